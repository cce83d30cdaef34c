"""The corpus pipeline, stage by stage, against what each operator says of its own input."""

import importlib.util
import random

import pytest

from tests.llm.test_llm import brute_classes, words

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from lotlens.llm import sentencepiece_bpe

    rng = random.Random(20)
    texts = [words(rng, rng.randint(10, 120)) for _ in range(40)]
    item = words(rng, 20)
    texts += [texts[0], texts[1] + " end", None, "1234", words(rng, 30) + " " + item + " " + words(rng, 30), texts[2] + " token=abcdefgh12", "clean token = 0123456789abcdef0123456789abcdef " + words(rng, 20)]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, held = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        held.append(at)
    ids = [sorted(r["doc_id"] for r in h.select("doc_id").collect()) for h in held]
    assert all(h.columns == docs.columns for h in held[:5])
    assert ids[1] == [i for i in range(len(texts)) if texts[i] and any(c.isalpha() for c in texts[i])]
    kept = brute_classes([texts[i] for i in ids[1]], ids[1])
    assert ids[2] == [i for i in ids[1] if kept[i] == i]
    assert ids[3] == [i for i in ids[2] if item not in texts[i]] and ids[3] != ids[2]
    masked = {r["doc_id"]: r["text"] for r in held[4].collect()}
    assert masked[46].startswith("clean [secret]") and masked[3] == texts[3]
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.tokenizer_path())
    assert {r["doc_id"]: r["token_ids"] for r in held[5].collect()} == {i: lib.encode(t, add_eos=True) for i, t in masked.items()}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["ids_sha256"] for r in again.collect()) == sorted(r["ids_sha256"] for r in held[5].collect())
