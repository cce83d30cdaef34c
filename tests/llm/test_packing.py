"""Packing against the tokenizer itself and the rules of a packing."""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotlens.llm import packing
from lotlens.llm.sentencepiece_bpe import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", "a", "  a  b\n\n c \n d", "it's  <|endoftext|> x", "'s''t don't", "\u3000x\u00a0 y\u1680z \x1c\x85w", "日本語 テスト 12٣ ½", "\U00010940\U00010940 \u0558 old and new letters", "x" * 3000, " " * 4000, "tab\t\ttab \t x", "é" * 2100, "\n" * 5 + "end"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(texts):
    return [x.ids + [packing.END_ID] for x in tokenizer().encode_batch(texts, add_special_tokens=False)]


def check(rows, texts_by_id, size=packing.SIZE):
    """The pieces make up the ids of the texts, and the sequences are gapless and hold size ids at most; the share that is padding."""
    want = defaultdict(list)
    for key, texts in texts_by_id.items():
        for ids in ids_of(texts):
            want[key].append(np.array(ids, "<u4").tobytes())
    sequences = defaultdict(list)
    covered = defaultdict(int)
    for r in rows:
        assert any(len(x) == 4 * r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in want[r.doc_id])
        assert r.length > 0 and r.start + r.length <= r.doc_tokens
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: sum(len(x) // 4 for x in v) for k, v in want.items()}
    wasted = 0
    for got in sequences.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        assert at <= size
        wasted += packing.padded(at, size) - at
    return wasted / max(sum(covered.values()), 1)


def test_ids_are_the_tokenizers():
    rng = np.random.default_rng(5)
    alphabet = list("ab'sé .,\n\t1½日\u00a0\u2028\u3000\x1c'") + [" ", " ", "'ll", "Ω", "\U0001f600", "\ua7d2"]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)]
    words = packing.Words(PATH, tokenizer_path("byte_bpe_50k.tiktoken"))
    want = [x[:-1] for x in ids_of(texts)]
    for n in (1, 7, 5000):
        got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), n) for x in words.ids(pa.array(texts[k : k + n], pa.string()))]
        assert got == want
    assert words.ids(pa.array([], pa.string())) == []


@pytest.mark.parametrize("lengths", [[600] * 50, [700] * 300 + [1024] * 5, list(range(1, 1024)), [1] * 5000, [513, 511, 1024, 1, 2, 3], []])
def test_plan_packs_every_length(lengths):
    lengths = np.array(sorted(lengths), np.int64)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    layout = packing.plan(counts)
    rank = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
    owner, start, n, sequence, offset = layout.placed(lengths, rank)
    fill = np.bincount(sequence, n, minlength=1).astype(int)
    assert n.sum() == lengths.sum() and (n > 0).all() and fill.max() <= packing.SIZE
    order = np.lexsort((offset, sequence))
    same = np.diff(sequence[order], prepend=-1) == 0
    assert (offset[order] == np.where(same, np.roll(offset[order] + n[order], 1), 0)).all()
    order = np.lexsort((start, owner))
    same = np.diff(owner[order], prepend=-1) == 0
    assert (start[order] == np.where(same, np.roll(start[order] + n[order], 1), 0)).all()
    assert sum(packing.padded(f) - f for f in fill.tolist()) <= packing.CUT_PRICE * lengths.sum()


def test_knapsack_is_the_best_filling():
    prices, lengths = np.array([3.1, 7.0, 11.9]), np.array([2, 5, 8])
    worth, last = packing.knapsack(prices, lengths, 20)
    for c in range(21):
        every = [a * 3.1 + b * 7 + d * 11.9 for a in range(11) for b in range(5) for d in range(3) if 2 * a + 5 * b + 8 * d == c]
        assert (not every and worth[c] == -np.inf) or np.isclose(worth[c], max(every))


def test_documents_of_all_kinds(spark):
    rows = [(k, t, "en", 5) for k, t in enumerate(ODD)] + [(3, "again", "en", 5), (None, None, None, 5), (None, "x y", "en", 5), (3, "again", "en", 5)]
    rows += [(100 + k, "word " * (k % 7 * 300), "en", 5) for k in range(40)] + [(200 + k, "all the same", "en", 5) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, rid int").repartition(5)
    texts = defaultdict(list)
    for k, t, *_ in rows:
        texts[k].append(t or "")
    got = packing.pack(docs).collect()
    assert check(got, texts) <= packing.CUT_PRICE
    small = packing.pack(docs, size=64, broadcast_rows=0, with_ids=True).collect()
    assert check(small, texts, 64) <= packing.CUT_PRICE
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in small)


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.op12_packing(spark, "/root/testdata/sf0.01").collect()
    assert check(got, {r.doc_id: [r.text] for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}) <= 0.002
