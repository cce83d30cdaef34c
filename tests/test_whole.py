"""Queries that read all of their tables: nothing of a text, a turn, an order or a day is left out."""

from lotlens.plans.registry import QUERIES


def test_normalized_text_is_whole(spark, tmp_path):
    text = "  É " * 300 + "END"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = QUERIES["normalized_text_whole"](spark, str(tmp_path)).first()
    assert (r["plain"], r["n"], r["words"]) == ("e " * 300 + "end", len(text), 301)


def test_fingerprints_are_of_the_whole_text(spark, tmp_path):
    one, two = " ".join(f"a{i}" for i in range(2000)), " ".join(f"b{i}" for i in range(2000))
    texts = ["same " + one, "same " + two, "same " + one, "other " + one]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["a"], r["b"]): r["distance"] for r in QUERIES["hamming_near_dupes_whole"](spark, str(tmp_path)).collect()}
    assert got.pop((0, 2)) == 0  # equal texts
    assert set(got) <= {(0, 3)} and (0, 3) in got  # another opening; not (0, 1), which share it and nothing else


def test_all_words_orders_and_days(spark, data):
    talks, orders = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("conversations", "orders"))
    assert QUERIES["words_with_ordinality_whole"](spark, data).count() == sum(len(r["text"].split(" ")) for r in talks.collect())
    assert QUERIES["insert_if_absent_whole"](spark, data).count() == orders.select("o_custkey", "o_orderstatus").distinct().count()
    assert sum(r["n"] for r in QUERIES["decision_metrics_windows_whole"](spark, data).collect()) == orders.count()
