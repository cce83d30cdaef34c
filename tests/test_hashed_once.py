from lotlens.plans import registry


def test_near_duplicates_hash_the_texts_once(spark, data):
    made = registry.QUERIES["hamming_near_dupes_whole"](spark, data)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() > 0 and "md5" not in plan and "parquet" not in plan
