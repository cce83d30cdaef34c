"""Variant documents against the same done to dictionaries."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lotlens.functions import variants as V


def random_value(rng, depth=3):
    if depth and rng.random() < 0.5:
        return {rng.choice("abcd"): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([None, 1, 2.5, "x", True, [], [1, None], [{"a": None}]])


def merged(a, b):
    return {**a, **b} if isinstance(a, dict) and isinstance(b, dict) else b


def stripped(v, depth):
    return {k: stripped(x, depth - 1) if depth > 1 else x for k, x in v.items() if x is not None} if isinstance(v, dict) else v


def put(v, path, value, create=True):
    if not isinstance(v, dict) or ((len(path) > 1 or not create) and path[0] not in v):
        return v
    return {**v, path[0]: put(v[path[0]], path[1:], value, create) if len(path) > 1 else value}


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "number"


def test_as_dictionaries(spark):
    rng = random.Random(1)
    rows = [(k, random_value(rng), random_value(rng)) for k in range(300)]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in rows], "id int, a string, b string").select("id", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    a, b, seven = F.col("a"), F.col("b"), F.lit(7).cast("variant")
    got = df.select("id", V.kind(a).alias("kind"), V.has_key(a, "a").alias("has"), *[F.to_json(c).alias(n) for n, c in dict(m=V.merged(a, b), w=V.without(a, "a", "b"), s=V.stripped(a, 2), p=V.set_path(a, ["a", "b"], seven), q=V.set_path(a, ["c"], seven, create=False)).items()]).collect()
    for r in got:
        _, x, y = rows[r.id]
        assert (r.kind, r.has) == (kind(x), isinstance(x, dict) and "a" in x)
        want = (merged(x, y), {k: v for k, v in x.items() if k not in "ab"} if isinstance(x, dict) else x, stripped(x, 2), put(x, ["a", "b"], 7), put(x, ["c"], 7, False))
        assert tuple(json.loads(c) for c in (r.m, r.w, r.s, r.p, r.q)) == want, (x, y)


def test_no_document(spark):
    df = spark.createDataFrame([(None,)], "x string").select(F.parse_json("x").alias("x"))
    x, one = F.col("x"), F.parse_json(F.lit('{"a":1}'))
    assert tuple(df.select(V.merged(x, one).isNull(), V.merged(one, x).isNull(), V.kind(x).isNull(), V.stripped(x).isNull(), V.set_path(x, ["a"], one).isNull(), V.has_key(x, "a")).first()) == (True,) * 5 + (False,)


def test_objects_of_a_group(spark):
    df = spark.createDataFrame([(1, 3, "a", 1), (1, 1, "a", 2), (1, 2, "b", None), (1, 4, None, 5), (2, 1, "c", 1)], "g int, o int, k string, v int")
    got = df.groupBy("g").agg(V.object_agg(F.col("k"), F.col("v").cast("variant"), F.col("o")).alias("d")).select("g", F.to_json(V.built(d=F.col("d"), n=F.lit(None).cast("int"))).alias("j"))
    assert {r.g: json.loads(r.j) for r in got.collect()} == {1: {"d": {"a": 1, "b": None}, "n": None}, 2: {"d": {"c": 1}, "n": None}}
