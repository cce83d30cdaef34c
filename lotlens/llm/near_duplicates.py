"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Documents are sets of shingles of five words, all of weight one, however often a text repeats them: links are verified by
the Jaccard of the sets, and so the search has to go by it. Each shingle is a Poisson process with its weight as rate,
whose arrivals fall on the signature's components at random; a component keeps the shingle that arrives first, and a
document's processes end once the next arrivals are later than all components (early termination). Two documents agree
on a component with the probability Jaccard of their weights, which is the sets' own Jaccard where all are one.

Texts with the same words in the same order are one class from the start, under the name of that wording. Classes meet
in the buckets of BANDS bands of ROWS components. In each bucket the most typical member, the one that meets most others
in all its buckets, is compared with the rest, so a group of any size costs its size and not its square.

Where a bucket still holds several components after that, its members go through an exact prefix join: with shingles in
order of rarity, two sets of a Jaccard of 0.8 share one of the first fifth of both. Members meet at such a shingle only
if they are of different components, and only those outside the shingle's largest component look for partners, so what a
star has joined already costs nothing again. A member that can't reach 0.8 with even the smallest set at the shingle,
by its place in the order, goes before any pair is made. These bounds are exact: no link that a bucket could show is
lost. Each comparison is the exact Jaccard of the distinct shingles, 0.8 or more.

Cases: texts without words are copies if they are equal, null being the empty text; texts of fewer than five words are
one shingle; rows with a null id get the class of their text, null if no row of it has an id, and are kept; rows that
repeat an id are told by their wording, each in the class of its own text, and one row of a class is kept at most; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, pieces, shingles_of, small_batches, table, word_hashes
from .components import components, extended

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
BROADCAST_ROWS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures, a row of element hashes for each (elements, weights); zeros where there are none."""
    n = np.array([len(e) for e, _ in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), n)
    element = np.concatenate([*(e for e, _ in sets), np.empty(0, np.uint64)]).astype(np.uint64)
    weight = np.concatenate([*(w for _, w in sets), np.empty(0)])
    best, kept = np.full(len(sets) * size, np.inf), np.zeros(len(sets) * size, np.uint64)
    time, state = np.zeros(len(element)), mix64(element ^ np.uint64(0x5851F42D4C957F2D))
    while len(element):
        with np.errstate(over="ignore"):
            state = state + _STEP
        draw = mix64(state)
        time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        slot = doc * size + (mix64(draw ^ _STEP) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        kept[slot[first]] = element[first]
        go = time < best.reshape(-1, size).max(axis=1)[doc]
        doc, element, weight, time, state = doc[go], element[go], weight[go], time[go], state[go]
    return kept.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, -1)
    out = np.repeat(mix64(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), axis=0)
    with np.errstate(over="ignore"):
        for k in range(parts.shape[2]):
            out = mix64(out * _STEP + parts[:, :, k])
    return out


def wording(text: str, words: np.ndarray | None = None) -> bytes:
    """A name that texts share if they have the same words in the same order; texts without words, if they are equal."""
    words = word_hashes(text) if words is None else words
    return hashlib.blake2b(words.tobytes() if len(words) else b"text:" + text.encode("utf-8", "replace"), digest_size=16).digest()


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, wording, bands) of every row; bands is empty for texts without words."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys = [], []
            for part in pieces([(t or "",) for t in b.column("__text").to_pylist()], 1_000_000):
                sets = []
                for (t,) in part:
                    w = word_hashes(t)
                    names.append(wording(t, w))
                    e = np.unique(shingles_of(w, SHINGLE))
                    sets.append((e, np.ones(len(e))))
                made = band_keys(signatures(sets, bands * rows), bands).view(np.int64).tolist()
                keys += [k if len(s[0]) else [] for k, s in zip(made, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "wording", "bands"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("__text")).mapInArrow(run, f"id {kind}, wording binary, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(w, h): the wording and the distinct shingles of rows with a text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sets = [], []
            for t in b.column("text").to_pylist():
                w = word_hashes(t or "")
                names.append(wording(t or "", w))
                sets.append(np.unique(shingles_of(w, SHINGLE)).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), flat], names=["w", "h"])

    return docs.select("text").mapInArrow(run, "w binary, h array<bigint>")


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _sets_of(wanted: DataFrame, worded: DataFrame, texts: DataFrame) -> DataFrame:
    """(w, h) of the wanted wordings (w). Only texts of ids that stand for one move; a further text of such an id goes again."""
    near = cut(worded.select("w", "rep").join(wanted, "w"))
    n = near.count()
    found = shingle_sets(texts.join(bounded(near.select(F.col("rep").alias("id")).distinct(), n), "id", "left_semi"))
    return cut(found.join(bounded(near.select("w"), n), "w", "left_semi").dropDuplicates(["w"]))


def verified(pairs: DataFrame, worded: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of wordings whose exact Jaccard reaches the threshold."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), worded, texts)
    both = pairs.join(sets.select(F.col("w").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("w").alias("b"), F.col("h").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    jaccard = shared / (F.size("x") + F.size("y") - shared)
    return both.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, w, class_id) of every row: class_id is the least id of the near copies that it is linked with, directly or not."""
    signed = cut(sign(docs, key, text))
    worded = cut(signed.groupBy(F.col("wording").alias("w")).agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    members = worded.filter(F.col("rep").isNotNull()).select("w", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = cut(members.join(sizes, "bucket"))
    usual = shared.groupBy("w").agg(F.sum("n").alias("total"))
    met = cut(shared.select("bucket", "w").join(usual, "w"))
    centers = met.groupBy("bucket").agg(F.max(F.struct("total", "w")).alias("c")).select("bucket", F.col("c.w").alias("center"))
    starred = met.join(centers, "bucket").filter(F.col("w") != F.col("center"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    pairs = cut(starred.select(F.least("w", "center").alias("a"), F.greatest("w", "center").alias("b")).distinct())
    links = cut(verified(pairs, worded, texts, threshold).select("a", "b"))
    joined = cut(components(links))
    rest = cut(_across(met, joined, worded, texts, threshold).join(pairs, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        joined = extended(joined, cut(verified(rest, worded, texts, threshold).select("a", "b")))
    named = worded.select("w", "rep").join(joined.select(F.col("id").alias("w"), "component"), "w", "left").select("w", "rep", F.coalesce("component", "w").alias("component"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    return signed.select("id", F.col("wording").alias("w")).join(named.select("w", "component").join(least, "component"), "w").select("id", "w", "class_id")


def _across(met: DataFrame, joined: DataFrame, worded: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold, of members of buckets with several components.

    A set of n shingles, in order of rarity among these members, has in its first n - ceil(t n) + 1 one that it shares
    with any set of a Jaccard of t. At a common shingle that leaves rest shingles of either from there on, the overlap is
    the lesser rest at most, if it is the first they share, which holds for one of the shingles they meet at.
    """
    placed = met.join(joined.select(F.col("id").alias("w"), "component"), "w", "left").select("bucket", "w", F.coalesce("component", "w").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter(F.col("c") != F.col("d")).select("bucket")
    members = cut(placed.join(mixed, "bucket").select("w", "component").distinct())
    sets = cut(_sets_of(members.select("w"), worded, texts).select("w", F.explode("h").alias("h")))
    times = sets.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    ranked = sets.join(times, "h", "left").groupBy("w").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "h"))).alias("s"))
    first = F.size("s") - F.ceil(F.size("s") * F.lit(threshold) - 1e-9).cast("int") + 1
    spread = ranked.select("w", F.size("s").alias("n"), F.posexplode(F.slice("s", F.lit(1), first)).alias("at", "x")).filter(F.col("x.k") > 1)
    here = spread.join(members, "w").select(F.col("x.h").alias("h"), "w", "component", "n", (F.col("n") - F.col("at")).alias("rest"))
    here = cut(_mixed(here))
    smallest = here.groupBy("h").agg(F.min("n").alias("least"))
    fits = F.col("rest") >= threshold * (F.col("n") + F.greatest("least", "rest") - F.col("rest")) - 1e-9
    left = cut(_mixed(here.join(smallest, "h").filter(fits).select("h", "w", "component", "n", "rest")))
    minor = left.filter(F.col("component") != F.col("largest")).select("h", F.col("w").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    other = left.select("h", F.col("w").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("rest").alias("ry"))
    most = F.least("rx", "ry")
    pairs = minor.join(other, "h").filter((F.col("cx") != F.col("cy")) & (most >= threshold * (F.col("nx") + F.col("ny") - most) - 1e-9))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mixed(here: DataFrame) -> DataFrame:
    """The rows (h, w, component, n, rest) of shingles with several components, and each shingle's largest."""
    sizes = here.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("h").agg(F.max(F.struct("k", "component")).alias("t"), F.count(F.lit(1)).alias("several")).filter(F.col("several") > 1).select("h", F.col("t.component").alias("largest"))
    return here.select("h", "w", "component", "n", "rest").join(top, "h")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs but for near copies: of each class the row with the least id stays.

    Rows that repeat an id are judged by their own texts; of those of one class with its least id one stays, the least by
    text. Rows with a null id stay, as nothing tells them apart.
    """
    found = cut(classes(docs, key, text).filter(F.col("id").isNotNull()))
    by_id = cut(found.groupBy("id").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    several = by_id.filter("n > 1").select(F.col("id").alias(key))
    gone = by_id.filter((F.col("id") != F.col("class_id")) & (F.col("n") == 1)).select(F.col("id").alias(key))
    left = docs.join(bounded(gone, gone.count(), 5 * BROADCAST_ROWS), key, "left_anti").select(*docs.columns)
    if not (n := several.count()):
        return left
    several = bounded(several, n, 5 * BROADCAST_ROWS)
    row = F.struct(F.coalesce(text, F.lit("")).alias("t"), F.struct(*docs.columns).alias("r"))
    again = docs.join(several, key, "left_semi").select(F.col(key).alias("__id"), F.col(text).alias("__text"), row.alias("__row"))
    mine = _worded_rows(again).join(found.filter(F.col("id") == F.col("class_id")).select(F.col("id").alias("__id"), F.col("w").alias("__w")).distinct(), ["__id", "__w"])
    single = mine.groupBy("__id").agg(F.min("__row").alias("x")).select("x.r.*")
    return left.join(several, key, "left_anti").select(*docs.columns).unionByName(single)


def _worded_rows(rows: DataFrame) -> DataFrame:
    """The rows (__id, __text, __row) with the wording (__w) of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.array([wording(t or "") for t in b.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__row"), names], names=["__id", "__row", "__w"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"__id {kinds['__id']}, __row {kinds['__row']}, __w binary")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept of every row; of rows that are the same in id and class one is kept at most."""
    found = classes(table(spark, sf_dir, "documents")).groupBy("id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    rows = found.select(F.col("id").alias("doc_id"), "class_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    return rows.select("doc_id", "class_id", (F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("i") == 1))).alias("kept"))
