"""Embedding near-duplicates by PCA-ordered tiled comparison.

All vectors are turned into their principal axes (a rotation keeps cosines), largest variance first, and scaled to unit
length. Equal vectors are one class. Cosine >= t means a distance of at most sqrt(2 - 2t), so vectors are laid into
cells of that width along the first axes, and only neighbouring cells are compared; cells with many vectors are split
into blocks by a hash of the id. A tile is a pair of blocks of about BLOCK vectors at most. In it, a strip of rows at a
time, products over the leading axes are summed first: as many axes as leave SUFFIX of the vectors' squared length. A
pair is given up if that sum plus the product of what the two vectors have left (their suffix norms) is under the
threshold. The suffix norm stands as one more coordinate, so sum and bound are one product; it is taken in single
precision, with a slack far above its error. The remaining axes are added only for the rows and columns of a strip that
still have a pair, and what reaches the threshold is decided by the cosine of the given vectors in double precision.

A tile returns, for each vector, how many vectors it links to and the least vector that it is connected with inside the
tile, never pairs; so a group of any size gives a row for each of its vectors and tile.

Cases: vectors that are null, zero or with null or non-finite components link with nothing and are kept, whatever other
rows their id has; vectors of different lengths have no cosine and are compared apart; very small and very large ones are
scaled first; rows with a null id link with nothing; equal vectors link, also under one id; rows with one id share its component and add up its links; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

THRESHOLD = 0.9
BLOCK = 8192
STRIP, PAIRS = 512, 100_000  # rows of a block multiplied at once; pairs decided together
SUFFIX, SLACK = 0.45, 1e-4  # share of the squared length left after the leading axes; far above the error of single precision
AXES = 2  # along which cells are laid at least
BROADCAST_ROWS = 200_000


def usable(vector: str) -> Column:
    """Whether a vector of doubles can have a cosine; never null."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & good, F.lit(False))


def units(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    scaled = raw / big
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, vector: str, dim: int) -> np.ndarray:
    """Axes as columns, by falling variance, from the second moments of all unit vectors: dim * dim sums, no more."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = units(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["k", "m"])

    sums = vectors.select(vector).mapInArrow(moments, "k long, m double").groupBy("k").agg(F.sum("m").alias("m")).collect()
    matrix = np.zeros(dim * dim)
    for r in sums:
        matrix[r["k"]] = r["m"]
    values, axes = np.linalg.eigh(matrix.reshape(dim, dim))
    return axes[:, np.argsort(-values)]


def leading(projected: np.ndarray) -> int:
    """How many axes to sum first: at most SUFFIX of the squared length is left after them, on average."""
    left = 1 - np.cumsum((projected**2).mean(axis=0)) if len(projected) else np.zeros(projected.shape[1])
    return int(min(np.searchsorted(-left, -SUFFIX) + 1, projected.shape[1]))


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places (i, j) of two blocks of raw vectors, a strip of a at a time; i < j if it is the same block."""
    ua, ub = units(a), units(b)
    pa_, pb = ua @ axes, ub @ axes
    k = leading(pb)
    head = [np.column_stack((p[:, :k], np.sqrt((p[:, k:] ** 2).sum(axis=1)))).astype(np.float32) for p in (pa_, pb)]
    for s in range(0, len(a), STRIP):
        go = head[0][s : s + STRIP] @ head[1].T >= threshold - SLACK
        if same:
            go &= np.arange(len(b)) > np.arange(s, s + len(go))[:, None]
        rows, columns = np.flatnonzero(go.any(axis=1)), np.flatnonzero(go.any(axis=0))
        if not len(rows):
            continue
        total = pa_[s + rows] @ pb[columns].T
        i, j = np.nonzero(go[np.ix_(rows, columns)] & (total >= threshold - 1e-9))
        i, j = s + rows[i], columns[j]
        good = np.concatenate([(ua[i[q : q + PAIRS]] * ub[j[q : q + PAIRS]]).sum(axis=1) >= threshold for q in range(0, len(i), PAIRS)] or [np.empty(0, bool)])
        yield i[good], j[good]


def least_connected(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels until both ends of each pair have the least of their connected part."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        if (labels[i] == low).all() and (labels[j] == low).all():
            return
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, axes_used: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    good = F.col("id").isNotNull() & usable("v")
    named = cut(rows.filter(good).select("id", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256).alias("name"), "v", F.array_max(F.transform("v", F.abs)).alias("big")))
    out = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for dim in sorted(r["dim"] for r in named.select(F.size("v").alias("dim")).distinct().collect()):  # lengths: one in most tables
        out = out.unionByName(_of_length(named.filter(F.size("v") == dim), dim, threshold, block, axes_used))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def axes_for(n: int) -> int:
    """Axes to lay cells along: two, and one more for each tenfold of 100,000 vectors, six at most."""
    return min(6, max(AXES, AXES + int(np.log10(max(n, 1) / 100_000)))) if n > 100_000 else AXES


def _of_length(named: DataFrame, dim: int, threshold: float, block: int, axes_used: int | None) -> DataFrame:
    """(id, n_links, component_id) of vectors (id, name, v, and big, the largest component) that can be used and have one length."""
    kind = named.schema["id"].dataType.simpleString()
    kinds = cut(named.groupBy("name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("big").alias("big")))
    axes = principal_axes(kinds, "v", dim)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    # scaled by the largest component first, as squares of very small or large ones would vanish or overflow
    scaled = kinds.withColumn("u", F.transform("v", lambda x: x / F.col("big")))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    used = min(axes_used or axes_for(kinds.count()), dim)
    along = [F.aggregate(F.zip_with("u", F.array(*map(F.lit, axes[:, k].tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / norm for k in range(used)]
    celled = scaled.select("rep", "n", "v", *[F.floor(c / width).cast("int").alias(f"c{k}") for k, c in enumerate(along)])
    cells = [f"c{k}" for k in range(used)]
    filled = celled.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    filled = cut(filled)
    many = filled.count()  # cells along a few axes of the unit sphere: (2 / width + 1) ** AXES at most
    placed = celled.join(F.broadcast(filled) if many <= BROADCAST_ROWS else filled, cells).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    parts = filled.select(*cells, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    other = parts.select(*[F.col(c).alias(f"o{c}") for c in cells], F.col("part").alias("opart"))
    near = parts
    for c in cells:
        near = near.withColumn("s", F.explode(steps)).withColumn(f"o{c}", F.col(c) + F.col("s")).drop("s")
    mine, theirs = F.struct(*cells, "part"), F.struct(*[F.col(f"o{c}").alias(c) for c in cells], F.col("opart").alias("part"))
    tiles = near.join(other, [f"o{c}" for c in cells]).filter(mine <= theirs).select(mine.alias("one"), theirs.alias("two"))
    tiles = tiles.withColumn("tile", F.xxhash64("one", "two")).select("tile", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("b"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("one").alias("b"), F.lit(0).alias("side")), F.struct(F.col("two").alias("b"), F.lit(1).alias("side"))))).alias("x"))
    tiles = cut(tiles.select("tile", "x.side", *[F.col(f"x.b.{c}").alias(c) for c in cells], F.col("x.b.part").alias("part")))
    dealt = placed.join(F.broadcast(tiles) if tiles.count() <= BROADCAST_ROWS else tiles, [*cells, "part"]).select("tile", "side", "rep", "n", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        ids, n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        raw = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(two)
        if same:
            two = one
        order = np.argsort(ids)
        labels = np.empty(len(ids), np.int64)
        labels[order] = np.arange(len(ids))
        count = np.zeros(len(ids), np.int64)
        seen_i, seen_j = [], []
        for i, j in compare(raw[one], raw[two], axes, threshold, same):
            i, j = one[i], two[j]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            # a forest of this strip's pairs is enough to connect what they connect
            before = np.arange(len(ids))
            least_connected(before, i, j)
            moved = np.flatnonzero(before != np.arange(len(ids)))
            seen_i.append(moved)
            seen_j.append(before[moved])
        least_connected(labels, np.concatenate([*seen_i, np.empty(0, np.int64)]), np.concatenate([*seen_j, np.empty(0, np.int64)]))
        got = np.flatnonzero(count)
        return pd.DataFrame({"rep": ids[got], "n": count[got], "least": ids[order[labels[got]]]})

    found = cut(dealt.groupBy("tile").applyInPandas(run, f"rep {kind}, n long, least {kind}"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    of_kind = kinds.select("name", "rep", "n").join(counts, "rep", "left").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_kind = of_kind.select("name", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return named.select("id", "name").join(of_kind, "name").select("id", "n_links", "component_id")


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
