"""Removal of repeated passages: longest-previous-factor arrays over content-anchored segments.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a row with a smaller id, or earlier in
the same text. Strings are judged on the input, and never cross rows.

A text's windows of LENGTH bytes are cut into segments: each window is anchored at the least hash among its GRAM-byte
grams, and neighbouring windows with one anchor make a segment. The anchor depends on the window's bytes alone, so
equal windows have equal anchors. Hence:

1. Whole copies of a text are told by SHA-256; all but the first go without a look.
2. Anchors that occur once are dropped; so is most of a corpus. Segments of the others that equal an earlier segment
   go as a whole: one row with a hash stands for all of its windows.
3. What is left are first segments that share an anchor with other contents, around the ends of repeats. Their bytes
   are gathered by anchor, put in suffix order (ranks of prefixes by doubling), and previous and next smaller positions
   in that order give each start's longest previous factor; starts with a factor of LENGTH go.
4. An anchor with more than GROUP such contents (a passage that a great many texts share, with other surroundings) is
   not gathered, as it has no bound. Its segments are cut again at a second anchor of each window, the least under
   another hash, and steps 2 and 3 are taken with the pair of anchors in the anchor's place; so on, down to segments of
   one window after LEVELS cuts, where step 2 alone decides. The inside of the shared passage falls into segments that
   are equal in all texts and goes by step 2; each cut leaves less around its ends.

Cases: null is the empty text; texts under LENGTH bytes lose nothing and take nothing; ids may be of any type that has an
order; rows with a null id come before all others; rows with one id come in the order of their SHA-256, equal rows one
after the other; empty tables give empty results; further columns are ignored. Hashes of 128 bits stand for segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, small_batches, table

LENGTH, GRAM = 100, 32
LEVELS = 4  # cuts of a hot anchor's segments, the last one into single windows
GROUP = 16_384  # contents of one anchor that a task takes at once: about 130 bytes each, so 2 MB
CHUNK = 600_000  # bytes of segments whose suffixes are ordered together
BROADCAST_ROWS = 1_000_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_BYTES = tuple(mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (k + 1))) for k in range(2))
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _sums(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' values times powers of a base, and the powers' inverses: hashes of any substring."""
    if not _POWERS or len(_POWERS[0][0]) <= len(raw):
        size = max(1 << 16, 2 * len(raw))
        _POWERS.clear()
        for base in _BASES:
            both = []
            for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            _POWERS.append((both[0], both[1]))
    power, inverse = _POWERS[k]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[k][raw] * power[: len(raw)], dtype=np.uint64))), inverse


def substring_hash(raw: np.ndarray, start: np.ndarray, size: np.ndarray | int, k: int = 0) -> np.ndarray:
    sums, inverse = _sums(raw, k)
    return mix64((sums[start + size] - sums[start]) * inverse[start] + np.asarray(size, np.uint64))


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, content hash, first window, windows) of each segment of a text; each level has other anchors."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    if level >= LEVELS:  # each window by itself
        first = np.arange(len(raw) - length + 1)
        return substring_hash(raw, first, length), substring_hash(raw, first, length, 1), first, np.ones(len(first), np.int64)
    h = substring_hash(raw, np.arange(len(raw) - gram + 1), gram)
    if level:
        h = mix64(h + np.uint64(level))
    value, place, width = h, np.arange(len(h), dtype=np.int32), 1
    span = length - gram + 1
    while width < span:  # leftmost least hash of each run of grams, by doubling
        step = min(width, span - width)
        left = value[:-step] <= value[step:]
        place = np.where(left, place[:-step], place[step:])
        value = np.minimum(value[:-step], value[step:])
        width += step
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    n = np.diff(np.append(first, len(place)))
    anchor = place[first].astype(np.int64)
    content = mix64(substring_hash(raw, first, n + length - 1, 1) + (anchor - first).astype(np.uint64))
    return h[anchor], content, first, n


def prefix_ranks(data: np.ndarray, limit: int) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... bytes at each place; past the end counts as less than any byte."""
    ranks, width = [data.astype(np.int32) + 1], 1
    while width * 2 <= limit:
        r = ranks[-1].astype(np.int64)
        pair = r * (int(r.max(initial=0)) + 1) + np.append(r[width:], np.zeros(min(width, len(r)), np.int64))
        ranks.append((np.unique(pair, return_inverse=True)[1] + 1).astype(np.int32))
        width *= 2
    return ranks


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and j, limit at most."""
    size, n = np.zeros(len(i), np.int64), len(ranks[0])
    for k in [len(ranks) - 1, *range(len(ranks) - 1, -1, -1)]:
        a, b = i + size, j + size
        inside = (np.maximum(a, b) + (1 << k) <= n) & (size + (1 << k) <= max(limit, 1 << (len(ranks) - 1)) + (1 << k))
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        size += same << k
    return np.minimum(size, limit)


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the previous and the next smaller value, -1 where there is none."""

    def previous(v: np.ndarray) -> np.ndarray:
        least, at = [v], np.arange(len(v))
        while 1 << len(least) <= len(v):
            k = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-k], least[-1][k:]))
        for k in range(len(least) - 1, -1, -1):
            back = at - (1 << k)
            at = np.where((back >= 0) & (least[k][np.maximum(back, 0)] >= v), back, at)
        return at - 1

    forward = previous(values[::-1])[::-1]
    return previous(values), np.where(forward < 0, -1, len(values) - 1 - forward)


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For each start, the longest common prefix, limit at most, with a start before it in the given order.

    The starts' suffixes are put in order; of all earlier starts, the nearest ones on either side in that order (the
    previous and next smaller positions) share the longest prefixes.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    ranks = prefix_ranks(data, limit)
    keys, at, left = [], 0, limit
    for k in range(len(ranks) - 1, -1, -1):
        while left >= 1 << k:
            place = starts + at
            keys.append(np.where(place < len(data), ranks[k][np.minimum(place, len(data) - 1)], 0))
            at, left = at + (1 << k), left - (1 << k)
    order = np.lexsort((np.arange(len(starts)), *keys[::-1])).astype(np.int32)
    out = np.zeros(len(starts), np.int64)
    for near in smaller_neighbours(order):
        has = near >= 0
        mine, its = order[has], order[near[has]]
        out[mine] = np.maximum(out[mine], common_prefix(ranks, starts[mine], starts[its], limit))
    return out


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rid, raw) of the first rows of all texts, and (doc_id, rid, sha, n_bytes, copy) of all rows; rid orders texts."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")).withColumn("sha", F.sha2("raw", 256))
    named = cut(rows.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("c"), F.max(F.octet_length("raw")).alias("n_bytes")))
    clash = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.max("c").alias("c")).agg(F.max("m").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.max("c").alias("c")).first()
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    simple = whole and (clash["m"] or 1) == 1 and not clash["nulls"]
    if simple:
        named = named.withColumn("rid", F.col("doc_id").cast("long"))
    else:  # a sort by range: numbers rise with the order, whatever the ids are
        named = cut(named.orderBy(F.col("doc_id").asc_nulls_first(), "sha").withColumn("rid", F.monotonically_increasing_id()))
    first = named.groupBy("sha").agg(F.min("rid").alias("first"))
    named = cut(named.join(first, "sha").withColumn("copied", F.col("rid") != F.col("first")).drop("first"))
    copies = named.filter("copied").select("doc_id", "sha")
    if simple:
        firsts = rows.join(bounded(copies, copies.count()), ["doc_id", "sha"], "left_anti").select(F.col("doc_id").cast("long").alias("rid"), "raw")
        if (clash["c"] or 1) > 1:  # rows repeated as a whole stand once; only their texts move
            again = named.filter(~F.col("copied") & (F.col("c") > 1)).select("rid")
            again = bounded(again, again.count())
            firsts = firsts.join(again, "rid", "left_anti").unionByName(firsts.join(again, "rid", "left_semi").dropDuplicates(["rid"]))
    else:
        kept = named.filter(~F.col("copied")).select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), "rid")
        firsts = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))).select("rid", "raw").dropDuplicates(["rid"])
    return firsts, named.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).drop("c")


def _cut_segments(texts: DataFrame, whole: bool, level: int = 0) -> DataFrame:
    """Anchor hashes (h) of all segments of (rid, raw), or their rows (h, g, rid, s, n).

    Above level 0 the rows are segments (h, rid, s, raw) of hot anchors, and the new anchor is told from the old one's h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [segments(np.frombuffer(t, np.uint8), level=level) for t in b.column("raw").to_pylist()]
            join = lambda k, kind: np.concatenate([*(x[k] for x in got), np.empty(0, kind)]).astype(kind)  # noqa: E731, B023
            sizes = [len(x[0]) for x in got]
            h = join(0, np.uint64)
            if level:
                h = mix64(np.repeat(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), sizes) ^ mix64(h))
            columns = [pa.array(h.view(np.int64))]
            if whole:
                start = join(2, np.int32)
                if level:
                    start = start + np.repeat(b.column("s").to_numpy(zero_copy_only=False), sizes)
                rid = np.repeat(b.column("rid").to_numpy(zero_copy_only=False), sizes)
                columns += [pa.array(join(1, np.uint64).view(np.int64)), pa.array(rid), pa.array(start), pa.array(join(3, np.int16))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "rid", "s", "n"][: len(columns)])

    return texts.select(*(["h", "s"] if level else []), "rid", "raw").mapInArrow(run, "h long, g long, rid long, s int, n short" if whole else "h long")


def _bytes_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, hot, rid, s, n, raw) of the wanted segments (h, hot, rid, s, n)."""
    by_text = cut(wanted.groupBy("rid").agg(F.collect_set(F.struct("h", "hot", "s", "n")).alias("w")))
    near = texts.join(bounded(by_text.select("rid"), by_text.count()), "rid", "left_semi").join(by_text, "rid")
    return near.select("rid", "raw", F.explode("w").alias("w")).select("w.h", "w.hot", "rid", "w.s", "w.n", F.substring("raw", F.col("w.s") + 1, F.col("w.n") + F.lit(LENGTH - 1)).alias("raw"))


def _by_factor(parts: DataFrame) -> DataFrame:
    """(rid, start, end) of what the longest previous factors remove; parts come with all of an anchor together."""

    def judge(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        group.sort(key=lambda x: (x[1], x[2]))
        sizes = np.array([len(x[4]) for x in group])
        n = np.array([x[3] for x in group])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(group)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # windows of one text by start, whatever segment they are in, as the group's order is by text and start
        gone = longest_previous_factor(np.frombuffer(b"".join(x[4] for x in group), np.uint8), begin[owner] + within, LENGTH) >= LENGTH
        at = np.flatnonzero(gone)
        if len(at):
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
            firsts, lasts = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            for f, e in zip(firsts.tolist(), lasts.tolist(), strict=True):
                _, rid, s, _, _ = group[owner[f]]
                yield rid, s + int(within[f]), s + int(within[e]) + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = list(judge(rows))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["rid", "start", "end"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "rid", "s", "n", "raw")), strict=True):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out(held)

    return parts.mapInArrow(run, "rid long, start int, end int")


def _level(texts: DataFrame, source: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(rid, start, end) of what goes by the anchors of one level, and the segments (h, rid, s, raw) that are still hot."""
    again = _cut_segments(source, False, level).groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1).select("h")
    shared = cut(_cut_segments(source, True, level).join(again, "h"))
    contents = cut(shared.groupBy("h", "g").agg(F.min(F.struct("rid", "s", "n")).alias("first")))
    place = F.struct("rid", "s")
    whole = shared.join(contents, ["h", "g"]).filter(place > F.struct("first.rid", "first.s")).select("rid", F.col("s").alias("start"), (F.col("s") + F.col("n") + F.lit(LENGTH - 1)).cast("int").alias("end"))
    groups = contents.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    wanted = contents.join(groups, "h").select("h", (F.col("k") > GROUP).alias("hot"), "first.rid", "first.s", "first.n")
    parts = cut(_bytes_of(texts, wanted))
    small = parts.filter(~F.col("hot")).select("h", "rid", "s", "n", "raw").repartition("h").sortWithinPartitions("h", "rid", "s")
    return whole.unionByName(_by_factor(small)), parts.filter("hot").select("h", "rid", "s", "raw")


def removed(texts: DataFrame) -> DataFrame:
    """(rid, spans) of the texts (rid, raw) that lose bytes: (start, end) pairs, which may overlap."""
    spans, hot = _level(texts, texts, 0)
    for level in range(1, LEVELS + 1):
        if not hot.limit(1).count():
            break
        more, hot = _level(texts, hot, level)
        spans = spans.unionByName(more)
    return spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def apply_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(rid, kept, n_removed, n_spans) of the texts that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone, runs = [], [], []
            for raw, found in zip(b.column("raw").to_pylist(), b.column("spans").to_pylist(), strict=True):
                out, last = [], 0
                spans_ = merged([(x["start"], x["end"]) for x in found])
                for s, e in spans_:
                    out.append(raw[last:s])
                    last = e
                kept.append(b"".join([*out, raw[last:]]))
                gone.append(len(raw) - len(kept[-1]))
                runs.append(len(spans_))
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=["rid", "kept", "n_removed", "n_spans"])

    near = texts.join(bounded(spans.select("rid"), spans.count()), "rid", "left_semi").join(spans, "rid")
    return near.select("rid", "raw", "spans").mapInArrow(run, "rid long, kept binary, n_removed long, n_spans long")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    small_batches(docs.sparkSession)
    texts, rows = _texts(docs, key, text)
    spans = cut(removed(texts))
    lost = apply_spans(texts, spans).select("rid", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    again = F.col("copied") | (F.col("copy") > 1)
    long = F.col("n_bytes") >= LENGTH

    def pick(copied: Column, own: str, other: Column) -> Column:
        return F.when(again, F.when(long, copied).otherwise(other)).otherwise(F.coalesce(own, other))

    none = F.lit(0).cast("long")
    size = F.col("n_bytes").cast("long")
    return rows.join(lost, "rid", "left").select("doc_id", size.alias("n_bytes"), pick(size, "n_removed", none).alias("n_removed"), pick(F.lit(1).cast("long"), "n_spans", none).alias("n_spans"), pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")).alias("kept_sha256"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
