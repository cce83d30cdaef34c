"""Packing of documents into sequences of one size by cutting-stock column generation.

Each document is tokenized once and ends with an end id. Its ids are cut at every SIZE: whole stretches fill a sequence
each, and what is left over is an item of 1 to SIZE - 1 ids. The items' lengths are counted, and a linear program over
patterns (which lengths share a sequence) says how often each pattern is used. Its columns are generated: the dual prices
of the lengths go into a knapsack by dynamic programming, which gives for every length the best pattern that has it, and
those that lower the cost come in. A pattern costs the ids it is padded to. Besides the patterns each length has a column
of its own, the stream, in which items are laid end to end and cut wherever a sequence is full: nothing is padded there,
but it costs CUT_PRICE more for each id, so a pattern padded by more than that share is never used, and lengths that
nothing complements (a third of all items of one length, say) are cut.

Patterns are rounded down, then up again while items last; what then remains is streamed. The items of each length are
ranked, and a rank says the pattern, the sequence and the place. Ranks are row numbers within (length, group) plus the
sizes of the groups before, and groups are counted beforehand, so a length that holds most items is spread. The program
sees only the histogram: SIZE numbers, whatever the corpus has. The last stretch of the stream is cut at powers of two.

Cases: a null or empty text is the end id alone; rows that repeat an id, null ids among them, are packed each for itself;
very long texts give many whole sequences; equal lengths are ranked by the order of the rows as read; an empty table gives
no pieces; further columns of the input do not reach the result.
"""

from __future__ import annotations

import base64
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored, table
from .sentencepiece_bpe import tokenizer_path

SIZE = 1024
END_ID = 0
CUT_PRICE = 0.005  # what streaming an id costs beside the id itself, and so the most that a pattern may be padded
ROUNDS, NEAR = 10, 0.02  # most pricing rounds; share of the ids in the stream at which the program is good enough
KNOWN_WORDS = 1_000_000  # spellings that a worker keeps; it starts afresh beyond them
PART_CHARS = 4_000_000  # characters encoded together, or one text
LEAST_GROUP, MOST_GROUP, GROUPS = 256, 100_000, 4096  # items ranked in one task together, and how many such groups if they fit

#: How byte-level BPE splits a text before its merges, and the special token of the vocabulary.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SPECIAL = "<|endoftext|>"
_USUAL = "^[!-~\u00c0-\u024f]([\n!-~\u00c0-\u024f]*[!-~\u00c0-\u024f])?$"  # no white space at either end, nothing odd
_ODD = regex.compile(r"[^\x00-\u024f]")


class Grown:
    """An array that grows at its end; held[:n] is in use."""

    def __init__(self, kind: type):
        self.held, self.n = np.empty(1 << 16, kind), 0

    def add(self, more: list | np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.empty(self.n + 2 * len(more), self.held.dtype)))
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Ids of texts by a tokenizers file and the same vocabulary as a file of ranks.

    A space between two characters that are none always starts a new split of the tokenizer, so texts are cut there, and
    each spelling of a batch is encoded once, many laid end to end. Texts with other spaces are encoded whole. Characters
    that the tokenizer and this process class differently (their Unicode versions may not be the same) and the special
    token send the whole text to the tokenizers library.
    """

    def __init__(self, path: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path = path
        with open(ranks, "rb") as f:
            byte_ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.merges = tiktoken.Encoding("byte_bpe", pat_str=SPLIT.pattern, mergeable_ranks=byte_ranks, special_tokens={})
        self.n_bytes = np.zeros(max(byte_ranks.values()) + 1, np.int64)
        for k, v in byte_ranks.items():
            self.n_bytes[v] = len(k)
        self.alike: dict[str, bool] = {}
        self._forget()

    @cached_property
    def tokenizer(self):
        """Loaded only once a text needs it, as it takes more memory than the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.later: dict[str, int] = {}  # numbers of the words after a space, which are encoded with it
        self.first: dict[str, int] = {}  # and of those that begin a text
        self.flat, self.begin, self.whole = Grown(np.uint32), Grown(np.int64), Grown(np.bool_)  # whole: the text is encoded whole
        self.begin.add([0])

    def _same(self, c: str) -> bool:
        if c not in self.alike:
            probe = f"a1 {c}{c}b2 {c}1{c}.{c}"
            self.alike[c] = [probe[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == SPLIT.findall(probe)
        return self.alike[c]

    def _odd(self, text: str) -> bool:
        return SPECIAL in text or not (text.isascii() or all(map(self._same, set(_ODD.findall(text)))))

    def _whole(self, word: str) -> bool:
        return word[:1].isspace() or word[-1:].isspace() or self._odd(word)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The numbers of words after a space; new ones are encoded as one text, in which each begins with its space."""
        at = np.fromiter(map(self.later.get, strings(words), itertools.repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            usual = pc.and_(pc.match_substring_regex(new, _USUAL), pc.invert(pc.match_substring(new, SPECIAL[:2]))).to_numpy(zero_copy_only=False)
            spelled = strings(new)
            whole = ~usual
            for k in np.flatnonzero(whole).tolist():
                whole[k] = not spelled[k] or self._whole(spelled[k])
            ids = self.merges.encode_to_numpy(" ".join(["", *strings(new.filter(pa.array(~whole)))]), disallowed_special=())
            n_bytes = np.where(whole, 0, pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            self.begin.add(self.flat.n + np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(n_bytes), "right"))
            at[fresh] = np.arange(self.whole.n, self.whole.n + len(new))
            self.later.update(zip(spelled, at[fresh].tolist(), strict=True))
            self.flat.add(ids)
            self.whole.add(whole)
        return at

    def _beginning(self, word: str) -> int:
        if word not in self.first:
            self.first[word] = self.whole.n
            odd = self._whole(word)
            self.flat.add([] if odd else self.merges.encode_ordinary(word))
            self.begin.add([self.flat.n])
            self.whole.add([odd])
        return self.first[word]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls) as little-endian unsigned 32-bit numbers."""
        if not len(texts):
            return []
        if len(self.later) + len(self.first) > KNOWN_WORDS:
            self._forget()
        parts = pc.split_pattern(texts, " ")  # every text has a part
        words, lists = parts.flatten(), parts.offsets.to_numpy()
        coded = pc.dictionary_encode(words)
        at = self._learn(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        at[lists[:-1]] = [self._beginning(w) for w in strings(words.take(pa.array(lists[:-1])))]
        whole = np.logical_or.reduceat(self.whole.held[at], lists[:-1])
        low = self.begin.held[at]
        n = self.begin.held[at + 1] - low
        reach = np.cumsum(n)
        flat = self.flat.held[np.repeat(low - reach + n, n) + np.arange(n.sum())].tobytes()
        ends = (4 * np.concatenate(([0], reach))[lists]).tolist()
        return [self._plainly(texts[k].as_py()) if w else flat[ends[k] : ends[k + 1]] for k, w in enumerate(whole.tolist())]

    def _plainly(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self._odd(text) else self.merges.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, "<u4").tobytes()


_WORDS: dict[str, Words] = {}


def words_of(path: str, ranks: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path, ranks)
    return _WORDS[path]


def tokenized(docs: DataFrame, path: str, ranks: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(rid, key, doc_tokens, crcs, ids) of every row: a number of its own, its ids with the end id as little-endian 32-bit
    numbers, and the CRC-32 of each stretch of size ids."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path, ranks)
        for b in batches:
            lengths = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            runs = (np.cumsum(lengths, dtype=np.int64) - lengths) // PART_CHARS
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(runs)) + 1):
                if not len(part):
                    continue
                some = b.slice(int(part[0]), len(part))
                raw = [x + end for x in words.ids(pc.fill_null(some.column("text"), ""))]
                crcs = [[zlib.crc32(x[s : s + 4 * size]) for s in range(0, len(x), 4 * size)] for x in raw]
                columns = [some.column("rid"), some.column("key"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "key", "doc_tokens", "crcs", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"rid long, key {kind}, doc_tokens long, crcs array<long>, ids binary")


# the program over the histogram


def padded(fill: int, size: int = SIZE) -> int:
    """What a sequence of so many ids takes: size, but a power of two stays as it is."""
    return fill if fill & (fill - 1) == 0 else size


def knapsack(prices: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that items of exactly so many ids in all are worth, for 0 to size, and the place of the last item taken (-1: none)."""
    worth = np.full(size + 1, -np.inf)
    worth[0] = 0
    last = np.full(size + 1, -1)
    for c in range(1, size + 1):
        n = np.searchsorted(lengths, c, "right")
        if n:
            value = worth[c - lengths[:n]] + prices[:n]
            k = n - 1 - int(value[::-1].argmax())  # of equals the longest item: shorter ones fit anywhere
            if value[k] > -np.inf:
                worth[c], last[c] = value[k], k
    return worth, last


def cheapening(prices: np.ndarray, lengths: np.ndarray, size: int, price: float) -> list[np.ndarray]:
    """Patterns (places of their items) that cost less than their items' prices, best first: for each length and each
    admissible fill the best pattern that has an item of that length."""
    worth, last = knapsack(prices, lengths, size)
    fills = [f for f in range(1, size + 1) if padded(f, size) <= (1 + price) * f]
    found: dict[tuple, float] = {}
    for f in fills:
        n = int(np.searchsorted(lengths, f, "right"))
        gain = worth[f - lengths[:n]] + prices[:n] - padded(f, size)
        for k in np.flatnonzero(gain > 1e-7 * size).tolist():
            took, c = [k], f - int(lengths[k])
            while c:
                took.append(int(last[c]))
                c -= int(lengths[took[-1]])
            found[tuple(sorted(took))] = float(gain[k])
    return [np.array(p) for p in sorted(found, key=found.get, reverse=True)]


def longest_first(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[np.ndarray]:
    """Patterns to begin with: the longest length left, then always the longest that still fits, as often as both last."""
    left, found = demand.copy(), []
    for k in range(len(lengths) - 1, -1, -1):
        while left[k]:
            taken, room, n = [], size, k + 1
            while room and n:
                n = min(int(np.searchsorted(lengths, room, "right")), n)
                n = int(np.flatnonzero(left[:n])[-1]) + 1 if left[:n].any() else 0
                if n:
                    times = int(min(room // lengths[n - 1], left[n - 1]))
                    taken += [n - 1] * times
                    room -= times * int(lengths[n - 1])
                    n -= 1
            places, times = np.unique(taken, return_counts=True)
            left[places] -= int((left[places] // times).min()) * times
            found.append(np.array(taken))
    return found


def program(lengths: np.ndarray, demand: np.ndarray, size: int = SIZE, price: float = CUT_PRICE) -> list[tuple[np.ndarray, float]]:
    """(places of the items, how often) of the patterns in a solution of the linear program, by the revised simplex method."""
    m = len(lengths)
    cost = (1 + price) * lengths.astype(float)
    inverse, x, columns = np.eye(m), demand.astype(float), [None] * m
    least = float((lengths * demand).sum())
    prices = cost.copy()
    for n in range(ROUNDS):
        if cost @ x - least <= NEAR * price * least:
            break
        entered = False
        for pattern in cheapening(prices, lengths, size, price) if n else longest_first(lengths, demand, size):
            paid = padded(int(lengths[pattern].sum()), size)
            gain = prices[pattern].sum() - paid
            if gain <= 1e-7 * size:
                continue
            kinds, times = np.unique(pattern, return_counts=True)
            step = inverse[:, kinds] @ times
            up = np.flatnonzero(step > 1e-9)
            if not len(up):
                continue
            row = up[(x[up] / step[up]).argmin()]
            amount = max(x[row], 0.0) / step[row]
            x -= amount * step
            x[row] = amount
            pivot = inverse[row] / step[row]
            prices = prices - gain * pivot
            touched = np.flatnonzero(step)
            inverse[touched] -= step[touched, None] * pivot
            inverse[row] = pivot
            cost[row], columns[row] = paid, pattern
            entered = True
        if not entered:
            break
    return [(p, float(n)) for p, n in zip(columns, x, strict=True) if p is not None and n > 0]


@dataclass
class Plan:
    """Where the item of each (length, rank) goes. Numbers grow with the lengths and patterns, not with the items."""

    size: int
    before: np.ndarray  # items of smaller lengths, by length
    start: np.ndarray  # first place in the order of (length, rank) of each run of ranks that share a pattern
    each: np.ndarray  # items of this length in one sequence of the pattern; 0: the stream
    sequence: np.ndarray  # first sequence of the pattern; in the stream, where the run begins
    offset: np.ndarray
    stream: int  # first sequence of the stream
    edges: np.ndarray  # where the last sequences of the stream begin, from the last whole one on; the end of the stream last
    whole: int  # whole sequences of the stream

    def placed(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in the input, start in the item, length, sequence, offset) of the pieces."""
        at = self.before[length] + rank
        run = np.searchsorted(self.start, at, "right") - 1
        within, each = at - self.start[run], self.each[run]
        flow = each == 0
        some = np.maximum(each, 1)
        sequence = self.sequence[run] + within // some
        offset = self.offset[run] + within % some * length
        first = np.where(flow, self.sequence[run] + within * length, 0)
        low, high = self._cell(first), self._cell(first + length - 1)
        n = np.where(flow, high - low + 1, 1)
        owner = np.repeat(np.arange(len(length)), n)
        cell = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.maximum(self._edge(cell), first[owner])
        stop = np.minimum(self._edge(cell + 1), first[owner] + length[owner])
        f = flow[owner]
        return owner, np.where(f, begin - first[owner], 0), np.where(f, stop - begin, length[owner]), np.where(f, self.stream + cell, sequence[owner]), np.where(f, begin - self._edge(cell), offset[owner])

    def _cell(self, position: np.ndarray) -> np.ndarray:
        tail = self.whole + np.searchsorted(self.edges, position, "right") - 1
        return np.where(position < self.whole * self.size, position // self.size, np.minimum(tail, self.whole + max(len(self.edges) - 2, 0)))

    def _edge(self, cell: np.ndarray) -> np.ndarray:
        return np.where(cell <= self.whole, cell * self.size, self.edges[np.clip(cell - self.whole, 0, len(self.edges) - 1)])


def rounded(lengths: np.ndarray, demand: np.ndarray, solution: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places, times in the pattern, how many sequences): rounded down, then once more for those cut off most while items last."""
    left, used = demand.copy(), {}
    kinds = [np.unique(p, return_counts=True) for p, _ in solution]
    amounts = np.array([n for _, n in solution])
    for k in np.argsort(-amounts, kind="stable").tolist():
        places, times = kinds[k]
        used[k] = int(min(np.floor(amounts[k] + 1e-6), (left[places] // times).min()))
        left[places] -= used[k] * times
    for k in np.argsort(-(amounts - np.floor(amounts + 1e-6)), kind="stable").tolist():
        places, times = kinds[k]
        more = int((left[places] // times).min())
        used[k] += more
        left[places] -= more * times
    return [(*kinds[k], n) for k, n in used.items() if n]


def plan(counts: dict[int, int], size: int = SIZE, price: float = CUT_PRICE) -> Plan:
    """The plan for so many items of each length; items of the whole size have a sequence each."""
    number = np.zeros(size + 2, np.int64)
    for length, n in counts.items():
        number[length] = n
    lengths = np.flatnonzero(number[:size])
    demand = number[lengths]
    patterns = rounded(lengths, demand, program(lengths, demand, size, price)) if len(lengths) else []
    before = np.concatenate(([0], np.cumsum(number)[:-1]))
    given, sequence, runs = np.zeros(size + 1, np.int64), 0, []
    if number[size]:
        runs.append((before[size], 1, 0, 0))
        sequence = int(number[size])
    for places, times, n in patterns:
        offset = 0
        for length, t in sorted(zip(lengths[places].tolist(), times.tolist(), strict=True), reverse=True):
            runs.append((before[length] + given[length], t, sequence, offset))
            given[length] += n * t
            offset += t * length
        sequence += n
    flow = 0
    for length in lengths[::-1].tolist():
        if rest := int(number[length] - given[length]):
            runs.append((before[length] + given[length], 0, flow, 0))
            flow += rest * length
    whole, tail = divmod(flow, size)
    parts = [1 << k for k in range(size.bit_length(), -1, -1) if tail >> k & 1]
    edges = whole * size + np.concatenate(([0], np.cumsum(parts, dtype=np.int64)))
    runs = np.array(sorted(runs) or [(0, 1, 0, 0)], np.int64)
    return Plan(size, before, *runs.T.copy(), sequence, edges, whole)


def _ranked(items: DataFrame, counts: dict[int, int]) -> DataFrame:
    """items with rank: from 0 within their length."""
    spark, total = items.sparkSession, sum(counts.values())
    per = min(max(total // GROUPS, LEAST_GROUP), MOST_GROUP)
    groups = spark.createDataFrame([(k, -(-n // per)) for k, n in counts.items()], "length int, groups int")
    dealt = items.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("rid", "k"), F.col("groups")))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    row = F.row_number().over(Window.partitionBy("length", "part").orderBy("rid", "k")) - 1
    return dealt.withColumn("row", row).join(base, ["length", "part"]).select("rid", "key", "doc_tokens", "k", "length", "crc", (F.col("base") + F.col("row")).alias("rank"))


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, key: str = "doc_id", text: str = "text", size: int = SIZE, price: float = CUT_PRICE, broadcast_rows: int = 200_000, with_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, and ids as an array if wanted."""
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, path or tokenizer_path("byte_bpe_50k.json"), ranks or tokenizer_path("byte_bpe_50k.tiktoken"), key, text, size), "packing-tokens")
    kind = tokens.schema["key"].dataType.simpleString()
    items = tokens.select("rid", "key", "doc_tokens", F.posexplode("crcs").alias("k", "crc"))
    items = items.withColumn("length", F.least(F.lit(size), F.col("doc_tokens") - F.lit(size) * F.col("k")).cast("int"))
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    layout = spark.sparkContext.broadcast(plan(counts, size, price))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank, k = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank", "k"))
            owner, start, n, sequence, offset = layout.value.placed(length, rank)
            taken = b.take(pa.array(owner))
            crc = pa.array(taken.column("crc").to_numpy(zero_copy_only=False), mask=n != length[owner])
            own = [taken.column(c) for c in ("rid", "key", "doc_tokens")]
            rest = [pa.array(x.astype(np.int64)) for x in (k[owner] * size + start, n, sequence, offset)]
            yield pa.RecordBatch.from_arrays([*own, *rest, crc], names=["rid", "key", "doc_tokens", "start", "length", "sequence_id", "offset", "ids_crc32"])

    found = stored(_ranked(items, counts).mapInArrow(place, f"rid long, key {kind}, doc_tokens long, start long, length long, sequence_id long, offset long, ids_crc32 long"), "packing-pieces")
    cut = found.filter(F.col("ids_crc32").isNull())
    named = cut.select("rid").distinct()
    named = F.broadcast(named) if cut.count() <= broadcast_rows else named
    own = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    again = tokens.select("rid", "ids").join(named, "rid", "left_semi").join(cut.drop("ids_crc32"), "rid")
    out = found.filter(F.col("ids_crc32").isNotNull()).unionByName(again.withColumn("ids_crc32", F.crc32(own)).select(*found.columns))
    more = []
    if with_ids:
        spelled = F.hex(own)
        number = F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), lambda i: F.conv(F.concat(*[F.substring(spelled, i * 8 + p, F.lit(2)) for p in (7, 5, 3, 1)]), 16, 10).cast("long"))
        out, more = out.join(tokens.select("rid", "ids"), "rid").withColumn("ids", number), ["ids"]
    return out.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *more)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
