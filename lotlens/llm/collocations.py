"""Phrase collocations by vertical positional inverted lists.

Texts are taken in blocks of one language. A block's postings are the words of its places in order; a phrase's list has
the places in the block where it starts. The lists of phrases of k words are extended by merging them with the lists that
start one place further (the phrase's tail has to be frequent too) and with the postings k places further: what stays is
grouped by (phrase, next word) into the lists of k + 1 words. A list's length is its phrase's exact count in the block.

Counts of all blocks are summed by (phrase, word), both named by the numbers that the level before gave to what is frequent
in all texts of the language, so names are exact. Only lists of frequent phrases go on to the next level; these are broadcast
if counted within a bound, and beyond it a join tells each block which of its own they are. The blocks' state is a table in the shared folder, one for each level.

What is frequent is a table for each level, too: a phrase's number, the number of its beginning (without the last word),
its last word, its count. Joins along beginnings and tails give the counts of all its beginnings and ends, from which
cuts are scored in decimals of 38 digits, and the largest count of a phrase one word longer, which decides what is dropped:
a longer candidate that holds the phrase holds such a one, and counts only fall from one to the next.

Cases: a null text is empty, a null language `und` and counted with texts whose language is the word itself; repeated rows
and ids count as often as they stand; very long texts are a block of their own; ties are ranked by count and then by the
phrase's bytes; an empty table gives no phrases; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, small_batches, stored, table

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words
TOP = 2000  # phrases returned for each language
BLOCK_CHARS = 2_000_000  # of the texts of a block, or one text
BLOCK_ROWS = "1"  # blocks of an Arrow batch
FILE_BLOCKS = 8  # of a file of the state: some MB each, so a task holds few of them, however many it reads and writes

BROADCAST_ROWS = 1_000_000  # frequent phrases of a level, at 24 bytes each, sent to all tasks; beyond it they are joined

#: A-Z to a-z, what splits pieces to a line feed, tabs to spaces
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
STATE = "block long, post binary, words array<long>, ids array<long>, sizes array<long>, places binary"
COUNTS = "block long, head array<long>, next array<long>, sizes array<long>"


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words and their places in the texts; -1 between pieces and between texts."""
    codes = _Codes({b"": 0, b"\n": 1})
    parts = b"\n".join(texts).translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
    post = np.fromiter(map(codes.__getitem__, parts), np.int32, len(parts))
    return list(codes)[2:], post[post > 0] - 2


def blocks(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(block, lang, post, words, n): the texts of a language in a task, some at a time, as codes of their own words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def out(key: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            words, post = coded(held.pop(key))
            size.pop(key)
            counts = np.bincount(post[post >= 0], minlength=len(words)).astype(np.int64)
            columns = [pa.array([number]), pa.array([key]), pa.array([post.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "post", "words", "n"])

        for b in batches:
            for key, raw in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(key, []).append(raw)
                size[key] = size.get(key, 0) + len(raw)
                if size[key] >= BLOCK_CHARS:
                    yield out(key)
        for key in list(held):
            yield out(key)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, lang string, post binary, words array<binary>, n array<long>")


def lists_of(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the lengths of their lists, and the places list by list; places come in order within a key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[edges], np.diff(np.append(edges, len(keys))), places[order]


def extended(post: np.ndarray, sizes: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of k + 1 words made of lists of k words: (list extended, code of the word added, lengths, places)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.zeros(len(post) + 1, bool)
    starts[places] = True
    beyond = places + k
    go = np.flatnonzero(beyond < len(post))
    go = go[(post[beyond[go]] >= 0) & starts[places[go] + 1]]
    n_codes = int(post.max(initial=0)) + 1
    keys, lengths, found = lists_of(owner[go].astype(np.int64) * n_codes + post[beyond[go]], places[go])
    return keys // n_codes, keys % n_codes, lengths, found


def _names(b: pa.RecordBatch, row: int, name: str, kind: type = np.int64) -> np.ndarray:
    return b.column(name)[row].values.to_numpy(zero_copy_only=False).astype(kind)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of rows of STATE or COUNTS."""
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


class Words:
    """Frequent words of each language and their numbers, small enough to be sent to every task."""

    def __init__(self, frequent: DataFrame):
        rows = frequent.select("lang", "phrase", "id").toArrow()
        self.by_lang = {}
        for key in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], key))
            self.by_lang[key] = own["phrase"].combine_chunks(), own["id"].to_numpy()

    def __call__(self, b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        words, ids = self.by_lang.get(b.column("lang")[row].as_py(), (pa.array([], pa.binary()), np.empty(0, np.int64)))
        found = pc.fill_null(pc.index_in(b.column("words")[row].values, value_set=words), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found >= 0)
        return at, ids[found[at]]


class Pairs:
    """Frequent phrases, by the numbers of their beginning and of their last word."""

    def __init__(self, frequent: DataFrame):
        rows = frequent.select("head", "next", "id").toArrow()
        head, word, ids = (rows[c].to_numpy().astype(np.int64) for c in ("head", "next", "id"))
        self.heads, self.words = np.unique(head), np.unique(word)
        keys = self._keys(head, word)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def _keys(self, head: np.ndarray, word: np.ndarray) -> np.ndarray:
        """-1 where the beginning or the word is in no frequent phrase."""
        out = np.zeros(len(head), np.int64)
        for known, x in ((self.heads, head), (self.words, word)):
            k = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
            out = np.where((out >= 0) & (len(known) > 0) & (known[k] == x if len(known) else False), out * len(known) + k, -1)
        return out

    def __call__(self, b: pa.RecordBatch, row: int, head: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self._keys(head, word)
        k = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        at = np.flatnonzero((keys >= 0) & (self.keys[k] == keys)) if len(self.keys) else np.empty(0, np.int64)
        return at, self.ids[k[at]]


class Told:
    """What a join has told the block: (at, id)."""

    def __call__(self, b: pa.RecordBatch, row: int, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _names(b, row, "at"), _names(b, row, "id")


def postings(held: DataFrame, known) -> DataFrame:
    """STATE without lists: the postings of frequent words, from blocks; known() gives the codes of a block's frequent words and
    their numbers. The lists of single words are the postings themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                post = np.frombuffer(b.column("post")[row].as_buffer(), np.int32)
                at, ids = known.value(b, row)
                recode = np.full(int(post.max(initial=0)) + 2, -1, np.int32)  # -1 stays the last
                recode[at] = np.arange(len(at))
                yield _batch(STATE, [(b.column("block")[row].as_py(), recode[post].tobytes(), ids, [], [], b"")])

    return held.mapInArrow(run, STATE)


def _candidates(b: pa.RecordBatch, row: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of k + 1 words that a block's lists of k words make: (numbers of their beginnings and last words, lengths, places)."""
    post, words = np.frombuffer(b.column("post")[row].as_buffer(), np.int32), _names(b, row, "words")
    if k == 1:
        places = np.flatnonzero(post >= 0)
        codes, sizes, places = lists_of(post[places], places)
        ids = words[codes]
    else:
        ids, sizes = _names(b, row, "ids"), _names(b, row, "sizes")
        places = np.frombuffer(b.column("places")[row].as_buffer(), np.int32).astype(np.int64)
    head, word, lengths, found = extended(post, sizes, places, k)
    return ids[head], words[word], lengths, found


def counted(state: DataFrame, k: int) -> DataFrame:
    """COUNTS of the lists of k + 1 words, from STATE with those of k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                yield _batch(COUNTS, [(b.column("block")[row].as_py(), *_candidates(b, row, k)[:3])])

    return state.mapInArrow(run, COUNTS)


def next_lists(held: DataFrame, k: int, known) -> DataFrame:
    """STATE with the frequent lists of k + 1 words, from that of k; known() gives which they are and their numbers. The lists
    are made once more, as those that are not frequent would take far more room than time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                head, word, lengths, found = _candidates(b, row, k)
                at, ids = known.value(b, row, head, word)
                order = np.argsort(at)
                at, ids = at[order], ids[order]
                kept = np.zeros(len(lengths), bool)
                kept[at] = True
                yield _batch(STATE, [(b.column("block")[row].as_py(), b.column("post")[row].as_py(), _names(b, row, "words"), ids, lengths[kept], found[np.repeat(kept, lengths)].astype(np.int32).tobytes())])

    return held.mapInArrow(run, STATE)


def _few_blocks(spark: SparkSession, df: DataFrame, what: str, file_rows: int = 0) -> DataFrame:
    """df stored while Arrow batches have few rows, as each is a block."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BLOCK_ROWS)
    try:
        return stored(df, what, file_rows)
    finally:
        spark.conf.set(setting, before)


def _replaced(spark: SparkSession, state: DataFrame, step, own: DataFrame, frequent: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The next state, stored; the one before goes."""
    held, known = _with_known(state, own, frequent, keys, limit)
    before = state.inputFiles()
    out = _few_blocks(spark, step(held, known), "collocations-lists", FILE_BLOCKS)
    if before:
        remove(spark, before[0].rsplit("/", 1)[0])
    return out


def _with_known(state: DataFrame, own: DataFrame, frequent: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, object]:
    """The state and what tells its blocks which of their own lists (block, at, keys) are frequent.

    Within the limit the frequent ones are broadcast, and neither lists nor blocks are shuffled; beyond it they meet in a join.
    """
    sc = state.sparkSession.sparkContext
    if frequent.count() <= limit:
        return state, sc.broadcast(Words(frequent) if "phrase" in keys else Pairs(frequent))
    told = own.join(frequent.select(*keys, "id"), keys).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("f")).select("block", "f.at", "f.id")
    return state.join(told, "block"), sc.broadcast(Told())


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, limit: int = BROADCAST_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """Levels of frequent phrases, level k at place k - 1, and (lang, n) of all languages.

    Level 1 is (lang, phrase, a, id), the words; the others are (head, next, a, id).
    """
    spark = docs.sparkSession
    state = stored(blocks(docs, lang, text), "collocations-blocks", FILE_BLOCKS)
    own = state.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("at", "w")).select("block", "lang", "at", F.col("w.words").alias("phrase"), F.col("w.n").alias("n"))
    counts = stored(own.groupBy("lang", "phrase").agg(F.sum("n").alias("a")), "collocations-words")
    levels = [stored(counts.filter(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id()), "collocations-1")]
    state = _replaced(spark, state, postings, own, levels[0], ["lang", "phrase"], limit)
    for k in range(2, longest + 1):
        own = counted(state, k - 1).select("block", F.posexplode(F.arrays_zip("head", "next", "sizes")).alias("at", "p")).select("block", "at", "p.head", "p.next", F.col("p.sizes").alias("n"))
        summed = own.groupBy("head", "next").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        levels.append(_few_blocks(spark, summed.withColumn("id", F.monotonically_increasing_id()), f"collocations-{k}"))
        if k < longest:
            state = _replaced(spark, state, lambda held, known, k=k: next_lists(held, k - 1, known), own, levels[-1], ["head", "next"], limit)
    return levels, counts.groupBy("lang").agg(F.sum("a").alias("n"))


def described(levels: list[DataFrame]) -> list[DataFrame]:
    """Each level from 2 with lang, phrase, begins and ends (the counts of its beginnings and ends, shortest first) and longer
    (the largest count of a phrase one word longer that holds it)."""
    word = levels[0].select("lang", "id", "phrase", "a")
    known = [word.select("lang", "id", "phrase", F.array("a").alias("begins"), F.array("a").alias("ends"), F.lit(None).cast("long").alias("tail"))]
    for k, level in enumerate(levels[1:], 2):
        head = known[-1].select("lang", F.col("id").alias("head"), F.col("phrase").alias("p"), "begins", F.col("tail").alias("head_tail"))
        full = level.join(head, "head").join(word.select(F.col("id").alias("next"), F.col("phrase").alias("w")), "next")
        ends = known[-1].select(F.col("id").alias("tail"), "ends")
        if k == 2:
            full = full.join(ends, F.col("next") == F.col("tail"))
        else:  # the tail of a phrase is the tail of its beginning with the same last word
            full = full.join(levels[k - 2].select(F.col("head").alias("head_tail"), "next", F.col("id").alias("tail")).join(ends, "tail"), ["head_tail", "next"])
        text = F.concat(F.col("p"), F.lit(b" "), F.col("w"))
        known.append(stored(full.select("lang", "id", "head", "tail", "a", text.alias("phrase"), F.concat("begins", F.array("a")).alias("begins"), F.concat("ends", F.array("a")).alias("ends")), f"collocations-full-{k}"))
    out = []
    for k, level in enumerate(known[1:], 2):
        if k < len(levels):
            up = known[k]
            above = up.select(F.col("head").alias("id"), "a").unionByName(up.select(F.col("tail").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("longer"))
            level = level.join(above, "id", "left")
        else:
            level = level.withColumn("longer", F.lit(None).cast("long"))
        out.append(level.select("lang", F.lit(k).alias("k"), "phrase", "a", "begins", "ends", "longer"))
    return out


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases by score, the first of them or all (top None)."""
    levels, totals = frequent_phrases(docs, lang, text, least, longest, limit)
    found = described(levels)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("at"), F.element_at("begins", i).alias("l"), F.element_at("ends", F.col("k") - i).alias("r")))
    rows = rows.select("lang", "phrase", "a", "n", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "n", "c.at", "c.l", "c.r")
    score = F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least_cut = rows.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "l", "r", "a", "n")).alias("m"))
    best = least_cut.select("lang", F.col("phrase").cast("string").alias("phrase"), "m.a", "m.l", "m.r", "m.n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked.filter(F.col("rank") <= top) if top is not None else ranked).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with docs as (
    select row_number() over () as doc, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), pieces as (
    select doc, lang, unnest(p) as piece, generate_subscripts(p, 1) as nth
    from (select doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') as p from docs)
), words as (
    select doc, lang, nth, unnest(w) as word, generate_subscripts(w, 1) as place
    from (select doc, lang, nth, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x : x <> '') as w from pieces)
), runs as (
    select lang, word as w1, lead(word, 1) over p as w2, lead(word, 2) over p as w3, lead(word, 3) over p as w4, lead(word, 4) over p as w5
    from words window p as (partition by doc, nth order by place)
), grams as (
    select lang, 1 as k, w1 as phrase, count(*) as a from runs group by all
    union all select lang, 2, w1 || ' ' || w2, count(*) from runs where w2 is not null group by all
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from runs where w3 is not null group by all
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from runs where w4 is not null group by all
    union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) from runs where w5 is not null group by all
), often as (
    select * from grams where a >= 100
), inner_phrases as (
    select o.lang, array_to_string(string_split(phrase, ' ')[s.i:s.i + l.m - 1], ' ') as phrase, max(o.a) as longer
    from often o, (select unnest(range(2, 5)) as m) l, (select unnest(range(1, 5)) as i) s
    where l.m < o.k and s.i + l.m - 1 <= o.k group by all
), kept as (
    select o.* from often o left join inner_phrases i using (lang, phrase)
    where o.k > 1 and (i.longer is null or 100 * i.longer < 100 * o.a)
), totals as (
    select lang, count(*) as n from words group by lang
), cuts as (
    select k.lang, k.phrase, k.a, c.i, array_to_string(string_split(k.phrase, ' ')[1:c.i], ' ') as one, array_to_string(string_split(k.phrase, ' ')[c.i + 1:], ' ') as two
    from kept k, (select unnest(range(1, 5)) as i) c where c.i < k.k
), scored as (
    select c.lang, c.phrase, c.a, f.a as l, g.a as r, t.n, c.i,
        ((1000::hugeint * c.a::hugeint * t.n::hugeint) // (f.a::hugeint * g.a::hugeint))::bigint as score
    from cuts c join often f on f.lang = c.lang and f.phrase = c.one join often g on g.lang = c.lang and g.phrase = c.two join totals t on t.lang = c.lang
), best as (
    select *, row_number() over (partition by lang, phrase order by score, i) as b from scored
), ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best where b = 1
)
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked where rank <= 2000
"""
