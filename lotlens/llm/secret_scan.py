"""Secret scan over an incremental blob ledger.

A blob is a distinct text, named by its SHA-256. The ledger has, for each blob, the rule versions that have been
run over it and what they found, each finding with its rule's version. A scan takes all versions of all files (rows of
path and text, old versions included), names the blobs, runs only pairs of blob and rule version that the ledger lacks,
appends them to it, and joins the findings of the wanted rule versions back to every path. A new rule version thus rescans
all blobs with that one rule only, what the old version found is no longer reported, and a copied file costs a hash.

The ledger is a Parquet folder. The query keeps it in the folder that LEDGER_SETTING names, so that a second run scans
only what is new; if none is set it starts an empty one in the checkpoint folder.

Cases: a null text is the empty blob; rows repeated as a whole stay as many rows; null paths are kept; further
columns of the input, whatever their names, are not touched and do not reach the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, file_system, shared_dir, small_batches, table

#: Rules that findings of any text are judged by; (kind, version, pattern, flags, group whose length counts, least).
BASE = (
    ("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", re.A, 0, 20),
    ("hex", 1, r"[0-9a-f]+", re.A, 0, 24),
)
MORE = (
    ("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A, 0, 0),
    ("web_token", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A, 0, 0),
    ("host_token", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.A, 0, 0),
    ("chat_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A, 0, 0),
    ("cloud_key", 1, r"\bAIza[A-Za-z0-9_-]{35}", re.A, 0, 0),
    ("url_login", 1, r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{3,80}@", re.A, 0, 0),
)
RULES = BASE + MORE
KINDS = [r[0] for r in RULES]
FINDING = "array<struct<kind:string,version:int,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDING}"
BROADCAST_ROWS = 200_000
LEDGER_SETTING = "spark.lotlens.secretLedger"


def rule_name(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


#: What a text must hold, one of them, for a rule to be run over it: saves the slow patterns most texts.
_HINTS = {"private_key": ("PRIVATE KEY-----",), "web_token": ("eyJ",), "host_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "chat_token": ("xox",), "cloud_key": ("AIza",), "access": ("AKIA",), "url_login": ("://",)}
#: A run of 24 letters and digits of the kind has one at every 24th place; so this skips most places of prose.
_FAST = {"hex": r"[0-9a-f]{24,}"}


_RUN, _TOKEN_START = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\beyJ", re.A)


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the rule web_token, in time that grows with the text: only runs that a dot and eyJ follow are looked into."""
    runs = [m.span() for m in _RUN.finditer(text)]
    last = 0
    for (s, e), (s2, e2), (s3, e3) in zip(runs, runs[1:], runs[2:]):
        if s2 == e + 1 and s3 == e2 + 1 and text[e] == text[e2] == "." and e2 - s2 >= 11 and e3 - s3 >= 8 and text.startswith("eyJ", s2):
            if m := _TOKEN_START.search(text, max(s, last), max(e - 8, 0)):
                last = e3
                yield m.start(), e3


def _spans(kind: str, pattern: str, flags: int, text: str, group: int, least: int) -> Iterator[tuple[int, int]]:
    if kind == "web_token":
        yield from web_tokens(text)
    else:
        yield from (m.span() for m in re.finditer(_FAST.get(kind, pattern), text, flags) if len(m[group]) >= least)


def find(text: str, rules: list[tuple]) -> list[dict]:
    """All findings of the rules, by start and then in the rules' order; code points, end exclusive."""
    out = []
    for order, (kind, version, pattern, flags, group, least) in enumerate(rules):
        if kind in _HINTS and not any(h in text for h in _HINTS[kind]):
            continue
        out += [(s, order, kind, version, e) for s, e in _spans(kind, pattern, flags, text, group, least)]
    return [{"kind": k, "version": v, "start": s, "end": e} for s, _, k, v, e in sorted(out)]


def blob_name(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple = RULES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """New ledger rows (LEDGER) for the pairs of blob and rule version that the ledger lacks; append them to it.

    The names of the blobs meet the ledger first, so texts that it knows aren't shuffled. The blobs' texts are grouped by name with a map-side combine, so copies are dropped before the shuffle and a
    blob with a third of all rows is one row from each task.
    """
    small_batches(versions.sparkSession)
    blobs = versions.select(blob_name(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    everything = [rule_name(r) for r in rules]
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).select("blob", "text", F.array(*map(F.lit, everything)).alias("rules"))
    else:
        seen = ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        unseen = F.array_except(F.array(*map(F.lit, everything)), F.coalesce("seen", F.array().cast("array<string>")))
        new = cut(blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", unseen.alias("rules")).filter(F.size("rules") > 0))
        todo = blobs.join(F.broadcast(new) if new.count() <= limit else new, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules")).select("blob", "text", "rules")
    by_name = {rule_name(r): r for r in rules}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("rules").to_pylist()
            found = [find(t, [by_name[n] for n in todo]) for t, todo in zip(b.column("text").to_pylist(), names, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "rules", "findings"])

    return todo.mapInArrow(scan, LEDGER)


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str = "path", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """(path, blob, findings): each row of versions with what the ledger has for its blob under the given rule versions.

    The side of the ledger has one row for each blob with findings; many paths of one blob are a skewed join that
    Spark splits at run time.
    """
    order = F.array(*[F.lit(rule_name(r)) for r in rules])
    held = ledger.filter(F.size("findings") > 0).select("blob", F.explode("findings").alias("f"))
    held = held.withColumn("k", F.array_position(order, F.concat_ws("@", "f.kind", F.col("f.version").cast("string")))).filter(F.col("k") > 0)
    one = held.groupBy("blob").agg(F.collect_set(F.struct(F.col("f.start").alias("start"), "k", F.col("f.kind").alias("kind"), F.col("f.version").alias("version"), F.col("f.end").alias("end"))).alias("f"))
    one = one.select("blob", F.transform(F.array_sort("f"), lambda x: F.struct(x["kind"].alias("kind"), x["version"].alias("version"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    names = versions.select(F.col(path).alias(path), blob_name(text).alias("blob"))
    return names.join(one, "blob", "left").select(path, "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; none if the folder has no ledger yet."""
    store, path = file_system(spark, folder)
    return spark.read.schema(LEDGER).parquet(folder) if store.exists(path) else spark.createDataFrame([], LEDGER)


def incremental(versions: DataFrame, folder: str, path: str = "path", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """findings_by_path once the ledger in the folder has every blob of versions under every rule.

    Only unseen pairs are scanned. They are appended in one commit; rows of a run that was cut off count as unseen, and a
    pair that two runs have appended changes nothing, as findings are sets.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, folder)
    scan_unseen(versions, known if known.limit(1).count() else None, text, rules).write.mode("append").parquet(folder)
    return findings_by_path(versions, read_ledger(spark, folder), path, text, rules)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each span, overlapping ones as one, replaced by the mask; spans come by start."""
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: DataFrame, text: str = "text", mask: str = "[secret]", limit: int = BROADCAST_ROWS, rules: tuple = RULES) -> DataFrame:
    """docs with each finding of the rules in the text, overlapping ones as one, replaced by the mask. Rows and columns stay.

    Blobs with findings are few; they are broadcast if counted within the limit, findings included, else joined by shuffle.
    Only their texts go to Python, where a text is cut once.
    """
    small_batches(docs.sparkSession)
    wanted = F.array(*[F.lit(rule_name(r)) for r in rules])
    held = ledger.filter(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).filter(F.array_contains(wanted, F.concat_ws("@", "f.kind", F.col("f.version").cast("string"))))
    found = cut(held.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("f.start", "f.end"))).alias("s")).select(F.col("blob").alias("__blob"), F.col("s.start").alias("__starts"), F.col("s.end").alias("__ends")))
    size = found.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.size("__starts")), F.lit(0)).alias("spans")).first()
    near = F.broadcast(found) if size["blobs"] + size["spans"] <= limit else found

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, list(zip(s, e, strict=True)), mask) for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    has = F.col("__starts").isNotNull()
    named = docs.withColumn("__blob", blob_name(text)).join(near, "__blob", "left")
    return named.withColumn(text, F.when(has, cut_out(F.when(has, F.col(text)), "__starts", "__ends")).otherwise(F.col(text))).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared_dir(spark)
    folder = spark.conf.get(LEDGER_SETTING, None) or f"{spark.sparkContext.getCheckpointDir()}/secret-ledger-{uuid.uuid4().hex}"
    found = incremental(docs, folder, path="doc_id")
    base = F.filter("findings", lambda x: x["kind"].isin(*[r[0] for r in BASE]))

    def spell(c: Column) -> Column:
        return F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("findings")).alias("spans"))
