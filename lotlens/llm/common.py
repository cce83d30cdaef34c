"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 500  # rows of an Arrow batch: long texts must fit in a worker's memory many at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python some hundreds at a time, whatever the session's default is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> None:
    """checkpoint() writes to the cluster's shared folder. Where none is set, a local run makes one and a cluster's fails."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read again: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str, file_rows: int = 0) -> DataFrame:
    """The rows written as Parquet to the shared checkpoint folder and read again; unlike cut() a reader takes the columns it needs.

    A row group is held whole by its writer, and by a reader up to 4,096 rows of it, so tables of very large rows have file_rows a file at most.
    """
    spark = df.sparkSession
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def file_system(spark: SparkSession, folder: str) -> tuple:
    """The store that the folder is in, and the folder's path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    store, path = file_system(spark, folder)
    store.delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64's)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "b" not in _POWERS or len(_POWERS["b"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("b", _BASE), ("i", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text in order: maximal runs of letters, digits and non-ASCII, lower-cased."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.concatenate(([False], _WORD[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
        return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """Hashes of the word shingles in order; a text of fewer words has one shingle, one without words none."""
    return shingles_of(word_hashes(text), width)


def shingles_of(words: np.ndarray, width: int = 5) -> np.ndarray:
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix64(out * _BASE + words[k : k + n] + np.uint64(k + 1))
    return out


def pieces(items: list, size: int) -> Iterator[list]:
    """Consecutive lists of texts of about so many characters in all, one text at least."""
    part, n = [], 0
    for x in items:
        part.append(x)
        n += len(x[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part
