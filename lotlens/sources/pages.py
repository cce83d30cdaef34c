"""The source contract as a Spark data source: saved pages of listing sites, parsed where they are read.

    spark.dataSource.register(ListingPages)
    spark.read.format("listing_pages").option("path", folder).load()
    spark.readStream.format("listing_pages").option("path", folder).load()

What a collector promises holds for a reader: each row says its source (the host of its address), what the page states
(title, language, links, and name, price and currency of a vehicle or product block), whether the page proves its ad gone,
and whether the page was read completely. A source is read completely only if all its pages were, which `coverage` sums up;
only then may an offer that is missing be taken for gone.

Parts are the row groups of the Parquet files in the folder, so reads are as parallel as the files. The offset of a stream
is the row groups read of each file; a restart goes on from it, files that come later are new, and a batch is at most
`groups` row groups. The option `source` keeps one host's pages. The folder is read by pyarrow in the tasks.

Cases: null addresses have the source ''; pages without text, or cut off before their end, are not complete; blocks that
don't parse are passed over; an empty folder gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, page_id long, url string, title string, lang string, n_links int, name string, price double, currency string, gone boolean, complete boolean"
_ARROW = pa.schema([("source", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("lang", pa.string()), ("n_links", pa.int32()), ("name", pa.string()), ("price", pa.float64()), ("currency", pa.string()), ("gone", pa.bool_()), ("complete", pa.bool_())])
ROWS = 500  # pages parsed into one batch

_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_TITLE = re.compile(r"<title>([^<]*)</title>")
_LANG = re.compile(r'<html lang="([a-z]+)"')
_LINK = re.compile(r'<a href="')
_BLOCK = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
KINDS = ("Vehicle", "Car", "Product")
#: How pages say that an ad is over: the address of a schema.org availability, lower-case.
GONE = ("discontinued", "soldout", "outofstock")


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _number(x) -> float | None:
    try:
        return float(x) if not isinstance(x, bool) else None
    except (TypeError, ValueError):
        return None


def _offer(html: str) -> tuple[str | None, float | None, str | None, bool]:
    """(name, price, currency, gone) of the first block of the kinds, the first kind first."""
    found = {}
    for m in _BLOCK.finditer(html):
        try:
            block = json.loads(m[1])
        except ValueError:
            continue
        if isinstance(block, dict) and isinstance(block.get("@type"), str):
            found.setdefault(block["@type"], block)
    block = next((found[k] for k in KINDS if k in found), None)
    if block is None:
        return None, None, None, False
    offers = block.get("offers") if isinstance(block.get("offers"), dict) else {}
    name, currency = (x if isinstance(x, str) else None for x in (block.get("name"), offers.get("priceCurrency")))
    return name, _number(offers.get("price")), currency, str(offers.get("availability", "")).rsplit("/", 1)[-1].lower() in GONE


def parsed(page_id: int | None, url: str | None, html: str | None) -> tuple:
    """A row of SCHEMA."""
    text = html or ""
    title, lang = _TITLE.search(text), _LANG.search(text)
    return (host(url), page_id, url, title[1] if title else None, lang[1] if lang else None, len(_LINK.findall(text)), *_offer(text), text.rstrip().endswith("</html>"))


@dataclass
class Group(InputPartition):
    file: str
    number: int


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def groups(path: str) -> dict[str, int]:
    """How many row groups each file of the folder, or the one file, has."""
    store, base = _store(path)
    info = store.get_file_info(base)
    files = [base] if info.type == pafs.FileType.File else [f.path for f in store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", "."))]
    return {f: pq.read_metadata(store.open_input_file(f)).num_row_groups for f in sorted(files)}


def _read(path: str, only: str | None, part: Group) -> Iterator[pa.RecordBatch]:
    store, _ = _store(path)
    for batch in pq.ParquetFile(store.open_input_file(part.file)).iter_batches(ROWS, row_groups=[part.number], columns=["page_id", "url", "html"]):
        columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        rows = [parsed(*r) for r in zip(*columns, strict=True) if only is None or host(r[1]) == only]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def partitions(self) -> list[Group]:
        return [Group(f, k) for f, n in groups(self.path).items() for k in range(n)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.file:
            yield from _read(self.path, self.only, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, only: str | None, most: int):
        self.path, self.only, self.most = path, only, most
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """At most so many row groups beyond what was handed out last."""
        room, out = self.most, dict(self.reached)
        for f, n in groups(self.path).items():
            take = min(room, n - out.get(f, 0))
            if take > 0:
                out[f] = out.get(f, 0) + take
                room -= take
        self.reached = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.reached = {f: max(n, self.reached.get(f, 0)) for f, n in end.items()}
        return [Group(f, k) for f, n in sorted(end.items()) for k in range(start.get(f, 0), n)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, self.only, partition)


class ListingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, str | None]:
        if not self.options.get("path"):
            raise ValueError("listing_pages needs the option path")
        return self.options["path"], self.options.get("source")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._options(), int(self.options.get("groups", 1_000_000)))


def coverage(pages: DataFrame) -> DataFrame:
    """(source, pages, titled, links, gone, complete): what a read got of each source, and whether that is all of it."""
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count("title").alias("titled"), F.sum("n_links").alias("links"), F.count_if("gone").alias("gone"), F.min("complete").alias("complete"))
