"""Dealer sheets: CSV or JSON lines with any of the usual headers, to one set of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Headers that people use for each column; fixed values.
HEADERS = {
    "make": ("make", "marca", "brand"),
    "model": ("model", "modelo"),
    "trim": ("trim", "version"),
    "year": ("year", "ano", "anio", "modelo ano"),
    "price": ("price", "precio", "valor", "importe"),
    "km": ("km", "kms", "kilometros", "kilometraje", "mileage"),
    "external_id": ("id", "external_id", "dominio", "patente", "codigo"),
}
TYPES = {"year": "int", "price": "double", "km": "double"}


def _name(header: str) -> str:
    for a, b in zip(T.ACCENTED, T.PLAIN, strict=True):
        header = header.replace(a, b)
    return " ".join(header.lower().replace("ñ", "n").replace("_", " ").split())


def mapped(rows: DataFrame) -> DataFrame:
    """rows with the columns of HEADERS (null where no header fits), and accepted: make, model and a plausible year."""
    have = {_name(c): c for c in rows.columns}
    out: list[Column] = []
    for column, names in HEADERS.items():
        found = next((have[_name(n)] for n in names if _name(n) in have), None)
        value = F.col(f"`{found}`") if found else F.lit(None)
        if column in ("price", "km"):
            value = T.number(value.cast("string"))
        elif column == "year":
            value = F.regexp_extract(value.cast("string"), r"\b(19[5-9]\d|20\d\d)\b", 1).try_cast("int")
        else:
            value = F.nullif(F.trim(value.cast("string")), F.lit(""))
        out.append(value.cast(TYPES.get(column, "string")).alias(column))
    good = F.col("make").isNotNull() & F.col("model").isNotNull() & F.col("year").between(1950, 2100)
    return rows.select(*out).withColumn("accepted", F.coalesce(good, F.lit(False)))


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """The separator is the commonest of , ; tab and | in the first line unless given."""
    if separator is None:
        first = spark.read.text(path).limit(1).collect()
        line = first[0][0] if first else ""
        separator = max(",;\t|", key=line.count)
    return mapped(spark.read.option("header", True).option("sep", separator).option("mode", "PERMISSIVE").csv(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return mapped(spark.read.json(path))
