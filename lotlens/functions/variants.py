"""Documents of changing shape as variants: set, merge, drop and strip as column expressions.

An object is taken apart into a map of variants, changed with map functions, and put together again; its keys come out in
order. What is no object is returned as it is (or replaced, where it is the side that gives way). SQL null is no document:
merging with it gives null, as in databases; a JSON null is a value like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null for no document."""
    s = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(v.isNotNull(), "number")
    )


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "object", F.lit(False))


def entries(v: Column) -> Column:
    """The top keys of an object with their values; empty for anything else."""
    return F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>")).otherwise(F.create_map().cast("map<string,variant>"))


def from_entries(m: Column) -> Column:
    return F.to_variant_object(m)


def has_key(v: Column, key: str) -> Column:
    return F.map_contains_key(entries(v), F.lit(key))


def merged(a: Column, b: Column) -> Column:
    """The top keys of both, those of b first; what isn't two objects is b."""
    both = F.map_zip_with(entries(a), entries(b), lambda k, x, y: F.coalesce(y, x))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(is_object(a) & is_object(b), from_entries(both)).otherwise(b))


def without(v: Column, *keys: str) -> Column:
    return F.when(is_object(v), from_entries(F.map_filter(entries(v), lambda k, x: ~k.isin(*keys)))).otherwise(v)


def set_path(v: Column, path: list[str], value: Column, create: bool = True) -> Column:
    """The document with value at the end of a path of keys. Keys on the way must be there and hold objects, else nothing is
    changed; the last one is made unless create is off."""
    key, rest = path[0], path[1:]
    held = entries(v)
    there = F.map_contains_key(held, F.lit(key))
    new = set_path(F.element_at(held, key), rest, value, create) if rest else value
    put = from_entries(F.map_zip_with(held, F.create_map(F.lit(key), new), lambda k, x, y: F.coalesce(y, x)))
    possible = is_object(v) & (there if rest or not create else F.lit(True))
    return F.when(possible, put).otherwise(v)


def stripped(v: Column, depth: int = 3) -> Column:
    """Without the keys whose value is null, down to so many objects inside one another; arrays are left as they are."""
    inner = (lambda x: stripped(x, depth - 1)) if depth > 1 else (lambda x: x)
    kept = F.map_filter(entries(v), lambda k, x: ~F.is_variant_null(x))
    return F.when(is_object(v), from_entries(F.transform_values(kept, lambda k, x: inner(x)))).otherwise(v)


def object_agg(key: Column, value: Column, order: Column) -> Column:
    """An aggregate: an object of the group's keys, of equal ones the last by order (unique within a key); null keys are left
    out. The group is one document."""
    gathered = F.collect_list(F.when(key.isNotNull(), F.struct(order.alias("o"), key.alias("k"), value.alias("v"))))
    rows = F.array_sort(gathered, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    last = F.aggregate(rows, F.create_map().cast("map<string,variant>"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, x: k != r["k"]), F.create_map(r["k"], r["v"])))
    return from_entries(last)


def built(**fields: Column) -> Column:
    """An object of the given columns, whatever their types."""
    return from_entries(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), _variant(c))]))


def _variant(c: Column) -> Column:
    return F.coalesce(c.cast("variant"), F.parse_json(F.lit("null")))


def all_merged(*documents: Column) -> Column:
    return reduce(merged, documents)
