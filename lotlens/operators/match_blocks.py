"""Match rules of many searches on many offers at once, for searches that name no model.

A search by make or by body type alone meets every offer of its kind, so pairs grow with the product of both. Here searches
and offers of one kind meet in blocks: Spark deals (kind, block of offers, block of searches) to tasks, and in a task each
rule is worked out once for each distinct thing asked, as one bit an offer. Rules are then joined by words of 64 offers, so
counts, blockers and pages of results make no pairs. Only `pairs` makes them, for queries that return them.

The states are those of `rules`, in numpy; a test holds both to each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import RADIUS_KM
from . import rules

NOT_ASKED, OK, UNKNOWN, FAIL = range(4)
HARD = ["model", "year", "price", "km", "transmission", "fuel", "body_type", "color", "location", "source", "seller", "trim"]
SOFT = ["km_target", "price_target", "seller_type", "max_distance"]
#: What a rule reads of a search, as `asks` names it.
READS = {
    "model": ["model_state"], "year": ["year_low", "year_high", "years"], "price": ["price_min", "price_max", "unit"], "km": ["km_min", "km_max"],
    "transmission": ["transmission"], "fuel": ["fuel"], "body_type": ["body_types", "less"], "color": ["colors"], "location": ["zones"], "source": ["sources"],
    "seller": ["seller_types", "seller_filter"], "trim": ["trims"],
    "km_target": ["km_target"], "price_target": ["price_target", "target_unit"], "seller_type": ["seller_types", "seller_filter"], "max_distance": ["zones", "max_distance"],
}
#: Offers and searches of a block where only sums leave it, and where pairs do.
SUM_BLOCK, PAIR_BLOCK = (32_768, 4_096), (8_192, 512)
CHUNK = 128
PAIR = pa.schema([(k, pa.string() if k == "missing" else pa.int64()) for k in ("search", "id", "fails", "oks", "unknowns", "soft_ok", "soft_fail", "missing")])


def wanted() -> Column:
    """The kinds of offers that a search meets: its make and model, its make, or each of its body types."""
    c = F.col
    named = F.array_compact(F.array(F.concat(F.lit("model="), "make", F.lit("|"), "model")))
    bodies = F.transform(F.array_distinct(rules.listed(c("body_types"))), lambda b: F.concat(F.lit("body="), b))
    return F.when(c("model").isNotNull(), named).when(c("make").isNotNull(), F.array(F.concat(F.lit("make="), "make"))).otherwise(bodies)


def offered() -> Column:
    return F.array_compact(F.array(F.concat(F.lit("model="), "make", F.lit("|"), "model"), F.concat(F.lit("make="), "make"), F.concat(F.lit("body="), "body_type")))


def asks(searches: DataFrame) -> DataFrame:
    """(kind, search, what its rules read): a row for each make or body type that a search without a model asks for."""
    c = F.col
    s = lambda k: F.col(k)
    years = F.transform(rules.listed(c("years")), lambda y: y.cast("int"))
    return searches.filter("model IS NULL").select(
        F.explode(wanted()).alias("kind"), "search", F.when(rules.model_less(s), F.when(c("body_types").isNull(), FAIL).otherwise(NOT_ASKED)).otherwise(OK).alias("model_state"),
        F.coalesce("year_min", F.array_min(years)).cast("double").alias("year_low"), F.coalesce("year_max", F.array_max(years)).cast("double").alias("year_high"), "years",
        c("price_min").cast("double").alias("price_min"), c("price_max").cast("double").alias("price_max"), rules.currency_of(F.coalesce("price_max", "price_min"), c("currency")).alias("unit"),
        c("km_min").cast("double").alias("km_min"), c("km_max").cast("double").alias("km_max"), T.plain(c("transmission")).alias("transmission"), T.plain(c("fuel")).alias("fuel"),
        "body_types", rules.model_less(s).alias("less"), "colors", F.to_json(rules.zones(s)).alias("zones"), "sources", "seller_types", "seller_filter",
        F.array_join(F.transform(rules.listed(c("trims"), r"\|"), lambda w: F.replace(T.plain(w), F.lit("!"), F.lit(""))), "|").alias("trims"), c("km_target").cast("double").alias("km_target"), c("price_target").cast("double").alias("price_target"),
        rules.currency_of(c("price_target"), c("currency")).alias("target_unit"), c("max_distance").cast("double").alias("max_distance"),
    )


def says(offers: DataFrame, fx: float, *more: Column) -> DataFrame:
    """(kind, id, what rules read of it, more): a row for the make and one for the body type of each offer."""
    c = F.col
    o = lambda k: F.col(k)
    strong = F.filter(rules.listed(c("maybe_colors")), lambda m: F.split_part(m, F.lit(":"), F.lit(2)).cast("int") >= rules.CANDIDATE_MIN)
    price = F.when(c("price") > 0, c("price")).cast("double")
    return offers.select(
        F.explode(offered()).alias("kind"), "id", c("year").cast("double").alias("year"), F.upper("currency").alias("own"), price.alias("price"), F.coalesce(c("price_usd").cast("double"), price / fx).alias("frozen"), (price * fx).alias("turned"),
        F.coalesce("price_partial", F.lit(False)).alias("partial"), c("price_partial").isNull().alias("partial_null"), c("km").cast("double").alias("km"), T.plain(c("transmission")).alias("transmission"), T.plain(c("fuel")).alias("fuel"), "body_type", "color",
        F.array_join(F.transform(strong, lambda m: F.split_part(m, F.lit(":"), F.lit(1))), ",").alias("strong"), c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"), "source",
        rules.effective_seller(o).alias("who"), c("dealer").isNotNull().alias("dealer"), F.replace(T.plain(c("trim")), F.lit("!"), F.lit("")).alias("trim"), *more,
    )


def dealt(s: DataFrame, o: DataFrame, block: tuple[int, int]) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with (kind, a, b), a block of a kind's offers by a block of its searches, and the number of tasks for them."""
    sizes = s.groupBy("kind").agg(F.count(F.lit(1)).alias("n_s")).join(o.groupBy("kind").agg(F.count(F.lit(1)).alias("n_o")), "kind")
    sizes = sizes.select("kind", F.ceil(F.col("n_o") / block[0]).cast("int").alias("n_a"), F.ceil(F.col("n_s") / block[1]).cast("int").alias("n_b"), (F.col("n_s") * F.col("n_o")).alias("pairs"))
    few = sizes.agg(F.sum(F.col("n_a") * F.col("n_b")).alias("cells"), F.sum("pairs").alias("pairs")).first()  # one row
    tasks = int(min(max(2 * (few["pairs"] or 0) // (block[0] * block[1]), min(few["cells"] or 1, 64)), 20_000))
    part = lambda k, m: F.pmod(F.xxhash64(k), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    sizes = sizes.hint("shuffle_hash")  # else a side of few bytes and very many rows is broadcast, through the driver
    left = s.join(sizes, "kind").withColumn("b", part("search", "n_b")).withColumn("a", every("n_a")).drop("n_a", "n_b", "pairs")
    right = o.join(sizes, "kind").withColumn("a", part("id", "n_a")).withColumn("b", every("n_b")).drop("n_a", "n_b", "pairs")
    return left, right, tasks


CELL = ["kind", "a", "b"]


def met(left: DataFrame, right: DataFrame, tasks: int, keys: list[str] = CELL) -> DataFrame:
    """The rows of both sides that `dealt` has brought to one cell, block by block; neither side goes through the driver."""
    return left.repartition(tasks, *keys).hint("merge").join(right.repartition(tasks, *keys), keys)


def cells(s: DataFrame, o: DataFrame, block: tuple[int, int]):
    left, right, tasks = dealt(s, o, block)
    return left.repartition(tasks, *CELL).groupBy(*CELL).cogroup(right.repartition(tasks, *CELL).groupBy(*CELL))


def _tri(value: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(value), UNKNOWN, np.where(good, OK, FAIL)).astype(np.uint8)


class Offers:
    """A block of offers, and the states of one thing asked for all of them."""

    def __init__(self, frame: pd.DataFrame):
        self.n, self.frame = len(frame), frame
        self.num = {k: frame[k].to_numpy(float) for k in ("year", "price", "frozen", "turned", "km", "lat", "lon")}
        self.flag = {k: frame[k].to_numpy(bool) for k in ("partial", "partial_null", "dealer")}
        self.coded = {}
        for k in ("own", "transmission", "fuel", "body_type", "color", "strong", "source", "who", "trim"):
            codes, values = pd.factorize(frame[k])
            self.coded[k] = (codes, [None if v is None or v != v else v for v in [*values, None]])  # code -1: the last, null
        self.spots, self.spot = np.unique(np.column_stack([self.num["lat"], self.num["lon"]]), axis=0, return_inverse=True)
        self.spot = self.spot.ravel()

    def each(self, column: str, f: Callable) -> np.ndarray:
        """f of each distinct value, for all offers."""
        codes, values = self.coded[column]
        return np.array([f(v) for v in values])[codes]

    def known(self, column: str, f: Callable) -> np.ndarray:
        return self.each(column, lambda v: UNKNOWN if v is None else OK if f(v) else FAIL).astype(np.uint8)

    def value(self, unit: str) -> np.ndarray:
        other = self.num["frozen"] if unit == "USD" else self.num["turned"]
        same = self.each("own", lambda v: v is None or v == unit)
        return np.where(np.isnan(self.num["price"]), np.nan, np.where(same, self.num["price"], other))

    def distances(self, zones: str) -> np.ndarray:
        """To each zone, of each distinct place; without coordinates half the globe, as least() passes over nulls in the columns and the SQL."""
        out = []
        lat, lon = self.spots[:, 0], self.spots[:, 1]
        for z in json.loads(zones):
            h = np.sin(np.radians(lat - z["lat"]) / 2) ** 2 + np.cos(np.radians(z["lat"])) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - z["lon"]) / 2) ** 2
            out.append(2 * RADIUS_KM * np.arcsin(np.sqrt(np.fmin(h, 1.0))))
        return np.array(out)

    def none(self) -> np.ndarray:
        return np.zeros(self.n, np.uint8)

    def range(self, value: np.ndarray, low: float, high: float) -> np.ndarray:
        return _tri(value, ~(value < low) & ~(value > high))

    def model(self, state):
        return np.full(self.n, state, np.uint8)

    def year(self, low, high, years):
        if low is None and high is None:
            return self.none()
        v, good = self.num["year"], ~np.zeros(self.n, bool)
        if years is not None:
            good = np.isin(v, [int(y) for y in years.split(",")])
        return np.where(good | np.isnan(v), self.range(v, _bound(low), _bound(high)), FAIL).astype(np.uint8)

    def price(self, low, high, unit):
        if low is None and high is None:
            return self.none()
        return np.where(self.flag["partial"], UNKNOWN, self.range(self.value(unit), _bound(low), _bound(high))).astype(np.uint8)

    def km(self, low, high):
        return self.none() if low is None and high is None else self.range(self.num["km"], _bound(low), _bound(high))

    def transmission(self, asked):
        return self.none() if asked is None else self.known("transmission", lambda v: asked in v)

    def fuel(self, asked):
        return self.none() if asked is None else self.known("fuel", lambda v: asked in v)

    def body_type(self, asked, less):
        if asked is None:
            return self.none()
        some = self.known("body_type", lambda v: v in asked.split(","))
        return np.where(some == UNKNOWN, FAIL, some).astype(np.uint8) if less else some

    def color(self, asked):
        if asked is None:
            return self.none()
        wanted = asked.split(",")
        own = self.each("color", lambda v: OK if v in wanted else UNKNOWN if v is None else FAIL)
        maybe = self.each("strong", lambda v: v is not None and any(x in wanted for x in v.split(",")))
        return np.where((own == FAIL) & maybe, UNKNOWN, own).astype(np.uint8)

    def location(self, zones):
        each = json.loads(zones)
        if not each:
            return self.none()
        near = (self.distances(zones) <= np.array([z["radius"] for z in each])[:, None]).any(0)
        return np.where(near, OK, FAIL).astype(np.uint8)[self.spot]

    def source(self, asked):
        return self.none() if asked is None else self.each("source", lambda v: OK if v in asked.split(",") else FAIL).astype(np.uint8)

    def seller(self, types, strict):
        state = self.known("who", lambda v: v in types.split(",")) if types is not None and strict else self.none()
        return np.where(self.flag["dealer"], FAIL, state).astype(np.uint8) if types == "private" else state

    def trim(self, asked):
        if asked is None:
            return self.none()
        any_of = [set(w.split(" ")) for w in asked.split("|")]
        return self.known("trim", lambda v: any(w <= set(v.split(" ")) for w in any_of))

    def km_target(self, most):
        return self.none() if most is None else self.range(self.num["km"], -np.inf, most)

    def price_target(self, most, unit):
        if most is None:
            return self.none()
        return self.range(np.where(self.flag["partial"] | self.flag["partial_null"], np.nan, self.value(unit)), -np.inf, most)

    def seller_type(self, types, strict):
        return self.none() if types is None or strict is not False else self.known("who", lambda v: v == types.split(",")[0])

    def max_distance(self, zones, most):
        if most is None:
            return self.none()
        far = self.distances(zones)
        near = np.fmin.reduce(far) if len(far) else np.full(len(self.spots), np.nan)
        return _tri(near, near <= most)[self.spot]


def _bound(v: float | None) -> float:
    return np.nan if v is None else v  # nothing is under or over it


def _classes(s: pd.DataFrame, rule: str) -> tuple[np.ndarray, list[tuple]]:
    """Each search's number among the distinct things that a rule reads, and those."""
    rows = list(zip(*[[None if v is None or v != v else v for v in s[k].tolist()] for k in READS[rule]]))
    place: dict[tuple, int] = {}
    return np.array([place.setdefault(r, len(place)) for r in rows]), list(place)


def _bits(mask: np.ndarray) -> np.ndarray:
    wide = np.zeros(-(-mask.size // 64) * 64, bool)
    wide[: mask.size] = mask
    return np.packbits(wide, bitorder="little").view(np.uint64)


def _sum(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


class Block:
    """The hard rules of a block of searches as bits of its offers: fail and unknown, a row for each distinct thing asked."""

    def __init__(self, s: pd.DataFrame, offers: Offers):
        self.n, self.n_offers = len(s), offers.n
        self.all = _bits(np.ones(offers.n, bool))
        self.rules = {}
        for rule in HARD:
            cls, asked = _classes(s, rule)
            fail, unknown = np.empty((len(asked), self.all.size), np.uint64), np.empty((len(asked), self.all.size), np.uint64)
            for k, a in enumerate(asked):
                state = getattr(offers, rule)(*a)
                fail[k], unknown[k] = _bits(state == FAIL), _bits(state == UNKNOWN)
            self.rules[rule] = (cls, fail, unknown)

    def chunks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(searches, offers that fail nothing, those of them with nothing unknown, offers that fail one rule)."""
        for at in range(0, self.n, CHUNK):
            part = slice(at, min(at + CHUNK, self.n))
            once = np.zeros((part.stop - at, self.all.size), np.uint64)
            twice, unsure = once.copy(), once.copy()
            for cls, fail, unknown in self.rules.values():
                f = fail[cls[part]]
                twice |= once & f
                once |= f
                unsure |= unknown[cls[part]]
            hit = ~once & self.all
            yield part, hit, hit & ~unsure, once & ~twice


SUMS = ["n", "n_match", "n_sure"]
BY_RULE = [f"{x}_{k}" for k in HARD for x in ("fail", "only")]


def sums(searches: DataFrame, offers: DataFrame, fx: float, by_rule: bool = False, block: tuple[int, int] = SUM_BLOCK) -> DataFrame:
    """(search, n, n_match, n_sure and by rule fail_, only_) in parts that are to be added up by search."""
    names = SUMS + (BY_RULE if by_rule else [])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = left.to_pandas()
        if not len(s) or not right.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ["search", *names]})
        b = Block(s, Offers(right.to_pandas()))
        out = {k: np.zeros(b.n, np.int64) for k in names}
        out["n"][:] = b.n_offers
        for part, hit, sure, once in b.chunks():
            out["n_match"][part], out["n_sure"][part] = _sum(hit), _sum(sure)
            if by_rule:
                for k, (cls, fail, _) in b.rules.items():
                    out[f"fail_{k}"][part], out[f"only_{k}"][part] = _sum(fail[cls[part]]), _sum(fail[cls[part]] & once)
        return pa.table({"search": s["search"].to_numpy(np.int64), **out})

    return cells(asks(searches), says(offers, fx), block).applyInArrow(run, ", ".join(f"{k} long" for k in ["search", *names]))


def first(searches: DataFrame, offers: DataFrame, fx: float, tab: str, order: Column, size: int, block: tuple[int, int] = SUM_BLOCK) -> DataFrame:
    """(search, id): of each block the first matches of each search, by falling or rising order (a double, nulls last), then id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, o = left.to_pandas(), right.to_pandas()
        found, ids = [np.array([], np.int64)], [np.array([], np.int64)]
        if len(s) and len(o):
            o = o.sort_values(["place", "id"], na_position="last", ignore_index=True)
            search, offer = s["search"].to_numpy(np.int64), o["id"].to_numpy(np.int64)
            for part, hit, sure, _ in Block(s, Offers(o)).chunks():
                shown = {"all": hit, "new": sure, "unsure": hit & ~sure}[tab]
                for k, words in enumerate(shown):
                    some = np.flatnonzero(words)[:size]  # words that hold the first ones
                    at = np.flatnonzero(np.unpackbits(words[some].view(np.uint8), bitorder="little"))[:size]
                    at = some[at // 64] * 64 + at % 64
                    found.append(np.full(at.size, search[part.start + k]))
                    ids.append(offer[at])
        return pa.table({"search": np.concatenate(found), "id": np.concatenate(ids)})

    return cells(asks(searches), says(offers, fx, order.cast("double").alias("place")), block).applyInArrow(run, "search long, id long")


def pairs(searches: DataFrame, offers: DataFrame, fx: float, keep: str, block: tuple[int, int] = PAIR_BLOCK) -> DataFrame:
    """(search, id, fails, oks, unknowns, soft_ok, soft_fail, missing) of pairs that fail nothing, or where two rules are ok.

    `keep` is 'match' or 'ok2'. What is returned grows with the pairs; a task holds those of one block at most.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, parts = left.to_pandas(), []
        if len(s) and right.num_rows:
            o = Offers(right.to_pandas())
            search, offer = s["search"].to_numpy(np.int64), o.frame["id"].to_numpy(np.int64)
            table = {}
            for rule in HARD + SOFT:
                cls, asked = _classes(s, rule)
                table[rule] = (cls, np.stack([getattr(o, rule)(*a) for a in asked]))
            for at in range(0, len(s), CHUNK):
                part = slice(at, at + CHUNK)
                count = {k: np.zeros((len(search[part]), o.n), np.uint8) for k in ("fails", "oks", "soft_ok", "soft_fail")}
                lacks = np.zeros((len(search[part]), o.n), np.uint16)
                for k, rule in enumerate(HARD):
                    cls, states = table[rule]
                    v = states[cls[part]]
                    count["fails"] += v == FAIL
                    count["oks"] += v == OK
                    lacks |= (v == UNKNOWN).astype(np.uint16) << np.uint16(k)
                i, j = np.nonzero(count["fails"] == 0 if keep == "match" else count["oks"] >= 2)
                for rule in SOFT:
                    cls, states = table[rule]
                    v = states[cls[part]]
                    count["soft_ok"] += v == OK
                    count["soft_fail"] += v == FAIL
                lack = lacks[i, j]
                values, codes = np.unique(lack, return_inverse=True)
                names = pa.array([",".join(r for k, r in enumerate(HARD) if v >> k & 1) for v in values.tolist()], pa.string())
                out = {"search": search[part][i], "id": offer[j], **{k: c[i, j].astype(np.int64) for k, c in count.items()}, "unknowns": np.bitwise_count(lack).astype(np.int64)}
                parts.append(pa.table({**{k: pa.array(v) for k, v in out.items()}, "missing": names.take(pa.array(codes.ravel()))}).select(PAIR.names))
        return pa.concat_tables(parts) if parts else PAIR.empty_table()

    return cells(asks(searches), says(offers, fx), block).applyInArrow(run, ", ".join(f"{k} {'string' if k == 'missing' else 'long'}" for k in PAIR.names))


#: What the columns of `rules` read of a search and of an offer, and where a search asks nothing by a rule.
FIELDS = {
    "model": ("make model body_types", "make model", "NOT (coalesce(trim(make), '') = '' AND coalesce(trim(model), '') = '') OR body_types IS NULL"), "year": ("year_min year_max years", "year", "coalesce(year_min, year_max) IS NOT NULL OR years IS NOT NULL"),
    "price": ("price_min price_max currency", "price price_usd currency price_partial", "price_min IS NOT NULL OR price_max IS NOT NULL"), "km": ("km_min km_max", "km", "km_min IS NOT NULL OR km_max IS NOT NULL"),
    "transmission": ("transmission", "transmission", "transmission IS NOT NULL"), "fuel": ("fuel", "fuel", "fuel IS NOT NULL"), "body_type": ("make model body_types", "body_type", "body_types IS NOT NULL"),
    "color": ("colors", "color maybe_colors", "colors IS NOT NULL"), "location": ("radius lat lon extra_zones", "lat lon", "radius IS NOT NULL OR extra_zones IS NOT NULL"), "source": ("sources", "source", "sources IS NOT NULL"),
    "seller": ("seller_types seller_filter", "seller_type dealer_inferred dealer", "seller_types IS NOT NULL"), "trim": ("trims", "trim", "trims IS NOT NULL"), "km_target": ("km_target", "km", "km_target IS NOT NULL"),
    "price_target": ("price_target currency", "price price_usd currency price_partial", "price_target IS NOT NULL"), "seller_type": ("seller_types seller_filter", "seller_type dealer_inferred", "NOT seller_filter AND seller_types IS NOT NULL"),
    "max_distance": ("max_distance radius lat lon extra_zones", "lat lon", "max_distance IS NOT NULL"),
}
#: Rules of nearly as many different values as rows: their states are worked out pair by pair, of what `priced` prepares.
WIDE = {"price", "price_target"}
#: Parts of what a rule is said to read that it reads only in part: whether there is a dealer, and no model where only the make is asked.
SAID = {"dealer": lambda: F.when(F.col("dealer").isNotNull(), F.lit(0)), "model": lambda: F.when(F.startswith("kind", F.lit("model=")), F.col("model"))}
#: Few offers at a time beside many searches: what a search is compared with stays near the processor, a task is short, and the
#: ids of a block come again for each search within what a column's compression looks back on, so pairs take little room.
STATE_BLOCK = (1_024, 16_384)


def priced(s: DataFrame, o: DataFrame, fx: float, rule: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a price rule with its strings and units worked out once a row, and the state of a pair of them."""
    c = F.col
    high, low = (c("asked.price_max"), c("asked.price_min")) if rule == "price" else (c("asked.price_target"), F.lit(None))
    unit = rules.currency_of(F.coalesce(high, low), c("asked.currency"))
    # not a number is over all prices, so a missing bound compares as one
    s = s.select("kind", "search", unit.alias("unit"), (unit == "USD").alias("dollars"), F.coalesce(low.cast("double"), F.lit(float("-inf"))).alias("low"), F.coalesce(high.cast("double"), F.lit(float("nan"))).alias("high"))
    hidden = F.coalesce("said.price_partial", F.lit(rule != "price"))
    price = F.when(~hidden & (c("said.price") > 0), c("said.price")).cast("double")
    own = F.upper("said.currency")
    o = o.select("kind", "id", own.alias("own"), price.alias("price"), F.when(own.isNull() | (own == "USD"), price).when(price.isNotNull(), F.coalesce("said.price_usd", price / fx)).alias("in_dollars"), (price * fx).alias("turned"))
    value = F.when(c("dollars"), c("in_dollars")).when(c("own").isNull() | (c("own") == c("unit")), c("price")).otherwise(c("turned"))
    return s, o, rules.state(value, (value <= c("high")) & (value >= c("low"))).alias("result")


def states(searches: DataFrame, offers: DataFrame, fx: float, rule: str, block: tuple[int, int] | None = None) -> DataFrame:
    """(search, id, result) of one rule, for all pairs of searches that ask it and offers that they meet.

    A rule is worked out between the distinct things asked and said in a kind; pairs are then a join of the searches with the
    blocks of offers that say the same.
    """
    of_s, of_o, asked = FIELDS[rule]
    s = searches.filter(asked).select(F.explode(wanted()).alias("kind"), "search", F.struct(*of_s.split()).alias("asked"))
    o = offers.select(F.explode(offered()).alias("kind"), "id", *of_o.split())
    o = o.select("kind", "id", F.struct(*[SAID[k]().alias(k) if k in SAID else k for k in of_o.split()]).alias("said"))
    field = (lambda k: F.col(f"asked.{k}")), (lambda k: F.col(f"said.{k}"))
    if rule in WIDE:
        s, o, result = priced(s, o, fx, rule)
        return met(*dealt(s, o, block or STATE_BLOCK)).select("search", "id", result)
    result = (rules.hard(*field, fx) | rules.soft(*field, fx))[rule].alias("result")
    known = s.select("kind", "asked").distinct().join(o.select("kind", "said").distinct(), "kind").select("kind", "asked", "said", result).filter("result IS NOT NULL")
    both = F.struct("kind", "said").alias("kind")
    return met(*dealt(s.join(known, ["kind", "asked"]).select(both, "search", "result"), o.select(both, "id"), block or STATE_BLOCK)).select("search", "id", "result")
