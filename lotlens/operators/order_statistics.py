"""Percentiles of each offer's own pool, without pairs.

The pool of an offer is the offers of its make and model within a year, some of them near in mileage, less itself. All pools
of one make, model and target year are cut from the same rows, so they are told by ranges: rows in order of (key, mileage)
have each pool as a range of one key, and the offer itself, or its seller's offers, as a range to take off. A wavelet matrix
over the rows' price ranks answers the k-th price of sums and differences of ranges in a logarithm of steps, for all
offers at once. Work and memory grow with the rows, not with their square; nothing is sampled or cut. The make, model and
year are a part of the key, so small ones are judged together: in BUCKETS buckets for each shuffle partition, and in more
where these would hold over ROWS rows. A make, model and target year is one bucket at least.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

YEARS, BUCKETS, ROWS = 1, 2, 50_000


class Order:
    """Rows in order of (key, mileage), missing mileage last, with zero counts of each bit of their price ranks."""

    def __init__(self, key: np.ndarray, km_rank: np.ndarray, none: int, rank: np.ndarray, bits: int):
        self.width = none + 1
        composite = key.astype(np.int64) * self.width + km_rank
        by = np.argsort(composite, kind="stable")
        self.composite = composite[by]
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.arange(len(by))
        self.zeros, seq = [], rank[by]
        for bit in range(bits - 1, -1, -1):
            zero = (seq >> bit) & 1 == 0
            self.zeros.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(zero, dtype=np.int32))))
            seq = np.concatenate((seq[zero], seq[~zero]))

    def range(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of the keys with mileage ranks from low up to high stand."""
        base = key.astype(np.int64) * self.width
        left = np.searchsorted(self.composite, base + low)
        return left, np.maximum(left, np.searchsorted(self.composite, base + high))


Part = tuple[Order, np.ndarray, np.ndarray, int]


def size(parts: list[Part]) -> np.ndarray:
    return sum(sign * (r - l) for _, l, r, sign in parts)


def kth(parts: list[Part], k: np.ndarray) -> np.ndarray:
    """The price rank that k others of the ranges lie under."""
    state, k = [(o, l.copy(), r.copy(), s) for o, l, r, s in parts], k.copy()
    out = np.zeros(len(k), np.int64)
    for level in range(len(parts[0][0].zeros)):
        pairs = [(o.zeros[level][l], o.zeros[level][r]) for o, l, r, _ in state]
        under = sum(s * (b - a) for (a, b), (_, _, _, s) in zip(pairs, state, strict=True))
        low = k < under
        k = np.where(low, k, k - under)
        out = 2 * out + ~low
        state = [(o, np.where(low, a, o.zeros[level][-1] + l - a), np.where(low, b, o.zeros[level][-1] + r - b), s) for (a, b), (o, l, r, s) in zip(pairs, state, strict=True)]
    return out


def under(parts: list[Part], rank: np.ndarray) -> np.ndarray:
    """How many rows of the ranges have a smaller price rank."""
    bits = len(parts[0][0].zeros)
    state, count = [(o, l.copy(), r.copy(), s) for o, l, r, s in parts], np.zeros(len(rank), np.int64)
    for level in range(bits):
        one = (rank >> (bits - 1 - level)) & 1 == 1
        pairs = [(o.zeros[level][l], o.zeros[level][r]) for o, l, r, _ in state]
        count += np.where(one, sum(s * (b - a) for (a, b), (_, _, _, s) in zip(pairs, state, strict=True)), 0)
        state = [(o, np.where(one, o.zeros[level][-1] + l - a, a), np.where(one, o.zeros[level][-1] + r - b, b), s) for (a, b), (o, l, r, s) in zip(pairs, state, strict=True)]
    return np.where(rank >> bits > 0, size(parts), count)


class Pools:
    """The rows of one make, model and target year as orders by key, and percentiles of ranges of them."""

    def __init__(self, price: np.ndarray, km: np.ndarray):
        self.n, self.sorted = len(price), np.sort(price, kind="stable")
        self.rank = np.empty(self.n, np.int64)
        self.rank[np.argsort(price, kind="stable")] = np.arange(self.n)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.km = km
        self.known = np.unique(km[~np.isnan(km)])
        self.none = len(self.known)
        self.km_rank = np.where(np.isnan(km), self.none, np.searchsorted(self.known, np.nan_to_num(km)))

    def order(self, *keys: np.ndarray) -> tuple[Order, np.ndarray]:
        code = np.zeros(self.n, np.int64)
        for k in keys:
            values = np.unique(k, return_inverse=True)[1]
            code = np.unique(code * (values.max(initial=0) + 1) + values, return_inverse=True)[1]
        return Order(code, self.km_rank, self.none, self.rank, self.bits), code

    def near(self, at: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the mileages that differ by the tolerance at most; all for a row without mileage."""
        km = np.nan_to_num(self.km[at])
        low, high = np.searchsorted(self.known, km - tolerance), np.searchsorted(self.known, km + tolerance, side="right")
        if self.none:
            last = self.none - 1
            low += (low <= last) & (km - self.known[np.minimum(low, last)] > tolerance)
            low -= (low > 0) & (km - self.known[np.maximum(low - 1, 0)] <= tolerance)
            high -= (high > 0) & (self.known[np.maximum(high - 1, 0)] - km > tolerance)
            high += (high <= last) & (self.known[np.minimum(high, last)] - km <= tolerance)
        return low, high

    def own(self, order: Order, at: np.ndarray, there: np.ndarray) -> Part:
        """The rows themselves, to be taken off where they are in the range."""
        return order, order.place[at], order.place[at] + there, -1

    def percentile(self, parts: list[Part], q: float, skip: np.ndarray | None = None) -> np.ndarray:
        """Between ranks, of the rows but for the skip cheapest; nan where none is left."""
        skip = np.zeros(len(parts[0][1]), np.int64) if skip is None else skip
        left = size(parts) - skip
        at = np.maximum(left - 1, 0) * q
        low, some = np.floor(at).astype(np.int64), left > 0
        a = self.sorted[np.minimum(kth(parts, skip + low), self.n - 1)]
        b = self.sorted[np.minimum(kth(parts, skip + np.minimum(low + 1, np.maximum(left - 1, 0))), self.n - 1)]
        return np.where(some, a + (b - a) * (at - low), np.nan)


def group_of(pdf: pd.DataFrame) -> np.ndarray:
    """A code for each make, model and target year; one for all where they are not told."""
    if "of" not in pdf:
        return np.zeros(len(pdf), np.int64)
    return pdf.groupby(["make", "model", "of"], dropna=False, sort=False).ngroup().to_numpy(np.int64)


def codes(*columns: pd.Series) -> np.ndarray:
    """A code for each combination of values."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values = pd.factorize(c, use_na_sentinel=False)[0]
        out = pd.factorize(out * (values.max(initial=0) + 1) + values)[0]
    return out


def by_bucket(wide: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int) -> DataFrame:
    """judge over the rows of many makes, models and target years (of) at once; rows: how many there are at most."""
    many = max(BUCKETS * int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    bucket = F.pmod(F.xxhash64("make", "model", "of"), F.lit(many))
    tasks = min(max(1, rows // ROWS), 2_000)  # few bytes make much work, so tasks are dealt by rows
    return wide.withColumn("bucket", bucket).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(lambda pdf: judge(pdf), schema)


def per_year(offers: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: list[str]) -> DataFrame:
    """judge over the rows of each make, model and target year with its neighbours; a row is a target where `target` is true."""
    wide = offers.select("id", "make", "model", "year", "price", F.col("km").cast("double").alias("km"), *columns, F.explode(F.sequence(F.col("year") - YEARS, F.col("year") + YEARS)).alias("of"))
    return by_bucket(wide.withColumn("target", F.col("of") == F.col("year")), judge, schema, (2 * YEARS + 1) * offers.count())


def reference(pdf: pd.DataFrame, tolerance: float = 0.25, share: float = 0.35, least: int = 5) -> pd.DataFrame:
    """The cascade of references: prices over a share of the pool's upper quartile, by version and gearbox, gearbox, model."""
    at = np.flatnonzero(pdf["target"].to_numpy())
    p = Pools(pdf["price"].to_numpy(float), pdf["km"].to_numpy(float))
    trim, gear = pdf["trim"], pdf["gearbox"]
    zero = np.zeros(len(at), np.int64)
    low, high = p.near(at, np.nan_to_num(p.km[at]) * tolerance)
    blind = np.isnan(p.km[at])
    group = group_of(pdf)
    levels = {"trim_gearbox": ((codes(group, trim, gear),), (trim.notna() & gear.notna()).to_numpy()), "gearbox": ((codes(group, gear),), gear.notna().to_numpy()), "model": ((group,), np.ones(len(pdf), bool))}
    made = {}
    for name, (keys, has) in levels.items():
        order, code = p.order(*keys)
        key, ok = code[at], has[at]
        l, r = order.range(key, np.where(blind, zero, low), np.where(blind, p.none + 1, high))
        nl, nr = order.range(key, np.where(blind, p.none + 1, p.none), zero + p.none + 1)
        r, nr = np.where(ok, r, l), np.where(ok, nr, nl)
        made[name] = ([(order, l, r, 1), (order, nl, nr, 1), p.own(order, at, ok)], keys, code, ok)
    floor = p.percentile(made["model"][0], 0.75) * share
    cut = np.searchsorted(p.sorted, np.nan_to_num(floor))
    out = pd.DataFrame({"id": pdf["id"].to_numpy()[at], "price": p.sorted[p.rank[at]], "level": "", "n": 0, "p25": np.nan, "median": np.nan, "p75": np.nan, "median_km": np.nan})
    open_ = np.ones(len(at), bool)
    by_km = Pools(p.km_rank.astype(float), p.sorted[p.rank])  # the same with prices and mileages exchanged
    for name, (parts, keys, code, ok) in made.items():
        skip = under(parts, cut)
        n = size(parts) - skip
        take = open_ & ((n >= least) | (name == "model")) & (n > 0)
        open_ &= ~take
        if not take.any():
            continue
        some = [(o, l[take], r[take], s) for o, l, r, s in parts]
        for column, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            out.loc[take, column] = p.percentile(some, q, skip[take])
        out.loc[take, "level"], out.loc[take, "n"] = name, n[take]
        order, _ = by_km.order(*keys)
        first = np.searchsorted(by_km.known, np.nan_to_num(floor[take]))
        l, r = order.range(code[at][take], first, np.full(take.sum(), by_km.none + 1))
        inside = [(order, l, r, 1), by_km.own(order, at[take], p.sorted[p.rank[at[take]]] >= floor[take])]
        a = under(inside, np.searchsorted(by_km.sorted, np.where(blind, 0, low)[take]))
        b = under(inside, np.searchsorted(by_km.sorted, np.where(blind, p.none, high)[take]))
        known = b - a
        mid = np.maximum(known - 1, 0) * 0.5
        pick = lambda k, inside=inside: p.known[np.minimum(by_km.sorted[np.minimum(kth(inside, k), p.n - 1)].astype(int), max(p.none - 1, 0))] if p.none else np.zeros(len(k))
        x, y = pick(a + np.floor(mid).astype(np.int64)), pick(a + np.ceil(mid).astype(np.int64))
        out.loc[take, "median_km"] = np.where(known > 0, (x + y) / 2, np.nan)
    return out[out["n"] > 0]


def cohort(pdf: pd.DataFrame, tolerance: float = 0.25, share: float = 0.35) -> pd.DataFrame:
    """The last level of the references alone: the median of the model's pool over the share of its upper quartile."""
    at = np.flatnonzero(pdf["target"].to_numpy())
    p = Pools(pdf["price"].to_numpy(float), pdf["km"].to_numpy(float))
    low, high = p.near(at, np.nan_to_num(p.km[at]) * tolerance)
    blind, end = np.isnan(p.km[at]), np.full(len(at), p.none + 1)
    order, code = p.order(group_of(pdf))
    near = order.range(code[at], np.where(blind, 0, low), np.where(blind, end, high))
    unknown = order.range(code[at], np.where(blind, end, p.none), end)
    parts = [(order, *near, 1), (order, *unknown, 1), p.own(order, at, np.ones(len(at), bool))]
    skip = under(parts, np.searchsorted(p.sorted, np.nan_to_num(p.percentile(parts, 0.75) * share)))
    made = pd.DataFrame({"id": pdf["id"].to_numpy()[at], "n": size(parts) - skip, "median": p.percentile(parts, 0.5, skip)})
    return made[made["n"] > 0]


COHORT = "id long, n long, median double"
REFERENCE = "id long, price double, level string, n long, p25 double, median double, p75 double, median_km double"


def _near_parts(p: Pools, at: np.ndarray, order: Order, code: np.ndarray, key: np.ndarray, ok: np.ndarray, km_least: float, km_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The range of a key's rows of known mileage near that of each target, and whether the target can have any."""
    low, high = p.near(at, np.maximum(km_least, np.nan_to_num(p.km[at]) * km_share))
    ok = ok & ~np.isnan(p.km[at])
    l, r = order.range(key, low, high)
    return l, np.where(ok, r, l), ok


def context(pdf: pd.DataFrame, km_least: float = 5.0, km_share: float = 0.2) -> pd.DataFrame:
    """Medians of six cuts of each target's pool."""
    at = np.flatnonzero(pdf["target"].to_numpy())
    p = Pools(pdf["price"].to_numpy(float), pdf["km"].to_numpy(float))
    every, zero = np.ones(len(at), bool), np.zeros(len(at), np.int64)
    out = {"id": pdf["id"].to_numpy()[at]}
    group, has_trim = group_of(pdf), pdf["trim"].notna().to_numpy()
    dealer = (pdf["source"] == "A").to_numpy()

    def whole(order: Order, key: np.ndarray, ok: np.ndarray, mine: np.ndarray) -> list[Part]:
        l, r = order.range(key, zero, zero + p.none + 1)
        return [(order, l, np.where(ok, r, l), 1), p.own(order, at, ok & mine)]

    def near(order: Order, code: np.ndarray) -> list[Part]:
        l, r, ok = _near_parts(p, at, order, code, code[at], every, km_least, km_share)
        return [(order, l, r, 1), p.own(order, at, ok)]

    (all_, c0), (by_year, c1), (by_trim, c2) = p.order(group), p.order(codes(group, pdf["year"])), p.order(codes(group, pdf["trim"]))
    by_dealer = Order(2 * group + dealer, p.km_rank, p.none, p.rank, p.bits)
    parts = {
        "all_years": whole(all_, c0[at], every, every), "same_year": whole(by_year, c1[at], every, every), "similar_km": near(all_, c0), "closest": near(by_year, c1),
        "same_trim": whole(by_trim, c2[at], has_trim[at], every), "dealers": whole(by_dealer, 2 * group[at] + 1, every, dealer[at]),
    }
    out["n"] = size(parts["all_years"])
    for name, some in parts.items():
        out[name] = p.percentile(some, 0.5)
    made = pd.DataFrame(out)
    return made[made["n"] > 0]


CONTEXT = "id long, n long, all_years double, same_year double, similar_km double, closest double, same_trim double, dealers double"


def market(pdf: pd.DataFrame, km_least: float = 5.0, km_share: float = 0.2) -> pd.DataFrame:
    """Counts and medians of other sellers' offers: of the same version and near in mileage, near in mileage, and all."""
    at = np.flatnonzero(pdf["target"].to_numpy())
    p = Pools(pdf["price"].to_numpy(float), pdf["km"].to_numpy(float))
    every, zero = np.ones(len(at), bool), np.zeros(len(at), np.int64)
    group, seller, has_trim = group_of(pdf), pdf["seller"].to_numpy(), pdf["trim"].notna().to_numpy()
    out = {"id": pdf["id"].to_numpy()[at], "price": p.sorted[p.rank[at]]}
    for k, keys, ok, close in (("1", (codes(group, pdf["trim"]),), has_trim[at], True), ("2", (group,), every, True), ("3", (group,), every, False)):
        parts = []
        for order, code, sign in ((*p.order(*keys), 1), (*p.order(*keys, seller), -1)):
            if close:
                l, r, _ = _near_parts(p, at, order, code, code[at], ok, km_least, km_share)
            else:
                l, r = order.range(code[at], zero, zero + p.none + 1)
            parts.append((order, l, r, sign))
        out[f"n{k}"], out[f"m{k}"] = size(parts), p.percentile(parts, 0.5)
    return pd.DataFrame(out)


MARKET = "id long, price double, n1 long, m1 double, n2 long, m2 double, n3 long, m3 double"


def split_reference(pdf: pd.DataFrame, tolerance: float = 0.25, share: float = 0.35, least: int = 5) -> pd.DataFrame:
    """The cascade with the chosen level's dealers and private sellers apart, for targets that need not be in the pool.

    `member` tells which rows are in the pool, `of_target` the offer that a row is a repost of: it never counts for that one.
    """
    at = np.flatnonzero(pdf["target"].to_numpy())
    member = pdf["member"].to_numpy(bool)
    p = Pools(pdf["price"].fillna(0).to_numpy(float), pdf["km"].to_numpy(float))
    ids, reposts = pdf["id"].to_numpy(), pdf["of_target"].fillna(-1).to_numpy(np.int64)
    zero = np.zeros(len(at), np.int64)
    low, high = p.near(at, np.nan_to_num(p.km[at]) * tolerance)
    blind = np.isnan(p.km[at])
    told = np.flatnonzero(member & (reposts >= 0))
    told = told[np.argsort(reposts[told], kind="stable")]
    first, last = np.searchsorted(reposts[told], ids[at]), np.searchsorted(reposts[told], ids[at], side="right")
    own_reposts = [np.where(first + k < last, told[np.minimum(first + k, len(told) - 1)], -1) for k in range((last - first).max(initial=0))]

    def parts(code: np.ndarray, has: np.ndarray, among: np.ndarray, some: np.ndarray) -> list[Part]:
        """The pool rows of the key of some targets that are among the given ones."""
        order = Order(np.where(among, code, code.max(initial=0) + 1), p.km_rank, p.none, p.rank, p.bits)
        mine, unknown = at[some], blind[some]
        key, ok, end = code[mine], has[mine], zero[some] + p.none + 1
        l, r = order.range(key, np.where(unknown, 0, low[some]), np.where(unknown, end, high[some]))
        nl, nr = order.range(key, np.where(unknown, end, p.none), end)
        r, nr = np.where(ok, r, l), np.where(ok, nr, nl)
        made = [(order, l, r, 1), (order, nl, nr, 1), p.own(order, mine, ok & among[mine])]
        for rows in own_reposts:
            place = np.where(rows[some] >= 0, order.place[rows[some]], 0)
            inside = (rows[some] >= 0) & (((place >= l) & (place < r)) | ((place >= nl) & (place < nr)))
            made.append((order, place, place + inside, -1))
        return made

    trim, gear = pdf["trim"], pdf["gearbox"]
    group = group_of(pdf)
    levels = {"trim_transmission": (codes(group, trim, gear), (trim.notna() & gear.notna()).to_numpy()), "transmission": (codes(group, gear), gear.notna().to_numpy()), "model": (group, np.ones(len(pdf), bool))}
    floor = p.percentile(parts(*levels["model"], member, np.arange(len(at))), 0.75) * share
    cut = np.searchsorted(p.sorted, np.nan_to_num(floor))
    out = {"level": np.full(len(at), "", object), **{k: np.zeros(len(at), np.int64) for k in ("n", "dealer_n", "private_n")}, **{k: np.full(len(at), np.nan) for k in ("p25", "median", "p75", "dealer_median", "private_median")}}
    open_ = np.arange(len(at))
    groups = {"dealer": member & pdf["dealer"].to_numpy(bool), "private": member & pdf["private"].to_numpy(bool)}
    for name, (code, has) in levels.items():
        full = parts(code, has, member, open_)
        skip = under(full, cut[open_])
        n = size(full) - skip
        take = (n >= least) | (name == "model")
        out["level"][open_[take]], out["n"][open_[take]] = name, n[take]
        take &= n > 0  # nothing is told of an empty pool
        some, open_ = open_[take], open_[n < least]
        for column, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            out[column][some] = p.percentile([(o, l[take], r[take], s) for o, l, r, s in full], q, skip[take])
        for who, among in groups.items():
            theirs = parts(code, has, among, some)
            below = under(theirs, cut[some])
            out[f"{who}_n"][some] = size(theirs) - below
            out[f"{who}_median"][some] = p.percentile(theirs, 0.5, below)
    return pd.DataFrame({"id": ids[at], "price": pdf["price"].to_numpy(float)[at], **{k: out[k] for k in ("level", "n", "p25", "median", "p75", "dealer_n", "dealer_median", "private_n", "private_median")}})


SPLIT = "id long, price double, level string, n long, p25 double, median double, p75 double, dealer_n long, dealer_median double, private_n long, private_median double"
