"""News against a loop over the reads, one after the other."""

from __future__ import annotations

import random

from lotlens.operators import news

READ = "target string, at int, source string, make string, model string, year_min int, year_max int, km_max long, band int, ok boolean, complete boolean, found int"
ROW = "target string, at int, id long, make string, model string, year int, km long, dated boolean"


def outside(year, km, b):
    low, high, most = b
    return (year is not None and ((low is not None and year < low) or (high is not None and year > high))) or (km is not None and most is not None and km > most)


def sent(r):
    low, high, most, band = r["year_min"], r["year_max"], r["km_max"], r["band"] or 0
    return (None if low is None else low - band, None if high is None else high + band, most)


def loop(reads, rows):
    reads = [dict(zip([c.split()[0] for c in READ.split(", ")], r, strict=True)) for r in reads]
    rows = [dict(zip([c.split()[0] for c in ROW.split(", ")], r, strict=True)) for r in rows]

    def envelope(target, at):
        done = [r for r in reads if r["target"] == target and r["at"] < at and r["complete"]]
        return max(done, key=lambda r: r["at"]) if done else None

    out = {}
    for run in reads:
        mine = [x for x in rows if (x["target"], x["at"]) == (run["target"], run["at"])]
        own = (run["year_min"], run["year_max"], run["km_max"])
        before = envelope(run["target"], run["at"])
        good = [r for r in reads if r["target"] == run["target"] and r["at"] < run["at"] and r["ok"]]
        full = sorted((r for r in good if (r["found"] or 0) > 0), key=lambda r: -r["at"])[:3]
        base = max((r["found"] for r in full), default=0 if good else None)
        band = [bool(run["band"]) and outside(x["year"], None, own) for x in mine]
        new = band.count(False)
        for x, b in zip(mine, band, strict=True):
            reason = "news"
            if x["dated"]:
                reason = "dated"
            elif before is None:
                reason = "first_run"
            elif not b and base is not None and new >= 5 and 2 * new >= base:
                reason = "step"
            elif outside(x["year"], None if b else x["km"], sent(before)):
                others = {r["target"] for r in reads if r["target"] != run["target"] and r["source"] == run["source"] and r["make"].lower() == x["make"].lower() and r["model"].lower() == x["model"].lower()}
                held = [e for t in others if (e := envelope(t, run["at"]))]
                if not any(not outside(x["year"], x["km"], (e["year_min"], e["year_max"], e["km_max"])) and not outside(x["year"], x["km"], sent(e)) for e in held):
                    reason = "band" if b else "envelope"
            out[x["target"], x["at"], x["id"]] = reason
    return out


def test_as_the_loop(spark):
    rng = random.Random(6)
    reads, rows, number = [], [], 0
    for target, source, model in (("a", "s", "Gol"), ("b", "s", "gol"), ("c", "s", "up"), ("d", "t", "Gol"), ("e", "t", "gol")):
        for at in sorted(rng.sample(range(40), 22)):
            ok = rng.random() < 0.8
            reads.append((target, at, source, "VW" if at % 2 else "vw", model, rng.choice([None, 2008, 2010, 2012]), rng.choice([None, 2014, 2016]), rng.choice([None, 90, 120]), rng.choice([None, 0, 1, 2]), ok, ok and rng.random() < 0.5, rng.choice([0, 0, 4, 9, 30])))
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                number += 1
                rows.append((target, at, number, "Vw", "GOL" if model != "up" else "up", rng.choice([None, *range(2005, 2020)]), rng.choice([None, 50, 100, 130]), rng.choice([None, False, False, False, True])))
    got = {(r.target, r.at, r.id): r.reason for r in news.classify(spark.createDataFrame(reads, READ), spark.createDataFrame(rows, ROW)).collect()}
    want = loop(reads, rows)
    assert got == want
    assert set(want.values()) == {"dated", "first_run", "step", "band", "envelope", "news"}


def test_no_reads(spark):
    assert news.classify(spark.createDataFrame([], READ), spark.createDataFrame([], ROW)).collect() == []
