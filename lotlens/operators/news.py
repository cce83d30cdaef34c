"""Which listings that a read stores for the first time are news, and which are old stock that only this read reached.

A target reads a source again and again, each time with bounds (years, mileage) that its searches set and perhaps a band of
years beyond them. A read that got to its end is complete; the bounds of a target's last complete read are its envelope. Of
what a read stores first, in this order:

dated      published lately: always news
first_run  no read of the target was complete before
step       at least five new listings outside of the band, and twice them at least what was found by the best of the last
           three good reads that found something (none of which: nothing to compare with, unless all good reads were empty)
band       beyond the searches' own years, and the envelope did not reach that year
envelope   outside of the envelope: a wider search brings it
news       all else; and what another target of the source, of the same make and model, would have stored before: it lies within
           that one's own bounds and the envelope it had by then

Runs are told by windows over a target's reads, a row for each run; siblings' envelopes are intervals of time that rows of
the same source, make and model meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP_NEW, STEP_RUNS = 5, 3
BOUNDS = ("year_min", "year_max", "km_max")


def outside(year: Column, km: Column, bounds: Column) -> Column:
    """Whether a listing is outside of bounds; null bounds bound nothing, and an unknown year or mileage is inside."""
    return F.coalesce(year < bounds["year_min"], F.lit(False)) | F.coalesce(year > bounds["year_max"], F.lit(False)) | F.coalesce(km > bounds["km_max"], F.lit(False))


def beyond(year: Column, bounds: Column) -> Column:
    return F.coalesce(year < bounds["year_min"], F.lit(False)) | F.coalesce(year > bounds["year_max"], F.lit(False))


def read_band(own: Column, band: Column) -> Column:
    """The bounds that a read was sent with: its searches' own, with the band's years on either side."""
    b = F.coalesce(band, F.lit(0))
    return F.struct((own["year_min"] - b).alias("year_min"), (own["year_max"] + b).alias("year_max"), own["km_max"].alias("km_max"))


def runs(reads: DataFrame) -> DataFrame:
    """reads with what was known before each: envelope, base (what a step is held against) and first_run; and until when its
    own envelope holds."""
    past = Window.partitionBy("target").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(*BOUNDS)
    full = F.when(F.col("complete"), read_band(own, F.col("band")))
    loaded = F.col("ok") & (F.col("found") > 0)
    each = reads.withColumn("own", own).withColumn("sent", full)
    best = F.max("found").over(Window.partitionBy("target", loaded).orderBy("at").rowsBetween(1 - STEP_RUNS, 0))
    each = each.withColumn("best", F.when(loaded, best))
    base = F.coalesce(F.last("best", ignorenulls=True).over(past), F.when(F.coalesce(F.max(F.col("ok").cast("int")).over(past), F.lit(0)) > 0, 0))
    return each.withColumn("envelope", F.last("sent", ignorenulls=True).over(past)).withColumn("base", base).withColumn("first_run", F.col("envelope").isNull())


def envelopes(known: DataFrame) -> DataFrame:
    """(source, make, model, sibling, own, sent, from, until): the envelope of each target from one complete read to the next."""
    done = known.filter("complete").select("source", F.lower("make").alias("make"), F.lower("model").alias("model"), F.col("target").alias("sibling"), "own", "sent", F.col("at").alias("from"))
    return done.withColumn("until", F.lead("from").over(Window.partitionBy("sibling").orderBy("from")))


def classify(reads: DataFrame, fresh: DataFrame) -> DataFrame:
    """(target, at, id, reason) of what the reads stored first.

    reads: target, at, source, make, model, year_min, year_max, km_max (of the searches), band, ok, complete, found; a target
    has a read at one time. fresh: target, at, id, make, model, year, km, dated.
    """
    known = runs(reads)
    rows = fresh.join(known.select("target", "at", "source", "own", "band", "envelope", "base", "first_run"), ["target", "at"])
    banded = (F.coalesce("band", F.lit(0)) > 0) & beyond(F.col("year"), F.col("own"))
    rows = rows.withColumn("in_band", banded)
    new = rows.filter(~F.col("in_band")).groupBy("target", "at").agg(F.count(F.lit(1)).alias("new"))
    rows = rows.join(new, ["target", "at"], "left")
    left_out = F.when(F.col("in_band"), beyond(F.col("year"), F.col("envelope"))).otherwise(outside(F.col("year"), F.col("km"), F.col("envelope")))
    rows = rows.withColumn("left_out", F.coalesce(left_out, F.lit(False)))
    asked = rows.filter("left_out and not first_run").select("target", "at", "id", "source", F.lower("make").alias("make"), F.lower("model").alias("model"), "year", "km")
    met = asked.join(envelopes(known), ["source", "make", "model"]).filter((F.col("sibling") != F.col("target")) & (F.col("from") < F.col("at")) & (F.col("until").isNull() | (F.col("until") >= F.col("at"))))
    seen = met.filter(~outside(F.col("year"), F.col("km"), F.col("own")) & ~outside(F.col("year"), F.col("km"), F.col("sent"))).select("target", "at", "id").distinct().withColumn("covered", F.lit(True))
    rows = rows.join(seen, ["target", "at", "id"], "left")
    step = F.coalesce((F.col("new") >= STEP_NEW) & (2 * F.col("new") >= F.col("base")), F.lit(False)) & ~F.col("in_band")
    unread = F.col("left_out") & F.col("covered").isNull()
    reason = F.when(F.coalesce("dated", F.lit(False)), "dated").when(F.col("first_run"), "first_run").when(step, "step").when(unread & F.col("in_band"), "band").when(unread, "envelope").otherwise("news")
    return rows.select("target", "at", "id", reason.alias("reason"))
