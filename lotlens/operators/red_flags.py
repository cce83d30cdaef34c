"""What a buyer should look at in an offer: nineteen flags, each a column condition, in the order they are shown in.

An offer is a row of title, description, enriched (whether its own page was read), year, km, diff_pct (percent under the
median of what it compares with), suspicious (the score's guard), price_partial, repost_of, belt (the model has a timing belt),
seller_type, dealer_inferred, seller_count, stated_price (a total in the description that the price isn't), stated_year,
stated_km, the claims of the description single_owner, service_history, timing_belt_changed, damage_mentioned, commercial_use,
vtv_current (null: nothing said), and pairs (kinds of its shown duplicates). Flags that need a description come only where one
is known; a null field raises no flag but where its absence is the flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import plain
from ..functions.vehicle import damaged

#: The flags in the order they are shown in.
ORDER = (
    "duplicate_photos", "much_cheaper", "partial_price_suspect", "private_many_listings", "cross_source_duplicate", "no_owners", "service_unavailable", "no_service", "timing_pending", "no_timing_belt",
    "short_description", "damage_mentioned", "commercial_use", "vtv_pending", "low_km_for_age", "repost", "price_mismatch", "year_mismatch", "km_mismatch",
)
#: Words that say who owned the car, that it was serviced, and that its belt was seen to; and bounds.
OWNERS = r"\b(duen[oa]s?|titular(es)?|unico dueno|primer dueno|1 dueno|(unica|primera|segunda) mano)\b"
SERVICE = r"\b(services?|servicios? oficial\w*|mantenimiento|service oficial)\b"
BELT = r"\b(distribucion|correa|kit de distribucion)\b"
MUCH, VERIFY, DOWN_PAYMENT = 25, 35, 50
LEAST_KM_A_YEAR, LEAST_CHARS = 5000, 150
KM_APART, KM_SHARE = 5000, 0.10


def cheaper_text(diff_pct: Column) -> Column:
    """Which text the flag carries, by the percentage as it is shown; null under the bound."""
    shown = F.bround(diff_pct, 0)
    return F.when(diff_pct >= MUCH, F.when(shown >= DOWN_PAYMENT, "much_cheaper_anticipo").when(shown >= VERIFY, "much_cheaper_verify").otherwise("much_cheaper"))


def said(description: Column) -> Column:
    """What the flags read of a description. Where many offers share one, it can be worked out for each text before a join."""
    text = plain(F.coalesce(description, F.lit("")))
    some = F.coalesce(F.length(description), F.lit(0)) > 0
    return F.struct(some.alias("some"), text.rlike(OWNERS).alias("owners"), text.rlike(SERVICE).alias("service"), text.rlike(BELT).alias("belt"), (F.length(text) < LEAST_CHARS).alias("short"))


def flags(o: Callable[[str], Column], this_year: Column, text: Column | None = None) -> dict[str, Column]:
    """Each flag's condition, never null, by name; `text` is what was said, if it is known already."""
    text = said(o("description")) if text is None else text
    known = text["some"] | F.coalesce(o("enriched"), F.lit(False))
    says = lambda c, value: o(c).eqNullSafe(F.lit(value))
    has = lambda kind: F.coalesce(F.array_contains(o("pairs"), kind), F.lit(False))
    told = known & says("damage_mentioned", True)
    titled = ~told & damaged(F.coalesce(o("title"), F.lit("")))
    age = F.when(o("year") != 0, F.greatest(this_year - o("year"), F.lit(1)))
    apart = F.abs(o("km") - o("stated_km")) > F.greatest(F.lit(float(KM_APART)), KM_SHARE * F.greatest(o("km"), o("stated_km")))
    found = {
        "much_cheaper": o("diff_pct") >= MUCH,
        "duplicate_photos": has("duplicate_photos"),
        "partial_price_suspect": F.coalesce(o("suspicious"), F.lit(False)) | F.coalesce(o("price_partial"), F.lit(False)),
        "private_many_listings": (o("seller_type") == "private") & o("dealer_inferred") & o("seller_count").isNotNull(),
        "cross_source_duplicate": has("cross_source_photos") | has("cross_source_data"),
        "no_owners": known & ~says("single_owner", True) & ~text["owners"],
        "service_unavailable": known & says("service_history", False),
        "no_service": known & o("service_history").isNull() & ~text["service"],
        "timing_pending": known & says("timing_belt_changed", False),
        "no_timing_belt": known & o("belt") & o("timing_belt_changed").isNull() & ~text["belt"],
        "short_description": known & text["short"],
        "damage_mentioned": told | titled,
        "commercial_use": known & says("commercial_use", True),
        "vtv_pending": titled & says("vtv_current", False),
        "low_km_for_age": o("km") / age < LEAST_KM_A_YEAR,
        "repost": o("repost_of").isNotNull() & (o("repost_of") != 0),
        "price_mismatch": F.coalesce(o("stated_price"), F.lit(0.0)) != 0,
        "year_mismatch": (o("year") != 0) & (o("stated_year") != 0) & (o("year") != o("stated_year")),
        "km_mismatch": (o("km") != 0) & (o("stated_km") != 0) & apart,
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in found.items()}


def ordered(o: Callable[[str], Column], this_year: Column, text: Column | None = None) -> Column:
    """The names of an offer's flags in the order they are shown in, as an array."""
    found = flags(o, this_year, text)
    return F.filter(F.array(*[F.when(found[k], k) for k in ORDER]), lambda x: x.isNotNull())
