"""Text, number and date helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms; fixed values.
ACCENTED, PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
#: Words for millions and thousands in prices.
SCALES = (("millones", 1_000_000), ("millon", 1_000_000), ("mil", 1_000))


def plain(c: Column) -> Column:
    """Without marks, in small letters, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), r"\s+", " "))


def number(c: Column) -> Column:
    """A number as people write it: 16.500.000, 11,5 millones, 12 mil; null if there is none.

    Points between groups of three digits are separators, a comma starts the decimals.
    """
    t = plain(c)
    raw = F.regexp_extract(t, r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)", 1)
    value = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".").try_cast("double")
    scale = F.lit(1)
    for word, times in reversed(SCALES):
        scale = F.when(t.rlike(rf"\d\s*{word}\b"), times).otherwise(scale)
    return value * scale


def currency(amount: Column, sign: Column) -> Column:
    """By the sign if it says so, else by size: a million or more is local money."""
    s = plain(sign)
    return F.when(s.rlike(r"u\$s|us\$|usd|dolar"), "USD").when(s.rlike(r"ars|peso"), "ARS").when(amount >= 1_000_000, "ARS").when(amount.isNotNull(), "USD")


def first_of(text: list[Column], kinds: list[tuple[str, str]]) -> Column:
    """The kind that the first text to match any pattern matches; earlier texts win, then earlier kinds."""
    out = []
    for t in text:
        e = F.when(F.lit(False), F.lit(""))
        for name, pattern in kinds:
            e = e.when(plain(t).rlike(pattern), name)
        out.append(e)
    return F.coalesce(*out)


def email(c: Column) -> Column:
    """One spelling of an address: small letters, no +tag, and no points before gmail's @."""
    low = F.lower(F.trim(c))
    user, host = F.regexp_replace(F.split_part(low, F.lit("@"), F.lit(1)), r"\+.*$", ""), F.split_part(low, F.lit("@"), F.lit(2))
    mail = host.isin("gmail.com", "googlemail.com")
    return F.concat(F.when(mail, F.regexp_replace(user, r"\.", "")).otherwise(user), F.lit("@"), F.when(mail, F.lit("gmail.com")).otherwise(host))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(plain(a), " ")), F.array_distinct(F.split(plain(b), " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def add_business_days(day: Column, n: Column) -> Column:
    """The n-th weekday after a day: whole weeks by arithmetic, no list of days."""
    since = (F.weekday(day)).cast("int")  # Monday 0
    start = F.when(since > 4, F.date_sub(day, since - 4)).otherwise(day)
    left = F.least(since, F.lit(4)) + n % 5
    return F.date_add(start, (F.floor(n / 5) * 7 + n % 5 + F.when(left > 4, 2).otherwise(0)).cast("int"))


def placeholder_price(c: Column) -> Column:
    """A digit repeated four times and more. Spelled out, as not every engine's patterns can refer back."""
    return F.floor(c).cast("string").rlike("^(" + "|".join(f"{d}{{4,}}" for d in range(1, 9)) + ")$")


def path_words(url: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]*|[?#].*$", ""), r"[/_\-.]+", " "))
