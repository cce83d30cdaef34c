"""License scan with a positional index of rare words.

Templates are short licence notices. A first pass counts in how many documents each template word occurs; the index
has, for each template, the postings (word, place in the template) of its words of highest IDF. A second pass looks up
the index words of each document, subtracts the template place from the document place, and takes (template, offset)
pairs on which enough postings agree; each is accepted only if the template's mandatory phrases stand at their places.

All of it is DataFrame functions on one row at a time: no shuffle but the count of the words, and a document's postings
are sorted, not paired, so a file of nothing but notices costs n log n. The counts brought to the driver are bounded by
the words of the templates.

Cases: null is the empty text; an empty table gives an empty result; repeated rows and further columns don't matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, notice, mandatory phrases of it); fixed values from the licences' own notices.
TEMPLATES = (
    ("mit-notice", "released under the MIT License", ("mit license",)),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-later", "either version 3 of the License, or (at your option) any later version", ("at your option", "any later version")),
    ("agpl-3.0", "GNU Affero General Public License version 3", ("gnu affero general public license",)),
    ("lgpl", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
)
RARE = 4  # postings of a template: its so many rarest words


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(f"({WORD})"), F.lit(1))


def split(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES) -> tuple[int, dict[str, int]]:
    """(documents, in how many each template word occurs), over all rows."""
    vocabulary = sorted({w for _, notice, _ in templates for w in split(notice)})
    found = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col(text)), strings(vocabulary)), F.lit(""))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def rare_index(frequencies: dict[str, int], templates: tuple = TEMPLATES, rare: int = RARE) -> list[tuple[str, int, int]]:
    """Postings (word, template, place) of each template's words of highest IDF; of equal ones the first by name."""
    out = []
    for t, (_, notice, _) in enumerate(templates):
        words = split(notice)
        chosen = sorted(set(words), key=lambda w: (frequencies.get(w, 0), w))[:rare]
        out += [(w, t, p) for p, w in enumerate(words) if w in chosen]
    return out


def find(docs: DataFrame, postings: list[tuple[str, int, int]], text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """docs plus __words, and __found: accepted (template, offset, share of its words in place), by template and offset."""
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in postings])
    words = F.col("__words")
    named = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.filter(named, lambda x: F.array_contains(strings(sorted({w for w, _, _ in postings})), x["w"]))
    placed = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(index, lambda p: p["w"] == h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"), p["p"].alias("p")))))
    bodies = [split(n) for _, n, _ in templates]
    sizes = F.array(*[F.lit(len(b)) for b in bodies])
    needs = F.array(*[F.lit(max(1, min(sum(t == k for _, t, _ in postings), RARE) - (len(set(b)) > RARE))) for k, b in enumerate(bodies)])
    sorted_hits = F.col("__placed")

    def agreed(x: Column, i: Column) -> Column:
        """The first of a run of as many postings as the template needs."""
        last = F.get(sorted_hits, i + F.get(needs, x["t"]) - 1)
        before = F.get(sorted_hits, i - 1)
        starts = ~F.coalesce((before["t"] == x["t"]) & (before["o"] == x["o"]), F.lit(False))
        return starts & F.coalesce((last["t"] == x["t"]) & (last["o"] == x["o"]), F.lit(False))

    def stands(k: int, offset: Column) -> Column:
        checks = []
        for phrase in templates[k][2]:
            want = split(phrase)
            at = next(p for p in range(len(bodies[k])) if bodies[k][p : p + len(want)] == want)
            checks += [F.coalesce(F.get(words, offset + at + j) == w, F.lit(False)) for j, w in enumerate(want)]
        return reduce(lambda a, b: a & b, checks)

    def verified(x: Column) -> Column:
        return reduce(lambda a, k: a.when(x["t"] == k, stands(k, x["o"])), range(len(templates)), F.when(F.lit(False), F.lit(False)))

    def in_place(x: Column) -> Column:
        body = F.get(F.array(*map(strings, bodies)), x["t"])
        return F.size(F.filter(F.transform(body, lambda w, j: F.get(words, x["o"] + j).eqNullSafe(w)), lambda b: b)) / F.get(sizes, x["t"])

    some = F.arrays_overlap(words, strings(sorted({w for w, _, _ in postings})))
    return (
        docs.withColumn("__words", words_of(F.col(text)))
        .withColumn("__placed", F.when(some, F.array_sort(placed)))
        .withColumn("__agreed", F.when(F.size("__placed") > 0, F.filter(F.filter("__placed", agreed), verified)))
        .withColumn("__found", F.when(F.size("__agreed") > 0, F.transform("__agreed", lambda x: F.struct(x["t"].alias("template"), x["o"].alias("offset"), in_place(x).alias("share")))))
    )


def base_places(words: Column) -> Column:
    """(start, label) of each place where a base phrase stands, by start; null where the texts have none."""
    at = F.sequence(F.lit(0), F.size(words) - 1)

    def label(i: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for phrase, name in BASE:
            out = out.when(reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + j) == w, F.lit(False)) for j, w in enumerate(phrase.split())]), F.lit(name))
        return out

    found = F.filter(F.transform(at, lambda i: F.struct(i.alias("start"), label(i).alias("label"))), lambda x: x["label"].isNotNull())
    return F.when(F.array_contains(words, "license"), found)


def scan(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """docs plus n_words, base (start, label), and notices (label, start, share)."""
    postings = rare_index(document_frequencies(docs, text, templates)[1], templates)
    labels = strings([t[0] for t in templates])
    found = find(docs, postings, text, templates)
    notices = F.transform("__found", lambda x: F.struct(F.get(labels, x["template"]).alias("label"), x["offset"].alias("start"), x["share"].alias("share")))
    return found.withColumns({"n_words": F.size("__words").cast("long"), "base": base_places(F.col("__words")), "notices": notices}).drop("__words", "__placed", "__agreed", "__found")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    base = F.coalesce(F.transform("base", lambda x: x["label"]), F.array().cast("array<string>"))
    more = F.coalesce(F.transform("notices", lambda x: x["label"]), F.array().cast("array<string>"))
    spell = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    shares = F.array_max(F.transform("notices", lambda x: x["share"]))
    return found.select(
        "doc_id", "n_words",
        F.when(F.col("base").isNull(), F.lit(0)).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        spell(base).alias("base_labels"), spell(F.concat(base, more)).alias("labels"),
        F.coalesce(shares, F.when(F.size("base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )
