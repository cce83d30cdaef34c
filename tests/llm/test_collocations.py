"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from lotlens.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, least, top=2000, longest=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    often = {k: a for k, a in counts.items() if a >= least}
    dropped = set()
    for (lang, p), f in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * f >= 100 * often.get((lang, p[i : i + m]), f + 1):
                    dropped.add((lang, p[i : i + m]))
    out = []
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in dropped:
            cuts = [(1000 * a * totals[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]], totals[lang]))
    out.sort()
    found, rank = [], Counter()
    for lang, score, a, p, left, right, n in out:
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], p.decode(), -a, left, right, n, -score))
    return found


def table(spark, rows):
    return spark.createDataFrame([(t, g, 1, "x", b"y") for t, g in rows], "text string, lang string, a int, phrase string, block binary")


def mined(df, **how):
    return sorted(map(tuple, collocations.mine(df, **how).collect()))


def random_rows(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cc", "É", "dd'", "日本", "e-f", "\x00", "g h"][:words] + [f"w{k}" for k in range(words - 9)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t", "  "]) for _ in range(rng.randint(0, 40))]
        rows.append((" ".join(parts), rng.choice(["en", "de", None, "", "und"])))
    return rows


def test_random_texts(spark, monkeypatch):
    rows = random_rows(1, 300) + [(None, "en"), ("", None), ("one two three four five six seven. " * 30, "en"), ("same same same same same same " * 20, "fr")]
    df = table(spark, rows).repartition(6)
    assert mined(df, least=5) == naive(rows, 5)
    monkeypatch.setattr(collocations, "BLOCK_CHARS", 50)
    assert mined(df, least=3, top=7) == naive(rows, 3, 7)
    assert mined(df, least=4, longest=4, top=None, limit=0) == naive(rows, 4, 10**9, 4)


def test_long_and_repeated_texts(spark):
    rows = [("the quick brown fox jumps over the lazy dog, " * 4000, "en")] + [("to be or not to be", "en")] * 500
    assert mined(table(spark, rows)) == naive(rows, 100)


def test_files_of_the_state_have_few_blocks(spark, monkeypatch):
    """A block's row is some MB, and readers hold a row group's rows by the thousand."""
    most = []
    monkeypatch.setattr(collocations, "BLOCK_CHARS", 50)
    monkeypatch.setattr(collocations, "remove", lambda spark, folder: most.extend(pq.read_metadata(f).num_rows for f in Path(folder.removeprefix("file:")).glob("*.parquet")))
    rows = [(" ".join(["one two three four"] * 5), "en")] * 60
    assert mined(table(spark, rows).coalesce(1), least=5) == naive(rows, 5)
    assert len(most) > 8 and max(most) <= 8


def test_no_texts(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(None, None), ("rare words only", "en")])) == []


def test_counts_past_64_bits():
    """The products are decimals of 38 digits: the largest that the casts let through fit in them."""
    assert 1000 * 10**17 * 10**17 < 10**38 and 10**19 * 10**19 <= 10**38


def test_lists_are_extended_by_merging():
    post = np.array([0, 1, 0, 1, 2, -1, 0, 1], np.int32)
    codes, sizes, places = collocations.lists_of(post[post >= 0], np.flatnonzero(post >= 0))
    assert codes.tolist() == [0, 1, 2] and sizes.tolist() == [3, 3, 1] and places.tolist() == [0, 2, 6, 1, 3, 7, 4]
    head, word, lengths, found = collocations.extended(post, sizes, places, 1)
    assert list(zip(head.tolist(), word.tolist(), lengths.tolist(), strict=True)) == [(0, 1, 3), (1, 0, 1), (1, 2, 1)] and found.tolist() == [0, 2, 6, 1, 3]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, collocations.op11_collocations(spark, "/root/testdata/sf0.01").collect()))
    assert got == naive([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 100)
