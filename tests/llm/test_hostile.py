"""Hostile inputs of op1, masking and op7: long texts in time that grows with them, vectors of every scale and length."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from lotlens.llm import embedding_duplicates, secret_scan

WEB_TOKEN = next(r for r in secret_scan.MORE if r[0] == "web_token")


def test_web_tokens_are_the_patterns():
    rng = random.Random(4)
    parts = ["eyJ", "eyJabcdefgh", ".", ".", "-", "_", "abcdefgh", "x", " ", "\u00e9", "eyJabcdefghij.eyJabcdefghij.abcdefghi"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert list(secret_scan.web_tokens(text)) == [m.span() for m in re.finditer(WEB_TOKEN[2], text, re.A)], text


@pytest.mark.parametrize("text", ["eyJ-" * 250_000, "eyJabcdefgh." * 80_000, "password " * 100_000, "-----BEGIN " + "A " * 400_000, "a" * 1_000_000, "token=abcdef " * 70_000])
def test_long_texts_are_scanned_in_time(text):
    began = time.process_time()
    found = secret_scan.find(text, list(secret_scan.RULES))
    assert time.process_time() - began < 4
    assert len(found) == (70_000 if text.startswith("token") else 1 if text.startswith("aa") else len(re.findall(WEB_TOKEN[2], text, re.A)) if "." in text else 0)


def test_masks_of_many_secrets(spark):
    text = "token=abcdef x\u00e9\n" * 40_000
    docs = spark.createDataFrame([(1, text, None), (2, None, "y"), (3, "plain", "z")], "doc_id long, text string, start string")
    ledger = secret_scan.scan_unseen(docs)
    began = time.time()
    got = {r.doc_id: r.text for r in secret_scan.redacted(docs, ledger).collect()}
    assert time.time() - began < 20 and got == {1: "[secret] x\u00e9\n" * 40_000, 2: None, 3: "plain"}
    assert {r.doc_id: r.text for r in secret_scan.redacted(docs, ledger, limit=0).collect()} == got
    assert secret_scan.masked("abcdefgh", [(1, 3), (2, 4), (4, 5), (6, 6)], "_") == "a__f_gh"


@pytest.mark.parametrize("limit", [0, 1000])
def test_a_known_text_is_not_scanned_again(spark, limit):
    docs = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "other")], "doc_id long, text string")
    ledger = secret_scan.scan_unseen(docs.filter("doc_id < 3"), limit=limit)
    assert [r.rules for r in secret_scan.scan_unseen(docs, ledger, limit=limit).collect()] == [[secret_scan.rule_name(r) for r in secret_scan.RULES]]
    assert secret_scan.scan_unseen(docs.filter("doc_id = 2"), ledger, limit=limit).count() == 0


def test_vectors_of_every_scale_and_length(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6))
    rows = [(k, (v * s).tolist()) for k, (v, s) in enumerate(zip(np.concatenate([base] * 4), np.repeat([1.0, 1e-200, 1e200, 1e-300], 40), strict=True))]
    rows += [(200 + k, v) for k, v in enumerate([[1.0, 2.0], [2.0, 4.0], [-1.0, 2.0], [5e-324, 1e-323], [1.0], [3.0], [-3.0], [], [0.0, 0.0], None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates.links(df, block=16).collect()}
    want = {}
    for dim in {len(v) for _, v in rows if v}:
        ids = [k for k, v in rows if v and len(v) == dim and any(v)]
        m = np.array([v for k, v in rows if k in set(ids)])
        m = m / np.abs(m).max(axis=1, keepdims=True)
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        link = u @ u.T >= 0.9
        label = np.arange(len(u))
        for _ in range(len(u)):
            label = np.where(link, label[None, :], len(u)).min(axis=1)
        want |= {k: (int(link[j].sum()) - 1, ids[label[j]], ids[label[j]] == k) for j, k in enumerate(ids)}
    want |= {k: (0, k, True) for k, _ in rows if k not in want}
    assert got == want
    assert [embedding_duplicates.axes_for(n) for n in (0, 10, 100_000, 1_000_000, 10**12)] == [2, 2, 2, 3, 6]
