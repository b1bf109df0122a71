"""Phrases against plain counting and, on a table, against the SQL."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from tessella.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, least, longest=5, top=2000, percent=100):
    counts, total = collections.Counter(), collections.Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {k: n for k, n in counts.items() if n >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or any(100 * n >= percent * a and of == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (of, q), n in f.items()):
            continue
        score, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def some_rows(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["The", "ÉTÉ", "naïve", "été", "\x00", "\x1c", "x\x85y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ",x", "\x0b"]) for w in rng.choices(words, weights, k=rng.randrange(80)))
        rows.append((i, rng.choice(["en", "en", "de", None]), text if rng.random() < 0.9 else "all rights reserved by the owner of this"))
    return [*rows, (1000, "fr", None), (1001, "fr", ""), (None, "en", "no id w0 w1"), *[(5, "en", "w0 w1 w2 w3 w4 w5 w6")] * 20]


@pytest.mark.parametrize("least, share", [(10, 1 << 20), (10, 40), (25, 300)])
def test_collocations(spark, monkeypatch, least, share):
    """Small shares make hot leading phrases of every length."""
    monkeypatch.setattr(C, "SHARE", share)
    monkeypatch.setattr(C, "FLUSH_WINDOWS", 500)
    rows = some_rows(least)
    docs = spark.createDataFrame([(*r, "mine") for r in rows], f"{SCHEMA}, words string").repartition(3)
    got = {tuple(r) for r in C.collocations(docs, least).collect()}
    assert got == plain(rows, least) and len(got) > 5


def test_more_frequent_words_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_WORDS", 3)
    rows = some_rows(4)
    assert {tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), 12, top=7).collect()} == plain(rows, 12, top=7)


def test_lower_percent(spark):
    rows = some_rows(5)
    assert {tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), 8, percent=60).collect()} == plain(rows, 8, percent=60)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as of a very large corpus: scores stay exact."""
    words, phrases = C.phrase_counts(spark.createDataFrame(some_rows(1), SCHEMA), 10)
    big = 3_000_000_017
    monkeypatch.setattr(C, "phrase_counts", lambda *a: (words.withColumn("n", words.n * big), phrases.withColumn("n", phrases.n * big)))
    got = {tuple(r) for r in C.collocations(spark.createDataFrame([], SCHEMA)).collect()}
    assert got == {(lang, k, p, a * big, l * big, r * big, n * big, 1000 * a * n // (l * r)) for lang, k, p, a, l, r, n, _ in plain(some_rows(1), 10)}


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_sql(spark):
    rows = some_rows(6)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, SCHEMA).toPandas().astype({"lang": object, "text": object}).where(lambda d: d.notna(), None))
    want = {tuple(x) for x in con.execute(C.ORACLE.replace(">= 100", ">= 10")).fetchall()}
    assert {tuple(r) for r in C.collocations(spark.createDataFrame(rows, SCHEMA), 10).collect()} == {(r[0], *map(lambda x: x if isinstance(x, str) else int(x), r[1:])) for r in want}


@pytest.mark.parametrize("seed", range(4))
def test_multikey_quicksort(seed):
    rng = np.random.default_rng(seed)
    columns = [rng.integers(1, 5, 400) for _ in range(4)]
    columns[3][::7] = 0
    weight = rng.integers(1, 4, 400)
    want: collections.Counter = collections.Counter()
    for i in range(400):
        for d in range(2, 5):
            key = tuple(int(c[i]) for c in columns[:d])
            if 0 not in key:
                want[key] += int(weight[i])
    assert dict(C.multikey_quicksort(columns, weight, 9)) == {k: n for k, n in want.items() if n >= 9}
