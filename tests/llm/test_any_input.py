"""Inputs that aren't plain scans, empty tables, and columns whose names the operators use."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import encoding, exact_dedup, fingerprint, near_copies, packing, simhash, suffix_dedup, toxicity
from tessella.llm.common import Cache
from tests.llm.test_llm import WORD, plain_components, plain_simhash, removed

SCHEMA = "doc_id long, text string"


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, prose(rng.randrange(3, 60))) for i in range(120)]
    out += [(200 + i, out[i % 40][1]) for i in range(60)] + [(300 + i, out[i][1] + " " + prose(1)) for i in range(30)]
    return out + [(400, None), (401, ""), (None, "no id"), (402, prose(30_000))]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The same rows as a shuffle, a join and an aggregate give them."""
    path = str(tmp_path_factory.mktemp("any") / "t")
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    ids = docs.select(F.col("doc_id").alias("other")).distinct()
    joined = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("other")), "left").select("doc_id", "text")
    return {"scan": docs, "shuffled": docs.repartition(7), "joined": joined, "grouped": docs.groupBy("doc_id", "text").count().select("doc_id", "text")}


@pytest.mark.parametrize("kind", ["scan", "shuffled", "joined", "grouped"])
def test_nothing_is_lost_off_a_scan(inputs, kind):
    docs = inputs[kind]
    text = {i: t or "" for i, t in rows()}
    kept = [r.doc_id for r in exact_dedup.without_copies(docs).collect()]
    best: dict = {}
    for i, t in text.items():
        best[t.lower()] = max((i is not None, i) for i in (i, best.get(t.lower(), (False, None))[1]))
    assert sorted(map(str, kept)) == sorted(str(i) for _, i in best.values())
    order = list(text)
    of = plain_components([plain_simhash(text[i]) for i in order], 3)
    least = {k: min((order[j] for j in range(len(of)) if of[j] == k and order[j] is not None), default=None) for k in set(of)}
    assert sorted(str(r.doc_id) for r in simhash.without_near_copies(docs).collect()) == sorted(map(str, least.values()))
    want = collections.Counter(removed([(i, t) for i, t in text.items()]))
    assert collections.Counter(map(tuple, suffix_dedup.removal_report(docs).collect())) == want


def test_files_own_row_numbers(inputs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ROWS", 7)
    monkeypatch.setattr(suffix_dedup, "LONG_BYTES", 200)
    want = collections.Counter(removed([(i, t or "") for i, t in rows()]))
    for docs in (inputs["scan"], inputs["shuffled"]):
        assert collections.Counter(map(tuple, suffix_dedup.removal_report(docs, plain_scan=True).collect())) == want


def test_no_character_from_two_sides_of_a_cut(spark):
    """Bytes left and right of what was taken out never join to a character that the text doesn't have."""
    docs = spark.createDataFrame([(1, "é" + "q" * 49 + "ã"), (2, "ĩ" + "q" * 49 + "é zz")], SCHEMA)
    out = suffix_dedup.suffix_dedup(docs, as_text=True)
    assert {r.doc_id: r["__kept"] for r in out.collect()} == {1: "é" + "q" * 49 + "ã", 2: " zz"}
    assert [r.n_removed for r in suffix_dedup.removal_report(docs).orderBy("doc_id").collect()] == [0, 51]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.packed_pieces(none, WORD, 1).collect() == []
    assert simhash.simhash_components(none).collect() == simhash.without_near_copies(none).collect() == []
    assert exact_dedup.exact_dedup(none).collect() == exact_dedup.without_copies(none).collect() == []
    assert suffix_dedup.removal_report(none).collect() == near_copies.without_similar(none).collect() == []
    assert fingerprint.fingerprints(none).collect() == []


def test_names_that_clash(spark, tmp_path):
    import corpus_pipeline as c

    extra = ["score", "_score", "fingerprint", "h1", "variant", "canonical", "c0", "__row", "__kept", "row", "__sd_row"]
    docs = spark.createDataFrame([(i, f"text number {i}", *(f"mine{k}" for k in range(len(extra)))) for i in range(12)], ", ".join([SCHEMA, *(f"{c} string" for c in extra)]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    scored = toxicity.learnt_scores(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert scored.columns == [*docs.columns, "__score"]
    printed = fingerprint.fingerprints(docs)
    assert printed.columns == [*docs.columns, "_fingerprint"] and {r["fingerprint"] for r in printed.collect()} == {"mine2"}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all(r[k] == f"mine{n}" for r in out.collect() for n, k in enumerate(extra)), name


def test_cache_is_bounded():
    cache, most = Cache(40_000), 0
    for k in range(5000):
        cache.turn()
        for w in cache.recall(["often", f"w{k}"]) if "often" not in cache.young else [f"w{k}"]:
            cache.add(w, w, len(w))
        most = max(most, len(cache.young) + len(cache.old))
    assert "often" in cache.young and most * Cache.ENTRY <= 40_000


def test_encoding_with_a_small_cache(monkeypatch):
    """Generations come and go; the ids stay."""
    monkeypatch.setattr(encoding, "WORD_BYTES", 2000)
    monkeypatch.setattr(encoding, "PIECE_BYTES", 2000)
    encoding.kept("another")
    e = encoding.encoder(WORD)
    texts = [t or "" for _, t in rows()] + ["你好 naïve ﬁ " + (t or "")[:50] for _, t in rows()]
    for k in range(0, len(texts), 10):
        assert e.encode(texts[k : k + 10]) == [e.whole(t) for t in texts[k : k + 10]]
    encoding.kept("another")
