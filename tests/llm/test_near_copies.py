"""The pipeline's near-dedup stage against brute force on planted copies of similarity 0.8 to 0.95, and at the edges."""

from __future__ import annotations

import random

import pytest

from tessella.llm import common, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA.replace("lang", "__row")


def grams(text: str | None) -> set:
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def staying(rows: list[tuple]) -> list:
    """Ids that stay, by all pairs."""
    sets, of = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    groups = {}
    for k, r in zip(of, rows):
        groups.setdefault(k, []).append(r[0])
    return sorted((min(g, key=lambda i: (i is None, i or 0)) for g in groups.values()), key=str)


def planted(seed: int) -> list[tuple]:
    """Texts, some of them edited copies, copies of copies, one large group, a line that most share, short and blank ones."""
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    line, out = " ".join(prose(12)), []

    def edited(words: list[str], edits: int) -> list[str]:
        words = list(words)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"e{rng.randrange(10**6)}"
        return words

    for _ in range(60):
        base = prose(rng.randrange(60, 200))
        out.append(base)
        for _ in range(rng.randrange(3)):
            out.append(edited(base, max(1, round(len(base) * rng.uniform(0.004, 0.03)))))
            base = out[-1] if rng.random() < 0.3 else base
    base = prose(150)
    out += [edited(base, 2) for _ in range(80)]
    texts = [" ".join(w).upper() if rng.random() < 0.2 else " ".join(w) + (f" {line}" if rng.random() < 0.7 else "") for w in out]
    texts += [None, "", " \n", "one two", "One  two", "one two three four five", "one two three four five six", line, line + " end"]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, "x", "s", 0) for i, t in zip(ids, texts)]
    return rows + [(None, texts[0], "x", "s", 0), (None, "a text that only a row without an id has", "x", "s", 0), rows[3]]


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_finds_all_pairs(spark, tmp_path, monkeypatch, seed):
    import corpus_pipeline as c

    rows = planted(seed)
    sets = [grams(r[1]) for r in rows]
    prints = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 0.8 <= similarity(sets[i], sets[j]) <= 0.95]
    assert sum(((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() > 3 for i, j in near) > 50  # beyond op2's radius
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    if seed:  # no frequent shingles known: the order alone differs
        monkeypatch.setattr(near_copies, "MOST", 0)
    if seed == 2:  # leaders are met, turn after turn, and texts are picked by a shuffle
        monkeypatch.setattr(near_copies, "MANY", 0)
        monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    out = c.near_dedup(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == staying(rows)


def test_near_dedup_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "t"))
    assert near_copies.without_similar(spark.read.parquet(str(tmp_path / "t"))).collect() == []


def test_long_lists_are_compared_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_copies, "TURNS", 0)
    monkeypatch.setattr(near_copies, "BLOCK", 6)
    monkeypatch.setattr(near_copies, "SAMPLE", 20)
    rows = planted(7)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    out = near_copies.without_similar(spark.read.parquet(str(tmp_path / "t")))
    assert sorted((r.doc_id for r in out.collect()), key=str) == staying(rows)


def test_passages_that_the_sample_misses(spark, tmp_path, monkeypatch):
    """Unlike texts that share a passage are seldom compared, though no shingle of it is known to be frequent."""
    rng, rows = random.Random(5), []
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    for _ in range(5):
        passage = prose(25)
        rows += [(len(rows) + k, f"{prose(40)} {passage} {prose(40)}", "x", "s", 0) for k in range(40)]
    rows += [(1000 + i, f"{t} end", *r) for i, t, *r in rows[:3]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "TURNS", 0)
    made, pairs = [], near_copies._apart_pairs

    def counted(*args):
        out = pairs(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "_apart_pairs", counted)
    out = near_copies.without_similar(spark.read.parquet(str(tmp_path / "t")))
    assert sorted((r.doc_id for r in out.collect()), key=str) == staying(rows)
    assert sum(made) < 10 * len(rows)  # of 3,900 pairs, most of them in several lists


def test_suffix_stage_s_rows(spark, tmp_path):
    """Each row that stays, with its whole text: what is left blank goes, nulls stay null, untouched rows stay as they are."""
    import corpus_pipeline as c

    again = "a passage of more than fifty bytes that stands in several documents. "
    rows = [(1, again + "one", "x", "s", 7), (2, again + "\n\t \x0b", "x", "s", 9), (3, "two " + again + "three", None, "s", None), (4, None, "x", None, None), (5, "", "x", "s", 0), (6, " \n", "x", "s", 2), (7, again + "\x85", "x", "s", 5)]
    out = c.suffix_array_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == [rows[0], (3, "two three", None, "s", 9), rows[3], rows[4], rows[5], (7, "\x85", "x", "s", 1)]


def test_parities_never_rule_out_near_copies():
    """Sets differ in at least as many shingles as their parities in bits, and unlike texts of usual length are ruled out."""
    import numpy as np

    rows = planted(11)
    sets = [near_copies.shingles((r[1] or "").encode()) for r in rows]
    odds = [near_copies.parities(s) for s in sets]
    ruled_out = 0
    for i in range(len(rows)):
        for j in range(i):
            bits = int(np.bitwise_count((odds[i] ^ odds[j]).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(sets[i], sets[j]))
            ruled_out += 9 * bits > len(sets[i]) + len(sets[j])
    assert ruled_out > 0.5 * len(rows) * (len(rows) - 1) / 2
