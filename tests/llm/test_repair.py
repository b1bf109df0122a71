"""Conversation repair against a plain search that keeps the least list of edits of each state."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tessella.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows after damage, by conversation."""
    out: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        d = zlib.crc32(key.encode()) % 20
        if d == 1:
            text = ""
        elif d == 2:
            text = re.sub("[.!?]", "", text)
        elif d == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(d, 1))
    return out


def search(codes):
    """Cost and least initials of the cheapest edits; codes are (initial, forced, truncated)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        waiting = list(best)
        while waiting:
            q = waiting.pop()
            cost, edits = best[q]
            new = (cost + 2, edits + "I")
            if after[q] not in best or new < best[after[q]]:
                best[after[q]] = new
                waiting.append(after[q])
        return best

    best = with_inserts({"": (0, "")})
    for initial, forced, truncated in codes:
        new: dict = {}

        def offer(q, cost, edits):
            if q not in new or (cost, edits) < new[q]:
                new[q] = (cost, edits)

        for q, (cost, edits) in best.items():
            offer(q, cost + 3, edits + "D")
            if not forced:
                if initial == after[q] or q == "" and initial == "s":
                    offer(initial, cost + truncated, edits + "K")
                offer(after[q], cost + 2 + truncated, edits + "R")
        best = with_inserts(new)
    return min(best[q] for q in ("", "a") if q in best)


def expected(conv_rows):
    rows = sorted(conv_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, codes, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        left = text.strip(SPACE)
        kind = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "duplicate"), truncated + (kind == "truncated")
        codes.append((role[:1], kind in ("blank", "duplicate"), int(kind == "truncated")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, edits = search(codes)
    out, q, left = [], "", iter(rows)
    for e in edits:
        role, text = ("", "") if e == "I" else next(left)[1:]
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if q == "u" else "user"
        q = role[0]
        out.append(f"{role}:{text}")
    return gaps, blank, duplicate, truncated, illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        n = rng.choice([1, 2, 3, 8, 90, 400]) if rng.random() < 0.5 else rng.randrange(1, 12)
        for turn in range(n):
            role = rng.choices([["system", "user", "assistant"][0 if not turn else 1 + (turn + 1) % 2], "user", "assistant", "system", "tool", "", None], [20, 3, 3, 1, 1, 0.3, 0.3])[0]
            text = rng.choices([f"text {turn}.", "same.", "no end", "", None, "\t\n ", "what? \n", "é…", "x" * 3000], [20, 2, 2, 1, 1, 1, 2, 1, 0.1])[0]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1000]) if n < 50 else turn, role, text))
    for turn in range(300):  # never converges: two ways stay apart
        rows.append((500, turn, "tool", f"t {turn}."))
        rows.append((501, turn, "user", "same."))
    rows += [(600, None, "user", "only."), (601, 3, None, None)]
    # turns are told apart by their order alone
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("chunk", [3, 16, 1024])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "ROWS", chunk)
    rows = some_rows(chunk)
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, "mine") for r in rows], f"{SCHEMA}, chunk string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in R.repair_report(R.damaged(docs), present_col="present").collect()}
    after = damage(rows)
    assert set(got) == {r[0] for r in rows}
    assert {c: got[c] for c in got if got[c] != expected(after[c])} == {}


def test_undamaged_rows_and_an_empty_table(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "system", "s."), (3, 0, "user", "q"), (3, 1, "user", "q")]
    got = {r.conv_id: (r.cost, r.audit) for r in R.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, "KK"), 2: (3, "D"), 3: (6, "DD")}
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(none).collect() == [] and R.repair_report(R.damaged(none), present_col="present").collect() == []


def test_repeated_rows_of_one_turn_are_duplicates(spark):
    """A third of all rows may be copies of one row; they are dealt to many chunks."""
    rows = [(7, 5, "user", "again.")] * 3000 + [(7, 6, "assistant", "yes.")]
    r = R.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(4)).first()
    assert (r.duplicate, r.cost, r.audit) == (2999, 3 * 2999, "K" + "D" * 2999 + "K")


@pytest.mark.parametrize("seed", range(3))
def test_runs_that_meet(seed):
    """From any vector, running beside the speculative run gives what running alone gives, up to a constant."""
    rng = random.Random(seed)
    codes = bytes(rng.choice([R.USER, R.ASSISTANT, R.SYSTEM, R.OTHER, R.USER | R.FORCED, R.USER | R.TRUNCATED]) for _ in range(rng.randrange(60)))
    for _ in range(30):
        used, right = (R._closed([rng.randrange(6) for _ in range(4)]) for _ in range(2))
        new = R.fixed(codes, used, right)
        assert (R.backward(codes, used) if new is None else new) == R.backward(codes, right)
