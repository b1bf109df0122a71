"""The queries with 2000 replicates and 512 orders against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np

import __spark_entry__ as entry
from tessella.plans import registry
from tessella.plans import views as V

SF = "/root/testdata/sf0.001"


def test_display_order(spark):
    rows = registry.of(spark, SF, registry.SHOWN).collect()
    sessions, want = defaultdict(list), {}
    for r in rows:
        sessions[r.session].append(r)
    for session, shown in sessions.items():
        best = None
        for t in range(512):
            order = sorted(shown, key=lambda r: (hashlib.md5(f"{t}:{r.tile_id}".encode()).hexdigest(), r.tile_id))
            n = sum(a.tile_size == b.tile_size or a.label == b.label for a, b in zip(order, order[1:]))
            if best is None or n < best[0]:
                best = (n, order)
        want |= {(session, r.tile_id): (k, best[0]) for k, r in enumerate(best[1], 1)}
    got = entry.queries()["display_order_512"](spark, SF).collect()
    assert len(got) == len(rows) and {(r.session, r.tile_id): (r.position, r.conflicts) for r in got} == want


def test_bootstrap(spark):
    rows = registry.of(spark, SF, V.PRED).filter("split = 'test' AND prob IS NOT NULL").select("specimen", "prob", "y").collect()
    units = sorted({r.specimen for r in rows})
    at = np.array([units.index(r.specimen) for r in rows])
    prob, y = np.array([r.prob for r in rows]), np.array([r.y for r in rows])
    by = np.argsort(-prob, kind="stable")
    at, prob, y = at[by], prob[by], y[by]
    end = np.append(np.flatnonzero(np.diff(prob)), len(prob) - 1)
    found = []
    for rep in range(2000):
        drawn = [int(hashlib.md5(f"7:{rep}:{k}".encode()).hexdigest()[:8], 16) % len(units) for k in range(len(units))]
        w = np.bincount(drawn, minlength=len(units))[at]
        p, n = (w * (y == 1)).sum(), (w * (y == 0)).sum()
        if p and n:
            tp, fp = np.cumsum(w * (y == 1))[end], np.cumsum(w * (y == 0))[end]
            seen = tp + fp > 0
            ap = (np.diff(tp, prepend=0)[seen] / p * tp[seen] / (tp + fp)[seen]).sum()
            hit = (w * ((y == 1) & (prob >= 0.4))).sum()
            found.append((ap, 2 * hit / (p + (w * (prob >= 0.4)).sum()), hit / p))
    low, high = np.percentile(np.array(found), [2.5, 97.5], axis=0)
    got = {r.metric: r for r in entry.queries()["bootstrap_ci_2000"](spark, SF).collect()}
    for k, m in enumerate(("average_precision", "f1", "recall")):
        assert got[m].n_usable == len(found) and abs(got[m].low - low[k]) < 2e-6 and abs(got[m].high - high[k]) < 2e-6
