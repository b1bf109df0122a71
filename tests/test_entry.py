"""Queries give the rows of their SQL, and the flagship runs."""

from __future__ import annotations

import collections

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tile_grid", "point_in_tile", "rect_coverage_fraction", "ranking_scores", "best_f1_threshold", "specimen_counts", "site_rollup", "next_unlabelled", "pool_mean", "fold_splits", "cross_validation", "fold_assignment", "run_identities", "recorded_list_conflicts", "lossy_outlines", "measured_outlines", "suppressed_boxes"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "events", "orders", "customer", "nation", "region", "supplier", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    plain = lambda x: tuple(map(plain, x)) if hasattr(x, "__len__") and not isinstance(x, str) else None if x is None or x is pd.NA or x != x else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x
    rows = lambda df: collections.Counter(tuple(map(plain, r)) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
