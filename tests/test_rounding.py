"""Numbers are rounded as the SQL rounds them, at ties and around zero."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from tessella.operators.reports import decimals
from tessella.plans.registry import rounded


def test_decimals_at_ties(spark):
    values = [k / 2000 for k in range(-41, 400)] + [k / 20 for k in range(1, 400)] + [0.0, 1e12, 123456.7895, 2.5, 0.125, 0.375]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", decimals("v", 3).alias("a"), decimals(F.col("v"), 1).alias("b"), decimals("v", 2).alias("c")).collect()
    assert [r for r in got if (r.a, r.b, r.c) != (f"{r.v:.3f}", f"{r.v:.1f}", f"{r.v:.2f}")] == []


def test_zero_keeps_its_sign(spark):
    values = [-3e-7, 3e-7, -0.0, 0.0, -6e-7, 1.25, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 6)).collect()]
    assert [math.copysign(1, v) for v in got[:4]] == [-1, 1, -1, 1] and got[4:] == [-1e-6, 1.25, None]


@pytest.mark.parametrize("name", ["fold_table", "interval_table", "pool_mean", "pool_max"])
def test_same_as_sql_on_many_rows(spark, tmp_path, name):
    """120 slides a fold, means and least values at ties, and pooled numbers that round to either zero."""
    c, r = duckdb.connect(), random.Random(7)
    c.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i % 480 AS user_id, CASE WHEN i % 7 < 2 THEN 'purchase' ELSE 'view' END AS event_type, round((i * 7919 % 2000) / 8.0, 2)::DOUBLE AS value, '{}' AS props FROM range(2000) t(i)")
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [(i, [(-1) ** k * 2e-7 if (i + k) % 5 else r.uniform(-1, 1) for k in range(64)] if i % 2 else [-1e-7] * 64) for i in range(40)])
    for t in ("events", "embeddings"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    found = e.queries()[name](spark, str(tmp_path))
    expected = c.execute(f"SELECT {', '.join(found.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
