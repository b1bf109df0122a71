"""Deterministic views of the tile data model over the given tables; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CUT = "SELECT concat('P', p_partkey, '_cut000') AS cut_name, CAST(p_size * 40 + 200 AS BIGINT) AS width, CAST((p_partkey % 37) * 30 + 200 AS BIGINT) AS height FROM {part}"
POINT = """SELECT c.cut_name, concat(l_orderkey, '-', l_linenumber) AS id, CAST((l_orderkey * 7919 + l_linenumber * 104729) % c.width AS BIGINT) AS cx,
 CAST((l_orderkey * 104729 + l_linenumber * 7919) % c.height AS BIGINT) AS cy, l_linenumber % 5 AS stage, CAST(l_quantity AS BIGINT) AS half
 FROM {lineitem} JOIN (SELECT p_partkey, CAST(p_size * 40 + 200 AS BIGINT) AS width, CAST((p_partkey % 37) * 30 + 200 AS BIGINT) AS height, concat('P', p_partkey, '_cut000') AS cut_name FROM {part}) c ON l_partkey = c.p_partkey"""
RECT = f"SELECT cut_name, id, stage, cx - half AS x0, cy - half AS y0, cx + half AS x1, cy + half AS y1 FROM ({POINT}) p"
STEM = """SELECT concat(upper(substr(r_name, 1, 3)), '_', CASE s_suppkey % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'SU' WHEN 2 THEN 'AU' ELSE 'WI' END, '_', n_nationkey, '_', s_suppkey, '-', s_suppkey + s_suppkey % 7) AS stem,
 s_suppkey, s_acctbal FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
PRED = """SELECT event_id AS tile_id, concat('SP_', user_id) AS specimen, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, CAST(value AS DOUBLE) / 500 AS prob, user_id % 4 AS fold FROM {events}"""
REVIEW = """SELECT doc_id AS tile_id, quality = 1 AS ground_truth, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE toxic = 0 END AS collaborator_label,
 CASE doc_id % 4 WHEN 0 THEN 128 WHEN 1 THEN 256 WHEN 2 THEN 512 ELSE 1024 END AS tile_size, (doc_id * 7919) % 1000003 AS display_index FROM {labels}"""
META = """SELECT r_name AS site, CASE quarter(o_orderdate) WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' WHEN 3 THEN 'Autumn' ELSE 'Winter' END AS season, CAST(o_custkey % 20 AS BIGINT) AS polyp,
 CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS flag, concat(o_orderkey, '.img') AS image, CAST(o_orderdate AS DATE) AS day
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

TABLES = ("part", "lineitem", "supplier", "nation", "region", "events", "labels", "orders", "customer", "embeddings")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's text over the Parquet tables of a folder; nothing is registered."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(text: str) -> str:
    """The same text for DuckDB, whose views have the tables' names, and whose counts of a condition have to be 64 bits wide."""
    while (at := text.find("count_if(")) >= 0:
        begin = end = at + len("count_if(")
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(CASE WHEN {text[begin : end - 1]} THEN 1 END){text[end:]}"
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
