"""Embeddings of tiles as arrays of sub-vectors, their pooling, checks and heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sub_vectors(vector: Column, parts: int, dim: int) -> Column:
    """A flat vector as ``parts`` vectors of ``dim`` numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(vector, i * dim + 1, F.lit(dim)))


def pooled(sub: Column, dim: int, how: str = "mean") -> Column:
    """The mean or maximum over sub-vectors, number by number."""
    at = lambda i: F.transform(sub, lambda v: F.element_at(v, i).cast("double"))
    if how == "mean":
        one = lambda i: F.aggregate(at(i), F.lit(0.0), lambda s, v: s + v) / F.size(sub)
    elif how == "max":
        one = lambda i: F.array_max(at(i))
    else:
        raise ValueError("pooling is mean or max")
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), one)


def not_covered(frame: DataFrame, cache: DataFrame) -> DataFrame:
    """Tiles without an embedding, or with one under another path: columns tile_id, reason."""
    both = frame.select("tile_id", "png_path").join(cache.select("tile_id", F.col("png_path").alias("__p")), "tile_id", "left")
    return both.select("tile_id", F.when(F.col("__p").isNull(), "missing").when(F.col("__p") != F.col("png_path"), "other path").alias("reason")).filter("reason IS NOT NULL")


def deviation(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Largest absolute difference of two tables' vectors, and its size relative to the mean magnitude."""
    both = a.select(key, F.col(vector).alias("__a")).join(b.select(key, F.col(vector).alias("__b")), key)
    values = both.select(F.inline(F.arrays_zip(F.col("__a").alias("u"), F.col("__b").alias("v"))))
    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    out = values.agg(F.max(F.abs(u - v)).alias("max_abs"), F.avg(F.abs(u)).alias("magnitude"))
    return out.select("max_abs", "magnitude", (F.col("max_abs") / F.nullif(F.col("magnitude"), F.lit(0.0))).alias("relative"))


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows there are and a checksum that doesn't depend on their order."""
    line = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(line), F.lit(0)).alias("checksum"))


def fit_head(train: DataFrame, vector: str, label: str, seed: int = 42):
    """A logistic head over pooled vectors (pyspark.ml), fitted on all rows by Spark."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=50, regParam=0.01).fit(rows)


def head_scores(df: DataFrame, model, vector: str) -> DataFrame:
    """``df`` with ``prob`` by a fitted head."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
