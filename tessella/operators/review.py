"""Review sessions: labels of reviewers against the ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strict_join(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles with their labels, one to one by tile_id and at the same display_index; anything else is an error.

    The error is raised when a broken row is read.
    """
    one = lambda df: df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("tile_id")))
    a, b = one(tiles.withColumn("__a", F.lit(True))), one(labels.withColumn("__b", F.lit(True))).withColumnsRenamed({"display_index": "__i", "__n": "__m"})
    both = a.join(b, "tile_id", "full_outer")
    ok = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__n") == 1) & (F.col("__m") == 1) & (F.col("display_index") == F.col("__i"))
    return both.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("tile and label don't match: "), F.col("tile_id").cast("string"))).cast("boolean"))).drop("__a", "__b", "__n", "__m", "__i")


def join_breaks(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Why a strict join would fail: columns tile_id, reason."""
    a = tiles.groupBy("tile_id").agg(F.count(F.lit(1)).alias("na"), F.min("display_index").alias("ia"))
    b = labels.groupBy("tile_id").agg(F.count(F.lit(1)).alias("nb"), F.min("display_index").alias("ib"))
    reason = F.when(F.col("na").isNull(), "label without tile").when(F.col("nb").isNull(), "tile without label").when((F.col("na") > 1) | (F.col("nb") > 1), "not unique").when(F.col("ia") != F.col("ib"), "other display index")
    return a.join(b, "tile_id", "full_outer").select("tile_id", reason.alias("reason")).filter("reason IS NOT NULL")


def review_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of a reviewer's yes against the truth; a missing label counts as no; null on a zero denominator."""
    said, true = F.coalesce("collaborator_label", F.lit(False)), F.col("ground_truth")
    n = lambda c: F.count_if(c)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n(said & true).alias("n_tp"), n(~said & ~true).alias("n_tn"), n(said & ~true).alias("n_fp"), n(~said & true).alias("n_fn"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return counts.withColumns({"accuracy": (F.col("n_tp") + F.col("n_tn")) / F.nullif(F.col("n"), F.lit(0)), "sensitivity": share("n_tp", "n_fn"), "specificity": share("n_tn", "n_fp")})


def confusion_with_missing(df: DataFrame) -> DataFrame:
    """Rows by truth and label, missing labels apart."""
    return df.groupBy("ground_truth", "collaborator_label").agg(F.count(F.lit(1)).alias("n"))


def session_summary(df: DataFrame) -> DataFrame:
    """By size: positives, negatives, labelled ones, and their share."""
    n = F.count(F.lit(1))
    done = F.count("collaborator_label")
    return df.groupBy("tile_size").agg(F.count_if("ground_truth").alias("n_positive"), F.count_if(~F.col("ground_truth")).alias("n_negative"), done.alias("n_labelled"), (done / n).alias("progress"))


def next_unlabelled(df: DataFrame, session: str = "session") -> DataFrame:
    """For each row the display index of the next one without a label, from the start again behind the last; null if all have one."""
    # walked backwards: a frame that begins behind each row would be read again for every row
    order = Window.partitionBy(session).orderBy(F.desc("display_index"))
    open_ = F.when(F.col("collaborator_label").isNull(), F.col("display_index"))
    after = F.last(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.min(open_).over(Window.partitionBy(session))
    return df.withColumn("next_index", F.coalesce(after, start))


def latest_labels(events: DataFrame) -> DataFrame:
    """Of each tile the label that was given last; of equal times the larger."""
    return events.groupBy("tile_id").agg(F.max_by("label", F.struct("labelled_at", "label")).alias("label"), F.max("labelled_at").alias("labelled_at"))
