"""Scores of binary predictions as aggregations over ties of the probability.

Rows are first summed up by (group, probability): what a window then walks
through is at most one row for each distinct value.  NaN counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.unit_bootstrap import unit_scores


def _clean(df: DataFrame) -> DataFrame:
    p = F.col("prob")
    return df.withColumn("prob", F.when(~F.isnan(p), p))


def tie_groups(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Columns by, prob, tp, fp: weighted positives and negatives of each distinct probability."""
    w = F.lit(1) if weight is None else weight
    return _clean(df).filter("prob IS NOT NULL").groupBy(*by, "prob").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("fp"))


def running(ties: DataFrame, by: list[str]) -> DataFrame:
    """``ties`` with cum_tp and cum_fp from the highest probability down, and totals p and n.

    Groups are walked side by side.  Without a group column, probabilities are
    cut into 256 bands first, whose totals are summed apart, so that no single
    task walks all of them.
    """
    ties = ties.withColumn("__band", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prob"))) * 255).cast("int"))
    bands = ties.groupBy(*by, "__band").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    above = Window.partitionBy(*by).orderBy(F.desc("__band"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*by)
    zero = F.lit(0)
    bands = bands.select(
        *by, "__band", F.coalesce(F.sum("btp").over(before), zero).alias("tp0"), F.coalesce(F.sum("bfp").over(before), zero).alias("fp0"), F.sum("btp").over(total).alias("p"), F.sum("bfp").over(total).alias("n")
    )
    w = Window.partitionBy(*by, "__band").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    here = ties.withColumns({"cum_tp": F.sum("tp").over(w), "cum_fp": F.sum("fp").over(w)})
    joined = here.join(F.broadcast(bands) if not by else bands, [*by, "__band"])  # 256 rows without groups
    return joined.withColumns({"cum_tp": F.col("cum_tp") + F.col("tp0"), "cum_fp": F.col("cum_fp") + F.col("fp0")}).drop("__band", "tp0", "fp0")


def ranking_scores(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """average_precision and roc_auc of each group, ties taken together; null with one class."""
    r = running(tie_groups(df, by, weight), by)
    ap = F.sum(F.col("tp") / F.nullif(F.col("p"), F.lit(0)) * F.col("cum_tp") / F.nullif(F.col("cum_tp") + F.col("cum_fp"), F.lit(0)))
    auc = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)) / F.nullif(F.max("p") * F.max("n"), F.lit(0))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    return r.groupBy(*by).agg(F.when(both, ap).alias("average_precision"), F.when(both, auc).alias("roc_auc"))


def best_threshold(df: DataFrame, by: list[str]) -> DataFrame:
    """The probability of largest F1 among all distinct ones, the lower on ties; 0.5 with one class: threshold, f1, source."""
    r = running(tie_groups(df, by), by)
    f1 = 2 * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp") + F.col("p"))
    r = r.withColumn("f1", f1)
    best = F.max_by(F.struct("prob", "f1"), F.struct("f1", -F.col("prob")))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    out = r.groupBy(*by).agg(best.alias("b"), both.alias("both"))
    return out.select(*by, F.when(F.col("both"), F.col("b.prob")).otherwise(0.5).alias("threshold"), F.when(F.col("both"), F.col("b.f1")).alias("f1"), F.when(F.col("both"), "max_val_f1").otherwise("fallback_single_class").alias("source"))


def confusion(df: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    hit, y = F.col("prob") >= threshold, F.col("y") == 1
    n = lambda c, name: F.count_if(c).alias(name)
    return _clean(df).filter("prob IS NOT NULL").groupBy(*by).agg(n(y & hit, "n_tp"), n(~y & hit, "n_fp"), n(y & ~hit, "n_fn"), n(~y & ~hit, "n_tn"))


def point_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 (0 on a zero denominator), accuracy, balanced accuracy and mcc (null with one class)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("n_tp", "n_fp", "n_fn", "n_tn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    both = (tp + fn > 0) & (fp + tn > 0)
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns(
        {
            "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": (tp + tn) / (tp + fp + fn + tn),
            "balanced_accuracy": F.when(both, (share(tp, tp + fn) + share(tn, tn + fp)) / 2), "mcc": F.when(both, share(tp * tn - fp * fn, root)),
        }
    )


def split_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, positives, their rate, and the accuracy of calling everything negative."""
    n, p = F.count(F.lit(1)), F.sum("y")
    return df.groupBy(*by).agg(n.alias("n"), p.alias("n_positive"), (p / n).alias("positive_rate"), (1 - p / n).alias("all_negative_accuracy"))


def fold_scores(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Each fold's average precision, prevalence, their quotient (lift), and whether it is undefined."""
    prevalence = df.filter(F.col("prob").isNotNull()).groupBy(fold).agg(F.avg("y").alias("prevalence"))
    out = prevalence.join(ranking_scores(df, [fold]), fold, "left")
    return out.withColumns({"lift": F.col("average_precision") / F.nullif(F.col("prevalence"), F.lit(0.0)), "is_undefined": F.col("average_precision").isNull()})


def summarise(df: DataFrame, values: list[str]) -> DataFrame:
    """Of each column's defined values: mean, min, max, quartiles and number; one row for each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])))
    defined = F.when(~F.isnan("value"), F.col("value"))
    q = F.percentile(defined, F.array(F.lit(0.25), F.lit(0.75)))
    return long.groupBy("metric").agg(F.avg(defined).alias("mean"), F.min(defined).alias("least"), F.max(defined).alias("most"), q[0].alias("q25"), q[1].alias("q75"), F.count(defined).alias("n_defined"))


def bootstrap_interval(df: DataFrame, unit: str, threshold: float, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile intervals (2.5, 97.5) of average precision, F1 and recall, resampling whole units.

    Rows are never copied, and only weighted by how often their unit was drawn
    (``unit_bootstrap``).  Replicates with one class are left out; under two
    usable ones give nulls.
    """
    if replicates < 1:
        raise ValueError("a bootstrap takes one replicate at least")
    kind = F.when(F.col("y") == 1, 1).when(F.col("y") == 0, 0).when(F.col("y").isNotNull(), 2)
    ties = _clean(df).filter("prob IS NOT NULL").select(unit, F.col("prob").cast("double").alias("prob"), kind.alias("kind")).filter("kind IS NOT NULL")
    ties = ties.groupBy(unit, "prob", "kind").agg(F.count(F.lit(1)).alias("c")).withColumn("hit", F.col("prob") >= threshold)
    both = point_scores(unit_scores(ties, df.select(unit).distinct(), unit, replicates, seed)).filter("n_tp + n_fn > 0 AND n_fp + n_tn > 0")
    both = both.select("rep", "average_precision", "f1", "recall")
    ends = lambda m: F.percentile(m, F.array(F.lit(0.025), F.lit(0.975)))
    usable = F.count(F.lit(1))
    out = both.agg(usable.alias("n_usable"), *[ends(m).alias(m) for m in ("average_precision", "f1", "recall")])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col("n_usable") >= 2, F.col(m)[0]).alias("low"), F.when(F.col("n_usable") >= 2, F.col(m)[1]).alias("high")) for m in ("average_precision", "f1", "recall")])
    return out.select("n_usable", F.inline(rows))
