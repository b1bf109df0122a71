"""Quality measures of groups: medians, percentile ranks and blur flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import running_sum
from tessella.operators.splits import hash_order


def percentile_rank(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``df`` with ``percentile``: 100 times the average rank among equals over the number of values; null for nulls.

    Equal values are counted first, so what is ranked is one row for each distinct value.
    """
    v = F.when(~F.isnan(value), F.col(value))
    rows = df.withColumn("__v", v)
    counts = rows.filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    up = running_sum(counts, [F.col("__v")], F.col("__n"), list(by), "__up")
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    up = up.join(totals, list(by)) if by else up.crossJoin(F.broadcast(totals))  # one row
    places = up.select(*by, "__v", (100 * (F.col("__up") - (F.col("__n") - 1) / 2) / F.col("__all")).alias("percentile"))
    return rows.join(places, [*by, "__v"], "left").drop("__v")


def group_medians(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Exact medians of each group's defined values, and how many there are."""
    defined = {v: F.when(~F.isnan(v), F.col(v)) for v in values}
    aggs = [F.percentile(c, F.lit(0.5)).alias(f"median_{v}") for v, c in defined.items()] + [F.count(c).alias(f"n_{v}") for v, c in defined.items()]
    return df.groupBy(by).agg(*aggs)


def flag_groups(groups: DataFrame, key: str, value: str, n: str, cutoff: float, least: int, listed: str | None = None) -> DataFrame:
    """Flags by the ratio to the median of eligible groups: ``too few tiles``, ``blurred`` or blank; blurred and undefined first.

    Eligible: enough tiles, a value, and not ``listed``.  A median that isn't above 0 is an error.
    """
    v = F.when(~F.isnan(value), F.col(value))
    eligible = (F.col(n) >= least) & v.isNotNull() & (F.lit(True) if listed is None else ~F.col(listed))
    middle = groups.agg(F.percentile(F.when(eligible, v), F.lit(0.5)).alias("__m"))
    known = F.when(F.col("__m") > 0, F.col("__m")).otherwise(F.raise_error(F.lit("the median of the eligible groups isn't above 0")).cast("double"))
    out = groups.crossJoin(F.broadcast(middle)).withColumn("ratio", v / known)  # one row
    flag = F.when((F.col(n) < least) | v.isNull(), "too few tiles").when(F.col("ratio") < cutoff, "blurred").otherwise("")
    return out.withColumn("flag", flag).drop("__m").orderBy(F.asc_nulls_first("ratio"), F.asc(key))


def sample_per_group(df: DataFrame, by: str, key: str, k: int, seed: int) -> DataFrame:
    """Up to k rows of each group in a seeded order."""
    w = Window.partitionBy(by).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def cut_quality(stats: DataFrame, tiles: DataFrame, values: list[str], sharpness: str = "sharpness") -> DataFrame:
    """Of each cut: tiles measured, medians of its tiles' statistics, how many gave a sharpness, and its percentile among all cuts.

    ``stats`` has path and statistics; ``tiles`` has cut_name and png_path.
    """
    rows = tiles.select("cut_name", F.col("png_path").alias("path")).join(stats, "path")
    n = rows.groupBy("cut_name").agg(F.count(F.lit(1)).alias("n_tiles"))
    return percentile_rank(group_medians(rows, "cut_name", values).join(n, "cut_name"), f"median_{sharpness}")


def quality_report(tiles: DataFrame, read: Callable[[list[str]], DataFrame], listed: DataFrame, per_cut: int, cutoff: float, least: int, seed: int = 42) -> DataFrame:
    """Every cut's image quality, flagged, least sharp first: the columns of ``cut_quality``, listed (a status), ratio, flag.

    ``per_cut`` tiles of each cut are sampled before any picture is read: ``read``
    gets their paths alone (as many as cuts times ``per_cut``) and gives rows of
    the image source.  Cuts that are listed as excluded don't set the median.
    """
    from tessella.operators.images import image_stats

    some = sample_per_group(tiles, "cut_name", "png_path", per_cut, seed).select("cut_name", "png_path")
    paths = [r.png_path for r in some.select("png_path").distinct().collect()]
    if not paths:
        raise ValueError("no tiles to measure")
    stats = image_stats(read(paths))
    name = lambda c: F.regexp_replace(c, r"^[a-z]+:/+", "/")  # noqa: E731  the source writes a scheme before its paths
    stats, some = stats.withColumn("path", name("path")), some.withColumn("png_path", name("png_path"))
    cuts = cut_quality(stats, some, ["tissue_fraction", "brightness", "saturation", "red", "blue", "sharpness"])
    cuts = cuts.join(listed.select("cut_name", F.col("status").alias("listed")), "cut_name", "left").withColumn("__out", F.coalesce(F.col("listed") == "excluded", F.lit(False)))
    return flag_groups(cuts, "cut_name", "median_sharpness", "n_sharpness", cutoff, least, "__out").drop("__out")


def quality_warnings(report: DataFrame, listed: DataFrame) -> DataFrame:
    """Cuts to look at (cut_name, warning): blurred or too few tiles without being excluded, and listed ones that no tile belongs to."""
    told = report.filter("flag <> '' AND (listed IS NULL OR listed <> 'excluded')")
    odd = told.select("cut_name", F.when(F.col("flag") == "blurred", "out of focus and not excluded").otherwise("too few tiles to judge").alias("warning"))
    return odd.unionByName(listed.join(report, "cut_name", "left_anti").select("cut_name", F.lit("listed without a tile").alias("warning")))
