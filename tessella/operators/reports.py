"""Report tables over slide metadata, annotations and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASONS = ["Spring", "Summer", "Autumn", "Winter"]


def ordered(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Sorted by a fixed order of categories; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), column)


def site_overview(df: DataFrame) -> DataFrame:
    """Cuts, specimens, images, seasons, yes and no, rate and date range by site and, with a null site, of all; null sites are left out."""
    known = df.filter(F.col("site").isNotNull())
    yes, no = F.count_if(F.col("flag") == "Yes"), F.count_if(F.col("flag") == "No")
    return known.rollup("site").agg(
        F.count(F.lit(1)).alias("n_cuts"), F.countDistinct("season", "polyp").alias("n_specimens"), F.countDistinct("image").alias("n_images"), F.countDistinct("season").alias("n_seasons"),
        yes.alias("n_yes"), no.alias("n_no"), (yes / F.nullif(yes + no, F.lit(0))).alias("rate"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


def season_pivot(df: DataFrame, seasons: list[str] = SEASONS) -> DataFrame:
    """Yes and No by season in a fixed order, with total and percent; seasons without rows are zero."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, s) for i, s in enumerate(seasons)], "position int, season string")
    counts = df.filter(F.col("flag").isin("Yes", "No")).groupBy("season").pivot("flag", ["Yes", "No"]).count()
    out = dim.join(counts, "season", "left").na.fill(0, ["Yes", "No"]).withColumn("total", F.col("Yes") + F.col("No"))
    return out.select("position", "season", F.col("Yes").alias("n_yes"), F.col("No").alias("n_no"), "total", (100 * F.col("Yes") / F.nullif(F.col("total"), F.lit(0))).alias("percent"))


def specimen_rates(df: DataFrame) -> DataFrame:
    """The share of yes of each specimen (site, season, polyp)."""
    yes = F.count_if(F.col("flag") == "Yes")
    return df.filter(F.col("site").isNotNull()).groupBy("site", "season", "polyp").agg(F.count(F.lit(1)).alias("n"), yes.alias("n_yes"), (yes / F.count(F.lit(1))).alias("rate"))


def rate_variation(rates: DataFrame) -> DataFrame:
    """By site: specimens at 0, at 1 and between, median and mean rate, and how many have 0.3 or more."""
    r = F.col("rate")
    return rates.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r == 0).alias("n_zero"), F.count_if(r == 1).alias("n_one"), F.count_if((r > 0) & (r < 1)).alias("n_mixed"),
        F.percentile("rate", F.lit(0.5)).alias("median_rate"), F.avg("rate").alias("mean_rate"), F.count_if(r >= 0.3).alias("n_high"),
    )


def campaign_rates(df: DataFrame) -> DataFrame:
    """Rate and distinct days by site and year."""
    yes = F.count_if(F.col("flag") == "Yes")
    return df.filter(F.col("day").isNotNull()).groupBy("site", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), (yes / F.count(F.lit(1))).alias("rate"), F.countDistinct("day").alias("n_days"))


def any_positive(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_or(F.col("flag") == "Yes").alias("any_yes"), F.count(F.lit(1)).alias("n"))


def stage_shares(df: DataFrame) -> DataFrame:
    """Rows of each stage and their percentage."""
    counts = df.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("stage", "n", (100 * F.col("n") / F.col("t")).alias("percent"))


def stage_composition(df: DataFrame, by: str, stages: list[int]) -> DataFrame:
    """Rows of each group by stage, absolute and as shares."""
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("stage") == s).alias(f"stage_{s}") for s in stages])
    return wide.select("*", *[(F.col(f"stage_{s}") / F.col("total")).alias(f"share_{s}") for s in stages])


def stage_map(df: DataFrame, by: str) -> DataFrame:
    """Stage counts of each group as a map, in order of the stage."""
    counts = df.groupBy(by, "stage").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "n")))).alias("stage_counts"), F.sum("n").alias("total"))


def value_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows by bin of the base-ten logarithm, clipped to the first and last bin."""
    at = F.floor((F.log10(F.greatest(F.col(value).cast("double"), F.lit(1.0))) - low) / ((high - low) / bins))
    return df.groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def threshold_counts(df: DataFrame, by: list[str], fraction: str, thresholds: list[float]) -> DataFrame:
    """Rows, touched rows and rows from each threshold on."""
    f = F.col(fraction)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(f > 0).alias("n_touched"), *[F.count_if((f >= t) & (f > 0)).alias(f"n_from_{round(100 * t):02d}") for t in thresholds])


def split_table(df: DataFrame, splits: list[str] = ("train", "val", "test")) -> DataFrame:
    """Rows of each location by split, zero where there are none."""
    return df.groupBy("location").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits])


def checks(violations: DataFrame, names: list[str]) -> DataFrame:
    """All named checks with how many rows break each and the first three: columns check, ok, n, examples.  ``violations`` has check, detail."""
    dim = violations.sparkSession.createDataFrame([(n,) for n in names], "check string")
    w = Window.partitionBy("check").orderBy("detail")
    top = violations.withColumn("k", F.row_number().over(w)).groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("detail")))).alias("examples"))
    out = dim.join(top, "check", "left")
    return out.select("check", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def training_progress(log: DataFrame, run: str, patience: int) -> DataFrame:
    """By epoch: best score so far, epochs since it was reached, and whether patience is at its end."""
    w = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max("score").over(w)
    marked = log.withColumns({"best": best, "__new": (F.col("score") > F.coalesce(F.max("score").over(Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))))})
    marked = marked.withColumn("best_epoch", F.max(F.when(F.col("__new"), F.col("epoch"))).over(w))
    return marked.withColumn("stops", (F.col("epoch") - F.col("best_epoch")) >= patience).drop("__new")


def null_nan(df: DataFrame) -> DataFrame:
    """NaN to null in all floating columns."""
    fix = {c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def share(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def images_by_site(df: DataFrame) -> DataFrame:
    """Distinct images of each site, and how many of them are annotated (have the flag)."""
    return df.groupBy("site").agg(F.countDistinct("image").alias("n_images"), F.countDistinct(F.when(F.col("annotated"), F.col("image"))).alias("n_annotated"))


def expect_rows(df: DataFrame, n: int, what: str) -> DataFrame:
    """``df``, or an error if it hasn't as many rows as it should."""
    if (found := df.count()) != n:
        raise ValueError(f"{what}: {found} rows, not {n}")
    return df


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand in two lists which should have none in common."""
    return a.select(key).intersect(b.select(key))


def decimals(value: Column | str, places: int) -> Column:
    """A number with so many places, rounded by its exact binary value, as Python and C do.

    ``format_string`` rounds its shortest decimal, and ``format_number`` does so too where the first digit decides, as in
    0.0005: on which side of such a tie the binary value lies is computed here, in products that lose no bit.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    twice = 2.0 * 10**places
    size = F.abs(x)
    half = F.rint(size * twice)
    high = size.cast("float").cast("double")
    off = (high * twice - half) + (size - high) * twice
    side = F.when(off > 0, half + 1).otherwise(half - 1) / twice
    tie = (size < 1e9) & (half % 2 == 1) & (size == half / twice) & (off != 0)
    exact = F.when(tie, F.when(x < 0, -side).otherwise(side)).otherwise(x)
    return F.replace(F.format_number(exact, places), F.lit(","), F.lit(""))


def interval_text(value: str, low: str, high: str) -> Column:
    """``0.123 [0.100, 0.150]``; a dash where the value is missing, only the value where the interval is."""
    number = lambda c: decimals(c, 3)
    both = F.col(low).isNotNull() & F.col(high).isNotNull()
    return F.when(F.col(value).isNull(), "-").when(both, F.concat(number(value), F.lit(" ["), number(low), F.lit(", "), number(high), F.lit("]"))).otherwise(number(value))


def score_grid(scores: DataFrame, rows: str, columns: str, value: str, wanted: list) -> DataFrame:
    """A table with a row for each model and a column for each size of one score, as text; a dash where there is none."""
    out = scores.groupBy(rows).pivot(columns, wanted).agg(F.first(decimals(value, 3)))
    return out.select(rows, *[F.coalesce(F.col(f"`{c}`"), F.lit("-")).alias(str(c)) for c in wanted])
