"""Cross-validation over folds of whole specimens: what runs have to have in common, and their results together.

Inputs are tables: ``folds`` (fold, specimens, slides, inner_val_specimen,
split_manifest_path, split_manifest_sha256), ``runs`` (fold, run_id,
split_manifest_sha256, decision_threshold, label_rule, area_fraction,
is_subset_run), ``predictions`` (fold, tile_id, stem, split, y, prob) and
``scorable`` (tile_id, stem), the tiles that can be scored at this size and
labelling.  Folds and specimens are few; predictions and tiles may be many, and
are only ever grouped by fold, split, specimen and tile.

Every rule gives rows (fold, check, detail) of what breaks it, so that all
breaks are seen at once; ``cross_validation`` refuses if there are any.  A
missing run alone can be allowed: the result then says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import metrics
from tessella.operators.reports import decimals

SPLITS = ("train", "val", "test")
SCORES = ["average_precision", "roc_auc", "f1", "precision", "recall", "accuracy", "balanced_accuracy", "mcc"]
SUMMARISED = ["lift", "average_precision", "roc_auc", "f1"]
#: The one break that an incomplete result may have.
MISSING = "no run"

#: Fields of a run's configuration that don't tell runs apart, those left out at their defaults (as JSON), and those of a single fold.
NOT_COMPARED = ("output_dir",)
LEFT_OUT = {
    "split_manifest_path": '"data/splits/split_manifest.json"', "split_manifest_sha256": "null", "embedding_cache_dir": "null", "embedding_cache_sha256": "null",
    "quadrant_pooling": '"mean"', "excluded_cuts": "[]", "known_empty_cuts": "[]", "cut_exclusions_applied": "false",
}
OF_A_FOLD = ("split_manifest_path", "split_manifest_sha256")


def _row(df: DataFrame, fold: str | None, check: str, detail: Column) -> DataFrame:
    return df.select(F.col(fold).cast("int").alias("fold") if fold else F.lit(None).cast("int").alias("fold"), F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expected_specimens(folds: DataFrame) -> DataFrame:
    """Where each specimen has to stand when a fold is held out: fold, specimen, split."""
    every = folds.select(F.col("fold").alias("of"), F.explode("specimens").alias("specimen"))
    inner = folds.select(F.col("fold").alias("inner_of"), F.col("inner_val_specimen").alias("specimen"))
    held = F.broadcast(folds.select("fold"))  # folds are few
    known = every.join(inner, "specimen", "left").crossJoin(held)
    split = F.when(F.col("of") == F.col("fold"), "test").when(F.col("inner_of").isNotNull() & (F.col("inner_of") != F.col("fold")), "val").otherwise("train")
    # a specimen that is the inner one of several folds is for validation if any of them isn't held out
    return known.groupBy("fold", "specimen").agg(F.max_by(split, F.when(split == "test", 2).when(split == "val", 1).otherwise(0)).alias("split"))


def isolation_breaks(rows: DataFrame, folds: DataFrame, required: tuple[str, ...] = SPLITS) -> DataFrame:
    """Specimens of ``rows`` (fold, stem, split) on several splits, and those that a required split lacks or shouldn't have."""
    if unknown := set(required) - set(SPLITS):
        raise ValueError(f"unknown splits: {sorted(unknown)}")
    got = rows.select("fold", names.specimen_of(F.col("stem")).alias("specimen"), "split").distinct()
    several = got.groupBy("fold", "specimen").agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    wanted = F.col("split").isin(*required)
    want = expected_specimens(folds).join(rows.select("fold").distinct(), "fold", "left_semi")
    where = F.concat_ws(" ", "specimen", "split")
    missing = want.filter(wanted).join(got, ["fold", "specimen", "split"], "left_anti")
    extra = got.filter(wanted).join(want, ["fold", "specimen", "split"], "left_anti")
    return _all([_row(several, "fold", "several splits", F.concat_ws(" ", "specimen", F.array_join("splits", ","))), _row(missing, "fold", "specimen missing", where), _row(extra, "fold", "specimen unexpected", where)])


def coverage_breaks(predictions: DataFrame, scorable: DataFrame, folds: DataFrame) -> DataFrame:
    """Tiles held out more than once, never, or without being scorable; only specimens of folds with a run are asked for."""
    held = predictions.filter("split = 'test'").groupBy("tile_id").agg(F.count(F.lit(1)).alias("times"), F.max("fold").alias("fold"))
    ran = folds.join(predictions.select("fold").distinct(), "fold", "left_semi").select(F.explode("specimens").alias("__s")).distinct()
    want = scorable.withColumn("__s", names.specimen_of(F.col("stem"))).join(ran, "__s", "left_semi").select("tile_id").distinct()
    both = want.withColumn("__e", F.lit(True)).join(held, "tile_id", "full_outer")
    check = F.when(F.col("times") > 1, "held out more than once").when(F.col("times").isNull(), "never held out").when(F.col("__e").isNull(), "not scorable")
    return both.withColumn("check", check).filter("check IS NOT NULL").select(F.col("fold").cast("int").alias("fold"), "check", F.col("tile_id").cast("string").alias("detail"))


def run_breaks(runs: DataFrame, folds: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Folds without a run or with several, runs of unknown folds, of other split files, of another configuration, or scored differently.

    ``expected`` (fold, run_id) says which run each fold asks for.
    """
    n = runs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    both = runs.join(folds.select("fold", F.col("split_manifest_sha256").alias("__sha")), "fold", "left")
    parts = [
        _row(folds.join(n, "fold", "left_anti"), "fold", MISSING, F.lit("")),
        _row(n.filter("n > 1"), "fold", "several runs", F.col("n")),
        _row(both.join(folds, "fold", "left_anti"), "fold", "unknown fold", F.col("run_id")),
        _row(both.join(folds, "fold", "left_semi").filter(~F.col("__sha").eqNullSafe(F.col("split_manifest_sha256"))), "fold", "other split file", F.col("run_id")),
    ]
    if expected is not None:
        wrong = runs.join(expected.select("fold", F.col("run_id").alias("__want")), "fold", "left").filter(~F.col("run_id").eqNullSafe(F.col("__want")))
        parts.append(_row(wrong, "fold", "other configuration", F.concat_ws(" ", F.coalesce("run_id", F.lit("null")), F.lit("instead of"), F.coalesce("__want", F.lit("null")))))
    ways = runs.select("label_rule", "area_fraction").distinct().agg(F.sort_array(F.collect_list(F.concat_ws(" ", F.coalesce("label_rule", F.lit("null")), F.coalesce(F.col("area_fraction").cast("string"), F.lit("null"))))).alias("ways"))
    parts.append(_row(ways.filter(F.size("ways") > 1), None, "different labellings", F.array_join("ways", ", ")))
    return _all(parts)


def fold_results(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """Each fold's held-out results at its run's threshold: numbers of tiles, slides and specimens, prevalence, scores and lift.

    Lift is average precision over prevalence, undefined where either is missing or the prevalence is 0.
    """
    rows = predictions.filter(F.col("split") == "test").join(runs.select("fold", "run_id", "decision_threshold", "is_subset_run"), "fold")
    sizes = rows.groupBy("fold", "run_id", "decision_threshold", "is_subset_run").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum(F.col("y").cast("long")).alias("n_positive"), F.countDistinct("stem").alias("n_slides"), F.countDistinct(names.specimen_of(F.col("stem"))).alias("n_specimens"), F.avg("y").alias("positive_rate")
    )
    val = predictions.filter(F.col("split") == "val").groupBy("fold").agg(F.count(F.lit(1)).alias("val_n_tiles"), F.countDistinct(names.specimen_of(F.col("stem"))).alias("val_n_specimens"))
    points = metrics.point_scores(metrics.confusion(rows, ["fold"], F.col("decision_threshold")))
    ranks = metrics.ranking_scores(rows.select("fold", "y", "prob"), ["fold"])
    out = sizes.join(points, "fold", "left").join(ranks, "fold", "left").join(val, "fold", "left")
    lift = F.col("average_precision") / F.nullif(F.col("positive_rate"), F.lit(0.0))
    return out.withColumn("lift", lift).select(
        "fold", "run_id", "n_tiles", "n_positive", "n_slides", "n_specimens", "positive_rate", *SCORES, "lift", F.col("lift").isNull().alias("undefined"),
        (1 - F.col("positive_rate")).alias("all_negative_accuracy"), "decision_threshold", F.coalesce("val_n_tiles", F.lit(0).cast("long")).alias("val_n_tiles"), F.coalesce("val_n_specimens", F.lit(0).cast("long")).alias("val_n_specimens"), "is_subset_run",
    )


def all_breaks(folds: DataFrame, runs: DataFrame, predictions: DataFrame, scorable: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Every break of every rule: fold, check, detail.  A run's own predictions need its validation and test specimens."""
    known = predictions.join(folds.select("fold"), "fold", "left_semi")
    return _all([run_breaks(runs, folds, expected), isolation_breaks(known, folds, ("val", "test")), coverage_breaks(known, scorable, folds)])


def cross_validation(folds: DataFrame, runs: DataFrame, predictions: DataFrame, scorable: DataFrame, expected: DataFrame | None = None, allow_partial: bool = False) -> DataFrame:
    """One row with everything: flags, missing folds, the results of each fold in order, and a summary of their scores.

    Any break is an error that lists the first ones; with ``allow_partial``
    folds without a run are told in the result, unless none has one.
    """
    breaks = all_breaks(folds, runs, predictions, scorable, expected)
    refused = breaks.filter(F.col("check") != MISSING) if allow_partial else breaks
    if some := refused.orderBy("check", "fold", "detail").limit(5).collect():
        raise ValueError(f"the folds' runs don't make one result: {[tuple(r) for r in some]}")
    per = fold_results(predictions, runs)
    missing = folds.join(runs, "fold", "left_anti").agg(F.sort_array(F.collect_list("fold")).alias("folds_missing"))
    every = per.agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_tiles").alias("n_tiles_held_out"), F.coalesce(F.bool_or("is_subset_run"), F.lit(False)).alias("is_subset_run"), F.array_sort(F.collect_list(F.struct(*per.columns))).alias("per_fold"), *[_summary(c).alias(f"s_{c}") for c in SUMMARISED]
    )
    out = every.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(folds.agg(F.count(F.lit(1)).alias("k"))))  # one row each
    if out.filter("n_folds = 0").head(1):
        raise ValueError("no fold has a run")
    return out.select(
        F.format_string("flat_grouped_%dfold", "k").alias("evaluation_design"), (F.size("folds_missing") > 0).alias("is_partial"), "folds_missing", "is_subset_run", "n_tiles_held_out", "per_fold",
        F.struct(*[F.col(f"s_{c}").alias(c) for c in SUMMARISED], F.format_string("spread is a range over %d non-independent folds, not a confidence interval", "n_folds").alias("note")).alias("summary"),
    )


def _summary(c: str) -> Column:
    defined = F.when(~F.isnan(c), F.col(c))
    return F.struct(F.avg(defined).alias("mean"), F.min(defined).alias("min"), F.max(defined).alias("max"), F.percentile(defined, F.array(F.lit(0.25), F.lit(0.75))).alias("iqr"), F.count(defined).alias("n_defined"))


# Configurations as maps of field to JSON text


def config_json(config: Column, excluded: tuple[str, ...] = NOT_COMPARED, omitted: dict[str, str] = LEFT_OUT) -> Column:
    """A configuration as one JSON object in order of its keys, without excluded fields and those at their defaults."""
    defaults = F.create_map(*[F.lit(x) for kv in omitted.items() for x in kv]) if omitted else None
    stays = lambda k, v: ~k.isin(*excluded) if excluded else F.lit(True)
    told = F.map_filter(config, stays)
    if defaults is not None:
        told = F.map_filter(told, lambda k, v: ~F.coalesce(F.try_element_at(defaults, k) == v, F.lit(False)))
    pairs = F.transform(F.array_sort(F.map_entries(told)), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"^\[(.*)\]$", 1), F.lit(": "), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def config_digest(config: Column, excluded: tuple[str, ...] = NOT_COMPARED, omitted: dict[str, str] = LEFT_OUT, length: int = 8) -> Column:
    return F.substr(F.sha2(config_json(config, excluded, omitted), 256), F.lit(1), F.lit(length))


def path_part(text: Column) -> Column:
    """A text as one part of a path: runs of other characters become a dash; ``unnamed`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("unnamed"))


def _readable(config: Column) -> Column:
    plain = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), config[k], F.lit("}")), "$.v")
    encoder = F.coalesce(F.when(plain("encoder_name") != "", path_part(plain("encoder_name"))), F.lit("none"))
    threshold = F.bround(plain("min_oocyte_area_fraction").cast("double") * 10000).cast("int")
    return F.concat(plain("architecture"), F.lit("_"), encoder, F.format_string("_%04d_", plain("tile_size").cast("int")), plain("label_rule"), F.format_string("%04d", threshold), F.lit("_seed"), plain("seed"))


def run_id(config: Column) -> Column:
    """A readable name of a run, with a digest of everything that changes its numbers."""
    return F.concat(_readable(config), F.lit("_"), config_digest(config))


def cv_run_id(config: Column, folds_sha256: Column) -> Column:
    """The name of a cross-validation: the run's without its own split, with the fold manifest's hash."""
    whole = F.map_concat(F.map_filter(config, lambda k, v: ~k.isin(*OF_A_FOLD)), F.create_map(F.lit("fold_manifest_sha256"), F.concat(F.lit('"'), folds_sha256, F.lit('"'))))
    return F.concat(_readable(config), F.lit("_cv_"), config_digest(whole))


def expected_runs(config: DataFrame, folds: DataFrame) -> DataFrame:
    """The run that each fold asks for under a configuration (one row with a map ``config``): fold, run_id."""
    of_fold = lambda path: F.map_concat(F.map_filter("config", lambda k, v: ~k.isin(*OF_A_FOLD)), F.create_map(F.lit("split_manifest_path"), F.concat(F.lit('"'), path, F.lit('"')), F.lit("split_manifest_sha256"), F.lit("null")))
    return folds.crossJoin(F.broadcast(config.select("config"))).select("fold", run_id(of_fold(F.col("split_manifest_path"))).alias("run_id"))


# Recorded lists of excluded cuts


def recorded_lists(records: DataFrame) -> DataFrame:
    """``records`` with ``listing``: the exclusions that each recorded, or those of the corpus before there was a list.

    The record's columns are excluded_cuts, known_empty_cuts and
    cut_exclusions_applied, nulls for a record from before.  A list that names
    cuts without being applied is an error, as is a cut that it names twice.
    """
    none = F.array().cast("array<string>")
    excluded, empty = (F.array_sort(F.array_distinct(F.coalesce(c, none))) for c in ("excluded_cuts", "known_empty_cuts"))
    applied = F.coalesce("cut_exclusions_applied", F.lit(False))
    both = F.array_intersect(excluded, empty)
    wrong = F.when(~applied & (F.size(excluded) + F.size(empty) > 0), F.lit("a list that names cuts has to be applied")).when(F.size(both) > 0, F.concat(F.array_join(both, ", "), F.lit(" listed both as excluded and as known empty")))
    listing = F.struct(applied.alias("applied"), excluded.alias("excluded"), empty.alias("known_empty"))
    return records.withColumn("listing", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("struct<applied: boolean, excluded: array<string>, known_empty: array<string>>")).otherwise(listing))


def described(listing: Column) -> Column:
    """Exclusions in words."""
    quoted = lambda a: F.when(F.size(a) == 0, "nothing").otherwise(F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
    some = F.concat(F.lit("a cut exclusion list excluding "), quoted(listing["excluded"]), F.lit(" and confirming empty "), quoted(listing["known_empty"]))
    return F.when(listing["applied"], some).otherwise("no cut exclusion list (the legacy corpus)")


def list_conflicts(records: DataFrame, in_use: DataFrame) -> DataFrame:
    """Records (with their own columns) whose list is another than the one in use (one row), with both in words."""
    mine = recorded_lists(in_use).select(F.col("listing").alias("__use"))
    other = recorded_lists(records).crossJoin(F.broadcast(mine)).filter(~F.col("listing").eqNullSafe(F.col("__use")))
    return other.select(*records.columns, described(F.col("listing")).alias("recorded"), described(F.col("__use")).alias("used"))


def orphaned_manifests(manifests: DataFrame, in_use: DataFrame, output: str, split_files: list[str]) -> DataFrame:
    """Fold manifests built with another list that writing to ``output`` and ``split_files`` would orphan: path, recorded, used.

    ``manifests`` has path, split_files (array) and the record's columns.
    """
    other = list_conflicts(manifests, in_use)
    touched = F.arrays_overlap("split_files", F.array(*map(F.lit, split_files)).cast("array<string>"))
    return other.filter((F.col("path") == output) | F.coalesce(touched, F.lit(False))).select("path", "recorded", "used")


def default_run(runs: DataFrame, default: dict[str, str], folds_sha256: str, ignored: tuple[str, ...] = ("num_workers", "output_dir", "split_manifest_sha256", "embedding_cache_sha256")) -> DataFrame:
    """Cross-validations (path, config, is_subset_run, is_partial, fold_manifest_sha256) with why each isn't the default's: path, reason.

    Fields that a record lacks count as their defaults.  A null reason is a match.
    """
    lists = ("excluded_cuts", "known_empty_cuts", "cut_exclusions_applied")
    known = F.create_map(*[F.lit(x) for kv in default.items() for x in kv])
    lacking = F.create_map(*[F.lit(x) for kv in LEFT_OUT.items() for x in kv])
    keys = F.array_except(F.array_union(F.map_keys("config"), F.map_keys("__d")), F.array(*map(F.lit, ignored)))
    differs = F.filter(keys, lambda k: ~F.coalesce(F.try_element_at("config", k), F.try_element_at(lacking, k)).eqNullSafe(F.try_element_at("__d", k)))
    rows = runs.withColumn("__d", known).withColumn("__differs", differs)
    plain = F.array_except("__differs", F.array(*map(F.lit, lists)))
    reason = F.when(F.col("is_subset_run"), "subset").when(F.size(plain) > 0, "other configuration").when(F.size("__differs") > 0, "other exclusion list").when(~F.col("fold_manifest_sha256").eqNullSafe(F.lit(folds_sha256)), "other folds").when(F.col("is_partial"), "partial")
    return rows.select("path", reason.alias("reason"))


def one_default_run(reasons: DataFrame) -> str:
    """The path of the only match; else an error that says how many of each kind were passed over."""
    found = [r.path for r in reasons.filter("reason IS NULL").orderBy("path").limit(4).collect()]
    if len(found) != 1:
        skipped = {r.reason: r.n for r in reasons.filter("reason NOT IN ('subset', 'other configuration')").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        raise (ValueError if found or skipped else LookupError)(f"one default run is asked for; found {found}; passed over {dict(sorted(skipped.items()))}")
    return found[0]


def fold_table(folds: DataFrame, sizes: list[int]) -> DataFrame:
    """A line of text for each fold: fold, line.  ``folds`` has slides, tiles, positives and positive_rate (maps by size), specimens and inner_val_specimen."""
    cells = []
    for s in sizes:
        rate = F.col("positive_rate")[str(s)]
        share = F.when(rate.isNull(), "  n/a").otherwise(F.concat(decimals(rate * 100, 1), F.lit("%")))
        cells.append(F.concat(F.format_string(f"{s}px %,7d %,6d ", F.col("tiles")[str(s)], F.col("positives")[str(s)]), share))
    first = F.concat(F.format_string("fold %d  %2d slides  ", "fold", F.size("slides")), F.concat_ws("  ", *cells))
    second = F.concat(F.lit("\n        "), F.array_join("specimens", ", "), F.lit("  (inner val: "), F.col("inner_val_specimen"), F.lit(")"))
    return folds.select("fold", F.concat(first, second).alias("line"))
