"""Keys that names encode: site, specimen, slide stem, cut and tile; and stages in free text.

Names look like ``SITE_SEASON_COLONY_A-B`` for slides, ``{stem}_cutNNN`` for
cuts and ``{cut}_s0512_r0001_c0002`` for tiles.  All functions take and give
columns; a null name gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stage_number(*texts: Column) -> Column:
    """The number after ``stage``, in any case, in the first text that has one; else null."""
    return F.coalesce(*[F.regexp_extract(t, r"(?i)stage\s*(\d+)", 1).try_cast("int") for t in texts])


def stage_name(classification: Column) -> Column:
    """The classification's own name, ``Unknown`` if it is null or empty."""
    return F.coalesce(F.nullif(classification, F.lit("")), F.lit("Unknown"))


def stage_label(number: Column) -> Column:
    """``Stage N``, or ``Unlabelled`` without a number."""
    return F.when(number.isNull(), "Unlabelled").otherwise(F.concat(F.lit("Stage "), number.cast("string")))


def class_name(number: Column, names: list[str]) -> Column:
    """A class's name by its index, ``class_N`` beyond the list."""
    known = F.try_element_at(F.array(*map(F.lit, names)), F.when(number >= 0, number.cast("int") + 1))
    return F.coalesce(known, F.concat(F.lit("class_"), number.cast("string")))


def specimen_of(stem: Column) -> Column:
    """All tokens but the last; a single token stays."""
    return F.when(F.instr(stem, "_") == 0, stem).otherwise(F.regexp_replace(stem, r"_[^_]*$", ""))


def site_of(stem: Column) -> Column:
    return F.split_part(stem, F.lit("_"), F.lit(1))


def stem_parts(stem: Column) -> Column:
    """A struct of location, season, colony, sample and slice_range; all null with fewer than four tokens."""
    t = F.split(stem, "_")
    n = F.size(t)
    some = lambda c: F.when(n >= 4, c)
    return F.struct(
        some(F.get(t, F.lit(0))).alias("location"), some(F.get(t, F.lit(1))).alias("season"), some(F.get(t, F.lit(2))).alias("colony"),
        some(F.concat_ws("_", F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))))).alias("sample"), some(F.get(t, n - 1)).alias("slice_range"),
    )


def cut_count(stem: Column) -> Column:
    """B - A + 1 of a ``_A-B`` ending, else null."""
    part = lambda i: F.regexp_extract(stem, r"_(\d+)-(\d+)$", i).try_cast("int")
    return part(2) - part(1) + 1


def stem_of_cut(cut_name: Column) -> Column:
    """What precedes the last ``_cut``; null if there is none."""
    return F.nullif(F.regexp_extract(cut_name, r"^(.*)_cut[^_]*$", 1), F.lit(""))


def tile_id(cut_name: Column, size: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_s%04d_r%04d_c%04d", cut_name, size, row, col)


def tile_id_at(cut_name: Column, size: Column, x: Column, y: Column) -> Column:
    """The form that names a tile by its pixel origin."""
    number = lambda c, n: F.when((c >= 0) & (c < 10**n), F.lpad(c.cast("string"), n, "0")).otherwise(F.format_string(f"%0{n}d", c))  # noqa: E731  # formatting is dear
    return F.concat(F.coalesce(cut_name, F.lit("null")), F.lit("_s"), number(size, 4), F.lit("_x"), number(x, 6), F.lit("_y"), number(y, 6))


def annotation_id(given: Column, stem: Column, position: Column, separator: str = ":") -> Column:
    return F.coalesce(given, F.concat_ws(separator, stem, position.cast("string")))


def quota_key(location: Column, has_scarce: Column) -> Column:
    return F.concat(location, F.when(has_scarce, "_has_stage2").otherwise("_no_stage2"))


def yes_no(flag: Column) -> Column:
    """Trimmed, first letter large and the rest small."""
    return F.initcap(F.lower(F.trim(flag)))


def image_stem(name: Column) -> Column:
    """An image's name without folder and ending."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def date_or_null(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def fingerprint(config: Column) -> Column:
    """SHA-256 of a map's non-null entries as JSON in order of their keys."""
    known = F.map_filter(config, lambda k, v: v.isNotNull())
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(known)))), 256)


def slug(text: Column) -> Column:
    """A path-safe form: runs of other characters become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")
