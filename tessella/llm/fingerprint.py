"""Canonical exact digests, with DataFrame functions alone.

A text is normalised (NFKC before and after full case folding, by the ICU
library that Spark brings), its white space is folded to single spaces and
trimmed, and two independent 64-bit xxhash values make a bucket.  Texts of a
bucket with several rows are compared byte by byte; if a bucket holds different
texts, they are told apart by a number behind the digest, in order of the text.
So equal canonical texts have equal fingerprints and different ones don't, and
the likeness of two fingerprints is 1 or 0.

Null and empty texts are equal.  Very long texts are normalised whole.  Repeated
rows and equal ids are ordered by their text.  A table of one row is its own next document.  Rows with a null id
come first.  An empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, written

#: Rows of a cell of neighbouring documents, about; cells at most; boundaries that are estimated at most.
CELL_ROWS, MOST_CELLS, MOST_BOUNDS = 1000, 65_536, 1024
#: Bucket keys that are broadcast at most (16 bytes each); beyond that the comparison shuffles.
MOST_BROADCAST = 500_000


def normalised(text: Column) -> Column:
    """NFKC, full case folding, NFKC, and white space folded."""
    compose = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def bucket(canonical: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes; the second is seeded by another column before it."""
    return F.xxhash64(canonical), F.xxhash64(F.lit("second"), canonical)


def digest(h1: Column, h2: Column, variant: Column | None = None) -> Column:
    out = F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))
    out = F.lower(out)
    return out if variant is None else F.when(F.coalesce(variant, F.lit(0)) > 0, F.concat(out, F.lit("-"), variant.cast("string"))).otherwise(out)


def collisions(docs: DataFrame, buckets: DataFrame, text: str = "text") -> DataFrame:
    """Columns h1, h2, canonical, variant of buckets that hold different texts: byte comparison of all buckets with several rows.

    ``buckets`` has a row (h1, h2) for each document.
    """
    several = buckets.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    if several.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        several = F.broadcast(several)
    canonical = docs.select(normalised(F.coalesce(F.col(text), F.lit(""))).alias("canonical"))
    h1, h2 = bucket(F.col("canonical"))
    texts = canonical.withColumns({"h1": h1, "h2": h2}).join(several, ["h1", "h2"], "left_semi")
    # the text decides; its own hash leads, so that the rows of one text are merged before they are shuffled
    distinct = texts.groupBy("h1", "h2", "canonical").agg(F.lit(1).alias("one"))
    mixed = distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("canonical")).alias("all")).filter("n > 1")
    return mixed.select("h1", "h2", F.posexplode("all").alias("variant", "canonical"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and one more, last column ``fingerprint`` of whole texts (with underscores before it where ``docs`` has one)."""
    names = docs.columns
    inner = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]  # no outer name meets an inner one
    withc = docs.select(*inner, normalised(F.coalesce(F.col(text), F.lit(""))).alias("canonical"))
    h1, h2 = bucket(F.col("canonical"))
    withh = withc.withColumns({"h1": h1, "h2": h2})
    mixed = written(collisions(docs, withh.select("h1", "h2"), text), "collisions")
    if mixed.isEmpty():
        out = withh.withColumn("variant", F.lit(0))
    else:
        out = withh.join(mixed, ["h1", "h2", "canonical"], "left")
    found = digest(F.col("h1"), F.col("h2"), F.col("variant")).alias(fresh(docs, "fingerprint"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], found)


def _cells(ids: DataFrame) -> Column:
    """A column of ``id`` that numbers cells of neighbouring ids, in their order.

    Boundaries are estimated from the ids, MOST_BOUNDS at most; between two of
    them cells have equal width.  Any boundaries give the same results.
    """
    rows, low, high = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    cells = max(1, min(MOST_CELLS, -(-rows // CELL_ROWS)))
    parts = min(cells, MOST_BOUNDS)
    inner = -(-cells // parts)
    bounds = [low, high]
    if low is not None and parts > 1:
        found = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        bounds = sorted({low, *found, high})
    if low is None or len(bounds) < 2 or low == high:
        return F.lit(0).cast("long")
    array = F.array(*[F.lit(b).cast("long") for b in bounds[:-1]])
    widths = F.array(*[F.lit(b - a).cast("double") for a, b in zip(bounds, bounds[1:])])
    at = F.greatest(F.lit(1), F.size(F.filter(array, lambda b: b <= F.col("id"))))
    share = (F.col("id") - F.element_at(array, at)).cast("double") / F.element_at(widths, at)
    return F.coalesce((at * inner + F.least(F.lit(inner - 1), F.floor(share * inner))).cast("long"), F.lit(0).cast("long"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, text, next: each document's text and that of the next by ascending id; the first follows the last.

    Documents are dealt once, to cells of neighbouring ids; each cell also gets
    the first document of the next cell.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cell = _cells(plain.select("id"))
    placed = plain.withColumn("cell", cell)
    # the first id of each cell, and the cell before it: as many rows as there are cells
    firsts = placed.select("id", "cell").groupBy("cell").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"))).alias("first"))
    order = Window.orderBy("cell")
    every = Window.partitionBy(F.lit(1))
    firsts = firsts.withColumn("before", F.coalesce(F.lag("cell").over(order), F.max("cell").over(every))).select(F.col("first.id").alias("fid"), "before")
    guests = plain.join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("fid")))  # cells are bounded by MOST_CELLS
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests.select("id", "text", F.col("before").alias("cell"), F.lit(1).alias("guest")))
    w = Window.partitionBy("cell").orderBy("guest", F.asc_nulls_first("id"), F.xxhash64("text"), "text")
    return both.withColumn("next", F.lead("text").over(w)).filter("guest = 0").select("id", "text", "next")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edited text, and the likeness to that and to the next document's."""
    rows = with_next(docs)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next", F.lit(1), cut))
    rows = rows.select("id", "n_chars", "text", "next", edited.alias("edited"))
    rows = rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), normalised(F.col("text")).alias("c"), normalised(F.col("edited")).alias("e"), normalised(F.col("next")).alias("x"))
    (h1, h2), (g1, g2) = bucket(F.col("c")), bucket(F.col("e"))
    like = lambda other: (F.col("c") == F.col(other)).cast("double")  # noqa: E731  bytes, not hashes
    table = rows.select("id", "n_chars", "edited_sha256", h1.alias("h1"), h2.alias("h2"), g1.alias("g1"), g2.alias("g2"), like("e").alias("near_edited"), like("x").alias("near_next"))
    table = written(table, "fingerprints")
    mixed = written(collisions(docs, table.select("h1", "h2")), "collisions")
    if not mixed.isEmpty():
        return _told_apart(docs, rows, mixed)
    return table.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digest(F.col("h1"), F.col("h2")).alias("fingerprint"), digest(F.col("g1"), F.col("g2")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def _told_apart(docs: DataFrame, rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """The report where two different texts share both hashes."""
    out = rows
    for c in ("c", "e"):
        h1, h2 = bucket(F.col(c))
        found = mixed.select(F.col("canonical").alias(f"{c}_text"), F.col("variant").alias(f"{c}_variant"))
        out = out.withColumns({f"{c}1": h1, f"{c}2": h2}).join(found, F.col(c) == F.col(f"{c}_text"), "left")
    like = lambda other: (F.col("c") == F.col(other)).cast("double")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digest(F.col("c1"), F.col("c2"), F.col("c_variant")).alias("fingerprint"),
        digest(F.col("e1"), F.col("e2"), F.col("e_variant")).alias("edited_fingerprint"), like("e").alias("near_edited"), like("x").alias("near_next"),
    )
