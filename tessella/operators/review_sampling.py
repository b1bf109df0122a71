"""Whole review sessions: tiles around annotations and tiles far from any, in seeded order, through a tissue gate.

The gate needs pixels, which are dear: candidates are put in order first, and only
the next block of them is measured, until exactly as many as asked for have passed.
So few are asked for that the first POOL of the order nearly always have them; joins
that tell which candidates count are made for those alone, and for the rest, ranked
whole, only where they don't suffice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import grid, images, sampling, spatial
from tessella.operators.ranking import ranked
from tessella.session import can_checkpoint

BOX = ["x0", "y0", "x1", "y1"]
#: Candidates, first in order, that are tried before all are ranked.
POOL = 4096


def centred(points: DataFrame, cuts: DataFrame, size: int) -> DataFrame:
    """For each point (cut_name, id, cx, cy) the tile around it, moved into its cut, and clipped where the cut is smaller: cut_name, id, box."""
    at = lambda c, extent: F.least(F.greatest(F.bround(F.col(c) - size / 2).cast("long"), F.lit(0)), F.greatest(F.col(extent).cast("long") - size, F.lit(0)))
    rows = points.join(grid.exchanged(cuts.select("cut_name", "width", "height")), "cut_name").withColumns({"x0": at("cx", "width"), "y0": at("cy", "height")})
    rows = rows.withColumns({"x1": F.least(F.col("x0") + size, F.col("width").cast("long")), "y1": F.least(F.col("y0") + size, F.col("height").cast("long"))})
    return rows.select("cut_name", "id", *BOX)


def points_in_boxes(boxes: DataFrame, points: DataFrame, size: int, key: str = "id") -> DataFrame:
    """``boxes`` (cut_name, a key, a box of about ``size``) with the points inside or on the border: n_points and their sorted ids.

    Both sides meet in cells as wide as a tile: four at most for a box, one for a point.
    """
    cell = lambda c: F.floor(F.col(c) / size)
    there = points.select(F.col("cut_name").alias("__cut"), F.col("id").alias("__id"), "cx", "cy", cell("cx").alias("__col"), cell("cy").alias("__row"))
    here = boxes.select("cut_name", key, *BOX).withColumn("__c", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("__r", F.explode(F.sequence(cell("y0"), cell("y1"))))
    same = (F.col("cut_name") == F.col("__cut")) & (F.col("__c") == F.col("__col")) & (F.col("__r") == F.col("__row"))
    inside = F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))
    found = here.join(there, same & inside).groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), F.array_sort(F.collect_list("__id")).alias("annotation_ids"))
    none = F.array().cast(found.schema["annotation_ids"].dataType)
    return boxes.join(found, key, "left").withColumns({"n_points": F.coalesce("n_points", F.lit(0).cast("long")), "annotation_ids": F.coalesce("annotation_ids", none)})


def passing(candidates: DataFrame, key: str, n: int, seed: int, measure: Callable[[DataFrame], DataFrame], least: float, what: str = "tiles", usable: Callable[[DataFrame, bool], DataFrame] | None = None) -> DataFrame:
    """The first ``n`` candidates in a seeded order whose tissue share, which ``measure`` adds as tissue_fraction, is enough; fewer are an error.

    ``usable`` makes of some candidates those that count, and learns whether these
    are few (at most POOL).  Each block that is measured is twice as large as what
    still lacks.
    """
    can_checkpoint(candidates.sparkSession)
    place = F.struct("__h", key)
    hashed = F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.lit(1), F.lit(8))  # in the order of its number, and made faster
    marked = candidates.withColumn("__h", hashed)
    first = marked.orderBy("__h", key).limit(POOL).checkpoint()
    last = first.agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("place")).first()
    more, rest = last.n == POOL, None
    if more:  # the last one's equals, if any, stay together in the rest
        at = F.struct(F.lit(last.place["__h"]).alias("__h"), F.lit(last.place[key]).cast(marked.schema[key].dataType).alias(key))
        first, rest = first.filter(place < at), marked.filter(place >= at)
    found, have = None, 0
    for some, few in ((first, True), (rest, False)):
        if have >= n or some is None:
            break
        some = (usable(some.drop("__h"), few) if usable else some.drop("__h")).withColumn("__h", hashed).checkpoint()
        order = some.withColumn("__k", F.row_number().over(Window.orderBy("__h", key))) if few else ranked(some, [F.col("__h"), F.col(key)], name="__k")
        order = order.checkpoint()
        done, total = 0, order.count()
        while have < n and done < total:
            block = 2 * (n - have)
            passed = measure(order.filter((F.col("__k") > done) & (F.col("__k") <= done + block))).filter(F.col("tissue_fraction") >= least).checkpoint()
            found = passed if found is None else found.unionByName(passed)
            have, done = have + passed.count(), done + block
    if have < n:
        raise ValueError(f"only {have} {what} pass; {n} are asked for")
    return found.orderBy("__h", key).limit(n).drop("__h", "__k")


def _of_cuts(df: DataFrame, some: DataFrame) -> DataFrame:
    """What belongs to the cuts of a few tiles."""
    return df.join(F.broadcast(some.select("cut_name").distinct()), "cut_name", "left_semi")  # POOL names at most


def positives(points: DataFrame, cuts: DataFrame, size: int, n: int, seed: int, measure: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """``n`` tiles around different points, with all points that each shows."""
    around = lambda some, few: centred(some.dropDuplicates(["id"]), _of_cuts(cuts, some) if few else cuts, size)
    some = passing(points, "id", n, seed, measure, least, f"positive tiles of {size}", around).checkpoint()
    return points_in_boxes(some, _of_cuts(points, some) if n <= POOL else points, size).withColumn("ground_truth", F.lit(True))


def negatives(points: DataFrame, cuts: DataFrame, size: int, n: int, seed: int, measure: Callable[[DataFrame], DataFrame], least: float, buffer: float, with_points: bool = False) -> DataFrame:
    """``n`` tiles of a grid without overlap that no point comes nearer than a share of their size, of all cuts or those with a point."""
    tiles = grid.tile_grid(cuts, [size], 0.0)
    tiles = tiles.withColumn("id", names.tile_id_at(F.col("cut_name"), F.lit(size), F.col("x0"), F.col("y0"))).select(*spatial.CELL, "id", *BOX)

    def free(some: DataFrame, few: bool) -> DataFrame:
        near, its = (_of_cuts(points, some).checkpoint(), _of_cuts(cuts, some)) if few else (points, cuts)
        alone = spatial.tiles_without_points(some, near, its, [size], 0.0, size * buffer)
        alone = alone.join(near.select("cut_name").distinct(), "cut_name", "left_semi") if with_points else alone
        return alone.select("cut_name", "id", *BOX)

    some = passing(tiles, "id", n, seed, measure, least, f"negative tiles of {size}", free)
    return some.withColumns({"n_points": F.lit(0).cast("long"), "annotation_ids": F.array().cast("array<string>"), "ground_truth": F.lit(False)})


def session_tiles(points: DataFrame, cuts: DataFrame, sizes: list[int], n_positive: int, n_negative: int, measure: Callable[[DataFrame], DataFrame], least: float = 0.2, buffer: float = 0.5, seed: int = 42) -> DataFrame:
    """The tiles of a session with their truth: tile_id, cut_name, tile_size, box, tissue_fraction, ground_truth, n_points, annotation_ids, candidate.

    Only cuts with a point take part.
    """
    if not sizes or min(sizes) < 1 or n_positive < 1 or n_negative < 1 or not 0 <= least <= 1 or buffer < 0:
        raise ValueError("a session needs sizes, tiles of both kinds, a tissue share in [0, 1] and a buffer that isn't negative")
    can_checkpoint(points.sparkSession)
    points = points.select("cut_name", F.col("id").cast("string").alias("id"), "cx", "cy").checkpoint()  # every size and kind reads them
    cuts = cuts.select("cut_name", "width", "height").repartition("cut_name").checkpoint()  # a small file is read by few tasks, and its tiles are many
    out = None
    for k, size in enumerate(sizes):
        both = positives(points, cuts, size, n_positive, seed + 2 * k, measure, least).unionByName(negatives(points, cuts, size, n_negative, seed + 2 * k + 1, measure, least, buffer, True))
        both = both.withColumn("tile_size", F.lit(size))
        out = both if out is None else out.unionByName(both)
    tile = names.tile_id_at(F.col("cut_name"), F.col("tile_size"), F.col("x0"), F.col("y0"))
    return out.select(tile.alias("tile_id"), "cut_name", "tile_size", *BOX, F.round("tissue_fraction", 6).alias("tissue_fraction"), "ground_truth", "n_points", "annotation_ids", F.col("id").alias("candidate"))


def session(tiles: DataFrame, session_id: str, tries: int = 512) -> DataFrame:
    """``tiles`` in the order in which they are shown, with names that tell nothing: session_id, display_index, png_filename, conflicts."""
    key = F.concat_ws(":", F.col("ground_truth").cast("string"), F.col("tile_size").cast("string"), "candidate")
    marked = tiles.withColumns({"session_id": F.lit(session_id), "__key": key})
    order = sampling.display_order(marked, "__key", "tile_size", "ground_truth", tries, "session_id")
    placed = marked.join(order.select("__key", (F.col("position") - 1).alias("display_index"), "conflicts"), "__key")
    return placed.withColumn("png_filename", F.format_string("tiles/tile_%04d.png", F.col("display_index") + 1)).drop("__key")


def shared(session: DataFrame) -> DataFrame:
    """What a reviewer gets: nothing that gives the truth away, and a blank label."""
    return session.select("session_id", "tile_id", "display_index", "png_filename", "tile_size", F.lit(None).cast("boolean").alias("collaborator_label"), F.lit(None).cast("timestamp").alias("labelled_at"))


def tissue_of(pictures: DataFrame, path_of_cut: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A measure from images of whole cuts (rows of the image source) and each cut's path (cut_name, path)."""

    def measure(boxes: DataFrame) -> DataFrame:
        rows = boxes.join(path_of_cut.select("cut_name", "path"), "cut_name").withColumn("tile_size", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("int"))
        cut = images.crop_tiles(pictures.join(rows.select(F.col("path").alias("__p")).distinct(), F.col("image.origin") == F.col("__p"), "left_semi"), rows)
        return cut.withColumn("tissue_fraction", images.tissue_share("pixels", "tile_size")).select(*boxes.columns, "tissue_fraction")

    return measure
