"""Queries of the tile operators over the given tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import labels as lab
from tessella.functions import names, rings
from tessella.operators import embeddings, grid, index, metrics, quality, reports, review, sampling, spatial, splits
from tessella.plans import views as V
from tessella.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = V.sql(oracle)
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def rounded(value: Column, places: int) -> Column:
    """``value`` with so many places; what rounds to zero keeps its sign, which ``round`` drops."""
    out = F.round(value, places)
    return F.when(out == 0, value * F.lit(0)).otherwise(out)


def of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return V.view(spark, sf_dir, text)


SIZES = [512, 1024]
GRID = f"""cut AS ({V.CUT}),
sized AS (SELECT * FROM cut, (VALUES (512, 410), (1024, 819)) s(tile_size, stride)),
ys AS (SELECT *, unnest(range(0, height, stride)) AS y0 FROM sized),
xs AS (SELECT *, unnest(range(0, width, stride)) AS x0 FROM ys),
tile AS (SELECT cut_name, width, height, tile_size, stride, y0 // stride AS "row", x0 // stride AS col, x0, y0, least(x0 + tile_size, width) AS x1, least(y0 + tile_size, height) AS y1 FROM xs)"""


def _tiles(spark, sf_dir):
    cuts = of(spark, sf_dir, V.CUT)
    return cuts, grid.tile_grid(cuts, SIZES)


# Grid and spatial joins


@query(f'WITH {GRID} SELECT cut_name, tile_size, "row", col, x0, y0, x1, y1, x0 + tile_size - x1 AS pad_right, y0 + tile_size - y1 AS pad_bottom FROM tile')
def tile_grid(spark, sf_dir):
    return _tiles(spark, sf_dir)[1]


@query(f"""WITH {GRID} SELECT cut_name, tile_size, "row", col, x0, y0, x1, y1, x0 + tile_size - x1 AS pad_right, y0 + tile_size - y1 AS pad_bottom FROM tile
WHERE (x0 = 0 OR x0 - stride + tile_size < width) AND (y0 = 0 OR y0 - stride + tile_size < height)""")
def tile_grid_edge_stop(spark, sf_dir):
    return grid.tile_grid(of(spark, sf_dir, V.CUT), SIZES, stop_at_edge=True)


@query(f"""WITH {GRID} SELECT cut_name, tile_size, "row", col, 2 * j + i AS quadrant, x0 + i * tile_size // 2 AS qx0, y0 + j * tile_size // 2 AS qy0, x0 + (i + 1) * tile_size // 2 AS qx1, y0 + (j + 1) * tile_size // 2 AS qy1
FROM tile, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) q(i, j)""")
def tile_quadrants(spark, sf_dir):
    return grid.quadrants(_tiles(spark, sf_dir)[1]).select("cut_name", "tile_size", "row", "col", "quadrant", "qx0", "qy0", "qx1", "qy1")


@query(f"""WITH {GRID}, p AS ({V.POINT}), hit AS (SELECT t.cut_name, t.tile_size, t."row", t.col, count(*) AS n_points FROM tile t JOIN p ON t.cut_name = p.cut_name AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY ALL)
SELECT t.cut_name, t.tile_size, t."row", t.col, coalesce(n_points, 0) AS n_points FROM tile t LEFT JOIN hit h ON t.cut_name = h.cut_name AND t.tile_size = h.tile_size AND t."row" = h."row" AND t.col = h.col""")
def point_in_tile(spark, sf_dir):
    cuts, tiles = _tiles(spark, sf_dir)
    return spatial.tiles_with_points(tiles, of(spark, sf_dir, V.POINT), cuts, SIZES).select("cut_name", "tile_size", "row", "col", "n_points")


@query(f"""WITH {GRID}, p AS ({V.POINT}), hit AS (SELECT t.cut_name, t.tile_size, t."row", t.col, count(cx) AS n FROM tile t LEFT JOIN p ON t.cut_name = p.cut_name AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY ALL)
SELECT tile_size, CASE WHEN n > 0 THEN 'positive' ELSE 'negative' END AS label, count(*) AS n_tiles, CAST(sum(n) AS BIGINT) AS n_points FROM hit GROUP BY ALL""")
def tile_labels_by_size(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts, tiles = _tiles(spark, sf_dir)
    t = spatial.tiles_with_points(tiles, of(spark, sf_dir, V.POINT), cuts, SIZES)
    label = lab.label_by("centroid", F.lit(None).cast("double"), F.col("n_points"), 0.05)
    return t.groupBy("tile_size", label.alias("label")).agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("n_points").alias("n_points"))


@query(f"""WITH {GRID}, p AS ({V.POINT}) SELECT cut_name, tile_size, "row", col FROM tile t WHERE NOT EXISTS
(SELECT 1 FROM p WHERE p.cut_name = t.cut_name AND cx BETWEEN x0 - 64 AND x1 + 64 AND cy BETWEEN y0 - 64 AND y1 + 64)""")
def tiles_without_points_buffered(spark, sf_dir):
    cuts, tiles = _tiles(spark, sf_dir)
    return spatial.tiles_without_points(tiles, of(spark, sf_dir, V.POINT), cuts, SIZES, 0.2, 64).select("cut_name", "tile_size", "row", "col")


COVER = f"""{GRID}, rect AS ({V.RECT}),
near AS (SELECT t.cut_name, t.tile_size, t."row", t.col, t.x0 AS a, t.y0 AS b, t.x1 AS c, t.y1 AS d, greatest(r.x0, t.x0) AS x0, greatest(r.y0, t.y0) AS y0, least(r.x1, t.x1) AS x1, least(r.y1, t.y1) AS y1
  FROM tile t JOIN rect r ON t.cut_name = r.cut_name AND r.x0 < t.x1 AND r.x1 > t.x0 AND r.y0 < t.y1 AND r.y1 > t.y0),
xe AS (SELECT DISTINCT cut_name, tile_size, "row", col, x FROM (SELECT cut_name, tile_size, "row", col, x0 AS x FROM near UNION ALL SELECT cut_name, tile_size, "row", col, x1 FROM near)),
strips AS (SELECT *, lead(x) OVER (PARTITION BY cut_name, tile_size, "row", col ORDER BY x) AS x2 FROM xe),
inside AS (SELECT s.cut_name, s.tile_size, s."row", s.col, s.x, s.x2, n.y0, n.y1 FROM strips s JOIN near n ON s.cut_name = n.cut_name AND s.tile_size = n.tile_size AND s."row" = n."row" AND s.col = n.col AND n.x0 <= s.x AND n.x1 >= s.x2 WHERE x2 IS NOT NULL),
reach AS (SELECT *, coalesce(max(y1) OVER (PARTITION BY cut_name, tile_size, "row", col, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y0) AS before FROM inside),
area AS (SELECT cut_name, tile_size, "row", col, sum((x2 - x) * greatest(0, y1 - greatest(y0, before))) AS area FROM reach GROUP BY ALL),
cover AS (SELECT t.cut_name, t.tile_size, t."row", t.col, coalesce(area, 0)::DOUBLE / ((x1 - x0) * (y1 - y0)) AS f FROM tile t LEFT JOIN area a ON t.cut_name = a.cut_name AND t.tile_size = a.tile_size AND t."row" = a."row" AND t.col = a.col)"""


def _outlines(spark, sf_dir):
    r = of(spark, sf_dir, V.RECT)
    return r.select("cut_name", "id", rings.ring(*[(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]).alias("ring"))


def _covered(spark, sf_dir):
    cuts, tiles = _tiles(spark, sf_dir)
    return spatial.tile_coverage(tiles, _outlines(spark, sf_dir), cuts, SIZES)


@query(f'WITH {COVER} SELECT cut_name, tile_size, "row", col, f AS area_fraction FROM cover')
def rect_coverage_fraction(spark, sf_dir):
    return _covered(spark, sf_dir).select("cut_name", "tile_size", "row", "col", "area_fraction")


@query(f"""WITH {COVER} SELECT tile_size, CASE WHEN f >= 0.05 AND f > 0 THEN 'positive' WHEN f > 0 THEN 'ambiguous' ELSE 'negative' END AS label, count(*) AS n FROM cover GROUP BY ALL""")
def label_bands(spark, sf_dir):
    return _covered(spark, sf_dir).groupBy("tile_size", lab.label_of(F.col("area_fraction"), 0.05).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {COVER} SELECT tile_size, count(*) AS n, count_if(f > 0) AS n_touched, count_if(f >= 0.05 AND f > 0) AS n_from_05, count_if(f >= 0.1 AND f > 0) AS n_from_10, count_if(f >= 0.25 AND f > 0) AS n_from_25, count_if(f >= 0.5 AND f > 0) AS n_from_50 FROM cover GROUP BY ALL""")
def threshold_grid_counts(spark, sf_dir):
    return reports.threshold_counts(_covered(spark, sf_dir), ["tile_size"], "area_fraction", [0.05, 0.1, 0.25, 0.5])


@query(f"""WITH {GRID}, rect AS ({V.RECT}), hit AS (SELECT t.tile_size, ((least(r.x1, t.x1) - greatest(r.x0, t.x0)) * (least(r.y1, t.y1) - greatest(r.y0, t.y0)))::DOUBLE / ((r.x1 - r.x0) * (r.y1 - r.y0)) AS v
FROM tile t JOIN rect r ON t.cut_name = r.cut_name AND r.x0 < t.x1 AND r.x1 > t.x0 AND r.y0 < t.y1 AND r.y1 > t.y0) SELECT tile_size, count(*) AS n, round(sum(v), 4) AS visible FROM hit WHERE v >= 0.3 GROUP BY ALL""")
def clipped_instances(spark, sf_dir):
    cuts, tiles = _tiles(spark, sf_dir)
    return spatial.clipped_instances(tiles, _outlines(spark, sf_dir), cuts, SIZES).groupBy("tile_size").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("visible"), 4).alias("visible"))


REMAP = f"""box AS (SELECT cut_name AS stem, k AS cut_index, concat(cut_name, '_', k) AS sub, (k * width) // 3 AS x0, 0 AS y0, ((k + 1) * width) // 3 + 20 AS x1, height AS y1 FROM cut, (VALUES (0), (1)) v(k)),
pair AS (SELECT r.cut_name AS stem, r.id, r.cx, r.cy, b.*, cx BETWEEN b.x0 AND b.x1 AND cy BETWEEN b.y0 AND b.y1 AS inside,
  greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) AS shared,
  (r.x0 BETWEEN b.x0 AND b.x1 AND r.y0 BETWEEN b.y0 AND b.y1)::INT + (r.x1 BETWEEN b.x0 AND b.x1 AND r.y0 BETWEEN b.y0 AND b.y1)::INT + (r.x1 BETWEEN b.x0 AND b.x1 AND r.y1 BETWEEN b.y0 AND b.y1)::INT + (r.x0 BETWEEN b.x0 AND b.x1 AND r.y1 BETWEEN b.y0 AND b.y1)::INT AS vertices
  FROM (SELECT *, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy FROM rect) r JOIN box b ON r.cut_name = b.stem),
best AS (SELECT *, count_if(inside) OVER (PARTITION BY stem, id) AS n_inside, row_number() OVER (PARTITION BY stem, id ORDER BY inside DESC, CASE WHEN inside THEN shared END DESC NULLS LAST, vertices DESC, cut_index) AS k FROM pair)"""


@query(f"""WITH cut AS ({V.CUT}), rect AS ({V.RECT}), {REMAP} SELECT stem, id, CASE WHEN n_inside = 0 AND vertices = 0 THEN NULL ELSE cut_index END AS cut_index,
CASE WHEN n_inside = 1 THEN 'centroid_in_bbox' WHEN n_inside > 1 THEN 'largest_overlap' WHEN vertices > 0 THEN 'vertex_in_bbox' ELSE 'unassigned' END AS method FROM best WHERE k = 1""")
def assign_annotation_to_cut(spark, sf_dir):
    cuts = of(spark, sf_dir, V.CUT)
    boxes = cuts.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        F.col("cut_name").alias("stem"), F.col("k").alias("cut_index"), F.concat_ws("_", "cut_name", "k").alias("cut_name"),
        F.floor(F.col("k") * F.col("width") / 3).alias("x0"), F.lit(0).alias("y0"), (F.floor((F.col("k") + 1) * F.col("width") / 3) + 20).alias("x1"), F.col("height").alias("y1"),
    )
    return spatial.assign_to_cuts(_outlines(spark, sf_dir).withColumnRenamed("cut_name", "stem"), boxes).select("stem", "id", "cut_index", "method")


@query(f"""WITH cut AS ({V.CUT}), rect AS ({V.RECT}), {REMAP}, m AS (SELECT stem, CASE WHEN n_inside = 1 THEN 'centroid_in_bbox' WHEN n_inside > 1 THEN 'largest_overlap' WHEN vertices > 0 THEN 'vertex_in_bbox' ELSE 'unassigned' END AS method FROM best WHERE k = 1)
SELECT method, count(*) AS n, count(DISTINCT stem) AS n_stems FROM m GROUP BY ROLLUP(method)""")
def remap_report(spark, sf_dir):
    return assign_annotation_to_cut(spark, sf_dir).rollup("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("n_stems"))


@query(f"""WITH rect AS ({V.RECT}), xe AS (SELECT DISTINCT cut_name, x FROM (SELECT cut_name, x0 AS x FROM rect UNION ALL SELECT cut_name, x1 FROM rect)),
strips AS (SELECT *, lead(x) OVER (PARTITION BY cut_name ORDER BY x) AS x2 FROM xe),
inside AS (SELECT s.cut_name, s.x, s.x2, n.y0, n.y1 FROM strips s JOIN rect n ON s.cut_name = n.cut_name AND n.x0 <= s.x AND n.x1 >= s.x2 WHERE x2 IS NOT NULL),
reach AS (SELECT *, coalesce(max(y1) OVER (PARTITION BY cut_name, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y0) AS before FROM inside),
area AS (SELECT cut_name, sum((x2 - x) * greatest(0, y1 - greatest(y0, before)))::DOUBLE AS united FROM reach GROUP BY ALL),
total AS (SELECT cut_name, sum((x1 - x0) * (y1 - y0))::DOUBLE AS total FROM rect GROUP BY ALL)
SELECT cut_name, total, round(united, 6) AS united, round(1 - united / nullif(total, 0), 6) AS overlap_fraction FROM total JOIN area USING (cut_name)""")
def box_overlap(spark, sf_dir):
    return spatial.box_overlap(of(spark, sf_dir, V.RECT), "cut_name").select("cut_name", "total", *r6("united", "overlap_fraction"))


@query(f"""WITH RECURSIVE r AS ({V.RECT}), b AS (SELECT *, (x1 - x0) * (y1 - y0) AS size, row_number() OVER (ORDER BY cut_name, id, x0, y0) AS n FROM r WHERE x1 > x0 AND y1 > y0),
s AS (SELECT i.n, j.n AS by_n FROM b i JOIN b j ON i.cut_name = j.cut_name AND j.size >= 2 * i.size AND greatest(0, least(i.x1, j.x1) - greatest(i.x0, j.x0)) * greatest(0, least(i.y1, j.y1) - greatest(i.y0, j.y0)) >= 0.7 * i.size),
p AS (SELECT n, list(by_n) AS above FROM s GROUP BY n), m AS (SELECT cut_name, list(struct_pack(n := b.n, id := id, above := above) ORDER BY size DESC, id, b.n) AS boxes FROM b LEFT JOIN p ON p.n = b.n GROUP BY cut_name),
w AS (SELECT cut_name, boxes, 0 AS k, []::BIGINT[] AS kept, []::VARCHAR[] AS ids FROM m UNION ALL
SELECT cut_name, boxes, k + 1, CASE WHEN list_has_any(kept, coalesce(boxes[k + 1].above, []::BIGINT[])) THEN kept ELSE list_append(kept, boxes[k + 1].n) END, CASE WHEN list_has_any(kept, coalesce(boxes[k + 1].above, []::BIGINT[])) THEN ids ELSE list_append(ids, boxes[k + 1].id) END FROM w WHERE k < len(boxes))
SELECT cut_name, unnest(ids) AS id FROM w WHERE k = len(boxes)""")
def suppressed_boxes(spark, sf_dir):
    return spatial.suppress_boxes(of(spark, sf_dir, V.RECT).select("cut_name", "id", "x0", "y0", "x1", "y1"), "cut_name", 0.7)


@query(f"""WITH rect AS ({V.RECT}), b AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM rect), k AS (SELECT *, row_number() OVER (PARTITION BY cut_name ORDER BY area DESC, id) AS k FROM b),
t AS (SELECT cut_name, id, x0, row_number() OVER (PARTITION BY cut_name ORDER BY x0, id) - 1 AS position FROM k WHERE k <= 5) SELECT * FROM t""")
def largest_boxes(spark, sf_dir):
    from pyspark.sql import Window

    r = of(spark, sf_dir, V.RECT).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    top = r.withColumn("k", F.row_number().over(Window.partitionBy("cut_name").orderBy(F.desc("area"), "id"))).filter("k <= 5")
    return top.select("cut_name", "id", "x0", (F.row_number().over(Window.partitionBy("cut_name").orderBy("x0", "id")) - 1).alias("position"))


# Outlines and names


@query(f"""WITH rect AS ({V.RECT}) SELECT cut_name, id, ((x1 - x0) * (y1 - y0) / 2.0)::DOUBLE AS area, round((x0 + x1 + x0) / 3.0, 6) AS cx, round((y0 + y0 + y1) / 3.0, 6) AS cy,
round((x1 - x0) + (y1 - y0) + sqrt(((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))::DOUBLE), 6) AS perimeter, (x1 - x0)::DOUBLE AS width, (y1 - y0)::DOUBLE AS height,
CASE WHEN x1 > x0 THEN 0.5::DOUBLE END AS coverage, round((x1 - x0)::DOUBLE / nullif(y1 - y0, 0), 6) AS aspect FROM rect""")
def ring_measures(spark, sf_dir):
    """Of the triangle in each box's upper left half."""
    r = of(spark, sf_dir, V.RECT).withColumn("ring", rings.ring((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x0"), F.col("y1"))))
    c, b, m = rings.vertex_centroid(F.col("ring")), rings.bounds(F.col("ring")), rings.box_metrics(F.col("ring"))
    out = r.select("cut_name", "id", "ring", c.alias("c"), b.alias("b"), m.alias("m"))
    return out.select(
        "cut_name", "id", rings.area(F.col("ring")).alias("area"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), F.round(rings.perimeter(F.col("ring")), 6).alias("perimeter"),
        (F.col("b.x1") - F.col("b.x0")).alias("width"), (F.col("b.y1") - F.col("b.y0")).alias("height"), F.round("m.coverage", 6).alias("coverage"), F.round("m.aspect", 6).alias("aspect"),
    )


@query(f"""WITH p AS ({V.POINT}) SELECT cut_name, id, (cx + 0.25 - 100)::DOUBLE AS x, (cy - 0.5 - 50)::DOUBLE AS y FROM p""")
def translate_ring(spark, sf_dir):
    p = of(spark, sf_dir, V.POINT)
    r = rings.translate(rings.ring((F.col("cx") + F.lit(0.25), F.col("cy") - F.lit(0.5))), F.lit(100), F.lit(50))
    return p.select("cut_name", "id", F.round(r[0]["x"], 6).alias("x"), F.round(r[0]["y"], 6).alias("y"))


@query(f"""WITH s AS ({V.STEM}) SELECT stem, regexp_replace(stem, '_[^_]*$', '') AS specimen, split_part(stem, '_', 1) AS site, split_part(stem, '_', 2) AS season, split_part(stem, '_', 4) AS slice_range,
(s_suppkey % 7 + 1)::INT AS n_cuts, concat(stem, '_cut001') AS cut_name, stem AS stem_again FROM s""")
def stem_names(spark, sf_dir):
    s = of(spark, sf_dir, V.STEM)
    p = names.stem_parts(F.col("stem"))
    cut = F.concat("stem", F.lit("_cut001"))
    return s.select("stem", names.specimen_of(F.col("stem")).alias("specimen"), names.site_of(F.col("stem")).alias("site"), p["season"].alias("season"), p["slice_range"].alias("slice_range"), names.cut_count(F.col("stem")).alias("n_cuts"), cut.alias("cut_name"), names.stem_of_cut(cut).alias("stem_again"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END::INT AS stage, CASE WHEN p_size % 3 = 0 THEN 'Unlabelled' ELSE concat('Stage ', p_size) END AS stage_label FROM {part}""")
def stage_numbers(spark, sf_dir):
    p = of(spark, sf_dir, "SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN p_name ELSE concat('see STAGE  ', p_size, ' here') END AS note FROM {part}")
    p = p.withColumn("note", F.when(F.col("p_size") % 3 == 0, F.regexp_replace("note", "(?i)stage", "")).otherwise(F.col("note")))
    n = names.stage_number(F.lit(None).cast("string"), F.col("note"))
    return p.select("p_partkey", n.alias("stage"), names.stage_label(n).alias("stage_label"))


@query(f"""WITH {GRID} SELECT printf('%s_s%04d_r%04d_c%04d', cut_name, tile_size, "row", col) AS tile_id FROM tile""")
def tile_ids(spark, sf_dir):
    return grid.with_tile_ids(_tiles(spark, sf_dir)[1]).select("tile_id")


# Metrics


@query(f"""WITH p AS ({V.PRED}), t AS (SELECT split, prob, sum(y) AS tp, sum(1 - y) AS fp FROM p GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY split) AS p, sum(fp) OVER (PARTITION BY split) AS n FROM t WINDOW w AS (PARTITION BY split ORDER BY prob DESC))
SELECT split, round(sum(tp::DOUBLE / p * ctp / (ctp + cfp)), 6) AS average_precision, round(sum(fp * (ctp - tp / 2.0))::DOUBLE / (max(p) * max(n)), 6) AS roc_auc FROM r GROUP BY split""")
def ranking_scores(spark, sf_dir):
    return metrics.ranking_scores(of(spark, sf_dir, V.PRED), ["split"]).select("split", *r6("average_precision", "roc_auc"))


@query(f"""WITH p AS ({V.PRED}), t AS (SELECT prob, sum(y) AS tp, sum(1 - y) AS fp FROM p GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM t WINDOW w AS (ORDER BY prob DESC))
SELECT round(sum(tp::DOUBLE / p * ctp / (ctp + cfp)), 6) AS average_precision, round(sum(fp * (ctp - tp / 2.0))::DOUBLE / (max(p) * max(n)), 6) AS roc_auc FROM r""")
def ranking_scores_overall(spark, sf_dir):
    return metrics.ranking_scores(of(spark, sf_dir, V.PRED), []).select(*r6("average_precision", "roc_auc"))


BEST = """t AS (SELECT split, prob, sum(y) AS tp, sum(1 - y) AS fp FROM p GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY split) AS p FROM t WINDOW w AS (PARTITION BY split ORDER BY prob DESC)),
f AS (SELECT *, 2.0::DOUBLE * ctp / (ctp + cfp + p) AS f1 FROM r), best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY split ORDER BY f1 DESC, prob) = 1)"""


@query(f"WITH p AS ({V.PRED}), {BEST} SELECT split, round(prob, 6) AS threshold, round(f1, 6) AS f1, 'max_val_f1' AS source FROM best")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_threshold(of(spark, sf_dir, V.PRED), ["split"]).select("split", *r6("threshold", "f1"), "source")


CONF = """c AS (SELECT split, count_if(y = 1 AND prob >= 0.4) AS n_tp, count_if(y = 0 AND prob >= 0.4) AS n_fp, count_if(y = 1 AND prob < 0.4) AS n_fn, count_if(y = 0 AND prob < 0.4) AS n_tn FROM p GROUP BY split),
m AS (SELECT *, n_tp::DOUBLE AS tp, n_fp::DOUBLE AS fp, n_fn::DOUBLE AS fn, n_tn::DOUBLE AS tn FROM c)"""


@query(f"""WITH p AS ({V.PRED}), {CONF} SELECT split, n_tp, n_fp, n_fn, n_tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS mcc FROM m""")
def confusion_metrics(spark, sf_dir):
    c = metrics.confusion(of(spark, sf_dir, V.PRED), ["split"], F.lit(0.4))
    return metrics.point_scores(c).select("split", "n_tp", "n_fp", "n_fn", "n_tn", *r6("precision", "recall", "f1", "accuracy", "balanced_accuracy", "mcc"))


@query(f"""WITH p AS ({V.PRED}), o AS (SELECT CASE WHEN tile_id % 11 = 0 THEN 'not scored' WHEN tile_id % 13 = 0 THEN 'no prediction' WHEN y = 1 AND prob >= 0.4 THEN 'TP' WHEN y = 1 THEN 'FN' WHEN prob >= 0.4 THEN 'FP' ELSE 'TN' END AS outcome FROM p)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def outcome_classes(spark, sf_dir):
    p = of(spark, sf_dir, V.PRED)
    label = F.when(F.col("tile_id") % 11 == 0, "ambiguous").when(F.col("y") == 1, "positive").otherwise("negative")
    prob = F.when(F.col("tile_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("prob"))
    return p.groupBy(lab.outcome(label, prob, F.lit(0.4)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS ({V.PRED}) SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, round(sum(y)::DOUBLE / count(*), 6) AS positive_rate, round(1 - sum(y)::DOUBLE / count(*), 6) AS all_negative_accuracy FROM p GROUP BY split")
def trivial_baseline(spark, sf_dir):
    return metrics.split_summary(of(spark, sf_dir, V.PRED), ["split"]).select("split", "n", "n_positive", *r6("positive_rate", "all_negative_accuracy"))


@query(f"""WITH p AS ({V.PRED}), t AS (SELECT fold, prob, sum(y) AS tp, sum(1 - y) AS fp FROM p GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY fold) AS p FROM t WINDOW w AS (PARTITION BY fold ORDER BY prob DESC)),
a AS (SELECT fold, sum(tp::DOUBLE / p * ctp / (ctp + cfp)) AS ap FROM r GROUP BY fold), v AS (SELECT fold, avg(y) AS prevalence FROM p GROUP BY fold)
SELECT fold, round(prevalence, 6) AS prevalence, round(ap, 6) AS average_precision, round(ap / prevalence, 6) AS lift, ap IS NULL AS is_undefined FROM a JOIN v USING (fold)""")
def fold_summary(spark, sf_dir):
    return metrics.fold_scores(of(spark, sf_dir, V.PRED)).select("fold", *r6("prevalence", "average_precision", "lift"), "is_undefined")


@query(f"""WITH p AS ({V.PRED}), v AS (SELECT specimen, avg(prob) AS m, max(prob) AS x FROM p GROUP BY specimen), l AS (SELECT 'm' AS metric, m AS value FROM v UNION ALL SELECT 'x', x FROM v)
SELECT metric, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, count(value) AS n_defined FROM l GROUP BY metric""")
def cv_summary(spark, sf_dir):
    v = of(spark, sf_dir, V.PRED).groupBy("specimen").agg(F.avg("prob").alias("m"), F.max("prob").alias("x"))
    return metrics.summarise(v, ["m", "x"]).select("metric", *r6("mean", "least", "most", "q25", "q75"), "n_defined")


@query(f"""WITH p AS (SELECT * FROM ({V.PRED}) WHERE split = 'test'), u AS (SELECT DISTINCT specimen FROM p), k AS (SELECT specimen, row_number() OVER (ORDER BY specimen) - 1 AS k, count(*) OVER () AS n FROM u),
slots AS (SELECT rep, s.k AS slot, n FROM range(20) r(rep), k s), d AS (SELECT rep, ('0x' || substr(md5(concat_ws(':', '7', rep, slot)), 1, 8))::BIGINT % n AS k FROM slots),
draws AS (SELECT rep, specimen, count(*) AS times FROM d JOIN k USING (k) GROUP BY ALL),
t AS (SELECT rep, prob, sum(y * times) AS tp, sum((1 - y) * times) AS fp FROM p JOIN draws USING (specimen) GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY rep) AS p FROM t WINDOW w AS (PARTITION BY rep ORDER BY prob DESC)),
a AS (SELECT rep, sum(tp::DOUBLE / p * ctp / nullif(ctp + cfp, 0)) AS average_precision FROM r GROUP BY rep),
c AS (SELECT rep, sum(CASE WHEN y = 1 AND prob >= 0.4 THEN times ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y = 0 AND prob >= 0.4 THEN times ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN y = 1 AND prob < 0.4 THEN times ELSE 0 END)::DOUBLE AS fn FROM p JOIN draws USING (specimen) GROUP BY rep),
l AS (SELECT 'average_precision' AS metric, average_precision AS v FROM a UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM c UNION ALL SELECT 'recall', tp / (tp + fn) FROM c)
SELECT 20::BIGINT AS n_usable, metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM l GROUP BY metric""")
def bootstrap_ci(spark, sf_dir):
    p = of(spark, sf_dir, V.PRED).filter("split = 'test'")
    return metrics.bootstrap_interval(p, "specimen", 0.4, 20, 7).select("n_usable", "metric", *r6("low", "high"))


@query()
def bootstrap_ci_2000(spark, sf_dir):
    """The whole interval: 2000 replicates."""
    p = of(spark, sf_dir, V.PRED).filter("split = 'test'")
    return metrics.bootstrap_interval(p, "specimen", 0.4, 2000, 7).select("n_usable", "metric", *r6("low", "high"))


# Splits


@query(f"""WITH s AS ({V.STEM}), o AS (SELECT stem, split_part(stem, '_', 1) AS stratum, row_number() OVER (PARTITION BY split_part(stem, '_', 1) ORDER BY ('0x' || substr(md5('42:' || stem), 1, 8))::BIGINT, stem) AS k FROM s)
SELECT stem, stratum, CASE WHEN k <= 1 THEN 'val' WHEN k <= 2 THEN 'test' ELSE 'train' END AS split FROM o""")
def stratified_quota_split(spark, sf_dir):
    s = of(spark, sf_dir, V.STEM).select("stem", names.site_of(F.col("stem")).alias("stratum"))
    sizes = s.groupBy("stratum").count().collect()  # five regions
    return splits.quota_split(s, {r[0]: (1, min(1, r[1] - 1)) for r in sizes}, 42)


INDEX = f"""SELECT specimen, split_part(specimen, '_', 1) AS site, concat('S', tile_id % 97) AS stem, CASE WHEN tile_id % 2 = 0 THEN 512 ELSE 1024 END AS tile_size,
 CASE WHEN y = 1 THEN 'positive' WHEN prob > 0.9 THEN 'ambiguous' ELSE 'negative' END AS label, split, fold, tile_id FROM ({V.PRED}) p"""


@query(f"""WITH i AS ({INDEX}) SELECT specimen, site, list_sort(list(DISTINCT stem)) AS slides, count_if(tile_size = 512) AS tiles_512, count_if(tile_size = 512 AND label = 'positive') AS positives_512, count_if(tile_size = 512 AND label = 'ambiguous') AS ambiguous_512,
count_if(tile_size = 1024) AS tiles_1024, count_if(tile_size = 1024 AND label = 'positive') AS positives_1024, count_if(tile_size = 1024 AND label = 'ambiguous') AS ambiguous_1024 FROM i GROUP BY specimen, site""")
def specimen_counts(spark, sf_dir):
    return splits.specimen_counts(of(spark, sf_dir, INDEX), [512, 1024])


@query(f"""WITH i AS ({INDEX}) SELECT stem, list_sort(list(DISTINCT split)) AS splits FROM i GROUP BY stem HAVING count(DISTINCT split) > 1""")
def straddling_units(spark, sf_dir):
    return splits.straddling(of(spark, sf_dir, INDEX), "stem")


COUNTS = f"WITH i AS ({INDEX}) SELECT concat('K', tile_id % 7) AS specimen, CAST(count_if(tile_size = 512) AS BIGINT) AS tiles_512, CAST(count_if(tile_size = 512 AND label = 'positive') AS BIGINT) AS positives_512, CAST(tile_id % 7 % 3 AS BIGINT) AS fold FROM i GROUP BY tile_id % 7"


@query(f"""WITH c AS ({COUNTS}), n AS (SELECT *, row_number() OVER (ORDER BY specimen) - 1 AS k FROM c), ids AS (SELECT range AS id FROM range(2187)),
a AS (SELECT id, specimen, tiles_512, positives_512, (id // CAST(pow(3, 6 - k) AS BIGINT)) % 3 AS fold FROM ids, n),
f AS (SELECT id, fold, sum(tiles_512) AS t, sum(positives_512) AS p FROM a GROUP BY ALL),
g AS (SELECT id, max(p::DOUBLE / t) - min(p::DOUBLE / t) AS spread FROM f GROUP BY id HAVING count(*) = 3 AND min(p) >= 5 AND max(t) <= 2 * min(t)),
b AS (SELECT * FROM g ORDER BY spread, id LIMIT 1)
SELECT round(spread, 6) AS spread, specimen, fold::INT AS fold FROM b JOIN a USING (id)""")
def fold_search(spark, sf_dir):
    return splits.fold_search(of(spark, sf_dir, COUNTS), 3, 5, 2.0, [512]).select(*r6("spread"), "specimen", "fold")


@query(f"""WITH c AS ({COUNTS}), t AS (SELECT sum(positives_512)::DOUBLE / sum(tiles_512) AS c FROM c)
SELECT fold, arg_min(specimen, (abs(positives_512::DOUBLE / tiles_512 - c), specimen)) AS inner_val_specimen FROM c, t WHERE positives_512 > 0 GROUP BY fold""")
def inner_val_specimen(spark, sf_dir):
    return splits.inner_val(of(spark, sf_dir, COUNTS), F.col("positives_512") > 0, "positives_512", "tiles_512", ["fold"])


@query(f"WITH c AS ({COUNTS}) SELECT fold, CAST(sum(tiles_512) AS BIGINT) AS tiles, CAST(sum(positives_512) AS BIGINT) AS positives, round_even(sum(positives_512)::DOUBLE / sum(tiles_512), 4) AS positive_rate FROM c GROUP BY fold")
def fold_rollup(spark, sf_dir):
    return splits.fold_rollup(of(spark, sf_dir, COUNTS), 512)


@query(f"""WITH c AS ({COUNTS}), t AS (SELECT sum(positives_512)::DOUBLE / sum(tiles_512) AS c FROM c), v AS (SELECT fold AS f, arg_min(specimen, (abs(positives_512::DOUBLE / tiles_512 - c), specimen)) AS specimen FROM c, t GROUP BY fold)
SELECT h.fold AS held_out, c.specimen AS stem, c.specimen, c.fold, CASE WHEN c.fold = h.fold THEN 'test' WHEN v.f IS NOT NULL AND v.f <> h.fold THEN 'val' ELSE 'train' END AS split FROM c CROSS JOIN (SELECT DISTINCT fold FROM c) h LEFT JOIN v ON c.specimen = v.specimen""")
def fold_splits(spark, sf_dir):
    c = of(spark, sf_dir, COUNTS)
    inner = splits.inner_val(c, F.lit(True), "positives_512", "tiles_512", ["fold"])
    return splits.fold_splits(c.select(F.col("specimen").alias("stem"), "specimen", "fold"), inner)


@query(f"""WITH i AS ({INDEX}), e AS (SELECT DISTINCT specimen, CASE WHEN fold = 0 THEN 'test' ELSE split END AS split FROM i), g AS (SELECT DISTINCT specimen, split FROM i)
SELECT *, 'unexpected' AS side FROM (SELECT * FROM g EXCEPT SELECT * FROM e) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM g)""")
def fold_isolation(spark, sf_dir):
    i = of(spark, sf_dir, INDEX)
    return splits.isolation_breaks(i, i.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise(F.col("split"))))


@query(f"""WITH i AS ({INDEX}), g AS (SELECT tile_id FROM i WHERE fold < 3 UNION ALL SELECT tile_id FROM i WHERE fold = 0), t AS (SELECT tile_id, count(*) AS times FROM g GROUP BY ALL)
SELECT tile_id, coalesce(times, 0) AS times, e.tile_id IS NOT NULL AS expected FROM (SELECT DISTINCT tile_id FROM i) e FULL JOIN t USING (tile_id) WHERE e.tile_id IS NULL OR coalesce(times, 0) <> 1""")
def coverage_once(spark, sf_dir):
    i = of(spark, sf_dir, INDEX)
    return splits.coverage_breaks(i, i.filter("fold < 3").select("tile_id").unionByName(i.filter("fold = 0").select("tile_id")), "tile_id")


# Quality


@query("""WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM {events}), c AS (SELECT event_type, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
k AS (SELECT event_type, v, 100 * (sum(n) OVER (PARTITION BY event_type ORDER BY v) - (n - 1) / 2.0) / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_id, round(p, 6) AS percentile FROM v LEFT JOIN k ON v.event_type = k.event_type AND v.v = k.v""")
def percentile_rank_avg(spark, sf_dir):
    e = of(spark, sf_dir, "SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM {events}")
    return quality.percentile_rank(e, "v", ["event_type"]).select("event_id", *r6("percentile"))


MEDIANS = "SELECT user_id, quantile_cont(CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END, 0.5) AS median_v, count(CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END) AS n_v FROM {events} GROUP BY user_id"


def _medians(spark, sf_dir):
    e = of(spark, sf_dir, "SELECT user_id, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM {events}")
    return quality.group_medians(e, "user_id", ["v"])


@query(f"SELECT user_id, round(median_v, 6) AS median_v, n_v FROM ({MEDIANS})")
def group_median(spark, sf_dir):
    return _medians(spark, sf_dir).select("user_id", *r6("median_v"), "n_v")


@query(f"""WITH m AS ({MEDIANS}), c AS (SELECT quantile_cont(median_v, 0.5) AS c FROM m WHERE n_v >= 10 AND median_v IS NOT NULL AND user_id % 9 <> 0)
SELECT user_id, round(median_v / c, 6) AS ratio, CASE WHEN n_v < 10 OR median_v IS NULL THEN 'too few tiles' WHEN median_v / c < 0.5 THEN 'blurred' ELSE '' END AS flag FROM m, c""")
def flag_vs_median(spark, sf_dir):
    m = _medians(spark, sf_dir).withColumn("listed", F.col("user_id") % 9 == 0)
    return quality.flag_groups(m, "user_id", "median_v", "n_v", 0.5, 10, "listed").select("user_id", *r6("ratio"), "flag")


HASH = "('0x' || substr(md5(concat('{seed}:', {key})), 1, 8))::BIGINT"


@query(f"SELECT event_id, user_id FROM {{events}} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {HASH.format(seed=5, key='event_id')}, event_id) <= 3")
def sample_per_group(spark, sf_dir):
    return quality.sample_per_group(of(spark, sf_dir, "SELECT event_id, user_id FROM {events}"), "user_id", "event_id", 3, 5)


# Sampling


@query(f"""WITH p AS ({V.PRED}), n AS (SELECT count(*) AS n, sum(y) AS p FROM p), q AS (SELECT least(p, greatest(1, round_even(500 * p::DOUBLE / n, 0)), 499)::BIGINT AS np FROM n)
SELECT tile_id, y FROM p, q QUALIFY row_number() OVER (PARTITION BY y ORDER BY {HASH.format(seed=3, key='tile_id')}, tile_id) <= CASE WHEN y = 1 THEN np ELSE 500 - np END""")
def stratified_subsample(spark, sf_dir):
    return sampling.stratified_subsample(of(spark, sf_dir, V.PRED), 500, 3, "tile_id").select("tile_id", "y")


@query(f"WITH p AS (SELECT * FROM ({V.PRED}) WHERE y = 0), n AS (SELECT ceil(count(*) * 0.1) AS k FROM p) SELECT tile_id, round(prob, 6) AS prob FROM p, n QUALIFY row_number() OVER (ORDER BY prob DESC, tile_id) <= k")
def hard_negative_pool(spark, sf_dir):
    """Of the negatives alone, those that score highest."""
    return sampling.hard_pool(of(spark, sf_dir, V.PRED).filter("y = 0"), "prob", "tile_id", 0.1).select("tile_id", *r6("prob"))


@query()
def ratio_batches(spark, sf_dir):
    return sampling.ratio_batches(of(spark, sf_dir, V.PRED), 16, 0.25, 40, 9, "tile_id")


@query(f"""WITH p AS ({V.PRED}), n AS (SELECT count(*) - sum(y) AS negatives FROM p)
SELECT unnest(range(greatest(1, CAST(negatives AS BIGINT) // 9))) AS batch, 16::BIGINT AS batch_size, 4::BIGINT AS n_positive, 12::BIGINT AS n_negative, 3::BIGINT AS n_hard_negative FROM n""")
def batch_composition(spark, sf_dir):
    """The log of an epoch, whose length follows from the table: a quarter of the negatives are hard, nine are uniform."""
    p = of(spark, sf_dir, V.PRED)
    hard = sampling.hard_pool(p.filter("y = 0"), "prob", "tile_id", 0.1)
    return sampling.composition(sampling.ratio_batches(p, 16, 0.25, None, 9, "tile_id", hard=hard, share=0.25), ["batch"])


SHOWN = "SELECT doc_id AS tile_id, doc_id % 23 AS session, CASE doc_id % 4 WHEN 0 THEN 128 WHEN 1 THEN 256 WHEN 2 THEN 512 ELSE 1024 END AS tile_size, quality AS label FROM {labels}"


@query(f"""WITH s AS ({SHOWN}), o AS (SELECT *, t, row_number() OVER w AS position, (CASE WHEN tile_size = lag(tile_size) OVER w THEN 1 ELSE 0 END) + (CASE WHEN label = lag(label) OVER w THEN 1 ELSE 0 END) AS clash FROM s, range(8) r(t) WINDOW w AS (PARTITION BY session, t ORDER BY md5(concat(t, ':', tile_id)), tile_id)),
c AS (SELECT session, t, sum(clash) AS conflicts FROM o GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY conflicts, t) = 1)
SELECT o.session, tile_id, position, CAST(conflicts AS BIGINT) AS conflicts FROM o JOIN b ON o.session = b.session AND o.t = b.t""")
def display_order(spark, sf_dir):
    return sampling.display_order(of(spark, sf_dir, SHOWN), "tile_id", "tile_size", "label", 8, twice=True)


@query()
def display_order_512(spark, sf_dir):
    """The whole search: 512 orders, one conflict for each pair of neighbours."""
    return sampling.display_order(of(spark, sf_dir, SHOWN), "tile_id", "tile_size", "label")


@query(f"""WITH s AS ({SHOWN}), k AS (SELECT tile_size, least(4, count_if(label = 1), count_if(label <> 1)) AS m FROM s GROUP BY tile_size)
SELECT s.tile_id, s.tile_size, label = 1 AS has FROM s JOIN k USING (tile_size) QUALIFY row_number() OVER (PARTITION BY s.tile_size, label = 1 ORDER BY {HASH.format(seed=2, key='tile_id')}, tile_id) <= m""")
def paired_sample(spark, sf_dir):
    s = of(spark, sf_dir, SHOWN).select("tile_id", "tile_size", (F.col("label") == 1).alias("has"))
    return sampling.paired_sample(s, "tile_size", "has", 4, 2, "tile_id")


# Review


@query(f"""WITH r AS (SELECT tile_size, ground_truth AS g, coalesce(collaborator_label, false) AS s FROM ({V.REVIEW}) v), c AS (SELECT tile_size, count(*) AS n, count_if(s AND g) AS n_tp, count_if(NOT s AND NOT g) AS n_tn, count_if(s AND NOT g) AS n_fp, count_if(NOT s AND g) AS n_fn FROM r GROUP BY tile_size)
SELECT *, round((n_tp + n_tn)::DOUBLE / n, 6) AS accuracy, round(n_tp::DOUBLE / nullif(n_tp + n_fn, 0), 6) AS sensitivity, round(n_tn::DOUBLE / nullif(n_tn + n_fp, 0), 6) AS specificity FROM c""")
def review_metrics(spark, sf_dir):
    m = review.review_metrics(of(spark, sf_dir, V.REVIEW), ["tile_size"])
    return m.select("tile_size", "n", "n_tp", "n_tn", "n_fp", "n_fn", *r6("accuracy", "sensitivity", "specificity"))


@query(f"SELECT ground_truth, collaborator_label, count(*) AS n FROM ({V.REVIEW}) v GROUP BY ALL")
def review_confusion(spark, sf_dir):
    return review.confusion_with_missing(of(spark, sf_dir, V.REVIEW))


@query(f"SELECT tile_size, count_if(ground_truth) AS n_positive, count_if(NOT ground_truth) AS n_negative, count(collaborator_label) AS n_labelled, round(count(collaborator_label)::DOUBLE / count(*), 6) AS progress FROM ({V.REVIEW}) v GROUP BY tile_size")
def review_progress(spark, sf_dir):
    return review.session_summary(of(spark, sf_dir, V.REVIEW)).select("tile_size", "n_positive", "n_negative", "n_labelled", *r6("progress"))


@query(f"SELECT v.tile_id, v.tile_size, v.ground_truth, v.collaborator_label FROM ({V.REVIEW}) v")
def review_join(spark, sf_dir):
    r = of(spark, sf_dir, V.REVIEW)
    tiles, given = r.select("tile_id", "display_index", "tile_size", "ground_truth"), r.select("tile_id", "display_index", "collaborator_label")
    return review.strict_join(tiles, given).select("tile_id", "tile_size", "ground_truth", "collaborator_label")


@query(f"""WITH r AS ({V.REVIEW}), a AS (SELECT tile_id, display_index FROM r WHERE tile_id % 5 <> 0), b AS (SELECT tile_id, display_index + CASE WHEN tile_id % 7 = 0 THEN 1 ELSE 0 END AS display_index FROM r WHERE tile_id % 6 <> 0)
SELECT tile_id, CASE WHEN a.tile_id IS NULL THEN 'label without tile' WHEN b.tile_id IS NULL THEN 'tile without label' ELSE 'other display index' END AS reason FROM a FULL JOIN b USING (tile_id) WHERE a.display_index IS DISTINCT FROM b.display_index""")
def review_join_breaks(spark, sf_dir):
    r = of(spark, sf_dir, V.REVIEW)
    moved = F.col("display_index") + F.when(F.col("tile_id") % 7 == 0, 1).otherwise(0)
    return review.join_breaks(r.filter("tile_id % 5 <> 0").select("tile_id", "display_index"), r.filter("tile_id % 6 <> 0").select("tile_id", moved.alias("display_index")))


@query(f"""WITH r AS (SELECT *, tile_id % 19 AS session FROM ({V.REVIEW}) v) SELECT session, display_index, coalesce(min(CASE WHEN collaborator_label IS NULL THEN display_index END) OVER (PARTITION BY session ORDER BY display_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
min(CASE WHEN collaborator_label IS NULL THEN display_index END) OVER (PARTITION BY session)) AS next_index FROM r""")
def next_unlabelled(spark, sf_dir):
    r = of(spark, sf_dir, V.REVIEW).withColumn("session", F.col("tile_id") % 19)
    return review.next_unlabelled(r).select("session", "display_index", "next_index")


GIVEN = "SELECT user_id AS tile_id, ts AS labelled_at, event_type AS label, user_id % 5 AS reviewer FROM {events}"


@query(f"SELECT tile_id, arg_max(label, (labelled_at, label)) AS label FROM ({GIVEN}) g GROUP BY tile_id")
def latest_label(spark, sf_dir):
    return review.latest_labels(of(spark, sf_dir, GIVEN)).select("tile_id", "label")


@query(f"SELECT tile_id, arg_max(label, (labelled_at, label)) AS label FROM ({GIVEN}) g GROUP BY tile_id")
def latest_label_stream(spark, sf_dir):
    """The streaming operator in its batch form; the tests run it over a file stream."""
    return streams.latest_label_stream(of(spark, sf_dir, GIVEN)).select("tile_id", "label")


@query(f"SELECT time_bucket(INTERVAL 10 minutes, labelled_at) AS start, count(*) AS n FROM ({GIVEN}) g GROUP BY ALL")
def labels_by_window(spark, sf_dir):
    return streams.labels_by_window(of(spark, sf_dir, GIVEN)).select("start", "n")


@query("""SELECT CAST(extract(day FROM ts) AS INT) AS epoch, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, count(*) AS n_rows, round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS positive_fraction FROM {events} GROUP BY ALL""")
def running_fraction(spark, sf_dir):
    log = of(spark, sf_dir, "SELECT day(ts) AS epoch, hour(ts) AS batch_index, CAST(count(*) AS BIGINT) AS batch_size, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM {events} GROUP BY 1, 2")
    return streams.running_fraction(log).select("epoch", "n_positive", "n_rows", *r6("positive_fraction"))


# Reports


@query(f"""WITH m AS ({V.META}) SELECT site, count(*) AS n_cuts, count(DISTINCT (season, polyp)) AS n_specimens, count(DISTINCT image) AS n_images, count(DISTINCT season) AS n_seasons, count_if(flag = 'Yes') AS n_yes, count_if(flag = 'No') AS n_no,
round(count_if(flag = 'Yes')::DOUBLE / count(*), 6) AS rate, CAST(min(CAST(day AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(day AS DATE)) AS VARCHAR) AS last_day FROM m GROUP BY ROLLUP(site)""")
def site_rollup(spark, sf_dir):
    r = reports.site_overview(of(spark, sf_dir, V.META))
    return r.withColumns({"rate": F.round("rate", 6), "first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string")})


@query(f"""WITH m AS ({V.META}), d AS (SELECT * FROM (VALUES (0, 'Spring'), (1, 'Summer'), (2, 'Autumn'), (3, 'Winter')) v(position, season))
SELECT position, d.season, count_if(flag = 'Yes') AS n_yes, count_if(flag = 'No') AS n_no, count(flag) AS total, round(100.0::DOUBLE * count_if(flag = 'Yes') / nullif(count(flag), 0), 6) AS percent FROM d LEFT JOIN m ON d.season = m.season GROUP BY ALL""")
def season_pivot(spark, sf_dir):
    r = reports.season_pivot(of(spark, sf_dir, V.META))
    return r.withColumn("percent", F.round("percent", 6))


RATES = f"WITH m AS ({V.META}), r AS (SELECT site, season, polyp, count(*) AS n, count_if(flag = 'Yes') AS n_yes, count_if(flag = 'Yes')::DOUBLE / count(*) AS rate FROM m GROUP BY ALL)"


@query(f"{RATES} SELECT site, season, polyp, n, n_yes, round(rate, 6) AS rate FROM r")
def specimen_rates(spark, sf_dir):
    return reports.specimen_rates(of(spark, sf_dir, V.META)).withColumn("rate", F.round("rate", 6))


@query(f"{RATES} SELECT site, count(*) AS n, count_if(rate = 0) AS n_zero, count_if(rate = 1) AS n_one, count_if(rate > 0 AND rate < 1) AS n_mixed, round(quantile_cont(rate, 0.5), 6) AS median_rate, round(avg(rate), 6) AS mean_rate, count_if(rate >= 0.3) AS n_high FROM r GROUP BY site")
def rate_variation(spark, sf_dir):
    r = reports.rate_variation(reports.specimen_rates(of(spark, sf_dir, V.META)))
    return r.withColumns({"median_rate": F.round("median_rate", 6), "mean_rate": F.round("mean_rate", 6)})


@query(f"WITH m AS ({V.META}) SELECT site, CAST(year(day) AS INT) AS year, count(*) AS n, round(count_if(flag = 'Yes')::DOUBLE / count(*), 6) AS rate, count(DISTINCT day) AS n_days FROM m GROUP BY ALL")
def campaign_rate(spark, sf_dir):
    return reports.campaign_rates(of(spark, sf_dir, V.META)).withColumn("rate", F.round("rate", 6))


@query(f"WITH m AS ({V.META}) SELECT site, season, polyp, bool_or(flag = 'Yes') AS any_yes, count(*) AS n FROM m GROUP BY ALL")
def any_positive(spark, sf_dir):
    return reports.any_positive(of(spark, sf_dir, V.META), ["site", "season", "polyp"])


@query(f"WITH p AS ({V.POINT}) SELECT stage, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM p GROUP BY stage")
def stage_percent(spark, sf_dir):
    return reports.stage_shares(of(spark, sf_dir, V.POINT)).withColumn("percent", F.round("percent", 6))


@query(f"""WITH p AS ({V.POINT}) SELECT cut_name, count(*) AS total, {', '.join(f'count_if(stage = {s}) AS stage_{s}, round(count_if(stage = {s})::DOUBLE / count(*), 6) AS share_{s}' for s in range(5))} FROM p GROUP BY cut_name""")
def stage_composition(spark, sf_dir):
    r = reports.stage_composition(of(spark, sf_dir, V.POINT), "cut_name", list(range(5)))
    return r.withColumns({f"share_{s}": F.round(f"share_{s}", 6) for s in range(5)})


@query(f"WITH r AS (SELECT stage, ((x1 - x0) * (y1 - y0))::DOUBLE AS a FROM ({V.RECT}) v) SELECT stage, count(*) AS n, round(avg(a), 4) AS mean, round(quantile_cont(a, 0.5), 6) AS median, round(stddev_samp(a), 4) AS std, min(a) AS least, max(a) AS most FROM r GROUP BY stage")
def size_stats(spark, sf_dir):
    r = of(spark, sf_dir, V.RECT).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    s = reports.value_stats(r, ["stage"], "area")
    return s.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 6), "std": F.round("std", 4)})


@query("SELECT CAST(least(11, greatest(0, floor((log10(greatest(o_totalprice::DOUBLE, 1)) - 3) / ((6.0 - 3) / 12)))) AS INT) AS bin, count(*) AS n FROM {orders} GROUP BY ALL")
def hist_bins(spark, sf_dir):
    return reports.log_histogram(of(spark, sf_dir, "SELECT o_totalprice FROM {orders}"), "o_totalprice", 3.0, 6.0, 12)


@query("SELECT split_part(p_brand, '#', 1) AS location, count_if(p_partkey % 3 = 0) AS n_train, count_if(p_partkey % 3 = 1) AS n_val, count_if(p_partkey % 3 = 2) AS n_test FROM {part} GROUP BY ALL")
def split_table(spark, sf_dir):
    p = of(spark, sf_dir, "SELECT split_part(p_brand, '#', 1) AS location, CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM {part}")
    return reports.split_table(p)


PROGRESS = "SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS epoch, CAST(value AS DOUBLE) AS score FROM {events}"


@query(f"""WITH l AS ({PROGRESS}), b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best, coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS before FROM l),
e AS (SELECT *, max(CASE WHEN score > before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM b) SELECT run, epoch, round(best, 6) AS best, best_epoch, epoch - best_epoch >= 3 AS stops FROM e""")
def training_progress(spark, sf_dir):
    return reports.training_progress(of(spark, sf_dir, PROGRESS), "run", 3).select("run", "epoch", *r6("best"), "best_epoch", "stops")


@query("""WITH v AS (SELECT 'no price' AS "check", concat('k', p_partkey) AS detail FROM {part} WHERE p_size % 10 = 0), k AS (SELECT *, row_number() OVER (ORDER BY detail) AS k FROM v)
SELECT 'no price' AS "check", count(*) = 0 AS ok, count(*) AS n, coalesce(list_sort(list(detail) FILTER (k <= 3)), []) AS examples FROM k UNION ALL SELECT 'no name', true, 0, []""")
def check_report(spark, sf_dir):
    v = of(spark, sf_dir, "SELECT 'no price' AS check, concat('k', p_partkey) AS detail FROM {part} WHERE p_size % 10 = 0")
    return reports.checks(v, ["no price", "no name"])


# Joins and sets


LISTED = "SELECT concat('P', p_partkey, '_cut000') AS cut_name, CASE WHEN p_partkey % 2 = 0 THEN 'excluded' ELSE 'known_empty' END AS status FROM {part} WHERE p_size % 7 = 0"


@query(f"WITH c AS ({V.CUT}), l AS ({LISTED}) SELECT c.cut_name, coalesce(status, '') AS status FROM c LEFT JOIN l USING (cut_name)")
def exclusion_left_join(spark, sf_dir):
    return of(spark, sf_dir, V.CUT).join(of(spark, sf_dir, LISTED), "cut_name", "left").select("cut_name", F.coalesce("status", F.lit("")).alias("status"))


@query(f"WITH c AS ({V.CUT}), l AS ({LISTED}) SELECT cut_name, width, height FROM c WHERE cut_name NOT IN (SELECT cut_name FROM l WHERE status = 'excluded')")
def exclusion_anti(spark, sf_dir):
    return of(spark, sf_dir, V.CUT).join(of(spark, sf_dir, LISTED).filter("status = 'excluded'"), "cut_name", "left_anti")


@query(f"WITH c AS ({V.CUT}), p AS ({V.POINT}) SELECT cut_name, width, height FROM c WHERE cut_name IN (SELECT cut_name FROM p)")
def semi_annotated(spark, sf_dir):
    return of(spark, sf_dir, V.CUT).join(of(spark, sf_dir, V.POINT), "cut_name", "left_semi")


@query(f"WITH c AS ({V.CUT}), l AS ({LISTED}) SELECT cut_name, 'only tiles' AS side FROM (SELECT cut_name FROM c EXCEPT SELECT cut_name FROM l) UNION ALL SELECT cut_name, 'only list' FROM (SELECT cut_name FROM l EXCEPT SELECT cut_name FROM c)")
def except_both_ways(spark, sf_dir):
    a, b = of(spark, sf_dir, V.CUT).select("cut_name"), of(spark, sf_dir, LISTED).select("cut_name")
    return a.exceptAll(b).withColumn("side", F.lit("only tiles")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only list")))


@query(f"SELECT list_sort(list(cut_name) FILTER (status = 'excluded')) AS excluded, list_sort(list(cut_name) FILTER (status = 'known_empty')) AS known_empty, sha256(array_to_string(list_sort(list(concat(cut_name, ',', status))), chr(10))) AS sha256 FROM ({LISTED}) l")
def exclusion_record(spark, sf_dir):
    from tessella.sources.readers import exclusion_record as record

    return record(of(spark, sf_dir, LISTED))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}")
def json_fields(spark, sf_dir):
    return of(spark, sf_dir, "SELECT event_id, props FROM {events}").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


# Embeddings


@query("SELECT vec_id, [round((embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE + embedding[i + 48]::DOUBLE) / 4, 6) FOR i IN range(1, 17)] AS pooled FROM {embeddings}")
def pool_mean(spark, sf_dir):
    e = of(spark, sf_dir, "SELECT vec_id, embedding FROM {embeddings}")
    return e.select("vec_id", F.transform(embeddings.pooled(embeddings.sub_vectors(F.col("embedding"), 4, 16), 16), lambda v: rounded(v, 6)).alias("pooled"))


@query("SELECT vec_id, [round(greatest(embedding[i], embedding[i + 16], embedding[i + 32], embedding[i + 48])::DOUBLE, 6) FOR i IN range(1, 17)] AS pooled FROM {embeddings}")
def pool_max(spark, sf_dir):
    e = of(spark, sf_dir, "SELECT vec_id, embedding FROM {embeddings}")
    return e.select("vec_id", F.transform(embeddings.pooled(embeddings.sub_vectors(F.col("embedding"), 4, 16), 16, "max"), lambda v: rounded(v, 6)).alias("pooled"))


@query("SELECT concat('t', vec_id) AS tile_id, CASE WHEN vec_id % 5 = 0 THEN 'missing' ELSE 'other path' END AS reason FROM {embeddings} WHERE vec_id % 5 = 0 OR vec_id % 7 = 0")
def embed_coverage(spark, sf_dir):
    frame = of(spark, sf_dir, "SELECT concat('t', vec_id) AS tile_id, concat('p', vec_id) AS png_path FROM {embeddings}")
    cache = of(spark, sf_dir, "SELECT concat('t', vec_id) AS tile_id, concat('p', vec_id + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) AS png_path FROM {embeddings} WHERE vec_id % 5 <> 0")
    return embeddings.not_covered(frame, cache)


@query("""WITH v AS (SELECT unnest(embedding)::DOUBLE AS u, unnest([x + 0.25 FOR x IN embedding])::DOUBLE AS v FROM {embeddings}) SELECT round(max(abs(u - v)), 4) AS max_abs, round(avg(abs(u)), 6) AS magnitude, round(max(abs(u - v)) / avg(abs(u)), 4) AS relative FROM v""")
def embed_deviation(spark, sf_dir):
    e = of(spark, sf_dir, "SELECT vec_id, embedding FROM {embeddings}")
    moved = e.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.25)))
    return embeddings.deviation(e, moved, "vec_id", "embedding").select(F.round("max_abs", 4).alias("max_abs"), F.round("magnitude", 6).alias("magnitude"), F.round("relative", 4).alias("relative"))


@query()
def head_scores(spark, sf_dir):
    e = of(spark, sf_dir, "SELECT vec_id, embedding, CAST(label % 2 AS INT) AS y FROM {embeddings}")
    e = e.withColumn("pooled", embeddings.pooled(embeddings.sub_vectors(F.col("embedding"), 4, 16), 16))
    model = embeddings.fit_head(e, "pooled", "y")
    return embeddings.head_scores(e, model, "pooled").select("vec_id", "y", "prob")


# The tile index


TILED = """SELECT event_id AS tile_id, concat('p', event_id) AS png_path, concat('A', user_id % 5, '_', user_id % 40) AS stem, concat('P', event_id % 60, '_cut000') AS cut_name, CASE WHEN event_id % 2 = 0 THEN 512 ELSE 1024 END AS tile_size,
 CAST(event_id % 3 AS INT) AS n_oocytes, CAST(value AS DOUBLE) / 500 AS tissue_fraction, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST((event_id * 37) % 100 AS DOUBLE) / 100 END AS area_fraction FROM {events}"""
SLIDES = "SELECT DISTINCT concat('A', user_id % 5, '_', user_id % 40) AS stem, concat('A', user_id % 5) AS location, CASE user_id % 40 % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM {events}"
INDEXED = f"""SELECT tile_id, png_path, stem, cut_name, tile_size, n_oocytes, tissue_fraction, area_fraction AS oocyte_area_fraction, CASE WHEN area_fraction >= 0.05 AND area_fraction > 0 THEN 'positive' WHEN area_fraction > 0 THEN 'ambiguous' ELSE 'negative' END AS label,
 area_fraction > 0 AND area_fraction < 0.05 AS is_ambiguous, split FROM ({TILED}) t JOIN ({SLIDES}) s USING (stem) WHERE tissue_fraction >= 0.1 AND cut_name NOT IN (SELECT cut_name FROM ({LISTED}) l WHERE status = 'excluded')"""


def _index(spark, sf_dir):
    return index.tile_index(of(spark, sf_dir, TILED), of(spark, sf_dir, SLIDES), of(spark, sf_dir, LISTED), 0.05, "area", 0.1)


@query(INDEXED)
def tile_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"SELECT tile_id, stem, label, CASE WHEN label = 'positive' THEN 1 ELSE 0 END::BIGINT AS target FROM ({INDEXED}) i WHERE split = 'train' AND NOT is_ambiguous")
def training_rows(spark, sf_dir):
    return index.training_rows(_index(spark, sf_dir), "train").select("tile_id", "stem", "label", "target")


@query(f"SELECT cut_name, count_if(tissue_fraction >= 0.3) AS n_kept, count_if(NOT tissue_fraction >= 0.3) AS n_dropped FROM ({TILED}) t GROUP BY cut_name")
def tissue_counts(spark, sf_dir):
    return index.tissue_counts(of(spark, sf_dir, TILED), "cut_name", 0.3)


@query("SELECT CASE WHEN p_size % 9 = 0 THEN 'unlabelled' WHEN p_size % 9 <= 4 THEN 'kept' ELSE 'out of range' END AS fate, count(*) AS n FROM {part} GROUP BY ALL")
def stage_rejects(spark, sf_dir):
    return index.stage_rejects(of(spark, sf_dir, "SELECT CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 9 END AS stage FROM {part}"))


@query(f"WITH i AS ({INDEXED}), f AS (SELECT DISTINCT stem FROM i WHERE split = 'train' ORDER BY stem LIMIT 3) SELECT tile_id, stem, split FROM i WHERE split <> 'train' OR stem IN (SELECT stem FROM f)")
def first_train_slides(spark, sf_dir):
    return index.first_slides(_index(spark, sf_dir), "train", 3).select("tile_id", "stem", "split")


@query(f"""WITH l AS ({LISTED}), c AS (SELECT DISTINCT cut_name FROM ({TILED}) t), a AS (SELECT DISTINCT cut_name FROM ({TILED}) t WHERE area_fraction > 0.5 AND tile_id % 60 < 50)
SELECT 'listed but no cut' AS "check", cut_name AS detail FROM l WHERE cut_name NOT IN (SELECT cut_name FROM c)
UNION ALL SELECT 'known empty but annotated', cut_name FROM l WHERE status = 'known_empty' AND cut_name IN (SELECT cut_name FROM a)
UNION ALL SELECT 'not annotated and not listed', cut_name FROM c WHERE cut_name NOT IN (SELECT cut_name FROM a) AND cut_name NOT IN (SELECT cut_name FROM l)""")
def exclusion_breaks(spark, sf_dir):
    t = of(spark, sf_dir, TILED)
    return index.exclusion_breaks(t, t.filter("area_fraction > 0.5 AND tile_id % 60 < 50"), of(spark, sf_dir, LISTED))


@query("SELECT user_id AS k, count(*) AS n, count(DISTINCT event_type) AS n_sizes FROM {events} GROUP BY user_id HAVING count(*) > 1 OR count(DISTINCT event_type) > 1")
def key_breaks(spark, sf_dir):
    return index.key_breaks(of(spark, sf_dir, "SELECT user_id AS k, event_type FROM {events}"), "k", "event_type")


@query(f"WITH i AS ({INDEXED}) SELECT tile_id, label, row_number() OVER (PARTITION BY label ORDER BY tile_id) - 1 AS position FROM i")
def class_positions(spark, sf_dir):
    return index.class_positions(_index(spark, sf_dir), "tile_id", "label").select("tile_id", "label", F.col("position").cast("long").alias("position"))


@query(f"WITH i AS ({INDEXED}), p AS ({V.PRED}) SELECT i.tile_id, i.label, round(prob, 6) AS prob FROM i LEFT JOIN (SELECT tile_id, prob FROM p WHERE split = 'test') q USING (tile_id)")
def prediction_join(spark, sf_dir):
    return index.prediction_join(_index(spark, sf_dir), of(spark, sf_dir, V.PRED).filter("split = 'test'")).select("tile_id", "label", *r6("prob"))


@query(f"""WITH i AS ({INDEXED}), p AS (SELECT tile_id, split, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS label FROM ({V.PRED}) v)
SELECT count_if(i.split IS NULL) AS n_unknown, count_if(i.split <> p.split) AS n_other_split, count_if(i.label <> p.label) AS n_other_label FROM p LEFT JOIN i USING (tile_id)""")
def prediction_mismatches(spark, sf_dir):
    p = of(spark, sf_dir, V.PRED).withColumn("label", F.when(F.col("y") == 1, "positive").otherwise("negative"))
    return index.prediction_mismatches(_index(spark, sf_dir), p)


@query(f"WITH i AS ({INDEX}) SELECT tile_id, specimen, specimen IN (SELECT specimen FROM i WHERE tile_id % 5 = 0) AS leaks FROM i WHERE split = 'test'")
def leakage_flags(spark, sf_dir):
    i = of(spark, sf_dir, INDEX)
    return index.leakage_flags(i.filter("split = 'test'"), i.filter("tile_id % 5 = 0")).select("tile_id", "specimen", "leaks")


@query(f"""WITH p AS ({V.PRED}), m AS (SELECT *, specimen IN (SELECT specimen FROM p WHERE tile_id % 5 = 0) AS leaks FROM p WHERE split = 'test'), t AS (SELECT leaks, prob, sum(y) AS tp, sum(1 - y) AS fp FROM m GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY leaks) AS p, sum(fp) OVER (PARTITION BY leaks) AS n FROM t WINDOW w AS (PARTITION BY leaks ORDER BY prob DESC))
SELECT leaks, CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(tp::DOUBLE / nullif(p, 0) * ctp / (ctp + cfp)), 6) END AS average_precision, CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(fp * (ctp - tp / 2.0))::DOUBLE / nullif(max(p) * max(n), 0), 6) END AS roc_auc FROM r GROUP BY leaks""")
def scores_by_leakage(spark, sf_dir):
    p = of(spark, sf_dir, V.PRED)
    return metrics.ranking_scores(index.leakage_flags(p.filter("split = 'test'"), p.filter("tile_id % 5 = 0")), ["leaks"]).select("leaks", *r6("average_precision", "roc_auc"))


@query("SELECT p_partkey AS run, round(p_retailprice, 6) AS recorded, round(p_retailprice + CASE WHEN p_partkey % 50 = 0 THEN 0.5 ELSE 0 END, 6) AS recomputed FROM {part} WHERE p_partkey % 50 = 0")
def metric_differences(spark, sf_dir):
    a = of(spark, sf_dir, "SELECT p_partkey AS run, p_retailprice AS value FROM {part}")
    b = of(spark, sf_dir, "SELECT p_partkey AS run, p_retailprice + CASE WHEN p_partkey % 50 = 0 THEN 0.5 ELSE 0 END AS value FROM {part}")
    return index.metric_differences(a, b, ["run"], 1e-9).select("run", *r6("recorded", "recomputed"))


@query(f"WITH i AS ({INDEXED}) SELECT tile_size, count_if(split = 'train' AND is_ambiguous) AS ambiguous_train, count_if(split = 'val' AND is_ambiguous) AS ambiguous_val, count_if(split = 'test' AND is_ambiguous) AS ambiguous_test FROM i GROUP BY tile_size")
def ambiguous_per_split(spark, sf_dir):
    return index.ambiguous_per_split(_index(spark, sf_dir))


@query(f"WITH i AS ({INDEXED}) SELECT split, count(*) AS n_tiles, count_if(label = 'positive') AS n_positive, count(DISTINCT stem) AS n_slides, count(DISTINCT split_part(stem, '_', 1)) AS n_specimens FROM i WHERE NOT is_ambiguous GROUP BY split")
def train_summary(spark, sf_dir):
    return index.train_summary(_index(spark, sf_dir))


@query(f"WITH s AS ({V.STEM}) SELECT stem, (s_suppkey % 7 + 1)::INT AS expected, 3::BIGINT AS found FROM s WHERE s_suppkey % 7 + 1 <> 3")
def cut_reconciliation(spark, sf_dir):
    s = of(spark, sf_dir, V.STEM).select("stem", F.explode(F.array(*map(F.lit, range(3)))).alias("cut_index"))
    return index.cut_reconciliation(s)


@query(f"""WITH m AS ({SLIDES}), s AS (SELECT stem FROM m WHERE stem <> 'A1_1'), g AS (SELECT location FROM m GROUP BY location HAVING count(DISTINCT split) < 3)
SELECT 'not a slide' AS "check", stem AS detail FROM m WHERE stem = 'A1_1' UNION ALL SELECT 'scarce outside train', stem FROM m WHERE stem LIKE '%7' AND split <> 'train' UNION ALL SELECT 'a site misses a split', location FROM g""")
def split_breaks(spark, sf_dir):
    m = of(spark, sf_dir, SLIDES)
    return index.split_breaks(m, m.filter("stem <> 'A1_1'"), F.col("stem").endswith("7"))


@query("SELECT CAST(extract(day FROM ts) AS INT) AS epoch, round(avg(value), 6) AS loss_by_batch, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS loss_by_row FROM {events} GROUP BY ALL")
def epoch_means(spark, sf_dir):
    return index.epoch_means(of(spark, sf_dir, "SELECT day(ts) AS epoch, value AS loss, event_id % 7 + 1 AS n FROM {events}")).select("epoch", *r6("loss_by_batch", "loss_by_row"))


@query(f"""WITH s AS (SELECT DISTINCT stem FROM ({SLIDES}) v), n AS (SELECT count(*) AS n FROM s), o AS (SELECT stem, row_number() OVER (ORDER BY {HASH.format(seed=4, key='stem')}, stem) AS k FROM s)
SELECT stem, CASE WHEN k <= greatest(1, floor(n * 0.2)) THEN 'val' WHEN k <= greatest(1, floor(n * 0.2)) + greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS split FROM o, n""")
def random_lists(spark, sf_dir):
    return index.random_lists(of(spark, sf_dir, SLIDES).select("stem"), {"val": 0.2, "test": 0.1}, 4)


@query(f"""WITH {GRID}, p AS ({V.POINT}), hit AS (SELECT t.cut_name, t.tile_size, x0 + t.tile_size > x1 OR y0 + t.tile_size > y1 AS padded, count(cx) AS n FROM tile t LEFT JOIN p ON t.cut_name = p.cut_name AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY t.cut_name, t.tile_size, t."row", t.col, x0, y0, x1, y1)
SELECT cut_name, tile_size, count(*) AS n, count_if(n > 0) AS n_annotated, count_if(padded) AS n_padded FROM hit GROUP BY ALL""")
def manifest_counts(spark, sf_dir):
    cuts, tiles = _tiles(spark, sf_dir)
    return index.manifest_counts(spatial.tiles_with_points(tiles, of(spark, sf_dir, V.POINT), cuts, SIZES))


@query(f"""WITH cut AS ({V.CUT}), p AS ({V.POINT}), ys AS (SELECT *, unnest(range(0, height, 256)) AS y0 FROM cut), g AS (SELECT *, unnest(range(0, width, 256)) AS x0 FROM ys),
t AS (SELECT cut_name, x0, y0, least(x0 + 256, width) AS x1, least(y0 + 256, height) AS y1 FROM g), f AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cut_name = t.cut_name AND cx BETWEEN x0 - 32 AND x1 + 32 AND cy BETWEEN y0 - 32 AND y1 + 32))
SELECT cut_name, x0, y0 FROM f QUALIFY row_number() OVER (PARTITION BY cut_name ORDER BY {HASH.format(seed=6, key="concat(x0, ':', y0)")}, concat(x0, ':', y0)) <= 2""")
def negative_review_tiles(spark, sf_dir):
    cuts = of(spark, sf_dir, V.CUT)
    free = spatial.tiles_without_points(grid.tile_grid(cuts, [256], 0.0), of(spark, sf_dir, V.POINT), cuts, [256], 0.0, 32)
    return quality.sample_per_group(free.withColumn("at", F.concat_ws(":", "x0", "y0")), "cut_name", "at", 2, 6).select("cut_name", "x0", "y0")


@query(f"""WITH c AS ({V.CUT}), p AS ({V.POINT}), r AS (SELECT cut_name, id, stage, greatest(0, least(round_even(cx - 64, 0)::BIGINT, width - 128)) AS x0, greatest(0, least(round_even(cy - 64, 0)::BIGINT, height - 128)) AS y0 FROM p JOIN c USING (cut_name))
SELECT cut_name, id, x0, y0, x0 + 128 AS x1, y0 + 128 AS y1 FROM r QUALIFY row_number() OVER (PARTITION BY stage ORDER BY {HASH.format(seed=8, key="concat(cut_name, ':', id)")}, concat(cut_name, ':', id)) <= 10""")
def positive_review_tiles(spark, sf_dir):
    p = of(spark, sf_dir, V.POINT).join(of(spark, sf_dir, V.CUT), "cut_name")
    b = rings.centred_box(F.col("cx"), F.col("cy"), 128, F.col("width"), F.col("height"))
    return quality.sample_per_group(p.withColumns({"b": b, "key": F.concat_ws(":", "cut_name", "id")}), "stage", "key", 10, 8).select("cut_name", "id", "b.*")


@query(f"WITH p AS ({V.PRED}) SELECT split, count(DISTINCT specimen) AS n_specimens, count(*) AS n FROM p GROUP BY split")
def sample_summary(spark, sf_dir):
    return of(spark, sf_dir, V.PRED).groupBy("split").agg(F.countDistinct("specimen").alias("n_specimens"), F.count(F.lit(1)).alias("n"))


from tessella.plans import validation  # noqa: E402, F401
