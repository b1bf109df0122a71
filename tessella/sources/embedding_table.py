"""A table of embeddings that says what it was made from, and is opened only if that still holds.

Writing is staged: the table and its manifest stand beside the old ones until
both are whole and the inputs are seen not to have changed meanwhile; then they
take their place.  Digests are sums over rows, so they don't depend on order and
no task sees more than its own rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format that this module writes and reads.
VERSION = 1
MANIFEST = "version INT, encoder STRING, tile_size INT, parts INT, dim INT, n BIGINT, list_digest STRING, content_digest STRING, inputs_digest STRING"


def digest(df: DataFrame, *columns: str) -> str:
    """A SHA-256 over a table's rows in any order, repeated ones included."""
    line = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda k: F.conv(F.substr(line, F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(38, 0)")
    sums = F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(F.sum(part(k)), F.lit(0)).cast("string") for k in range(4)])
    return df.agg(F.sha2(sums, 256).alias("d")).first().d


def cache_tiles(index: DataFrame, size: int) -> DataFrame:
    """The tiles that a table of a size holds, in the order of their ids: tile_id, png_path."""
    return index.filter(F.col("tile_size") == size).select("tile_id", "png_path").orderBy("tile_id")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, target = _fs(spark, old)
    if not fs.rename(target, _fs(spark, new)[1]):
        raise OSError(f"{old} couldn't be renamed to {new}")


def write_table(tiles: DataFrame, embeddings: DataFrame, path: str, encoder: str, tile_size: int, inputs: DataFrame) -> None:
    """Put a table (tile_id, png_path, sub: array of parts) and its manifest in place of what stands at ``path``.

    ``embeddings`` has tile_id and sub.  ``inputs`` (path, sha256) is read before
    and after: if it changed while the table was built, or a tile has no
    embedding or several, or vectors differ in shape, what stands stays.
    """
    spark = tiles.sparkSession
    before = digest(inputs, "path", "sha256")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        rows = cache_tiles(tiles, tile_size).join(embeddings.select("tile_id", F.col("sub").cast("array<array<double>>").alias("sub")), "tile_id", "left")
        rows.write.parquet(f"{staging}/rows")
        made = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
        n, ids, parts, dims, empty = made.agg(F.count(F.lit(1)), F.countDistinct("tile_id"), F.collect_set(F.size("sub")), F.collect_set(F.size(F.get("sub", F.lit(0)))), F.count_if(F.col("sub").isNull())).first()
        if empty or n != ids:
            raise ValueError(f"{empty} tiles have no embedding and {n - ids} have several")
        ragged = made.filter(F.exists("sub", lambda v: F.size(v) != F.size(F.get("sub", F.lit(0))))).head(1)
        if n == 0 or len(parts) != 1 or len(dims) != 1 or ragged:
            raise ValueError("embeddings aren't all of one shape")
        facts = (VERSION, encoder, tile_size, parts[0], dims[0], n, digest(made, "tile_id", "png_path"), digest(made, "tile_id", "sub"), before)
        spark.createDataFrame([facts], MANIFEST).coalesce(1).write.json(f"{staging}/manifest")
        if digest(inputs, "path", "sha256") != before:
            raise ValueError("the inputs changed while the table was built")
        old = f"{path}.old-{uuid.uuid4().hex}"
        if _exists(spark, path):
            _rename(spark, path, old)
        _rename(spark, staging, path)
        if _exists(spark, old):
            _delete(spark, old)
    finally:
        if _exists(spark, staging):
            _delete(spark, staging)


def open_table(spark: SparkSession, path: str, encoder: str, tile_size: int, tiles: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """The table at ``path``: tile_id, png_path, sub; an error if it isn't what is asked for.

    Checked in turn: that it is whole, its format, size and encoder, that it
    lists the tiles of ``tiles``, that the inputs are those it was made from,
    the vectors' shape, and its own content.
    """
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"{path} has no whole table")
    facts = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    for what, found, wanted in (("format", facts.version, VERSION), ("tile size", facts.tile_size, tile_size), ("encoder", facts.encoder, encoder)):
        if found != wanted:
            raise ValueError(f"{path} has {what} {found}, not {wanted}")
    if facts.list_digest != digest(cache_tiles(tiles, tile_size), "tile_id", "png_path"):
        raise ValueError(f"{path} lists other tiles")
    if inputs is not None and facts.inputs_digest != digest(inputs, "path", "sha256"):
        raise ValueError(f"{path} was made from other inputs")
    rows = spark.read.schema("tile_id " + tiles.schema["tile_id"].dataType.simpleString() + ", png_path string, sub array<array<double>>").parquet(f"{path}/rows")
    if rows.filter((F.size("sub") != facts.parts) | F.exists("sub", lambda v: F.size(v) != facts.dim)).head(1) or rows.count() != facts.n:
        raise ValueError(f"{path} has rows of another shape or number")
    if facts.content_digest != digest(rows, "tile_id", "sub"):
        raise ValueError(f"{path} has other content than it says")
    return rows
