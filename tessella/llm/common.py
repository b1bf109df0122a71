"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one Python task handles at a time, in characters.
SLICE_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in one process, as in tests, a
    temporary folder is made and recorded in the session, so that later calls
    find the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete the shuffle files of a write that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write a table in between, and ask Spark to delete its shuffle files when it stands.

    Seen to work where all runs in one process; on several executors they may
    stay until the driver collects garbage, as they always did.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


#: The list that gets the folders of tables that stay, while one is set.
_STAYING: list[list[str]] = []


@contextlib.contextmanager
def staying():
    """A list of the folders that are written meanwhile and that nothing removes: what is returned may read them."""
    _STAYING.append([])
    try:
        yield _STAYING[-1]
    finally:
        _STAYING.pop()


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of any executor.
    ``paths`` gets the folder, for ``remove``.
    """
    path = new_path(df.sparkSession, name)
    if paths is None and _STAYING:
        paths = _STAYING[-1]
    if paths is not None:
        paths.append(path)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``new_path`` named, once nothing reads them any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver, which idles between large steps, give back what nothing refers to: shuffle files and broadcasts, which
    Spark deletes once their handles are collected, and free memory of Python and of the JVM."""
    gc.collect()
    trimmed()
    spark._jvm.System.gc()


def made_before(paths: list[str], df: DataFrame) -> list[str]:
    """Those of some written tables' folders that stood before all files of ``df`` were written, and aren't among them."""
    spark, files = df.sparkSession, df.inputFiles() if paths else []

    def when(name: str) -> int | None:
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        store = target.getFileSystem(spark._jsc.hadoopConfiguration())
        return store.getFileStatus(target).getModificationTime() if store.exists(target) else None

    times = [when(f) for f in files]
    if not times or None in times or any(p.rsplit("/", 1)[1] in f for p in paths for f in files):
        return []
    stood = {p: when(f"{p}/_SUCCESS") for p in paths}
    return [p for p, t in stood.items() if t is not None and t < min(times)]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let batches to Python hold ``rows`` rows at most, unless the session has a number of its own.

    By default they hold 10,000, which for whole texts is much memory on both sides.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of a few numbers each that are broadcast at most; where there are more, the join shuffles.
MOST_BROADCAST = 1_000_000


def if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= (MOST_BROADCAST if most is None else most) else df


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, written with a column ``name`` that numbers its rows.

    The numbers are read again and never made again, so they are the same in
    every pass, wherever the rows came from and whatever becomes of executors.
    """
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``id`` and ``text``; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches, text: str = "text"):
    """Cut Arrow batches so that a slice holds about SLICE_CHARS bytes of text, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            total += n or 0
            if total >= SLICE_CHARS:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8 values as bytes; null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """What a Python worker remembers by a string, in two generations of bounded size.

    ``young`` takes what is new.  Once that holds half of ``most`` bytes it
    becomes the old one, whose entries come back when they are asked for.
    """

    #: Bytes of an entry besides its key and value, about.
    ENTRY = 200

    def __init__(self, most: int = 64_000_000, kind: type[dict] = dict):
        self.most, self.bytes, self.kind = most, 0, kind
        self.young: dict = kind()
        self.old: dict = kind()

    def recall(self, keys) -> list:
        """Take up those of ``keys`` that the old generation holds; gives the others, each once."""
        new = []
        for k in dict.fromkeys(keys):
            if (x := self.old.get(k)) is None:
                new.append(k)
            else:
                self.add(k, x)
        return new

    def add(self, key, value, size: int = 0) -> None:
        self.bytes += self.ENTRY + len(key) + size
        self.young[key] = value

    def add_all(self, new: dict) -> None:
        """Several entries at once; their values' lengths are their sizes."""
        self.bytes += self.ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))
        self.young.update(new)

    def turn(self) -> None:
        """Between two slices: let the older generation go if the younger one is full."""
        if self.bytes > self.most // 2:
            self.old, self.young, self.bytes = self.young, self.kind(), 0


def trimmed() -> None:
    """Give free memory of Arrow and of the C library back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in this Python worker from task to task; what others kept is let go.

    Workers live through all stages of an application, so without that every
    operator's models and caches would add up.  What the C library has free goes
    back to the system as well, where it can tell.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        gc.collect()
        trimmed()
    return _KEPT.setdefault(owner, {})


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
