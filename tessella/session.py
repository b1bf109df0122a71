"""Send this package to the executors, as ``--py-files`` would."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="spark-")) / f"{here.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(out))
    _SENT.add(app)


def can_checkpoint(spark: SparkSession) -> None:
    """Have ``checkpoint()`` write to the folder that ``spark.checkpoint.dir`` names.

    Only where it is unset and Spark runs in one process, as in tests, a
    temporary folder is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(found)
