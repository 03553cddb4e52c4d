"""Sends this package to the executors' Python, once for each Spark context."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


#: Rows of an Arrow batch: texts are long, and both sides of the pipe hold a batch or two of each task.
_BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def ship(spark: SparkSession) -> None:
    """Add the package's modules to what workers can import (a zip of some 100 KB).

    Where the session leaves the size of Arrow batches at its default, it
    becomes a smaller one.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS[0]) == "10000":
        spark.conf.set(*_BATCH_ROWS)
    if context.applicationId in _done:
        return
    folder = tempfile.mkdtemp(prefix="modules-")
    path = os.path.join(folder, f"{_ROOT.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT)}")
    context.addPyFile(path)
    _done.add(context.applicationId)
