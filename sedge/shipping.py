"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


#: Rows of an Arrow batch: texts may be long, and a worker holds a batch whole.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "512"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context.

    Batches get fewer rows too, unless the session has its own number.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS[0]) == "10000":
        spark.conf.set(*BATCH_ROWS)
    if getattr(sc, "_sedge_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    folder = tempfile.mkdtemp(prefix="sedge-package-")
    path = os.path.join(folder, "sedge_package.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._sedge_shipped = True
