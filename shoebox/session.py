"""Session helpers: shipping this package to executors, and the size of Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes that Spark hands to a Python worker at once. Whole texts pass through workers, several copies of a batch at a time.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that their Python workers can import it.

    Arrow batches are set to ``BATCH_BYTES`` unless the Spark configuration names their size.
    """
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(context, "_shoebox_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shoebox-package-")) / "shoebox.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._shoebox_shipped = True
