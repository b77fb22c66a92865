"""What jobs need of the cluster: this package on its Python workers, and a shared folder for rows between jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder that all executors share, as spark.checkpoint.dir says; a new one of this machine only in a single-process session that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix=prefix)}"
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """A folder and all in it, if it is there, by the file system that its path names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints-"))
    return df.checkpoint()


#: Of one Arrow batch: few rows, as single ones may be long, and a bound in bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """The package on the workers, and batches for Python that stay small whatever the length of rows; both hold for the session from then on."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
