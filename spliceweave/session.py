"""Session helpers: shipping the package, the stage folder and stored stages."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that kernels run from any folder.

    Functions know the files that were sent before they were made: call this before making a kernel.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spliceweave-package-"))
    sc.addPyFile(shutil.make_archive(f"{folder}/spliceweave", "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir_ready(spark: SparkSession) -> None:
    """Make sure stages have a folder: the one in ``spark.checkpoint.dir``, else one under the warehouse.

    The same rule holds for every master. Both are storage that all executors share on a cluster.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the stage folder and return a scan of it.

    A stored table survives lost executors, has known sizes (so joins are planned from them) and
    starts a fresh plan, which a checkpointed frame does not: that keeps the constraints of its
    origin, and they pile up in loops.
    """
    spark = df.sparkSession
    checkpoint_dir_ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(*stored: DataFrame) -> None:
    """Delete what ``cut_lineage`` stored, once nothing reads it any more (states that a loop has replaced)."""
    for df in stored:
        if path := getattr(df, "_stage_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
