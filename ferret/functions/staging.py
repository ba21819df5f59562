"""Tables that a job writes for its own later steps, in the folder the cluster shares.

Writing cuts the lineage: a lost executor costs the tasks it ran, not the steps before. ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ferret.session import shared_dir


def staging_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and driver and executors are one process."""
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        try:
            return shared_dir(spark)
        except RuntimeError:
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ferret-staged-"))
    return shared_dir(spark)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back."""
    path = f"{staging_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
