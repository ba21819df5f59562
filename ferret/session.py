"""Session helpers: one place that knows the configuration the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job assumes. AQE re-plans joins from runtime sizes (a side
# only becomes a broadcast when its measured size is under the threshold),
# splits skewed shuffle partitions and coalesces small ones.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "ferret", conf: dict | None = None) -> SparkSession:
    """A session with the engine's settings. On a cluster the launcher supplies master, sizes and checkpoint folder; the
    number of shuffle partitions is set only when given."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**ENGINE_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. There is no fallback, since a machine-local
    folder would be seen by one machine only; local sessions and tests set a temporary one themselves."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d.rstrip("/")
