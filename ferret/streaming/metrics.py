"""Structured Streaming operators (M1–M5, M7, M8).

Each operator is a function of a (streaming or batch) DataFrame, so the same
code runs as a stream and as its batch twin; tests compare the two.
Checkpoints go under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferret.session import shared_dir
from ferret.sources.tables import SCHEMAS, table_path


def event_stream(spark: SparkSession, source_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A file stream over a table directory (new parquet files become micro-batches)."""
    return (spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(source_dir))


def checkpoint_for(spark: SparkSession, query: str) -> str:
    return f"{shared_dir(spark)}/streams/{query}"


# ------------------------------------------------------------------ M1 ----

def window_counts(events: DataFrame, interval: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """M1: fixed-interval event and error counts with value totals (event time, watermark for late data)."""
    # watermarks need TIMESTAMP (session zone UTC, so values are unchanged); outputs go back to NTZ
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .groupBy(F.window("ts", interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"),
                 F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events", "errors", "value_cents"))


# ------------------------------------------------------------------ M2 ----

RATE_SCHEMA = "user_id long, ts timestamp_ntz, counter long, delta long, rate double, reset boolean"
RATE_STATE = "last_counter long, last_ts timestamp_ntz"


def _rates(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A source's new samples of one micro-batch, as arrays; what came before is only the last (counter, ts)."""
    new = pd.concat(list(pdfs)).sort_values(["ts", "counter"], kind="stable")
    count, ts = new["counter"].to_numpy(np.int64), new["ts"].to_numpy("datetime64[us]")
    before = state.get if state.exists else None
    last_c, last_t = (before[0], np.datetime64(before[1], "us")) if before else (count[0], ts[0])
    delta = np.diff(count, prepend=last_c)
    elapsed = np.diff(ts, prepend=last_t) / np.timedelta64(1, "s")
    rate = np.divide(delta, elapsed, out=np.zeros(len(delta)), where=elapsed > 0)
    state.update((int(count[-1]), pd.Timestamp(ts[-1]).to_pydatetime()))
    yield pd.DataFrame({"user_id": key[0], "ts": new["ts"].to_numpy(), "counter": count, "delta": delta, "rate": rate, "reset": delta < 0})


def counter_rates_stream(samples: DataFrame) -> DataFrame:
    """M2: counter → delta and rate per source across micro-batches; first sample 0; a negative delta
    (counter reset) is flagged. State per key is the last (counter, ts), so a task holds a source's rows of one
    micro-batch, never its history; the source's ``maxFilesPerTrigger`` bounds the batch."""
    return samples.select("user_id", "ts", "counter").groupBy("user_id").applyInPandasWithState(
        _rates, RATE_SCHEMA, RATE_STATE, "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ M3 ----

def peaks_and_totals(events: DataFrame) -> DataFrame:
    """M3: per source peak value and totals since start (update mode)."""
    return events.groupBy("user_id").agg(F.max("value").alias("peak_value"), F.count(F.lit(1)).alias("events"))


# ------------------------------------------------------------------ M7 ----

def health_alerts(windows: DataFrame, min_events: int = 10, max_error_share: float = 0.10, max_latency: float | None = None,
                  max_waiting: int | None = None, min_hit_rate: float | None = None, max_utilisation: float | None = 0.9,
                  max_preemption_rate: float | None = 0.5, max_truncated_share: float | None = 0.1, min_truncated: int = 5) -> DataFrame:
    """M7: one row per window and alert: error_share over its limit once enough events were seen; mean latency, waiting
    requests, utilisation or preemptions a second over theirs; a hit rate under its; and, once ``min_truncated`` answers were cut short, their share of
    the events over its. A limit of None, or a column that is not there, raises no alert."""
    enough = F.col("events") >= min_events
    share = F.try_divide(F.col("errors"), F.col("events"))
    checks = [("error_share", share, enough & (share > max_error_share))]
    if max_latency is not None and "mean_latency" in windows.columns:
        checks.append(("latency", F.col("mean_latency"), enough & (F.col("mean_latency") > max_latency)))
    if max_waiting is not None and "waiting" in windows.columns:
        checks.append(("waiting", F.col("waiting").cast("double"), F.col("waiting") > max_waiting))
    if min_hit_rate is not None and "hit_rate" in windows.columns:
        checks.append(("hit_rate", F.col("hit_rate"), enough & (F.col("hit_rate") < min_hit_rate)))
    if max_utilisation is not None and "utilisation" in windows.columns:
        checks.append(("utilisation", F.col("utilisation"), F.col("utilisation") > max_utilisation))
    if max_preemption_rate is not None and "preemption_rate" in windows.columns:
        checks.append(("preemption_rate", F.col("preemption_rate").cast("double"), F.col("preemption_rate") > max_preemption_rate))
    if max_truncated_share is not None and "truncated" in windows.columns:
        cut = F.try_divide(F.col("truncated"), F.col("events"))
        checks.append(("truncated", cut, enough & (F.col("truncated") >= min_truncated) & (cut > max_truncated_share)))
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("alert"), value.alias("value"))) for name, value, cond in checks]), lambda x: x.isNotNull())
    return windows.select("window_start", "events", "errors", F.inline(found))


# ------------------------------------------------------------------ M8 ----

def sliding_mean(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """M8: trailing mean of value over a sliding event-time window (bounded history)."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .groupBy(F.window("ts", size, slide).alias("w"))
            .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "mean_value", "events"))


# -------------------------------------------------------------- M4 / M5 ----

def incremental_save(stream: DataFrame, path: str, query_name: str, keys: list[str], partition_by: str | None = None):
    """M4/M5: append each micro-batch under ``batch_id=<id>`` (overwrite of the same id on replay makes
    it idempotent); the checkpoint makes a restart resume without rework. Read back with
    ``read_saved`` which keeps one row per key."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int):
        w = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        target = f"{path.rstrip('/')}/batch_id={batch_id}"
        (w.partitionBy(partition_by) if partition_by else w).parquet(target)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_for(spark, query_name))
            .trigger(availableNow=True).start())


def read_saved(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Read incremental output; the latest batch wins per key (aggregate, not a window)."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    g = df.groupBy(*keys).agg(F.max(F.struct("batch_id", *cols)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def run_to_memory(df: DataFrame, name: str, mode: str = "append"):
    """Drive a streaming DataFrame to completion into a memory table (tests / smoke)."""
    import uuid

    spark = df.sparkSession
    # a fresh checkpoint per call: this helper replays the whole source, it does not resume
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint_for(spark, f"{name}-{uuid.uuid4().hex}")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


__all__ = ["event_stream", "window_counts", "counter_rates_stream", "peaks_and_totals", "health_alerts",
           "sliding_mean", "incremental_save", "read_saved", "run_to_memory", "table_path"]
