"""Counter rates and bounded history of a stream of samples, with no source in one task (M2, M8).

A stateful operator keyed by source hands all of a source's new samples to one task. Here every micro-batch is a prefix scan
over range partitions, so that a source with a third of the samples is dealt out like the others; what a source carries into the next
micro-batch is one row of fixed size (its last sample and its last ``history - 1`` values) in a bucketed table, which is merged at the end of
the micro-batch. Each row also keeps the state before its own batch: a batch that is replayed after a failure finds what it
started from, overwrites its own results and merges the same state again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ferret.functions.prefix_scan import prefix_scan
from ferret.operators.merge import KeyedTable
from ferret.streaming.metrics import checkpoint_for

SAMPLE = "struct<counter: bigint, ts: timestamp_ntz, ring: array<bigint>>"
STATE = f"user_id bigint, batch bigint, now {SAMPLE}, before {SAMPLE}"
RESULT = "user_id bigint, ts timestamp_ntz, counter bigint, delta bigint, rate double, reset boolean, mean_value double"
HISTORY = 120


class RateStream:
    """Rates of the samples (user_id, ts, counter, cents) of a stream, written under ``path``."""

    def __init__(self, spark, path: str, name: str, history: int = HISTORY, buckets: int = 16):
        self.spark, self.path, self.name, self.history = spark, path.rstrip("/"), name, history
        self.state = KeyedTable(spark, f"{self.path}/state", "user_id", StructType.fromDDL(STATE), buckets)

    def _known(self, batch_id: int) -> DataFrame:
        """What each source carries into the batch."""
        s = self.state.read()
        return s.select(F.col("user_id").alias("u"), F.when(F.col("batch") == batch_id, F.col("before")).otherwise(F.col("now")).alias("s"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: its rates, then the state it leaves. Applying it again changes nothing."""
        new = batch.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "counter", "cents")
        x = prefix_scan(new, ["user_id"], ["ts", "counter"], rn="rn", lags={"prev_counter": ("counter", 1), "prev_ts": ("ts", 1)}, trailing={"sum": ("cents", self.history)})
        j = x.join(self._known(batch_id), F.col("user_id").eqNullSafe(F.col("u")), "left")
        first, ring = F.col("rn") == 1, F.coalesce("s.ring", F.array().cast("array<bigint>"))
        was, at = (F.when(first, F.col(f"s.{c}")).otherwise(F.col(f"prev_{c}")) for c in ("counter", "ts"))
        more = F.least(F.size(ring), F.greatest(F.lit(self.history) - F.col("rn"), F.lit(0)).cast("int"))
        total = F.col("sum") + F.aggregate(F.slice(ring, F.size(ring) - more + 1, more), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0)))
        elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6
        delta = F.when(was.isNull(), F.lit(0).cast("long")).otherwise(F.col("counter") - was)
        out = j.select("user_id", "ts", "counter", delta.alias("delta"), F.when(was.isNull() | (elapsed <= 0), F.lit(0.0)).otherwise(delta / elapsed).alias("rate"),
                       (delta < 0).alias("reset"), (total / (F.least(F.col("rn"), F.lit(self.history)) + more) / 100.0).alias("mean_value"))
        out.write.mode("overwrite").parquet(f"{self.path}/rates/batch_id={batch_id}")
        # the state after the batch: the last sample and the last values of each source that had samples, old values first
        w = Window.partitionBy("user_id").orderBy(F.col("rn").desc())
        tail = x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= self.history)  # cut map-side
        last = tail.groupBy("user_id").agg(F.max(F.struct("rn", "counter", "ts")).alias("l"), F.sort_array(F.collect_list(F.struct("rn", "cents"))).alias("v"))
        k = last.join(self._known(batch_id), F.col("user_id").eqNullSafe(F.col("u")), "left")
        both = F.concat(F.coalesce("s.ring", F.array().cast("array<bigint>")), F.transform("v", lambda e: e["cents"]))
        keep = F.least(F.size(both), F.lit(self.history - 1))
        now = F.struct(F.col("l.counter").alias("counter"), F.col("l.ts").alias("ts"), F.slice(both, F.size(both) - keep + 1, keep).alias("ring"))
        self.state.merge(k.select("user_id", F.lit(batch_id).cast("long").alias("batch"), now.alias("now"), F.col("s").alias("before")))

    def run(self, stream: DataFrame):
        """Drive the stream over what is there; a later call goes on where this one ended."""
        if not self._started():
            self.state.create(self.spark.createDataFrame([], self.state.schema))
        return (stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint_for(self.spark, self.name)).trigger(availableNow=True).start())

    def _started(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.state.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rates(self) -> DataFrame:
        return self.spark.read.schema(RESULT).parquet(f"{self.path}/rates").select(*[c.split()[0] for c in RESULT.split(", ")])
