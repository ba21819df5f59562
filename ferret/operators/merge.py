"""Keyed tables in buckets and merges that rewrite only the buckets they touch.

Rows are dealt into ``bucket=<n>`` folders by a hash of their key, so a key has one place. A merge reads the touched
buckets only (partition pruning), merges there in one join, writes the result to a staged table and then replaces just those
buckets (dynamic partition overwrite); files of other buckets are not read, moved or written, and none is where no row differs. A merge is idempotent: run again,
after a lost driver or in doubt, it gives the same table. Where a merge is broken off between two buckets, running it again completes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ferret.functions.ordering import chunked_row_number, hash_chunks
from ferret.functions.staging import stage

BUCKET = "bucket"
STEPS = ("updated", "inserted", "unchanged")


class KeyedTable:
    """A table of one row a key under ``path``. Null keys are a key of their own."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, dealt: DataFrame) -> None:
        # one task a bucket writes one file; a bucket holds about 1/buckets of the keys, whatever the keys are
        dealt.repartition(self.buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> KeyedTable:
        self._write(self._dealt(rows))
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.fieldNames())

    def merge(self, updates: DataFrame, recency: str | None = None, cols: list[str] | None = None, insert: bool = True) -> dict[str, int]:
        """Write ``updates`` into the table: rows of a known key replace its columns ``cols`` (default: all), rows of a new key are inserted
        (with ``insert``; columns that updates lack are null). Of several updates of one key the most recent wins, then the greatest
        values. With ``recency`` an update older than the row it meets is left out; of equally recent ones the update wins.
        Nulls are written. Returns how many rows of the touched buckets were updated, inserted and left as they are."""
        names, key = self.schema.fieldNames(), self.key
        cols = [c for c in (cols or names) if c != key]
        given = [c for c in names if c in updates.columns and c != key]
        lead = [recency] if recency else []
        up = self._dealt(updates.select(key, *given)).groupBy(key, BUCKET).agg(F.max(F.struct(*lead, *[c for c in given if c != recency])).alias("_u"))
        up = stage(up, "updates")
        touched = sorted(r[BUCKET] for r in up.select(BUCKET).distinct().collect())  # at most ``buckets``
        if not touched:
            return dict.fromkeys(STEPS, 0)
        stored = self._stored().where(F.col(BUCKET).isin(touched)).withColumn("_known", F.lit(True))
        up = up.withColumnsRenamed({key: "_key", BUCKET: "_bucket"})
        j = stored.join(up, F.col(key).eqNullSafe(F.col("_key")) & (F.col(BUCKET) == F.col("_bucket")), "full" if insert else "left")
        new, applies = F.col("_known").isNull(), F.col("_known") & F.col("_u").isNotNull()
        if recency:
            older = F.col("_u")[recency] < F.col(recency)
            applies = applies & ~F.coalesce(older, F.col("_u")[recency].isNull() & F.col(recency).isNotNull())
        have, kinds = [c for c in cols if c in given], {f.name: f.dataType for f in self.schema.fields}
        fresh = {c: F.when(new, (F.col("_u")[c] if c in given else F.lit(None)).cast(kinds[c])) for c in names if c != key}
        values = [(fresh[c].when(applies, F.col("_u")[c]) if c in have else fresh[c]).otherwise(F.col(c)).alias(c) for c in names if c != key]
        differs = new
        for c in have:
            differs = differs | (applies & ~F.col("_u")[c].eqNullSafe(F.col(c)))
        out = j.select(F.when(new, F.col("_key")).otherwise(F.col(key)).alias(key), *values, F.when(new, F.col("_bucket")).otherwise(F.col(BUCKET)).alias(BUCKET),
                       F.when(new, "inserted").when(applies, "updated").otherwise("unchanged").alias("_step"), differs.alias("_differs"))
        merged = stage(out, "merged")
        steps = merged.groupBy("_step").agg(F.count(F.lit(1)).alias("n"), F.max("_differs").alias("differs")).collect()
        if any(r["differs"] for r in steps):  # not where the table holds the updates already
            self._write(merged.drop("_step", "_differs"))
        return dict.fromkeys(STEPS, 0) | {r["_step"]: r["n"] for r in steps}

    def insert_new(self, incoming: DataFrame, id_col: str) -> int:
        """Rows of new, non-null keys with surrogate ids max(id) + rank by md5(key); known keys are not changed. Run again it inserts
        nothing. Only buckets that get rows are rewritten."""
        key, names = self.key, self.schema.fieldNames()
        extra = [c for c in names if c in incoming.columns and c not in (key, id_col)]
        one = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.lit(0).alias("_"), *extra)).alias("_u"))
        new = stage(one.join(self.read().select(key), key, "left_anti").select(key, *[F.col("_u")[c].alias(c) for c in extra]), "new")
        top = self.read().select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
        ranked = chunked_row_number(new.withColumn("_h", F.md5(F.col(key).cast("string"))), [], [F.col("_h"), F.col(key)], hash_chunks(F.col("_h")), out="_rn")
        return self.merge(ranked.select(key, *extra, (top + F.col("_rn")).alias(id_col)))["inserted"]
