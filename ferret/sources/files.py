"""File sources and sinks (S1–S4, S6, S8, S9, S11). Explicit schemas; never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.functions.text import utf8


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array file (or directory of them) → rows; a missing path raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json_arrays(rows: DataFrame, path: str, file_of: Column) -> None:
    """S1 sink: a folder of JSON array files, one for each value of ``file_of``, which must bound what one file holds."""
    d = rows.select(file_of.cast("long").alias("file"), F.struct(*rows.columns).alias("row"))
    arrays = d.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list("row"))).alias("value"))
    arrays.write.partitionBy("file").text(path)


MANIFEST_SCHEMA = ("repo_name string, file_path string, original_path string, paper_title string, "
                   "domain string, ml_imports string")


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """CSV manifest with a header row, all columns strings."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """S2 sink: one CSV directory with a header (Spark writes part files in parallel)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def scan_corpus(spark: SparkSession, root: str, globs: tuple[str, ...] = ("*.py", "*.ipynb")) -> DataFrame:
    """S3: recursive scan → (path, content, size); undecodable bytes are dropped. One table, read in
    parallel splits, not one file per task."""
    parts = []
    for g in globs:
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                     .option("pathGlobFilter", g).load(root))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.select("path", utf8(F.col("content")).alias("content"), F.col("length").alias("size"))


def notebook_code(nb: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Code cells only; ``source`` may be a string or a list of strings (joined with ''); cells are
    joined with a blank line. Returns (code, quarantine) — rows whose JSON does not parse go to quarantine.

    The cell's JSON type decides whether ``source`` is a list, not its text: a code string may itself look like one.
    """
    parsed = nb.withColumn("_nb", F.try_parse_json(F.col(content)))
    cells = F.try_variant_get("_nb", "$.cells", "array<variant>")
    parsed = parsed.withColumn("_cells", cells)
    bad = parsed.where(F.col("_cells").isNull()).drop("_nb", "_cells")
    ok = parsed.where(F.col("_cells").isNotNull())

    def src(c):
        # a list yields an array of strings; only a string is cast to a string unchanged
        lines = F.try_variant_get(c, "$.source", "array<string>")
        return F.coalesce(F.array_join(lines, ""), F.try_variant_get(c, "$.source", "string"), F.lit(""))

    code = F.filter("_cells", lambda c: F.try_variant_get(c, "$.cell_type", "string") == "code")
    out = ok.withColumn("code", F.array_join(F.transform(code, src), "\n\n")).drop("_nb", "_cells")
    return out, bad


def write_run_results(df: DataFrame, path: str, partition: str = "run_id") -> None:
    """Partitioned sink with dynamic partition overwrite: re-running one run replaces only its
    partition (idempotent), other runs stay. The mode is an option of this write; no session setting is touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


EXPECTED_SCHEMA = ("scenario string, verified boolean, "
                   "bugs array<struct<pattern_id: string, line: int, description: string>>")


def expected_bugs(spark: SparkSession, path: str, include_unverified: bool = False) -> DataFrame:
    """Expected-bug manifest → one row per (scenario, bug); unverified scenarios dropped unless asked."""
    df = spark.read.schema(EXPECTED_SCHEMA).option("multiLine", True).json(path)
    if not include_unverified:
        df = df.where(F.col("verified"))
    return df.select("scenario", F.explode_outer("bugs").alias("b")).select("scenario", "b.*")


LINE_RE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)"


def parse_exposition(df: DataFrame, text: str = "text", ts: str = "ts") -> DataFrame:
    """Exposition text → (ts, name, labels, value); comment lines and lines whose value is no number are skipped;
    scientific notation parsed."""
    lines = df.select(ts, F.explode(F.split(F.col(text), "\n")).alias("line")).where(
        ~F.trim("line").startswith("#") & (F.trim("line") != ""))
    number = F.regexp_replace(F.regexp_extract("line", LINE_RE, 3), r"^\+?Inf$", "Infinity")
    parsed = lines.select(ts, F.regexp_extract("line", LINE_RE, 1).alias("name"),
                          F.regexp_extract("line", LINE_RE, 2).alias("labels"), number.try_cast("double").alias("value"))
    return parsed.where((F.col("name") != "") & F.col("value").isNotNull())


def rollup_series(samples: DataFrame, ts: str = "ts") -> DataFrame:
    """Per (ts, base name): labelled series are summed; an unlabelled series wins over the sum."""
    unl = F.max(F.when(F.col("labels") == "", F.col("value")))
    lab = F.sum(F.when(F.col("labels") != "", F.col("value")))
    return samples.groupBy(ts, "name").agg(F.coalesce(unl, lab).alias("value"))


METRIC_LOG_SCHEMA = "timestamp timestamp, elapsed_s double, running long, waiting long, finished long, throughput double"


def metric_log_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append metric samples as CSV files (a file sink is exactly-once with its checkpoint)."""
    return (stream.writeStream.format("csv").option("header", True).option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Read the metric log back (batch)."""
    return spark.read.option("header", True).schema(METRIC_LOG_SCHEMA).csv(path)
