"""Rule catalog and the rule scan.

Each document meets the whole (bounded) rule catalogue at once — the Spark analogue of the reference's shared prompt
prefix — and becomes (document, rule) rows only on output, so no text is ever replicated through a shuffle. The default
scorer counts all patterns in one pass over the bytes of an Arrow batch; a plugged scorer ``(pandas.DataFrame[doc_id, text],
rules) -> rows`` runs in ``mapInPandas``. Filters on rules and documents belong below the scan.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.functions.patterns import PatternCounter, text_slices
from ferret.functions.text import utf8
from ferret.plans.star import Star

RULE_RUN_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("rule_no", T.LongType()),
    T.StructField("pattern_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("detected", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("n_matches", T.LongType()),
])

# Demo detection rule: rule i looks for the syllable CONSONANTS[i % 11] + VOWELS[(i // 11) % 6].
CONSONANTS = "tnrshldcmwb"
VOWELS = "aeiouy"


def syllable(rule_no: int) -> str:
    return CONSONANTS[rule_no % 11] + VOWELS[(rule_no // 11) % 6]


def rule_catalog(star: Star) -> DataFrame:
    """Rules with their (demo) detection pattern; users may add rows with their own patterns."""
    syl = F.concat(F.element_at(F.split(F.lit(CONSONANTS), ""), (F.col("rule_no") % 11 + 1).cast("int")),
                   F.element_at(F.split(F.lit(VOWELS), ""), ((F.col("rule_no") / 11).cast("long") % 6 + 1).cast("int")))
    return star.rules.withColumn("pattern", syl)


def select_rules(rules: DataFrame, severities: list[str] | None = None, ids: list[str] | None = None,
                 categories: list[str] | None = None) -> DataFrame:
    """Severity set AND optional id set AND optional category set; empty optional set = no filter."""
    r = rules
    if severities:
        r = r.where(F.col("severity").isin(*severities))
    if ids:
        r = r.where(F.col("pattern_id").isin(*ids))
    if categories:
        r = r.where(F.col("category").isin(*categories))
    return r


def parse_rule_toml(path: str, content: str) -> dict | None:
    """S7 helper: one rule definition; a bad file yields None (the caller reports it)."""
    try:
        d = tomllib.loads(content)
        meta = d.get("meta", d)
        return {"id": meta["id"], "name": meta.get("name"), "category": meta.get("category"),
                "severity": meta.get("severity"), "question": d.get("detection", {}).get("question"),
                "tags": list(meta.get("tags", [])), "path": path}
    except (tomllib.TOMLDecodeError, KeyError, AttributeError, TypeError):
        return None


def load_rule_catalog(spark, directory: str) -> tuple[DataFrame, DataFrame]:
    """Directory of rule definitions → (rule table, paths of files that could not be parsed)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.toml").load(directory).select("path", utf8(F.col("content")).alias("content")))
    schema = "id string, name string, category string, severity string, question string, tags array<string>, path string"
    names = ["id", "name", "category", "severity", "question", "tags", "path"]

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [parse_rule_toml(p, c) or dict.fromkeys(names) | {"path": p} for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=names, dtype=object)
    parsed = files.mapInPandas(parse, schema)
    return parsed.where(F.col("id").isNotNull()), parsed.where(F.col("id").isNull()).select("path")


Scorer = Callable[[pd.DataFrame, list[dict]], pd.DataFrame]


MAX_RULES = 100_000


def rule_scan(docs: DataFrame, rules: DataFrame, scorer: Scorer | None = None, wanted: str | None = None) -> DataFrame:
    """T16 + J10: every document × every selected rule, one row per pair; with ``wanted``, a column of rule numbers, only those of a document.

    Default scorer: occurrences of the rule's pattern in the lower-cased text (non-overlapping);
    confidence = min(0.5 + 0.05·n, 0.99); yes ≥ 0.7, context-dependent ≥ 0.6. A text is read once for the whole catalogue. It never
    fails; statuses such as ``timeout`` or ``context_length`` come from plugged scorers. The catalogue is a bounded
    configuration table (checked), read once on the driver.
    """
    catalogue = rules.select("rule_no", "pattern_id", "pattern").orderBy("rule_no", "pattern_id").limit(MAX_RULES + 1).collect()
    if len(catalogue) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if scorer is not None:
        known = [r.asDict() for r in catalogue]
        lists = [wanted] if wanted else []

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                if len(pdf):
                    found = scorer(pdf[["doc_id", "text"]], known).astype({"doc_id": "int64", "rule_no": "int64"})
                    if wanted:
                        asked = {(d, n) for d, ns in zip(pdf["doc_id"], pdf[wanted]) for n in ns}
                        found = found[[pair in asked for pair in zip(found["doc_id"], found["rule_no"])]]
                    yield found
        return docs.select("doc_id", "text", *lists).mapInPandas(run, RULE_RUN_SCHEMA)
    number = np.array([r.rule_no for r in catalogue], np.int64)
    names = pa.array([r.pattern_id for r in catalogue], pa.string())
    patterns = [r.pattern or "" for r in catalogue]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PatternCounter(patterns)
        for b in batches:
            for s in text_slices(b):
                n = counter.counts(s.column(1))
                row, which = np.repeat(np.arange(len(n)), len(number)), np.tile(np.arange(len(number)), len(n))
                if wanted:
                    pairs = set(zip(np.repeat(np.arange(len(n)), s.column(2).value_lengths()).tolist(), s.column(2).flatten().to_pylist()))
                    asked = np.fromiter((pair in pairs for pair in zip(row.tolist(), number[which].tolist())), bool, len(row))
                    row, which = row[asked], which[asked]
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(row)), pa.array(number[which]), names.take(pa.array(which)), pa.array(n[row, which])],
                                                 names=["doc_id", "rule_no", "pattern_id", "n_matches"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), *([F.col(wanted).cast("array<long>")] if wanted else [])).mapInArrow(count, "doc_id long, rule_no long, pattern_id string, n_matches long")
    conf = F.least(F.lit(0.5) + F.lit(0.05) * F.col("n_matches"), F.lit(0.99))
    return x.select("doc_id", "rule_no", "pattern_id", F.lit("success").alias("status"),
                    F.when(conf >= 0.7, "yes").when(conf >= 0.6, "context-dependent").otherwise("no").alias("detected"),
                    conf.alias("confidence"), "n_matches")


def scan_findings(rule_runs: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Detected in (yes, context-dependent) and confidence ≥ min; at most one per (document, rule)."""
    return rule_runs.where((F.col("status") == "success") & F.col("detected").isin("yes", "context-dependent")
                           & (F.col("confidence") >= min_confidence))


def file_status(rule_runs: DataFrame) -> DataFrame:
    """Per document rule counts by status; the file failed when every rule failed."""
    g = rule_runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"),
                                        F.count_if(F.col("status") == "success").alias("succeeded"))
    return g.select("doc_id", "rules", "succeeded", (F.col("succeeded") == 0).alias("failed"))


def failed_runs(rule_runs: DataFrame, statuses: list[str]) -> DataFrame:
    """The rule runs to repeat."""
    return rule_runs.where(F.col("status").isin(*statuses))


def rescan(failed: DataFrame, docs: DataFrame, rules: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Run the failed (document, rule) pairs again and return their new status, detected and confidence by
    pattern_run_id. ``failed``: pattern_run_id, doc_id, rule_no.

    The work list has every pair once, as a list of rules by document (at most the catalogue), so a text is read once however many
    runs of it failed, and only the listed rules come back. Pairs without a document or a rule have no new result."""
    work = failed.select("doc_id", "rule_no").distinct().groupBy("doc_id").agg(F.collect_list("rule_no").alias("wanted"))
    texts = docs.select("doc_id", "text").join(work, "doc_id")
    again = rule_scan(texts, rules, scorer, wanted="wanted").select("doc_id", "rule_no", "status", "detected", "confidence")
    return failed.select("pattern_run_id", "doc_id", "rule_no").join(again, ["doc_id", "rule_no"]).select("pattern_run_id", "status", "detected", "confidence")
