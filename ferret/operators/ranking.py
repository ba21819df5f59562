"""Windows, ranking, top-k and sampling.

Top-k per group uses ``row_number() <= k`` with a literal k, which Spark plans
as a map-side ``WindowGroupLimit`` before the shuffle, so a hot group ships at
most k rows per map task. Quotas that differ per group and per-key sequences
(running counters, lags, trailing frames) are prefix scans over range partitions
(``ferret.functions.prefix_scan``) so no task ever holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions.ordering import DEFAULT_SEED, seeded_hash
from ferret.functions.prefix_scan import prefix_scan
from ferret.operators import report as R
from ferret.plans.star import SEVERITY_ORDER, Star


def order_position(col: Column | str, order: list[str]) -> Column:
    """Position in a custom order (1-based); unknown values sort last."""
    c = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), c)
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1))


# ------------------------------------------------------------------ runs ----

def latest_runs(star: Star, n: int = 1, data_source: str | None = None, status: str | None = None) -> DataFrame:
    """The n most recent runs by started_at, then run_id (a top-n report)."""
    r = star.analysis_runs
    if data_source is not None:
        r = r.where(F.col("data_source") == data_source)
    if status is not None:
        r = r.where(F.col("status") == status)
    return r.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)


def latest_scan_per_repo(star: Star) -> DataFrame:
    """Latest scan per repo as an aggregate (max of a struct led by run_no) — partial-aggregated, skew-safe."""
    s = star.repo_scans
    rest = [c for c in s.columns if c not in ("repo_id", "run_no")]
    g = s.groupBy("repo_id").agg(F.max(F.struct("run_no", *rest)).alias("_s"))
    return g.select("repo_id", "_s.*")


# ------------------------------------------------------------- examples ----

def top_examples_per_category(star: Star, k: int = 3, run_id: int | None = None, verified_only: bool = False) -> DataFrame:
    """Top-k findings per (run, category) by confidence (id breaks ties), enriched after the cut."""
    fn = R._run(R.verified_findings(star, verified_only), run_id)
    w = Window.partitionBy("run_id", "category").orderBy(F.col("confidence").desc(), F.col("finding_id"))
    top = fn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    fa = star.file_analyses.select("file_analysis_id", "file_id")
    f = star.files.select("file_id", "repo_id", "file_path")
    r = star.repos.select("repo_id", "repo_name", "repo_url", "domain", "paper_id")
    p = star.papers.select("paper_id", F.col("title").alias("paper_title"))
    return (top.join(fa, "file_analysis_id").join(f, "file_id").join(r, "repo_id").join(p, "paper_id", "left")
            .select("run_id", "category", "rank", "finding_id", "pattern_id", "severity", "confidence", "focus_line",
                    "file_path", "repo_name", "repo_url", "domain", "paper_title"))


def diverse_selection(star: Star, limit: int = 20, run_id: int | None = None,
                      severities: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """Of the findings verified ``valid``, one per (paper, severity) (max confidence, then min id), critical before
    high, the best finding of each rule first, the rest fill up to ``limit`` (per run).

    Both "best of group" steps are aggregates (``max`` of a sort struct), not
    windows over the group, so a hot paper or rule is partial-aggregated.
    """
    ef = R.enriched_findings(star, run_id, status="valid").where(F.col("paper_id").isNotNull() & F.col("severity").isin(*severities))
    sev = order_position("severity", SEVERITY_ORDER)
    key = F.struct(F.col("confidence"), (-F.col("finding_id")).alias("nid"))
    best = (ef.groupBy("run_id", "paper_id", "severity")
            .agg(F.max(F.struct(key.alias("k"), F.col("finding_id"), F.col("pattern_id"))).alias("b"))
            .select("run_id", "paper_id", "severity", "b.finding_id", "b.pattern_id", F.col("b.k.confidence").alias("confidence")))
    rank_key = F.struct((-sev).alias("s"), F.col("confidence"), (-F.col("finding_id")).alias("nid"))
    first = (best.withColumn("sev", sev).groupBy("run_id", "pattern_id")
             .agg(F.max(F.struct(rank_key.alias("k"), F.col("finding_id"))).alias("b"))
             .select("run_id", F.col("b.finding_id").alias("finding_id"), F.lit(True).alias("first_of_rule")))
    scored = best.join(first, ["run_id", "finding_id"], "left").withColumn("sev", sev).select(
        "*", F.coalesce("first_of_rule", F.lit(False)).alias("is_first"))
    w = Window.partitionBy("run_id").orderBy(F.col("is_first").desc(), "sev", F.col("confidence").desc(), "finding_id")
    return (scored.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= limit)
            .select("run_id", "pick", "finding_id", "paper_id", "severity", "pattern_id", "confidence", "is_first"))


def verification_queue(star: Star) -> DataFrame:
    """Verified findings sorted valid < invalid < uncertain < error, then rule, then id."""
    fv = star.judged_findings.where(F.col("v_status").isNotNull()).withColumnRenamed("v_status", "status")
    return fv.select("run_id", "finding_id", "pattern_id", "severity", "status",
                     order_position("status", ["valid", "invalid", "uncertain", "error"]).alias("status_rank"),
                     order_position(F.coalesce("severity", F.lit("low")), SEVERITY_ORDER).alias("severity_rank")
                     ).orderBy("status_rank", "pattern_id", "finding_id")


# -------------------------------------------------------------- sampling ----

def balanced_sample(df: DataFrame, id_col: str, domain_col: str, limit: int, seed: int = DEFAULT_SEED,
                    order: list[Column] | None = None) -> DataFrame:
    """W7 (and W8 with ``order``): quota limit//k per domain, +1 for the first limit%k domains
    in seeded-hash order; rows ranked by ``order`` (default md5(seed‖id)); short domains are not back-filled.

    No quota exceeds ``limit``, so ``rank <= limit`` is tested first: Spark plans it as a map-side
    WindowGroupLimit and a hot domain ships at most ``limit`` rows per task.
    """
    d = df.where(F.col(domain_col).isNotNull())
    w = Window.partitionBy(domain_col).orderBy(*(order or [seeded_hash(seed, id_col)]))
    ranked = d.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= limit)
    doms = d.select(domain_col).distinct()
    k = doms.select(F.count(F.lit(1))).scalar()
    # of more than ``limit`` domains only the first ``limit`` get a row, so no more are ever numbered
    first = doms.withColumn("_h", seeded_hash(seed, domain_col)).orderBy("_h", domain_col).limit(limit)
    place = F.row_number().over(Window.orderBy("_h", domain_col))
    quota = first.withColumn("_place", place).select(
        domain_col, (F.floor(F.lit(limit) / k) + (F.col("_place") <= F.lit(limit) % k).cast("long")).alias("quota"))
    return ranked.join(quota, domain_col).where(F.col("sample_rank") <= F.col("quota"))


def group_sample(star: Star, n_papers: int, seed: int = DEFAULT_SEED, include_orphans: bool = False) -> DataFrame:
    """The n papers first in seeded-hash order, with all their files (left semi join on the picked papers).
    Files without a paper are returned only with ``include_orphans``."""
    f = star.files.join(star.repos.select("repo_id", "paper_id"), "repo_id").select("file_id", "repo_id", "paper_id", "file_path")
    picked = f.where(F.col("paper_id").isNotNull()).select("paper_id").distinct().orderBy(seeded_hash(seed, "paper_id")).limit(n_papers)
    out = f.join(picked, "paper_id", "left_semi")
    return out.unionByName(f.where(F.col("paper_id").isNull())) if include_orphans else out


def dedup_ordered(df: DataFrame, key: str | Column, order_col: str, keep: str = "first") -> DataFrame:
    """One row per key, the first (or last) by an input-order column, as an aggregate."""
    k = F.col(key) if isinstance(key, str) else key
    cols = [c for c in df.columns]
    pick = F.min if keep == "first" else F.max
    g = df.withColumn("_key", k).groupBy("_key").agg(pick(F.struct(order_col, *[c for c in cols if c != order_col])).alias("_r"))
    return g.select(F.col("_key").alias("dedup_key"), "_r.*")


# ------------------------------------------------------- metric samples ----

def _samples(events: DataFrame) -> DataFrame:
    """Samples of the sources with their integer counters."""
    return events.select("user_id", "ts", "event_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("cents"),
                         (F.col("event_type") == "purchase").cast("long").alias("hit"), (F.col("event_type") == "click").cast("long").alias("query"))


SAMPLE_ORDER = ["ts", "event_id"]


def metric_samples(events: DataFrame) -> DataFrame:
    """Per source (user) counters over time: cumulative samples, purchases (hits) and clicks (queries)."""
    return prefix_scan(_samples(events), ["user_id"], SAMPLE_ORDER, rn="counter", sums={"hits": "hit", "queries": "query", "value_cents": "cents"}).drop("cents", "hit", "query")


def counter_rates(events: DataFrame) -> DataFrame:
    """Counter → delta and rate per source; first sample 0; elapsed ≤ 0 → 0."""
    m = prefix_scan(events.select("user_id", "ts", "event_id"), ["user_id"], SAMPLE_ORDER, rn="counter", lags={"prev_ts": ("ts", 1)})
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / 1e6
    delta = F.when(F.col("counter") == 1, F.lit(0).cast("long")).otherwise(F.lit(1).cast("long"))  # the counter counts samples
    return m.select(
        "user_id", "ts", "event_id", "counter", delta.alias("delta"),
        F.coalesce(elapsed, F.lit(0.0)).alias("elapsed_s"),
        F.when((F.col("counter") == 1) | (elapsed <= 0) | elapsed.isNull(), F.lit(0.0)).otherwise(delta / elapsed).alias("rate"))


def trailing_metrics(events: DataFrame, w: int = 5) -> DataFrame:
    """W12 + W13: trailing mean of value and rolling hit ratio over the last w samples per source."""
    t = prefix_scan(_samples(events), ["user_id"], SAMPLE_ORDER, rn="rn", trailing={"w_value": ("cents", w), "w_hits": ("hit", w), "w_queries": ("query", w)})
    return t.select(
        "user_id", "ts", "event_id", "rn",
        (F.col("w_value").cast("double") / F.least(F.col("rn"), F.lit(w)) / 100.0).alias("moving_avg"),
        F.when(F.col("w_queries") > 0, F.col("w_hits") / F.col("w_queries")).otherwise(F.lit(0.0)).alias("hit_ratio"))


def running_peaks(events: DataFrame) -> DataFrame:
    """Running maximum of value per source."""
    return prefix_scan(events.select("user_id", "ts", "event_id", "value"), ["user_id"], SAMPLE_ORDER, maxes={"peak_value": "value"})


def line_chunks(docs: DataFrame, size: int = 500, step: int = 400) -> DataFrame:
    """Overlapping line windows: starts 0, step, 2·step … < n; window [start, min(start+size, n)), with its text."""
    lines = F.split(F.col("text"), "\n", -1)
    d = docs.select("doc_id", lines.alias("_lines"))
    n = F.size("_lines").cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")), F.lit(step).cast("long"))
    x = d.select("doc_id", "_lines", n.alias("_n"), F.posexplode(starts).alias("chunk_no", "_start"))
    return x.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), (F.col("_start") + 1).alias("start_line"),
                    F.least(F.col("_start") + size, F.col("_n")).alias("end_line"),
                    F.array_join(F.slice("_lines", (F.col("_start") + 1).cast("int"), F.lit(size)), "\n").alias("chunk"))
