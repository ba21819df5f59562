"""Run-report operators over the star (J1–J9 building blocks, A1–A17, A37, A38).

Every operator works for one run (``run_id=...``) or for all runs at once
(``run_id=None``, grouped by ``run_id``), so a full report is one pass over the
facts instead of one SQL statement per run / severity / category.

Plan rules used throughout:
* facts are pre-aggregated to the (run, file) or (run, repo) grain before the
  next join, so conditional distinct counts become ``count_if`` on a unique
  grain (no Expand node, no multi-distinct blow-up);
* ``run_id`` sits on the facts, so the run filter is a pushed scan predicate;
* only the 66-row rule table and fixed severity lists are broadcast; every
  other join is planned by AQE from runtime sizes (sort-merge + skew split
  when large, broadcast when measured small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.plans.star import SEVERITY_ORDER, Star


def _run(df: DataFrame, run_id: int | None) -> DataFrame:
    return df if run_id is None else df.where(F.col("run_id") == F.lit(run_id))


def avg_cents(c: str) -> F.Column:
    """Mean of a 2-decimal score computed on integer cents: exact, and bit-identical in any engine."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100.0


def rate(num, den) -> F.Column:
    """A4: 100·num/den, 0 when the denominator is 0."""
    return F.when(den > 0, F.lit(100.0) * num / den).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- joins ----

def join_verifications(findings: DataFrame, verifications: DataFrame) -> DataFrame:
    """Findings with their verification as ``v_`` columns, null where pending (left join on the finding)."""
    v = verifications.select("finding_id", *[F.col(c).alias(f"v_{c}") for c in ("status", "reasoning", "model", "verified_at")])
    return findings.join(v, "finding_id", "left")


def verified_findings(star: Star, verified_only: bool, status: str | None = None) -> DataFrame:
    """All findings; with ``verified_only`` those with a verification that is no error; or those of one status."""
    v = F.col("v_status")
    j = star.judged_findings
    if status is not None:
        j = j.where(v == status)
    elif verified_only:
        j = j.where(v != "error")
    return j.drop("v_status", "v_reasoning", "v_model", "v_verified_at")


def findings_per_file(star: Star, run_id: int | None = None, verified_only: bool = False) -> DataFrame:
    """(run_id, file_analysis_id, n_findings) — the pre-aggregated right side of J2."""
    return (_run(verified_findings(star, verified_only), run_id)
            .groupBy("run_id", "file_analysis_id").agg(F.count(F.lit(1)).alias("n_findings")))


def analysed_files(star: Star, run_id: int | None = None) -> DataFrame:
    """J1 + J2: one row per analysed file of a run with its finding count (0 when none)."""
    fa = _run(star.file_analyses, run_id)
    per_file = findings_per_file(star, run_id)
    j = fa.join(per_file, ["run_id", "file_analysis_id"], "left")
    return j.join(star.files.select("file_id", "repo_id"), "file_id").select(
        "run_id", "file_analysis_id", "file_id", "repo_id", "status",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def enriched_findings(star: Star, run_id: int | None = None, verified_only: bool = False, status: str | None = None) -> DataFrame:
    """J1 + J3 (+J4): findings with file, repo and (left) paper columns."""
    fn = _run(verified_findings(star, verified_only, status), run_id)
    fa = star.file_analyses.select("file_analysis_id", "file_id")
    f = star.files.select("file_id", "repo_id", "file_path")
    r = star.repos.select("repo_id", "repo_name", "repo_url", "domain", "paper_id")
    p = star.papers.select("paper_id", F.col("title").alias("paper_title"))
    return fn.join(fa, "file_analysis_id").join(f, "file_id").join(r, "repo_id").join(p, "paper_id", "left")


# ------------------------------------------------------------ run stats ----

def run_totals(star: Star, run_id: int | None = None) -> DataFrame:
    """A1 + A4: analysed files (all statuses), files with findings, findings, success and finding rates."""
    per = analysed_files(star, run_id).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("analyzed_files"),
        F.count_if(F.col("n_findings") > 0).alias("files_with_findings"),
        F.sum("n_findings").alias("total_findings"))
    runs = _run(star.analysis_runs, run_id).select("run_id", "total_files")
    return per.join(runs, "run_id").select(
        "run_id", "total_files", "analyzed_files", "files_with_findings", "total_findings",
        rate(F.col("analyzed_files"), F.col("total_files")).alias("analysis_success_rate"),
        rate(F.col("files_with_findings"), F.col("analyzed_files")).alias("finding_rate"))


def repo_coverage(star: Star, run_id: int | None = None) -> DataFrame:
    """A2: distinct repos and distinct repos with findings, via the (run, repo) grain."""
    g = analysed_files(star, run_id).groupBy("run_id", "repo_id").agg(F.max(F.col("n_findings") > 0).alias("hit"))
    return g.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_repos"),
                                   F.count_if("hit").alias("repos_with_findings"))


def paper_coverage(star: Star, run_id: int | None = None) -> DataFrame:
    """A3: distinct papers (not null) and those with findings."""
    af = analysed_files(star, run_id)
    r = star.repos.where(F.col("paper_id").isNotNull()).select("repo_id", "paper_id")
    g = af.join(r, "repo_id").groupBy("run_id", "paper_id").agg(F.max(F.col("n_findings") > 0).alias("hit"))
    return g.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_papers"),
                                   F.count_if("hit").alias("papers_with_findings"))


def findings_by_domain(star: Star, run_id: int | None = None) -> DataFrame:
    """A5: per domain files, analysed (success only), with findings, findings, finding rate."""
    af = analysed_files(star, run_id)
    r = star.repos.select("repo_id", "domain")
    g = af.join(r, "repo_id").groupBy("run_id", "domain").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "success").alias("analyzed_files"),
        F.count_if(F.col("n_findings") > 0).alias("files_with_findings"),
        F.sum("n_findings").alias("total_findings"))
    return g.select("run_id", F.coalesce("domain", F.lit("unknown")).alias("domain"),
                    "total_files", "analyzed_files", "files_with_findings", "total_findings",
                    rate(F.col("files_with_findings"), F.col("analyzed_files")).alias("finding_rate"))


def findings_by_category(star: Star, run_id: int | None = None) -> DataFrame:
    """Count, unique files, unique repos per category."""
    fn = _run(star.findings, run_id).groupBy("run_id", "category", "file_analysis_id").agg(F.count(F.lit(1)).alias("n"))
    f = star.file_analyses.select("file_analysis_id", "file_id").join(star.files.select("file_id", "repo_id"), "file_id")
    return fn.join(f, "file_analysis_id").groupBy("run_id", "category").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique_files"),
        F.count_distinct("repo_id").alias("unique_repos"))


def _top_by_count(df: DataFrame, k: int) -> DataFrame:
    # Window over an already-aggregated (run × rule) table: ≤ 66 rows per run.
    w = Window.partitionBy("run_id").orderBy(F.col("count").desc(), F.col("pattern_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def findings_by_rule(star: Star, run_id: int | None = None, k: int = 15) -> DataFrame:
    """Top-k rules by count; ``category`` taken deterministically as min."""
    g = _run(star.findings, run_id).groupBy("run_id", "pattern_id").agg(
        F.min("category").alias("category"), F.count(F.lit(1)).alias("count"),
        F.count_distinct("file_analysis_id").alias("unique_files"),
        avg_cents("confidence").alias("avg_confidence"))
    return _top_by_count(g, k)


def findings_by_severity(star: Star, run_id: int | None = None) -> DataFrame:
    """Finding count by raw severity (null kept)."""
    return _run(star.findings, run_id).groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("count"))


def top_rules(star: Star, run_id: int | None = None, k: int = 10, verified_only: bool = False) -> DataFrame:
    """Top rules with unique files and repos; verified_only switch.

    Pre-aggregated to the (run, rule, file) grain first, so the two distinct
    counts become one row count plus a single distinct (no Expand)."""
    fn = _run(verified_findings(star, verified_only), run_id)
    f = star.file_analyses.select("file_analysis_id", "file_id").join(star.files.select("file_id", "repo_id"), "file_id")
    per_file = fn.join(f, "file_analysis_id").groupBy("run_id", "pattern_id", "file_id", "repo_id").agg(
        F.min("category").alias("category"), F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("cents"))
    g = per_file.groupBy("run_id", "pattern_id").agg(
        F.min("category").alias("category"), F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique_files"), F.count_distinct("repo_id").alias("unique_repos"),
        (F.sum("cents").cast("double") / F.sum("n") / 100.0).alias("avg_confidence"))
    return _top_by_count(g, k)


def _severity_frame(runs: DataFrame) -> DataFrame:
    """runs × the 4 severity levels, by exploding a literal array (no join)."""
    return runs.select("run_id", F.explode(F.array(*[F.lit(s) for s in SEVERITY_ORDER])).alias("severity"))


def papers_by_severity(star: Star, run_id: int | None = None, verified_only: bool = False) -> DataFrame:
    """A10: distinct papers per severity (null → low), zero-filled for the 4 levels."""
    ef = enriched_findings(star, run_id, verified_only).where(F.col("paper_id").isNotNull())
    g = (ef.select("run_id", "paper_id", F.coalesce("severity", F.lit("low")).alias("severity"))
         .groupBy("run_id", "severity").agg(F.count_distinct("paper_id").alias("paper_count")))
    frame = _severity_frame(_run(star.analysis_runs, run_id))
    return frame.join(g, ["run_id", "severity"], "left").select(
        "run_id", "severity", F.coalesce("paper_count", F.lit(0)).alias("paper_count"))


def findings_distribution(star: Star, run_id: int | None = None, verified_only: bool = False) -> DataFrame:
    """Findings-per-paper distribution overall and per severity in one pass over the findings.

    Zero-finding papers are absent (as in the reference); a severity without
    papers reports zeros. Null severity counts only in ``all``.
    """
    ef = enriched_findings(star, run_id, verified_only).where(F.col("paper_id").isNotNull())
    per = ef.groupBy("run_id", "paper_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    # each (paper, severity) cell counts in "all" and, for a listed severity, in its own scope
    scope = F.explode(F.array(F.lit("all"), F.when(F.col("severity").isin(*SEVERITY_ORDER), F.col("severity"))))
    cells = per.select("run_id", "paper_id", "n", scope.alias("scope")).where(F.col("scope").isNotNull())
    cells = cells.groupBy("run_id", "paper_id", "scope").agg(F.sum("n").alias("n"))
    stats = cells.groupBy("run_id", "scope").agg(
        F.count(F.lit(1)).alias("papers"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.avg("n").alias("mean"),
        F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("stdev"),
        F.median("n").alias("median"))
    runs = _run(star.analysis_runs, run_id)
    frame = runs.select("run_id", F.explode(F.array(*[F.lit(s) for s in ["all", *SEVERITY_ORDER]])).alias("scope"))
    return frame.join(stats, ["run_id", "scope"], "left").select(
        "run_id", "scope", F.coalesce("papers", F.lit(0)).alias("papers"),
        F.coalesce("min", F.lit(0)).alias("min"), F.coalesce("max", F.lit(0)).alias("max"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("stdev", F.lit(0.0)).alias("stdev"),
        F.coalesce("median", F.lit(0.0)).alias("median"))


def verification_by_severity(star: Star, run_id: int | None = None) -> DataFrame:
    """A12 + J5: severity × status with pending (no verification row) and total; error counts in total only."""
    j = _run(star.judged_findings, run_id).select("run_id", F.coalesce("severity", F.lit("low")).alias("severity"), "v_status")
    st = F.coalesce("v_status", F.lit("pending"))
    g = j.groupBy("run_id", "severity").agg(
        *[F.count_if(st == s).alias(s) for s in ("valid", "invalid", "uncertain", "pending")],
        F.count(F.lit(1)).alias("total"))
    frame = _severity_frame(_run(star.analysis_runs, run_id))
    cols = ["valid", "invalid", "uncertain", "pending", "total"]
    return frame.join(g, ["run_id", "severity"], "left").select(
        "run_id", "severity", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def _judged(star: Star, run_id: int | None) -> DataFrame:
    return _run(star.judged_findings, run_id).where(F.col("v_status").isNotNull())


def _status_counts(*statuses: str) -> list[F.Column]:
    return [F.count_if(F.col("v_status") == s).alias(s) for s in statuses]


def verification_summary(star: Star, run_id: int | None = None) -> DataFrame:
    """Counts by status, precision with uncertain in the denominator, last verification and its model."""
    g = _judged(star, run_id).groupBy("run_id").agg(
        *_status_counts("valid", "invalid", "uncertain", "error"),
        F.max("v_verified_at").alias("verified_at"),
        F.max_by("v_model", F.struct("v_verified_at", "v_model")).alias("model"))
    tot = F.col("valid") + F.col("invalid") + F.col("uncertain")
    return g.select("run_id", "valid", "invalid", "uncertain", "error", tot.alias("total_verified"),
                    rate(F.col("valid"), tot).alias("precision"), "verified_at", "model")


def precision_by(star: Star, dim: str, run_id: int | None = None) -> DataFrame:
    """valid/invalid/uncertain per category or severity, precision rounded half-even to an integer."""
    key = F.coalesce(dim, F.lit("low")) if dim == "severity" else F.col(dim)
    g = _judged(star, run_id).groupBy("run_id", key.alias(dim)).agg(*_status_counts("valid", "invalid", "uncertain"))
    tot = F.col("valid") + F.col("invalid") + F.col("uncertain")
    prec = F.when(tot > 0, F.bround(F.col("valid") / tot * 100.0, 0)).otherwise(F.lit(0.0)).cast("long")
    return g.select("run_id", dim, "valid", "invalid", "uncertain", tot.alias("total"), prec.alias("precision"))


def rule_error_profile(star: Star, run_id: int | None = None, min_invalid: int = 1,
                       patterns: list[str] | None = None) -> DataFrame:
    """Per rule valid/invalid/uncertain/total, HAVING invalid ≥ k, precision = valid/(valid+invalid).

    Reasoning texts are not gathered into one array per rule (a hot rule would
    put an unbounded list in one row); ``rule_error_reasonings`` returns them
    as rows for the kept rules.
    """
    fn = _judged(star, run_id)
    if patterns:
        fn = fn.where(F.col("pattern_id").isin(*patterns))
    g = fn.groupBy("run_id", "pattern_id", "category").agg(*_status_counts("valid", "invalid", "uncertain"), F.count(F.lit(1)).alias("total"))
    ev = F.col("valid") + F.col("invalid")
    return g.where(F.col("invalid") >= min_invalid).select(
        "run_id", "pattern_id", "category", "valid", "invalid", "uncertain", "total",
        rate(F.col("valid"), ev).alias("precision"))


def rule_error_reasonings(star: Star, run_id: int | None = None, min_invalid: int = 1) -> DataFrame:
    """Companion of A15: (rule, status, reasoning) rows for the profiled rules, valid and invalid only."""
    prof = rule_error_profile(star, run_id, min_invalid).select("run_id", "pattern_id")
    fn = _judged(star, run_id).where(F.col("v_status").isin("valid", "invalid") & (F.col("v_reasoning") != ""))
    kept = fn.join(F.broadcast(prof), ["run_id", "pattern_id"], "left_semi")  # at most runs x rules rows
    return kept.select("run_id", "finding_id", "pattern_id", F.col("v_status").alias("status"), F.col("v_reasoning").alias("reasoning"))


def scan_statistics(star: Star) -> DataFrame:
    """Completed scans: counts, sums, mean duration, self-contained per distinct repo (denominator ≥ 1)."""
    s = star.repo_scans.where(F.col("status") == "completed")
    g = s.agg(F.count(F.lit(1)).alias("total_scans"), F.count_distinct("repo_id").alias("total_repos"),
              F.sum("files_total").alias("total_files"), F.sum("self_contained").alias("total_self_contained"),
              F.sum("fragments").alias("total_fragments"), F.sum("uncertain").alias("total_uncertain"),
              F.avg("duration_seconds").alias("avg_duration"))
    return g.select("*", (F.coalesce("total_self_contained", F.lit(0))
                            / F.greatest(F.col("total_repos"), F.lit(1))).alias("avg_self_contained_per_repo"))


def prefilter_funnel(star: Star, prefilter_run_id: int | None = None) -> DataFrame:
    """Distinct repos/papers before and after (self-contained), plus repos that lost every file."""
    pf = star.prefilter_file_results
    if prefilter_run_id is not None:
        pf = pf.where(F.col("prefilter_run_id") == prefilter_run_id)
    r = star.repos.select("repo_id", "paper_id")
    # (run, repo) grain first: one row per repo with "kept any file"
    per_repo = pf.groupBy("prefilter_run_id", "repo_id").agg(
        F.max(F.col("classification") == "self_contained").alias("kept"))
    per_repo = per_repo.join(r, "repo_id")
    repos = per_repo.groupBy("prefilter_run_id").agg(
        F.count(F.lit(1)).alias("original_repos"), F.count_if("kept").alias("filtered_repos"),
        F.count_if(~F.col("kept")).alias("dropped_repos"))
    papers = (per_repo.where(F.col("paper_id").isNotNull())
              .groupBy("prefilter_run_id", "paper_id").agg(F.max("kept").alias("kept"))
              .groupBy("prefilter_run_id").agg(F.count(F.lit(1)).alias("original_papers"),
                                               F.count_if("kept").alias("filtered_papers")))
    files = pf.groupBy("prefilter_run_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        *[F.count_if(F.col("classification") == c).alias(n) for c, n in
          (("self_contained", "self_contained"), ("fragment", "fragments"), ("uncertain", "uncertain"), ("error", "errors"))])
    return files.join(repos, "prefilter_run_id").join(papers, "prefilter_run_id", "left").fillna(0, ["original_papers", "filtered_papers"])


def dropped_repos(star: Star, prefilter_run_id: int | None = None) -> DataFrame:
    """Repos of a prefilter run with no self-contained file (left anti join, not NOT IN)."""
    pf = star.prefilter_file_results
    if prefilter_run_id is not None:
        pf = pf.where(F.col("prefilter_run_id") == prefilter_run_id)
    seen = pf.select("prefilter_run_id", "repo_id").distinct()
    kept = pf.where(F.col("classification") == "self_contained").select("prefilter_run_id", "repo_id").distinct()
    return (seen.join(kept, ["prefilter_run_id", "repo_id"], "left_anti")
            .join(star.repos.select("repo_id", "repo_name"), "repo_id"))


def success_files_with_findings(star: Star, run_id: int | None = None) -> DataFrame:
    """Successful files and those having a finding (IN-subquery inside CASE → left join to distinct ids)."""
    af = analysed_files(star, run_id).where(F.col("status") == "success")
    return af.groupBy("run_id").agg(F.count(F.lit(1)).alias("files_analyzed"),
                                    F.count_if(F.col("n_findings") > 0).alias("files_with_findings"))


def per_file_summary(star: Star, run_id: int | None = None) -> DataFrame:
    """Per file finding count, counts by severity and by category (bounded: ≤ 66 findings per file)."""
    fn = _run(star.findings, run_id)
    bys = fn.groupBy("run_id", "file_analysis_id", F.coalesce("severity", F.lit("low")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    byc = fn.groupBy("run_id", "file_analysis_id", F.col("category").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = bys.groupBy("run_id", "file_analysis_id").agg(F.sum("n").alias("n_findings"),
                                                       F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("by_severity"))
    c = byc.groupBy("run_id", "file_analysis_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("by_category"))
    return s.join(c, ["run_id", "file_analysis_id"])


def nested_results(star: Star, run_id: int | None = None) -> DataFrame:
    """Per successful file one result row with its findings as an array (≤ one per rule: bounded)."""
    fa = _run(star.file_analyses, run_id).where(F.col("status") == "success")
    fn = star.findings.select("file_analysis_id", F.struct("pattern_id", "category", "severity", "confidence").alias("f"))
    per = fn.groupBy("file_analysis_id").agg(F.collect_list("f").alias("findings"))
    repo = star.files.select("file_id", "repo_id").join(star.repos.select("repo_id", "domain", "paper_id"), "repo_id")
    return fa.join(per, "file_analysis_id", "left").join(repo, "file_id").select(
        "run_id", "file_analysis_id", "repo_id", "paper_id", "domain", "status",
        F.coalesce("findings", F.array().cast(per.schema["findings"].dataType)).alias("findings"))


def nested_results_by(results: DataFrame, *dims: str) -> DataFrame:
    """Explode findings of successful results; per rule, category or domain the findings, distinct files, repos
    and papers, and the share of all findings of the run."""
    ex = results.where(F.col("status") == "success").select(
        "run_id", "file_analysis_id", "repo_id", "paper_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.inline("findings"))
    # (run, dims, file) grain first: files = rows at that grain
    per = ex.groupBy("run_id", *dims, "file_analysis_id", "repo_id", "paper_id").agg(F.count(F.lit(1)).alias("n"))
    by_repo = per.groupBy("run_id", *dims, "repo_id", "paper_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))
    g = by_repo.groupBy("run_id", *dims).agg(F.sum("n").alias("findings"), F.sum("files").alias("files"), F.count(F.lit(1)).alias("repos"),
                                             F.count_distinct("paper_id").alias("papers"))
    share = F.lit(100.0) * F.col("findings") / F.sum("findings").over(Window.partitionBy("run_id"))  # over the grouped table
    return g.select("*", share.alias("pct"))


def freshness(entries: DataFrame, fetched_at: str, as_of, days: int = 7) -> DataFrame:
    """Whether an entry was fetched less than ``days`` before ``as_of``."""
    return entries.select("*", (F.col(fetched_at) > as_of - F.make_dt_interval(F.lit(days))).alias("fresh"))
