"""Registered run-report queries (all runs at once) with their DuckDB oracles.

An oracle states an operator's definition over the star in its own terms: facts per file or per repository first
(does it have a finding? how many?), then sums of those.
"""

from __future__ import annotations

from ferret.operators import report as R
from ferret.plans.catalog import register
from ferret.plans.star import Star
from ferret.plans.star_sql import with_star

# one row per analysed file: its run, repository, success and number of findings
_PER_FILE = """
hits AS (SELECT file_analysis_id, count(*) AS k FROM findings GROUP BY file_analysis_id),
scanned AS (SELECT a.run_id, a.status = 'success' AS fine, f.repo_id, r.domain, r.paper_id, coalesce(h.k, 0) AS k
            FROM file_analyses a JOIN files f USING (file_id) JOIN repos r USING (repo_id) LEFT JOIN hits h USING (file_analysis_id))"""
_PCT = "CASE WHEN {d} = 0 THEN 0.0 ELSE 100.0 * {n}::DOUBLE / {d} END"


@register("findings_by_domain", "A5 J1 J2 P24", with_star(f"""
WITH {_PER_FILE},
d AS (SELECT run_id, coalesce(domain, 'unknown') AS domain, count(*) AS total_files, sum(fine::INT)::BIGINT AS analyzed_files,
             sum((k > 0)::INT)::BIGINT AS files_with_findings, sum(k)::BIGINT AS total_findings FROM scanned GROUP BY ALL)
SELECT *, {_PCT.format(n='files_with_findings', d='analyzed_files')} AS finding_rate FROM d"""))
def q_findings_by_domain(spark, d):
    return R.findings_by_domain(Star(spark, d))


@register("run_totals", "A1 A4 J2", with_star(f"""
WITH {_PER_FILE},
t AS (SELECT run_id, count(*) AS analyzed_files, sum((k > 0)::INT)::BIGINT AS files_with_findings, sum(k)::BIGINT AS total_findings FROM scanned GROUP BY run_id)
SELECT run_id, total_files, analyzed_files, files_with_findings, total_findings,
       {_PCT.format(n='analyzed_files', d='total_files')} AS analysis_success_rate,
       {_PCT.format(n='files_with_findings', d='analyzed_files')} AS finding_rate
FROM t NATURAL JOIN (SELECT run_id, total_files FROM analysis_runs) n"""))
def q_run_totals(spark, d):
    return R.run_totals(Star(spark, d))


@register("repo_coverage", "A2 J2", with_star(f"""
WITH {_PER_FILE},
per_repo AS (SELECT run_id, repo_id, max(k) AS most FROM scanned GROUP BY run_id, repo_id)
SELECT run_id, count(*) AS total_repos, sum((most > 0)::INT)::BIGINT AS repos_with_findings FROM per_repo GROUP BY run_id"""))
def q_repo_coverage(spark, d):
    return R.repo_coverage(Star(spark, d))


@register("paper_coverage", "A3 J2", with_star(f"""
WITH {_PER_FILE},
per_paper AS (SELECT run_id, paper_id, max(k) AS most FROM scanned GROUP BY run_id, paper_id HAVING paper_id IS NOT NULL)
SELECT run_id, count(*) AS total_papers, sum((most > 0)::INT)::BIGINT AS papers_with_findings FROM per_paper GROUP BY run_id"""))
def q_paper_coverage(spark, d):
    return R.paper_coverage(Star(spark, d))


@register("findings_by_category", "A6 J1", with_star("""
WITH per_repo AS (SELECT x.run_id, x.category, f.repo_id, sum(x.k) AS k, count(*) AS files
                  FROM (SELECT run_id, category, file_analysis_id AS file_id, count(*) AS k FROM findings GROUP BY ALL) x JOIN files f USING (file_id) GROUP BY ALL)
SELECT run_id, category, sum(k)::BIGINT AS count, sum(files)::BIGINT AS unique_files, count(*) AS unique_repos FROM per_repo GROUP BY run_id, category"""))
def q_findings_by_category(spark, d):
    return R.findings_by_category(Star(spark, d))


# a rule's findings are one per file, so files are rows; confidence is summed in cents
_RULE_TABLE = """
chosen AS (SELECT run_id, pattern_id, category, file_analysis_id AS file_id, round(confidence * 100)::BIGINT AS cents FROM findings fn WHERE {only}),
per_repo AS (SELECT run_id, pattern_id, repo_id, min(category) AS category, count(*) AS n, count(DISTINCT file_id) AS files, sum(cents) AS cents
             FROM chosen JOIN files USING (file_id) GROUP BY run_id, pattern_id, repo_id),
per_rule AS (SELECT run_id, pattern_id, min(category) AS category, sum(n)::BIGINT AS count, sum(files)::BIGINT AS unique_files, count(*) AS unique_repos,
                    sum(cents)::DOUBLE / sum(n) / 100.0 AS avg_confidence FROM per_repo GROUP BY run_id, pattern_id),
placed AS (SELECT t.*, 1 + (SELECT count(*) FROM per_rule o WHERE o.run_id = t.run_id AND (o.count > t.count OR o.count = t.count AND o.pattern_id < t.pattern_id)) AS rank FROM per_rule t)"""


@register("findings_by_rule_top15", "A7 W1", with_star(f"""
WITH {_RULE_TABLE.format(only='true')}
SELECT run_id, pattern_id, category, count, unique_files, avg_confidence, rank FROM placed WHERE rank <= 15"""))
def q_findings_by_rule(spark, d):
    return R.findings_by_rule(Star(spark, d), k=15)


@register("findings_by_severity", "A8", with_star("""
WITH cells AS (SELECT file_analysis_id, run_id, severity, count(*) AS k FROM findings GROUP BY ALL)
SELECT run_id, severity, sum(k)::BIGINT AS count FROM cells GROUP BY run_id, severity"""))
def q_findings_by_severity(spark, d):
    return R.findings_by_severity(Star(spark, d))


@register("top_rules", "A9 J1", with_star(f"WITH {_RULE_TABLE.format(only='true')} SELECT * FROM placed WHERE rank <= 10"))
def q_top_rules(spark, d):
    return R.top_rules(Star(spark, d), k=10)


@register("top_rules_verified", "A9 J4", with_star("WITH " + _RULE_TABLE.format(
    only="EXISTS (SELECT 1 FROM finding_verifications v WHERE v.finding_id = fn.finding_id AND v.status IN ('valid', 'invalid', 'uncertain'))") + " SELECT * FROM placed WHERE rank <= 10"))
def q_top_rules_verified(spark, d):
    return R.top_rules(Star(spark, d), k=10, verified_only=True)


@register("papers_by_severity", "A10 J1 P24", with_star("""
SELECT fr.run_id, fr.severity, coalesce(g.paper_count, 0) AS paper_count
FROM (SELECT ar.run_id, s.severity FROM analysis_runs ar,
        (SELECT unnest(['critical','high','medium','low']) AS severity) s) fr
LEFT JOIN (
  SELECT fa.run_id, coalesce(fn.severity, 'low') AS severity, count(DISTINCT r.paper_id) AS paper_count
  FROM findings fn JOIN file_analyses fa ON fa.file_analysis_id = fn.file_analysis_id
  JOIN files f ON f.file_id = fa.file_id JOIN repos r ON r.repo_id = f.repo_id
  WHERE r.paper_id IS NOT NULL GROUP BY 1, 2) g
ON g.run_id = fr.run_id AND g.severity = fr.severity"""))
def q_papers_by_severity(spark, d):
    return R.papers_by_severity(Star(spark, d))


@register("findings_distribution", "A11 J1", with_star("""
WITH per AS (
  SELECT fa.run_id, r.paper_id, fn.severity, count(*) AS n
  FROM findings fn JOIN file_analyses fa ON fa.file_analysis_id = fn.file_analysis_id
  JOIN files f ON f.file_id = fa.file_id JOIN repos r ON r.repo_id = f.repo_id
  WHERE r.paper_id IS NOT NULL GROUP BY 1, 2, 3),
cells AS (
  SELECT run_id, 'all' AS scope, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY run_id, paper_id
  UNION ALL
  SELECT run_id, severity AS scope, n FROM per WHERE severity IN ('critical','high','medium','low')),
st AS (
  SELECT run_id, scope, count(*) AS papers, min(n) AS mn, max(n) AS mx, avg(n) AS mean,
         round(coalesce(stddev_samp(n), 0.0), 6) AS stdev, median(n) AS median
  FROM cells GROUP BY 1, 2)
SELECT fr.run_id, fr.scope, coalesce(st.papers, 0) AS papers, coalesce(st.mn, 0) AS min, coalesce(st.mx, 0) AS max,
       coalesce(st.mean, 0.0) AS mean, coalesce(st.stdev, 0.0) AS stdev, coalesce(st.median, 0.0) AS median
FROM (SELECT ar.run_id, s.scope FROM analysis_runs ar,
        (SELECT unnest(['all','critical','high','medium','low']) AS scope) s) fr
LEFT JOIN st ON st.run_id = fr.run_id AND st.scope = fr.scope"""))
def q_findings_distribution(spark, d):
    return R.findings_distribution(Star(spark, d))


@register("verification_by_severity", "A12 J5", with_star("""
SELECT fr.run_id, fr.severity, coalesce(valid, 0) AS valid, coalesce(invalid, 0) AS invalid,
       coalesce(uncertain, 0) AS uncertain, coalesce(pending, 0) AS pending, coalesce(total, 0) AS total
FROM (SELECT ar.run_id, s.severity FROM analysis_runs ar,
        (SELECT unnest(['critical','high','medium','low']) AS severity) s) fr
LEFT JOIN (
  SELECT fn.run_id, coalesce(fn.severity, 'low') AS severity,
         count(*) FILTER (WHERE fv.status = 'valid') AS valid,
         count(*) FILTER (WHERE fv.status = 'invalid') AS invalid,
         count(*) FILTER (WHERE fv.status = 'uncertain') AS uncertain,
         count(*) FILTER (WHERE fv.status IS NULL) AS pending,
         count(*) AS total
  FROM findings fn LEFT JOIN finding_verifications fv ON fv.finding_id = fn.finding_id
  GROUP BY 1, 2) g ON g.run_id = fr.run_id AND g.severity = fr.severity"""))
def q_verification_by_severity(spark, d):
    return R.verification_by_severity(Star(spark, d))


@register("verification_summary", "A13", with_star("""
SELECT run_id, valid, invalid, uncertain, error, valid + invalid + uncertain AS total_verified,
       CASE WHEN valid + invalid + uncertain > 0
            THEN 100.0 * CAST(valid AS DOUBLE) / (valid + invalid + uncertain) ELSE 0.0 END AS precision,
       verified_at, model
FROM (SELECT fn.run_id,
             count(*) FILTER (WHERE fv.status = 'valid') AS valid,
             count(*) FILTER (WHERE fv.status = 'invalid') AS invalid,
             count(*) FILTER (WHERE fv.status = 'uncertain') AS uncertain,
             count(*) FILTER (WHERE fv.status = 'error') AS error,
             max(fv.verified_at) AS verified_at,
             arg_max(fv.model, fv.verified_at::VARCHAR || fv.model) AS model
      FROM finding_verifications fv JOIN findings fn ON fn.finding_id = fv.finding_id
      GROUP BY fn.run_id) g"""))
def q_verification_summary(spark, d):
    return R.verification_summary(Star(spark, d))


_PREC = """
SELECT run_id, {dim}, valid, invalid, uncertain, valid + invalid + uncertain AS total,
       CAST(CASE WHEN valid + invalid + uncertain > 0
                 THEN round_even(CAST(valid AS DOUBLE) / (valid + invalid + uncertain) * 100.0, 0) ELSE 0 END AS BIGINT) AS precision
FROM (SELECT fn.run_id, {key} AS {dim},
             count(*) FILTER (WHERE fv.status = 'valid') AS valid,
             count(*) FILTER (WHERE fv.status = 'invalid') AS invalid,
             count(*) FILTER (WHERE fv.status = 'uncertain') AS uncertain
      FROM findings fn JOIN finding_verifications fv ON fv.finding_id = fn.finding_id
      GROUP BY 1, 2) g"""


@register("precision_by_category", "A14", with_star(_PREC.format(dim="category", key="fn.category")))
def q_precision_by_category(spark, d):
    return R.precision_by(Star(spark, d), "category")


@register("precision_by_severity", "A14 P24", with_star(_PREC.format(dim="severity", key="coalesce(fn.severity, 'low')")))
def q_precision_by_severity(spark, d):
    return R.precision_by(Star(spark, d), "severity")


@register("rule_error_profile", "A15", with_star("""
WITH tally AS (SELECT f.run_id, f.pattern_id, f.category, histogram(v.status) AS h, count(*) AS total FROM findings f NATURAL JOIN (SELECT finding_id, status FROM finding_verifications) v GROUP BY ALL),
t AS (SELECT run_id, pattern_id, category, coalesce(h['valid'], 0)::BIGINT AS valid, coalesce(h['invalid'], 0)::BIGINT AS invalid,
             coalesce(h['uncertain'], 0)::BIGINT AS uncertain, total FROM tally)
SELECT *, CASE WHEN valid = 0 THEN 0.0 ELSE 100.0 * valid::DOUBLE / (valid + invalid) END AS precision FROM t WHERE invalid > 2"""))
def q_rule_error_profile(spark, d):
    return R.rule_error_profile(Star(spark, d), min_invalid=3)


@register("rule_error_reasonings", "A15", with_star("""
SELECT fn.run_id, fn.finding_id, fn.pattern_id, fv.status, fv.reasoning
FROM findings fn JOIN finding_verifications fv ON fv.finding_id = fn.finding_id
WHERE fv.status IN ('valid', 'invalid') AND fv.reasoning <> ''
  AND (fn.run_id, fn.pattern_id) IN (
    SELECT (fn2.run_id, fn2.pattern_id) FROM findings fn2 JOIN finding_verifications fv2 ON fv2.finding_id = fn2.finding_id
    GROUP BY fn2.run_id, fn2.pattern_id HAVING count(*) FILTER (WHERE fv2.status = 'invalid') >= 3)"""))
def q_rule_error_reasonings(spark, d):
    return R.rule_error_reasonings(Star(spark, d), min_invalid=3).select("run_id", "finding_id", "pattern_id", "status", "reasoning")


@register("scan_statistics", "A16", with_star("""
WITH per_repo AS (SELECT repo_id, count(*) AS scans, sum(files_total) AS f, sum(self_contained) AS s, sum(fragments) AS g, sum(uncertain) AS u, sum(duration_seconds) AS secs
                  FROM repo_scans WHERE status <> 'running' GROUP BY repo_id),
t AS (SELECT sum(scans)::BIGINT AS total_scans, count(*) AS total_repos, sum(f)::BIGINT AS total_files, sum(s)::BIGINT AS total_self_contained,
             sum(g)::BIGINT AS total_fragments, sum(u)::BIGINT AS total_uncertain, sum(secs) AS secs FROM per_repo)
SELECT * EXCLUDE (secs), secs / total_scans AS avg_duration,
       CASE WHEN total_repos = 0 THEN 0 ELSE total_self_contained::DOUBLE / total_repos END AS avg_self_contained_per_repo FROM t"""))
def q_scan_statistics(spark, d):
    return R.scan_statistics(Star(spark, d))


@register("prefilter_funnel", "A17 J7", with_star("""
WITH shelf AS (SELECT prefilter_run_id, repo_id, any_value(paper_id) AS paper_id, histogram(classification) AS h, count(*) AS n
               FROM prefilter_file_results JOIN repos USING (repo_id) GROUP BY prefilter_run_id, repo_id),
flat AS (SELECT prefilter_run_id, paper_id, n, coalesce(h['self_contained'], 0) AS s, coalesce(h['fragment'], 0) AS f, coalesce(h['uncertain'], 0) AS u, coalesce(h['error'], 0) AS e FROM shelf),
book AS (SELECT prefilter_run_id, paper_id, max(s) AS s FROM flat WHERE paper_id IS NOT NULL GROUP BY prefilter_run_id, paper_id),
books AS (SELECT prefilter_run_id, count(*) AS original_papers, sum((s > 0)::INT)::BIGINT AS filtered_papers FROM book GROUP BY prefilter_run_id),
sums AS (SELECT prefilter_run_id, sum(n)::BIGINT AS total_files, sum(s)::BIGINT AS self_contained, sum(f)::BIGINT AS fragments, sum(u)::BIGINT AS uncertain, sum(e)::BIGINT AS errors,
                count(*) AS original_repos, sum((s > 0)::INT)::BIGINT AS filtered_repos, sum((s = 0)::INT)::BIGINT AS dropped_repos FROM flat GROUP BY prefilter_run_id)
SELECT sums.*, coalesce(original_papers, 0) AS original_papers, coalesce(filtered_papers, 0) AS filtered_papers FROM sums LEFT JOIN books USING (prefilter_run_id)"""))
def q_prefilter_funnel(spark, d):
    return R.prefilter_funnel(Star(spark, d)).select(
        "prefilter_run_id", "total_files", "self_contained", "fragments", "uncertain", "errors",
        "original_repos", "filtered_repos", "dropped_repos", "original_papers", "filtered_papers")


@register("dropped_repos", "A17 J7", with_star("""
SELECT s.prefilter_run_id, s.repo_id, r.repo_name
FROM (SELECT DISTINCT prefilter_run_id, repo_id FROM prefilter_file_results) s
JOIN repos r ON r.repo_id = s.repo_id
WHERE NOT EXISTS (SELECT 1 FROM prefilter_file_results k
                  WHERE k.prefilter_run_id = s.prefilter_run_id AND k.repo_id = s.repo_id
                    AND k.classification = 'self_contained')"""))
def q_dropped_repos(spark, d):
    return R.dropped_repos(Star(spark, d)).select("prefilter_run_id", "repo_id", "repo_name")


@register("success_files_with_findings", "A37", with_star(f"""
WITH {_PER_FILE}
SELECT run_id, count(*) AS files_analyzed, count(nullif(k, 0)) AS files_with_findings FROM scanned WHERE fine GROUP BY run_id"""))
def q_success_files_with_findings(spark, d):
    return R.success_files_with_findings(Star(spark, d))


def _nested_sql(dim, expr):
    return with_star(f"""
WITH x AS (SELECT fn.run_id, {expr} AS {dim}, fn.file_analysis_id, f.repo_id, r.paper_id
           FROM findings fn JOIN files f ON f.file_id = fn.file_analysis_id JOIN repos r USING (repo_id)),
g AS (SELECT run_id, {dim}, count(*) AS findings, count(DISTINCT file_analysis_id) AS files, count(DISTINCT repo_id) AS repos, count(DISTINCT paper_id) AS papers FROM x GROUP BY ALL)
SELECT g.*, 100.0 * findings::DOUBLE / (SELECT sum(o.findings) FROM g o WHERE o.run_id = g.run_id) AS pct FROM g""")


@register("nested_results_by_rule", "A20", _nested_sql("pattern_id", "fn.pattern_id"))
def q_nested_results_by_rule(spark, d):
    return R.nested_results_by(R.nested_results(Star(spark, d)), "pattern_id")


@register("nested_results_by_category", "A20", _nested_sql("category", "fn.category"))
def q_nested_results_by_category(spark, d):
    return R.nested_results_by(R.nested_results(Star(spark, d)), "category")


@register("nested_results_by_domain", "A20", _nested_sql("domain", "coalesce(r.domain, 'unknown')"))
def q_nested_results_by_domain(spark, d):
    return R.nested_results_by(R.nested_results(Star(spark, d)), "domain")


# maps as JSON-like text, keys in order
@register("per_file_summary", "A38", with_star("""
WITH s AS (SELECT run_id, file_analysis_id, coalesce(severity, 'low') AS k, count(*) AS n FROM findings GROUP BY ALL),
c AS (SELECT run_id, file_analysis_id, category AS k, count(*) AS n FROM findings GROUP BY ALL)
SELECT a.*, b.by_category FROM
  (SELECT run_id, file_analysis_id, sum(n)::BIGINT AS n_findings, string_agg(k || '=' || n, ',' ORDER BY k) AS by_severity FROM s GROUP BY run_id, file_analysis_id) a
  JOIN (SELECT file_analysis_id, string_agg(k || '=' || n, ',' ORDER BY k) AS by_category FROM c GROUP BY file_analysis_id) b USING (file_analysis_id)"""))
def q_per_file_summary(spark, d):
    from pyspark.sql import functions as F
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return R.per_file_summary(Star(spark, d)).select("run_id", "file_analysis_id", "n_findings", text("by_severity"), text("by_category"))


# a user's last event is when it was last fetched; fresh within seven days of the newest event
@register("freshness", "T10", """
WITH last AS (SELECT user_id, max(ts) AS fetched_at FROM events GROUP BY user_id)
SELECT user_id, fetched_at, fetched_at > max(fetched_at) OVER () - INTERVAL 7 DAY AS fresh FROM last""")
def q_freshness(spark, d):
    from pyspark.sql import functions as F
    from ferret.sources.tables import Tables
    events = Tables(spark, d).events
    return R.freshness(events.groupBy("user_id").agg(F.max("ts").alias("fetched_at")), "fetched_at", events.select(F.max("ts")).scalar())
