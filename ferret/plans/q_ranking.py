"""Registered window / ranking / sampling queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferret.functions.ordering import seeded_hash
from ferret.operators import ranking as W
from ferret.operators import report as R
from ferret.plans.catalog import register
from ferret.plans.star import Star
from ferret.sources.tables import Tables
from ferret.plans.star_sql import with_star

SEV_CASE = "CASE {c} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"


@register("latest_runs", "W1", with_star("""
SELECT * FROM analysis_runs ORDER BY started_at DESC, run_id DESC LIMIT 3"""))
def q_latest_runs(spark, d):
    return W.latest_runs(Star(spark, d), n=3)


@register("latest_incomplete_run", "W2", with_star("""
SELECT * FROM analysis_runs WHERE status = 'running' ORDER BY started_at DESC, run_id DESC LIMIT 1"""))
def q_latest_incomplete_run(spark, d):
    return W.latest_runs(Star(spark, d), n=1, status="running")


@register("latest_scan_per_repo", "W3", with_star("""
SELECT repo_id, run_no, scan_id, files_total, self_contained, fragments, uncertain, duration_seconds, status
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY run_no DESC) AS rn FROM repo_scans) s WHERE rn = 1"""))
def q_latest_scan_per_repo(spark, d):
    return W.latest_scan_per_repo(Star(spark, d))


@register("top_examples_per_category", "W4 J1 J3", with_star("""
SELECT t.run_id, t.category, t.rank, t.finding_id, t.pattern_id, t.severity, t.confidence, t.focus_line,
       f.file_path, r.repo_name, r.repo_url, r.domain, p.title AS paper_title
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY confidence DESC, finding_id) AS rank
      FROM findings) t
JOIN file_analyses fa ON fa.file_analysis_id = t.file_analysis_id JOIN files f ON f.file_id = fa.file_id
JOIN repos r ON r.repo_id = f.repo_id LEFT JOIN papers p ON p.paper_id = r.paper_id
WHERE t.rank <= 3"""))
def q_top_examples(spark, d):
    return W.top_examples_per_category(Star(spark, d), k=3)


@register("top_examples_verified", "W4 J4", with_star("""
SELECT t.run_id, t.category, t.rank, t.finding_id, t.pattern_id, t.severity, t.confidence, t.focus_line,
       f.file_path, r.repo_name, r.repo_url, r.domain, p.title AS paper_title
FROM (SELECT fn.*, row_number() OVER (PARTITION BY fn.run_id, fn.category ORDER BY fn.confidence DESC, fn.finding_id) AS rank
      FROM findings fn JOIN finding_verifications fv ON fv.finding_id = fn.finding_id AND fv.status <> 'error') t
JOIN file_analyses fa ON fa.file_analysis_id = t.file_analysis_id JOIN files f ON f.file_id = fa.file_id
JOIN repos r ON r.repo_id = f.repo_id LEFT JOIN papers p ON p.paper_id = r.paper_id
WHERE t.rank <= 3"""))
def q_top_examples_verified(spark, d):
    return W.top_examples_per_category(Star(spark, d), k=3, verified_only=True)


@register("diverse_selection", "W5 W6", with_star(f"""
WITH ef AS (
  SELECT fn.run_id, r.paper_id, fn.severity, fn.finding_id, fn.pattern_id, fn.confidence
  FROM findings fn JOIN file_analyses fa ON fa.file_analysis_id = fn.file_analysis_id
  JOIN files f ON f.file_id = fa.file_id JOIN repos r ON r.repo_id = f.repo_id
  WHERE r.paper_id IS NOT NULL AND fn.severity IN ('critical', 'high')
    AND EXISTS (SELECT 1 FROM finding_verifications v WHERE v.finding_id = fn.finding_id AND v.status = 'valid')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, paper_id, severity
                                                     ORDER BY confidence DESC, finding_id) AS rn FROM ef) b WHERE rn = 1),
ranked AS (SELECT *, {SEV_CASE.format(c='severity')} AS sev,
                  row_number() OVER (PARTITION BY run_id, pattern_id
                                     ORDER BY {SEV_CASE.format(c='severity')}, confidence DESC, finding_id) AS rr FROM best)
SELECT run_id, pick, finding_id, paper_id, severity, pattern_id, confidence, is_first FROM (
  SELECT *, rr = 1 AS is_first,
         row_number() OVER (PARTITION BY run_id ORDER BY (rr = 1) DESC, sev, confidence DESC, finding_id) AS pick
  FROM ranked) x WHERE pick <= 20"""))
def q_diverse_selection(spark, d):
    return W.diverse_selection(Star(spark, d), limit=20)


@register("verification_queue", "W6 J1", with_star(f"""
SELECT fn.run_id, fv.finding_id, fn.pattern_id, fn.severity, fv.status,
       CASE fv.status WHEN 'valid' THEN 1 WHEN 'invalid' THEN 2 WHEN 'uncertain' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS status_rank,
       {SEV_CASE.format(c="coalesce(fn.severity, 'low')")} AS severity_rank
FROM finding_verifications fv JOIN findings fn ON fn.finding_id = fv.finding_id
ORDER BY status_rank, pattern_id, finding_id"""))
def q_verification_queue(spark, d):
    return W.verification_queue(Star(spark, d))


@register("balanced_sample_docs", "W7 D9", """
WITH d AS (SELECT *, md5('42|' || CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE lang IS NOT NULL),
doms AS (SELECT lang, row_number() OVER (ORDER BY md5('42|' || lang)) AS drank, count(*) OVER () AS k
         FROM (SELECT DISTINCT lang FROM d) x),
q AS (SELECT lang, CAST(101 // k AS BIGINT) + CASE WHEN drank <= 101 % k THEN 1 ELSE 0 END AS quota FROM doms),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h) AS sample_rank FROM d)
SELECT r.doc_id, r.lang, r.sample_rank, q.quota FROM r JOIN q ON q.lang = r.lang WHERE sample_rank <= quota""")
def q_balanced_sample_docs(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "lang")
    return W.balanced_sample(docs, "doc_id", "lang", 101).select("doc_id", "lang", "sample_rank", "quota")


@register("confidence_quota_sample", "W8 D9", with_star("""
WITH d AS (SELECT fn.finding_id, r.domain, fn.confidence, md5('42|' || CAST(fn.finding_id AS VARCHAR)) AS h
           FROM findings fn JOIN file_analyses fa ON fa.file_analysis_id = fn.file_analysis_id
           JOIN files f ON f.file_id = fa.file_id JOIN repos r ON r.repo_id = f.repo_id
           WHERE fn.confidence >= 0.7 AND r.domain IS NOT NULL),
doms AS (SELECT domain, row_number() OVER (ORDER BY md5('42|' || domain)) AS drank, count(*) OVER () AS k
         FROM (SELECT DISTINCT domain FROM d) x),
q AS (SELECT domain, CAST(50 // k AS BIGINT) + CASE WHEN drank <= 50 % k THEN 1 ELSE 0 END AS quota FROM doms),
r AS (SELECT finding_id, domain, confidence,
             row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, h) AS sample_rank FROM d)
SELECT r.finding_id, r.domain, r.confidence, r.sample_rank, q.quota FROM r JOIN q ON q.domain = r.domain
WHERE sample_rank <= quota"""))
def q_confidence_quota_sample(spark, d):
    ef = R.enriched_findings(Star(spark, d)).where(F.col("confidence") >= 0.7).select("finding_id", "domain", "confidence")
    h = seeded_hash(42, "finding_id")
    out = W.balanced_sample(ef, "finding_id", "domain", 50, order=[F.col("confidence").desc(), h])
    return out.select("finding_id", "domain", "confidence", "sample_rank", "quota")


@register("group_sample", "W9 J6", with_star("""
WITH f AS (SELECT f.file_id, f.repo_id, r.paper_id, f.file_path FROM files f JOIN repos r ON r.repo_id = f.repo_id),
p AS (SELECT DISTINCT paper_id FROM f WHERE paper_id IS NOT NULL),
pk AS (SELECT paper_id FROM p ORDER BY md5('42|' || CAST(paper_id AS VARCHAR)) LIMIT 20)
SELECT file_id, repo_id, paper_id, file_path FROM f
WHERE paper_id IS NULL OR paper_id IN (SELECT paper_id FROM pk)"""))
def q_group_sample(spark, d):
    return W.group_sample(Star(spark, d), 20, include_orphans=True)


@register("dedup_pages_first", "W11", """
SELECT dedup_key, page_id, url FROM (
  SELECT regexp_replace(url, '[?#].*$', '') AS dedup_key, page_id, url,
         row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS rn FROM pages) x
WHERE rn = 1""")
def q_dedup_pages_first(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    return W.dedup_ordered(p, F.regexp_replace("url", "[?#].*$", ""), "page_id", "first")


@register("dedup_pages_last", "W11", """
SELECT dedup_key, page_id, url FROM (
  SELECT regexp_replace(url, '[?#].*$', '') AS dedup_key, page_id, url,
         row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id DESC) AS rn FROM pages) x
WHERE rn = 1""")
def q_dedup_pages_last(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    return W.dedup_ordered(p, F.regexp_replace("url", "[?#].*$", ""), "page_id", "last")


_W = "PARTITION BY user_id ORDER BY ts, event_id"


@register("metric_samples", "W15 A36", f"""
SELECT user_id, ts, event_id, row_number() OVER ({_W}) AS counter,
       sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS hits,
       sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS queries
FROM events""")
def q_metric_samples(spark, d):
    return W.metric_samples(Tables(spark, d).events).select("user_id", "ts", "event_id", "counter", "hits", "queries")


@register("counter_rates", "W14", f"""
SELECT user_id, ts, event_id, counter, CASE WHEN prev IS NULL THEN 0 ELSE counter - prev END AS delta,
       coalesce(el, 0.0) AS elapsed_s,
       CASE WHEN prev IS NULL OR el <= 0 THEN 0.0 ELSE (counter - prev) / el END AS rate
FROM (SELECT user_id, ts, event_id, counter, lag(counter) OVER ({_W}) AS prev,
             (epoch_us(ts) - epoch_us(lag(ts) OVER ({_W}))) / 1e6 AS el
      FROM (SELECT user_id, ts, event_id, row_number() OVER ({_W}) AS counter FROM events) a) b""")
def q_counter_rates(spark, d):
    return W.counter_rates(Tables(spark, d).events)


@register("trailing_metrics", "W12 W13", f"""
SELECT user_id, ts, event_id, row_number() OVER ({_W}) AS rn,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w5 AS DOUBLE) / count(*) OVER w5 / 100.0 AS moving_avg,
       CASE WHEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w5 > 0
            THEN CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w5 AS DOUBLE)
                 / sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w5 ELSE 0.0 END AS hit_ratio
FROM events WINDOW w5 AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q_trailing_metrics(spark, d):
    return W.trailing_metrics(Tables(spark, d).events, w=5)


@register("running_peaks", "W15", f"""
SELECT user_id, ts, event_id, value, max(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS peak_value FROM events""")
def q_running_peaks(spark, d):
    return W.running_peaks(Tables(spark, d).events)


def _chunk_sql(size, step):
    return f"""
SELECT doc_id, start0 // {step} AS chunk_no, start0 + 1 AS start_line, least(start0 + {size}, n_lines) AS end_line,
       array_to_string(lines[start0 + 1:start0 + {size}], chr(10)) AS chunk
FROM (SELECT doc_id, lines, n_lines, unnest(range(0, n_lines, {step})) AS start0
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents) a) b"""


@register("line_chunks", "W16", _chunk_sql(500, 400))
def q_line_chunks(spark, d):
    return W.line_chunks(Tables(spark, d).documents)


@register("line_chunks_overlapping", "W16", _chunk_sql(6, 4))
def q_line_chunks_overlapping(spark, d):
    return W.line_chunks(Tables(spark, d).documents, size=6, step=4)


@register("event_window_counts", "M1", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS events,
       count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM events GROUP BY 1, 2""")
def q_event_window_counts(spark, d):
    from ferret.streaming.metrics import window_counts
    return window_counts(Tables(spark, d).events)
