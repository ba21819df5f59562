"""Registered evaluation queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferret.operators import evaluation as E
from ferret.operators import ranking as W
from ferret.operators import report as R
from ferret.plans.catalog import register
from ferret.operators import scan as S
from ferret.plans.q_corpus import _SCAN_RUNS
from ferret.plans.star import Star
from ferret.plans.star_sql import with_star
from ferret.sources.tables import Tables

_OUT = """
o AS (SELECT *, CASE WHEN test_type = 'positive' THEN detected <> 'no' AND confidence >= 0.80
                     WHEN test_type = 'negative' THEN detected = 'no' ELSE true END AS passed
      FROM test_results),
a AS (SELECT *, CASE WHEN passed AND judge_verdict IN ('yes','partial') THEN 'both_pass'
                     WHEN NOT passed AND judge_verdict NOT IN ('yes','partial') THEN 'both_fail'
                     WHEN passed THEN 'quality_issue' ELSE 'overly_strict' END AS alignment FROM o)"""


def _outcomes(spark, d):
    return E.alignment(E.direct_outcome(Star(spark, d).test_results))


@register("direct_outcomes", "P27 P29", with_star(f"""
WITH {_OUT}
SELECT test_id, run_id, pattern_id, test_type, passed,
       CASE WHEN test_type = 'context_dependent' THEN 'context_dependent'
            WHEN test_type = 'positive' AND detected = 'no' THEN 'not_detected'
            WHEN test_type = 'positive' AND confidence < 0.80 THEN 'low_confidence'
            WHEN test_type = 'positive' THEN 'detected'
            WHEN detected = 'no' THEN 'correctly_clean' ELSE 'false_positive' END AS reason, alignment
FROM a"""))
def q_direct_outcomes(spark, d):
    return _outcomes(spark, d).select("test_id", "run_id", "pattern_id", "test_type", "passed", "reason", "alignment")


_G = """
g AS (SELECT run_id, pattern_id, count(*) AS n,
             count(*) FILTER (WHERE test_type = 'positive') AS n_pos,
             count(*) FILTER (WHERE test_type = 'positive' AND judge_verdict = 'yes') AS pos_ok,
             count(*) FILTER (WHERE test_type = 'negative') AS n_neg,
             count(*) FILTER (WHERE test_type = 'negative' AND judge_verdict = 'yes') AS neg_ok,
             count(*) FILTER (WHERE test_type = 'context_dependent') AS n_ctx,
             count(*) FILTER (WHERE test_type = 'context_dependent' AND judge_verdict IN ('yes','partial')) AS ctx_ok,
             count(*) FILTER (WHERE judge_verdict = 'yes') AS yes, count(*) FILTER (WHERE judge_verdict = 'partial') AS partial,
             count(*) FILTER (WHERE test_type = 'positive' AND detected <> 'no') AS focus_eligible,
             count(*) FILTER (WHERE test_type = 'positive' AND detected <> 'no' AND focus_line = expected_line) AS focus_ok
      FROM a GROUP BY 1, 2)"""
_RULE_EVAL = f"""
WITH {_OUT},{_G}
SELECT run_id, pattern_id, n,
       CASE WHEN n_pos > 0 THEN CAST(pos_ok AS DOUBLE) / n_pos ELSE 0.0 END AS positive_accuracy,
       CASE WHEN n_neg > 0 THEN CAST(neg_ok AS DOUBLE) / n_neg ELSE 0.0 END AS negative_accuracy,
       CASE WHEN n_ctx > 0 THEN CAST(ctx_ok AS DOUBLE) / n_ctx ELSE 1.0 END AS context_accuracy,
       (yes + partial * 0.5) / n AS overall_accuracy, focus_eligible, focus_ok,
       CASE WHEN focus_eligible > 0 THEN CAST(focus_ok AS DOUBLE) / focus_eligible ELSE 0.0 END AS focus_accuracy
FROM g"""


@register("rule_evaluation", "A26 P27", with_star(_RULE_EVAL))
def q_rule_evaluation(spark, d):
    return E.rule_evaluation(_outcomes(spark, d))


@register("alignment_summary", "A27 P29", with_star(f"""
WITH {_OUT},
g AS (SELECT run_id, count(*) FILTER (WHERE alignment = 'both_pass') AS both_pass,
             count(*) FILTER (WHERE alignment = 'both_fail') AS both_fail,
             count(*) FILTER (WHERE alignment = 'quality_issue') AS quality_issue,
             count(*) FILTER (WHERE alignment = 'overly_strict') AS overly_strict FROM a GROUP BY 1)
SELECT run_id, both_pass, both_fail, quality_issue, overly_strict,
       both_pass + both_fail + quality_issue + overly_strict AS total,
       CAST(both_pass AS DOUBLE) / (both_pass + both_fail + quality_issue + overly_strict) AS both_pass_rate,
       CAST(both_fail AS DOUBLE) / (both_pass + both_fail + quality_issue + overly_strict) AS both_fail_rate,
       CAST(quality_issue AS DOUBLE) / (both_pass + both_fail + quality_issue + overly_strict) AS quality_issue_rate,
       CAST(overly_strict AS DOUBLE) / (both_pass + both_fail + quality_issue + overly_strict) AS overly_strict_rate
FROM g"""))
def q_alignment_summary(spark, d):
    return E.alignment_summary(_outcomes(spark, d))


@register("overall_metrics", "A28", with_star(f"""
WITH {_OUT},{_G},
re AS (SELECT run_id, pattern_id, (yes + partial * 0.5) / n AS overall_accuracy FROM g),
m AS (SELECT run_id, count(*) AS tests, count(*) FILTER (WHERE passed) AS direct_passed,
             (count(*) FILTER (WHERE judge_verdict = 'yes') + count(*) FILTER (WHERE judge_verdict = 'partial') * 0.5) / count(*) AS overall_accuracy,
             CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS mean_confidence
      FROM a GROUP BY 1),
r AS (SELECT run_id, count(*) AS rules, count(*) FILTER (WHERE overall_accuracy >= 0.85) AS rules_above_threshold FROM re GROUP BY 1)
SELECT m.*, r.rules, r.rules_above_threshold, CAST(direct_passed AS DOUBLE) / tests AS direct_accuracy
FROM m JOIN r ON r.run_id = m.run_id"""))
def q_overall_metrics(spark, d):
    o = _outcomes(spark, d)
    return E.overall_metrics(o, E.rule_evaluation(o))


@register("cross_run_variance", "A29", with_star("""
WITH per AS (SELECT pattern_id, run_id, avg(CASE judge_verdict WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) AS acc
             FROM test_results GROUP BY pattern_id, run_id),
g AS (SELECT pattern_id, count(*) AS runs, avg(acc) AS mean, stddev_samp(acc) AS stdev, min(acc) AS min, max(acc) AS max
      FROM per GROUP BY 1 HAVING count(*) >= 2)
SELECT pattern_id, runs, round(mean, 9) AS mean, round(stdev, 9) AS stdev, round(min, 9) AS min, round(max, 9) AS max, round(max - min, 9) AS range,
       round(max - min, 9) > 0.10 OR round(stdev, 9) > 0.05 AS unstable FROM g"""))
def q_cross_run_variance(spark, d):
    v = E.cross_run_variance(E.rule_evaluation(_outcomes(spark, d)))
    r = lambda c: F.round(c, 9).alias(c)
    return v.select("pattern_id", "runs", r("mean"), r("stdev"), r("min"), r("max"), r("range"), "unstable")


@register("overall_variance", "A29", with_star("""
WITH per AS (SELECT run_id, avg(CASE WHEN judge_verdict = 'yes' THEN 1.0 ELSE 0.0 END) AS acc FROM test_results GROUP BY run_id)
SELECT count(*) AS num_runs, round(avg(acc), 9) AS overall_mean_accuracy, round(coalesce(stddev_samp(acc), 0), 9) AS overall_stdev FROM per"""))
def q_overall_variance(spark, d):
    v = E.overall_variance(Star(spark, d).test_results)
    return v.select("num_runs", F.round("overall_mean_accuracy", 9).alias("overall_mean_accuracy"), F.round("overall_stdev", 9).alias("overall_stdev"))


LABEL_RULES = {"quality": ["r00", "r01", "r02"], "toxic": ["r03", "r04", "r05"]}

_CONF = f"""
rr AS (SELECT doc_id, pattern_id, detected, confidence, status FROM ({_SCAN_RUNS}) s),
m AS (SELECT * FROM (VALUES ('quality','r00'), ('quality','r01'), ('quality','r02'),
                            ('toxic','r03'), ('toxic','r04'), ('toxic','r05')) t(label, pattern_id)),
hit AS (SELECT DISTINCT rr.doc_id, m.label FROM rr, m WHERE m.pattern_id = rr.pattern_id
          AND rr.status = 'success' AND rr.detected IN ('yes','context-dependent') AND rr.confidence >= 0.7),
lost AS (SELECT DISTINCT rr.doc_id, m.label FROM rr, m WHERE m.pattern_id = rr.pattern_id AND rr.status = 'timeout'),
truth AS (SELECT l.doc_id, x.label, CASE x.label WHEN 'quality' THEN quality ELSE toxic END = 1 AS truth
          FROM labels l, (SELECT DISTINCT label FROM m) x),
state AS (SELECT t.label, t.truth, EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = t.doc_id AND h.label = t.label) AS detected,
                 CASE WHEN t.doc_id NOT IN (SELECT doc_id FROM rr) THEN 'unscanned'
                      WHEN EXISTS (SELECT 1 FROM lost o WHERE o.doc_id = t.doc_id AND o.label = t.label) THEN 'excluded' ELSE 'known' END AS kind
          FROM truth t),
c AS (SELECT label, count(*) FILTER (kind = 'known') AS n, count(*) FILTER (kind = 'known' AND detected AND truth) AS tp,
             count(*) FILTER (kind = 'known' AND detected AND NOT truth) AS fp, count(*) FILTER (kind = 'known' AND NOT detected AND truth) AS fn,
             count(*) FILTER (kind = 'known' AND NOT detected AND NOT truth) AS tn,
             count(*) FILTER (kind = 'excluded') AS excluded, count(*) FILTER (kind = 'unscanned') AS unscanned
      FROM state GROUP BY label)"""


def _confusion(spark, d):
    t, mapped = Tables(spark, d), sorted({r for v in LABEL_RULES.values() for r in v})
    # only the mapped rules, on labelled documents: both filters stand below the scan
    docs = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    rules = S.select_rules(S.rule_catalog(Star(spark, d)), ids=mapped)
    return E.confusion_by_label(S.rule_scan(docs, rules), t.labels, LABEL_RULES)


@register("label_confusion", "A24 T16", with_star("WITH " + _CONF.strip() + "\nSELECT label, n, tp, fp, fn, tn, excluded, unscanned FROM c"))
def q_label_confusion(spark, d):
    return _confusion(spark, d)


@register("label_metrics", "A25", with_star("WITH " + _CONF.strip() + """,
u AS (SELECT label, n, tp, fp, fn, tn FROM c
      UNION ALL SELECT 'ALL', sum(n), sum(tp), sum(fp), sum(fn), sum(tn) FROM c),
v AS (SELECT label, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
             CAST(tn AS BIGINT) AS tn,
             CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM u)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CASE WHEN n > 0 THEN CAST(tp + tn AS DOUBLE) / n ELSE 0.0 END AS accuracy FROM v"""))
def q_label_metrics(spark, d):
    return E.label_metrics(_confusion(spark, d))


@register("scenario_scoring", "A30 U2", with_star("""
WITH e AS (SELECT run_id, test_id AS k FROM test_results WHERE test_type = 'positive'),
f AS (SELECT run_id, finding_id AS k FROM findings),
v AS (SELECT finding_id AS k FROM finding_verifications WHERE status = 'valid'),
j AS (SELECT coalesce(f.run_id, e.run_id) AS run_id, coalesce(f.k, e.k) AS k, e.k IS NOT NULL AS ex, f.k IS NOT NULL AS fd
      FROM f FULL JOIN e ON e.run_id = f.run_id AND e.k = f.k),
g AS (SELECT j.run_id, count(*) FILTER (WHERE ex) AS intended, count(*) FILTER (WHERE ex AND fd) AS tp,
             count(*) FILTER (WHERE fd AND NOT ex AND v.k IS NOT NULL) AS bonus,
             count(*) FILTER (WHERE fd AND NOT ex AND v.k IS NULL) AS fp, count(*) FILTER (WHERE ex AND NOT fd) AS fn
      FROM j LEFT JOIN v ON v.k = j.k GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + bonus + fp > 0 THEN CAST(tp + bonus AS DOUBLE) / (tp + bonus + fp) ELSE 0.0 END AS precision,
             CASE WHEN intended > 0 THEN CAST(tp AS DOUBLE) / intended ELSE 0.0 END AS recall FROM g)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m"""))
def q_scenario_scoring(spark, d):
    s = Star(spark, d)
    expected = s.test_results.where(F.col("test_type") == "positive").select("run_id", F.col("test_id").alias("k"))
    found = s.judged_findings.select("run_id", F.col("finding_id").alias("k"), (F.col("v_status") == "valid").alias("valid"))
    return E.scenario_scoring(expected, found, "k")


@register("precision_progression", "A31 A13", with_star("""
WITH p AS (SELECT fn.run_id,
                  CASE WHEN count(*) FILTER (WHERE fv.status IN ('valid','invalid','uncertain')) > 0
                       THEN 100.0 * CAST(count(*) FILTER (WHERE fv.status = 'valid') AS DOUBLE)
                            / count(*) FILTER (WHERE fv.status IN ('valid','invalid','uncertain')) ELSE 0.0 END AS precision
           FROM finding_verifications fv JOIN findings fn ON fn.finding_id = fv.finding_id GROUP BY 1)
SELECT run_id, precision, precision - lag(precision) OVER (ORDER BY run_id) AS change FROM p"""))
def q_precision_progression(spark, d):
    return E.precision_progression(R.verification_summary(Star(spark, d)))


@register("counts_cube", "A32", with_star("""
SELECT category, severity, count(*) AS count, CAST(grouping(category, severity) AS BIGINT) AS grouping_id
FROM findings GROUP BY CUBE (category, severity)"""))
def q_counts_cube(spark, d):
    return E.counts_cube(Star(spark, d).findings, "category", "severity")


_LES = [10.0, 50.0, 100.0, 200.0, 500.0]


def _bucket_sql():
    arms = " ".join(f"WHEN value <= {le} THEN {le}" for le in _LES)
    return f"CASE {arms} ELSE CAST('inf' AS DOUBLE) END"


@register("histogram_percentiles", "A35 S9", f"""
WITH b AS (SELECT event_type, {_bucket_sql()} AS le, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT event_type, le, sum(n) OVER (PARTITION BY event_type ORDER BY le ROWS UNBOUNDED PRECEDING) AS count FROM b),
fin AS (SELECT * FROM c WHERE le <> CAST('inf' AS DOUBLE)),
t AS (SELECT event_type, arg_max(count, le) AS total FROM fin GROUP BY 1)
SELECT fin.event_type,
       CASE WHEN max(t.total) > 0 THEN min(CASE WHEN fin.count >= t.total * 50 / 100.0 THEN fin.le END) END AS p50,
       CASE WHEN max(t.total) > 0 THEN min(CASE WHEN fin.count >= t.total * 90 / 100.0 THEN fin.le END) END AS p90
FROM fin JOIN t ON t.event_type = fin.event_type GROUP BY fin.event_type""")
def q_histogram_percentiles(spark, d):
    e = Tables(spark, d).events
    le = F.lit(float("inf"))
    for v in reversed(_LES):
        le = F.when(F.col("value") <= v, F.lit(v)).otherwise(le)
    b = e.groupBy("event_type", le.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    # cumulative counts over the (type × bucket) table: a handful of rows per type
    c = b.select("event_type", "le", F.sum("n").over(Window.partitionBy("event_type").orderBy("le")
                                                      .rowsBetween(Window.unboundedPreceding, 0)).alias("count"))
    return E.histogram_percentiles(c, ["event_type"], [50, 90])


@register("snapshot_deltas", "A36 W14", """
WITH m AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter,
                  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hits,
                  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS queries
           FROM events),
g AS (SELECT user_id, arg_min(counter, ts) AS c0, arg_max(counter, ts) AS c1, arg_min(hits, ts) AS h0, arg_max(hits, ts) AS h1,
             arg_min(queries, ts) AS q0, arg_max(queries, ts) AS q1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS el
      FROM m GROUP BY 1)
SELECT user_id, c1 - c0 AS requests, el AS elapsed_s, CASE WHEN el > 0 THEN (c1 - c0) / el ELSE 0.0 END AS throughput,
       CASE WHEN c1 - c0 > 0 THEN el / (c1 - c0) ELSE 0.0 END AS latency_s,
       CASE WHEN q1 - q0 > 0 THEN CAST(h1 - h0 AS DOUBLE) / (q1 - q0) ELSE 0.0 END AS hit_rate,
       CASE WHEN c1 - c0 > 0 THEN CAST(h1 - h0 AS DOUBLE) / (c1 - c0) ELSE 0.0 END AS hits_per_request,
       CASE WHEN c1 - c0 > 0 THEN CAST(q1 - q0 AS DOUBLE) / (c1 - c0) ELSE 0.0 END AS queries_per_request FROM g""")
def q_snapshot_deltas(spark, d):
    t = F.col("event_type")
    return E.request_deltas(Tables(spark, d).events.select("user_id", "ts", "event_id", (t == "purchase").cast("long").alias("hit"), (t == "click").cast("long").alias("query")))


@register("generalisation_gap", "A31", with_star("""
WITH v AS (SELECT fv.status, fn.run_id >= 6 AS held FROM finding_verifications fv, findings fn
           WHERE fn.finding_id = fv.finding_id AND fv.status <> 'error'),
c AS (SELECT sum(CASE WHEN status = 'valid' AND NOT held THEN 1 ELSE 0 END)::BIGINT AS feedback_valid, sum(CASE WHEN held THEN 0 ELSE 1 END)::BIGINT AS feedback_total,
             sum(CASE WHEN status = 'valid' AND held THEN 1 ELSE 0 END)::BIGINT AS holdout_valid, sum(CASE WHEN held THEN 1 ELSE 0 END)::BIGINT AS holdout_total FROM v),
p AS (SELECT *, CASE WHEN feedback_total > 0 THEN 100.0 * feedback_valid::DOUBLE / feedback_total ELSE 0 END AS feedback_precision,
             CASE WHEN holdout_total > 0 THEN 100.0 * holdout_valid::DOUBLE / holdout_total ELSE 0 END AS holdout_precision FROM c)
SELECT *, feedback_precision - holdout_precision AS gap FROM p"""))
def q_generalisation_gap(spark, d):
    v = Star(spark, d).judged_findings.select("run_id", F.col("v_status").alias("status"))
    return E.generalisation_gap(v, F.col("run_id") >= 6)


@register("timing_summary", "A34", with_star("""
WITH t AS (SELECT f.is_notebook, fa.run_id AS size, fa.duration_seconds::DECIMAL(18, 3) AS s FROM file_analyses fa JOIN files f USING (file_id))
SELECT is_notebook, size, count(*) AS runs, round(avg(s)::DECIMAL(18, 9), 2)::DOUBLE AS mean_seconds, round(min(s), 2)::DOUBLE AS min_seconds,
       round(max(s), 2)::DOUBLE AS max_seconds, CASE WHEN count(*) > 1 THEN round(max(s) - min(s), 2)::DOUBLE END AS spread_seconds
FROM t GROUP BY is_notebook, size"""))
def q_timing_summary(spark, d):
    s = Star(spark, d)
    t = s.file_analyses.join(s.files.select("file_id", "is_notebook"), "file_id").withColumnRenamed("run_id", "size")
    return E.timing_summary(t, "is_notebook", "size", "duration_seconds")


@register("scaling_verdict", "A34", with_star("""
WITH band AS (SELECT f.line_count // 100 AS k, (f.line_count // 100) * 100 + 50 AS lines, fa.duration_seconds AS s FROM file_analyses fa JOIN files f USING (file_id)),
t AS (SELECT k, lines, round(avg(s), 2) AS m FROM band GROUP BY k, lines),
e AS (SELECT (SELECT m FROM t ORDER BY lines LIMIT 1) AS m0, (SELECT m FROM t ORDER BY lines DESC LIMIT 1) AS m1, min(lines) AS l0, max(lines) AS l1 FROM t HAVING count(*) >= 2),
r AS (SELECT l0 AS smallest, l1 AS largest, CASE WHEN m0 > 0 THEN m1 / m0 ELSE 0 END AS time_ratio, l1::DOUBLE / l0 AS size_ratio FROM e)
SELECT *, CASE WHEN time_ratio < size_ratio * 0.8 THEN 'Sub-linear' WHEN time_ratio < size_ratio * 1.2 THEN 'Roughly linear' ELSE 'Super-linear' END AS scaling FROM r"""))
def q_scaling_verdict(spark, d):
    s = Star(spark, d)
    band = F.floor(F.col("line_count") / 100)
    t = s.file_analyses.join(s.files.select("file_id", band.alias("k"), (band * 100 + 50).alias("lines")), "file_id")
    return E.scaling_verdict(E.timing_summary(t, "k", "lines", "duration_seconds"), "k", "lines")


# requests end ok (view), truncated (click), aborted (purchase) or in an error; their value is the latency
@register("monitor_gauges", "A39", """
WITH t AS (SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'view') AS ok, count(*) FILTER (event_type = 'click') AS truncated,
                  count(*) FILTER (event_type = 'purchase') AS aborted, count(*) FILTER (event_type = 'error') AS errors,
                  count(*) FILTER (event_type = 'purchase' AND event_id % 4 = 0) AS hits, count(*) FILTER (event_type = 'purchase') AS queries,
                  sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents
           FROM events GROUP BY user_id),
s AS (SELECT *, errors::DOUBLE / requests AS e, CASE WHEN queries > 0 THEN hits::DOUBLE / queries END AS h,
             (errors * 1000) // requests AS low, (errors * 1000) % requests AS rest, ok + truncated + aborted + errors AS total FROM t),
u AS (SELECT *, low + CASE WHEN 2 * rest > requests OR (2 * rest = requests AND low % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM s)
SELECT user_id, requests,
       CASE WHEN total > 0 THEN ok || ' ok' || CASE WHEN truncated > 0 THEN '  ' || truncated || ' truncated' ELSE '' END || CASE WHEN aborted > 0 THEN '  ' || aborted || ' aborted' ELSE '' END
         || CASE WHEN errors > 0 THEN '  ' || errors || ' errors' ELSE '' END || '  (' || total || ' total)' END AS history,
       e AS error_share,
       '[' || repeat('█', CAST((errors * 30) // requests AS INTEGER)) || repeat('░', 30 - CAST((errors * 30) // requests AS INTEGER)) || '] ' || lpad(CAST(tenths // 10 AS VARCHAR), 3, ' ') || '.' || (tenths % 10) || '%' AS error_bar,
       CASE WHEN e < 0.6 THEN 'green' WHEN e < 0.85 THEN 'yellow' ELSE 'red' END AS error_band, h AS hit_rate,
       CASE WHEN h > 0.3 THEN 'green' WHEN h > 0.1 THEN 'yellow' WHEN h IS NOT NULL THEN 'dim' END AS hit_band, cents / 100.0 / requests AS mean_latency
FROM u""")
def q_monitor_gauges(spark, d):
    t = F.col("event_type")
    g = Tables(spark, d).events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(t == "view").alias("ok"), F.count_if(t == "click").alias("truncated"), F.count_if(t == "purchase").alias("aborted"),
        F.count_if(t == "error").alias("errors"), F.count_if((t == "purchase") & (F.col("event_id") % 4 == 0)).alias("hits"), F.count_if(t == "purchase").alias("queries"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("latency_cents"))
    return E.monitor_gauges(g, "user_id")

