"""Evaluation operators.

Every metric is an aggregate over outcome rows; the per-rule / per-run /
per-label tables are small, and micro averages are one extra grouping level
(rollup) instead of a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_div(n, d) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def prf(tp, fp, fn) -> tuple[Column, Column, Column]:
    """Precision, recall, F1 with 0 on empty denominators."""
    p = safe_div(tp, tp + fp)
    r = safe_div(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- P27/29 ----

def direct_outcome(tests: DataFrame, min_confidence: float = 0.80) -> DataFrame:
    """Positive needs detected ≠ no and confidence ≥ 0.80; negative needs no; context-dependent passes."""
    t, det, conf = F.col("test_type"), F.col("detected"), F.col("confidence")
    passed = (F.when(t == "positive", (det != "no") & (conf >= min_confidence))
              .when(t == "negative", det == "no").otherwise(F.lit(True)))
    reason = (F.when(t == "context_dependent", "context_dependent")
              .when((t == "positive") & (det == "no"), "not_detected")
              .when((t == "positive") & (conf < min_confidence), "low_confidence")
              .when(t == "positive", "detected")
              .when(det == "no", "correctly_clean").otherwise("false_positive"))
    return tests.select("*", passed.alias("passed"), reason.alias("reason"))


def alignment(outcomes: DataFrame) -> DataFrame:
    """Direct vs judge; judge 'partial' counts as a pass."""
    judge = F.col("judge_verdict").isin("yes", "partial")
    d = F.col("passed")
    cls = (F.when(d & judge, "both_pass").when(~d & ~judge, "both_fail")
           .when(d & ~judge, "quality_issue").otherwise("overly_strict"))
    return outcomes.select("*", cls.alias("alignment"))


# ------------------------------------------------------------------ A26 ----

def rule_evaluation(outcomes: DataFrame) -> DataFrame:
    """Per (run, rule): share of tests of each type that the judge accepts (yes; for context tests partial too; 1.0
    without context tests),
    overall = (yes + 0.5·partial)/n, focus-line accuracy over detected positive tests."""
    t, jv = F.col("test_type"), F.col("judge_verdict")
    g = outcomes.groupBy("run_id", "pattern_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t == "positive").alias("n_pos"), F.count_if((t == "positive") & (jv == "yes")).alias("pos_ok"),
        F.count_if(t == "negative").alias("n_neg"), F.count_if((t == "negative") & (jv == "yes")).alias("neg_ok"),
        F.count_if(t == "context_dependent").alias("n_ctx"),
        F.count_if((t == "context_dependent") & jv.isin("yes", "partial")).alias("ctx_ok"),
        F.count_if(jv == "yes").alias("yes"), F.count_if(jv == "partial").alias("partial"),
        F.count_if((t == "positive") & (F.col("detected") != "no")).alias("focus_eligible"),
        F.count_if((t == "positive") & (F.col("detected") != "no") & (F.col("focus_line") == F.col("expected_line"))).alias("focus_ok"))
    return g.select(
        "run_id", "pattern_id", "n",
        safe_div(F.col("pos_ok"), F.col("n_pos")).alias("positive_accuracy"),
        safe_div(F.col("neg_ok"), F.col("n_neg")).alias("negative_accuracy"),
        F.when(F.col("n_ctx") > 0, F.col("ctx_ok") / F.col("n_ctx")).otherwise(F.lit(1.0)).alias("context_accuracy"),
        ((F.col("yes") + F.col("partial") * 0.5) / F.col("n")).alias("overall_accuracy"),
        "focus_eligible", "focus_ok",
        safe_div(F.col("focus_ok"), F.col("focus_eligible")).alias("focus_accuracy"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """Alignment class counts and rates per run."""
    classes = ["both_pass", "both_fail", "quality_issue", "overly_strict"]
    g = aligned.groupBy("run_id").pivot("alignment", classes).count().fillna(0, classes)
    tot = sum((F.col(c) for c in classes), F.lit(0))
    return g.select("run_id", *classes, tot.alias("total"),
                    *[safe_div(F.col(c), tot).alias(f"{c}_rate") for c in classes])


def overall_metrics(outcomes: DataFrame, per_rule: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Micro-averaged accuracy, mean confidence, rules with overall accuracy ≥ threshold."""
    jv = F.col("judge_verdict")
    g = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(F.col("passed")).alias("direct_passed"),
        ((F.count_if(jv == "yes") + F.count_if(jv == "partial") * 0.5) / F.count(F.lit(1))).alias("overall_accuracy"),
        (F.sum(F.round(F.col("confidence") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100.0).alias("mean_confidence"))
    r = per_rule.groupBy("run_id").agg(F.count(F.lit(1)).alias("rules"),
                                       F.count_if(F.col("overall_accuracy") >= threshold).alias("rules_above_threshold"))
    return g.join(r, "run_id").select("*", (F.col("direct_passed") / F.col("tests")).alias("direct_accuracy"))


def cross_run_variance(per_rule: DataFrame, range_limit: float = 0.10, stdev_limit: float = 0.05) -> DataFrame:
    """Per rule over its runs (≥ 2): mean, sample stdev, min, max and range of A26's overall accuracy (half credit
    for partial); unstable when range > 0.10 or stdev > 0.05. ``per_rule``: run_id, pattern_id, overall_accuracy."""
    acc = F.col("overall_accuracy")
    g = per_rule.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("runs"), F.avg(acc).alias("mean"),
                                           F.stddev_samp(acc).alias("stdev"), F.min(acc).alias("min"), F.max(acc).alias("max"))
    g = g.where(F.col("runs") >= 2).withColumn("range", F.col("max") - F.col("min"))
    return g.select("*", ((F.col("range") > range_limit) | (F.col("stdev") > stdev_limit)).alias("unstable"))


def overall_variance(outcomes: DataFrame) -> DataFrame:
    """A29 overall: mean and sample stdev over runs of yes verdicts / tests (no half credit); stdev 0 for one run."""
    per = outcomes.groupBy("run_id").agg((F.count_if(F.col("judge_verdict") == "yes") / F.count(F.lit(1))).alias("acc"))
    return per.agg(F.count(F.lit(1)).alias("num_runs"), F.coalesce(F.avg("acc"), F.lit(0.0)).alias("overall_mean_accuracy"),
                   F.coalesce(F.stddev_samp("acc"), F.lit(0.0)).alias("overall_stdev"))


# ---------------------------------------------------------------- A24/25 ----

def confusion_by_label(rule_runs: DataFrame, labels: DataFrame, label_rules: dict[str, list[str]],
                       id_col: str = "doc_id", min_confidence: float = 0.7, model_label: str | None = None) -> DataFrame:
    """Per label: detected = any mapped rule fired. Rows without a model (``model_label`` not 1) are skipped; rows
    in which a mapped rule timed out are counted as ``excluded``; a labelled row that was not scanned is visible as
    ``unscanned`` and takes no part in the matrix. Other failures count as not detected."""
    spark = rule_runs.sparkSession
    m = spark.createDataFrame([(lab, pid) for lab, pids in label_rules.items() for pid in pids], "label string, pattern_id string")
    fired = (F.col("status") == "success") & F.col("detected").isin("yes", "context-dependent") & (F.col("confidence") >= min_confidence)
    per = (rule_runs.join(F.broadcast(m), "pattern_id")  # the label→rule map is a bounded literal
           .groupBy(id_col, "label").agg(F.max(F.coalesce(fired, F.lit(False))).alias("detected"), F.max(F.col("status") == "timeout").alias("timed_out")))
    rows = labels if model_label is None else labels.where(F.col(model_label) == 1)
    truth = rows.select(id_col, F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), (F.col(lab) == 1).alias("truth")) for lab in label_rules])).alias("t")).select(id_col, "t.*")
    j = truth.join(per, [id_col, "label"], "left")
    d, y = F.col("detected"), F.col("truth")
    known = F.col("timed_out") == False  # noqa: E712  null for unscanned rows
    return j.groupBy("label").agg(
        F.count_if(known).alias("n"), F.count_if(known & d & y).alias("tp"), F.count_if(known & d & ~y).alias("fp"),
        F.count_if(known & ~d & y).alias("fn"), F.count_if(known & ~d & ~y).alias("tn"),
        F.count_if("timed_out").alias("excluded"), F.count_if(F.col("timed_out").isNull()).alias("unscanned"))


def label_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy per label plus a micro-averaged 'ALL' row (rollup)."""
    g = conf.rollup("label").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn")])
    g = g.select(F.coalesce("label", F.lit("ALL")).alias("label"), *[F.col(c).cast("long").alias(c) for c in ("n", "tp", "fp", "fn", "tn")])
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                    safe_div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"))


# ------------------------------------------------------------------ A30 ----

def scenario_scoring(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A30 per run: TP = found ∩ expected (findings), bonus = found∖expected judged valid (``found.valid``), FP = the rest
    of found∖expected, FN = expected∖found (manifest entries); recall = TP/intended,
    precision = (TP+bonus)/(TP+bonus+FP). Set algebra as one full outer join on the key."""
    e = expected.select("run_id", key).withColumn("_e", F.lit(1))
    f = found.select("run_id", key, F.lit(1).alias("_f"), F.when(F.col("valid"), 1).alias("_v"))
    j = f.join(e, ["run_id", key], "full")
    ex, fd, ok = F.col("_e").isNotNull(), F.col("_f").isNotNull(), F.col("_v").isNotNull()
    g = j.groupBy("run_id").agg(F.count_if(ex).alias("intended"), F.count_if(ex & fd).alias("tp"),
                                F.count_if(fd & ~ex & ok).alias("bonus"), F.count_if(fd & ~ex & ~ok).alias("fp"),
                                F.count_if(ex & ~fd).alias("fn"))
    prec = safe_div(F.col("tp") + F.col("bonus"), F.col("tp") + F.col("bonus") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("intended"))
    return g.select("*", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"))


# ------------------------------------------------------------------ A31 ----

def precision_progression(per_run: DataFrame) -> DataFrame:
    """Precision per run in order with the change from the previous run (window over ≤ runs rows)."""
    w = Window.orderBy("run_id")
    return per_run.select("run_id", "precision", (F.col("precision") - F.lag("precision").over(w)).alias("change"))


def generalisation_gap(verified: DataFrame, holdout: Column) -> DataFrame:
    """Precision of the feedback set, of the holdout set, and their difference in points. ``verified``: one row
    per verified finding with its status; ``holdout`` says to which set it belongs."""
    st = F.col("status")
    counts = verified.where(st.isin("valid", "invalid", "uncertain")).agg(*[
        F.count_if((h if c == "holdout" else ~h) & (st == "valid") if v else (h if c == "holdout" else ~h)).alias(f"{c}_{'valid' if v else 'total'}")
        for h in [F.coalesce(holdout, F.lit(False))] for c in ("feedback", "holdout") for v in (True, False)])
    f, h = (safe_div(100.0 * F.col(f"{c}_valid"), F.col(f"{c}_total")) for c in ("feedback", "holdout"))
    return counts.select("*", f.alias("feedback_precision"), h.alias("holdout_precision"), (f - h).alias("gap"))


# ------------------------------------------------------------------ A32 ----

def counts_cube(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, by b, by both and the grand total in one pass (cube + grouping_id)."""
    # pre-aggregate to the (a, b) grain so the cube's Expand only multiplies the small table
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells.cube(a, b).agg(F.sum("n").alias("count"), F.grouping_id().cast("long").alias("grouping_id"))


# ------------------------------------------------------------------ A35 ----

def histogram_percentile(buckets: DataFrame, group: list[str], p: float) -> DataFrame:
    """Cumulative buckets (le, count) → first finite le with count ≥ total·p/100, total = count of the
    last finite bucket; +Inf ignored; total 0 → null."""
    return histogram_percentiles(buckets, group, [p])


def histogram_percentiles(buckets: DataFrame, group: list[str], ps: list[float]) -> DataFrame:
    """A35 for several percentiles at once, one exchange. A histogram's buckets are a fixed handful, kept as a sorted list of (le, count)."""
    fin = F.col("le") != F.lit(float("inf"))
    g = buckets.groupBy(*group).agg(F.sort_array(F.collect_list(F.when(fin, F.struct("le", "count")))).alias("b"))
    total = F.element_at("b", -1)["count"]
    reach = lambda p: F.try_element_at(F.filter("b", lambda x: x["count"] >= total * p / 100.0), F.lit(1))["le"]
    return g.where(F.size("b") > 0).select(*group, *[F.when(total > 0, reach(p)).alias(f"p{int(p)}") for p in ps])


# ------------------------------------------------------------------ A36 ----

def _deltas(g: DataFrame, key: str, elapsed: Column, requests: Column, hits: Column, queries: Column) -> DataFrame:
    return g.select(key, requests.alias("requests"), elapsed.alias("elapsed_s"),
                    safe_div(requests, elapsed).alias("throughput"), safe_div(elapsed, requests).alias("latency_s"), safe_div(hits, queries).alias("hit_rate"),
                    safe_div(hits, requests).alias("hits_per_request"), safe_div(queries, requests).alias("queries_per_request"))


def _seconds(a: str, b: str) -> Column:
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6


def snapshot_deltas(samples: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """first→last snapshot per source: requests, elapsed, throughput, mean latency (elapsed per request), hit
    rate, and hits and queries per request (zero-guarded). Ties of time are ordered by the rest of ``order``. ``samples`` hold the counters."""
    snap = F.struct(*order, "counter", "hits", "queries")
    g = samples.groupBy(key).agg(F.min(snap).alias("a"), F.max(snap).alias("b"))
    diff = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    return _deltas(g, key, _seconds(f"a.{order[0]}", f"b.{order[0]}"), diff("counter"), diff("hits"), diff("queries"))


def request_deltas(requests: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """A36 from the requests themselves (key, order, hit and query: 0 or 1): a counter at the last snapshot less the counter
    at the first is what came after the first request, so one aggregation of sums, of the first request and of the last
    time does, without running sums."""
    first = F.min(F.struct(*order, "hit", "query"))
    g = requests.groupBy(key).agg(first.alias("a"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"), F.sum("query").alias("q"))
    return _deltas(g, key, _seconds(f"a.{order[0]}", "end"), F.col("n") - 1, F.col("h") - F.col("a.hit"), F.col("q") - F.col("a.query"))


# ------------------------------------------------------------------ A33 ----

def audit_totals(issues: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Totals of an audit: per (level, check) the issues and the distinct items they hit, and a row
    ('all', 'all') with the checked items, those without an error (valid) and those with one (invalid).
    ``issues``: key, level, check_name."""
    cells = issues.groupBy("level", "check_name", key).agg(F.count(F.lit(1)).alias("n"))
    by = cells.groupBy("level", "check_name").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("items"))
    bad = issues.where(F.col("level") == "error").select(key).distinct().withColumn("_bad", F.lit(True))
    whole = items.select(key).distinct().join(bad, key, "left").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("_bad").alias("invalid"))
    none = F.lit(None).cast("long")
    return by.select("level", "check_name", "issues", "items", none.alias("valid"), none.alias("invalid")).unionByName(
        whole.select(F.lit("all").alias("level"), F.lit("all").alias("check_name"), none.alias("issues"), "items",
                     (F.col("items") - F.col("invalid")).alias("valid"), "invalid"))


# ------------------------------------------------------------------ A34 ----

def timing_summary(timings: DataFrame, key: str, size: str, seconds: str) -> DataFrame:
    """Per item mean, min, max and spread (null for one run) of its timings, rounded to hundredths."""
    g = timings.groupBy(key, size).agg(F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("m"), F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))
    r = lambda c: F.round(F.round(c, 9), 2)  # noqa: E731  the first rounding takes away what binary fractions leave
    return g.select(key, size, "runs", r(F.col("m")).alias("mean_seconds"), r(F.col("lo")).alias("min_seconds"), r(F.col("hi")).alias("max_seconds"),
                    F.when(F.col("runs") > 1, r(F.col("hi") - F.col("lo"))).alias("spread_seconds"))


def scaling_verdict(summary: DataFrame, key: str, size: str) -> DataFrame:
    """Time ratio of the largest to the smallest item against their size ratio: Sub-linear below 0.8 of it,
    Roughly linear below 1.2, else Super-linear (0 for a zero denominator). No row for fewer than two items."""
    item = F.struct(F.col(size).alias("size"), F.col(key).alias("key"), F.col("mean_seconds").alias("mean"))
    g = summary.agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("a"), F.max(item).alias("b")).where("n >= 2")
    ratio, sizes = safe_div(F.col("b.mean"), F.col("a.mean")), safe_div(F.col("b.size"), F.col("a.size"))
    verdict = F.when(ratio < sizes * 0.8, "Sub-linear").when(ratio < sizes * 1.2, "Roughly linear").otherwise("Super-linear")
    return g.select(F.col("a.size").alias("smallest"), F.col("b.size").alias("largest"), ratio.alias("time_ratio"), sizes.alias("size_ratio"), verdict.alias("scaling"))


# ------------------------------------------------------------------ A39 ----

def gauge_band(share: Column, middle: float = 0.6, high: float = 0.85) -> Column:
    """Band of a utilisation: green below 0.6, yellow below 0.85, else red."""
    return F.when(share < middle, "green").when(share < high, "yellow").when(share.isNotNull(), "red")


def per_cent(part: Column, whole: Column) -> Column:
    """``part / whole`` in per cent with one decimal, ties to the even digit, of the exact ratio of two integers (a double
    of it may lie on either side of a tie)."""
    rest = (part * 1000) % whole
    low = ((part * 1000 - rest) / whole).cast("long")
    tenths = low + ((rest * 2 > whole) | ((rest * 2 == whole) & (low % 2 == 1))).cast("long")
    return F.concat(F.lpad(((tenths - tenths % 10) / 10).cast("long").cast("string"), 3, " "), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def gauge_bar(part: Column, whole: Column, width: int = 30) -> Column:
    """The gauge as text: ``width`` places, filled by the whole part of share · width, then the per cent."""
    filled = F.least(F.lit(width), F.greatest(F.lit(0), F.floor(part * width / whole).cast("int")))
    return F.when(whole > 0, F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit("] "), per_cent(part, whole)))


# outcome columns and their names in the history (fixed values); the first one is always shown
OUTCOMES = (("ok", "ok"), ("truncated", "truncated"), ("aborted", "aborted"), ("errors", "errors"))


def outcome_history(outcomes: tuple[tuple[str, str], ...] = OUTCOMES) -> Column:
    """How requests ended: ``3 ok  1 errors  (4 total)``; but for the first, outcomes that did not occur are left out; null without any."""
    total = sum((F.col(c) for c, _ in outcomes[1:]), F.col(outcomes[0][0]))
    shown = [F.when((F.col(c) > 0) | F.lit(i == 0), F.concat(F.col(c).cast("string"), F.lit(f" {name}"))) for i, (c, name) in enumerate(outcomes)]
    return F.when(total > 0, F.concat_ws("  ", *shown, F.concat(F.lit("("), total.cast("string"), F.lit(" total)"))))


def monitor_gauges(totals: DataFrame, key: str) -> DataFrame:
    """Per source the error share of its requests with its bar and band, and the hit-rate band (green above
    0.3, yellow above 0.1, else dim; null without queries). ``totals``: key, requests, errors, hits, queries; where they also
    hold the other outcomes (ok, truncated, aborted) the history is added, where they hold latency_cents the mean latency."""
    err = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests"))
    hit = F.when(F.col("queries") > 0, F.col("hits") / F.col("queries"))
    out = [key, "requests", err.alias("error_share"), gauge_bar(F.col("errors"), F.col("requests")).alias("error_bar"), gauge_band(err).alias("error_band"),
           hit.alias("hit_rate"), F.when(hit > 0.3, "green").when(hit > 0.1, "yellow").when(hit.isNotNull(), "dim").alias("hit_band")]
    if all(c in totals.columns for c, _ in OUTCOMES):
        out.append(outcome_history().alias("history"))
    if "latency_cents" in totals.columns:
        out.append(F.when(F.col("requests") > 0, F.col("latency_cents") / 100.0 / F.col("requests")).alias("mean_latency"))
    return totals.select(*out)
