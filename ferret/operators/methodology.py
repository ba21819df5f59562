"""Data-methodology operators (D1–D16): the rules re-aimed at the data itself.

Fits and statistics are aggregates; they reach the rows either through a
scalar subquery (one struct, evaluated once, reused) or through a join with a
per-group statistics table that AQE broadcasts only after measuring it.
Splits and samples are keyed by ``md5(seed ‖ key)`` so they do not depend on
partitioning or task order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions.ordering import (
    DEFAULT_SEED,
    chunked_row_number,
    hash_bucket,
    hash_chunks,
    join_null_safe,
    seeded_hash,
    split_of,
)
from ferret.functions.prefix_scan import prefix_scan

HEX = "0123456789abcdef"


def hex_digit(h: Column, pos: int = 1) -> Column:
    """Value 0..15 of one hex digit of a hash (portable, no base conversion)."""
    return (F.position(F.substring(h, pos, 1), F.lit(HEX)) - 1).cast("long")


def normalized_text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


# ------------------------------------------------------------------ D1 ----

def split_overlap(docs: DataFrame, bench: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Normalised-content hashes present in more than one split (train/validation/test/benchmark)."""
    d = docs.select(F.md5(normalized_text("text")).alias("content_hash"),
                    split_of(seeded_hash(seed, "doc_id")).alias("split"))
    b = bench.select(F.md5(normalized_text("text")).alias("content_hash"), F.lit("benchmark").alias("split"))
    u = d.unionByName(b)
    # partial aggregation per (hash, split) first: a hot duplicate collapses map-side
    per = u.groupBy("content_hash", "split").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_splits"), F.sum("n").alias("n_rows"),
                                        F.array_join(F.sort_array(F.collect_list("split")), ",").alias("splits"))
    return g.where(F.col("n_splits") > 1)


# ------------------------------------------------------------------ D2 ----

def train_only_scaling(df: DataFrame, value: str, group_key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Fit mean/std/min/max on the train split only (split by group key), apply to every row."""
    d = df.withColumn("split", split_of(seeded_hash(seed, group_key)))
    fit = d.where(F.col("split") == "train").select(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                 F.min(value).alias("mn"), F.max(value).alias("mx")))
    s = fit.scalar()  # one scalar subquery; Spark reuses it for every reference
    z = F.when(s.getField("std") > 1e-12, (F.col(value) - s.getField("mean")) / s.getField("std")).otherwise(F.lit(0.0))
    rng = s.getField("mx") - s.getField("mn")
    mm = F.when(rng > 0, (F.col(value) - s.getField("mn")) / rng).otherwise(F.lit(0.0))
    return d.select("*", z.alias("z"), mm.alias("minmax"))


def scaler_leakage_report(df: DataFrame, value: str, group_key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """D2 audit: full-data fit minus train-only fit (what fitting on everything leaks)."""
    d = df.withColumn("is_train", split_of(seeded_hash(seed, group_key)) == "train")
    t = F.col("is_train")
    return d.agg(
        F.avg(F.when(t, F.col(value))).alias("train_mean"), F.avg(value).alias("full_mean"),
        F.stddev_samp(F.when(t, F.col(value))).alias("train_std"), F.stddev_samp(value).alias("full_std"),
        F.min(F.when(t, F.col(value))).alias("train_min"), F.min(value).alias("full_min"),
        F.max(F.when(t, F.col(value))).alias("train_max"), F.max(value).alias("full_max"),
    ).select("*", (F.col("full_mean") - F.col("train_mean")).alias("mean_shift"),
             (F.col("full_std") - F.col("train_std")).alias("std_shift"))


# ------------------------------------------------------------------ D3 ----

def oof_target_encoding(df: DataFrame, id_col: str, category: str, target: Column, k: int = 5,
                        seed: int = DEFAULT_SEED) -> DataFrame:
    """D3: out-of-fold mean target per category (total − own fold), global out-of-fold mean fallback;
    ``full_encoding`` (uses the row's own target) and ``leak_gap`` are the audit."""
    d = df.select(id_col, category, target.cast("long").alias("y"),
                  (hex_digit(seeded_hash(seed, id_col)) % k).alias("fold"))
    cf = d.groupBy(category, "fold").agg(F.sum("y").alias("s_cf"), F.count(F.lit(1)).alias("n_cf"))
    c = cf.groupBy(category).agg(F.sum("s_cf").alias("s_c"), F.sum("n_cf").alias("n_c"))
    f = cf.groupBy("fold").agg(F.sum("s_cf").alias("s_f"), F.sum("n_cf").alias("n_f"))
    tot = d.select(F.struct(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))).scalar()
    j = join_null_safe(join_null_safe(d, cf, [category, "fold"]), c, [category]).join(f, "fold")
    oof_n = F.col("n_c") - F.col("n_cf")
    glob = F.try_divide(tot.getField("s") - F.col("s_f"), tot.getField("n") - F.col("n_f"))  # null with one fold
    enc = F.when(oof_n > 0, (F.col("s_c") - F.col("s_cf")) / oof_n).otherwise(glob)
    full = F.col("s_c") / F.col("n_c")
    return j.select(id_col, category, "fold", "y", enc.alias("oof_encoding"), full.alias("full_encoding"),
                    (full - enc).alias("leak_gap"))


# ------------------------------------------------------------------ D4 ----

def class_balance_audit(labels: DataFrame, docs: DataFrame, min_chars: int = 500) -> DataFrame:
    """Per label column: positive share, majority-class baseline accuracy beside precision,
    recall, F1 and accuracy of a length-gate predictor (n_chars ≥ min_chars)."""
    j = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), (F.col(c) == 1).alias("y")) for c in ("quality", "toxic")]))
    long = j.select((F.col("n_chars") >= min_chars).alias("pred"), both.alias("l")).select("pred", "l.label", "l.y")
    pred, y = F.col("pred"), F.col("y")
    u = long.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("positives"),
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    n, p = F.col("n"), F.col("positives")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return u.select("label", "n", "positives", (p / n).alias("positive_share"),
                    (F.greatest(p, n - p) / n).alias("majority_accuracy"), "tp", "fp", "fn", "tn",
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"),
                    ((F.col("tp") + F.col("tn")) / n).alias("accuracy"))


# ------------------------------------------------------------------ D5 ----

def temporal_folds(df: DataFrame, ts: str, k: int = 5) -> DataFrame:
    """Equal-width time folds; expanding scheme (train = earlier folds, test = fold i) with the
    ordering audit max(train.ts) < min(test.ts)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    mm = df.select(F.struct(F.min(us).alias("lo"), F.max(us).alias("hi"))).scalar()
    place = F.try_divide(us - mm.getField("lo"), mm.getField("hi") - mm.getField("lo"))  # one distinct time: all in fold 0
    fold = F.least(F.floor(F.coalesce(place, F.lit(0.0)) * k), F.lit(k - 1))
    per = df.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # ≤ k rows
    out = per.select("fold", F.col("rows").alias("test_rows"), F.col("min_ts").alias("test_min_ts"),
                     F.sum("rows").over(w).alias("train_rows"), F.max("max_ts").over(w).alias("train_max_ts"))
    return out.where(F.col("fold") > 0).select("fold", "train_rows", "test_rows", "train_max_ts", "test_min_ts",
                                               (F.col("train_max_ts") < F.col("test_min_ts")).alias("ordered"))


# ------------------------------------------------------------------ D6 ----

def past_only_features(events: DataFrame, w: int = 3) -> DataFrame:
    """Lag and trailing mean of the previous w values per user (never the current or a future row);
    the audit compares each feature with the *next* value to flag look-ahead."""
    e = events.select("user_id", "ts", "event_id", "value", F.round(F.col("value") * 100).cast("long").alias("c"))
    j = prefix_scan(e, ["user_id"], ["ts", "event_id"], rn="rn", lags={"prev_value": ("value", 1)}, trailing={"back": ("c", w + 1)}, leads={"next_value": "value"})
    n_prev = F.least(F.col("rn") - 1, F.lit(w))
    trailing = F.when(n_prev > 0, (F.col("back") - F.coalesce("c", F.lit(0))).cast("double") / n_prev / 100.0)
    return j.select("user_id", "ts", "event_id", "rn", "value", "prev_value", trailing.alias(f"trailing_mean_{w}"),
                    "next_value", (F.col("prev_value") == F.col("next_value")).alias("lag_equals_future"))


# ------------------------------------------------------------------ D7 ----

def stratified_split(df: DataFrame, id_col: str, label: str, train_tenths: int = 8, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exact per-class split: rank within class by md5(seed‖id) (chunked), first ⌊n·t/10⌋ → train."""
    d = df.select(id_col, label, seeded_hash(seed, id_col).alias("_h"))
    sizes = d.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    r = chunked_row_number(d, [label], [F.col("_h")], hash_chunks(F.col("_h")), out="class_rank")
    r = join_null_safe(r, sizes, [label])
    return r.select(id_col, label, F.when(F.col("class_rank") * 10 <= F.col("class_n") * train_tenths, "train")
                    .otherwise("test").alias("split"))


def split_class_drift(df: DataFrame, id_col: str, label: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """D7 audit: class share per split vs overall, for a plain hash split and the stratified split."""
    plain = df.select(id_col, label, F.when(hash_bucket(seeded_hash(seed, id_col)) < "cccc", "train")
                      .otherwise("test").alias("split")).withColumn("method", F.lit("hash"))
    strat = stratified_split(df, id_col, label, seed=seed).withColumn("method", F.lit("stratified"))
    u = plain.unionByName(strat)
    g = u.groupBy("method", "split", label).agg(F.count(F.lit(1)).alias("n"))
    st = g.groupBy("method", "split").agg(F.sum("n").alias("split_n"))
    ov = g.groupBy("method", label).agg(F.sum("n").alias("class_n"))
    tot = df.select(F.count(F.lit(1))).scalar()
    j = join_null_safe(g.join(st, ["method", "split"]), ov, ["method", label])
    share, overall = F.col("n") / F.col("split_n"), F.col("class_n") / tot
    return j.select("method", "split", label, "n", share.alias("share"), overall.alias("overall_share"),
                    F.abs(share - overall).alias("abs_diff"))


# ------------------------------------------------------------------ D8 ----

def group_split(df: DataFrame, group_key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """train/validation/test by group hash, so a group never spans splits."""
    return df.withColumn("split", split_of(seeded_hash(seed, group_key)))


def group_integrity_audit(df: DataFrame, row_key: str, group_key: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """D8 audit: groups spread over more than one split, row-keyed split vs group-keyed split."""
    parts = []
    for method, key in (("by_row", row_key), ("by_group", group_key)):
        a = df.select(group_key, split_of(seeded_hash(seed, key)).alias("split"))
        per = a.groupBy(group_key, "split").agg(F.count(F.lit(1)).alias("n")).groupBy(group_key).agg(F.count(F.lit(1)).alias("n_splits"))
        parts.append(per.agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("groups"),
                             F.count_if(F.col("n_splits") > 1).alias("groups_in_several_splits")))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ D9 ----

def seeded_sample(df: DataFrame, key: str, per_mille: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Reproducible Bernoulli sample of ~per_mille/1000 by md5(seed‖key) (whole groups of ``key``)."""
    h = seeded_hash(seed, key)
    bucket = hex_digit(h, 1) * 256 + hex_digit(h, 2) * 16 + hex_digit(h, 3)  # 0..4095
    return df.where(bucket * 1000 < per_mille * 4096)


# ----------------------------------------------------------------- D10 ----

def tolerance_compare(a: DataFrame, b: DataFrame, key: str, col: str, atol: float = 1e-6, rtol: float = 1e-9) -> DataFrame:
    """Full outer join on key; close when |a−b| ≤ atol + rtol·|b|; both null counts as equal."""
    j = a.select(key, F.col(col).alias("a")).join(b.select(key, F.col(col).alias("b")), key, "full")
    close = (F.when(F.col("a").isNull() & F.col("b").isNull(), True)
             .when(F.col("a").isNull() | F.col("b").isNull(), False)
             .otherwise(F.abs(F.col("a") - F.col("b")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("b"))))
    return j.select(key, "a", "b", close.alias("close"))


# ----------------------------------------------------------------- D11 ----

def cancellation_audit(df: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Naive E[x²]−E[x]² against the stable population variance per group; digits at risk."""
    g = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(x) * F.col(x)).alias("ex2"),
                                F.avg(x).alias("ex"), F.var_pop(x).alias("var_pop"))
    naive = F.col("ex2") - F.col("ex") * F.col("ex")
    return g.select(*groups, "n", "var_pop", naive.alias("naive_var"),
                    F.when(F.col("var_pop") > 0, F.log10(F.col("ex2") / F.col("var_pop"))).alias("digits_lost"))


# ----------------------------------------------------------------- D12 ----

def guarded_log(df: DataFrame, x: str, eps: float = 1e-9) -> DataFrame:
    """Log with a floor and log1p of the positive part; ``nonpositive`` marks rows a plain log breaks."""
    return df.select("*", (F.col(x) <= 0).alias("nonpositive"),
                     F.log(F.greatest(F.col(x), F.lit(eps))).alias(f"log_{x}"),
                     F.log1p(F.greatest(F.col(x), F.lit(0.0))).alias(f"log1p_{x}"))


# ----------------------------------------------------------------- D13 ----

INT32_MAX = 2**31 - 1


def int32_overflow_audit(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Exact 64-bit group sums and what a wrapping 32-bit accumulator would report."""
    g = df.groupBy(group).agg(F.sum(value.cast("long")).alias("sum64"))
    wrapped = F.pmod(F.col("sum64") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return g.select(group, "sum64", (F.abs(F.col("sum64")) > INT32_MAX).alias("overflows_int32"), wrapped.alias("int32_result"))


# ----------------------------------------------------------------- D14 ----

def safe_normalize(df: DataFrame, group: str, x: str, eps: float = 1e-12) -> DataFrame:
    """Per-group z-score and min-max with zero-spread guards (stats table joined back)."""
    st = df.groupBy(group).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"), F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    j = join_null_safe(df, st, [group])
    z = F.when(F.col("_std") > eps, (F.col(x) - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
    mm = F.when(F.col("_mx") - F.col("_mn") > eps, (F.col(x) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(F.lit(0.0))
    return j.select(*df.columns, z.alias("z"), mm.alias("minmax"))


# ----------------------------------------------------------------- D15 ----

def tie_audit(df: DataFrame, sort_col: str, id_col: str, k: int) -> DataFrame:
    """Ties of a sort key overall and at the top-k boundary (descending sort)."""
    boundary = df.orderBy(F.col(sort_col).desc(), F.col(id_col)).limit(k).select(F.min(sort_col)).scalar()
    ties = df.groupBy(sort_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    tied = ties.select(F.struct(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("r"))).scalar()
    edge = df.agg(F.count_if(F.col(sort_col) > boundary).alias("rows_above"),
                  F.count_if(F.col(sort_col) == boundary).alias("rows_at_boundary"))
    return edge.select(
        F.lit(k).alias("k"), boundary.alias("boundary_value"), tied.getField("v").alias("tied_values"),
        tied.getField("r").alias("tied_rows"), "rows_above", "rows_at_boundary",
        ((F.col("rows_at_boundary") > 1) & (F.col("rows_above") + F.col("rows_at_boundary") > k)).alias("order_dependent"))


# ----------------------------------------------------------------- D16 ----

def normalize_to_utc(df: DataFrame, local_ts: str, zone: str) -> DataFrame:
    """Local wall-clock → UTC; flag times that do not round-trip (skipped in a DST gap) and times that two
    instants show (ambiguous: an instant up to two hours off shows the same local time; zones shift by 20 minutes to
    two hours, in steps of ten minutes)."""
    local = F.col(local_ts).cast("timestamp")
    utc = F.to_utc_timestamp(local, zone)
    shows = lambda minutes: F.from_utc_timestamp(utc + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), zone) == local
    twice = F.lit(False)
    for m in range(10, 130, 10):
        twice = twice | shows(m) | shows(-m)
    return df.select("*", utc.cast("timestamp_ntz").alias("ts_utc"), (F.from_utc_timestamp(utc, zone) != local).alias("skipped"), twice.alias("ambiguous"))
