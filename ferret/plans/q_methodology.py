"""Registered data-methodology queries (D1–D16) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferret.operators import methodology as M
from ferret.operators.neighbours import nearest_neighbours
from ferret.plans.catalog import register
from ferret.sources.tables import Tables

H = "md5('42|' || CAST({k} AS VARCHAR))"
SPLIT = ("CASE WHEN substr({h}, 1, 4) < 'b333' THEN 'train' WHEN substr({h}, 1, 4) < 'd999' THEN 'validation' "
         "ELSE 'test' END")
NORM = r"md5(lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))))"
HEXV = "(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"


def _split(k):
    return SPLIT.format(h=H.format(k=k))


@register("split_overlap", "D1 U1", f"""
WITH u AS (SELECT {NORM.format(c='text')} AS content_hash, {_split('doc_id')} AS split FROM documents
           UNION ALL SELECT {NORM.format(c='text')}, 'benchmark' FROM benchmark),
per AS (SELECT content_hash, split, count(*) AS n FROM u GROUP BY 1, 2)
SELECT content_hash, count(*) AS n_splits, CAST(sum(n) AS BIGINT) AS n_rows,
       array_to_string(list_sort(list(split)), ',') AS splits
FROM per GROUP BY content_hash HAVING count(*) > 1""")
def q_split_overlap(spark, d):
    t = Tables(spark, d)
    return M.split_overlap(t.documents, t.benchmark)


@register("train_only_scaling", "D2", f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, {_split('l_orderkey')} AS split FROM lineitem),
s AS (SELECT avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS mn,
             max(l_extendedprice) AS mx FROM d WHERE split = 'train')
SELECT l_orderkey, l_linenumber, l_extendedprice, split,
       CASE WHEN std > 1e-12 THEN (l_extendedprice - mean) / std ELSE 0.0 END AS z,
       CASE WHEN mx - mn > 0 THEN (l_extendedprice - mn) / (mx - mn) ELSE 0.0 END AS minmax
FROM d, s""")
def q_train_only_scaling(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return M.train_only_scaling(li, "l_extendedprice", "l_orderkey")


@register("scaler_leakage_report", "D2", f"""
WITH d AS (SELECT l_extendedprice AS x, {_split('l_orderkey')} = 'train' AS t FROM lineitem)
SELECT avg(x) FILTER (WHERE t) AS train_mean, avg(x) AS full_mean,
       stddev_samp(x) FILTER (WHERE t) AS train_std, stddev_samp(x) AS full_std,
       min(x) FILTER (WHERE t) AS train_min, min(x) AS full_min, max(x) FILTER (WHERE t) AS train_max, max(x) AS full_max,
       avg(x) - avg(x) FILTER (WHERE t) AS mean_shift, stddev_samp(x) - stddev_samp(x) FILTER (WHERE t) AS std_shift
FROM d""")
def q_scaler_leakage_report(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_extendedprice")
    return M.scaler_leakage_report(li, "l_extendedprice", "l_orderkey")


_OOF = f"""
WITH d AS (SELECT o_orderkey, o_custkey, CAST(o_orderstatus = 'F' AS BIGINT) AS y,
                  CAST({HEXV.format(h=H.format(k='o_orderkey'), i=1)} % 5 AS BIGINT) AS fold FROM orders),
cf AS (SELECT o_custkey, fold, sum(y) AS s_cf, count(*) AS n_cf FROM d GROUP BY 1, 2),
c AS (SELECT o_custkey, sum(y) AS s_c, count(*) AS n_c FROM d GROUP BY 1),
f AS (SELECT fold, sum(y) AS s_f, count(*) AS n_f FROM d GROUP BY 1),
t AS (SELECT sum(y) AS s, count(*) AS n FROM d),
e AS (SELECT d.*, c.s_c, c.n_c,
             CASE WHEN c.n_c - cf.n_cf > 0 THEN CAST(c.s_c - cf.s_cf AS DOUBLE) / (c.n_c - cf.n_cf)
                  ELSE CAST(t.s - f.s_f AS DOUBLE) / (t.n - f.n_f) END AS oof_encoding
      FROM d JOIN cf ON cf.o_custkey = d.o_custkey AND cf.fold = d.fold JOIN c ON c.o_custkey = d.o_custkey
      JOIN f ON f.fold = d.fold, t)
SELECT o_orderkey, o_custkey, fold, y, oof_encoding, CAST(s_c AS DOUBLE) / n_c AS full_encoding,
       CAST(s_c AS DOUBLE) / n_c - oof_encoding AS leak_gap FROM e"""


@register("oof_target_encoding", "D3", _OOF)
def q_oof_target_encoding(spark, d):
    o = Tables(spark, d).orders
    return M.oof_target_encoding(o, "o_orderkey", "o_custkey", F.col("o_orderstatus") == "F")


_BAL = """
SELECT '{lab}' AS label, count(*) AS n, count(*) FILTER (WHERE {lab} = 1) AS positives,
       count(*) FILTER (WHERE n_chars >= 500 AND {lab} = 1) AS tp, count(*) FILTER (WHERE n_chars >= 500 AND {lab} <> 1) AS fp,
       count(*) FILTER (WHERE n_chars < 500 AND {lab} = 1) AS fn, count(*) FILTER (WHERE n_chars < 500 AND {lab} <> 1) AS tn
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


@register("class_balance_audit", "D4 A25", f"""
WITH u AS ({_BAL.format(lab='quality')} UNION ALL {_BAL.format(lab='toxic')}),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM u)
SELECT label, n, positives, CAST(positives AS DOUBLE) / n AS positive_share,
       CAST(greatest(positives, n - positives) AS DOUBLE) / n AS majority_accuracy, tp, fp, fn, tn, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CAST(tp + tn AS DOUBLE) / n AS accuracy
FROM m""")
def q_class_balance_audit(spark, d):
    t = Tables(spark, d)
    return M.class_balance_audit(t.labels, t.documents)


@register("temporal_folds", "D5", """
WITH mm AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
e AS (SELECT ts, CAST(least(floor((epoch_us(ts) - lo) / (hi - lo) * 5), 4) AS BIGINT) AS fold FROM events, mm),
per AS (SELECT fold, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM e GROUP BY 1),
o AS (SELECT fold, rows AS test_rows, min_ts AS test_min_ts,
             sum(rows) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_rows,
             max(max_ts) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_max_ts FROM per)
SELECT fold, CAST(train_rows AS BIGINT) AS train_rows, test_rows, train_max_ts, test_min_ts,
       train_max_ts < test_min_ts AS ordered
FROM o WHERE fold > 0""")
def q_temporal_folds(spark, d):
    return M.temporal_folds(Tables(spark, d).events, "ts", 5)


_UW = "PARTITION BY user_id ORDER BY ts, event_id"


@register("past_only_features", "D6 W14", f"""
SELECT user_id, ts, event_id, rn, value, prev_value, trailing_mean_3, next_value,
       prev_value = next_value AS lag_equals_future
FROM (SELECT user_id, ts, event_id, value, row_number() OVER ({_UW}) AS rn,
             lag(value) OVER ({_UW}) AS prev_value, lead(value) OVER ({_UW}) AS next_value,
             CASE WHEN row_number() OVER ({_UW}) > 1 THEN
               CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER ({_UW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE)
               / least(row_number() OVER ({_UW}) - 1, 3) / 100.0 END AS trailing_mean_3
      FROM events) x""")
def q_past_only_features(spark, d):
    return M.past_only_features(Tables(spark, d).events, 3)


_STRAT = f"""
SELECT doc_id, quality, CASE WHEN rk * 10 <= n * 8 THEN 'train' ELSE 'test' END AS split
FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H.format(k='doc_id')}) AS rk,
             count(*) OVER (PARTITION BY quality) AS n FROM labels) r"""


@register("stratified_split", "D7", _STRAT)
def q_stratified_split(spark, d):
    return M.stratified_split(Tables(spark, d).labels, "doc_id", "quality")


@register("split_class_drift", "D7", f"""
WITH u AS (SELECT doc_id, quality, CASE WHEN substr({H.format(k='doc_id')}, 1, 4) < 'cccc' THEN 'train' ELSE 'test' END AS split,
                  'hash' AS method FROM labels
           UNION ALL SELECT doc_id, quality, split, 'stratified' AS method FROM ({_STRAT}) s),
g AS (SELECT method, split, quality, count(*) AS n FROM u GROUP BY 1, 2, 3),
st AS (SELECT method, split, sum(n) AS split_n FROM g GROUP BY 1, 2),
ov AS (SELECT method, quality, sum(n) AS class_n FROM g GROUP BY 1, 2),
tot AS (SELECT count(*) AS t FROM labels)
SELECT g.method, g.split, g.quality, g.n, CAST(g.n AS DOUBLE) / st.split_n AS share,
       CAST(ov.class_n AS DOUBLE) / tot.t AS overall_share,
       abs(CAST(g.n AS DOUBLE) / st.split_n - CAST(ov.class_n AS DOUBLE) / tot.t) AS abs_diff
FROM g JOIN st ON st.method = g.method AND st.split = g.split JOIN ov ON ov.method = g.method AND ov.quality = g.quality, tot""")
def q_split_class_drift(spark, d):
    return M.split_class_drift(Tables(spark, d).labels, "doc_id", "quality")


@register("group_split", "D8", f"""
SELECT o_orderkey, o_custkey, {_split('o_custkey')} AS split FROM orders""")
def q_group_split(spark, d):
    return M.group_split(Tables(spark, d).orders.select("o_orderkey", "o_custkey"), "o_custkey")


@register("group_integrity_audit", "D8 U9", f"""
SELECT 'by_row' AS method, count(*) AS groups, count(*) FILTER (WHERE n_splits > 1) AS groups_in_several_splits
FROM (SELECT o_custkey, count(DISTINCT {_split('o_orderkey')}) AS n_splits FROM orders GROUP BY 1) a
UNION ALL
SELECT 'by_group', count(*), count(*) FILTER (WHERE n_splits > 1)
FROM (SELECT o_custkey, count(DISTINCT {_split('o_custkey')}) AS n_splits FROM orders GROUP BY 1) b""")
def q_group_integrity_audit(spark, d):
    return M.group_integrity_audit(Tables(spark, d).orders, "o_orderkey", "o_custkey")


@register("seeded_sample", "D9", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE ({HEXV.format(h=H.format(k='l_orderkey'), i=1)} * 256 + {HEXV.format(h=H.format(k='l_orderkey'), i=2)} * 16
       + {HEXV.format(h=H.format(k='l_orderkey'), i=3)}) * 1000 < 100 * 4096""")
def q_seeded_sample(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return M.seeded_sample(li, "l_orderkey", 100)


@register("tolerance_compare", "D10", """
WITH a AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey, sum(l_extendedprice) - sum(l_extendedprice * l_discount) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, round(a.v, 2) AS a, round(b.v, 2) AS b,
       CASE WHEN a.v IS NULL AND b.v IS NULL THEN true WHEN a.v IS NULL OR b.v IS NULL THEN false
            ELSE abs(a.v - b.v) <= 1e-6 + 1e-9 * abs(b.v) END AS close
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey""")
def q_tolerance_compare(spark, d):
    li = Tables(spark, d).lineitem
    a = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    b = li.groupBy("l_suppkey").agg((F.sum("l_extendedprice") - F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("v"))
    out = M.tolerance_compare(a, b, "l_suppkey", "v")
    return out.select("l_suppkey", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "close")


@register("cancellation_audit", "D11", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(var_pop(l_extendedprice), 2) AS var_pop,
       round(log10(avg(l_extendedprice * l_extendedprice) / var_pop(l_extendedprice)), 3) AS digits_lost
FROM lineitem GROUP BY 1, 2""")
def q_cancellation_audit(spark, d):
    out = M.cancellation_audit(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", F.round("var_pop", 2).alias("var_pop"),
                      F.round("digits_lost", 3).alias("digits_lost"))


@register("guarded_log", "D12", """
SELECT c_custkey, c_acctbal, c_acctbal <= 0 AS nonpositive, ln(greatest(c_acctbal, 1e-9)) AS log_c_acctbal,
       ln(1 + greatest(c_acctbal, 0.0)) AS log1p_c_acctbal FROM customer""")
def q_guarded_log(spark, d):
    return M.guarded_log(Tables(spark, d).customer.select("c_custkey", "c_acctbal"), "c_acctbal")


@register("int32_overflow_audit", "D13", """
SELECT l_suppkey, sum64, abs(sum64) > 2147483647 AS overflows_int32,
       ((sum64 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS int32_result
FROM (SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum64
      FROM lineitem GROUP BY 1) g""")
def q_int32_overflow_audit(spark, d):
    li = Tables(spark, d).lineitem
    return M.int32_overflow_audit(li, "l_suppkey", F.round(F.col("l_extendedprice") * 100))


@register("safe_normalize", "D14", """
WITH s AS (SELECT l_suppkey, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_quantity) AS mn,
                  max(l_quantity) AS mx FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity,
       CASE WHEN s.std > 1e-12 THEN (l.l_quantity - s.mean) / s.std ELSE 0.0 END AS z,
       CASE WHEN s.mx - s.mn > 1e-12 THEN (l.l_quantity - s.mn) / (s.mx - s.mn) ELSE 0.0 END AS minmax
FROM lineitem l JOIN s ON s.l_suppkey = l.l_suppkey""")
def q_safe_normalize(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return M.safe_normalize(li, "l_suppkey", "l_quantity")


@register("tie_audit", "D15", """
WITH b AS (SELECT min(o_totalprice) AS v FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) x),
t AS (SELECT count(*) AS tied_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS tied_rows
      FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) y),
e AS (SELECT count(*) FILTER (WHERE o_totalprice > (SELECT v FROM b)) AS rows_above,
             count(*) FILTER (WHERE o_totalprice = (SELECT v FROM b)) AS rows_at_boundary FROM orders)
SELECT 100 AS k, (SELECT v FROM b) AS boundary_value, tied_values, tied_rows, rows_above, rows_at_boundary,
       rows_at_boundary > 1 AND rows_above + rows_at_boundary > 100 AS order_dependent
FROM t, e""")
def q_tie_audit(spark, d):
    return M.tie_audit(Tables(spark, d).orders, "o_totalprice", "o_orderkey", 100)


# New York's clock changes of 2024 as a table: the second Sunday of March and the first of November
@register("utc_normalization", "D16", """
WITH e AS (SELECT event_id, user_id, ts FROM events),
z AS (SELECT *, ts >= TIMESTAMP '2024-03-10 02:00' AND ts < TIMESTAMP '2024-03-10 03:00' AS skipped,
                ts >= TIMESTAMP '2024-11-03 01:00' AND ts < TIMESTAMP '2024-11-03 02:00' AS ambiguous,
                ts >= TIMESTAMP '2024-03-10 03:00' AND ts < TIMESTAMP '2024-11-03 01:00' AS summer FROM e)
SELECT event_id, user_id, ts, ts + CASE WHEN summer THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS ts_utc, skipped, ambiguous FROM z""")
def q_utc_normalization(spark, d):
    e = Tables(spark, d).events.select("event_id", "user_id", "ts")
    return M.normalize_to_utc(e, "ts", "America/New_York")


@register("nearest_vectors", "D17", """
WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
           FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 12) DESC, neighbour_id) AS rank FROM p)
SELECT vec_id, rank, neighbour_id, similarity FROM r WHERE rank <= 5""")
def q_nearest_vectors(spark, d):
    return nearest_neighbours(Tables(spark, d).embeddings, "vec_id", "embedding", 5).withColumnRenamed("id", "vec_id")
