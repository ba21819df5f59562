"""Unit cases restated as literal DataFrames, golden values and invariants."""

import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from ferret.functions import text as X
from ferret.functions.ordering import chunked_row_number, hash_chunks, seeded_hash
from ferret.functions.prefix_scan import prefix_scan
from ferret.operators import corpus as C
from ferret.operators import evaluation as E
from ferret.operators import maintenance as U
from ferret.operators import methodology as M
from ferret.operators import ranking as W
from ferret.sources import files as S
from ferret.sources.tables import Tables


def test_url_normalise_and_slug(spark):
    urls = ["git@github.com:o/r.git", "git://github.com/o/r", "https://github.com/o/r.git/", "https://github.com/o/r/", "single"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = df.select(X.normalize_github_url("url").alias("n"), X.repo_slug("url").alias("s")).collect()
    assert [r.n for r in out] == ["https://github.com/o/r", "https://github.com/o/r", "https://github.com/o/r",
                                  "https://github.com/o/r", "single"]
    assert [r.s for r in out] == ["git@github.com:o__r.git", "o__r", "o__r.git", "o__r", "single"]


def test_domain_first_match_wins(spark):
    from ferret.functions.vocab import SCIENTIFIC_DOMAINS
    df = spark.createDataFrame([(["EEG signal analysis"],), (["Protein folding"],), ([],), (None,)], "tasks array<string>")
    got = [r.d for r in df.select(X.classify_tasks("tasks", SCIENTIFIC_DOMAINS).alias("d")).collect()]
    assert got == ["medical", "biology", None, None]  # eeg is in medical and neuroscience: medical first


def test_size_budget_golden(spark):
    df = spark.createDataFrame([(200,), (600,), (10000,)], "n long")
    assert [r.b for r in df.select(X.size_budget("n", 120, max_factor=5).alias("b")).collect()] == [120, 220, 600]
    assert df.select(X.size_budget("n", 120).alias("b")).collect()[2].b == 120 + 50 * 49


def test_label_parsing_and_verdict(spark):
    df = spark.createDataFrame([("nb_12.ipynb", "Y (MinMaxScaler)"), ("x nb_3", "N [human errors]")], "nb string, pre string")
    out = df.select(X.nb_id("nb").alias("id"), X.yes_label("pre").alias("y")).collect()
    assert [(r.id, r.y) for r in out] == [("nb_12", True), ("nb_3", False)]
    v = spark.createDataFrame([("VALID: the scaler leaks\n  fit on all data \n\nsecond",), ("INVALID - no",), ("",)], "t string")
    got = v.select(X.verdict("t").alias("v"), X.reasoning_text("t").alias("r")).collect()
    assert [r.v for r in got] == ["valid", "invalid", "uncertain"]
    assert [r.r for r in got] == ["the scaler leaks fit on all data second", "", ""]
    odd = [("\n VALID: This is a real issue, see below\nbecause",), ("no verdict here\nreason",), ("uncertain:\n\n a \n b",), (None,), ("INVALID:x",)]
    got = spark.createDataFrame(odd, "t string").select(X.reasoning_text("t").alias("r")).collect()
    assert [r.r for r in got] == ["because", "reason", "a b", None, "x"]


def test_prf_golden(spark):
    df = spark.createDataFrame([("pre", 13, 7, 0, 32), ("multi", 4, 1, 18, 27), ("overlap", 0, 0, 3, 43)],
                               "label string, tp long, fp long, fn long, tn long").withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    m = {r.label: r for r in E.label_metrics(df).collect()}
    assert (round(m["pre"].precision * 100, 1), round(m["pre"].recall * 100, 1), round(m["pre"].f1 * 100, 1)) == (65.0, 100.0, 78.8)
    assert (round(m["multi"].precision * 100, 1), round(m["multi"].recall * 100, 1), round(m["multi"].f1 * 100, 1)) == (80.0, 18.2, 29.6)
    assert (m["overlap"].precision, m["overlap"].recall, m["overlap"].f1) == (0.0, 0.0, 0.0)
    assert m["ALL"].tp == 17


def test_precision_half_even_golden(spark):
    df = spark.createDataFrame([(5, 21), (52, 77), (28, 39), (1, 6)], "v long, t long")
    got = [r.p for r in df.select(F.bround(F.col("v") / F.col("t") * 100.0, 0).cast("long").alias("p")).collect()]
    assert got == [24, 68, 72, 17]


def test_scenario_scoring_golden(spark):
    # 148 intended, 126 found as expected, 27 bonus, 111 false positives
    exp = spark.range(148).select(F.lit(1).alias("run_id"), F.col("id").alias("k"))
    found = spark.range(126).union(spark.range(1000, 1027)).union(spark.range(2000, 2111)).select(
        F.lit(1).alias("run_id"), F.col("id").alias("k"), F.col("id").between(1000, 1026).alias("valid"))
    r = E.scenario_scoring(exp, found, "k").collect()[0]
    assert (r.tp, r.bonus, r.fp, r.fn) == (126, 27, 111, 22)
    assert (round(r.precision * 100, 1), round(r.recall * 100, 1), round(r.f1 * 100, 1)) == (58.0, 85.1, 69.0)


def test_balanced_sample_five_and_five(spark):
    df = spark.createDataFrame([(i, "biology" if i < 10 else "medical") for i in range(20)], "id long, domain string")
    out = W.balanced_sample(df, "id", "domain", 10).groupBy("domain").count().collect()
    assert sorted((r.domain, r["count"]) for r in out) == [("biology", 5), ("medical", 5)]


def hot_events(spark):
    # a key with 90 % of the rows, null keys, many rows with one time, null values
    return spark.range(2000).select(
        F.when(F.col("id") % 10 < 9, 1).when(F.col("id") % 20 == 9, 2).alias("k"), F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("id") % 700) * 7).cast("decimal(18,6)"))).alias("ts"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 101).alias("value"))


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (7, 3), (40, 50), (400, 10_000)])
def test_prefix_scan_matches_windows(spark, partitions, batch):
    ev = hot_events(spark).withColumn("d", F.col("value").cast("double"))
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = ev.select("event_id", F.row_number().over(w).alias("rn"), F.lag("value").over(w).alias("pv"), F.lag("ts", 4).over(w).alias("pt"), F.coalesce(F.sum("value").over(run), F.lit(0)).alias("cs"),
                    F.max("d").over(run).alias("mx"), F.coalesce(F.sum("value").over(w.rowsBetween(-2, 0)), F.lit(0)).alias("w3"),
                    F.coalesce(F.sum("value").over(w.rowsBetween(-6, 0)), F.lit(0)).alias("w7"), F.lead("value").over(w).alias("nx"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = prefix_scan(ev.repartition(5), ["k"], ["ts", "event_id"], rn="rn", sums={"cs": "value"}, maxes={"mx": "d"}, lags={"pv": ("value", 1), "pt": ("ts", 4)},
                          trailing={"w3": ("value", 3), "w7": ("value", 7)}, leads={"nx": "value"}, partitions=partitions)
        found = {r.event_id: r for r in got.select(*ref.columns).collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = ref.collect()
    assert len(found) == len(want) == 2000 and all(found[r.event_id] == r for r in want)
    # the rows were shuffled once, when the scan was staged; what is left is a broadcast of one row a partition
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_prefix_scan_deals_out_a_hot_key(spark):
    ev = hot_events(spark).where("k = 1")
    parts = ev.repartitionByRange(16, "k", "ts", "event_id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 500
    assert prefix_scan(ev.where("false"), ["k"], ["ts", "event_id"], rn="rn").collect() == []
    nan = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 5.0), (2, 1, float("-inf")), (2, 2, None), (3, 1, None)], "k int, t int, v double")
    got = {(r.k, r.t): r.m for r in prefix_scan(nan, ["k"], ["t"], maxes={"m": "v"}, partitions=5).collect()}
    assert got[1, 1] != got[1, 1] and got[1, 2] != got[1, 2] and got[2, 1] == got[2, 2] == float("-inf") and got[3, 1] is None


def test_chunked_row_numbers(spark):
    ev = hot_events(spark)
    h = ev.withColumn("h", F.md5(F.col("event_id").cast("string")))
    got = chunked_row_number(h, [], [F.col("h")], hash_chunks(F.col("h"))).orderBy("h").collect()
    assert [r.rn for r in got] == list(range(1, 2001))


def test_samples_are_cut_before_the_shuffle(spark, capsys):
    docs = Tables(spark, SF_SMALL).documents.select("doc_id", "lang")
    plan = W.balanced_sample(docs, "doc_id", "lang", 101)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_seeded_hash_independent_of_partitioning(spark):
    li = Tables(spark, SF_SMALL).lineitem
    a = M.seeded_sample(li, "l_orderkey", 100).select(F.sum(F.crc32(F.col("l_orderkey").cast("string")))).first()[0]
    b = M.seeded_sample(li.repartition(13), "l_orderkey", 100).select(F.sum(F.crc32(F.col("l_orderkey").cast("string")))).first()[0]
    assert a == b


def test_group_split_integrity(spark):
    o = Tables(spark, SF_SMALL).orders
    r = {x.method: x for x in M.group_integrity_audit(o, "o_orderkey", "o_custkey").collect()}
    assert r["by_group"].groups_in_several_splits == 0
    assert r["by_row"].groups_in_several_splits > 0


def test_stratified_split_keeps_class_shares(spark):
    labels = Tables(spark, SF_SMALL).labels
    d = {(x.method, x.split, x.quality): x.abs_diff for x in M.split_class_drift(labels, "doc_id", "quality").collect()}
    assert max(v for k, v in d.items() if k[0] == "stratified") <= 0.05


def test_dst_flags(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30),), (dt.datetime(2024, 11, 3, 1, 30),), (dt.datetime(2024, 1, 5, 12, 0),)],
                               "ts timestamp_ntz")
    got = [(r.skipped, r.ambiguous) for r in M.normalize_to_utc(df, "ts", "America/New_York").collect()]
    assert got[0][0] is True and got[1][1] is True and got[2] == (False, False)


def test_notebook_code_and_quarantine(spark):
    nb1 = json.dumps({"cells": [{"cell_type": "markdown", "source": "# t"}, {"cell_type": "code", "source": ["import a\n", "x=1"]},
                                {"cell_type": "code", "source": "y=2"}]})
    df = spark.createDataFrame([("a.ipynb", nb1), ("b.ipynb", "{not json")], "path string, content string")
    code, bad = S.notebook_code(df)
    assert [r.code for r in code.collect()] == ["import a\nx=1\n\ny=2"]
    assert [r.path for r in bad.collect()] == ["b.ipynb"]


def test_exposition_rollup(spark):
    text = "# HELP x\nreq_total{model=\"a\"} 1.5e+06\nreq_total{model=\"b\"} 2\nrun 3\nrun{k=\"v\"} 10\n"
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), text)], "ts timestamp, text string")
    got = {r.name: r.value for r in S.rollup_series(S.parse_exposition(df)).collect()}
    assert got == {"req_total": 1500002.0, "run": 3.0}


def test_notebook_cells_that_look_like_lists(spark):
    nb = json.dumps({"cells": [{"cell_type": "code", "source": "[1, 2]\nx"}, {"cell_type": "code", "source": "[\"a\"]"}, {"cell_type": "code", "source": ["[", "3]"]},
                               {"cell_type": "code"}, {"cell_type": "raw", "source": "no"}]})
    code, bad = S.notebook_code(spark.createDataFrame([("a", nb), ("b", "{}"), ("c", None)], "path string, content string"))
    assert [r.code for r in code.collect()] == ['[1, 2]\nx\n\n["a"]\n\n[3]\n\n'] and sorted(r.path for r in bad.collect()) == ["b", "c"]


def test_exposition_skips_what_is_no_number(spark):
    text = "a 1\nb NaN\nc oops\n{x} 3\nd_bucket{le=\"+Inf\"} +Inf\nbroken"
    got = S.parse_exposition(spark.createDataFrame([(dt.datetime(2024, 1, 1), text)], "ts timestamp, text string")).collect()
    assert [r.name for r in got] == ["a", "b", "d_bucket"] and got[2].value == float("inf")


def test_boilerplate_strip():
    html = ("<html><body><nav><a href='/x'>menu</a></nav><div class='site-sidebar'><div>in</div>side</div>"
            "<script>var a='</p>';</script><article><p>Keep this text</p></article><footer>f</footer></body></html>")
    assert C.strip_boilerplate(html) == "Keep this text"
    assert C.strip_boilerplate('<p>a</p><img class="menu-icon"><p>b</p><input id="toc"/><p>c</p>') == "a\nb\nc"


def test_snippet_containment_matches_bruteforce(spark):
    t = Tables(spark, SF_SMALL)
    fast = {(r.item_id, r.doc_id) for r in C.snippet_containment(t.benchmark, t.documents).collect()}
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    brute = t.benchmark.select("item_id", norm(F.col("text")).alias("i")).crossJoin(
        t.documents.select("doc_id", norm(F.col("text")).alias("d"))).where(F.col("d").contains(F.col("i")))
    assert fast == {(r.item_id, r.doc_id) for r in brute.collect()}
    assert len(fast) >= 3


def test_snippet_containment_of_all_lengths(spark):
    items = [(1, "one"), (2, "two words"), (3, "of three  words"), (4, "  "), (5, None), (6, "x"), (7, "ab"), (8, "a longer item of several words"), (9, "wor"), (10, "absent words here now")]
    docs = [(1, "here are two words and one"), (2, "xyz ab"), (3, "some of\nthree words"), (4, "take a longer item of several   words, please"), (5, None), (6, ""), (7, "swords and stwo wordsmith")]
    it, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    norm = lambda t: " ".join(t.split())
    want = {(i, j) for i, a in items for j, b in docs if a and norm(a) and b and norm(a) in norm(b)}
    assert {(r.item_id, r.doc_id) for r in C.snippet_containment(it, d).collect()} == want and len(want) > 9


def test_named_lines(spark):
    files = spark.createDataFrame([("a.py", "x = 1\ny  =  2\nz = 3")], "path string, content string")
    exp = [(1, "a.py", "y = 2", [2]), (2, "a.py", "y = 2", [3, 9]), (3, "a.py", "q", [1]), (4, "a.py", "1 y = 2", [1, 2]), (5, "a.py", "z = 3", []), (6, "a.py", " ", [1]), (7, "no.py", "z", [1]), (8, "a.py", "z", None)]
    got = C.named_lines(spark.createDataFrame(exp, "item_id long, path string, snippet string, lines array<int>"), files).collect()
    assert {r.item_id: r.status for r in got} == {1: "ok", 2: "snippet_not_at_lines", 3: "snippet_not_in_file", 4: "ok", 5: "ok", 8: "ok"}


def test_line_cut_and_context(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x")], "doc_id long, text string")
    ranges = spark.createDataFrame([(1, 2, 3), (1, 3, 4), (1, 5, 4), (1, 0, 0), (1, 9, 12)], "doc_id long, first_line int, last_line int")
    assert {r.doc_id: (r.text, r.lines_cut) for r in C.cut_line_ranges(docs, ranges).collect()} == {1: ("a\ne", 3), 2: ("x", 0)}
    f = spark.createDataFrame([(1, 1, [3], None), (2, 1, [], None), (3, 7, [1], "snip"), (4, 7, None, ""), (5, 1, [1, 5], None)], "finding_id long, doc_id long, lines array<int>, snippet string")
    got = {r.finding_id: r.context for r in C.flagged_context(f, docs, around=1, default_lines=2).collect()}
    assert got == {1: "       2 | b\n>>>    3 | c\n       4 | d", 2: "a\nb", 3: "snip", 4: "(file not found)",
                   5: ">>>    1 | a\n       2 | b\n       3 | c\n       4 | d\n>>>    5 | e"}


def test_audits(spark):
    assert [r.marker for r in C.unfinished_markers(spark.createDataFrame([(1, "x todo: fix \nTODO later\nTODOS no\nmastodon")], "doc_id long, text string")).collect()] == ["todo: fix", "TODO later"]
    rows = [(1, "it's", [("a", 1)]), (2, " ", []), (3, None, [("", 2), (None, 3)])]
    got = C.required_fields_audit(spark.createDataFrame(rows, "id long, name string, cells array<struct<name: string, n: int>>"), ["id"], ["name", "cells"], {"cells": ["name"]}).collect()
    assert sorted((r.id, r.field) for r in got) == [(2, "cells"), (2, "name"), (3, "cells[0].name"), (3, "cells[1].name"), (3, "name")]
    hint = C.hint_scan(spark.createDataFrame([(1, "aab")], "doc_id long, text string"), [("h", "a", "it's quoted"), ("g", "z", "x")]).collect()
    assert [(r.hint_id, r.description, r.n_matches) for r in hint] == [("h", "it's quoted", 2)]
    df = spark.createDataFrame([(1, "abc", 5.0), (2, None, None), (3, "q" * 30, -1.0)], "id long, s string, x double")
    bad = C.contract_audit(df, "id", [("it's long", C.within("s", max_length=10)), ("range", C.within("x", 0, 4)), ("needed", C.within("s", required=True)), ("enum", C.within("s", one_of=["abc"]))])
    assert sorted((r.id, r.rule) for r in bad.collect()) == [(1, "range"), (2, "needed"), (3, "enum"), (3, "it's long"), (3, "range")]
    m = C.category_mismatch(spark.createDataFrame([("a", "r/a/x/p.toml"), ("b", "r/a/x/p.toml"), ("c", "p.toml")], "category string, path string")).collect()
    assert [(r.category, r.path_category) for r in m] == [("b", "a"), ("c", None)]
    t = spark.createDataFrame([("e", 3), ("f", 2), ("g", 1)], "error_type string, count long")
    assert C.failure_summary(t, types=2).first().summary == "3 e, 2 f, 1 of 1 other types" and C.failure_summary(t).first().summary == "3 e, 2 f, 1 g"


def test_intent_hints(spark):
    from ferret.functions.vocab import INTENT_HINTS
    code = [(1, 'def buggy_fit(): pass'), (2, '"""A leaky scaler."""\nclass GoodModel: pass'), (3, "wrong_data = 1"), (4, "'''the correct way'''"), (5, "def fit(): pass")]
    got = C.hint_scan(spark.createDataFrame(code, "doc_id long, text string"), INTENT_HINTS).collect()
    assert sorted((r.doc_id, r.description) for r in got) == [
        (1, "Function name hints at bug"), (2, "Class name hints at correctness"), (2, "Docstring hints at bug"), (3, "Variable name hints at bug"), (4, "Docstring hints at correctness")]


def test_more_domains_than_the_limit(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("domain"))
    assert W.balanced_sample(df, "id", "domain", 7).count() == 7


def test_whole_texts_are_used(spark):
    long = "filler " * 20_000 + "needle needle needle needle"
    docs = spark.createDataFrame([(1, long), (2, None), (3, "needle")], "doc_id long, text string")
    rules = spark.createDataFrame([(0, "r00", "needle"), (1, "r01", ""), (2, "r02", "ee")], "rule_no long, pattern_id string, pattern string")
    from ferret.operators import scan as R
    got = {(r.doc_id, r.rule_no): (r.status, r.n_matches, r.detected) for r in R.rule_scan(docs, rules).collect()}
    assert got[1, 0] == ("success", 4, "yes") and got[2, 0] == ("success", 0, "no") and got[3, 2] == ("success", 1, "no") and got[3, 1][1] == 0 and len(got) == 9

    def lengths(pdf, catalogue):
        import pandas as pd
        rows = [(d, c["rule_no"], c["pattern_id"], "timeout" if d == 2 else "success", "no", 0.5, len(t or "")) for d, t in zip(pdf["doc_id"], pdf["text"]) for c in catalogue]
        return pd.DataFrame(rows, columns=["doc_id", "rule_no", "pattern_id", "status", "detected", "confidence", "n_matches"])
    plugged = R.rule_scan(docs, rules, lengths)
    assert {(r.doc_id, r.n_matches) for r in plugged.collect()} == {(1, len(long)), (2, 0), (3, 6)}
    st = {r.doc_id: (r.rules, r.succeeded, r.failed) for r in R.file_status(plugged).collect()}
    assert st == {1: (3, 3, False), 2: (3, 0, True), 3: (3, 3, False)}
    g = {r.doc_id: (r.classification, r.too_large) for r in C.file_gate(docs, ["needle"]).collect()}
    assert g == {1: ("candidate", False), 2: ("skipped", False), 3: ("candidate", False)}
    assert {r.doc_id: r.skip_reason for r in C.file_gate(docs, ["needle"], max_tokens=12000).collect()}[1] == f"too_large_{len(long) // 4}_tokens"
    a = {r.doc_id: (r.status, r.n_chars, r.text) for r in X.abstract_gate(docs).collect()}
    assert a[1] == ("kept", len(long), long) and a[2][0] == a[3][0] == "no_abstract"
    assert "Exchange" not in R.rule_scan(docs, rules)._jdf.queryExecution().executedPlan().toString()  # one pass, no text moves


def test_pattern_counter_against_replace():
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from ferret.functions.patterns import PatternCounter
    words = st.text(alphabet="aabé", max_size=4)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(words, min_size=1, max_size=8), st.lists(st.one_of(st.none(), st.text(alphabet="aabé ", max_size=30)), max_size=6))
    def check(patterns, texts):
        got = PatternCounter(patterns).counts(pa.array(texts, pa.string()))
        assert got.tolist() == [[(t or "").count(p) if p else 0 for p in patterns] for t in texts]
    check()


def test_rescan_works_each_pair_once(spark):
    from ferret.operators import scan as R
    docs = spark.createDataFrame([(1, "needle needle needle needle"), (2, None), (3, "x")], "doc_id long, text string")
    rules = spark.createDataFrame([(0, "r00", "needle"), (1, "r01", "x")], "rule_no long, pattern_id string, pattern string")
    failed = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (12, 3, 1), (13, 9, 0), (14, 2, 1), (15, 1, 7)], "pattern_run_id long, doc_id long, rule_no long")
    got = {r.pattern_run_id: (r.status, r.detected) for r in R.rescan(failed, docs, rules).collect()}
    assert got == {10: ("success", "yes"), 11: ("success", "yes"), 12: ("success", "no"), 14: ("success", "no")}

    def scorer(pdf, catalogue):
        import pandas as pd
        rows = [(d, c["rule_no"], c["pattern_id"], "success", "no", 0.5, 0) for d in pdf["doc_id"] for c in catalogue]
        return pd.DataFrame(rows, columns=["doc_id", "rule_no", "pattern_id", "status", "detected", "confidence", "n_matches"])
    work = docs.join(failed.groupBy("doc_id").agg(F.collect_set("rule_no").alias("wanted")), "doc_id")
    assert sorted((r.doc_id, r.rule_no) for r in R.rule_scan(work, rules, scorer, wanted="wanted").collect()) == [(1, 0), (2, 1), (3, 1)]


def test_confusion_excludes_only_timeouts(spark):
    runs = [(1, "r0", "success", "yes", 0.9), (1, "r1", "api_error", None, None), (2, "r0", "success", "no", 0.5), (2, "r1", "timeout", None, None),
            (3, "r0", "success", "yes", 0.6), (3, "r1", "success", "no", 0.5), (4, "r0", "success", "yes", 0.9), (6, "r0", "success", "yes", 0.9), (7, "r0", "success", "yes", 0.9)]
    labels = [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 0), (5, 1, 1), (6, 0, 1)]
    r = E.confusion_by_label(spark.createDataFrame(runs, "doc_id long, pattern_id string, status string, detected string, confidence double"),
                             spark.createDataFrame(labels, "doc_id long, model int, pre int"), {"pre": ["r0", "r1"]}, model_label="model").first()
    # 1: found; 2: timed out; 3: below the confidence; 4: found, label 0; 5: never scanned; 6: no model; 7: no label
    assert (r.n, r.tp, r.fp, r.fn, r.tn, r.excluded, r.unscanned) == (3, 1, 1, 1, 0, 1, 1)


def test_rule_accuracy_and_variance(spark):
    rows = [(1, "a", "positive", "yes"), (1, "a", "positive", "no"), (1, "a", "negative", "partial"), (1, "a", "negative", "yes"), (1, "a", "context_dependent", "partial"),
            (2, "a", "positive", "yes"), (2, "b", "negative", "no")]
    out = spark.createDataFrame([(*r, "yes", 0.9, 1, 1, False) for r in rows],
                                "run_id long, pattern_id string, test_type string, judge_verdict string, detected string, confidence double, focus_line int, expected_line int, passed boolean")
    per = E.rule_evaluation(out)
    got = {(r.run_id, r.pattern_id): (r.positive_accuracy, r.negative_accuracy, r.context_accuracy, r.overall_accuracy) for r in per.collect()}
    assert got == {(1, "a"): (0.5, 0.5, 1.0, (2 + 0.5 * 2) / 5), (2, "a"): (1.0, 0.0, 1.0, 1.0), (2, "b"): (0.0, 0.0, 1.0, 0.0)}
    v = E.cross_run_variance(per).collect()
    assert [(r.pattern_id, r.runs, round(r.mean, 9), r.unstable) for r in v] == [("a", 2, 0.8, True)]
    o = E.overall_variance(out).first()
    assert (o.num_runs, round(o.overall_mean_accuracy, 9)) == (2, (2 / 5 + 1 / 2) / 2)


def test_report_totals_timing_and_gauges(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    issues = spark.createDataFrame([(1, "error", "a"), (1, "error", "a"), (2, "warning", "b")], "k long, level string, check_name string")
    got = {(r.level, r.check_name): (r.issues, r["items"], r.valid, r.invalid) for r in E.audit_totals(issues, items, "k").collect()}
    assert got == {("error", "a"): (2, 1, None, None), ("warning", "b"): (1, 1, None, None), ("all", "all"): (None, 3, 2, 1)}
    t = spark.createDataFrame([("s", 32, 14.0), ("s", 32, 15.365), ("l", 1001, 43.95)], "f string, lines int, s double")
    summ = E.timing_summary(t, "f", "lines", "s")
    rows = {r.f: r for r in summ.collect()}
    assert (rows["s"].mean_seconds, rows["s"].spread_seconds, rows["l"].spread_seconds) == (14.68, 1.37, None)
    assert E.scaling_verdict(summ, "f", "lines").first().scaling == "Sub-linear"
    assert E.scaling_verdict(summ.where("f = 's'"), "f", "lines").count() == 0
    for m, want in ((300.0, "Super-linear"), (29.0, "Roughly linear")):
        two = spark.createDataFrame([("a", 1, 10.0), ("b", 3, m)], "f string, lines int, s double")
        assert E.scaling_verdict(E.timing_summary(two, "f", "lines", "s"), "f", "lines").first().scaling == want
    g = spark.createDataFrame([(1, 10, 6, 1, 2), (2, 10, 9, 0, 0), (3, 0, 0, 1, 20), (4, 8, 1, 1, 5)], "k long, requests long, errors long, hits long, queries long")
    got = {r.k: (r.error_band, r.hit_band, r.error_bar) for r in E.monitor_gauges(g, "k").collect()}
    assert got[1] == ("yellow", "green", "[" + "█" * 18 + "░" * 12 + "]  60.0%") and got[2][:2] == ("red", None) and got[3] == (None, "dim", None) and got[4][:2] == ("green", "yellow")
    gap = E.generalisation_gap(spark.createDataFrame([("valid", False)] * 85 + [("invalid", False)] * 45 + [("uncertain", False)] * 7 + [("valid", True)] * 40 + [("invalid", True)] * 28
                                                     + [("uncertain", True)] * 6 + [("error", True), (None, False)], "status string, h boolean"), F.col("h")).first()
    assert (round(gap.feedback_precision, 1), round(gap.holdout_precision, 1), round(gap.gap, 1)) == (62.0, 54.1, 8.0)
    s = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 2, 10, 0, 0), (1, dt.datetime(2024, 1, 1), 1, 20, 0, 0), (1, dt.datetime(2024, 1, 1, 0, 0, 10), 3, 40, 5, 10)],
                              "user_id long, ts timestamp_ntz, event_id long, counter long, hits long, queries long")
    r = E.snapshot_deltas(s).first()
    assert (r.requests, r.throughput, r.latency_s, r.hit_rate, r.hits_per_request) == (20, 2.0, 0.5, 0.5, 0.25)


def test_verified_views_agree(spark):
    from ferret.operators import report as R
    from ferret.plans.star import Star
    star = Star(spark, SF_SMALL)
    joined = R.join_verifications(star.findings, star.finding_verifications)
    one = star.judged_findings.withColumns({c: F.when(F.col("v_status").isNotNull(), F.col(c)) for c in ("v_reasoning", "v_model", "v_verified_at")})
    assert one.select(*joined.columns).exceptAll(joined).count() == 0 and joined.count() == one.count()
    plan = R.top_rules(star, verified_only=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    picked = W.diverse_selection(star).join(star.finding_verifications, "finding_id", "left")
    assert picked.where("status is null or status <> 'valid'").count() == 0


def test_remaining_files(spark):
    runs = spark.createDataFrame([(1, "completed"), (2, "running"), (3, "running")], "run_id long, status string")
    files = spark.createDataFrame([(r, f) for r in (1, 2, 3) for f in (10, 11, 12)], "run_id long, file_id long")
    done = spark.createDataFrame([(2, 10), (2, 11), (1, 10)], "run_id long, file_id long")
    assert sorted(map(tuple, U.remaining_files(runs, files, done).collect())) == [(2, 12), (3, 10), (3, 11), (3, 12)]


def test_set_operations_on_runs(spark):
    rows = [(1, 5), (1, 6), (2, 5), (3, 5), (3, 6), (3, None), (2, None)]
    df = spark.createDataFrame(rows, "run_id long, paper_id long")
    assert sorted(map(tuple, U.shared_members(df, "run_id", "paper_id").collect())) == [(1, 2, 5), (1, 3, 5), (1, 3, 6), (2, 3, 5)]
    kept = U.exclude_seen_groups(df, "run_id", "paper_id").collect()
    assert sorted(((r.run_id, r.paper_id) for r in kept), key=str) == sorted([(1, 5), (1, 6), (3, None), (2, None)], key=str)


def test_manifest_paths_and_names(spark):
    papers = spark.createDataFrame([(1, "o__r", "first"), (2, "o__r", "last"), (3, "p__q", None)], "order_no long, repo_name string, title string")
    files = spark.createDataFrame([(1, "o__r"), (2, "p__q"), (3, "none")], "file_id long, repo_name string")
    assert {r.file_id: r.title for r in U.manifest_enrichment(files, papers).collect()} == {1: "last", 2: "", 3: ""}
    known = spark.createDataFrame([(1, "files/a/b.py"), (2, "files/c.py")], "file_id long, file_path string")
    ask = spark.createDataFrame([("files/a/b.py",), ("/x/files/c.py",), ("/files/x/files/a/b.py",), ("c.py",)], "path string")
    got = {r.path: (r.file_id, r.matched_by) for r in U.lookup_paths(ask, known).collect()}
    assert got == {"files/a/b.py": (1, "exact"), "/x/files/c.py": (2, "relative"), "/files/x/files/a/b.py": (1, "relative"), "c.py": (None, "none")}
    names = ["a.py", "a.py", "a_1.py", "a.py", "a_1.py", "b.tar.gz", "b.tar.gz", ".rc", ".rc", "x", "x", "x", "a.b", "b_1.tar.gz", "a_2.py"]

    def one_by_one(names):
        seen, out = set(), []
        for n in names:
            i = n.rfind(".")
            stem, ext = (n[:i], n[i:]) if i > 0 else (n, "")
            new, k = n, 0
            while new in seen:
                k += 1
                new = f"{stem}_{k}{ext}"
            seen.add(new)
            out.append(new)
        return out
    df = spark.createDataFrame([(g, i, n) for g in (1, 2) for i, n in enumerate(names if g == 1 else reversed(names))], "g long, i long, name string")
    for g in (1, 2):
        assert [r.unique_name for r in U.unique_names(df, "g", "name", "i").where(F.col("g") == g).orderBy("i").collect()] == one_by_one(names if g == 1 else names[::-1])


def test_upsert_and_evolve(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (4, "valid", 5)], "k long, v string, t long")
    upd = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (4, "invalid", 5)], "k long, v string, t long")
    assert sorted(tuple(r) for r in U.upsert_latest(cur, upd, "k", "t").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2), (4, "invalid", 5)]
    ev = U.evolve_schema(cur, upd.withColumn("extra", F.lit(1)))
    assert ev.where(F.col("extra").isNull()).count() == 3
    old = spark.createDataFrame([(7, "https://github.com/a/b")], "id long, url string")
    new = spark.createDataFrame([(f"https://github.com/x/{i}",) for i in range(50)] + [("https://github.com/a/b",), (None,)], "url string")
    assert sorted(r.id for r in U.insert_if_absent(old, new, "url", "id").collect()) == list(range(8, 58))


def test_nulls_and_single_values_are_kept(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, None, 4.0)], "id long, g string, x double")
    assert M.safe_normalize(df, "g", "x").count() == 3 and M.stratified_split(df, "id", "g").count() == 3
    enc = M.oof_target_encoding(df, "id", "g", F.col("x") > 1, k=1)
    assert enc.count() == 3 and enc.where("oof_encoding is not null").count() == 0
    assert M.split_class_drift(df, "id", "g").where("g is null").count() > 0
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), i) for i in range(4)], "ts timestamp_ntz, id long")
    assert M.temporal_folds(one, "ts").count() == 0


def test_streaming_matches_batch(spark, tmp_path):
    from ferret.streaming.metrics import counter_rates_stream, run_to_memory, window_counts
    src = str(tmp_path / "events")
    ev = Tables(spark, SF_SMALL).events
    ev.repartition(3, "event_id").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_to_memory(window_counts(stream), "m1_test", mode="complete")
    batch = window_counts(ev)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    samples = W.metric_samples(ev).select("user_id", "ts", "counter")
    sdir = str(tmp_path / "samples")
    samples.orderBy("ts").coalesce(1).write.parquet(sdir)
    s2 = spark.readStream.schema(samples.schema).parquet(sdir)
    rates = run_to_memory(counter_rates_stream(s2), "m2_test")
    ref = W.counter_rates(ev).select("user_id", "ts", "delta")
    diff = rates.select("user_id", "ts", "delta").exceptAll(ref)
    assert diff.count() == 0 and rates.count() == ev.count()


def test_verification_and_share_golden(spark):
    from ferret.operators.report import rate
    df = spark.createDataFrame([(85, 45, 7)], "v long, i long, u long")
    assert round(df.select(rate(F.col("v"), F.col("v") + F.col("i") + F.col("u")).alias("p")).first().p, 1) == 62.0
    rows = [("uncertain",)] * 120 + [("self_contained",)] * 749 + [("fragment",)] * 15
    got = {r.c: round(r.pct, 1) for r in C.share_of_total(spark.createDataFrame(rows, "c string"), "c").collect()}
    assert got == {"uncertain": 13.6, "self_contained": 84.7, "fragment": 1.7}


def test_decode_detections_and_embedded_verdicts(spark):
    raws = ['```json\n{"detected": "yes", "confidence": 0.9, "location": {"name": "f", "location_type": "function", "near_line": 3}}\n```',
            '{"detected": "yes", "confidence": 0.8}', '{"detected": "no", "confidence": 0.1}', '{broken']
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    ok, bad = C.decode_detections(df)
    got = {r.id: (r.detected, r.confidence) for r in ok.collect()}
    assert got == {0: ("yes", 0.9), 1: ("no", 0.5), 2: ("no", 0.1)}
    assert [r.id for r in bad.collect()] == [3]
    flipped = ok.where("id = 1").first().reasoning
    assert flipped.startswith("Originally detected='yes' but could not identify specific location.")
    t = spark.createDataFrame([(1, 'Result: [{"pair_id": 1, "verdict": "Diverse"}, {"pair_id": "2", "verdict": "x"}, {"pair_id": "q", "verdict": "diverse"}] done')],
                              "check_id long, text string")
    exp = spark.createDataFrame([(1, 1), (1, 2)], "check_id long, pair_id int")
    items, missing = C.embedded_verdicts(t, exp)
    assert [(r.pair_id, r.verdict) for r in items.collect()] == [(1, "diverse")]
    assert [r.pair_id for r in missing.collect()] == [2]


def test_name_match(spark):
    df = spark.createDataFrame([("Model.fit", "model.fit"), ("Trainer.run", "run"), ("a.b.load", "x.load"), ("foo", None), ("abc", "xyz"), ("", "x")],
                               "e string, f string")
    got = [(r.m.exact, r.m.partial) for r in df.select(X.name_match("e", "f").alias("m")).collect()]
    assert got == [(True, True), (False, True), (False, True), (False, False), (False, False), (False, False)]


def test_column_helpers(spark):
    from ferret.functions.vocab import ML_IMPORTS
    one = lambda c, *rows: [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(c).collect()]
    text = "import sklearn.svm\nfrom torch import nn\n  import os\nx = 'import no'"
    assert one(X.extract_imports("x"), text) == [["sklearn", "os", "torch"]] and "no" in one(X.extract_imports("x", loose=True), text)[0]
    assert one(X.libraries_used(X.extract_imports("x"), ML_IMPORTS), text) == [["sklearn", "sklearn", "torch"]]
    assert one(X.path_excluded("x", ["setup.py"], ["tests/*.py"]), "a/setup.py", "tests\\x.py", "tests/x.py", "src/tests/x.py") == [True, True, True, False]
    v = spark.createDataFrame([("ICML 2020", None), (None, " "), ("Nature", "Proc. of CVPR")], "c string, p string")
    assert [r[0] for r in v.select(X.venue_excluded("c", "p", ["cvpr", "icml"])).collect()] == [True, False, True]
    loc = spark.createDataFrame([("", "n"), (None, "n"), ("f", "n")], "a string, b string")
    assert [r[0] for r in loc.select(X.coalesce_location("a", F.col("b"))).collect()] == ["n", "n", "f"]
    keep = spark.createDataFrame([("self_contained", None), ("uncertain", None), ("uncertain", "why"), ("fragment", None)], "classification string, skip_reason string")
    assert C.keep_classified(keep).count() == 1 and C.keep_classified(keep, include_uncertain=True).count() == 2
    assert one(X.content_key(F.lit(3), "x"), "https://a.b.org/c?d") == ["3_a_b_org_" + __import__("hashlib").md5(b"https://a.b.org/c?d").hexdigest()[:12]]


def test_file_sources(spark, tmp_path):
    import pytest
    (tmp_path / "papers.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    assert sorted(r.a for r in S.read_json_array(spark, str(tmp_path / "papers.json"), "a int, b string").collect()) == [1, 2]
    with pytest.raises(Exception):
        S.read_json_array(spark, str(tmp_path / "missing.json"), "a int").collect()
    rows = spark.createDataFrame([("o__r", "files/a.py", "a.py", "T, with comma", "bio", "numpy")], S.MANIFEST_SCHEMA)
    S.write_manifest(rows, str(tmp_path / "manifest"))
    assert S.read_manifest(spark, str(tmp_path / "manifest")).collect() == rows.collect()
    code = tmp_path / "code" / "deep"
    code.mkdir(parents=True)
    (code / "a.py").write_bytes(b"x = '\xff\xe9'\ny = 1")
    (code / "b.ipynb").write_text("{}")
    (code / "c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.size) for r in S.scan_corpus(spark, str(tmp_path / "code")).collect()}
    assert got == {"a.py": ("x = ''\ny = 1", 14), "b.ipynb": ("{}", 2)}
    from ferret.operators.scan import load_rule_catalog
    (code / "ok.toml").write_bytes(b'[meta]\nid = "r1"\nname = "n\xff"\ntags = ["t"]\n[detection]\nquestion = "q"')
    (code / "bad.toml").write_text("[meta\n")
    (code / "noid.toml").write_text("[meta]\nname = 'x'")
    rules, bad = load_rule_catalog(spark, str(tmp_path / "code"))
    assert [(r.id, r.name, r.question, list(r.tags)) for r in rules.collect()] == [("r1", "n", "q", ["t"])]
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["bad.toml", "noid.toml"]
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, v string")
    S.write_run_results(runs, str(tmp_path / "runs"))
    S.write_run_results(spark.createDataFrame([(2, "c")], "run_id long, v string"), str(tmp_path / "runs"))
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "bugs.json").write_text(json.dumps([{"scenario": "s", "verified": True, "bugs": [{"pattern_id": "p", "line": 3, "description": "d"}]}, {"scenario": "u", "verified": False, "bugs": []}]))
    assert [(r.scenario, r.pattern_id) for r in S.expected_bugs(spark, str(tmp_path / "bugs.json")).collect()] == [("s", "p")]
    assert S.expected_bugs(spark, str(tmp_path / "bugs.json"), include_unverified=True).count() == 2


def test_metric_log_and_alerts(spark, tmp_path):
    from ferret.streaming import metrics as N
    src = str(tmp_path / "src")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, i), float(i), i, 0, i, 1.5) for i in range(3)], S.METRIC_LOG_SCHEMA).write.parquet(src)
    for _ in range(2):  # a second start finds nothing new
        S.metric_log_sink(spark.readStream.schema(S.METRIC_LOG_SCHEMA).parquet(src), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert S.read_metric_log(spark, str(tmp_path / "log")).count() == 3
    w = spark.createDataFrame([(1, 100, 20, 5.0, 3, 0.05), (2, 5, 5, 9.0, 0, 0.0), (3, 100, 0, 0.1, 0, 0.9)], "window_start long, events long, errors long, mean_latency double, waiting long, hit_rate double")
    got = N.health_alerts(w, max_latency=2.0, max_waiting=2, min_hit_rate=0.1).collect()
    assert sorted((r.window_start, r.alert) for r in got) == [(1, "error_share"), (1, "hit_rate"), (1, "latency"), (1, "waiting")]
    assert [(r.window_start, r.alert) for r in N.health_alerts(w.select("window_start", "events", "errors")).collect()] == [(1, "error_share")]


def test_streams_resume_and_match_batches(spark, tmp_path):
    from ferret.streaming import metrics as N
    ev = Tables(spark, SF_SMALL).events
    src = str(tmp_path / "ev")
    ev.where("event_id % 2 = 0").write.parquet(src)
    stream = lambda: spark.readStream.schema(ev.schema).parquet(src)
    peaks = N.run_to_memory(N.peaks_and_totals(stream()), "peaks", mode="complete")
    assert sorted(map(tuple, peaks.collect())) == sorted(map(tuple, N.peaks_and_totals(ev.where("event_id % 2 = 0")).collect()))
    mean = N.run_to_memory(N.sliding_mean(stream()), "mean", mode="complete")
    rounded = lambda d: sorted((r.window_start, r.events, round(r.mean_value, 6)) for r in d.collect())
    assert rounded(mean) == rounded(N.sliding_mean(ev.where("event_id % 2 = 0")))
    out = str(tmp_path / "out")
    N.incremental_save(stream(), out, "save-test", ["event_id"]).awaitTermination()
    ev.where("event_id % 2 = 1").write.mode("append").parquet(src)
    for _ in range(2):  # a restart goes on where it was; another finds nothing new
        N.incremental_save(stream(), out, "save-test", ["event_id"]).awaitTermination()
    saved = N.read_saved(spark, out, ["event_id"])
    assert saved.count() == ev.count() and spark.read.parquet(out).count() == ev.count()
    # the replay of a batch replaces its rows
    again = spark.createDataFrame(spark.read.parquet(out).where("batch_id = 1").drop("batch_id").collect(), ev.schema)
    again.write.mode("overwrite").parquet(f"{out}/batch_id=1")
    assert N.read_saved(spark, out, ["event_id"]).count() == ev.count()
