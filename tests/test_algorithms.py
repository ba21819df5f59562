"""Nearest neighbours, fuzzy matching, keyed tables and the corrected edge cases."""

import glob
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferret.functions.staging import stage
from ferret.operators import corpus as C
from ferret.operators import evaluation as E
from ferret.operators import maintenance as U
from ferret.operators import matching as M
from ferret.operators import neighbours as N
from ferret.operators.merge import KeyedTable

SF_SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- D17

def brute_neighbours(rows, k):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    out = {}
    for i, v in ok.items():
        best = sorted((-round(float(v @ w), 12), j) for j, w in ok.items() if j != i)[:k]
        out[i] = [j for _, j in best]
    return out


def clustered(n, dim, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block,per_pivot,k", [(1024, 4096, 5), (16, 20, 4), (7, 1, 3)])
def test_neighbours_equal_brute_force(spark, block, per_pivot, k):
    rng = random.Random(2)
    rows = clustered(160, 5, 1) + [(1000 + i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    rows += [(2000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)]  # one very common vector
    rows += [(5000, None), (None, [1.0] * 5), (5001, [0.0] * 5), (5002, [float("nan")] * 5), (5003, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest_neighbours(df, "vec_id", "embedding", k, block, per_pivot).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
        assert r.rank == len(got[r.id])
    assert got == brute_neighbours(rows, k)


def test_neighbours_skip_regions_and_split_crowded_ones(spark):
    """Clustered points ask for few rings, and none holds more than ``block`` points."""
    df = spark.createDataFrame(clustered(600, 8, 3, 0.01), "vec_id long, embedding array<double>")
    points = N.unit_vectors(df, "vec_id", "embedding")
    rings, payload, _ = N.rings_and_pairs(points, 3, 20, 10)
    sizes = [r[0] for r in rings.select(F.octet_length("ids") / 8).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 20 and len(sizes) >= 30
    assert payload.count() < 0.25 * len(sizes) ** 2
    got = N.nearest_points(points, 3, 20, 10)
    assert got.count() == 1800
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_neighbours_ship_each_vector_a_fixed_number_of_times(spark):
    """Random directions: every ring is asked for, by at most ``GROUPS`` groups, not by each of the other rings."""
    rng = np.random.default_rng(5)
    vectors = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(500, 8)))}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>").repartition(3)
    rings, payload, _ = N.rings_and_pairs(points, 3, 8, 100)
    n = rings.count()
    assert n >= 60 and payload.count() <= N.GROUPS * n
    assert {r[0] for r in rings.select("group").distinct().collect()} == set(range(N.GROUPS))
    got = {}
    for r in N.nearest_points(points, 3, 8, 100).collect():
        got.setdefault(r.point, []).append((-r.similarity, r.other))
    assert {i: [o for _, o in sorted(x)] for i, x in got.items()} == brute_neighbours([(i, v.tolist()) for i, v in vectors.items()], 3)


def test_nearest_keeps_ties_by_the_lesser_id():
    """Many equal similarities, met in any order, with a floor that the k-th just reaches."""
    points = np.eye(40)
    for floor in (None, np.zeros(40)):
        best = N.Nearest(np.arange(40), points, 2, floor)
        for part in (slice(20, 40), slice(0, 3), slice(3, 20)):
            best.meet(np.arange(40)[part], points[part])
        assert best.near.tolist() == [[j for j in range(3) if j != i][:2] for i in range(40)]


def test_neighbours_of_few_or_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.id, r.rank, r.neighbour_id, r.similarity) for r in N.nearest_neighbours(df, "vec_id", "embedding", 4).orderBy("id").collect()] == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]
    assert N.nearest_neighbours(df.where("false"), "vec_id", "embedding", 4).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        N.nearest_neighbours(df.unionByName(spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<float>")), "vec_id", "embedding", 4).collect()


# ---------------------------------------------------------------- J16

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_match(asked, names, num=3, den=5):
    best = [(levenshtein(asked, n) / max(len(asked), len(n)), n) for n in names if n and (max(len(asked), len(n)) - levenshtein(asked, n)) * den > max(len(asked), len(n)) * num]
    return min(best)[1] if best else None


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    names = {word(rng.randrange(1, 14)) for _ in range(120)} | {"aaaaaaaa", "abababab", "bolt", "x"}
    asked = {word(rng.randrange(0, 14)) for _ in range(60)} | {"aaaaaaa", "babababa", "", "y"}
    for n in sorted(names)[:60]:
        i = rng.randrange(len(n))
        asked.add(n[:i] + rng.choice("abz") + n[i + rng.randrange(2):])
    q = spark.createDataFrame([(a,) for a in sorted(asked)] * 2 + [(None,)], "asked string")
    t = spark.createDataFrame([(n,) for n in sorted(names)] * 3 + [(None,), ("",)], "name string")
    got = M.fuzzy_best_match(q, "asked", t, "name").collect()
    assert len(got) == len(asked) and {r.asked: r.best for r in got} == {a: brute_match(a, names) for a in asked}
    same = {r.asked: r.similarity for r in got if r.best is not None}
    assert all(math.isclose(s, 1 - levenshtein(a, brute_match(a, names)) / max(len(a), len(brute_match(a, names)))) for a, s in same.items())


def test_fuzzy_match_compares_few_pairs(spark):
    rng = random.Random(8)
    names = sorted({"the common stem " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(300)})
    q = spark.createDataFrame([(n[:20] + "?" + n[21:],) for n in names], "asked string")
    t = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = M.candidate_pairs(q, t, (4, 5)).count()
    assert len(names) <= pairs < 0.05 * len(names) ** 2  # the common stem is no anchor
    assert all(r.best == r.asked[:20] + r.best[20] + r.asked[21:] for r in M.fuzzy_best_match(q, "asked", t, "name", (4, 5)).collect())


# ---------------------------------------------------------------- U3-U5

@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"v{i}", i % 7) for i in range(200)] + [(None, "nobody", 1)]
    df = spark.createDataFrame(rows, "id long, v string, at int")
    return KeyedTable(spark, str(tmp_path / "t"), "id", df.schema, buckets=16).create(df)


def files(t):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{t.path}/bucket=*/*.parquet")}


def test_merge_rewrites_only_touched_buckets(spark, table):
    before = files(table)
    up = spark.createDataFrame([(3, "new", 9), (3, "newest", 11), (3, "older", 1), (4, None, 9), (5, "late", -1), (999, "fresh", 0), (None, "somebody", 5)], "id long, v string, at int")
    assert table.merge(up, recency="at") | {"unchanged": 0} == {"updated": 3, "inserted": 1, "unchanged": 0}
    want = {i: (f"v{i}", i % 7) for i in range(200)} | {3: ("newest", 11), 4: (None, 9), 999: ("fresh", 0), None: ("somebody", 5)}
    read = lambda: {r.id: (r.v, r["at"]) for r in table.read().collect()}
    assert read() == want and table.read().count() == len(want)
    after = files(table)
    same = {f for f in before if after.get(f) == before[f]}
    touched = {r.b for r in up.select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).distinct().collect()}
    assert len({os.path.dirname(f) for f in same}) == 16 - len(touched) >= 8
    table.merge(up, recency="at")
    assert read() == want  # a replay changes nothing
    assert table.merge(up.where("false"), recency="at") == {"updated": 0, "inserted": 0, "unchanged": 0}


def test_merge_replayed_writes_nothing(spark, table):
    """A replay leaves every file alone and says what it met; one new value is written."""
    up = spark.createDataFrame([(3, "new", 9), (4, None, 9), (5, "late", -1), (999, None, None), (None, "somebody", 5)], "id long, v string, at int")
    first, after = table.merge(up, recency="at"), files(table)
    again = table.merge(up, recency="at")
    assert files(table) == after and first["updated"] == 3 and first["inserted"] == 1
    assert (again["updated"], again["inserted"], sum(again.values())) == (4, 0, sum(first.values()))
    table.merge(up.where("id = 3").withColumn("v", F.lit("other")), recency="at")
    now = files(table)
    assert len({os.path.dirname(f) for f in after if now.get(f) != after[f]}) == 1
    assert [r.v for r in table.read().where("id = 3").collect()] == ["other"]


def test_merge_joins_repeated_rows_once(spark, tmp_path):
    """Rows of one key in the table each meet the update; a lone update is inserted once."""
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    t = KeyedTable(spark, str(tmp_path / "r"), "id", df.schema, 4).create(df)
    assert t.merge(spark.createDataFrame([(1, "x"), (3, "y"), (3, "z")], "id long, v string"))["inserted"] == 1
    assert sorted(map(tuple, t.read().collect())) == [(1, "x"), (1, "x"), (2, "c"), (3, "z")]


def test_verifications_read_the_lineitems_once(spark, monkeypatch):
    from ferret.plans import q_maintenance as Q
    staged = []
    monkeypatch.setattr(Q, "stage", lambda df, tag: staged.append((tag, df.inputFiles())) or keep(df, tag))
    keep = stage
    got = Q.q_merged_verifications(spark, SF_SMALL)
    assert [any("lineitem" in f for f in files) for _, files in staged] == [True, False]
    want = Q.q_upsert_verifications(spark, SF_SMALL).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_merge_of_some_columns_and_without_inserts(spark, table):
    up = spark.createDataFrame([(7, "x"), (7, "z"), (7, None), (500, "no")], "id long, v string")
    assert table.merge(up, insert=False)["inserted"] == 0
    assert {r.id: (r.v, r["at"]) for r in table.read().where("id in (7, 8, 500)").collect()} == {7: ("z", 0), 8: ("v8", 1)}


def test_insert_new_keeps_ids(spark, tmp_path):
    df = spark.createDataFrame([("a", 5), ("b", 9)], "url string, n long")
    t = KeyedTable(spark, str(tmp_path / "u"), "url", df.schema, 8).create(df)
    inc = spark.createDataFrame([("c",), ("c",), ("a",), (None,), ("d",)], "url string")
    assert t.insert_new(inc, "n") == 2 and t.insert_new(inc, "n") == 0
    got = {r.url: r.n for r in t.read().collect()}
    assert got["a"] == 5 and got["b"] == 9 and {got["c"], got["d"]} == {10, 11} and len(got) == 4


# ---------------------------------------------------------------- corrected edges

def test_keyed_update_duplicates_and_nulls(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "id long, v string, n int")
    up = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (2, None, None), (None, "z", 7), (9, "q", 1)], "id long, v string, n int")
    got = {r.id: (r.v, r.n, r.updated) for r in U.keyed_update(base, up, ["id"], ["v", "n"], recency="n").collect()}
    assert got == {1: ("x", 5, True), 2: (None, None, True), None: ("z", 7, True)}
    once = U.keyed_update(base, up, ["id"], ["v"]).collect()
    assert len(once) == 3 and {r.id: (r.v, r.n) for r in once} == {1: ("y", 1), 2: (None, 2), None: ("z", 3)}


def test_two_way_difference_with_nulls(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id long") for xs in ([1, None, 2, 2], [None, 2, 3]))
    assert {(r.id, r.side) for r in U.declared_vs_present(a, b, "id").collect()} == {(1, "declared_only"), (3, "present_only")}
    assert {(r.id, r.side) for r in U.declared_vs_present(a, b.where("id is not null"), "id").collect()} == {(1, "declared_only"), (3, "present_only"), (None, "declared_only")}


def test_one_answer_a_path(spark):
    files = spark.createDataFrame([(4, "files/a.py"), (2, "files/a.py"), (3, "files/b.py")], "file_id long, file_path string")
    ask = spark.createDataFrame([("files/a.py",), ("/x/files/a.py",), ("/x/files/a.py",), (None,)], "path string")
    got = sorted(map(tuple, U.lookup_paths(ask, files).collect()), key=str)
    assert got == sorted([("files/a.py", 2, "exact"), ("/x/files/a.py", 2, "relative"), ("/x/files/a.py", 2, "relative"), (None, None, "none")], key=str)


def test_null_names_stay(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a.py", None, "a.py", "a_1.py", None])], "g long, i long, name string")
    assert {r.i: r.unique_name for r in U.unique_names(df, "g", "name", "i").collect()} == {0: "a.py", 1: None, 2: "a_1.py", 3: "a_1_1.py", 4: None}


def test_links_in_any_quotes(spark):
    html = "<a href='http://x'>1</a><a HREF=https://y>2</a><a href = \"\">3</a><a href=rel/z class=q>4</a><a data='href'>5</a>"
    r = C.link_audit(spark.createDataFrame([(1, html), (2, "")], "page_id long, html string"), max_links=3).orderBy("page_id").collect()
    assert (r[0].n_links, r[0].too_many, r[0].blank_links, r[0].non_http_links) == (4, True, 1, 1) and r[1].no_links


def test_failures_are_all_listed(spark):
    b = spark.createDataFrame([(f"e{i:02}", 100 - i) for i in range(30)], "error_type string, count long")
    assert C.failure_summary(b).first().summary == ", ".join(f"{100 - i} e{i:02}" for i in range(30))
    assert C.failure_summary(b, 2).first().summary == f"100 e00, 99 e01, {sum(100 - i for i in range(2, 30))} of 28 other types"


def test_gauges_round_half_to_even(spark):
    df = spark.createDataFrame([(i, n, n - e, 0, 0, e, 0, 0, 250 * n) for i, (e, n) in enumerate([(13, 80), (0, 7), (7, 7), (1, 80), (3, 80), (1, 3), (0, 0)])],
                               "k long, requests long, ok long, truncated long, aborted long, errors long, hits long, queries long, latency_cents long")
    got = {r.k: r for r in E.monitor_gauges(df, "k").collect()}
    ends = [got[i].error_bar and got[i].error_bar[33:] for i in range(7)]
    assert ends == [" 16.2%", "  0.0%", "100.0%", "  1.2%", "  3.8%", " 33.3%", None]
    assert got[0].error_bar[:33] == "[" + "█" * 4 + "░" * 26 + "] "
    assert got[0].history == "67 ok  13 errors  (80 total)" and got[1].history == "7 ok  (7 total)" and got[6].history is None and got[0].mean_latency == 2.5


# ---------------------------------------------------------------- T6

@pytest.mark.parametrize("max_items", [1000, 0])
def test_containment_by_both_ways(spark, max_items):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 4)))
    docs = [(i, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(30)))) for i in range(80)] + [(80, None), (81, ""), (None, "a b a"), (82, "zz q zz"), (82, "zz q zz")]
    flat = lambda t: " ".join(t.split())
    items = [(100 + i, flat(t)[k:k + rng.randrange(1, 25)]) for i, (_, t) in enumerate(docs[:40]) if t for k in [rng.randrange(len(flat(t)) or 1)]]
    items += [(1, " "), (2, None), (3, "zz\tq  zz"), (3, "zz q zz"), (4, "a nowhere b"), (5, "b")]
    i = spark.createDataFrame([(f"i{n}", t) for n, t in items], "item_id string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = C.snippet_containment(i, d, max_items=max_items).collect()
    want = {(f"i{n}", k) for n, t in items if t and flat(t) for k, x in docs if k is not None and x is not None and flat(t) in flat(x)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


# ---------------------------------------------------------------- M2

def test_rate_stream_carries_state_and_replays(spark, tmp_path):
    from ferret.streaming.rates import RateStream
    rng = random.Random(5)
    rows = [(None if i % 11 == 0 else 1 if i % 3 else 2, i // 2, c, rng.randrange(100) if i % 7 else None) for i, c in enumerate(rng.randrange(50) for _ in range(120))]
    rows = [(u, t, c + i, v) for i, (u, t, c, v) in enumerate(rows)]  # no two samples of one time and counter
    frame = lambda part: spark.createDataFrame(part, "user_id long, s long, counter long, cents long").select(
        "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "counter", "cents")
    job = RateStream(spark, str(tmp_path / "r"), "t", history=4, buckets=4)
    job.state.create(spark.createDataFrame([], job.state.schema))
    cuts = [0, 50, 52, 120]
    for n, (a, z) in enumerate(zip(cuts, cuts[1:])):
        job.apply(frame(rows[a:z]), n)
        if n == 1:
            job.apply(frame(rows[a:z]), n)  # a replay after the state was already merged
    want = []
    for u in (None, 1, 2):
        mine = sorted((t, c, v) for x, t, c, v in rows if x == u) if all(v is not None for x, *_, v in rows if x == u) else sorted(((t, c, v) for x, t, c, v in rows if x == u), key=lambda r: r[:2])
        for i, (t, c, v) in enumerate(mine):
            last = mine[i - 1] if i else None
            d = c - last[1] if last else 0
            rate = d / (t - last[0]) if last and t > last[0] else 0.0
            seen = mine[max(0, i - 3):i + 1]
            want.append((u, t, c, d, round(rate, 9), d < 0, round(sum(x or 0 for *_, x in seen) / len(seen) / 100, 9)))
    got = [(r.user_id, r.s, r.counter, r.delta, round(r.rate, 9), r.reset, round(r.mean_value, 9))
           for r in job.rates().withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp"))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    sizes = job.state.read().select(F.size("now.ring")).collect()
    assert len(sizes) == 3 and all(r[0] == 3 for r in sizes)  # of a fixed size
