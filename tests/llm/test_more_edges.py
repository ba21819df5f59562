"""Edges that were found wrong or untested before: prose in articles, rows without ids, names that clash, reruns."""

import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferret.llm import common, fingerprints, jaccard_join
from ferret.llm.html_text import main_text
from ferret.llm.line_dedup import dedup_lines

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_prose_inside_an_article_stays():
    p = "<p>" + "This is a long paragraph of prose, with commas, about the topic at hand and nothing else. " * 2 + "</p>"
    page = lambda h: main_text("<html><body><nav><ul><li><a href=x>Home</a></ul></nav>" + h + "<footer>foot</footer></body></html>")
    text = page(f"<article><h1>T</h1>{p}<section class='search'><h2>Search</h2>{p}{p}</section>{p}</article>")
    assert "Search" in text and text.count("topic at hand") == 8
    text = page(f"<article>{p}<div class='tools'>{p}{p}</div><div class='search'><p>Find it</p></div><p class='meta'>By A. Writer</p><p>where <math><mi>x</mi></math> is</p></article>")
    assert "By A. Writer" in text and "where x is" in text and "Find it" not in text and text.count("topic at hand") == 6
    refs = "<ul><li><a href=1>Ref one</a><li><a href=2>Ref two</a></ul>"
    assert page(f"<div class='content'>{p}{p}{refs}</div>").endswith("Ref one\n\nRef two") and "Ref" not in page(f"<div id=wrap>{p}{p}{refs}</div>")
    assert "Subscribe" not in page(f"<article>{p}<div class='newsletter'><p>Subscribe to it. {'Now, please. ' * 30}</p></div></article>")


def test_line_dedup_keeps_columns_of_other_names(spark):
    df = spark.createDataFrame([(1, "a b c\na b c", 5, 6)], "doc_id long, text string, N_Lines int, n_near int")
    assert dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_removed", "n_near"]
    r = dedup_lines(df, prefix="__").first()
    assert (r.N_Lines, r.n_near, r.__n_lines if hasattr(r, "__n_lines") else r["__n_lines"], r["__n_removed"], r.text) == (5, 6, 2, 1, "a b c")
    out = P.line_dedup(spark, spark.createDataFrame([(1, "x y z", "en", "a", 5)], DOC).withColumn("n_removed", F.lit(7)), "")
    assert out.first().n_removed == 7


def test_regions_cut_by_rare_shingles_keep_every_link(spark):
    """Sets that share rare shingles but are of too different sizes, or share them only far back, fall apart; linked sets never do."""
    rng = np.random.default_rng(4)
    common_part = rng.integers(1 << 62, size=6).astype(np.uint64)
    sets = [np.unique(np.concatenate([common_part, rng.integers(1 << 62, size=int(40 * 1.6 ** (i % 6))).astype(np.uint64)])) for i in range(30)]
    for i in range(60):  # chains of near copies
        s = rng.permutation(sets[rng.integers(len(sets))])
        sets.append(np.unique(np.concatenate([s[:len(s) - int(rng.integers(0, len(s) // 5))], rng.integers(1 << 62, size=int(rng.integers(0, len(s) // 8))).astype(np.uint64)])))
    names = [jaccard_join.digest(s) for s in sets]
    rows = [(7, d, len(s), 1, s.tobytes(), True, -1) for d, s in dict(zip(names, sets)).items()]
    big = spark.createDataFrame(rows, "region long, digest binary, n long, copies long, set binary, core boolean, side int")
    part = {bytes(r.digest): r.region for r in jaccard_join._by_rare_shingles(big, 80, 100).collect()}
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both) and names[i] != names[j]:
                linked += 1
                assert part[names[i]] == part[names[j]]
    assert linked > 40
    short, long_, near = range(1, 7), [*range(1, 7), *range(1000, 1040)], [*range(1000, 1040), *range(5000, 5003)]
    short, long_, near = (np.array(s, np.uint64) for s in (short, long_, near))  # the short one's shingles are the long one's rarest
    rows = [(7, jaccard_join.digest(s), len(s), 1, s.tobytes(), True, -1) for s in (short, long_, near)]
    got = jaccard_join._by_rare_shingles(spark.createDataFrame(rows, big.schema), 80, 100).collect()
    assert {bytes(r.digest) for r in got} == {jaccard_join.digest(long_), jaccard_join.digest(near)} and len({r.region for r in got}) == 1


POINTS = "region long, digest binary, n long, copies long, set binary, core boolean, side int"


def _points(sets, regions):
    return [(r, jaccard_join.digest(s), len(s), 1, s.tobytes(), True, -1) for s, r in zip(sets, regions)]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_points_that_share_too_little_go(spark, monkeypatch, chunk):
    """The points that stay are those with enough shingles that others of their own region hold, however rows are sliced."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng, bound = np.random.default_rng(6), 1 << 62
    passages = [rng.integers(bound, size=20).astype(np.uint64) for _ in range(6)]
    sets = [np.array([5], np.uint64)]
    for i in range(80):
        own = rng.integers(bound, size=int(rng.integers(1, 30))).astype(np.uint64)
        sets.append(np.unique(np.concatenate([passages[i % 6], passages[i % 5][: i % 12], [np.uint64(5)], own])))
    regions = [7 if i % 3 else -8 for i in range(len(sets))]
    want = set()
    for s, r in zip(sets, regions):
        others = {x for t, q in zip(sets, regions) if q == r and t is not s for x in t.tolist()}
        if 100 * sum(x in others for x in s.tolist()) >= 80 * len(s):
            want.add(jaccard_join.digest(s))
    big = spark.createDataFrame(_points(sets, regions), POINTS).repartition(5)
    got = [bytes(r.digest) for r in jaccard_join._sharing(big, 80, 100).collect()]
    assert sorted(got) == sorted(want) and 10 < len(want) < 70


def test_large_regions_lose_unlinked_points_before_they_are_split(spark, monkeypatch):
    """Texts that share passages, more than the table of counts can tell apart: none is split or copied, and links stay."""
    monkeypatch.setattr(jaccard_join, "COUNTS", 2)
    monkeypatch.setattr(jaccard_join, "NAMES", 0)  # as if names were many: sets are dealt out a part at a time
    monkeypatch.setattr(jaccard_join, "_split", lambda *_: pytest.fail("a region was split"))
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = words(120), {}
    for i in range(40):
        texts[i] = " ".join(passage + words(60))
    for i in range(4):
        copy = texts[i].split()
        copy[rng.randrange(len(copy))] = "other"
        texts[100 + i] = " ".join(copy)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.near_duplicates(frame, 5, 80, 100, max_members=8).collect()}
    assert got == {i: (i % 100, int(i % 100 < 4)) for i in texts}


@pytest.mark.parametrize("blocks", [2, 5, 9])
def test_blocks_meet_a_part_at_a_time(spark, blocks):
    """Every pair of points meets once in all parts together, and no part copies a point more than PASSES times."""
    sets = [np.arange(i * 10, i * 10 + 3).astype(np.uint64) for i in range(30)]
    stuck, numbers = spark.createDataFrame(_points(sets, [3] * 30), POINTS), spark.createDataFrame([(3, blocks)], "region long, blocks int")
    met, P = Counter(), jaccard_join.PASSES
    for begin in range(0, blocks, P):
        rows = jaccard_join._blocks(stuck, numbers, begin, begin + P).collect()
        assert max(Counter(bytes(r.digest) for r in rows).values()) <= P
        for region in {r.region for r in rows}:
            here = [r for r in rows if r.region == region]
            met.update(frozenset((bytes(a.digest), bytes(b.digest))) for i, a in enumerate(here) for b in here[:i] if a.side != b.side or a.side == -1)
    assert len(met) == 30 * 29 // 2 and set(met.values()) == {1}


def test_near_duplicates_without_ids_go_too(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    near, other = text + " end", " ".join(f"v{rng.randrange(500)}" for _ in range(120))
    rows = [(1, text), (None, text), (None, near), (None, other), (None, other), (None, None), (2, other + " x"), (3, "alone"), (3, "alone too")]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC)
    got = sorted((tuple(r)[:2] for r in P.jaccard_join(spark, df, "").collect()), key=str)
    assert got[0] == (1, text) and (2, other + " x") in got and sum(i == 3 for i, _ in got) == 1
    assert not any(i is None and t in (text, near, other) for i, t in got) and (None, None) in got
    alone = spark.createDataFrame([(None, t, "en", "a", 1) for t in (text, text, near, other)], DOC)
    assert sorted(r.text for r in P.jaccard_join(spark, alone, "").collect()) in ([other, text], [other, near], sorted([text, other]), sorted([near, other]))


def test_fingerprints_of_many_rows_without_id(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(30))
    rows = [(None if i % 3 == 0 else i, text()) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    src = common.keyed(df, F.col("doc_id").cast("long").alias("doc_id")).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = {r.part: r["count"] for r in fingerprints._parted(src).groupBy("part").count().collect()}
    assert max(parts.values()) < 4 * np.median(list(parts.values()))  # a third of the rows without an id is dealt out
    # in order: every document's next one is the next in (doc, text hash)
    order = src.orderBy("doc", "th", "text").select("doc_id", "text").collect()
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_documents(df).collect()}
    import hashlib
    want = set()
    for r, n in zip(order, order[1:] + order[:1]):
        k = len(r.text) // 4
        want.add((r.doc_id, len(r.text), hashlib.sha256((r.text[:len(r.text) - k] + n.text[:k]).encode()).hexdigest()))
    assert got == want


def test_scratch_drops_what_is_not_kept(spark):
    import os
    with common.scratch() as staged:
        a, b = common.stage(spark.range(3), "a"), common.stage(spark.range(4), "b")
        staged.remove(b)
    path = lambda d: d._staged_at.removeprefix("file://")
    assert not os.path.exists(path(a)) and os.path.exists(path(b)) and b.count() == 4


def test_lean_session(spark):
    batch, clean = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(batch), spark.conf.get(clean)
    try:
        common.lean_session(spark)
        assert spark.conf.get(batch).rstrip("b") == str(common.BATCH_BYTES) and spark.conf.get(clean) == "true"
        df = spark.range(100).repartition(3, "id").groupBy((F.col("id") % 5).alias("k")).count()
        assert df.count() == 5 == len(df.collect()) == df.count()  # a frame that runs again shuffles again
        spark.conf.set(batch, "1000000")
        common.lean_session(spark)
        assert spark.conf.get(batch).rstrip("b") == "1000000"
    finally:
        spark.conf.set(batch, kept[0])
        spark.conf.set(clean, kept[1])
