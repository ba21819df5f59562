"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ferret.llm import queries as Q
from ferret.llm.fingerprints import fingerprint_documents
from ferret.llm.html_text import extract_html
from ferret.llm.jaccard_join import near_duplicates
from ferret.llm.language_id import identify
from ferret.llm.line_dedup import dedup_lines
from ferret.llm.mixing import mix_sources
from ferret.llm.quality_classifier import score_quality
from ferret.llm.quality_rules import quality_rules
from ferret.llm.sentencepieces import decode_documents, encode_documents
from ferret.llm.substring_dedup import dedup_substrings

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
PAGE = "page_id long, url string, html string"


def rows():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["the", "of", "héd", "ara", "no,", "x."]) + str(rng.randrange(40)) for _ in range(n))
    long, copy = text(30_000) + "\n" + text(5), text(60)
    out = [(1, copy, "en", "a"), (2, copy, "en", "b"), (2, copy, "en", "b"), (3, None, None, None), (4, "", "fr", ""), (None, copy, "fr", "a"),
           (None, None, None, None), (5, long, "de", None), (6, " \t\n ", "de", "b"), (7, "one", "de", "b"), (7, "other text", "de", "a"), (8, "x" * 50_000, "en", "a"),
           (9, "a a a a " * 30, "en", "c"), (10, "é中\U0001f600 ▁z\r\n\x0b y", "zh", "c"), (11, "Bad $$$ " * 60, "en", "a")]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), DOC)
    for c in ("doc", "th", "ids", "score", "size", "bucket", "sigs", "near", "gone", "words", "h", "first", "sources", "order", "n", "kept", "repeats", "digest", "spans"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (11, 0, 0), (9, 0, None), (2, 1, 0), (2, 1, 0), (None, 1, 0), (5, None, None), (99, 0, 1)], LABEL).withColumn("x", F.lit(1))


@pytest.fixture(scope="module")
def pages(spark):
    html = "<html lang=en><body><article><p>" + "word, " * 3000 + "</p></article></body></html>"
    return spark.createDataFrame([(1, "http://a.example.org/en/1", html), (1, "http://a.example.org/en/1", html), (None, None, None), (2, "no url", ""), (3, None, "<div" * 500),
                                  (4, "https://u@b.example.com:80?x", "<p>" * 20_000 + "deep"), (5, "", "<html lang='xx'>\x00&#0;&bogus;")], PAGE).withColumn("host", F.lit("clash"))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_jaccard(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 3, 90, 100).collect()), key=str)
    by = {}
    for i, n, c in got:
        by.setdefault(i, []).append((n, c))
    assert by[1][0][1] == 1 and {c for _, c in by[2]} == {1} and len(by[2]) == 2
    assert sorted(by[None], key=str) == [(0, None), (58, 1)]  # a null id joins its copies
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[6] == [(0, 6)] and by[8] == [(1, 8)]
    assert sorted(by[7]) == [(1, 7), (1, 7)] and len(got) == len(rows())
    assert near_duplicates(empty(spark, DOC)).count() == 0


def test_mixing(spark, docs):
    mixed, targets = mix_sources(docs)
    got = mixed.collect()
    assert len(got) == len(rows()) and all(r.taken <= 3 * r["size"] for r in got)
    t = {r.source: r for r in targets.collect()}
    assert set(t) == {None, "", "a", "b", "c"} and t[""].target == 0
    assert sorted((str(r.doc_id), r["size"], r.repeats) for r in got) == sorted((str(r.doc_id), r["size"], r.repeats) for r in mix_sources(docs.repartition(5))[0].collect())
    assert mix_sources(empty(spark, DOC))[0].count() == 0


def test_quality(spark, docs, labels):
    stats, _ = quality_rules(docs, labels)
    assert stats.count() == len(rows()) and stats.where("n_words = 0 and not base_failed").count() == 0
    assert quality_rules(docs, empty(spark, LABEL))[1] == []
    assert quality_rules(empty(spark, DOC), labels)[0].count() == 0
    scored = score_quality(docs, docs, labels)
    assert scored.count() == len(rows()) and scored.where("score is null or score < 0 or score > 1").count() == 0 and "bucket" in scored.columns
    assert {r.score for r in score_quality(docs, docs, empty(spark, LABEL)).collect()} == {0.5}
    assert score_quality(empty(spark, DOC), empty(spark, DOC), labels).count() == 0


def test_sentencepiece(spark, docs):
    both = decode_documents(encode_documents(docs)).select("text", "ids", "decoded").collect()
    assert len(both) == len(rows())
    for r in both:
        assert (r.text is None) == (r.ids is None) == (r.decoded is None)
        assert r.text is None or r.decoded == r.text.replace("▁", " ")
    assert decode_documents(encode_documents(empty(spark, DOC))).count() == 0


def test_substrings_and_lines(spark, docs):
    got = {}
    for r in dedup_substrings(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == [(60, 0)] and got[2] == [(60, 60)] * 2 and got[None].count((60, 60)) == 1
    assert got[3] == [(0, 0)] and got[8] == [(1, 0)] and sorted(got[7]) == [(1, 0), (2, 0)]
    assert dedup_substrings(empty(spark, DOC)).count() == 0
    lines = dedup_lines(docs)
    assert lines.columns == docs.columns + ["n_lines", "n_removed", "n_near"] and lines.count() == len(rows())
    by = {r.doc_id: r for r in lines.where("doc_id <> 7").collect()}
    assert by[1].text == rows()[0][1] and by[2].text == "" and by[3].text is None and by[6].text == " \t\n "
    assert dedup_lines(empty(spark, DOC)).count() == 0


def test_fingerprints(spark, docs):
    got = fingerprint_documents(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    one = fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint_documents(empty(spark, DOC)).count() == 0


def test_pages(spark, docs, pages):
    got = extract_html(pages).collect()
    assert len(got) == 7 and [r.text for r in got if r.page_id is None] == [""] and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 4} == {"deep"}
    assert extract_html(empty(spark, PAGE)).count() == 0
    known = identify(docs, pages).collect()
    assert len(known) == 7 and all(r.lang for r in known)
    assert {r.lang for r in identify(empty(spark, DOC), pages).collect()} == {None}
    assert identify(docs, empty(spark, PAGE)).count() == 0


def test_pipeline_edges(spark, docs, labels, pages, tmp_path):
    for d, table in (("some", docs), ("none", empty(spark, DOC))):
        table.write.parquet(f"{tmp_path}/{d}/documents.parquet")
        labels.where("quality = 1").write.parquet(f"{tmp_path}/{d}/labels.parquet")  # one class: all are kept
        out = P.run(spark, f"{tmp_path}/{d}")
        assert {"ids", "n_tokens"} <= set(out.columns)
        n = out.count()
        assert n > 0 if d == "some" else n == 0
    cur = docs
    for name, step in P.STAGES[1:3]:
        cur = step(spark, cur, f"{tmp_path}/some")
        assert cur.columns == docs.columns, name


def test_pipeline_without_a_model(spark, docs, labels, tmp_path):
    for name, table in (("none", empty(spark, LABEL)), ("bad", labels.where("quality = 0"))):
        table.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert P.STAGES[0][1](spark, docs, f"{tmp_path}/{name}").count() == len(rows()), name


def test_registered():
    assert [int(k[2:].split("_")[0]) for k in Q.QUERIES] == list(range(1, 14)) and set(Q.ORACLES) <= set(Q.QUERIES)
