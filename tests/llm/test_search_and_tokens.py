"""Ranked search against plain Python, token counts against the library, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferret.llm import lexical_search as L
from ferret.llm import token_counts as T

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    some = [b for _, b in bags if b]
    n_docs, total = len(some), sum(sum(b.values()) for b in some)
    df = Counter(t for b in some for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            n = sum(b.values())
            score = 0
            for t in terms(text):
                if t in b:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_term_hashes_follow_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ9é中 ._-\x7f\n\U0001f600") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None, "Ab-ab AB"]
    h, ptr = L.term_hashes(pa.array(texts, pa.string()))
    names = {}
    for t, a, b in zip(texts, ptr[:-1], ptr[1:]):
        want = terms(t)
        assert len(want) == b - a
        for w, x in zip(want, h[a:b].tolist()):
            assert names.setdefault(x, w) == w
    assert len(set(names.values())) == len(names)


def test_search_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, L.op11_lexical_search(spark, SF).collect()), key=str) == ranked(docs, items)


@pytest.mark.parametrize("block,width", [(512, 1024), (2, 8)])
def test_search_edges(spark, monkeypatch, block, width):
    monkeypatch.setattr(L, "WIDTH", width)
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(80)]
    docs += [(5, "a b c"), (None, "a b c"), (None, None), (200, None), (201, ""), (202, " .,"), (203, "zz " * 30_000), (-4, "A B C"), (300, "a b c"), (300, "a b c")]
    docs += [(400 + i, "hh gg ff") for i in range(30)]
    items = [(1, "a b c"), (1, "hh gg"), (2, None), (3, ""), (4, "nothere nothere2"), (None, "zz a a a"), (6, "hh gg ff " * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    got = L.rank_documents(d.repartition(5), q, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)
    assert L.rank_documents(d.where("false"), q).collect() == [] == L.rank_documents(d, q.where("false")).collect()


def test_bounds_hold_and_spare_documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(600)]
    b = L.Block(pa.array(texts))
    n_docs, total = len(texts), int(b.n.sum())
    df = Counter(b.term.tolist())
    query = [Counter(L.term_hashes(pa.array([" ".join(texts[i].split()[:12])]))[0].tolist()) for i in range(5)]
    items = L.Items(query, dict(df), n_docs, total)
    best = [L.Best(10) for _ in query]
    scored = L.search_block(b, np.arange(len(texts)), items, best)
    assert scored < 0.5 * len(texts) * len(query)  # most documents are never rescored
    assert all(x.id[0] == i for i, x in enumerate(best))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    raw, special = T.read_vocabulary(T.default_path())
    return T.Counter(raw, T.code_point_classes(raw), special)


def count(vocabulary, texts):
    t = T.Pretokens(texts, vocabulary.classes, vocabulary.special)
    return t.per_text(vocabulary.lengths(t)).tolist()


def test_tokens_of_random_strings(vocabulary, library):
    rng = random.Random(1)
    common = list("aZé中'’ 1٣!.\n\t\r 　\x85 stmdrevl'  \x00̀​😀½²ªʰ") + ["<|endoftext|>", "<|endof", "'s", "'ve", " '", "'LL", "don't", "  'll"]
    rare = [chr(rng.randrange(0x20, 0xd800)) for _ in range(300)] + [chr(rng.randrange(0xe000, 0x110000)) for _ in range(100)]
    for _ in range(60):
        texts = ["".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randrange(60))) for _ in range(40)]
        assert count(vocabulary, texts) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_every_code_point_is_classed_as_the_library_does(vocabulary, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for before in ("x", "1", " "):
        texts = ["".join(f"\n{before}{c}" for c in every[i:i + 5000]) for i in range(0, len(every), 5000)]
        assert count(vocabulary, texts) == [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_long_texts_in_pieces(vocabulary, library, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word", "  ", " ", "\n", "'s", "!", "9", " ", "x" * 70]) for _ in range(200)) for _ in range(20)] + ["a" * 500, " " * 500]
    assert any(len(T.pieces(t, [])) > 3 for t in texts)
    assert count(vocabulary, texts) == [len(library.encode(x, add_special_tokens=False).ids) for x in texts]


def test_table_and_summaries():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(1, 1 << 63, 40_000).astype(np.uint64))
    n = rng.integers(1, 60, len(h))
    table = T.build_table(h, n)
    kept = min(len(h), T.TABLE_WORDS)
    assert (T.probe(table, h[:kept]) == n[:kept]).all() and (T.probe(table, h[kept:]) == 0).all()
    # Misra-Gries: what is frequent stays
    have = T.NOTHING
    for _ in range(30):
        some = np.concatenate([np.arange(1, 11), rng.integers(100, 1 << 40, 50)]).astype(np.uint64)
        u, c = np.unique(some, return_counts=True)
        have = T.trim(*T.merge([have, (u, c, np.ones(len(u), np.int64))]), 40)
    assert set(range(1, 11)) <= set(have[0].tolist())


@pytest.mark.parametrize("frequent", [True, False])
def test_tokens_edges(spark, library, frequent):
    rows = [(1, "hello world"), (1, "hello world"), (None, "x"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a" * 3000 + " b" * 40_000), (6, "é 中\U0001f600")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_tokens", F.lit("clash")).withColumn("h", F.lit(1))
    got = T.count_tokens(df.repartition(3), frequent=frequent)
    assert got.columns == ["doc_id", "text", "h", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((i, len((t or "").encode()), k := len(library.encode(t or "", add_special_tokens=False).ids), k > 512) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == want
    assert T.count_tokens(df.where("false"), frequent=frequent).collect() == []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_tokens_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.op12_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), n := len(library.encode(r.text, add_special_tokens=False).ids), n > 512) for r in docs}
