"""Operators that SQL cannot express, recomputed in plain Python on whole small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferret.llm import fingerprints, language_id, mixing, quality_classifier as Q
from ferret.llm.common import spans_hash
from tests.llm.test_results import brute_chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---------------------------------------------------------------- 7

def plain_buckets(text):
    out = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t\n\x0b\x0c\r]+", (text or "").encode()):
        w = m.group()
        if len(re.findall(rb"[A-Z]", w)) >= 2 and not re.search(rb"[a-z]", w):
            out.append(min(len(w) // 4, Q.CAPS - 1))
        else:
            low = np.frombuffer(w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w), np.uint8)
            out.append(int(spans_hash(low, np.array([0]), np.array([len(low)]))[0] % np.uint64(Q.VOCAB - Q.CAPS)) + Q.CAPS)
    return out


def test_classifier_pooling_and_scores(spark, texts):
    """Tokens, word vectors, pooling and the network's scores, recomputed one document at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    buckets = {i: plain_buckets(t) for i, t in texts.items()}
    at, sign = Q.index_vectors()
    total = defaultdict(lambda: np.zeros(Q.DIM))
    for b in buckets.values():
        for x, y in zip(b, b[1:]):
            for a, c in ((x, y), (y, x)):
                for k in range(Q.NONZERO):
                    total[a][at[c, k]] += sign[c, k]
    table = Q.word_vectors(docs)
    for b in range(Q.VOCAB):
        want = total[b] / np.linalg.norm(total[b]) if b in total and total[b].any() else np.zeros(Q.DIM)
        assert np.allclose(table[b], want, atol=1e-6)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = Q.fit(docs, labels, table, 12_000)
    got = {r.doc_id: r for r in Q.op7_quality_classifier(spark, SF).collect()}
    for i, b in buckets.items():
        count = Counter(b)
        n, kinds = max(len(b), 1), max(len(count), 1)
        x = np.concatenate([sum((c * table[k].astype(float) for k, c in count.items()), np.zeros(Q.DIM)) / n, sum((table[k].astype(float) for k in count), np.zeros(Q.DIM)) / kinds,
                            [math.log1p(len(b)), len(count) / n]])
        hidden = np.tanh(((x - net.mean) / net.scale) @ net.p[0] + net.p[1])
        score = 1 / (1 + math.exp(-(hidden @ net.p[2] + net.p[3][0]) / net.temperature))
        assert got[i].score == pytest.approx(score, abs=1e-4) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == (got[i].score >= 0.7)


def test_classifier_does_not_see_what_it_may_not(spark):
    """Labels of the held-out fold, lang, source and ids change no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda d, x: {r.doc_id: round(r.score, 9) for r in Q.score_quality(d, d, x).collect()}
    assert score(docs.repartition(5), flipped) == score(docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("y")), labels)


def test_classifier_with_repeated_ids_agrees_on_reruns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") % 40).alias("doc_id"), "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = lambda d: sorted((r.doc_id, round(r.score, 9)) for r in Q.score_quality(d, docs.repartition(7), labels, max_labelled=30).collect())
    assert score(docs) == score(docs.repartition(3))


# ---------------------------------------------------------------- 8

def test_language_fusion(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    langs = sorted({r.lang for r in docs if r.lang is not None})
    n = len(langs)

    def grams(text):
        d = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
        return [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 18 for a, b, c in zip(d, d[1:], d[2:])]
    counts = {v: np.zeros(language_id.BUCKETS) for v in langs}
    for r in docs:
        if r.lang is not None and r.text is not None:
            np.add.at(counts[r.lang], grams(r.text), 1)
    logp = {v: np.log((c + 0.5) / (c + 0.5).sum()) for v, c in counts.items()}
    soft = lambda x: (lambda e: e / e.sum())(np.exp(np.array(x) - max(x)))
    seen = []
    for r in pages:
        text = language_id.main_text(r.html)
        ll = [language_id.TEMPER * sum(logp[v][g] for g in grams(text)) for v in langs]
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", r.url or "")
        host = (m.group(1) if m else "").lower()
        path = re.search(r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", r.url or "")
        tld = re.search(r"\.([a-z]+)$", host)
        declared = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", r.html or "")
        domain = re.search(r"([^.]+\.[^.]+)$", host)
        q = [math.floor(p * 1e6 + 0.5) for p in soft(ll)]
        seen.append((r.page_id, ll, q, host, domain.group(1) if domain else "", declared.group(1).lower() if declared else "",
                     "/" + path.group(1).lower() if path else "." + (tld.group(1) if tld else "")))
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(5)]
    for _, _, q, host, domain, declared, suffix in seen:
        for s, k in zip(sums, ("all", (host, domain), domain, declared, suffix)):
            s[k] += q
    got = {r.page_id: r for r in language_id.op8_language_id(spark, SF).collect()}
    assert len(got) == len(seen)
    for page, ll, q, host, domain, declared, suffix in seen:
        own = [s[k] for s, k in zip(sums, ("all", (host, domain), domain, declared, suffix))]
        total = [max(0.0, s.sum() / 1e6 - 1) for s in own]
        post = []
        for i in range(n):
            less = [max(0.0, (s[i] - q[i]) / 1e6) for s in own]
            base = (less[0] + 1 / n) / (total[0] + 1)
            dom = (less[2] + 2 * base) / (total[2] + 2)
            prior = (less[1] + 2 * dom) / (total[1] + 2)
            dec = (less[3] + 2 * (total[3] + 1) / (total[0] + 1)) / (less[0] + 2)
            suf = (less[4] + 2 * (total[4] + 1) / (total[0] + 1)) / (less[0] + 2)
            post.append(ll[i] + math.log(prior) + math.log(dec) + math.log(suf))
        p = soft(post)
        assert got[page].lang == langs[int(np.argmax(p))] and got[page].text_lang == langs[int(np.argmax(ll))]
        assert got[page].probability == pytest.approx(p.max(), abs=1e-5)


# ---------------------------------------------------------------- 9

def test_fingerprints_of_the_whole_table(spark, texts):
    """Chunks, likeness to the edited text and to the next document, for every document."""
    got = {r.doc_id: r for r in fingerprints.op9_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    chunks = {}

    def cut(t):
        if t not in chunks:
            chunks[t] = set(brute_chunks(t.encode()))
        return chunks[t]
    weight = lambda s: sum(map(len, s))
    like = lambda a, b: weight(a & b) / min(weight(a), weight(b)) if a and b else float(a == b)
    whole = 0
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], texts[nxt]
        q = len(t) // 4
        edited = t[:len(t) - q] + n[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if max(len(t), len(n)) < 6000:
            whole += 1
            assert got[i].near_edited == pytest.approx(like(cut(t), cut(edited))) and got[i].near_next == pytest.approx(like(cut(t), cut(n)))
    assert whole > 100


# ---------------------------------------------------------------- 2

def cheapest_flow(capacity, quota, layers):
    """Least (unrouted words, cost) over all ways to send whole words."""
    pats, best = list(capacity), None
    ways = []
    for p in pats:
        members = [s for s in quota if s in p]
        ways.append([dict(zip(members, w)) for w in itertools.product(range(layers * capacity[p] + 1), repeat=len(members)) if sum(w) <= layers * capacity[p]])
    for choice in itertools.product(*ways):
        sent = Counter()
        for c in choice:
            sent.update(c)
        if any(sent[s] > quota[s] for s in quota):
            continue
        cost = 0
        for p, c in zip(pats, choice):
            words, k = sum(c.values()), 0
            while words > 0:
                cost += min(words, capacity[p]) * (k + 1) ** 2
                words, k = words - capacity[p], k + 1
        key = (-sum(sent.values()), cost)
        if best is None or key < best:
            best = key
    return best


def test_flow_against_every_flow():
    rng = random.Random(4)
    for _ in range(25):
        pats = rng.sample([("a",), ("b",), ("a", "b"), ("b", "c")], rng.randrange(1, 4))
        capacity = {p: rng.randrange(1, 3) for p in pats}
        quota = {s: rng.randrange(0, 5) for s in sorted({s for p in pats for s in p})}
        flow = mixing.route(capacity, quota, 2)
        sent, cost = 0, 0
        for p, f in flow.items():
            words, k = sum(f.values()), 0
            sent += words
            while words > 0:
                cost += min(words, capacity[p]) * (k + 1) ** 2
                words, k = words - capacity[p], k + 1
        assert (-sent, cost) == cheapest_flow(capacity, quota, 2)
        got = Counter()
        for p, f in flow.items():
            assert set(f) <= set(p) and sum(f.values()) <= 2 * capacity[p]
            got.update(f)
        assert all(got[s] <= quota[s] for s in got)


def test_mix_of_the_whole_table(spark, texts):
    """Sizes, targets and what the mix takes, recomputed from the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    of = Counter()
    for i, s in source.items():
        of[s] += size[i]
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, names, float(sum(of.values()))
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > 3 * of[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / share for s in open_}
            break
        target |= {s: 3.0 * of[s] for s in over}
        left -= sum(3 * of[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    rows = mixing.op2_mixing(spark, SF).collect()
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == of[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs)
    for s in names:
        assert abs(taken[s] - target[s]) <= max([z for i, z in size.items() if source[i] == s])


