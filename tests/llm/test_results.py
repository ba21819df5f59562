"""Results of the operators against brute force, SQL, exact round trips and held-out labels."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ferret.llm import components, fingerprints, jaccard_join, line_dedup, mixing, quality_classifier, quality_rules, sentencepieces, substring_dedup
from ferret.llm.common import Text, slices
from ferret.llm.html_text import main_text
from ferret.llm.language_id import op8_language_id

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def brute_groups(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
                    links[a] += 1
                    links[b] += 1
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


@pytest.mark.parametrize("k,num,members", [(3, 90, 4096), (5, 80, 4096), (3, 40, 4)])
def test_jaccard_join(spark, docs, texts, k, num, members):
    # near copies at every distance, beside the table's own
    rng, more = random.Random(1), dict(texts)
    base = WORD.findall(texts[0])[:150]
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        more[10_000 + i] = " ".join(w)
    frame = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(frame, k, num, 100, max_members=members).collect()}
    assert got == brute_groups(more, k, num, 100)


def test_jaccard_join_of_long_texts(spark, monkeypatch):
    """Regions over max_shingles that windows cannot shrink: long near copies, and unrelated texts that share a passage."""
    rng, split, rounds = random.Random(3), jaccard_join._split, []

    def counted(*args):
        rounds.append(1)
        assert len(rounds) <= 4, "regions are split again and again"
        return split(*args)

    monkeypatch.setattr(jaccard_join, "_split", counted)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    copy, passage, texts = words(400), words(300), {}
    for i in range(14):
        near = list(copy)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = f"x{i}"
        texts[i] = " ".join(near)
        texts[100 + i] = " ".join(passage + words(100))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(frame, 5, 80, 100, max_members=8, max_shingles=800).collect()}
    assert rounds and got == brute_groups(texts, 5, 80, 100)


def test_jaccard_join_of_repeated_rows(spark):
    w = [f"w{i}" for i in range(60)]
    near, other = " ".join(w), " ".join(w[:-1])
    alone = [(None, f"{i} " * 30) for i in range(20)]
    frame = spark.createDataFrame([(1, near), (1, near), (1, "another text"), (2, other), (None, other), (None, other), *alone], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(frame, 3, 90, 100).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 4), (1, 1, 4), (1, 1, 0), (2, 1, 4), (None, 1, 4), (None, 1, 4), *[(None, None, 0)] * 20], key=str)


def test_join_region_recursion():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(60) < 0.97], rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)])) for b in base for _ in range(40)]
    near = jaccard_join.near_pairs(sets, 80, 100)
    whole, weight = jaccard_join._labels(near), rng.integers(1, 5, len(sets))
    for leaf in (8, 16, 100, 1000):
        root, links = jaccard_join.join_region(sets, 80, 100, weight, leaf=leaf)
        assert (root == whole).all() and (links == near @ weight - weight).all()
    assert len(set(whole.tolist())) < 60
    side = np.arange(len(sets)) % 2
    assert (jaccard_join.join_region(sets, 80, 100, weight, side=side, leaf=16)[1] == (near & (side[:, None] != side)) @ weight).all()


def test_signatures_meet():
    rng, met = np.random.default_rng(5), 0
    for n, num in [(n, num) for n in (1, 2, 4, 5, 9, 10, 18, 19, 40, 150, 900) for num in (90, 80, 50)]:
        sig = jaccard_join.Signatures(num, 100)
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            most = n * (100 - num) // 150 + 1
            b = a[rng.permutation(len(a))[:len(a) - int(rng.integers(0, most + 1))]]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 64, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
            i = len(np.intersect1d(a, b))
            if len(b) and jaccard_join.linked(i, len(a), len(b), num, 100):
                met += 1
                assert set(sig.of(a).tolist()) & set(sig.of(b).tolist()), (n, num, len(a), len(b), i)
    assert met > 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200}


def test_mixing_targets_and_flow(spark, docs):
    out = mixing.op2_mixing(spark, SF)
    rows = out.collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    names = sorted(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, left, open_ = {}, float(sum(size.values())), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            want.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            want[s] = 3 * size[s]
        left -= sum(want[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    longest = max(r.size for r in rows)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], longest / 2) for s in names)
    again = mixing.op2_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_flow_is_cheapest():
    # the shared pattern must go to b; a then repeats its own least
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 100, "b": 110}, 3)
    assert flow == {("a",): {"a": 100}, ("a", "b"): {"b": 100}, ("b",): {"b": 10}}
    flow = mixing.route({("a",): 10}, {"a": 25}, 3)
    assert flow == {("a",): {"a": 25}}


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["b", "a"] if i % 4 else ["a"]) for i in range(400)]
    mixed, targets = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 1))
    got = {tuple(r.sources): r.t for r in mixed.groupBy("sources").agg(F.sum("taken").alias("t")).collect()}
    assert got == {("a",): 1000, ("a", "b"): 3000} and {r.source: r.target for r in targets.collect()} == {"a": 2000.0, "b": 2000.0}


def brute_statistics(t):
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    tri = defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i:i + 3])].append(i)
    hit = {i + k for v in tri.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.op3_quality_rules(spark, SF).collect()}
    for i, t in texts.items():
        r, want = got[i], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed and r.rule is None)


def test_rules_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.95)
    rules = quality_rules.learn_list(x, bad)
    hit = np.any([quality_rules.covers(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98 and (hit & ~bad).sum() <= 5


def test_rules_hold_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    test = quality_rules.quality_rules(docs, train)[0].join(labels.join(train, "doc_id", "left_anti"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in test) >= 0.95 * len(test)


def test_classifier_hold_out(spark):
    d = "/root/testdata/sf0.01"
    out = quality_classifier.op7_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    assert len(bad) > 5 and sum(r.predicted == r.quality for r in out) >= 0.93 * len(out)
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95


def brute_viterbi(word, voc):
    best = [(0, None)] + [(None, None)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = word[i:j]
            s = voc.score.get(p, (voc.unknown if j - i == 1 else None, -1))
            if s[0] is not None and (best[j][0] is None or best[i][0] + s[0] > best[j][0]):
                best[j] = (best[i][0] + s[0], (i, s[1]))
    out, j = [], len(word)
    while j:
        i, p = best[j][1]
        out = ([p] if p >= 0 else [voc.byte_id[b] for b in word[i:j].encode()]) + out
        j = i
    return out


def test_viterbi_against_brute_force(texts):
    import sentencepiece
    voc = sentencepieces.Vocabulary(sentencepieces.DEFAULT_VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.DEFAULT_VOCABULARY)
    words = sorted({w for t in list(texts.values())[:40] for w in sentencepieces._WORDS.findall("▁" + t.replace(" ", "▁"))} | {"▁▁▁x", "▁\U0001f600é", "▁", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "});\r"})
    for w, ids in zip(words, sentencepieces.encode_sorted(words, voc)):
        assert ids == brute_viterbi(w, voc), w
    encoder = sentencepieces.Encoder(voc)
    some = ["  two  spaces \n\tand tab ", "", None, *list(texts.values())[:20]]
    flat, ptr = encoder.encode(some)
    for t, a, b in zip(some, ptr[:-1], ptr[1:]):
        assert flat[a:b].tolist() == [i for w in sentencepieces._WORDS.findall("▁" + t.replace(" ", "▁")) for i in brute_viterbi(w, voc)] if t else a == b
        if t:
            assert model.decode(flat[a:b].tolist()) == t


def test_round_trip(spark, texts):
    got = sentencepieces.op4_sentencepiece(spark, SF).collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_queries_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for query, sql in ((jaccard_join.op1_jaccard_join, jaccard_join.OP1_SQL), (substring_dedup.op5_substring_dedup, substring_dedup.OP5_SQL), (line_dedup.op6_line_dedup, line_dedup.OP6_SQL)):
        got, want = query(spark, SF), con.sql(sql)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_substring_dedup_of_many_overlapping_repeats(spark):
    rng = random.Random(3)
    passages = [" ".join(f"{rng.choice('abc')}{rng.randrange(9)}" for _ in range(n)) for n in (19, 20, 21, 35, 80)]
    made = {i: " ".join(rng.choice(passages)[rng.randrange(4):] if rng.random() < 0.7 else "z " * rng.randrange(30) for _ in range(6)) for i in range(60)}
    frame = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    seen, want = set(), {}
    for i, t in made.items():
        w = WORD.findall(t)
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            gone |= set(range(p, p + 20)) if k in seen else set()
            seen.add(k)
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(frame).collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup_of_repeated_rows(spark, parts):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(30)
    made = [(i, " ".join([text(40), passage, text(25)] if i % 2 else [text(70)])) for i in range(8)]
    rows = made * 3 + [(None, made[0][1])] * 2 + [(None, own := text(50))] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = [(i, t if i == 1 or i % 2 == 0 else " ".join(t.split()[:40] + t.split()[70:])) for i, t in made] * 3 + [(None, "")] * 2 + [(None, own)] * 2
    assert sorted(((r.doc_id, r.text) for r in substring_dedup.dedup_substrings(frame).collect()), key=str) == sorted(want, key=str)


def test_lines_one_edit_apart(spark):
    w = [f"w{i}" for i in range(14)]
    line = lambda x: " ".join(x)
    made = [(1, line(w)), (2, line(w[:3] + ["other"] + w[4:])), (3, line(w[:7] + w[8:])), (4, line(w + ["end"])), (5, line(["a", "b"] + w[2:])),
            (6, line(w[:5])), (7, line(w[:4] + ["x"])), (8, "\n" + line(w) + "\n\nnew line\n"), (9, line(["first", *w])), (10, line([w[1], w[0], *w[2:]]))]
    got = {r.doc_id: (r.text, r.n_removed, r.n_near) for r in line_dedup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert [i for i in got if got[i][2]] and sorted(i for i in got if got[i][2]) == [2, 3, 4, 9]
    assert got[8] == ("\n\nnew line\n", 1, 0) and got[5][1] == got[10][1] == got[7][1] == 0
    assert line_dedup.within_one([1, 2, 3], [1, 3]) and not line_dedup.within_one([1, 2, 3], [3, 2, 1]) and line_dedup.within_one([1], [])


def brute_chunks(raw):
    gear, out, s = fingerprints._GEAR.tolist(), [], 0
    while s < len(raw):
        h, cut = 0, len(raw)
        for i in range(s, len(raw)):
            h = (h << 1) + gear[raw[i]] & 0xFFFFFFFF
            window = 0
            for k, b in enumerate(reversed(raw[max(s, i - 15):i + 1])):
                window += gear[b] << k
            n, window = i + 1 - s, window & 0xFFFFFFFF
            if len(raw) - s > fingerprints.MIN and (fingerprints.MIN <= n < fingerprints.NORMAL and window < 1 << 25 or n >= fingerprints.NORMAL and window < 1 << 28 or n == fingerprints.MAX):
                cut = i + 1
                break
        out.append(raw[s:cut])
        s = cut
    return out


def test_fingerprints_against_brute_force(spark, texts):
    rows = fingerprints.op9_fingerprints(spark, SF)
    got = {r.doc_id: r for r in rows.collect()}
    ids = sorted(texts)
    for i, nxt in list(zip(ids, ids[1:] + ids[:1]))[:25]:
        t, n = texts[i], texts[nxt]
        q = len(t) // 4
        edited = t[:len(t) - q] + n[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) < 4000:
            one, two = set(brute_chunks(t.encode())), set(brute_chunks(edited.encode()))
            assert sorted(int(x[12:], 16) for x in got[i].fingerprint.split()) == sorted(map(len, one))
            weight = lambda s: sum(map(len, s))
            assert got[i].near_edited == pytest.approx(weight(one & two) / min(weight(one), weight(two)))
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert sorted(map(tuple, fingerprints.fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet").repartition(9)).collect())) == sorted(map(tuple, rows.collect()))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page has-sidebar">
<header id="top"><h1>Site</h1><nav><ul><li><a href="/">Home</a><li><a href="/n">News, all of it</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, and other things, so that you may read this page.</p></div>
<div id="wrap"><div class="%s"><h2>Head &amp; line</h2><p>First   paragraph, with commas,\n and enough <b>text</b> to count.<script>x="</p>"</script></p>
<div class="ad"><p>Buy now, buy here, buy all the things that we have to sell today.</p></div>
<p>Second one <a href="#">with a link</a>, which is long enough, too, I would say.<blockquote>Quoted &lt;words&gt;</blockquote><ul><li>item one<li>item two</ul>
<form><p>Sign up, please, with your address, and more of it.</p><input></form><p>Last.</p></div>
<aside><p>Related, and also related, and this is related as well, to it.</p></aside></div>
<section id="comments"><article class="comment"><p>Great text, thank you, dear author, for writing it so well!</p></article></section>
<footer><p>Imprint, address, phone, and all that is in a footer, of course.</p></footer></body></html>"""


@pytest.mark.parametrize("css", ["content", "post-body", "x1"])
def test_main_text(css):
    assert main_text(PAGE % css) == ("Head & line\n\nFirst paragraph, with commas, and enough text to count.\n\nSecond one with a link, which is long enough, too, I would say."
                                     "\n\nQuoted <words>\n\nitem one\n\nitem two\n\nLast.")


FIRST, SECOND = ("The first paragraph of the article, with commas, and enough text to count as one.", "The second one, which is long enough, too, to be a paragraph of its own.")


@pytest.mark.parametrize("page", [
    "<html><body class='showing-comments'><div>%s</div></body></html>", "<html><body class='comments-open'><main class='ad'>%s</main></body></html>", "<body style='display:none'><div>%s</div>",
    "<body><article class='post ad-free'>%s</article></body>", "<body><article class='comments-open'>%s</article></body>", "<body><div class='post-content share-enabled'>%s</div></body>",
    "<body><div class='layout-sidebar-x'><article>%s</article></div></body>", "<body><div class='content-sidebar-wrap'><main>%s</main></div></body>", "<body><div class='x-ad-y'>%s</div></body>", "<body><div class='post notice'><h1></h1>%s</div></body>",
    "<html><head><title>T</title><meta charset=utf-8><body><div>%s</div></body></html>", "<html><head><title>T</title><body class=x><div>%s</div></body></html>",
    "<html><head><title>T</title><div>%s</div></html>", "<html><head><title>T</title><style>p{}</style><script>x</script>%s"])
def test_whole_pages_stay(page):
    assert main_text(page % f"<p>{FIRST}</p><p>{SECOND}</p>") == f"{FIRST}\n\n{SECOND}"


def test_slug_ids_and_comments():
    page = (f"<body><article><h2 id='social-impact'>Social impact</h2><p>{FIRST}</p><h2 id='search'>Search</h2><section id='search-and-rescue'><p>{SECOND}</p></section>"
            f"<div id='share-buttons'>Share it</div><div class='x-share-y'>Send it</div></article><div id='comments'><p>{FIRST}</p></div><div class='comments-area'><article class='comment-body'><p>{FIRST * 9}</p></article></div></body>")
    assert main_text(page) == f"Social impact\n\n{FIRST}\n\nSearch\n\n{SECOND}"


def test_table_pages():
    import html
    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        inner = re.search("<article>(.*?)</article>", page, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert main_text(page) == "\n\n".join(x for x in parts if x)


def test_languages(spark):
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == 50 and all(r.lang == r.declared for r in rows) and sum(r.text_lang == r.declared for r in rows) >= 49


def test_slices_and_words():
    col = pa.array(["a b", None, "", " x\ty\n", "no", "sep"])
    t = Text(col)
    assert [[t.data[a:b].tobytes() for a, b in zip(t.starts[i:j], t.ends[i:j])] for i, j in zip(t.wptr[:-1], t.wptr[1:])] == [[b"a", b"b"], [], [], [b"x", b"y"], [b"no"], [b"sep"]]
    batch = pa.record_batch({"text": ["x" * n for n in (5, 50, 1, 1, 200, 3)]})
    assert [s.num_rows for s in slices(batch, "text", 60)] == [4, 1, 1]


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input: what it keeps, by another way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.stage(P.STAGES[0][1](spark, docs, SF), "t")
    scores = {r.doc_id: r.predicted for r in quality_classifier.op7_quality_classifier(spark, SF).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p}
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    want = {r[0]: r[1] for r in con.sql(line_dedup.OP6_SQL).select("doc_id, kept_sha256").fetchall()}
    lost = {r[0] for r in con.sql(line_dedup.OP6_SQL).filter("n_lines > 0 and n_removed = n_lines").fetchall()}
    lines = P.stage(P.STAGES[1][1](spark, kept, SF), "t")
    rows = lines.collect()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows} == {i: h for i, h in want.items() if i not in lost} and all(r.n_chars == len(r.text) for r in rows)
    near = P.stage(P.STAGES[2][1](spark, lines, SF), "t")
    groups = brute_groups({r.doc_id: r.text for r in rows}, 5, 80, 100)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c, _) in groups.items() if c == i}
    mixed = P.stage(P.STAGES[3][1](spark, near, SF), "t")
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    repeats, _ = mixing.mix_sources(near.withColumn("doc_id", F.xxhash64("doc_id", "text")))
    assert sorted(times.values()) == sorted(r.repeats for r in repeats.where("repeats > 0").collect()) and max(times.values()) <= 3
    final = P.STAGES[4][1](spark, mixed, SF)
    assert mixed.columns == docs.columns and sentencepieces.decode_documents(final).where("decoded <> text").count() == 0 and final.count() == sum(times.values())
