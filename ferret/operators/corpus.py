"""Corpus curation and audit jobs.

Per-row predicates are built-in expressions (codegen'd); the only Python is the
HTML boilerplate stripper (T7), a small pandas UDF helper inside the page job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.functions.patterns import PatternCounter, text_slices
from ferret.functions.text import contains_any, estimate_tokens, line_count

# ---------------------------------------------------------------- P12/13 ----


def file_gate(docs: DataFrame, keywords: list[str], max_tokens: int | None = None, text: str = "text") -> DataFrame:
    """no_ml_imports_found → skipped, else candidate (sent to the scorer). Size is a flag of its own: with
    ``max_tokens`` (the reference's context window: 12000) larger files are flagged too_large and, as its scorer cannot
    take them, skipped with the reason too_large_{n}_tokens; every file meets the keyword test."""
    tok = estimate_tokens(text)
    big = F.lit(False) if max_tokens is None else F.coalesce(tok > max_tokens, F.lit(False))
    kw = F.coalesce(contains_any(text, keywords), F.lit(False))
    reason = (F.when(big, F.concat(F.lit("too_large_"), tok.cast("string"), F.lit("_tokens")))
              .when(~kw, F.lit("no_ml_imports_found")))
    return docs.select("*", tok.alias("estimated_tokens"), kw.alias("has_keywords"), big.alias("too_large"),
                       F.when(reason.isNull(), "candidate").otherwise("skipped").alias("classification"),
                       reason.alias("skip_reason"))


def keep_classified(df: DataFrame, include_uncertain: bool = False) -> DataFrame:
    """Keep self-contained; with include_uncertain also uncertain rows without a skip reason."""
    cond = F.col("classification") == "self_contained"
    if include_uncertain:
        reason = F.col("skip_reason") if "skip_reason" in df.columns else F.lit(None)
        cond = cond | ((F.col("classification") == "uncertain") & reason.isNull())
    return df.where(cond)


# ------------------------------------------------------------------- T3 ----

def structural_duplicates(docs: DataFrame, group: str = "lang") -> DataFrame:
    """Normalised-text hash groups of size > 1 within a group column."""
    h = F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    return (docs.select(group, "doc_id", h.alias("content_hash"))
            .groupBy(group, "content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"))
            .where(F.col("n") > 1))


# ------------------------------------------------------------------- T4 ----

def hint_scan(docs: DataFrame, hints: list[tuple[str, str, str]], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """T4: one row per (document, hint) with at least one match: an array with one struct per hint, inlined."""
    found = F.array(*[F.struct(F.lit(hid).alias("hint_id"), F.lit(desc).alias("description"),
                               F.size(F.regexp_extract_all(F.col(text), F.lit(rx), 0)).alias("n_matches")) for hid, rx, desc in hints])
    return docs.select(id_col, F.inline(found)).where(F.col("n_matches") > 0)


# ------------------------------------------------------------------- T5 ----

MARKER_RE = r"(?i)TODO[:\s].*"  # fixed value


def unfinished_markers(docs: DataFrame, text: str = "text", id_col: str = "doc_id", marker_re: str = MARKER_RE) -> DataFrame:
    """T5: every unfinished marker with the rest of its line, trimmed."""
    return docs.select(id_col, F.explode(F.regexp_extract_all(F.col(text), F.lit(marker_re), 0)).alias("m")).select(
        id_col, F.regexp_replace("m", r"^\s+|\s+$", "").alias("marker"))


# ------------------------------------------------------------------- T6 ----

def _norm_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _grams(text: Column, n: int = 3) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


MAX_ITEMS, MAX_ITEM_BYTES, SHORT_ITEMS = 100_000, 32 << 20, 256


def snippet_containment(items: DataFrame, docs: DataFrame, max_items: int = MAX_ITEMS, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Distinct (item, document) pairs where the whitespace-normalised item occurs in the document; blank items match nothing,
    rows without a doc_id are left out.

    One plan for all lengths, without comparing all pairs. Each item is found by one anchor: its rarest word that
    stands between two spaces inside the item (so it is a whole word of any document that holds the item). Rarity is
    counted over the documents, map-side, in a first scan. In a second scan the anchors are looked up among the words of each document and what they hit is
    compared there, so that only matches leave a task. Items of at most two words are found by their bytes, all in one pass. The items' words and texts are
    broadcast while they are at most ``max_items`` and ``max_bytes`` (checked); beyond, they are joined (``joined_containment``).
    """
    it = items.select("item_id", _norm_ws(F.col("text")).alias("item_text")).where("item_text <> ''").distinct()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _norm_ws(F.col("text")).alias("doc_text")).where("doc_text is not null and doc_id is not null")
    size = it.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    if size.n > max_items or size.bytes > max_bytes:
        return joined_containment(it, d)
    rows = it.collect()
    inner = [sorted(set(r.item_text.split(" ")[1:-1])) for r in rows]
    words = sorted({w for ws in inner for w in ws})
    shipped = d.sparkSession.sparkContext.broadcast(words)
    counted = d.mapInArrow(_count_words(shipped), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a row a word
    seen = {words[r.word]: r.n for r in counted}
    by_anchor: dict[str, list[tuple[int, str]]] = {}
    for i, (r, ws) in enumerate(zip(rows, inner)):
        held = [(seen[w], w) for w in ws if w in seen]
        if len(held) == len(ws) and held:  # a word that no document holds: neither does any hold the item
            by_anchor.setdefault(min(held)[1], []).append((i, r.item_text))
    short = [(i, r.item_text) for i, (r, ws) in enumerate(zip(rows, inner)) if not ws]
    plan = d.sparkSession.sparkContext.broadcast((sorted(by_anchor), by_anchor, short))
    names = d.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    found = d.mapInArrow(_find_items(plan), "item long, doc_id long")
    return found.join(names, "item").select("item_id", "doc_id").distinct()


def _hits(text: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, number of the word) of the words that the texts hold between spaces or at an end."""
    parts = pc.split_pattern(text, " ")
    at = pc.index_in(parts.flatten(), value_set=words)
    held = at.is_valid().to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(parts).to_numpy()[held].astype(np.int64)
    pair = np.unique(row * max(len(words), 1) + at.fill_null(0).to_numpy()[held])
    return pair // max(len(words), 1), pair % max(len(words), 1)


def _count_words(shipped):
    def run(batches):
        words, n = pa.array(shipped.value, pa.string()), np.zeros(len(shipped.value), np.int64)
        for b in batches:
            for s in text_slices(b):
                n += np.bincount(_hits(s.column(1), words)[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["word", "n"])
    return run


def _find_items(plan):
    def run(batches):
        names, by_anchor, short = plan.value
        words = pa.array(names, pa.string())
        counters = [(short[i:i + SHORT_ITEMS], PatternCounter([t for _, t in short[i:i + SHORT_ITEMS]])) for i in range(0, len(short), SHORT_ITEMS)]
        for b in batches:
            for s in text_slices(b):
                found, texts, ids = [], {}, s.column(0).to_pylist()
                for row, word in zip(*(x.tolist() for x in _hits(s.column(1), words))):
                    if row not in texts:
                        texts[row] = s.column(1)[row].as_py()
                    found += [(item, ids[row]) for item, text in by_anchor[names[word]] if text in texts[row]]
                for part, counter in counters:
                    rows, cols = np.nonzero(counter.counts(s.column(1)))
                    found += [(part[c][0], ids[r]) for r, c in zip(rows.tolist(), cols.tolist())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["item", "doc_id"])
    return run


def joined_containment(it: DataFrame, d: DataFrame) -> DataFrame:
    """``snippet_containment`` for item tables of any size: the anchors go to the distinct words and trigrams of the documents by an
    equi-join. ``it``: item_id, item_text; ``d``: doc_id, doc_text; both normalised."""
    words = F.split("item_text", " ")
    inner = F.when(F.size(words) > 2, F.array_distinct(F.slice(words, 2, F.size(words) - 2)))
    keys = it.select("item_id", "item_text", F.explode(F.coalesce(F.transform(inner, lambda w: F.concat(F.lit("w"), w)), F.transform(_grams(F.col("item_text")), lambda g: F.concat(F.lit("g"), g)))).alias("key"))
    wanted = keys.select("key").distinct()
    by_word = d.select("doc_id", F.explode(F.array_distinct(F.split("doc_text", " "))).alias("k")).select("doc_id", F.concat(F.lit("w"), "k").alias("key"))
    short = keys.where(F.col("key").startswith("g")).select("key").distinct()
    by_gram = d.where(short.select(F.count(F.lit(1)) > 0).scalar())  # no trigrams unless some item needs them
    by_gram = by_gram.select("doc_id", F.explode(F.concat(*[_grams(F.col("doc_text"), n) for n in (1, 2, 3)])).alias("k")).distinct().select("doc_id", F.concat(F.lit("g"), "k").alias("key"))
    held = by_word.unionByName(by_gram).join(wanted, "key", "left_semi")
    count = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    anchor = keys.join(count, "key", "left").groupBy("item_id", "item_text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("a"))
    anchor = anchor.where("a.n > 0").select("item_id", "item_text", F.col("a.key").alias("key"))
    candidates = held.join(anchor, "key").select("doc_id", "item_id", "item_text")
    return candidates.join(d, "doc_id").where(F.col("doc_text").contains(F.col("item_text"))).select("item_id", "doc_id").distinct()


def named_lines(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Is each expected snippet in its file, and at its named lines? ``expected``: item_id, path, snippet, lines;
    ``files``: path, content. Blank snippets and unknown paths are skipped. Status: snippet_not_in_file,
    snippet_not_at_lines or ok; line numbers outside the file are ignored, no numbers means anywhere."""
    j = expected.where(_norm_ws(F.col("snippet")) != "").join(files.select("path", "content"), "path")
    rows = F.split("content", "\r\n|\n|\r", -1)
    named = F.transform(F.filter("lines", lambda n: (n >= 1) & (n <= F.size(rows))), lambda n: F.element_at(rows, n))
    at = _norm_ws(F.array_join(named, " "))
    snippet = _norm_ws(F.col("snippet"))
    status = (F.when(~_norm_ws(F.col("content")).contains(snippet), "snippet_not_in_file")
              .when((F.size(F.coalesce("lines", F.array().cast("array<int>"))) > 0) & ~at.contains(snippet), "snippet_not_at_lines").otherwise("ok"))
    return j.select("item_id", "path", status.alias("status"))


# ------------------------------------------------------------- J17 / J18 ----

def cut_line_ranges(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text without the lines (1-based, ends included) of its ranges, which may overlap; a range outside the
    text or with its ends swapped cuts nothing. Lines are counted at line feeds."""
    r = ranges.groupBy(id_col).agg(F.collect_list(F.struct("first_line", "last_line")).alias("_r"))  # bounded by the document's ranges
    lines = F.split(F.col(text), "\n", -1)
    keep = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))),
                    lambda x: ~F.coalesce(F.exists("_r", lambda c: (c["first_line"] <= x["i"]) & (x["i"] <= c["last_line"])), F.lit(False)))
    cut = F.array_join(F.transform(keep, lambda x: x["x"]), "\n")
    return docs.join(r, id_col, "left").select(id_col, F.when(F.col("_r").isNull(), F.col(text)).otherwise(cut).alias(text),
                                               (F.size(lines) - F.when(F.col("_r").isNull(), F.size(lines)).otherwise(F.size(keep))).alias("lines_cut"))


def flagged_context(findings: DataFrame, docs: DataFrame, around: int = 30, default_lines: int = 50,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines round the flagged ones of each finding: from min − around to max + around, numbered and marked
    with ``>>>``; without flagged lines the first ``default_lines`` of the text as they are; without a text the finding's
    snippet or ``(file not found)``. ``findings``: finding_id, id_col, lines array<int>, snippet."""
    j = findings.join(docs.select(id_col, F.col(text).alias("_text")), id_col, "left")
    rows = F.split("_text", "\n", -1)
    start = F.greatest(F.lit(0), F.array_min("lines") - around - 1)
    end = F.least(F.size(rows), F.array_max("lines") + around)
    part = F.slice(rows, start + 1, F.greatest(end - start, F.lit(0)))
    shown = F.transform(part, lambda x, i: F.concat(F.when(F.array_contains("lines", start + i + 1), ">>>").otherwise("   "), F.lit(" "),
                                                    F.format_string("%4d", start + i + 1), F.lit(" | "), x))
    none = F.size(F.coalesce("lines", F.array().cast("array<int>"))) == 0
    context = (F.when(F.col("_text").isNull(), F.coalesce(F.nullif("snippet", F.lit("")), F.lit("(file not found)")))
               .when(none, F.array_join(F.slice(rows, 1, default_lines), "\n")).otherwise(F.array_join(shown, "\n")))
    return j.select("finding_id", id_col, context.alias("context"))


# ------------------------------------------------------------------ T7/8 ----

NAV_TAGS = {"nav", "footer", "aside", "header"}
# class/id substrings that mark navigation blocks.
NAV_CLASSES = ["navbar", "sidebar", "site-header", "site-footer", "breadcrumb", "toc", "menu", "topnav",
               "header-nav", "footer-nav", "skip-link", "mobile-menu"]
DROP_CONTENT = {"script", "style"}
# Elements without content, which never open anything.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def strip_boilerplate(html: str | None) -> str | None:
    """Text of a page without nav/footer/aside/header, script/style, and elements whose class or
    id contains a navigation word (nesting-aware for the same tag)."""
    if html is None:
        return None
    from html.parser import HTMLParser

    class _P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip_tag, self.depth, self.out = None, 0, []

        def handle_starttag(self, tag, attrs):
            if tag in VOID_TAGS:
                if tag in ("br", "hr") and self.skip_tag is None:
                    self.out.append("\n")
                return
            if self.skip_tag is not None:
                if tag == self.skip_tag:
                    self.depth += 1
                return
            a = dict(attrs)
            marker = ((a.get("class") or "") + " " + (a.get("id") or "")).lower()
            if tag in NAV_TAGS or tag in DROP_CONTENT or any(w in marker for w in NAV_CLASSES):
                self.skip_tag, self.depth = tag, 1

        def handle_endtag(self, tag):
            if self.skip_tag is not None and tag == self.skip_tag:
                self.depth -= 1
                if self.depth == 0:
                    self.skip_tag = None
            elif self.skip_tag is None and tag in ("p", "div", "h1", "h2", "h3", "li", "article", "section", "br"):
                self.out.append("\n")

        def handle_startendtag(self, tag, attrs):
            if tag in VOID_TAGS:
                self.handle_starttag(tag, attrs)

        def handle_data(self, data):
            if self.skip_tag is None:
                self.out.append(data)

    p = _P()
    try:
        p.feed(html)
        p.close()
    except Exception:
        return html
    lines = [ln.strip() for ln in "".join(p.out).split("\n")]
    return "\n".join(ln for ln in lines if ln)


@F.pandas_udf(T.StringType())
def strip_boilerplate_udf(html: pd.Series) -> pd.Series:
    return html.map(strip_boilerplate)


def clean_pages(pages: DataFrame, min_chars: int = 100, keep_ratio: float = 0.9, max_lines: int = 1000) -> DataFrame:
    """Html → cleaned text; status too_short (< min_chars) / cleaned (kept when < keep_ratio of
    the raw length) / unchanged; reduction % and a flag for pages over max_lines."""
    raw_text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
    p = pages.select("page_id", "url", strip_boilerplate_udf(F.col("html")).alias("cleaned"),
                     F.length(F.trim(F.regexp_replace(raw_text, r"\s+", " "))).alias("raw_chars"))
    cl = F.length(F.trim(F.col("cleaned")))
    red = F.when(F.col("raw_chars") > 0, F.lit(100.0) * (F.col("raw_chars") - cl) / F.col("raw_chars")).otherwise(F.lit(0.0))
    status = (F.when(cl < min_chars, "too_short")
              .when(cl < F.col("raw_chars") * keep_ratio, "cleaned").otherwise("unchanged"))
    return p.select("page_id", "url", "cleaned", "raw_chars", cl.alias("clean_chars"), red.alias("reduction_pct"),
                    status.alias("status"), (line_count(F.col("cleaned")) > max_lines).alias("too_many_lines"))


def clean_status_counts(cleaned: DataFrame) -> DataFrame:
    """Pages, characters before and after, and pages over the line limit, by status."""
    return cleaned.groupBy("status").agg(F.count(F.lit(1)).alias("pages"), F.sum("raw_chars").cast("long").alias("raw_chars"),
                                         F.sum("clean_chars").cast("long").alias("clean_chars"), F.count_if("too_many_lines").alias("too_many_lines"))


# ------------------------------------------------------------------ T11 ----

def _blank_member(col: str, field: str):
    return lambda x, i: F.when(x[field].isNull() | (F.trim(x[field].cast("string")) == ""), F.concat(F.lit(f"{col}["), i.cast("string"), F.lit(f"].{field}")))


def required_fields_audit(df: DataFrame, id_cols: list[str], fields: list[str], arrays: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows whose required field is null, blank or an empty array, one row per (record, field). ``arrays`` names the
    required fields of the structs in an array column: ``cells`` → ``cells[2].name`` for the third struct."""
    def missing(f):
        kind = dict(df.dtypes)[f]
        empty = F.size(f) <= 0 if kind.startswith(("array", "map")) else F.trim(F.col(f).cast("string")) == ""
        return F.when(F.coalesce(F.col(f).isNull() | empty, F.lit(True)), F.lit(f))

    out = F.array(*[missing(f) for f in fields]).cast("array<string>")
    for col, inner in (arrays or {}).items():
        for f in inner:
            out = F.concat(out, F.transform(F.coalesce(F.col(col), F.array().cast(df.schema[col].dataType)), _blank_member(col, f)))
    return df.select(*id_cols, F.explode(F.filter(out, lambda x: x.isNotNull())).alias("field"))


# ------------------------------------------------------------------ T12 ----

def min_count_audit(groups: DataFrame, members: DataFrame, key: str, minimum: int = 3) -> DataFrame:
    """Groups with fewer than ``minimum`` members, zero-member groups included (left join)."""
    cnt = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (groups.select(key).distinct().join(cnt, key, "left")
            .select(key, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < minimum))


def category_mismatch(rules: DataFrame, path: str = "path", declared: str = "category") -> DataFrame:
    """Rules whose declared category is not the folder above their own folder (``…/category/rule/file``)."""
    parts = F.split(F.col(path), "/", -1)
    by_path = F.when(F.size(parts) >= 3, F.element_at(parts, -3))
    return rules.select("*", by_path.alias("path_category")).where(~F.col(declared).eqNullSafe(F.col("path_category")))


# ------------------------------------------------------------------ T14 ----

# an attribute value in double quotes, in single quotes, or without quotes
HREF_RE = r"(?i)\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def link_audit(pages: DataFrame, max_links: int = 5) -> DataFrame:
    """Per page: links none / more than max / blank / scheme not http(s) (relative links count)."""
    raw = F.regexp_extract_all(F.col("html"), F.lit(HREF_RE), 1)
    links = F.transform(raw, lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    p = pages.select("page_id", links.alias("links"))
    blank = F.size(F.filter("links", lambda x: F.trim(x) == ""))
    bad = F.size(F.filter("links", lambda x: (F.trim(x) != "") & ~F.lower(x).rlike("^https?://")))
    return p.select("page_id", F.size("links").alias("n_links"), (F.size("links") == 0).alias("no_links"),
                    (F.size("links") > max_links).alias("too_many"), blank.alias("blank_links"),
                    bad.alias("non_http_links"))


# ---------------------------------------------------------------- A18-23 ----

def share_of_total(df: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """Count and % of total per key; empty/null → default when given; zero buckets never appear."""
    k = F.col(key)
    if default is not None:
        k = F.when(k.isNull() | (k == ""), F.lit(default)).otherwise(k)
    g = df.groupBy(k.alias(key)).agg(F.count(F.lit(1)).alias("count"))
    tot = df.select(F.count(F.lit(1))).scalar()
    return g.select(key, "count", (F.lit(100.0) * F.col("count") / tot).alias("pct"))


def filter_funnel(gated: DataFrame) -> DataFrame:
    """Total → under the size limit → has keywords → candidates, as stage rows (one aggregation pass)."""
    g = gated.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(~F.col("too_large")).alias("within_size"), F.count_if(~F.col("has_keywords")).alias("no_keywords"),
                  F.count_if(F.col("classification") == "candidate").alias("candidates"))
    return g.selectExpr("stack(4, 1, 'total', total, 2, 'within_size', within_size, 3, 'no_keywords', no_keywords, "
                        "4, 'candidates', candidates) as (stage_no, stage, files)")


def keyword_frequency(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Documents containing each word and the % of all documents."""
    t = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w))
    ex = docs.select(F.explode(hits).alias("word"))
    n = docs.select(F.count(F.lit(1))).scalar()
    return ex.groupBy("word").agg(F.count(F.lit(1)).alias("files")).select(
        "word", "files", (F.lit(100.0) * F.col("files") / n).alias("pct"))


def error_breakdown(errors: DataFrame, message: str = "message") -> DataFrame:
    """Error type = text before the first ':'; counts per type."""
    return errors.groupBy(F.trim(F.split_part(F.col(message), F.lit(":"), F.lit(1))).alias("error_type")).agg(
        F.count(F.lit(1)).alias("count"))


def failure_summary(breakdown: DataFrame, types: int | None = None) -> DataFrame:
    """One string ``n type, …`` of all types, sorted by count desc then type. With ``types`` only so many of the most
    common, then how many other types and errors there are (error texts are free, so their number is not bounded)."""
    top = breakdown.orderBy(F.col("count").desc(), "error_type").limit(types) if types is not None else breakdown
    s = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), F.col("error_type"), F.col("count"))))
    listed = top.agg(s.alias("s"), F.count(F.lit(1)).alias("t"), F.coalesce(F.sum("count"), F.lit(0)).alias("c"))
    whole = breakdown.select(F.struct(F.count(F.lit(1)).alias("t"), F.coalesce(F.sum("count"), F.lit(0)).alias("c"))).scalar()
    text = F.array_join(F.transform("s", lambda x: F.concat(x["count"].cast("string"), F.lit(" "), x["error_type"])), ", ")
    more_t, more_c = whole.getField("t") - F.col("t"), whole.getField("c") - F.col("c")
    rest = F.when(more_t > 0, F.concat(F.lit(", "), more_c.cast("string"), F.lit(" of "), more_t.cast("string"), F.lit(" other types"))).otherwise(F.lit(""))
    return listed.select(F.concat(text, rest).alias("summary"))


# ------------------------------------------------------------------ P25 ----

def contract_audit(df: DataFrame, id_col: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """P25: evaluate (rule, violated-condition) pairs in one select and keep the violated rules' names."""
    names = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])
    return df.select(id_col, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("rule"))


def within(col: str, lo=None, hi=None, max_length: int | None = None, one_of: list | None = None, required: bool = False) -> Column:
    """P25: violated-condition of one field: number range, longest string or array, allowed values, required."""
    c, bad = F.col(col), F.lit(False)
    if lo is not None:
        bad = bad | (c < lo)
    if hi is not None:
        bad = bad | (c > hi)
    if one_of is not None:
        bad = bad | ~c.isin(*one_of)
    if max_length is not None:
        bad = bad | F.coalesce(F.length(c.cast("string")) > max_length, F.lit(False))
    return (c.isNull() | bad) if required else F.coalesce(bad, F.lit(False))


# ---------------------------------------------------------------- P21/22 ----

DETECTION_SCHEMA = ("detected string, confidence double, reasoning string, "
                    "location struct<name: string, location_type: string, near_line: int>")
# Fixed value: the reasoning of a detection that is turned into "no" for want of a location (detected, first 150
# characters of the original reasoning).
FLIPPED_FORMAT = ("Originally detected='%s' but could not identify specific location. Flipped to 'no' since unlocatable issues are "
                  "not actionable. Original reasoning: %s")
FENCE_RE = r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$"


def decode_detections(responses: DataFrame, raw: str = "raw", last_attempt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Strip code fences, parse JSON (PERMISSIVE); a detection without a location needs a retry,
    and on the last attempt it is flipped to detected='no', confidence 0.5. Returns (decoded, quarantine)."""
    last = last_attempt if last_attempt is not None else F.lit(True)
    body = F.regexp_replace(F.col(raw), FENCE_RE, "")
    p = responses.withColumn("_d", F.from_json(body, DETECTION_SCHEMA, {"mode": "PERMISSIVE"}))
    bad = p.where(F.col("_d").isNull() | F.col("_d.detected").isNull()).drop("_d")
    ok = p.where(F.col("_d.detected").isNotNull())
    missing_loc = F.col("_d.detected").isin("yes", "context-dependent") & F.col("_d.location").isNull()
    flip = missing_loc & last
    out = ok.select("*", F.when(flip, "no").otherwise(F.col("_d.detected")).alias("detected"),
                    F.when(flip, 0.5).otherwise(F.col("_d.confidence")).alias("confidence"),
                    F.when(flip, F.format_string(FLIPPED_FORMAT, F.col("_d.detected"), F.substring(F.coalesce("_d.reasoning", F.lit("")), 1, 150))).otherwise(F.col("_d.reasoning")).alias("reasoning"), F.col("_d.location").alias("location"),
                    (missing_loc & ~last).alias("needs_retry")).drop("_d")
    return out, bad


def embedded_verdicts(df: DataFrame, expected: DataFrame, text: str = "text", id_col: str = "check_id") -> tuple[DataFrame, DataFrame]:
    """The JSON array between the first '[' and the last ']' of free text → items with an integer pair_id and a
    lower-cased verdict in (diverse, redundant); expected pair ids that are missing are reported."""
    arr = F.from_json(F.regexp_extract(F.col(text), r"(?s)\[.*\]", 0), "array<struct<pair_id: string, verdict: string>>")
    items = df.select(id_col, F.explode_outer(arr).alias("it")).select(
        id_col, F.col("it.pair_id").try_cast("int").alias("pair_id"), F.lower(F.trim("it.verdict")).alias("verdict"))
    items = items.where(F.col("pair_id").isNotNull() & F.col("verdict").isin("diverse", "redundant"))
    missing = expected.join(items.select(id_col, "pair_id"), [id_col, "pair_id"], "left_anti")
    return items, missing
