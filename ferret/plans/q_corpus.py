"""Registered corpus curation, audit and scan queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferret.functions import text as X
from ferret.functions.vocab import DEMO_DOMAINS, DEMO_HINTS, DEMO_KEYWORDS
from ferret.operators import corpus as C
from ferret.operators import evaluation as E
from ferret.operators import scan as S
from ferret.plans.catalog import register
from ferret.plans.star import Star
from ferret.plans.star_sql import with_star
from ferret.sources.tables import Tables

HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)"


def _lit_list(ws):
    return " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in ws)


@register("normalized_urls", "P1 P2 T9", f"""
WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '') AS u2 FROM pages),
v AS (SELECT *, CASE WHEN starts_with(u2, 'git://github.com') THEN replace(u2, 'git://', 'https://') ELSE u2 END AS u3 FROM u),
w AS (SELECT *, string_split(regexp_replace(url, '/+$', ''), '/') AS parts FROM v)
SELECT page_id, url,
       CASE WHEN starts_with(u3, 'git@github.com:') THEN replace(u3, 'git@github.com:', 'https://github.com/') ELSE u3 END AS normalized_url,
       CASE WHEN len(parts) >= 2 THEN parts[len(parts) - 1] || '__' || parts[len(parts)] ELSE parts[len(parts)] END AS slug,
       CAST(page_id AS VARCHAR) || '_' || replace(regexp_extract(url, '{HOST_RE}', 1), '.', '_') || '_' || substr(md5(url), 1, 12) AS content_key
FROM w""")
def q_normalized_urls(spark, d):
    p = Tables(spark, d).pages.select("page_id", "url")
    host = F.regexp_replace(F.regexp_extract("url", HOST_RE, 1), r"\.", "_")
    key = F.concat_ws("_", F.col("page_id").cast("string"), host, F.substring(F.md5("url"), 1, 12))
    return p.select("page_id", "url", X.normalize_github_url("url").alias("normalized_url"),
                    X.repo_slug("url").alias("slug"), key.alias("content_key"))


def _domain_case():
    arms = " ".join(f"WHEN {_lit_list(ws)} THEN '{dom}'" for dom, ws in DEMO_DOMAINS.items())
    return f"CASE WHEN text IS NULL OR length(text) = 0 THEN NULL ELSE CASE {arms} END END"


@register("domain_classification", "P3 P4", f"""
SELECT doc_id, {_domain_case()} AS domain, ({_lit_list(['license', 'token'])}) AS excluded FROM documents""")
def q_domain_classification(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", X.classify_domain("text", DEMO_DOMAINS).alias("domain"),
                       X.contains_any("text", ["license", "token"]).alias("excluded"))


@register("size_band", "P7", """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       strlen(text) BETWEEN 500 AND 500000 AND len(string_split(text, chr(10))) >= 20 AS in_band
FROM documents""")
def q_size_band(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), X.line_count("text").alias("n_lines"),
                       X.size_band("text").alias("in_band"))


_GATE = f"""
SELECT doc_id, length(text) // 4 AS estimated_tokens, coalesce({_lit_list(DEMO_KEYWORDS)}, false) AS has_keywords, length(text) // 4 > 12000 AS too_large
FROM documents"""


@register("file_gate", "P10 P11 P12", f"""
WITH g AS ({_GATE}),
p AS (SELECT *, 500 + estimated_tokens + 200 AS base FROM g)
SELECT doc_id, estimated_tokens, has_keywords, CASE WHEN has_keywords THEN 'candidate' ELSE 'skipped' END AS classification,
       CASE WHEN NOT has_keywords THEN 'no_ml_imports_found' END AS skip_reason, base + CAST(floor(base * 0.1) AS BIGINT) AS total_tokens,
       base + CAST(floor(base * 0.1) AS BIGINT) <= 15600 AS fits
FROM p""")
def q_file_gate(spark, d):
    docs = Tables(spark, d).documents
    g = C.file_gate(docs, DEMO_KEYWORDS)
    fit = X.prompt_fits(F.lit(500).cast("long"), F.col("text"))
    return g.select("doc_id", "estimated_tokens", "has_keywords", "classification", "skip_reason",
                    fit.getField("total_tokens").alias("total_tokens"), fit.getField("fits").alias("fits"))


@register("filter_funnel", "A19 P12", f"""
WITH g AS ({_GATE})
SELECT unnest([1, 2, 3, 4]) AS stage_no, unnest(['total', 'within_size', 'no_keywords', 'candidates']) AS stage,
       unnest([count(*), count(*) FILTER (NOT too_large), count(*) FILTER (NOT has_keywords), count(*) FILTER (has_keywords AND NOT too_large)]) AS files FROM g""")
def q_filter_funnel(spark, d):
    return C.filter_funnel(C.file_gate(Tables(spark, d).documents, DEMO_KEYWORDS, max_tokens=12000))


_PATTERNS = ["files/1*.py", "*/7*"]
_BASENAMES = ["1.py", "2.py", "3.py"]


@register("path_exclusion", "P6", with_star("""
SELECT file_id, file_path,
       string_split(file_path, '/')[-1] IN ('1.py', '2.py', '3.py') OR regexp_matches(file_path, '^(files[/\\\\]1.*.py|.*[/\\\\]7.*)') AS excluded
FROM files"""))
def q_path_exclusion(spark, d):
    f = Star(spark, d).files
    return f.select("file_id", "file_path", X.path_excluded("file_path", _BASENAMES, _PATTERNS).alias("excluded"))


@register("rule_selection", "P14", with_star("""
SELECT f.finding_id, f.run_id, f.pattern_id FROM findings f
WHERE EXISTS (SELECT 1 FROM rules r WHERE r.pattern_id = f.pattern_id AND r.severity IN ('critical', 'high') AND r.category IN ('ai-training', 'scientific-numerical'))"""))
def q_rule_selection(spark, d):
    s = Star(spark, d)
    picked = S.select_rules(s.rules, ["critical", "high"], None, ["ai-training", "scientific-numerical"])
    # the catalogue has a fixed number of rules
    return s.findings.join(F.broadcast(picked.select("pattern_id")), "pattern_id", "left_semi").select("finding_id", "run_id", "pattern_id")


@register("finding_predicate", "P15", with_star("""
SELECT pattern_run_id, run_id, pattern_id, detected, confidence FROM pattern_runs
WHERE detected IN ('yes', 'context-dependent') AND confidence >= 0.7"""))
def q_finding_predicate(spark, d):
    pr = Star(spark, d).pattern_runs
    return pr.where(F.col("detected").isin("yes", "context-dependent") & (F.col("confidence") >= 0.7)).select(
        "pattern_run_id", "run_id", "pattern_id", "detected", "confidence")


@register("abstract_gate", "P16", """
SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) >= 50 THEN 'kept' ELSE 'no_abstract' END AS status,
       length(coalesce(text, '')) AS n_chars, length(text) > 2000 AS over_preview, text AS abstract
FROM documents""")
def q_abstract_gate(spark, d):
    return X.abstract_gate(Tables(spark, d).documents.select("doc_id", "text")).select("doc_id", "status", "n_chars", "over_preview", F.col("text").alias("abstract"))


@register("size_budget", "P17", with_star("""
SELECT file_id, line_count,
       CASE WHEN line_count <= 200 THEN 120 ELSE 120 + 50 * CAST(floor((line_count - 200) / 200) AS BIGINT) END AS budget_a,
       CASE WHEN line_count <= 500 THEN 120 ELSE least(120 + 60 * CAST(floor((line_count - 500) / 500) AS BIGINT), 600) END AS budget_b
FROM files"""))
def q_size_budget(spark, d):
    f = Star(spark, d).files
    return f.select("file_id", "line_count", X.size_budget("line_count", 120).alias("budget_a"),
                    X.size_budget("line_count", 120, step_lines=500, per_step=60, start=500, max_factor=5).alias("budget_b"))


# every turn of every conversation, read as an answer whose first line carries the verdict that its length stands for
_ANSWER = ("CASE conv_id % 5 WHEN 0 THEN 'VALID: ' WHEN 1 THEN 'Invalid: this is a false positive' || chr(10) WHEN 2 THEN 'UNCERTAIN:' || chr(10) || chr(10) "
           "WHEN 3 THEN '  VALID: This is a real issue' || chr(10) ELSE 'Well, ' END || coalesce(text, '')")


@register("verdicts", "P19 P20", f"""
WITH a AS (SELECT conv_id, turn, regexp_replace({_ANSWER}, '^\\s+|\\s+$', '', 'g') AS body, {_ANSWER} AS raw FROM conversations),
b AS (SELECT *, string_split(body, chr(10)) AS rows, upper(string_split(raw, chr(10))[1]) AS top FROM a),
c AS (SELECT *, CASE WHEN starts_with(upper(rows[1]), 'VALID:') THEN trim(substr(rows[1], 7)) WHEN starts_with(upper(rows[1]), 'INVALID:') THEN trim(substr(rows[1], 9))
                     WHEN starts_with(upper(rows[1]), 'UNCERTAIN:') THEN trim(substr(rows[1], 11)) ELSE '' END AS after FROM b)
SELECT conv_id, turn, CASE WHEN contains(top, 'INVALID') THEN 'invalid' WHEN contains(top, 'VALID') THEN 'valid' ELSE 'uncertain' END AS verdict,
       array_to_string(list_filter(list_concat(
           [CASE WHEN starts_with(upper(after), 'THIS IS A REAL ISSUE') OR starts_with(upper(after), 'THIS IS A FALSE POSITIVE') OR starts_with(upper(after), 'CANNOT DETERMINE') THEN '' ELSE after END],
           list_transform(rows[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''), ' ') AS reasoning
FROM c""")
def q_verdicts(spark, d):
    kind = F.col("conv_id") % 5
    lead = (F.when(kind == 0, "VALID: ").when(kind == 1, "Invalid: this is a false positive\n").when(kind == 2, "UNCERTAIN:\n\n")
            .when(kind == 3, "  VALID: This is a real issue\n").otherwise("Well, "))
    c = Tables(spark, d).conversations.withColumn("answer", F.concat(lead, F.coalesce("text", F.lit(""))))
    return c.select("conv_id", "turn", X.verdict("answer").alias("verdict"), X.reasoning_text("answer").alias("reasoning"))


@register("structural_duplicates", "T3", r"""
SELECT lang, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id
FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def q_structural_duplicates(spark, d):
    return C.structural_duplicates(Tables(spark, d).documents)


def _hint_sql():
    parts = [f"SELECT doc_id, '{hid}' AS hint_id, '{desc}' AS description, "
             f"CAST(len(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}')) AS INTEGER) AS n_matches FROM documents"
             for hid, rx, desc in DEMO_HINTS]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") h WHERE n_matches > 0"


@register("hint_scan", "T4", _hint_sql())
def q_hint_scan(spark, d):
    return C.hint_scan(Tables(spark, d).documents, DEMO_HINTS)


# the invented prose has no TODO: the word "und" stands in for it
@register("unfinished_markers", "T5", r"""
SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '(?i)und[:\s].*', 0)), '^\s+|\s+$', '', 'g') AS marker FROM documents""")
def q_unfinished_markers(spark, d):
    return C.unfinished_markers(Tables(spark, d).documents, marker_re=C.MARKER_RE.replace("TODO", "und"))


@register("benchmark_containment", "T6 D1", r"""
SELECT b.item_id, d.doc_id
FROM benchmark b, documents d
WHERE contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))""")
def q_benchmark_containment(spark, d):
    t = Tables(spark, d)
    return C.snippet_containment(t.benchmark, t.documents)


@register("link_audit", "T14", """
SELECT page_id, CAST(len(l) AS INTEGER) AS n_links, len(l) = 0 AS no_links, len(l) > 5 AS too_many,
       CAST(len(list_filter(l, lambda x: trim(x) = '')) AS INTEGER) AS blank_links,
       CAST(len(list_filter(l, lambda x: trim(x) <> '' AND NOT regexp_matches(lower(x), '^https?://'))) AS INTEGER) AS non_http_links
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) p""")
def q_link_audit(spark, d):
    return C.link_audit(Tables(spark, d).pages)


@register("required_fields", "T11", """
SELECT doc_id, field FROM (
  SELECT doc_id, 'quality' AS field FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  UNION ALL
  SELECT doc_id, 'lines[' || CAST(i - 1 AS VARCHAR) || '].body' FROM (
    SELECT doc_id, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) a) b WHERE trim(x[i]) = '') c""")
def q_required_fields(spark, d):
    t = Tables(spark, d)
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("body")))
    docs = t.documents.select("doc_id", "lang", lines.alias("lines")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return C.required_fields_audit(docs, ["doc_id"], ["lang", "quality", "lines"], {"lines": ["body"]})


@register("category_mismatch", "T12", with_star("""
WITH p AS (SELECT finding_id, category, category || '/' || pattern_id || '/' || severity AS path FROM findings WHERE severity IS NOT NULL
           UNION ALL SELECT finding_id, category, 'misc/' || pattern_id || '/none' FROM findings WHERE severity IS NULL)
SELECT finding_id, category, path, string_split(path, '/')[1] AS path_category FROM p WHERE string_split(path, '/')[1] <> category"""))
def q_category_mismatch(spark, d):
    path = F.concat_ws("/", F.when(F.col("severity").isNull(), "misc").otherwise(F.col("category")), "pattern_id", F.coalesce("severity", F.lit("none")))
    return C.category_mismatch(Star(spark, d).findings.select("finding_id", "category", path.alias("path")))


@register("min_count_audit", "T12", """
SELECT s.source, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT source FROM documents) s
LEFT JOIN (SELECT d.source, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1) c
  ON c.source = s.source
WHERE coalesce(c.n, 0) < 25""")
def q_min_count_audit(spark, d):
    t = Tables(spark, d)
    members = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return C.min_count_audit(t.documents, members, "source", 25)


@register("classification_breakdown", "A18", with_star("""
SELECT classification, count(*) AS count, 100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS pct
FROM prefilter_file_results GROUP BY classification"""))
def q_classification_breakdown(spark, d):
    return C.share_of_total(Star(spark, d).prefilter_file_results, "classification")


@register("domain_share", "A22 P24", with_star("""
SELECT domain, count(*) AS count, 100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS pct
FROM (SELECT CASE WHEN domain IS NULL OR domain = '' THEN 'unknown' ELSE domain END AS domain FROM repos) r
GROUP BY domain"""))
def q_domain_share(spark, d):
    return C.share_of_total(Star(spark, d).repos, "domain", default="unknown")


@register("keyword_frequency", "A21", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{w}' AS word, count(*) AS files, 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) AS pct "
    f"FROM documents WHERE contains(lower(text), '{w}')" for w in DEMO_KEYWORDS) + ") k WHERE files > 0")
def q_keyword_frequency(spark, d):
    return C.keyword_frequency(Tables(spark, d).documents, DEMO_KEYWORDS)


_ERR = "SELECT status || ': file ' || CAST(file_analysis_id AS VARCHAR) AS message FROM pattern_runs WHERE status <> 'success'"


@register("error_breakdown", "A23", with_star(f"""
SELECT trim(split_part(message, ':', 1)) AS error_type, count(*) AS count FROM ({_ERR}) e GROUP BY 1"""))
def q_error_breakdown(spark, d):
    pr = Star(spark, d).pattern_runs.where(F.col("status") != "success")
    msgs = pr.select(F.concat(F.col("status"), F.lit(": file "), F.col("file_analysis_id").cast("string")).alias("message"))
    return C.error_breakdown(msgs)


@register("failure_summary", "A23", with_star(f"""
SELECT string_agg(CAST(count AS VARCHAR) || ' ' || error_type, ', ' ORDER BY count DESC, error_type) AS summary
FROM (SELECT trim(split_part(message, ':', 1)) AS error_type, count(*) AS count FROM ({_ERR}) e GROUP BY 1) b"""))
def q_failure_summary(spark, d):
    return C.failure_summary(q_error_breakdown(spark, d))


_ISSUES = """
  SELECT finding_id, 'confidence_range' AS rule FROM findings WHERE confidence < 0 OR confidence > 0.9
  UNION ALL SELECT finding_id, 'severity_enum' FROM findings WHERE severity IS NULL OR severity NOT IN ('critical','high','medium','low')
  UNION ALL SELECT finding_id, 'detected_enum' FROM findings WHERE detected NOT IN ('yes','no','context-dependent')
  UNION ALL SELECT finding_id, 'location_required' FROM findings WHERE detected = 'yes' AND focus_line IS NULL
  UNION ALL SELECT finding_id, 'line_range' FROM findings WHERE focus_line > 5
  UNION ALL SELECT finding_id, 'category_length' FROM findings WHERE length(category) > 20"""


def _issues(spark, d):
    fn = Star(spark, d).findings
    rules = [("confidence_range", C.within("confidence", 0, 0.9)),
             ("severity_enum", C.within("severity", one_of=["critical", "high", "medium", "low"], required=True)),
             ("detected_enum", C.within("detected", one_of=["yes", "no", "context-dependent"])),
             ("location_required", (F.col("detected") == "yes") & F.col("focus_line").isNull()),
             ("line_range", C.within("focus_line", hi=5)), ("category_length", C.within("category", max_length=20))]
    return fn, C.contract_audit(fn, "finding_id", rules)


@register("contract_audit", "P25", with_star(f"SELECT finding_id, rule FROM ({_ISSUES}) v"))
def q_contract_audit(spark, d):
    return _issues(spark, d)[1]


@register("audit_totals", "A33", with_star(f"""
WITH i AS (SELECT finding_id, rule, CASE WHEN rule IN ('severity_enum', 'confidence_range') THEN 'error' ELSE 'warning' END AS level FROM ({_ISSUES}) v)
SELECT level, rule AS check_name, count(*) AS issues, count(DISTINCT finding_id) AS items, CAST(NULL AS BIGINT) AS valid, CAST(NULL AS BIGINT) AS invalid FROM i GROUP BY level, rule
UNION ALL
SELECT 'all', 'all', NULL, count(*), count(*) FILTER (finding_id NOT IN (SELECT finding_id FROM i WHERE level = 'error')),
       count(*) FILTER (finding_id IN (SELECT finding_id FROM i WHERE level = 'error')) FROM findings"""))
def q_audit_totals(spark, d):
    fn, issues = _issues(spark, d)
    level = F.when(F.col("rule").isin("severity_enum", "confidence_range"), "error").otherwise("warning")
    return E.audit_totals(issues.select("finding_id", level.alias("level"), F.col("rule").alias("check_name")), fn, "finding_id")


_SCAN_RUNS = """
SELECT doc_id, rule_no, pattern_id, 'success' AS status,
       CASE WHEN n >= 4 THEN 'yes' WHEN n >= 2 THEN 'context-dependent' ELSE 'no' END AS detected,
       least(0.5 + 0.05 * CAST(n AS DOUBLE), 0.99) AS confidence, n AS n_matches
FROM (SELECT d.doc_id, r.rule_no, r.pattern_id, CAST(len(string_split(lower(coalesce(d.text, '')), substr('tnrshldcmwb', CAST(r.rule_no % 11 AS INTEGER) + 1, 1)
             || substr('aeiouy', CAST((r.rule_no // 11) % 6 AS INTEGER) + 1, 1))) - 1 AS BIGINT) AS n
      FROM documents d, rules r) s"""


def _rule_runs(spark, d):
    star = Star(spark, d)
    return S.rule_scan(Tables(spark, d).documents, S.rule_catalog(star))


@register("scan_rule_runs", "T16 J10 S7", with_star(_SCAN_RUNS))
def q_scan_rule_runs(spark, d):
    return _rule_runs(spark, d)


@register("scan_findings", "T16 P15", with_star(f"""
SELECT * FROM ({_SCAN_RUNS}) r WHERE status = 'success' AND detected IN ('yes', 'context-dependent') AND confidence >= 0.7"""))
def q_scan_findings(spark, d):
    return S.scan_findings(_rule_runs(spark, d))


@register("scan_file_status", "T16", with_star(f"""
SELECT doc_id, count(*) AS rules, count(*) FILTER (WHERE status = 'success') AS succeeded,
       count(*) FILTER (WHERE status = 'success') = 0 AS failed
FROM ({_SCAN_RUNS}) r GROUP BY doc_id"""))
def q_scan_file_status(spark, d):
    return S.file_status(_rule_runs(spark, d))


# The tables' pages have one menu, one style, one script, one advert and one footer each; regular expressions can take
# them out, so the same lines can be had from SQL.
_PAGE = r"""
WITH cut AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]+>', ' ', 'g') AS raw,
                    regexp_replace(regexp_replace(html, '<(nav|footer|script|style)[^>]*>.*?</(nav|footer|script|style)>', '', 'gs'), '<!--.*?-->|<![^>]*>', '', 'gs') AS body FROM pages),
lines AS (SELECT page_id, url, raw, list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '</(p|div|h1|h2|h3|li|article|section)>|<[bh]r>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
                 lambda x: trim(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'))), lambda x: x <> '') AS l FROM cut),
sized AS (SELECT page_id, url, CAST(length(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS INTEGER) AS raw_chars, CAST(length(array_to_string(l, chr(10))) AS INTEGER) AS clean_chars, len(l) AS n FROM lines),
page AS (SELECT page_id, url, raw_chars, clean_chars, CASE WHEN raw_chars > 0 THEN 100.0 * CAST(raw_chars - clean_chars AS DOUBLE) / raw_chars ELSE 0.0 END AS reduction_pct,
                CASE WHEN clean_chars < 100 THEN 'too_short' WHEN clean_chars < raw_chars * 0.9 THEN 'cleaned' ELSE 'unchanged' END AS status, n > 1000 AS too_many_lines FROM sized)
"""


@register("page_cleaning", "T7 T8", _PAGE + "SELECT * FROM page")
def q_page_cleaning(spark, d):
    return C.clean_pages(Tables(spark, d).pages).drop("cleaned")


@register("page_cleaning_status", "T8", _PAGE + """
SELECT status, count(*) AS pages, CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(clean_chars) AS BIGINT) AS clean_chars,
       count(*) FILTER (too_many_lines) AS too_many_lines FROM page GROUP BY status""")
def q_page_cleaning_status(spark, d):
    return C.clean_status_counts(C.clean_pages(Tables(spark, d).pages))


# one cut per 7 lines of a text, and one that overlaps it
@register("cut_line_ranges", "J17", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, 2 AS a, 3 AS b FROM documents UNION ALL SELECT doc_id, 3, 3 + doc_id % 3 FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 9, 5 FROM documents)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (keep), '') AS text, CAST(count(*) FILTER (NOT keep) AS INTEGER) AS lines_cut
FROM (SELECT doc_id, x, i, NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND l.i BETWEEN r.a AND r.b) AS keep FROM l) k GROUP BY doc_id""")
def q_cut_line_ranges(spark, d):
    docs = Tables(spark, d).documents
    span = lambda a, b, src: src.select("doc_id", F.lit(a).alias("first_line"), b.cast("int").alias("last_line"))
    ranges = span(2, F.lit(3), docs).unionByName(span(3, 3 + F.col("doc_id") % 3, docs.where("lang = 'en'"))).unionByName(span(9, F.lit(5), docs))
    return C.cut_line_ranges(docs, ranges)


@register("flagged_context", "J18", with_star("""
WITH f AS (SELECT finding_id, file_analysis_id % (SELECT count(*) FROM documents) AS doc_id, CASE WHEN severity = 'medium' THEN [] ELSE [focus_line, focus_line + 2] END AS flags FROM findings),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT f.finding_id, f.doc_id, coalesce(string_agg(CASE WHEN len(flags) = 0 THEN x ELSE CASE WHEN list_contains(flags, i) THEN '>>>' ELSE '   ' END || ' ' || printf('%4d', i) || ' | ' || x END, chr(10) ORDER BY i)
       FILTER (CASE WHEN len(flags) = 0 THEN i <= 2 ELSE i BETWEEN list_min(flags) - 1 AND list_max(flags) + 1 END), '') AS context
FROM f JOIN l ON l.doc_id = f.doc_id GROUP BY f.finding_id, f.doc_id"""))
def q_flagged_context(spark, d):
    docs = Tables(spark, d).documents
    n = docs.select(F.count(F.lit(1))).scalar()
    flags = F.when(F.col("severity") == "medium", F.array().cast("array<int>")).otherwise(F.array(F.col("focus_line"), F.col("focus_line") + 2))
    f = Star(spark, d).findings.select("finding_id", (F.col("file_analysis_id") % n).alias("doc_id"), flags.alias("lines"), F.lit("").alias("snippet"))
    return C.flagged_context(f, docs, around=1, default_lines=2)
