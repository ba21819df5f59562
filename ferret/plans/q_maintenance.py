"""Registered set-operation / upsert / integrity queries with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ferret.functions import text as X
from ferret.functions.staging import stage, staging_dir
from ferret.operators import maintenance as U
from ferret.operators import report as R
from ferret.operators import scan as S
from ferret.operators.matching import fuzzy_best_match
from ferret.operators.merge import KeyedTable
from ferret.plans.catalog import register
from ferret.plans.star import Star
from ferret.plans.star_sql import with_star
from ferret.sources.tables import Tables


@register("exclusion_union", "U1 J7", with_star("""
WITH ex AS (SELECT DISTINCT paper_id FROM (
              SELECT r.paper_id FROM prefilter_file_results p JOIN repos r ON r.repo_id = p.repo_id
              WHERE p.classification = 'error' AND r.paper_id IS NOT NULL
              UNION ALL SELECT paper_id FROM papers WHERE matched_domain = 'ASIA') u)
SELECT p.paper_id, p.title FROM papers p WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.paper_id = p.paper_id)"""))
def q_exclusion_union(spark, d):
    s = Star(spark, d)
    a = s.prefilter_file_results.where(F.col("classification") == "error").join(s.repos.select("repo_id", "paper_id"), "repo_id") \
        .where(F.col("paper_id").isNotNull())
    b = s.papers.where(F.col("matched_domain") == "ASIA")
    ex = U.exclusion_union(a, b, key="paper_id")
    return U.exclude(s.papers, ex, "paper_id").select("paper_id", "title")


# documents that declare a label against pages that are present, by number: each side has some the other lacks
@register("declared_vs_present", "U2", """
SELECT id, 'declared_only' AS side FROM (SELECT doc_id AS id FROM labels EXCEPT SELECT page_id FROM pages) a
UNION ALL SELECT id, 'present_only' FROM (SELECT page_id AS id FROM pages EXCEPT SELECT doc_id FROM labels) b""")
def q_declared_vs_present(spark, d):
    t = Tables(spark, d)
    return U.declared_vs_present(t.labels.select(F.col("doc_id").alias("id")), t.pages.select(F.col("page_id").alias("id")), "id")


@register("insert_if_absent", "U3 P1", with_star(r"""
WITH inc AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', '') AS repo_url FROM pages),
new AS (SELECT repo_url FROM inc WHERE repo_url NOT IN (SELECT repo_url FROM repos))
SELECT (SELECT coalesce(max(repo_id), 0) FROM repos) + row_number() OVER (ORDER BY md5(repo_url), repo_url) AS repo_id, repo_url FROM new"""))
def q_insert_if_absent(spark, d):
    s = Star(spark, d)
    inc = Tables(spark, d).pages.select(X.normalize_github_url("url").alias("repo_url"))
    return U.insert_if_absent(s.repos, inc, "repo_url", "repo_id")


# a second verifier's answers for the uncertain findings: texts whose first line is read as P19 does
_ANSWER = "CASE rule_no % 3 WHEN 0 THEN 'VALID: line ' || focus_line WHEN 1 THEN 'INVALID: line ' || focus_line ELSE 'Cannot say' || chr(10) || 'more' END"
_UPD = f"""SELECT v.finding_id, CASE rule_no % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'uncertain' END AS status,
       CASE rule_no % 3 WHEN 2 THEN 'more' ELSE 'line ' || focus_line END AS reasoning, 'm9' AS model, verified_at
FROM finding_verifications v JOIN findings f ON f.finding_id = v.finding_id WHERE v.status = 'uncertain'"""


@register("upsert_verifications", "U4 T18", with_star(f"""
WITH upd AS ({_UPD})
SELECT * FROM upd
UNION ALL SELECT finding_id, status, reasoning, model, verified_at FROM finding_verifications o
          WHERE NOT EXISTS (SELECT 1 FROM upd WHERE upd.finding_id = o.finding_id)"""))
def q_upsert_verifications(spark, d):
    return U.upsert_latest(Star(spark, d).finding_verifications, _second_answers(Star(spark, d).judged_findings), "finding_id", "verified_at")


def _second_answers(judged):
    line = F.col("focus_line").cast("string")
    kind = F.col("rule_no") % 3
    answer = F.when(kind == 0, F.concat(F.lit("VALID: line "), line)).when(kind == 1, F.concat(F.lit("INVALID: line "), line)).otherwise("Cannot say\nmore")
    asked = judged.where(F.col("v_status") == "uncertain").withColumn("answer", answer)
    return asked.select("finding_id", X.verdict("answer").alias("status"), X.reasoning_text("answer").alias("reasoning"), F.lit("m9").alias("model"),
                        F.col("v_verified_at").alias("verified_at"))


# The timed-out runs are scanned again; the second scan reads the documents (a file's document is its number modulo
# the documents) and writes its own status, confidence and detection. Each (document, rule) is scored once.
@register("retry_update", "U5 J20 T17", with_star("""
WITH pr AS MATERIALIZED (SELECT * FROM pattern_runs),
n AS (SELECT count(*) AS n FROM documents),
f AS MATERIALIZED (SELECT pattern_run_id, file_analysis_id % n.n AS doc_id, rule_no FROM pr, n WHERE status = 'timeout'),
work AS MATERIALIZED (SELECT DISTINCT doc_id, rule_no, substr('tnrshldcmwb', CAST(rule_no % 11 AS INTEGER) + 1, 1) || substr('aeiouy', CAST((rule_no // 11) % 6 AS INTEGER) + 1, 1) AS syl FROM f),
again AS MATERIALIZED (SELECT doc_id, rule_no, (length(lower(text)) - length(replace(lower(text), syl, ''))) // 2 AS m FROM work JOIN documents USING (doc_id))
SELECT pr.pattern_run_id, pr.run_id, CASE WHEN a.m IS NULL THEN pr.status ELSE 'success' END AS status,
       CASE WHEN a.m IS NULL THEN pr.detected WHEN a.m >= 4 THEN 'yes' WHEN a.m >= 2 THEN 'context-dependent' ELSE 'no' END AS detected,
       CASE WHEN a.m IS NULL THEN pr.confidence ELSE least(0.5 + 0.05 * CAST(a.m AS DOUBLE), 0.99) END AS confidence, a.m IS NOT NULL AS updated
FROM pr LEFT JOIN f ON f.pattern_run_id = pr.pattern_run_id LEFT JOIN again a ON a.doc_id = f.doc_id AND a.rule_no = f.rule_no"""))
def q_retry_update(spark, d):
    s, t = Star(spark, d), Tables(spark, d)
    pr = s.pattern_runs
    n = t.documents.select(F.count(F.lit(1))).scalar()
    failed = S.failed_runs(pr, ["timeout"]).withColumn("doc_id", F.col("file_analysis_id") % n)
    again = S.rescan(failed, t.documents, S.rule_catalog(s))
    return U.keyed_update(pr.select("pattern_run_id", "run_id", "status", "detected", "confidence"), again, ["pattern_run_id"], ["status", "detected", "confidence"])


# U3-U5 on a stored table: the verifications are stored in buckets, then the second verifier's answers are merged, twice
@register("merged_verifications", "U4 U5 T18", with_star(f"""
WITH upd AS ({_UPD})
SELECT * FROM upd
UNION ALL SELECT finding_id, status, reasoning, model, verified_at FROM finding_verifications o
          WHERE NOT EXISTS (SELECT 1 FROM upd WHERE upd.finding_id = o.finding_id)"""))
def q_merged_verifications(spark, d):
    s = Star(spark, d)
    # staged, so that the lineitems are read, grouped and joined once for the table and the answers
    judged = s.judged_findings.where(F.col("v_status").isNotNull())
    s.judged_findings = stage(judged.select("finding_id", "rule_no", "focus_line", "v_status", "v_reasoning", "v_model", "v_verified_at"), "judged")
    fv = s.finding_verifications
    table = KeyedTable(spark, f"{staging_dir(spark)}/verifications-{uuid.uuid4().hex}", "finding_id", fv.schema).create(fv)
    upd = stage(_second_answers(s.judged_findings), "answers")
    table.merge(upd, recency="verified_at")
    table.merge(upd, recency="verified_at")  # a replay changes nothing
    return table.read()


@register("merged_repos", "U3 P1", with_star(r"""
WITH inc AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', '') AS repo_url FROM pages),
new AS (SELECT repo_url FROM inc WHERE repo_url NOT IN (SELECT repo_url FROM repos))
SELECT repo_id, repo_url FROM repos
UNION ALL SELECT (SELECT coalesce(max(repo_id), 0) FROM repos) + row_number() OVER (ORDER BY md5(repo_url), repo_url) AS repo_id, repo_url FROM new"""))
def q_merged_repos(spark, d):
    repos = Star(spark, d).repos.select("repo_id", "repo_url")
    table = KeyedTable(spark, f"{staging_dir(spark)}/repos-{uuid.uuid4().hex}", "repo_url", repos.schema).create(repos)
    table.insert_new(Tables(spark, d).pages.select(X.normalize_github_url("url").alias("repo_url")), "repo_id")
    return table.read()


@register("run_lifecycle", "U6 W2", with_star("""
WITH ev AS (SELECT run_id, 'running' AS state, started_at AS ev_at, CAST(NULL AS BIGINT) AS total_files FROM analysis_runs
            UNION ALL SELECT run_id, 'completed', completed_at, total_files FROM analysis_runs WHERE status = 'completed')
SELECT run_id, state, ev_at AS since, total_files FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ev_at DESC, state DESC, total_files DESC NULLS LAST) AS rn FROM ev) x
WHERE rn = 1"""))
def q_run_lifecycle(spark, d):
    return U.current_state(U.run_events(Star(spark, d).analysis_runs))


@register("integrity_audit", "U8", with_star("""
SELECT 'findings.file_analysis_id' AS check_name, count(*) AS violations FROM findings f
  WHERE NOT EXISTS (SELECT 1 FROM file_analyses a WHERE a.file_analysis_id = f.file_analysis_id)
UNION ALL SELECT 'files.repo_id', count(*) FROM files f WHERE NOT EXISTS (SELECT 1 FROM repos r WHERE r.repo_id = f.repo_id)
UNION ALL SELECT 'repos.paper_id', count(*) FROM repos r
  WHERE r.paper_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = r.paper_id)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'unique files(repo_id, file_path)', count(*) FROM (
  SELECT repo_id, file_path FROM files GROUP BY 1, 2 HAVING count(*) > 1) x
UNION ALL SELECT 'unique lineitem(l_orderkey, l_linenumber)', count(*) FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) y"""))
def q_integrity_audit(spark, d):
    s, t = Star(spark, d), Tables(spark, d)
    checks = [
        ("findings.file_analysis_id", U.fk_orphans(s.findings, s.file_analyses, "file_analysis_id", "file_analysis_id")),
        ("files.repo_id", U.fk_orphans(s.files, s.repos, "repo_id", "repo_id")),
        ("repos.paper_id", U.fk_orphans(s.repos, s.papers, "paper_id", "paper_id")),
        ("lineitem.l_orderkey", U.fk_orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey")),
        ("unique files(repo_id, file_path)", U.duplicate_keys(s.files, ["repo_id", "file_path"])),
        ("unique lineitem(l_orderkey, l_linenumber)", U.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])),
    ]
    parts = [df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations")) for name, df in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("dataset_disjointness", "U9 D1", with_star("""
WITH seen AS (SELECT fa.run_id, r.paper_id, count(*) AS files FROM file_analyses fa, files f, repos r
              WHERE f.file_id = fa.file_id AND r.repo_id = f.repo_id AND r.paper_id IS NOT NULL GROUP BY ALL)
SELECT a.run_id AS run_a, b.run_id AS run_b, a.paper_id FROM seen a, seen b WHERE a.paper_id = b.paper_id AND a.run_id < b.run_id"""))
def q_dataset_disjointness(spark, d):
    s = Star(spark, d)
    fp = s.file_analyses.join(s.files.select("file_id", "repo_id"), "file_id").join(s.repos.select("repo_id", "paper_id"), "repo_id")
    return U.shared_members(fp, "run_id", "paper_id")


@register("group_exclusion", "J9", with_star("""
WITH fr AS (SELECT f.file_id, f.repo_id, r.paper_id, fa.run_id FROM files f JOIN repos r ON r.repo_id = f.repo_id
            JOIN file_analyses fa ON fa.file_id = f.file_id),
debut AS (SELECT paper_id, min(run_id) AS run_id FROM fr WHERE paper_id IS NOT NULL GROUP BY paper_id)
SELECT fr.run_id, fr.file_id, fr.repo_id, fr.paper_id FROM fr LEFT JOIN debut USING (paper_id)
WHERE fr.paper_id IS NULL OR fr.run_id = debut.run_id"""))
def q_group_exclusion(spark, d):
    s = Star(spark, d)
    fr = s.files.select("file_id", "repo_id").join(s.repos.select("repo_id", "paper_id"), "repo_id") \
        .join(s.file_analyses.select("file_id", "run_id"), "file_id")
    return U.exclude_seen_groups(fr, "run_id", "paper_id").select("run_id", "file_id", "repo_id", "paper_id")


@register("papers_with_findings", "J6", with_star("""
SELECT p.paper_id, p.title FROM papers p
WHERE p.paper_id IN (SELECT r.paper_id FROM findings fn, file_analyses fa, files f, repos r
                     WHERE fa.file_analysis_id = fn.file_analysis_id AND f.file_id = fa.file_id AND r.repo_id = f.repo_id)"""))
def q_papers_with_findings(spark, d):
    s = Star(spark, d)
    found = R.enriched_findings(s).select("paper_id")
    return s.papers.join(found, "paper_id", "left_semi").select("paper_id", "title")


# Files of a failed analysis are pending again: their analysis row does not count as one.
@register("resume_remaining", "J8", with_star("""
SELECT fa.run_id, fa.file_id FROM file_analyses fa JOIN analysis_runs ar ON ar.run_id = fa.run_id
WHERE ar.status = 'running' AND fa.status IN ('timeout', 'error')"""))
def q_resume_remaining(spark, d):
    s = Star(spark, d)
    done = s.file_analyses.where(F.col("status") == "success")
    return U.remaining_files(s.analysis_runs, s.file_analyses.select("run_id", "file_id"), done)


@register("manifest_enrichment", "J11 P2", with_star("""
WITH p AS (SELECT paper_id, paper_url, title, matched_domain, 'owner' || (paper_id % 25) || '__' || 'Customer#' || lpad(CAST(paper_id % 40 AS VARCHAR), 9, '0') AS repo_name FROM papers),
l AS (SELECT repo_name, max(paper_id) AS paper_id FROM p GROUP BY repo_name)
SELECT r.repo_id, r.repo_name, coalesce(p.paper_url, '') AS paper_url, coalesce(p.title, '') AS title, coalesce(p.matched_domain, '') AS matched_domain
FROM (SELECT repo_id, 'owner' || (repo_id % 25) || '__' || 'Customer#' || lpad(CAST(repo_id % 60 AS VARCHAR), 9, '0') AS repo_name FROM repos) r
LEFT JOIN l ON l.repo_name = r.repo_name LEFT JOIN p ON p.paper_id = l.paper_id"""))
def q_manifest_enrichment(spark, d):
    s = Star(spark, d)
    slug = lambda c, m: F.concat(F.lit("owner"), (F.col(c) % 25).cast("string"), F.lit("__Customer#"), F.lpad((F.col(c) % m).cast("string"), 9, "0"))
    papers = s.papers.select(slug("paper_id", 40).alias("repo_name"), F.col("paper_id").alias("order_no"), "paper_url", "title", "matched_domain")
    return U.manifest_enrichment(s.repos.select("repo_id", slug("repo_id", 60).alias("repo_name")), papers)


@register("path_lookup", "J12", with_star("""
WITH q AS (SELECT file_id AS asked, CASE file_id % 4 WHEN 0 THEN '/data/' || file_path WHEN 1 THEN file_path WHEN 2 THEN '/x/files/y/' || file_path ELSE 'other/' || file_id END AS path FROM files)
SELECT q.asked, q.path, CASE WHEN asked % 4 = 3 THEN NULL ELSE f.file_id END AS file_id,
       CASE asked % 4 WHEN 1 THEN 'exact' WHEN 3 THEN 'none' ELSE 'relative' END AS matched_by
FROM q JOIN files f ON f.file_id = q.asked"""))
def q_path_lookup(spark, d):
    f = Star(spark, d).files
    kind, p = F.col("file_id") % 4, F.col("file_path")
    path = (F.when(kind == 0, F.concat(F.lit("/data/"), p)).when(kind == 1, p).when(kind == 2, F.concat(F.lit("/x/files/y/"), p))
            .otherwise(F.concat(F.lit("other/"), F.col("file_id").cast("string"))))
    return U.lookup_paths(f.select(F.col("file_id").alias("asked"), path.alias("path")), f.select("file_id", "file_path"))


@register("file_papers", "J13", with_star("""
SELECT fa.file_id, (SELECT r.paper_id FROM repos r WHERE r.repo_id = f.repo_id) AS paper_id
FROM file_analyses fa JOIN files f ON f.file_id = fa.file_id WHERE fa.status <> 'success'"""))
def q_file_papers(spark, d):
    s = Star(spark, d)
    return U.grandparent(s.file_analyses.where(F.col("status") != "success"), s.files, s.repos, "file_id", "repo_id", "paper_id")


@register("unique_names", "W10", with_star("""
WITH n AS (SELECT file_id, repo_id, 'part' || (file_id % 3) || '.v' || (file_id % 2) || '.py' AS name FROM files),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY file_id) - 1 AS k FROM n)
SELECT file_id, repo_id, name, CASE WHEN k = 0 THEN name ELSE left(name, length(name) - 3) || '_' || k || '.py' END AS unique_name FROM k"""))
def q_unique_names(spark, d):
    name = F.concat(F.lit("part"), (F.col("file_id") % 3).cast("string"), F.lit(".v"), (F.col("file_id") % 2).cast("string"), F.lit(".py"))
    return U.unique_names(Star(spark, d).files.select("file_id", "repo_id", name.alias("name")), "repo_id", "name", "file_id")


@register("orphaned_cache", "U10 T9", """
WITH c AS (SELECT page_id, CAST(page_id AS VARCHAR) || '_' || substr(md5(url), 1, 12) AS cache_key FROM pages),
r AS (SELECT CAST(p.page_id AS VARCHAR) || '_' || substr(md5(p.url), 1, 12) AS cache_key FROM pages p JOIN labels l ON l.doc_id = p.page_id)
SELECT page_id, cache_key FROM c WHERE cache_key NOT IN (SELECT cache_key FROM r)""")
def q_orphaned_cache(spark, d):
    t = Tables(spark, d)
    key = F.concat_ws("_", F.col("page_id").cast("string"), F.substring(F.md5("url"), 1, 12)).alias("cache_key")
    named = t.pages.join(t.labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select(key)
    return U.orphaned_entries(t.pages.select("page_id", key), named, "cache_key")


# misspelt part names: a letter lost, two swapped, one replaced, or another one at the end, by the part's number
_MISSPELT = """SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN left(p_name, k - 1) || substr(p_name, k + 1)
         WHEN 1 THEN left(p_name, k - 1) || 'x' || substr(p_name, k + 1) WHEN 2 THEN p_name || 'er' WHEN 3 THEN reverse(p_name) ELSE p_name END AS asked
       FROM (SELECT p_partkey, p_name, 1 + p_partkey % length(p_name) AS k FROM part) p"""


@register("fuzzy_part_names", "J16", f"""
WITH q AS ({_MISSPELT}), n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT asked, name, levenshtein(asked, name) AS edits, greatest(length(asked), length(name)) AS m FROM q, n),
r AS (SELECT asked, name, CAST(m - edits AS DOUBLE) / m AS similarity, row_number() OVER (PARTITION BY asked ORDER BY CAST(edits AS DOUBLE) / m, name) AS place
      FROM s WHERE (m - edits) * 5 > m * 3)
SELECT q.asked, r.name AS best, r.similarity FROM q LEFT JOIN r ON r.asked = q.asked AND r.place = 1""")
def q_fuzzy_part_names(spark, d):
    part = Tables(spark, d).part
    name, k = F.col("p_name"), (F.col("p_partkey") % F.length("p_name")).cast("int")
    left, right = F.substring(name, F.lit(1), k), F.substring(name, k + 2, F.length(name))
    kind = F.col("p_partkey") % 5
    wrong = (F.when(kind == 0, F.concat(left, right)).when(kind == 1, F.concat(left, F.lit("x"), right)).when(kind == 2, F.concat(name, F.lit("er")))
             .when(kind == 3, F.reverse(name)).otherwise(name))
    return fuzzy_best_match(part.select(wrong.alias("asked")), "asked", part, "p_name")
