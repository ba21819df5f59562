"""The star views of FIXTURES §2 as portable SQL (DuckDB dialect), for the oracle.

This is written independently of ``star.py`` (DataFrame API) so the oracle
check compares two separate derivations of the same fixture.
"""

from __future__ import annotations

STAR_CTES: dict[str, str] = {
    "rules": """
        SELECT CAST(range AS BIGINT) AS rule_no,
               'r' || lpad(CAST(range AS VARCHAR), 2, '0') AS pattern_id,
               ['ai-training','ai-inference','scientific-numerical','scientific-performance',
                'scientific-reproducibility'][range % 5 + 1] AS category,
               CASE WHEN range = 65 THEN NULL ELSE ['critical','high','medium'][range % 3 + 1] END AS severity
        FROM range(66)""",
    "geo": """
        SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "papers": """
        SELECT s_suppkey AS paper_id, 'https://papers.example/p/' || CAST(s_suppkey AS VARCHAR) AS paper_url,
               s_name AS title, g.r_name AS matched_domain
        FROM supplier LEFT JOIN geo g ON s_nationkey = g.n_nationkey""",
    "repos": """
        SELECT c_custkey AS repo_id,
               'owner' || CAST(c_nationkey AS VARCHAR) || '__' || c_name AS repo_name,
               'https://github.com/owner' || CAST(c_nationkey AS VARCHAR) || '/' || c_name AS repo_url,
               CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % (SELECT count(*) FROM supplier) END AS paper_id,
               CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE g.r_name END AS domain,
               c_mktsegment AS data_source
        FROM customer LEFT JOIN geo g ON c_nationkey = g.n_nationkey""",
    "files": """
        SELECT o_orderkey AS file_id, o_custkey AS repo_id,
               'files/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '.py' AS file_path,
               o_orderkey % 7 = 0 AS is_notebook, o_orderkey % 1200 + 1 AS line_count
        FROM orders""",
    "file_analyses": """
        SELECT o_orderkey AS file_analysis_id, o_orderkey AS file_id,
               CAST(year(o_orderdate) - 1994 AS BIGINT) AS run_id,
               CASE WHEN o_orderstatus IN ('F','O') THEN 'success'
                    WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'error' END AS status,
               floor(o_totalprice) / 1000.0 AS duration_seconds
        FROM orders""",
    "analysis_runs": """
        SELECT CAST(year(o_orderdate) - 1994 AS BIGINT) AS run_id, min(o_orderdate) AS started_at,
               max(o_orderdate) AS completed_at,
               CASE WHEN CAST(year(o_orderdate) - 1994 AS BIGINT) = 7 THEN 'running' ELSE 'completed' END AS status,
               'papers_with_code' AS data_source, count(*) AS total_files
        FROM orders GROUP BY 1""",
    "li_groups": """
        SELECT l_orderkey AS file_analysis_id, l_partkey % 66 AS rule_no, max(l_discount) AS max_disc,
               min(l_linenumber) AS min_line, min(l_returnflag) AS rf, min(l_linestatus) AS ls,
               max(l_shipdate) AS last_ship
        FROM lineitem GROUP BY 1, 2""",
    "pattern_runs": """
        SELECT g.file_analysis_id * 100 + g.rule_no AS pattern_run_id, g.file_analysis_id, fa.run_id, g.rule_no,
               r.pattern_id, r.category, r.severity, round(0.5 + 5.0 * g.max_disc, 2) AS confidence,
               CASE WHEN round(0.5 + 5.0 * g.max_disc, 2) >= 0.6 THEN 'yes'
                    WHEN round(0.5 + 5.0 * g.max_disc, 2) >= 0.55 THEN 'context-dependent' ELSE 'no' END AS detected,
               CASE fa.status WHEN 'success' THEN 'success' WHEN 'timeout' THEN 'timeout' ELSE 'api_error' END AS status,
               g.min_line AS focus_line, g.rf, g.ls, g.last_ship
        FROM li_groups g JOIN file_analyses fa ON g.file_analysis_id = fa.file_analysis_id
        JOIN rules r ON g.rule_no = r.rule_no""",
    "findings": """
        SELECT pattern_run_id AS finding_id, file_analysis_id, run_id, rule_no, pattern_id, category, severity,
               confidence, detected, focus_line
        FROM pattern_runs WHERE status = 'success' AND detected <> 'no' AND confidence >= 0.7""",
    "finding_verifications": """
        SELECT * FROM (
          SELECT pattern_run_id AS finding_id,
                 CASE WHEN rule_no % 20 = 0 THEN 'error' WHEN rf = 'A' THEN 'valid' WHEN rf = 'R' THEN 'invalid'
                      WHEN ls = 'F' THEN 'uncertain' END AS status,
                 'flag ' || rf || ' status ' || ls AS reasoning,
                 'm' || CAST(rule_no % 2 AS VARCHAR) AS model, last_ship AS verified_at
          FROM pattern_runs WHERE status = 'success' AND detected <> 'no' AND confidence >= 0.7) v
        WHERE status IS NOT NULL""",
    "prefilter_file_results": """
        SELECT CAST(year(o_orderdate) - 1994 AS BIGINT) AS prefilter_run_id, o_orderkey AS file_id,
               o_custkey AS repo_id,
               CASE WHEN substr(o_orderpriority, 1, 1) IN ('1','2') THEN 'self_contained'
                    WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'fragment'
                    WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'uncertain' ELSE 'error' END AS classification,
               CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence
        FROM orders""",
    "repo_scans": """
        SELECT repo_id * 10 + run_no AS scan_id, repo_id, run_no, files_total, self_contained, fragments, uncertain,
               files_total * 0.5 AS duration_seconds,
               CASE WHEN (repo_id + run_no) % 5 <> 0 THEN 'completed' ELSE 'running' END AS status
        FROM (SELECT repo_id, prefilter_run_id AS run_no, count(*) AS files_total,
                     count(*) FILTER (WHERE classification = 'self_contained') AS self_contained,
                     count(*) FILTER (WHERE classification = 'fragment') AS fragments,
                     count(*) FILTER (WHERE classification = 'uncertain') AS uncertain
              FROM prefilter_file_results GROUP BY 1, 2) s""",
    "test_results": """
        SELECT pattern_run_id AS test_id, run_id, pattern_id, category,
               ['positive','negative','context_dependent'][rule_no % 3 + 1] AS test_type, detected, confidence,
               CASE rf WHEN 'A' THEN 'yes' WHEN 'N' THEN 'partial' ELSE 'no' END AS judge_verdict,
               focus_line, CAST(file_analysis_id % 7 + 1 AS INTEGER) AS expected_line
        FROM pattern_runs WHERE status = 'success'""",
}


def with_star(body: str) -> str:
    """Prefix a query with every star CTE (DuckDB only materialises those referenced)."""
    ctes = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in STAR_CTES.items())
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"
