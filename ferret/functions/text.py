"""Column-level helpers for the curation predicates (P1–P24). All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferret.functions.vocab import IMPORT_ALIASES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8(content) -> Column:
    """Bytes as text; bytes that are not UTF-8 are left out."""
    return F.replace(F.make_valid_utf8(_c(content).cast("string")), F.lit("\ufffd"), F.lit(""))


def normalize_github_url(url) -> Column:
    """Strip trailing '/', then one '.git', then git:// → https:// (only for git://github.com),
    then git@github.com: → https://github.com/ — in that order. Host case is kept."""
    u = F.regexp_replace(_c(url), "/+$", "")
    u = F.regexp_replace(u, r"\.git$", "")
    u = F.when(u.startswith("git://github.com"), F.replace(u, F.lit("git://"), F.lit("https://"))).otherwise(u)
    return F.when(u.startswith("git@github.com:"), F.replace(u, F.lit("git@github.com:"), F.lit("https://github.com/"))).otherwise(u)


def repo_slug(url) -> Column:
    """P2: 'owner__repo' from the last two '/'-segments (after stripping trailing '/'); one segment → itself."""
    parts = F.split(F.regexp_replace(_c(url), "/+$", ""), "/", -1)
    return F.when(F.size(parts) >= 2, F.concat_ws("__", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def contains_any(text, words: list[str]) -> Column:
    """Lower-cased substring test against any word (an OR of ``contains``, codegen'd)."""
    t = F.lower(_c(text))
    cond = F.lit(False)
    for w in words:
        cond = cond | t.contains(w.lower())
    return cond


def classify_domain(text, domains: dict[str, list[str]]) -> Column:
    """First domain (declared order) having a keyword as a substring of the lower-cased text; null/empty → null."""
    t = F.lower(_c(text))
    out = None
    for dom, kws in domains.items():
        cond = F.lit(False)
        for k in kws:
            cond = cond | t.contains(k.lower())
        out = F.when(cond, dom) if out is None else out.when(cond, dom)
    return F.when(_c(text).isNull() | (F.length(_c(text)) == 0), F.lit(None).cast("string")).otherwise(out)


def classify_tasks(tasks, domains: dict[str, list[str]]) -> Column:
    """P3 on a task array: lower, join by space, then the substring classifier."""
    joined = F.array_join(F.transform(_c(tasks), lambda x: F.lower(x)), " ")
    return F.when(F.size(_c(tasks)) > 0, classify_domain(joined, domains))


def venue_excluded(conference, proceeding, venues: list[str]) -> Column:
    """P5: conference + ' ' + proceeding contains any excluded venue; blank keeps the row."""
    v = F.lower(F.trim(F.concat_ws(" ", F.coalesce(_c(conference), F.lit("")), F.coalesce(_c(proceeding), F.lit("")))))
    return F.when(v == "", F.lit(False)).otherwise(contains_any(v, venues))


def glob_to_regex(pattern: str) -> str:
    """P6: '*' → '.*', '/' → either separator, '.' left unescaped, anchored at the start only."""
    return pattern.replace("*", ".*").replace("/", r"[/\\]")


def path_excluded(path, basenames: list[str], patterns: list[str]) -> Column:
    """Basename in the exact list, or the path matches a glob-derived regex from its start."""
    base = F.element_at(F.split(_c(path), "/", -1), -1)
    cond = base.isin(*basenames) if basenames else F.lit(False)
    if patterns:
        cond = cond | _c(path).rlike("^(" + "|".join(glob_to_regex(p) for p in patterns) + ")")
    return cond


def line_count(text) -> Column:
    """Newline count + 1 (the curation definition)."""
    return F.size(F.split(_c(text), "\n", -1)).cast("long")


def size_band(text, min_bytes: int = 500, max_bytes: int = 500_000, min_lines: int = 20) -> Column:
    """Min ≤ UTF-8 bytes ≤ max and lines ≥ min_lines."""
    b = F.octet_length(_c(text))
    return b.between(min_bytes, max_bytes) & (line_count(text) >= min_lines)


IMPORT_RE = r"(?m)^\s*import\s+(\w+)"
FROM_RE = r"(?m)^\s*from\s+(\w+)"


def extract_imports(text, loose: bool = False) -> Column:
    """Distinct top-level modules from ``import x`` / ``from x`` lines (loose: unanchored, case-insensitive)."""
    if loose:
        a = F.regexp_extract_all(_c(text), F.lit(r"(?i)import\s+(\w+)"), 1)
        b = F.regexp_extract_all(_c(text), F.lit(r"(?i)from\s+(\w+)"), 1)
    else:
        a = F.regexp_extract_all(_c(text), F.lit(IMPORT_RE), 1)
        b = F.regexp_extract_all(_c(text), F.lit(FROM_RE), 1)
    return F.array_distinct(F.concat(a, b))


def libraries_used(imports, libraries: list[str]) -> Column:
    """For each listed library that is imported its module name, in list order (a package and its module that are
    both listed each count, as in the curation lists)."""
    lib = F.array(*[F.lit(IMPORT_ALIASES.get(x, x)) for x in libraries])
    return F.filter(lib, lambda x: F.array_contains(_c(imports), x))


def abstract_gate(docs, text: str = "text", min_chars: int = 50, preview_chars: int = 2000):
    """Status kept / no_abstract (blank or under ``min_chars`` when trimmed), the length, and whether a preview
    would have to be cut (over_preview). The text itself stays whole."""
    short = F.length(F.trim(F.coalesce(_c(text), F.lit("")))) < min_chars
    return docs.select("*", F.when(short, "no_abstract").otherwise("kept").alias("status"),
                       F.length(F.coalesce(_c(text), F.lit(""))).cast("long").alias("n_chars"), (F.length(_c(text)) > preview_chars).alias("over_preview"))


def estimate_tokens(text) -> Column:
    """Len // 4."""
    return F.floor(F.length(_c(text)) / 4).cast("long")


def prompt_fits(system_tokens, user_text, max_tokens: int = 16000, buffer: int = 400, overhead: int = 200) -> Column:
    """total = sys + user + overhead, plus int(10 %); fits when total ≤ max − buffer. Returns struct."""
    base = _c(system_tokens) + estimate_tokens(user_text) + F.lit(overhead)
    total = base + F.floor(base * 0.1).cast("long")
    return F.struct(total.alias("total_tokens"), (total <= F.lit(max_tokens - buffer)).alias("fits"))


def size_budget(n_lines, base: int, step_lines: int = 200, per_step: int = 50, start: int = 200, max_factor: int | None = None) -> Column:
    """≤ start lines → base; else base + per_step·⌊(n − start)/step_lines⌋, at most ``max_factor``·base when given
    (the reference's inference time-out: 5)."""
    n = _c(n_lines)
    grown = F.lit(base) + F.lit(per_step) * F.floor((n - start) / step_lines).cast("long")
    if max_factor is not None:
        grown = F.least(grown, F.lit(max_factor * base).cast("long"))
    return F.when(n <= start, F.lit(base).cast("long")).otherwise(grown)


def nb_id(text) -> Column:
    """Notebook id by regex ``(nb_\\d+)``."""
    return F.regexp_extract(_c(text), r"(nb_\d+)", 1)


def yes_label(text) -> Column:
    """True iff the trimmed upper-cased label starts with 'Y' (``Y (MinMaxScaler)`` is true)."""
    return F.upper(F.trim(_c(text))).startswith("Y")


def first_line(text) -> Column:
    return F.element_at(F.split(_c(text), "\n", -1), 1)


def verdict(text) -> Column:
    """First line: INVALID → invalid; VALID (and not INVALID) → valid; else (also blank) uncertain."""
    up = F.upper(first_line(text))
    return F.when(up.contains("INVALID"), "invalid").when(up.contains("VALID"), "valid").otherwise("uncertain")


# Verdict prefixes of line 1, and the answer template's own phrases.
VERDICT_PREFIXES = ["VALID:", "INVALID:", "UNCERTAIN:"]
TEMPLATE_PHRASES = ["THIS IS A REAL ISSUE", "THIS IS A FALSE POSITIVE", "CANNOT DETERMINE"]


def reasoning_text(text) -> Column:
    """P20: what follows the verdict prefix on line 1 (nothing without a prefix, or when it is the template's phrase),
    then the other non-blank lines, all trimmed, joined by spaces. The text itself is stripped first."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.transform(F.split(strip(_c(text)), "\n", -1), strip)
    first = F.element_at(lines, 1)
    after = strip(F.regexp_extract(first, "(?is)^(?:" + "|".join(VERDICT_PREFIXES) + ")(.*)$", 1))
    template = F.upper(after).rlike("^(" + "|".join(TEMPLATE_PHRASES) + ")")
    head = F.when(template, F.lit("")).otherwise(after)
    parts = F.transform(lines, lambda x, i: F.when(i == 0, head).otherwise(x))
    return F.when(_c(text).isNotNull(), F.array_join(F.filter(parts, lambda x: x != ""), " "))


def coalesce_location(flat, nested_field) -> Column:
    """Flat value unless falsy (null or ''), else the nested field."""
    return F.coalesce(F.nullif(_c(flat), F.lit("")), _c(nested_field))


def content_key(id_col, url) -> Column:
    """``{id}_{host with . → _}_{md5(url)[:12]}``."""
    host = F.regexp_replace(F.coalesce(F.parse_url(_c(url), F.lit("HOST")), F.lit("")), r"\.", "_")
    return F.concat_ws("_", _c(id_col).cast("string"), host, F.substring(F.md5(_c(url)), 1, 12))


def name_match(expected, found) -> Column:
    """struct(exact, partial): exact = case-insensitive equality; partial = either contains the other
    or the last dotted parts are equal; a null or empty side gives (false, false)."""
    a, b = F.nullif(F.lower(_c(expected)), F.lit("")), F.nullif(F.lower(_c(found)), F.lit(""))
    last = lambda x: F.element_at(F.split(x, r"\.", -1), -1)
    both = a.isNotNull() & b.isNotNull()
    exact = both & (a == b)
    partial = both & (exact | a.contains(b) | b.contains(a) | (last(a) == last(b)))
    return F.struct(exact.alias("exact"), partial.alias("partial"))
