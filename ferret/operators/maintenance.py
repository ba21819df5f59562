"""Set operations, upserts and table maintenance.

No table format is assumed: upserts are "union, keep the latest per key" as an
aggregate (``max`` of a struct led by the recency column), so a hot key is
partial-aggregated instead of sorted in one task; results are written with
dynamic partition overwrite by the caller (see ``ferret.sources.files``).
Anti joins are written as ``left_anti`` (never SQL ``NOT IN``, which plans a
null-aware broadcast).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferret.functions.ordering import chunked_row_number, hash_chunks, join_null_safe


def exclusion_union(*key_sets: DataFrame, key: str) -> DataFrame:
    """Distinct union of exclusion keys from several sources."""
    u = key_sets[0].select(key)
    for k in key_sets[1:]:
        u = u.unionByName(k.select(key))
    return u.distinct()


def exclude(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``keys`` (left anti join)."""
    return df.join(keys.select(key), key, "left_anti")


def declared_vs_present(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Two-way difference tagged by side: both sides in one grouping by key, in which nulls are equal."""
    both = declared.select(key, F.lit(1).alias("_s")).unionByName(present.select(key, F.lit(2).alias("_s")))
    g = both.groupBy(key).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).where("_lo = _hi")
    return g.select(key, F.when(F.col("_lo") == 1, "declared_only").otherwise("present_only").alias("side"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, id_col: str) -> DataFrame:
    """New keys get surrogate ids max(id) + rank(md5(key)); existing rows are not updated.
    The rank runs inside chunks of the hash, so the new keys spread over 65,536 windows whatever they look like."""
    new = incoming.where(F.col(key).isNotNull()).select(key).distinct().join(existing.select(key), key, "left_anti")
    top = existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    hashed = new.withColumn("_h", F.md5(key))
    ranked = chunked_row_number(hashed, [], [F.col("_h"), F.col(key)], hash_chunks(F.col("_h")), out="_rn")
    return ranked.select((top + F.col("_rn")).alias(id_col), key)


def upsert_latest(current: DataFrame, updates: DataFrame, key: str, recency: str) -> DataFrame:
    """U4: union and keep the most recent row per key; of equally recent rows an update wins over the current one
    (key stays stable, no id churn)."""
    cols = [c for c in current.columns if c not in (key, recency)]
    u = current.withColumn("_src", F.lit(0)).unionByName(updates.select(*current.columns, F.lit(1).alias("_src")))
    g = u.groupBy(key).agg(F.max(F.struct(recency, "_src", *cols)).alias("_r"))
    return g.select(key, "_r.*").select(*current.columns)


def keyed_update(base: DataFrame, updates: DataFrame, key: list[str], cols: list[str], recency: str | None = None) -> DataFrame:
    """Update columns of matched rows; unmatched rows unchanged, updates without a row dropped. Of several updates of one key the most
    recent wins (``recency``), then the greatest values; an update may write nulls; null keys match each other."""
    lead = [recency] if recency else []
    up = updates.groupBy(*key).agg(F.max(F.struct(*lead, *[c for c in cols if c != recency])).alias("_u"))
    j = join_null_safe(base, up, key, "left")
    hit = F.col("_u").isNotNull()
    out = [F.when(hit, F.col("_u")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns]
    return j.select(*out, hit.alias("updated"))


def run_events(runs: DataFrame) -> DataFrame:
    """Append-only lifecycle rows (start; completion for finished runs)."""
    start = runs.select("run_id", F.lit("running").alias("state"), F.col("started_at").alias("ev_at"), F.lit(None).cast("long").alias("total_files"))
    done = runs.where(F.col("status") == "completed").select("run_id", F.lit("completed").alias("state"),
                                                           F.col("completed_at").alias("ev_at"), "total_files")
    return start.unionByName(done)


def current_state(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Latest event per key (aggregate of a struct led by the event time)."""
    g = events.groupBy(key).agg(F.max(F.struct("ev_at", "state", "total_files")).alias("_s"))
    return g.select(key, F.col("_s.state").alias("state"), F.col("_s.ev_at").alias("since"), F.col("_s.total_files").alias("total_files"))


def evolve_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema evolution — union by name, missing columns become null."""
    return old.unionByName(new, allowMissingColumns=True)


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """U8: child rows whose non-null foreign key has no parent."""
    c = child.where(F.col(fk).isNotNull())
    return c.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """U8: UNIQUE violations: key groups having more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def group_exclusion(files: DataFrame, seen_files: DataFrame, group: str) -> DataFrame:
    """Drop all files of any group (paper) seen earlier; files without a group stay."""
    seen = seen_files.where(F.col(group).isNotNull()).select(group).distinct()
    return files.join(seen, group, "left_anti")  # null keys never match, so orphans are kept


def exclude_seen_groups(files: DataFrame, run: str, group: str) -> DataFrame:
    """J9 for every run against all earlier ones: a group's files stay only in the first run that has it; files without
    a group stay. One grouped minimum instead of a pair of runs at a time."""
    debut = files.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(run).alias("_debut"))
    j = files.join(debut, group, "left")
    return j.where(F.col(group).isNull() | (F.col(run) == F.col("_debut"))).select(*files.columns)


def shared_members(rows: DataFrame, dataset: str, member: str) -> DataFrame:
    """Members that two datasets share, for every pair of datasets. Reduced to one row per (dataset, member) first;
    the pairs come from a member's own list of datasets, which is as short as there are datasets."""
    own = rows.where(F.col(member).isNotNull()).select(dataset, member).distinct()
    lists = own.groupBy(member).agg(F.sort_array(F.collect_list(dataset)).alias("_all")).where(F.size("_all") > 1)
    a = lists.select(member, "_all", F.posexplode("_all").alias("_i", "a"))
    return a.select(F.col("a").alias("run_a"), F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("run_b"), member)


# ------------------------------------------------------------------ J8 ----

def remaining_files(runs: DataFrame, files: DataFrame, analyses: DataFrame) -> DataFrame:
    """For every unfinished run the files without an analysis row in that run; clean files are done."""
    todo = files.join(runs.where(F.col("status") != "completed").select("run_id"), "run_id", "left_semi")
    return todo.join(analyses.select("run_id", "file_id"), ["run_id", "file_id"], "left_anti").select("run_id", "file_id")


# ----------------------------------------------------------- J11 / J12 / J13 / W10 / U10 ----

def manifest_enrichment(files: DataFrame, papers: DataFrame, slug: str = "repo_name") -> DataFrame:
    """Files with the paper columns of their repo slug; of several papers that list a repo the last one wins;
    blanks where none does. ``papers``: order_no, slug, and the columns to add."""
    cols = [c for c in papers.columns if c not in (slug, "order_no")]
    last = papers.groupBy(slug).agg(F.max(F.struct("order_no", *cols)).alias("_p"))
    j = files.join(last, slug, "left")
    return j.select(*files.columns, *[F.coalesce(F.col(f"_p.{c}").cast("string"), F.lit("")).alias(c) for c in cols])


def lookup_paths(requests: DataFrame, files: DataFrame, path: str = "path", anchor: str = "files/") -> DataFrame:
    """Id of a path: an exact match, else a match of what follows the last ``anchor``; null when neither. One answer a
    request: of several files with the path the least id."""
    known = files.groupBy(F.col("file_path").alias("_p")).agg(F.min("file_id").alias("_id"))
    exact = requests.join(known, F.col(path) == F.col("_p"), "left").withColumnRenamed("_id", "_exact").drop("_p")
    tail = F.when(F.col("_exact").isNull() & F.col(path).contains(anchor), F.concat(F.lit(anchor), F.element_at(F.split(F.col(path), anchor, -1), -1)))
    j = exact.withColumn("_tail", tail).join(known, F.col("_tail") == F.col("_p"), "left")
    return j.select(*[j[c] for c in requests.columns], F.coalesce("_exact", "_id").alias("file_id"),
                    F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_id").isNotNull(), "relative").otherwise("none").alias("matched_by"))


def grandparent(ids: DataFrame, child: DataFrame, parent: DataFrame, key: str, via: str, target: str) -> DataFrame:
    """Id → parent → grandparent in two hops; ids without a parent drop, a null grandparent stays null."""
    return ids.select(key).join(child.select(key, via), key).join(parent.select(via, target), via).select(key, target)


def unique_names(files: DataFrame, group: str, name: str, order_col: str) -> DataFrame:
    """A name for every row that is unique within its group, given in input order: a name not in use is kept,
    otherwise ``stem_1.ext``, ``stem_2.ext``, … until one is free. Adds ``unique_name``.

    A null name stays null. Names can only meet names of the same family (stem without trailing ``_<number>``, and extension). A family of one
    name is numbered by a window; only families in which given and made-up names can clash are walked one by one.
    """
    ext = F.regexp_extract(F.col(name), r"^.+(\.[^.]+)$", 1)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    unnamed = files.where(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string"))
    d = files.where(F.col(name).isNotNull()).withColumn("_ext", ext).withColumn("_stem", stem).withColumn("_root", F.regexp_replace("_stem", r"(_\d+)+$", ""))
    family = [group, "_root", "_ext"]
    mixed = d.groupBy(*family).agg((F.min(name) != F.max(name)).alias("_mixed"))
    d = join_null_safe(d, mixed, family)
    k = F.row_number().over(Window.partitionBy(*family).orderBy(order_col)) - 1
    plain = d.where("not _mixed").withColumn("_k", k).withColumn(
        "unique_name", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("_"), F.col("_k").cast("string"), "_ext")))
    cols = [*files.columns, "unique_name"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        used, following, out = set(), {}, []
        for n, st, ex in zip(pdf[name], pdf["_stem"], pdf["_ext"]):
            new = n
            while new in used:
                following[n] = following.get(n, 0) + 1
                new = f"{st}_{following[n]}{ex}"
            used.add(new)
            out.append(new)
        return pdf.assign(unique_name=out)[cols]

    schema = T.StructType([*files.schema.fields]).add("unique_name", T.StringType())
    clashing = d.where("_mixed").groupBy(*family).applyInPandas(walk, schema)
    return plain.select(*cols).unionByName(clashing).unionByName(unnamed)


def orphaned_entries(cache: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Cached entries that no reference names any more (left anti join; the rest is what a clean-up keeps)."""
    return cache.join(references.select(key), key, "left_anti")
