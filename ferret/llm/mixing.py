"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the sorted set of their
sources); a flow then routes the patterns' word capacity to the sources' quotas. A pattern's capacity comes in
``max_repeats`` layers of its size, layer ``k`` costing ``k * k`` a word, so repetition is convex: the flow takes
every document once before it takes one twice. The flow network has one node per pattern and source and is
solved on the driver; its size is checked against ``max_patterns`` and does not grow with the documents. The
routed words are then filled with whole documents in the order of a seeded hash.

Edge cases: a null source is a source of its own, ordered last; null or empty texts have size 0 and are never
taken; an empty table gives an empty result; repeated rows are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.llm.common import SMALL_SLICE, Text, slices, stage

BUCKETS, END_DOCS = 4096, 256


def sizes(docs: DataFrame, sources: str = "source") -> DataFrame:
    """doc_id, sources (sorted array, null last), size (words), order: a seeded hash that does not depend on partitions."""
    def count(batches):
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                t = Text(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sources"), pa.array(np.diff(t.wptr))], names=["doc_id", "sources", "size"])

    col = F.col(sources)
    is_array = dict(docs.dtypes)[sources].startswith("array")
    member = F.array_sort(F.array_distinct(F.when(F.size(col) > 0, col).otherwise(F.array(F.lit(None).cast("string"))))) if is_array else F.array(col)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), member.alias("sources"), "text")
    return src.mapInArrow(count, "doc_id long, sources array<string>, size long")


def quotas(size_of: dict, weights: list[int], max_repeats: int, total: int) -> dict:
    """Targets: the total size of all documents shared by weight; a target stops at ``max_repeats`` times its source's size and the
    excess is reshared by weight among the others until none is above. Exact rational arithmetic."""
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), Fraction(total)
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > max_repeats * size_of[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in open_}
            break
        for s in over:
            target[s] = Fraction(max_repeats * size_of[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    return target


def route(capacity: dict[tuple, int], quota: dict, layers: int) -> dict[tuple, dict]:
    """Min-cost flow by successive shortest paths. ``capacity``: pattern -> words; ``quota``: source -> words.
    Returns pattern -> {source: words}. Edges: start -> pattern (one per layer, cost (k+1)^2), pattern -> member
    source, source -> end. Paths are found by breadth-first label correction; every augmentation fills an edge."""
    pats, srcs = list(capacity), list(quota)
    n = len(pats) + len(srcs) + 2
    s, t = n - 2, n - 1
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []

    def edge(a, b, c, w):
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, 0))
        cost.extend((w, -w))

    for i, p in enumerate(pats):
        for k in range(layers):
            edge(s, i, capacity[p], (k + 1) ** 2)
    inner = {}
    for i, p in enumerate(pats):
        for j, q in enumerate(srcs):
            if q in p:
                inner[len(to)] = (p, q)
                edge(i, len(pats) + j, layers * capacity[p], 0)
    for j, q in enumerate(srcs):
        edge(len(pats) + j, t, quota[q], 0)
    while True:
        dist, via, queue, waiting = [None] * n, [None] * n, deque([s]), {s}
        dist[s] = 0
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in graph[a]:
                b = to[e]
                if cap[e] > 0 and (dist[b] is None or dist[a] + cost[e] < dist[b]):
                    dist[b], via[b] = dist[a] + cost[e], e
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        if dist[t] is None:
            break
        push, b = None, t
        while b != s:
            push = cap[via[b]] if push is None else min(push, cap[via[b]])
            b = to[via[b] ^ 1]
        b = t
        while b != s:
            cap[via[b]] -= push
            cap[via[b] ^ 1] += push
            b = to[via[b] ^ 1]
    out: dict[tuple, dict] = {p: {} for p in pats}
    for e, (p, q) in inner.items():
        if cap[e ^ 1]:
            out[p][q] = cap[e ^ 1]
    return out


def mix_sources(docs: DataFrame, sources: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3,
                seed: int = 17, max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """One row per document: doc_id, sources, size, repeats (0..max_repeats), taken (= size * repeats); and one per
    source: source, source_size, target.

    ``sources`` is a string column or an array of strings (overlapping sources). Every document of a pattern is
    taken ``floor(flow / capacity)`` times; the rest is filled once more by documents in the order of their seeded
    hash: whole hash buckets by their totals, then document by document where the quota ends, taking each that
    still fits.
    """
    spark = docs.sparkSession
    rank = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    table = stage(sizes(docs, sources).withColumn("order", rank).withColumn("bucket", (F.col("order") / F.lit((1 << 40) // BUCKETS)).cast("int")), "sizes")
    pats = table.groupBy("sources").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(pats) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r.sources): r["size"] for r in pats}
    size_of: dict = {}
    for p, c in capacity.items():
        for s in p:
            size_of[s] = size_of.get(s, 0) + c
    target = quotas(size_of, list(weights), max_repeats, sum(capacity.values()))
    # a document of several sources counts in each source's size, so the targets can exceed what there is: the flow is what is possible
    flow = route(capacity, {s: round(x) for s, x in target.items()}, max_repeats)
    plan = []
    for p, c in capacity.items():
        words = sum(flow[p].values())
        whole = min(words // c, max_repeats) if c else 0
        plan.append((list(p), int(whole), int(words - whole * c)))
    plan_df = spark.createDataFrame(plan, "sources array<string>, whole long, rest long")
    key = F.to_json(F.struct("sources")).alias("pattern")
    plan_df = F.broadcast(plan_df.select(key, "whole", "rest"))  # at most max_patterns rows
    rows = table.withColumn("pattern", F.to_json(F.struct("sources"))).join(plan_df, "pattern")
    # where the rest of a pattern ends: totals by hash bucket, at most BUCKETS rows a pattern. The documents of the
    # bucket in which it ends and of the next ones, until END_DOCS are there, are looked at one by one.
    bucket = rows.where("rest > 0").groupBy("pattern", "rest", "bucket").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("*", F.coalesce(F.sum("b").over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("docs"))
    first = bucket.where("before < rest").groupBy("pattern").agg(F.max(F.struct("bucket", "before", "docs")).alias("at"))
    ends = bucket.join(F.broadcast(first), "pattern").where((F.col("bucket") >= F.col("at.bucket")) & (F.col("docs") - F.col("at.docs") < END_DOCS)).groupBy("pattern").agg(
        F.first("at.bucket").alias("last"), F.first("at.before").alias("before"), F.max("bucket").alias("until"))
    rows = rows.join(F.broadcast(ends), "pattern", "left")  # at most max_patterns rows
    inside = rows.where("rest > 0 and bucket between last and until")
    fill = inside.select("pattern", "order", "doc_id", "size", (F.col("rest") - F.col("before")).alias("room"))

    def fit(pdf):
        pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable")
        room, take = int(pdf["room"].iloc[0]), []
        for x in pdf["size"]:
            take.append(bool(x <= room and x > 0))
            room -= x if take[-1] else 0
        # a last document that overshoots by less than what is missing comes nearer
        rest = [(x, i) for i, (x, t) in enumerate(zip(pdf["size"], take)) if not t and 0 < x < 2 * room]
        if rest:
            take[min(rest)[1]] = True
        return pdf.assign(extra=np.array(take, bool))[["pattern", "order", "doc_id", "size", "extra"]]

    got = fill.groupBy("pattern").applyInPandas(fit, "pattern string, order long, doc_id long, size long, extra boolean")
    # equal rows of the end bucket are interchangeable: take as many of them as were chosen
    got = got.where("extra").groupBy("pattern", "order", F.col("doc_id").alias("id"), F.col("size").alias("words")).agg(F.count(F.lit(1)).alias("chosen"))
    near = inside.withColumn("copy", F.row_number().over(Window.partitionBy("pattern", "order", "doc_id", "size").orderBy("size")))
    near = near.join(got, (near.pattern == got.pattern) & (near.order == got.order) & near.doc_id.eqNullSafe(got.id) & (near["size"] == got.words), "left").select(
        near.doc_id, near.sources, near["size"], (near.whole + (F.coalesce("chosen", F.lit(0)) >= F.col("copy")).cast("long")).alias("repeats"))
    far = rows.where("not (rest > 0 and bucket between last and until)").select(
        "doc_id", "sources", "size", (F.col("whole") + ((F.col("rest") > 0) & (F.col("bucket") < F.col("last"))).cast("long")).alias("repeats"))
    out = far.unionByName(near).withColumn("repeats", F.when(F.col("size") > 0, F.least("repeats", F.lit(max_repeats))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("taken", F.col("size") * F.col("repeats"))
    targets = spark.createDataFrame([(s, int(size_of[s]), float(target[s])) for s in size_of], "source string, source_size long, target double")
    return out, targets


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, size, source_size, target, taken (and source) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m, targets = mix_sources(docs)
    t = F.broadcast(targets.withColumnRenamed("source", "name"))  # one row per source, checked by max_patterns
    m = m.withColumn("source", F.col("sources")[0])
    return m.join(t, F.col("source").eqNullSafe(F.col("name")), "left").select("doc_id", "source", "size", "source_size", "target", "taken")
