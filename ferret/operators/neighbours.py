"""Exact nearest neighbours by cosine without the N x N result.

On the unit sphere the chord ``sqrt(2 - 2 cos)`` is a metric, so the triangle inequality says which vectors cannot be near:

1. Equal vectors become one point that stands for its ids; only the k + 1 least ids of a point can be anybody's neighbours.
2. Every point goes to its nearest pivot (at most ``MAX_PIVOTS`` hash-sampled points, broadcast). A range partitioning by
   (pivot, distance to it, id) cuts each region into rings of at most ``block`` points, so a crowded region, or one
   with a third of all points, is dealt out over many tasks; a ring is stored as one row.
3. Inside its own ring and among the pivots every point finds k neighbours; the k-th bounds what another ring must beat. A ring's points ask a
   pivot's region only for the distances ``[d(q, pivot) - bound, d(q, pivot) + bound]``; rings outside of all of them are skipped.
4. Rings come in at most ``GROUPS`` groups of neighbouring rings (more only where a group would exceed ``HELD`` points). A task is a pair
   of groups: it holds the points of one and streams those rings of the other that any of them asks for, the nearest first;
   bounds shrink on the way and points that a ring cannot serve pass it over. A task hands out at most k rows a point.

So a vector is shuffled at most twice the number of groups, however many points there are. Where points have no structure (random
directions), no bound excludes a ring and every exact method compares all pairs of points; the time is quadratic then, what is
shuffled is not.

Rows without id or vector, and vectors that are zero, hold a null, NaN or infinity, have no direction: they are no neighbours and
have no rows. Ids are taken as unique; vectors of different length are an error. Ties go to the lesser id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions.ordering import seeded_hash
from ferret.functions.staging import stage

MAX_PIVOTS, BLOCK, PIVOT_POINTS = 1024, 1024, 4096
GROUPS, HELD = 8, 1 << 17
DIGITS = 12  # similarities that agree to so many places tie
TIE, APART = 2e-12, 1e-11  # more than rounding to DIGITS moves a similarity, and than products of other shapes differ by
SLACK = 1e-6  # rounding of chords near zero
RING = "ring long, pivot int, lo double, hi double, ids binary, points binary"


def unit_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v: vectors of length 1 in double precision."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id is not null and x is not null")
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e)
    norm = x.withColumn("n", F.sqrt(square)).where("n > 0 and n < double('infinity') and not isnan(n)")
    return norm.select("id", F.transform("x", lambda e: e / F.col("n")).alias("v"))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // max(len(col), 1)
    if len(col) and (pc_lengths := np.unique(col.value_lengths().to_numpy(zero_copy_only=False))).tolist() != [width]:
        raise ValueError(f"vectors of different lengths: {pc_lengths.tolist()}")
    return flat.reshape(len(col), width)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _assign(pivots):
    def run(batches):
        p = np.frombuffer(pivots.value[0]).reshape(pivots.value[1])
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                s = b.slice(i, BLOCK)
                d = chord(matrix(s.column(1)), p)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=["id", "v", "pivot", "dist"])
    return run


def _pack(block: int):
    """Rings of at most ``block`` points of one region, from rows in order of (pivot, dist, id)."""
    def ring(number, rows: pa.Table):
        dist = rows["dist"].to_numpy()
        points = matrix(rows["v"].combine_chunks())
        return pa.RecordBatch.from_pylist([{"ring": number, "pivot": rows["pivot"][0].as_py(), "lo": dist[0], "hi": dist[-1],
                                            "ids": rows["id"].to_numpy().tobytes(), "points": points.tobytes()}], RING_ARROW)

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            pivot = held["pivot"].to_numpy()
            start = 0
            for end in np.append(np.flatnonzero(np.diff(pivot)) + 1, len(pivot)).tolist():
                while end - start >= block or (end > start and end < len(pivot)):
                    size = min(block, end - start)
                    yield ring(number, held.slice(start, size))
                    number, start = number + 1, start + size
            held = held.slice(start)
        if held is not None and len(held):
            yield ring(number, held)
    return run


RING_ARROW = pa.schema([("ring", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("points", pa.binary())])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["points"]).reshape(len(ids), -1)


class Nearest:
    """The k nearest that each of some points has met so far; ``floor`` is a similarity that the k-th is known to reach."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.points, self.k = ids, points, k
        self.sim = np.full((len(ids), k), -np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor - APART

    def meet(self, ids: np.ndarray, points: np.ndarray, rows: np.ndarray | None = None):
        """Points of other ids than those met before; ``rows``: of the own points those that may gain (default: all)."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        for i in range(0, len(rows), BLOCK):
            self._meet(ids, points, rows[i:i + BLOCK])

    def _meet(self, ids, points, rows):
        sim = self.points[rows] @ points.T
        least = np.maximum(self.sim[rows, -1], self.floor[rows])
        at, to = np.nonzero(sim >= least[:, None] - TIE)
        if len(at) > 16 * self.k * len(rows) and len(ids) > self.k + 1:  # a point itself may be among the k + 1 that reach this
            least = np.maximum(least, np.partition(sim, -self.k - 1, axis=1)[:, -self.k - 1])
            at, to = np.nonzero(sim >= least[:, None] - TIE)
        row, near, sim = rows[at], ids[to], np.round(sim[at, to], DIGITS)
        worst = self.sim[row, -1]
        gains = (near != self.ids[row]) & (sim >= self.floor[row]) & ((sim > worst) | ((sim == worst) & (near < self.near[row, -1])))
        mine = np.unique(row[gains])
        row = np.concatenate([np.repeat(mine, self.k), row[gains]])
        near, sim = np.concatenate([self.near[mine].ravel(), near[gains]]), np.concatenate([self.sim[mine].ravel(), sim[gains]])
        order = np.lexsort((near, -sim, row))
        first = order[np.searchsorted(row[order], mine)[:, None] + np.arange(self.k)]
        self.sim[mine], self.near[mine] = sim[first], near[first]

    def bound(self) -> np.ndarray:
        """Chord to the k-th nearest; 2, the diameter, while there are fewer."""
        worst = np.maximum(self.sim[:, -1], self.floor)
        return np.where(np.isinf(worst), 2.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * worst))) + SLACK


def _own(ids: np.ndarray, points: np.ndarray, k: int, p: np.ndarray, pivot_ids: np.ndarray) -> Nearest:
    """The nearest in a ring and among the pivots, which are points too: what the k-th neighbours of its points cannot fall behind."""
    own = Nearest(ids, points, k)
    own.meet(ids, points)
    other = ~np.isin(pivot_ids, ids)
    if other.any():
        own.meet(pivot_ids[other], p[other])
    return own


def _ask(pivots, k: int):
    """For each ring the regions that may hold nearer points, with the range of distances to the pivot."""
    def run(batches):
        p, pivot_ids = np.frombuffer(pivots.value[0]).reshape(pivots.value[1]), np.frombuffer(pivots.value[2], np.int64)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, points = _unpack(row)
                d, r = chord(points, p), _own(ids, points, k, p, pivot_ids).bound()[:, None]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(p), row["ring"])), pa.array(np.arange(len(p), dtype=np.int32)),
                    pa.array((d - r).min(axis=0)), pa.array((d + r).max(axis=0))], names=["asker", "region", "least", "most"])
    return run


def _search(pivots, k: int):
    """Streams the rings of each task: first those that ask (kind 0), then those that are asked for."""
    def run(batches):
        p, pivot_ids = np.frombuffer(pivots.value[0]).reshape(pivots.value[1]), np.frombuffer(pivots.value[2], np.int64)
        task, held, best = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, points = _unpack(row)
                if row["task"] != task:
                    if best is not None:
                        yield from _found(best)
                    task, held, best = row["task"], [], None
                if row["kind"] == 0:
                    held.append((ids, points, _own(ids, points, k, p, pivot_ids).sim[:, -1]))
                    continue
                if best is None:
                    ask, at, floor = (np.concatenate(x) for x in zip(*held))
                    best, held = Nearest(ask, at, k, floor), []
                to = chord(best.points, p[row["pivot"]][None])[:, 0]
                gap = np.maximum(to - row["hi"], row["lo"] - to)
                best.meet(ids, points, np.flatnonzero(gap <= best.bound()))
        if best is not None:
            yield from _found(best)
    return run


def _found(best: Nearest):
    for i in range(0, len(best.ids), BLOCK):
        sim, ids, near = best.sim[i:i + BLOCK], best.ids[i:i + BLOCK], best.near[i:i + BLOCK]
        ok = ~np.isinf(sim)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(near[ok]), pa.array(sim[ok])], names=["point", "other", "similarity"])


def rings_and_pairs(points: DataFrame, k: int, block: int, per_pivot: int):
    """The staged rings of ``points`` with their group, the (asking group, near ring) rows with the near ring's content, and the broadcast
    pivots."""
    spark = points.sparkSession
    total = points.count()
    chosen = points.orderBy(seeded_hash(7, "id")).limit(min(MAX_PIVOTS, max(1, -(-total // per_pivot)))).select("id", "v").collect()  # at most MAX_PIVOTS
    if not chosen:
        return None
    p = np.array([r.v for r in chosen], float).reshape(len(chosen), -1)
    pivots = spark.sparkContext.broadcast((p.tobytes(), p.shape, np.array([r.id for r in chosen], np.int64).tobytes()))
    dealt = points.mapInArrow(_assign(pivots), "id long, v array<double>, pivot int, dist double")
    rings = stage(dealt.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id").mapInArrow(_pack(block), RING), "rings")
    groups = max(min(GROUPS, -(-total // block)), -(-total // HELD))
    cuts = rings.select(F.percentile_approx("ring", [i / groups for i in range(1, groups)] or [1.0], 10_000)).first()[0]  # one a group
    group = lambda ring: F.size(F.filter(F.lit(cuts), lambda c: c < F.col(ring)))
    rings = rings.withColumn("group", group("ring"))
    asked = rings.mapInArrow(_ask(pivots, k), "asker long, region int, least double, most double")
    near = rings.select("ring", F.col("pivot").alias("region"), "lo", "hi")
    pairs = asked.join(near, "region").where("hi >= least and lo <= most")
    away = F.greatest(F.col("lo") - F.col("most"), F.col("least") - F.col("hi"))  # how little the ranges overlap
    pairs = stage(pairs.groupBy(group("asker").alias("asker"), "ring").agg(F.min(away).alias("away")), "pairs")  # at most the rings for each group
    return rings, pairs.join(rings, "ring"), pivots


def nearest_points(points: DataFrame, k: int, block: int = BLOCK, per_pivot: int = PIVOT_POINTS) -> DataFrame:
    """(point, other, similarity): the ``k`` nearest of every one of the distinct unit vectors ``points`` (id, v)."""
    found = rings_and_pairs(points, k, block, per_pivot)
    if found is None:
        return points.sparkSession.createDataFrame([], "point long, other long, similarity double")
    rings, payload, pivots = found
    groups = rings.agg(F.max("group")).first()[0] + 1
    tasks = payload.select("asker", F.col("group").alias("near")).distinct()
    content = ["ring", "pivot", "lo", "hi", "ids", "points"]
    task = lambda asker, near: (F.col(asker) * groups + F.col(near)).cast("int").alias("task")
    first = rings.join(tasks.withColumnRenamed("asker", "group"), "group").select(task("group", "near"), F.lit(0).alias("kind"), F.lit(0.0).alias("away"), *content)
    then = payload.select(task("asker", "group"), F.lit(1).alias("kind"), "away", *content)
    streamed = first.unionByName(then).repartitionById(groups * groups, "task").sortWithinPartitions("task", "kind", "away", "ring")
    each = streamed.mapInArrow(_search(pivots, k), "point long, other long, similarity double")
    rank = F.row_number().over(Window.partitionBy("point").orderBy(F.col("similarity").desc(), "other"))  # at most k of each group
    return each.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def nearest_neighbours(vectors: DataFrame, id_col: str, vector: str, k: int, block: int = BLOCK, per_pivot: int = PIVOT_POINTS) -> DataFrame:
    """Id, rank (from 1), neighbour_id, similarity: the ``k`` other rows of highest cosine, ties by the lesser id."""
    rows = unit_vectors(vectors, id_col, vector).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))
    points = stage(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.any_value("v").alias("v")), "points")
    members = rows.select("id", "h1", "h2").join(points.select("h1", "h2", F.col("id").alias("point")), ["h1", "h2"]).select("id", "point")
    place = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    least = members.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("point").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1
    found = nearest_points(points.select("id", "v"), k, block, per_pivot)
    own = least.select("point", F.lit(1.0).alias("similarity"), "ids")
    far = found.join(least.withColumnRenamed("point", "other"), "other").select("point", "similarity", "ids")
    one = own.unionByName(far).select("point", F.explode("ids").alias("near"), "similarity")
    rank = F.row_number().over(Window.partitionBy("point").orderBy(F.col("similarity").desc(), "near"))
    lists = (one.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("point")
             .agg(F.sort_array(F.collect_list(F.struct("rank", "near", "similarity"))).alias("list")))  # at most k + 1
    others = members.join(lists, "point").select("id", F.slice(F.filter("list", lambda e: e["near"] != F.col("id")), 1, k).alias("list"))
    return others.select("id", F.posexplode("list").alias("pos", "e")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("e.near").alias("neighbour_id"), F.col("e.similarity").alias("similarity"))
