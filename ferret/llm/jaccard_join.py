"""Exact Jaccard join of shingle sets in the metric space of Jaccard distance.

1. *Sets.* A document is the set of its distinct word shingles (64-bit hashes); equal sets are one point, named by a
   128-bit digest.
2. *Pivots.* Points within the radius ``r = 1 - threshold`` differ in at most ``delta`` shingles, a bound that follows
   from the larger size. The hash space is cut into more ranges than that, so such points agree in at least one whole
   range (``Signatures``). The point with the least name among those that agree is the pivot, and each point is
   attached to the pivots of its ranges. Points of different attached clusters are farther apart than ``r``,
   so clusters are regions that need no replication.
3. *Voronoi regions.* From a region of more than ``max_members`` points (or ``max_shingles`` shingles) the points go that share too few
   shingles with all others of the region together, again and again; what is left is cut where points share none
   of their rare shingles; if it is still larger it elects pivots; every
   point goes to its nearest pivot's region and, by the triangle inequality, also to those of pivots at most ``2 r``
   farther: two points within ``r`` meet in the region of either. Regions split again until they are small. Where the
   windows keep a region from shrinking, it is dealt out in pairs of blocks, which is exact too. What is dealt out is decided on names
   before sets are copied, and sets and shingles are shuffled a part at a time, so the disk does not grow faster than the input.
4. *Leaves.* A small region is joined in one task: it falls apart by its rarest shingles where these are not shared, then
   splits recursively by pivots of its own, and is joined at the end by exact intersection counts of all its points at
   once. A leaf gives each point's least linked name (a spanning forest) and its number of links, not the pairs: a group
   of many near copies costs a row a point.

Edge cases: null texts and texts without words have the empty set, which links with nothing (component = own doc_id);
shorter texts than the shingle have their whole word sequence as one shingle; rows that repeat a doc_id each give a
row, and the component is the least doc_id of all rows it reaches; a null doc_id gets the least non-null doc_id of its
component, or null; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.llm.common import SMALL_SLICE, Text, U, drop_staged, long_array, mix64, slices, stage, windows_hash
from ferret.llm.components import components

NO_ID = -(1 << 63)
POINT = ["region", "digest", "n", "copies", "set", "core", "side"]
PIVOTS, SPLIT_PIVOTS, LEAF, COUNTS = 16, 4, 512, 1 << 20
PASSES, NAMES, CHUNK = 4, 1 << 18, 1 << 20  # parts in which a large shuffle is worked; names that are broadcast; shingles a slice


# ---------------------------------------------------------------- sets and signatures

def shingle_sets(t: Text, k: int):
    """The sorted distinct shingle hashes of every document of the slice."""
    h = t.word_hashes()
    w = windows_hash(h, k)
    for a, b in zip(t.wptr[:-1].tolist(), t.wptr[1:].tolist()):
        yield np.unique(w[a:b - k + 1]) if b - a >= k else windows_hash(h[a:b], b - a) if b > a else np.empty(0, U)


def digest(s: np.ndarray) -> bytes:
    n = U(len(s))
    return np.array([mix64(s).sum(dtype=U) + n, mix64(s ^ U(0xC2B2AE3D27D4EB4F)).sum(dtype=U) ^ n], U).tobytes()


class Signatures:
    """Hashes of parts of a set such that sets within the radius have one in common.

    The hash space is cut into equal ranges; sets that differ in at most ``delta`` elements agree in all but ``delta``
    ranges. The number of ranges is from a ladder and is fixed by the larger of two sizes; a set emits the signatures
    of all sizes a partner may have. Empty parts get none. There are ``spare`` ranges more than needed, so a set with
    no more empty parts than that agrees with its partners in elements; where both sets have more, they meet by
    their prefixes: the least elements, as many as a partner may lack, and one.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ladder, m = [1], 3
        while m < 1 << 22:
            self.ladder.append(m)
            m = max(m + 1, math.ceil(m * 1.3))
        self.spare = {m: 0 if m == 1 else 1 + m // (16 if 10 * num >= 9 * den else 8) + 2 * (m >= 8) for m in self.ladder}
        self.caps = np.array([m - self.spare[m] - 1 for m in self.ladder])
        self.edges: dict[int, np.ndarray] = {}
        self.salt: dict[int, np.ndarray] = {}

    def delta(self, size: int) -> int:
        """Most elements in which two sets of at most ``size`` elements may differ."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def ranges(self, n: int) -> list[int]:
        low = int(np.searchsorted(self.caps, self.delta(n)))
        high = int(np.searchsorted(self.caps, self.delta(n * self.den // self.num)))
        return self.ladder[low:high + 1]

    def of(self, s: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(s) + 1, U)
        np.cumsum(mix64(s ^ U(0x165667B19E3779F9)), out=acc[1:])
        out = []
        for m in self.ranges(len(s)):
            if m not in self.edges:
                self.edges[m] = np.array([-(-(i << 64) // m) for i in range(1, m)], U)
                self.salt[m] = mix64(np.arange(m, dtype=U) + U(m << 24))
            at = np.concatenate([[0], np.searchsorted(s, self.edges[m]), [len(s)]])
            full = np.diff(at) > 0
            out.append(mix64((acc[at[1:]] - acc[at[:-1]]) + self.salt[m])[full])
            if m - int(full.sum()) > self.spare[m]:
                out.append(mix64(s[:len(s) - -(-len(s) * self.num // self.den) + 1] + U(m)))
        return np.concatenate(out)


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n and digest (null for an empty set) of every row, and node: 64 bits of the digest."""
    def run(batches):
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                sets = list(shingle_sets(Text(part.column("text"), lower=True), k))
                names = [digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([d and _node(d) for d in names], pa.int64())],
                    names=["doc_id", "th", "n", "digest", "node"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, n long, digest binary, node long")


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, node) of every set; a task emits equal sets once."""
    def run(batches):
        sig, seen = Signatures(num, den), set()
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                rows, nodes = [np.empty(0, U)], []
                for s in shingle_sets(Text(part.column("text"), lower=True), k):
                    d = digest(s) if len(s) else None
                    if d is None or d in seen:
                        continue
                    if len(seen) > 1 << 19:  # forgetting only costs repeated rows
                        seen.clear()
                    seen.add(d)
                    rows.append(sig.of(s))
                    nodes.append(_node(d))
                yield pa.RecordBatch.from_arrays([long_array(np.concatenate(rows)), pa.array(np.repeat(np.array(nodes, np.int64), [len(r) for r in rows[1:]]))], names=["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig long, node long")


# ---------------------------------------------------------------- joins inside a region

def linked(i, a, b, num, den):
    """Whether intersection ``i`` of sets of sizes ``a`` and ``b`` reaches the threshold; integers only."""
    return den * i >= num * (a + b - i)


def near_pairs(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the sets link, as a matrix with a true diagonal, by exact intersection counts of all pairs at once."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    owner, common = np.repeat(np.arange(n), size), df[inverse] > 1
    owner, col = owner[common], number[inverse[common]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    columns = int(col[-1]) + 1 if len(col) else 0
    width = min(4096, columns)
    count = np.zeros((n, n), np.float32)
    for lo in range(0, columns, max(width, 1)):
        a, b = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], col[a:b] - lo] = 1
        count += m @ m.T
    near = linked(count.astype(np.int64), size[:, None], size[None, :], num, den)
    np.fill_diagonal(near, True)
    return near


def _labels(near: np.ndarray) -> np.ndarray:
    """Least index of everyone's component, by minima that pass along the links."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(np.where(near, label[None, :], len(near)).min(axis=1), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def separate(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Label of every set such that sets with different labels do not link. Elements are ordered by how many sets of
    the region hold them; linked sets share one of their first (rarest) elements, as many as a partner may lack and one. So
    texts that were attached by a common passage fall apart, since its shingles are the frequent ones."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    flat = np.concatenate(sets)
    order = np.argsort(flat)  # one large array at a time: a region may hold some million shingles
    flat = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    del flat
    rank = np.cumsum(new, dtype=np.int32) - 1
    token = np.empty(len(rank), np.int32)
    token[order] = rank
    del order, new
    df = np.bincount(rank).astype(np.int32)
    del rank
    lead = size + size * -num // den + 1
    kept = []
    for a, z, k in zip((ends - size).tolist(), ends.tolist(), lead.tolist()):
        mine = token[a:z]
        key = df[mine].astype(np.int64) << 32 | mine
        kept.append(mine if k >= len(mine) else mine[np.argpartition(key, k - 1)[:k]])
    owner, token = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in kept]), np.concatenate(kept)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    same = token[1:] == token[:-1]
    a, b = owner[:-1][same], owner[1:][same]
    label = np.arange(len(sets))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def join_region(sets: list[np.ndarray], num: int, den: int, weight: np.ndarray | None = None, core: np.ndarray | None = None,
                side: np.ndarray | None = None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Of every set of one region: the least index of its component, and its links, each counted ``weight`` times.

    A point is ``core`` in the one region that is its own and a guest in others: links count where a point is core,
    and each meets its points there. In a pair of blocks (``side`` names the block, -1 elsewhere) links inside a block do
    not count, as the block has a region of its own.
    """
    n = len(sets)
    parent, links = np.arange(n), np.zeros(n, np.int64)
    weight = np.ones(n, np.int64) if weight is None else weight
    core = np.ones(n, bool) if core is None else core
    cross = side is not None and (side >= 0).any()

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(members, own, block=None):
        if len(members) < 2:
            return
        near = near_pairs([sets[i] for i in members], num, den)
        label = _labels(near)
        for x, y in zip(members.tolist(), members[label].tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
        np.fill_diagonal(near, False)
        for part in (side[members] if cross else None, block):
            if part is not None:
                near &= part[:, None] != part[None, :]
        links[members] += np.where(own, near @ weight[members], 0)

    todo = [(np.arange(n), core)]
    if n > leaf:
        label = separate(sets, num, den)
        order = np.argsort(label, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
        todo = [(part, core[part]) for part in parts]
    while todo:
        members, own = todo.pop()
        if len(members) <= leaf:
            join(members, own)
            continue
        dist = np.stack([_distances([sets[i] for i in members], sets[p]) for p in _spread(members)], axis=1)
        home = dist.argmin(axis=1)
        slack = dist[np.arange(len(members)), home] + 2 * (1 - num / den) + 1e-9
        children = [(dist[:, q] <= slack, own & (home == q)) for q in range(dist.shape[1])]
        children = [(members[inside], mine[inside]) for inside, mine in children if mine.any()]
        if all(len(c) <= 0.8 * len(members) for c, _ in children):
            todo += children
            continue
        half = leaf // 2  # the windows hold nearly all: blocks, and pairs of blocks
        for a in range(0, len(members), half):
            join(members[a:a + half], own[a:a + half])
            for b in range(a + half, len(members), half):
                both, mine = (np.concatenate([x[a:a + half], x[b:b + half]]) for x in (members, own))
                join(both, mine, np.arange(len(both)) < half)
    return np.array([root(x) for x in range(n)]), links


def _spread(members: np.ndarray) -> np.ndarray:
    """Pivots of a region: evenly through its points, which are in the order of their hashed names."""
    return members[np.linspace(0, len(members) - 1, min(PIVOTS, len(members))).astype(int)]


def _distances(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    hit = np.concatenate([[0], np.cumsum(pivot[at] == flat)])
    ends = np.cumsum(size)
    i = hit[ends] - hit[ends - size]
    return 1 - i / (size + len(pivot) - i)


# ---------------------------------------------------------------- Spark

def _region_sets(docs: DataFrame, members: DataFrame, k: int, repeated: bool) -> DataFrame:
    """region, digest, n, copies and the set itself (8 bytes a shingle) of every member, once. ``repeated``: whether rows
    of ``docs`` repeat both doc_id and text."""
    def run(batches):
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                want = part.column("digest").to_pylist()
                keep, blobs = [], []
                for i, s in enumerate(shingle_sets(Text(part.column("text"), lower=True), k)):
                    if len(s) and digest(s) == want[i]:  # another text may have the same doc_id and hash
                        keep.append(i)
                        blobs.append(s.tobytes())
                rows = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("region", "digest", "n", "copies")], pa.array(blobs, pa.binary())], names=["region", "digest", "n", "copies", "set"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    texts = (texts.distinct() if repeated else texts).withColumn("th", F.xxhash64("text"))
    points = texts.join(members, ["doc_id", "th"]).select("region", "digest", "n", "copies", "text").mapInArrow(run, "region long, digest binary, n long, copies long, set binary")
    return points.select("*", F.lit(True).alias("core"), F.lit(-1).alias("side"))


def _grouped(batches, key: str):
    """Consecutive rows with the same key, as (key, list of batches); rows arrive sorted by it."""
    name, held = None, []
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if held and keys[i] != name:
                yield name, held
                held = []
            name = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield name, held


def _views(col: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, as views of its buffer."""
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = (np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]).tolist()
    return [np.frombuffer(data, U, (z - a) // 8, a) for a, z in zip(off[:-1], off[1:])]


def _leaves(regions: DataFrame, num: int, den: int) -> DataFrame:
    """(digest, root, links): each point's least linked point within its region, and its links with the copies of others."""
    def run(batches):
        for _, group in _grouped(batches, "region"):
            column = lambda c: [x for g in group for x in g.column(c).to_pylist()]  # noqa: E731,B023
            names, sets = column("digest"), [x for g in group for x in _views(g.column("set"))]
            root, links = join_region(sets, num, den, np.array(column("copies")), np.array(column("core"), bool), np.array(column("side")))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[r] for r in root.tolist()], pa.binary()), pa.array(links)], names=["digest", "root", "links"])

    rows = regions.select("region", "digest", "copies", "set", "core", "side").repartition("region").sortWithinPartitions("region", "digest")
    return rows.mapInArrow(run, "digest binary, root binary, links long")


def _split(big: DataFrame, sizes: DataFrame, num: int, den: int, max_members: int) -> DataFrame:
    """One level of Voronoi regions with windows, as names: region, parent, digest, core. Members are dealt out in salted
    blocks, the pivots go to each."""
    salts = sizes.select("region", F.ceil(F.col("budget") / max_members).cast("int").alias("salts"))
    rows = big.join(salts, "region")
    rank = F.row_number().over(Window.partitionBy("region").orderBy("digest"))  # a few rows leave each region: planned as a group limit
    pivots = rows.withColumn("rank", rank).where(F.col("rank") <= SPLIT_PIVOTS).drop("rank")
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(0))
    rest = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int")).withColumn("kind", F.lit(1))
    dealt = rest.unionByName(pivots).repartition("region", "salt").sortWithinPartitions("region", "salt", "kind", "digest")
    radius = 1 - num / den
    columns, kinds = ["region", "parent", "digest", "core"], [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(columns), kinds)], names=columns)

    def run(batches):
        at, pivot = None, []
        for b in batches:
            rows = []
            for region, salt, kind, name, blob, core in zip(*[b.column(c).to_pylist() for c in ("region", "salt", "kind", "digest", "set", "core")]):
                if (region, salt) != at:
                    at, pivot = (region, salt), []
                if kind == 0:
                    pivot.append(np.frombuffer(blob, U))
                    continue
                dist = np.array([_distances([np.frombuffer(blob, U)], p)[0] for p in pivot])
                home = int(dist.argmin())
                to = np.flatnonzero(dist <= dist[home] + 2 * radius + 1e-9)
                child = mix64(U(region & (1 << 64) - 1) + to.astype(U) + U(1)).view(np.int64)
                rows += [(c, region, name, core and q == home) for c, q in zip(child.tolist(), to.tolist())]
            yield frame(rows)

    return dealt.select("region", "salt", "kind", "digest", "set", "core").mapInArrow(run, "region long, parent long, digest binary, core boolean")


def _block_numbers(sizes: DataFrame, max_members: int) -> DataFrame:
    return sizes.select("region", F.least(F.ceil(2 * F.col("budget") / max_members), F.greatest("members", F.lit(2))).cast("int").alias("blocks"))


def _blocks(stuck: DataFrame, numbers: DataFrame, begin: int, end: int) -> DataFrame:
    """Regions that windows keep from shrinking, as blocks and pairs of blocks of half the size: every pair of points meets. Of
    these the ones whose block numbers add up to ``begin`` to ``end - 1``, modulo their number: a point is in one pair of each sum."""
    rows = stuck.drop("side").join(numbers, "region").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "digest"), F.col("blocks")).cast("int"))
    total = F.explode(F.sequence(F.lit(begin), F.least(F.lit(end), "blocks") - 1))
    rows = rows.where(F.col("blocks") > begin).withColumn("total", total).withColumn("other", F.pmod(F.col("total") - F.col("own"), F.col("blocks")))
    return rows.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "digest", "n", "copies", "set", "core",
                       F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side"))


def _by_rare_shingles(big: DataFrame, num: int, den: int) -> DataFrame:
    """Large regions cut where no link can be: ``separate`` for regions beyond a task. Linked sets share one of their first shingles
    in any order of shingles; here the order is by how many sets hold a shingle, as a table of ``COUNTS`` hashed counts says, which
    has a fixed size, is added up map-side and broadcast. Of a linked pair the smaller set is not below the threshold times the larger one, and
    has the common shingle among fewer first ones (``index``); a set joins the next smaller one with the shingle among these, through which
    it reaches all it may link with. Points that meet no other have no links and go."""
    def count(batches):
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            for s in _views(b.column("set")):
                np.add.at(total, (s % U(COUNTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["cell", "n"])

    counted = big.select("set").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTS rows
    held = np.zeros(COUNTS, np.int32)
    held[counted.column("cell").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 31) - 1)
    shipped = big.sparkSession.sparkContext.broadcast(held)  # 4 MB

    def first(batches):
        often = shipped.value
        for b in batches:
            regions, names, sigs, index = b.column("region").to_numpy(), b.column("digest"), [], []
            for s, r in zip(_views(b.column("set")), regions.astype(np.uint64)):
                k = len(s) - -(-len(s) * num // den) + 1
                order = np.lexsort((s, often[(s % U(COUNTS)).astype(np.int64)]))[:k]
                sigs.append(mix64(s[order] ^ mix64(r[None] + U(5))))
                index.append(np.arange(k) <= len(s) - -(-2 * len(s) * num // (num + den)))
            of = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            yield pa.RecordBatch.from_arrays([long_array(np.concatenate(sigs) if sigs else np.empty(0, U)), names.take(pa.array(of)), b.column("n").take(pa.array(of)),
                                              pa.array(np.concatenate(index) if index else np.empty(0, bool))], names=["sig", "digest", "n", "index"])

    lead = big.select("region", "digest", "set", "n").mapInArrow(first, "sig long, digest binary, n long, index boolean")
    before = Window.partitionBy("sig").orderBy("n", "digest").rowsBetween(Window.unboundedPreceding, -1)
    below = F.last(F.when(F.col("index"), F.struct("n", "digest")), ignorenulls=True).over(before)
    met = lead.withColumn("below", below).where(F.col("below.n") * den >= F.col("n") * num)
    near = met.select(F.col("digest").alias("a"), F.col("below.digest").alias("b")).where("a <> b")
    parts = components(near).select(F.col("node").alias("digest"), F.xxhash64("root").alias("part"))
    return _restaged(big, parts, ["digest"], [F.xxhash64("region", "part").alias("region"), *big.columns[1:]], "separated")


def _restaged(rows: DataFrame, names: DataFrame, on: list[str], columns: list, tag: str) -> DataFrame:
    """``columns`` of ``rows`` joined with ``names``, stored. The sets of ``rows`` are not shuffled where the names are few, else
    a part at a time."""
    if names.count() <= NAMES:
        return stage(rows.join(F.broadcast(names), on).select(*columns), tag)
    part = lambda d, p: d.where(F.pmod(F.xxhash64(F.lit(2), "digest"), F.lit(PASSES)) == p)
    first, *more = [part(rows, p).join(part(names, p), on).select(*columns) for p in range(PASSES)]
    return stage(first, tag, *more)


def _sharing(big: DataFrame, num: int, den: int) -> DataFrame:
    """digest of the points that may link: a linked point shares at least the threshold's part of its shingles with one other, so with
    all others of its region together. A shingle that a task sees twice in one slice is counted there and sent once, so a frequent
    one crowds no key. Counted for a part of the hash space at a time. Equal hashes of different points only keep a point."""
    def keys(p):
        def run(batches):
            for b in batches:
                regions, nodes, sets = b.column("region").to_numpy().astype(np.uint64), b.column("node").to_numpy(), _views(b.column("set"))
                size = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(size)
                i = 0
                while i < len(sets):
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + CHUNK, side="right")))
                    owner = np.repeat(np.arange(i, j), size[i:j])
                    key = mix64(np.concatenate(sets[i:j]) ^ mix64(regions + U(5))[owner])
                    mine = key % U(PASSES) == p
                    key, owner = key[mine], owner[mine]
                    order = np.argsort(key, kind="stable")
                    key, owner = key[order], owner[order]
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
                    times = np.diff(np.append(first, len(key)))
                    known = np.bincount(owner[np.repeat(times > 1, times)] - i, minlength=j - i)
                    at = np.flatnonzero(known)
                    once = pa.array(nodes[owner[first]], mask=times > 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.concat_arrays([long_array(key[first]), pa.array(nodes[i + at])]), pa.concat_arrays([once, pa.array(nodes[i + at])]),
                        pa.array(np.concatenate([np.zeros(len(first), np.int64), known[at]]))], names=["key", "node", "known"])
                    i = j
        return run

    named = big.withColumn("node", F.xxhash64("digest"))
    counted = []
    for p in range(PASSES):
        rows = named.select("region", "node", "set").mapInArrow(keys(p), "key long, node long, known long")
        rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("node is not null and (known > 0 or n > 1)")
        counted.append(stage(rows.groupBy("node").agg(F.sum(F.greatest("known", F.lit(1))).alias("shared")), "shared"))
    shared = reduce(DataFrame.unionByName, counted).groupBy("node").agg(F.sum("shared").alias("shared"))
    out = stage(named.select("digest", "n", "node").join(shared, "node").where(F.col("shared") * den >= F.col("n") * num).select("digest"), "sharing")
    drop_staged(*counted)
    return out


def region_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))


def join_points(points: DataFrame, sizes: DataFrame, num: int, den: int, max_members: int, max_shingles: int) -> DataFrame:
    """(digest, root, links): roots connect exactly the points which chains of pairs within the radius connect, and the
    links of a digest add up to its number of linked documents with other sets. ``points``: region, digest, n, copies,
    set, core, side; pairs in different regions are known to be farther apart. ``sizes``: their region_sizes.

    What a level finds is stored before the next one begins, so that only the sets of one level and of the next are on disk."""
    found, level, held, cut = None, points.select(*POINT), None, False

    def leaves(rows):
        return _union(found, stage(_leaves(rows, num, den), "leaves"))
    while True:
        large = stage(sizes.where((F.col("members") > max_members) | (F.col("shingles") > max_shingles)).where("members > 1"), "large")
        if large.isEmpty():
            found = leaves(level)
            drop_staged(large, *([held] if held is not None else []))
            return found
        if held is None:
            level = held = stage(level, "level")
        # a large region is dealt out by its members or its shingles, whichever are more; whether it shrinks is judged by its members
        large = large.withColumn("budget", F.greatest("members", F.ceil(F.col("shingles") * max_members / max_shingles)))
        found = leaves(level.join(large, "region", "left_anti"))
        big = level.join(large.select("region"), "region", "left_semi").select(*POINT)
        if not cut:  # the first large regions lose what cannot link while that makes them smaller, then are cut by their rare shingles
            names = _sharing(big, num, den)
            shrinks = names.count() <= 0.8 * large.agg(F.sum("members")).first()[0]
            level = _restaged(big, names, ["digest"], POINT, "kept") if shrinks else _by_rare_shingles(big, num, den)
            drop_staged(held, names)
            held, sizes, cut = level, region_sizes(level), not shrinks
            continue
        dealt = stage(_split(big, large, num, den, max_members), "split")
        # a region without a point of its own adds nothing: every pair meets in the region of either point
        split = dealt.join(dealt.where("core").select("region").distinct(), "region", "left_semi")
        child = split.groupBy("region", "parent").agg(F.count(F.lit(1)).alias("members"))
        shrunk = child.join(large.select(F.col("region").alias("parent"), F.col("members").alias("before")), "parent")
        # windows that hold nearly all, or copy every set twice and more, do not help
        stuck = shrunk.groupBy("parent").agg(F.max("members").alias("most"), F.sum("members").alias("all"), F.max("before").alias("before"))
        stuck = stage(stuck.where("most > 0.8 * before or all > 2 * before").select(F.col("parent").alias("region")), "stuck")
        numbers = stage(_block_numbers(large.join(stuck, "region", "left_semi"), max_members), "blocks")
        for begin in range(0, numbers.agg(F.max("blocks")).first()[0] or 0, PASSES):
            found = leaves(_blocks(level, numbers, begin, begin + PASSES))
        names = split.join(stuck.withColumnRenamed("region", "parent"), "parent", "left_anti")
        rows = level.withColumnRenamed("region", "parent").drop("core")
        level = _restaged(rows, names, ["parent", "digest"], POINT, "level")
        drop_staged(held, dealt, stuck, numbers)
        held, sizes = level, region_sizes(level)


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, max_members: int = 16_384, max_shingles: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (rows it links with) of every row; documents link when
    ``den * |A & B| >= num * |A | B|``."""
    prof = stage(profiles(docs, shingle), "profiles")
    pivot = F.first("node").over(Window.partitionBy("sig").orderBy("node"))
    attached = signatures(docs, shingle, num, den).withColumn("pivot", pivot).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    regions = components(attached).select("node", F.col("root").alias("region"))
    # one row a set: its node, rows and least id
    sets = stage(prof.where("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("row")), "sets")
    members = sets.join(regions, "node").select("region", "digest", "n", "copies", F.coalesce("row.doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("row.th").alias("th"))
    repeated = not prof.groupBy("doc_id", "th").count().where("count > 1").limit(1).isEmpty()
    found = join_points(_region_sets(docs, members, shingle, repeated), region_sizes(members), num, den, max_members, max_shingles)
    comp = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("digest"), "root")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    each = sets.join(comp, "digest", "left").join(links, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    each = each.join(least, "root").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = prof.select("doc_id", "n", "digest").join(each, "digest", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                       F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, num=90, den=100)


#: The same in DuckDB SQL: every pair that shares a shingle, and all that each document reaches.
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                 ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x) k USING (doc_id)
"""
