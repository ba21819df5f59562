"""Ranked lexical search by hashed max-sketches.

A term t of a document with m (its length against the average) weighs ``w(t) * impact(tf, m)``, the impact being
``(10^9 * tf) div (1000 * tf + 8 * m)``; a score sums that over an item's terms. Documents are read twice:

1. counts: number of documents, of terms, and of the documents that hold each term of the items, added up map-side.
2. search: in slices, every document folds the impacts of all its terms into a sketch of ``WIDTH`` coordinates (term hash
   modulo ``WIDTH``), keeping the maximum of each. A batch of items is a matrix of their weights by coordinate, so one product
   with the sketches gives, for every document and item, a sum that no score can exceed. For each item documents are
   rescored exactly in descending order of that bound until the bound falls behind the tenth best score that the task has
   found so far; the task carries its ten best through its slices. Each task hands out at most ten documents an item, which
   a grouped top-k joins: by item and hash bucket first, then by item.

Sketches are exact integers in doubles (below 2**53), so bounds are never too small. Items are taken in blocks of ``ITEMS``
against all documents; within a block the broadcast weights and term hashes are bounded by ``BLOCK_TERMS``. Terms are 64-bit hashes.

Terms are maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Edge cases: null and empty texts
have no terms and are not counted; an item without terms, or none of whose terms occurs, has no rows; each row is a document
of its own, so repeated rows rank one after another; of equal scores the least doc_id ranks first, null ids last; rows of
the items that share an item_id are one item each and, like null item_ids, are kept; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.llm.common import U, slices, spans_hash, stage

TOP = 10
WIDTH = 1024
ITEMS, BLOCK_TERMS = 512, 200_000
SLICE, ROWS = 4 << 20, 1024
NO_ID = (1 << 63) - 1
_TERM = np.zeros(256, bool)
_TERM[128:] = True
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- terms

def term_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a text column, and the bounds of each text's."""
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = _LOWER[np.frombuffer(data, np.uint8)[off[0]:off[-1]]] if data is not None else np.empty(0, np.uint8)
    off = off - off[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _TERM[raw]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    border = off[(off > 0) & (off < len(raw))]
    start[border] = inside[border + 1]
    end[border - 1] = inside[border]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return spans_hash(raw, starts, ends), np.searchsorted(starts, off)


class Block:
    """Documents of a slice: their lengths and the distinct terms of each with frequencies, ordered by document."""

    def __init__(self, col: pa.Array):
        h, ptr = term_hashes(col)
        self.n = np.diff(ptr)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.term, self.doc = h[at], doc[at]
        self.tf = np.diff(np.append(at, len(h)))


def blocks(batches, text: str):
    """Slices of the batches of at most ``SLICE`` bytes (or one longer text) and ``ROWS`` rows."""
    for b in batches:
        for s in slices(b, text, SLICE):
            for i in range(0, s.num_rows, ROWS):
                part = s.slice(i, ROWS)
                yield part, Block(part.column(part.schema.get_field_index(text)))


# ---------------------------------------------------------------- counts

def count_terms(docs: DataFrame, terms) -> DataFrame:
    """(kind, term, n), added up by task, then by term: kind 0 documents that hold the term (one of the broadcast sorted
    ``terms``), kind 1 documents with any term, kind 2 all terms with repeats."""
    def run(batches):
        wanted = terms.value
        df = np.zeros(len(wanted), np.int64)
        some = total = 0
        for _, b in blocks(batches, "text"):
            some += int((b.n > 0).sum())
            total += int(b.n.sum())
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, b.term), len(wanted) - 1)
                df += np.bincount(at[wanted[at] == b.term], minlength=len(wanted))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.zeros(len(seen), np.int8), [1, 2]]).astype(np.int8)),
            pa.array(np.concatenate([wanted[seen].view(np.int64), np.zeros(2, np.int64)])),
            pa.array(np.concatenate([df[seen], [some, total]]).astype(np.int64))], names=["kind", "term", "n"])

    return docs.select("text").mapInArrow(run, "kind byte, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


class Items:
    """A block of items: their terms with repeats, weights, and the weights by sketch coordinate."""

    def __init__(self, terms: list[Counter], found: dict[int, int], documents: int, total: int):
        self.documents, self.total = documents, max(total, 1)
        held = sorted({t for c in terms for t in c if t in found})
        self.terms = np.array(held, U)
        number = {t: i for i, t in enumerate(held)}
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * found[t] + 1))) for t in held]
        self.of = [np.array([number[t] for t in c if t in number], np.int64) for c in terms]
        self.weight = [np.array([weight[number[t]] * k for t, k in c.items() if t in number], np.int64) for c in terms]
        self.lookup = np.zeros((WIDTH, len(terms)))
        for i, (of, w) in enumerate(zip(self.of, self.weight)):
            np.add.at(self.lookup[:, i], (self.terms[of] % U(WIDTH)).astype(np.int64), w)

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 75 + (75 * n * self.documents) // self.total
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ---------------------------------------------------------------- search

class Best:
    """The best documents of one item that a task has found: (score, id) with higher scores, then lesser ids first."""

    def __init__(self, top: int):
        self.top, self.score, self.id = top, np.empty(0, np.int64), np.empty(0, np.int64)

    def beats(self, bound: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document with this bound may still be among the best."""
        if len(self.score) < self.top:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (ids < self.id[-1]))

    def add(self, score: np.ndarray, ids: np.ndarray):
        s, i = np.concatenate([self.score, score[score > 0]]), np.concatenate([self.id, ids[score > 0]])
        order = np.lexsort((i, -s))[:self.top]
        self.score, self.id = s[order], i[order]


def search_block(b: Block, ids: np.ndarray, items: Items, best: list[Best], step: int = 64) -> int:
    """Fold the block into ``best``; returns the number of exact scores that were computed."""
    impact = items.impacts(b.tf, b.n[b.doc])
    width = len(items.lookup)  # the items', wherever the task runs
    sketch = np.zeros((len(b.n), width))
    cell = b.doc * width + (b.term % U(width)).astype(np.int64)
    order = np.lexsort((impact, cell))  # the largest of a cell comes last and stays
    sketch.reshape(-1)[cell[order]] = impact[order]
    bounds = sketch @ items.lookup
    # exact impacts of the items' terms, looked up by document and term
    at = np.minimum(np.searchsorted(items.terms, b.term), max(len(items.terms) - 1, 0))
    mine = np.flatnonzero(items.terms[at] == b.term) if len(items.terms) else np.empty(0, np.int64)
    key = b.doc[mine] * len(items.terms) + at[mine]
    order = np.argsort(key, kind="stable")
    key, value = np.append(key[order], -1), np.append(impact[mine][order], 0)
    scored = 0
    for q, found in enumerate(best):
        left = np.flatnonzero(found.beats(bounds[:, q], ids))
        left = left[np.lexsort((ids[left], -bounds[left, q]))]
        while len(left):
            now, left = left[:step], left[step:]
            want = now[:, None] * len(items.terms) + items.of[q][None, :]
            pos = np.searchsorted(key[:-1], want)
            exact = (np.where(key[pos] == want, value[pos], 0) * items.weight[q]).sum(axis=1)
            found.add(exact, ids[now])
            scored += len(now)
            if len(left):  # bounds descend: what no longer beats the tenth ends the item
                left = left[found.beats(bounds[left, q], ids[left])]
    return scored


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS) -> DataFrame:
    """The ``top`` documents (columns doc_id, text) of each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    queries, done = _item_terms(items), []
    for part in _parts(queries, block):
        wanted = np.array(sorted({t for _, _, c in part for t in c}), U)
        counts = {(r.kind, r.term): r.n for r in count_terms(docs, spark.sparkContext.broadcast(wanted)).collect()}  # at most BLOCK_TERMS + 2 rows
        found = {t % (1 << 64): n for (kind, t), n in counts.items() if kind == 0}
        shipped = spark.sparkContext.broadcast((Items([c for _, _, c in part], found, counts.get((1, 0), 0), counts.get((2, 0), 0)), [n for n, _, _ in part]))

        def run(batches):
            held, number = shipped.value
            best = [Best(top) for _ in number]
            for rows, b in blocks(batches, "text"):
                search_block(b, rows.column(0).to_numpy(zero_copy_only=False), held, best)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(number, np.int64), [len(x.id) for x in best])),
                pa.array(np.concatenate([x.id for x in best])), pa.array(np.concatenate([x.score for x in best]))], names=["item", "doc", "score"])

        got = docs.mapInArrow(run, "item long, doc long, score long").withColumn("part", F.spark_partition_id() % 64)
        done.append((part, stage(_top(_top(got, top, "item", "part"), top, "item"), "ranked")))
    schema = items.select("item_id").schema["item_id"].dataType
    if not done:
        return spark.createDataFrame([], f"item_id {schema.simpleString()}, rank int, doc_id long, score long")
    names = spark.createDataFrame([(n, i) for part, _ in done for n, i, _ in part], f"item long, item_id {schema.simpleString()}")
    ranked = done[0][1]
    for _, more in done[1:]:
        ranked = ranked.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")).cast("int")
    return ranked.withColumn("rank", rank).join(names, "item").select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


def _top(found: DataFrame, top: int, *by: str) -> DataFrame:
    """At most ``top`` rows a group, cut map-side as well (window group limit)."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc")
    return found.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= top).drop("__place")


def _item_terms(items: DataFrame):
    """(number, item_id, term counts) of every item, read block by block through a local iterator."""
    rows = items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True)
    for n, r in enumerate(rows):
        h, _ = term_hashes(pa.array([r.text], pa.string()))
        yield n, r.item_id, Counter(h.tolist())


def _parts(queries, block: int):
    part, terms = [], 0
    for q in queries:
        if part and (len(part) >= block or terms + len(q[2]) > BLOCK_TERMS):
            yield part
            part, terms = [], 0
        part.append(q)
        terms += len(q[2])
    if part:
        yield part


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
occ AS (SELECT doc_id, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY 1, 2),
len AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
tot AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, tot),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * big_n) // l) AS m FROM len, tot),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS k FROM q GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
