"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters and digits (lower-cased; runs of capitals share one token) or of other characters, and
hash to ``VOCAB`` buckets. Every bucket has a sparse ternary index vector; its word vector is the sum of the index
vectors of its neighbours over all documents (exact integer sums, added up by Spark, so the table is the same for
any partitioning and its size does not grow). A document is the mean of its tokens' vectors, the mean over its
distinct tokens, its length and its diversity. A network of one hidden layer is trained in numpy on a bounded
sample of labelled rows; a temperature fitted on rows that it has not seen calibrates its probabilities.

Edge cases: null or empty texts have the zero vector and are scored like any other; without labels of both
classes the score is the share of label 1 (0.5 with none); a null doc_id is never held out; extra columns are
ignored; labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ferret.llm.common import SMALL_SLICE, Text, _LOWER, list_array, mix64, slices, spans_hash

VOCAB, DIM, NONZERO = 8192, 64, 4
CAPS = 4  # buckets 0..3: runs of capitals by length
WIDTH = 2 * DIM + 2
ACCEPT = 0.7
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token, and the bounds of the documents' tokens."""
    t = Text(col)
    kind = _KIND[t.data]
    edge = np.ones(len(kind) + 1, bool)
    if len(kind):
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[t.off[t.off < len(kind)]] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = kind[starts] > 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[keep], ends[keep]
    bucket = (spans_hash(_LOWER[t.data], starts, ends) % np.uint64(VOCAB - CAPS)).astype(np.int64) + CAPS
    count = lambda flags: (lambda acc: acc[ends] - acc[starts])(np.concatenate([[0], np.cumsum(flags)]))
    caps = (count((t.data >= 65) & (t.data <= 90)) >= 2) & (count((t.data >= 97) & (t.data <= 122)) == 0)
    bucket[caps] = np.minimum((ends - starts)[caps] // 4, CAPS - 1)
    return bucket, np.searchsorted(starts, t.off)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of every bucket's index vector."""
    h = mix64(np.arange(VOCAB * NONZERO, dtype=np.uint64).reshape(VOCAB, NONZERO) + np.uint64(0xA5A5))
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _contexts(batches):
    """Sums of neighbours' index vectors of what one task reads: one row per bucket that occurs."""
    at, sign = index_vectors()
    total = np.zeros(VOCAB * DIM)
    for b in batches:
        for part in slices(b, "text", SMALL_SLICE // 2):
            bucket, ptr = tokens(part.column("text"))
            if len(bucket) < 2:
                continue
            pair = np.ones(len(bucket) - 1, bool)
            inner = ptr[(ptr > 0) & (ptr < len(bucket))]
            pair[inner - 1] = False
            left, right = bucket[:-1][pair], bucket[1:][pair]
            for k in range(NONZERO):
                total += np.bincount(left * DIM + at[right, k], sign[right, k], VOCAB * DIM)
                total += np.bincount(right * DIM + at[left, k], sign[left, k], VOCAB * DIM)
    rows = total.reshape(VOCAB, DIM).astype(np.int64)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), list_array(rows[used].ravel(), np.arange(len(used) + 1) * DIM)], names=["bucket", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The VOCAB x DIM table of unit word vectors, from all documents."""
    parts = docs.select("text").mapInArrow(_contexts, "bucket long, v array<long>")
    summed = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v"))
    table = np.zeros((VOCAB, DIM))
    for r in summed.collect():  # at most VOCAB rows
        table[r.bucket] = r.v
    norm = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return np.divide(table, norm, out=np.zeros_like(table), where=norm > 0).astype(np.float32)


def pooled(col: pa.Array, table: np.ndarray) -> np.ndarray:
    bucket, ptr = tokens(col)
    n = len(ptr) - 1
    out = np.zeros((n, WIDTH), np.float32)
    for i in range(0, n, 256):
        j = min(i + 256, n)
        own = bucket[ptr[i]:ptr[j]]
        doc = np.repeat(np.arange(j - i), np.diff(ptr[i:j + 1]))
        counts = np.bincount(doc * VOCAB + own, minlength=(j - i) * VOCAB).reshape(j - i, VOCAB).astype(np.float32)
        size, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True).astype(np.float32)
        out[i:j, :DIM] = counts @ table / np.maximum(size, 1)
        out[i:j, DIM:2 * DIM] = (counts > 0).astype(np.float32) @ table / np.maximum(kinds, 1)
        out[i:j, 2 * DIM] = np.log1p(size[:, 0])
        out[i:j, 2 * DIM + 1] = (kinds / np.maximum(size, 1))[:, 0]
    return out


class Network:
    """tanh hidden layer, logistic output, Adam; deterministic for a given seed and order of rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 30, batch: int = 128, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), batch):
                k = order[i:i + batch]
                h = np.tanh(z[k] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[k]) / len(k)
                back = np.outer(err, p[2]) * (1 - h * h)
                grads = [z[k].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
                step += 1
                for a, g, mm, vv in zip(p, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= 0.003 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.999 ** step)) + 1e-8)
        self.p, self.temperature = p, 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on rows that training has not seen."""
        z = self.logit(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, x):
        return np.full(len(x), self.share)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, table: np.ndarray, max_labelled: int):
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = marked.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_labelled)

    def pool(batches):
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                x = pooled(part.column("text"), table)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), list_array(x.ravel(), np.arange(len(x) + 1) * WIDTH)], names=["doc_id", "quality", "x"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    one = marked.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of rows that repeat an id, the least text
    rows = one.mapInArrow(pool, "doc_id long, quality int, x array<float>").toArrow()  # at most max_labelled rows
    if not rows.num_rows:
        return Constant(0.5)
    ids = rows.column("doc_id").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)
    y = rows.column("quality").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[:4], y, ids))  # the order of arrival is not fixed
    order = order[np.argsort(mix64(ids[order].astype(np.uint64)), kind="stable")]
    x, y = x[order], y[order]
    if y.min() == y.max():
        return Constant(float(y[0]))
    cut = max(1, len(y) // 5)
    net = Network(x[cut:], y[cut:])
    net.calibrate(x[:cut], y[:cut])
    return net


def score_quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, score: str = "score", unfitted: float | None = None) -> DataFrame:
    """``docs`` with the column ``score`` (its other columns are kept). ``max_labelled`` bounds the fitted sample: the
    labelled rows outside the held-out fold with the smallest hash of doc_id. ``unfitted``: the score of all documents
    where these rows are none or of one class, so that no model is fitted; by default 0.5 or that class."""
    table = word_vectors(train_docs)
    net = fit(train_docs, labels, table, max_labelled)
    if unfitted is not None and isinstance(net, Constant):
        net = Constant(unfitted)
    kept = [c for c in docs.columns if c != score]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                s = net.score(pooled(part.column("text"), table).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*kept, score])

    return src.mapInArrow(run, StructType([*src.schema.fields]).add(score, DoubleType()))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs, docs, labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
