"""Shared helpers of the training-text operators: staged tables, vectorised word splitting and hashing.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. All separators are single ASCII bytes, so words can be
found on the UTF-8 bytes of a whole Arrow column at once. Hashes are 64-bit: a polynomial over the
bytes modulo 2**64, finished by an avalanche mix.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
SLICE_BYTES, SMALL_SLICE = 2 << 20, 1 << 19  # the smaller for what runs in one session with other operators
BATCH_BYTES = 4 << 20
_POLY = 0x9E3779B97F4A7C15 | 1
_POLY_INV = pow(_POLY, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- staged tables

def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset (tests, local sessions) a temporary folder; on a
    cluster without it this raises, since a machine-local folder is not seen by the executors."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="llm-checkpoints-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def stage(df: DataFrame, tag: str, *more: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts the lineage and outlives executors. ``more``:
    rows of the same table that are computed one after the other, so only one part's shuffle is on disk."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    for part in more:
        part.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Drops the tables that operators have staged within, once the block has stored its result. Yields the list: what is
    taken out of it stays."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        drop_staged(*_scopes.pop())


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_staged_at", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lean_session(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Settings for many operators in one session: from now on Arrow batches hold at most ``size`` bytes (Spark's default is
    64 MB, which JVM and Python worker each hold several times; a smaller setting stays), and the shuffle files of a
    query go when it ends, not when the driver happens to collect its garbage. Operators stage what they read again."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


# ---------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``; equal bytes give equal hashes in every batch."""
    acc = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _table(_POLY, len(data)), out=acc[1:])
    h = (acc[ends] - acc[starts]) * _table(_POLY_INV, len(data) + 1)[starts]
    return mix64(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values of ``h`` (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(h * _table(_POLY, len(h)), out=acc[1:])
    return mix64((acc[k:] - acc[:n]) * _table(_POLY_INV, n) + U(k))


def ranges_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the values ``h[start:end]``; another ``seed`` gives an independent hash."""
    acc = np.zeros(len(h) + 1, U)
    np.cumsum((mix64(h + U(seed)) if seed else h) * _table(_POLY, len(h)), out=acc[1:])
    x = (acc[ends] - acc[starts]) * _table(_POLY_INV, len(h) + 1)[starts]
    return mix64(x + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def powers(base_inverse: bool, n: int) -> np.ndarray:
    return _table(_POLY_INV if base_inverse else _POLY, n)


# ---------------------------------------------------------------- Arrow text

class Text:
    """The UTF-8 bytes of one slice of a text column and its words.

    ``off`` holds the documents' byte bounds; ``starts``/``ends`` the words' byte bounds; the words of document
    ``i`` are ``wptr[i]:wptr[i + 1]``. A null text is an empty one.
    """

    def __init__(self, col: pa.Array, lower: bool = False):
        col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
        self.off = off - off[0]
        self.data = _LOWER[raw] if lower else raw
        self.n = len(col)
        w = ~_SEP[self.data]
        inner = self.off[(self.off > 0) & (self.off < len(w))]
        start, end = w.copy(), w.copy()
        start[1:] &= ~w[:-1]
        end[:-1] &= ~w[1:]
        start[inner] = w[inner]
        end[inner - 1] = w[inner - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.wptr = np.searchsorted(self.starts, self.off)

    def word_hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose text is at most ``limit`` bytes, or a single longer document: bounds the memory of
    what follows by the longest document, not by the batch."""
    col = batch.column(column).cast(pa.large_string())
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, len(col)) - i)
        i = min(j, len(col))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc, th and text of every row: the least-first order of documents. A null doc_id comes last, a null text is empty.
    ``th`` tells apart rows that share a doc_id (by their text); where ids are unique it is the sign of ``doc``: not a
    literal, which Spark would take out of the join keys and so shuffle a table again that is dealt out by both."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    unique = docs.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).isEmpty()
    th = F.shiftright(doc, 63) if unique else F.xxhash64("text")
    return docs.select(doc.alias("doc"), th.alias("th"), F.coalesce("text", F.lit("")).alias("text"), *more)


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def list_array(values: np.ndarray, ptr: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(ptr, np.int32)), pa.array(values, kind) if kind else pa.array(values))
