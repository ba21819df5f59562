"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes (a doubling scheme computes it for all positions at once) proposes
boundaries. Chunking is normalised: from ``MIN`` bytes on a boundary needs 7 zero bits, from ``NORMAL`` bytes on only
4, and at ``MAX`` bytes a chunk ends anyhow, so chunk lengths gather around ``NORMAL``. No boundary depends on bytes
before the chunk, which makes the chunks resistant to shifts. A fingerprint is the set of (digest, length) of
the chunks; likeness is containment weighted by length: common weight over the weight of the lighter set.

Edge cases: a null text is an empty one; an empty text has the empty fingerprint, which is like (1.0) only another
empty one; equal texts have equal fingerprints; rows that share a doc_id are ordered by a hash of their text; a null doc_id
comes first; a single document is its own next one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferret.llm.common import Text, keyed, mix64, slices, spans_hash

MIN, NORMAL, MAX = 16, 48, 192
_GEAR = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x6EA5)).astype(np.uint32)
Print = dict[int, int]


def boundaries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of the documents ``data[off[i]:off[i + 1]]``, and the bounds of each document's chunks."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    easy = np.flatnonzero(h < (1 << 28)) + 1
    hard = easy[h[easy - 1] < (1 << 25)].tolist() + [len(data) + MAX]
    easy = easy.tolist() + [len(data) + MAX]
    cuts, ptr, a, b = [], [0], 0, 0
    off = off.tolist()
    for s, e in zip(off[:-1], off[1:]):
        while e - s > MIN:
            a = bisect_left(hard, s + MIN, a)
            c = hard[a]
            if c >= s + NORMAL:
                b = bisect_left(easy, s + NORMAL, b)
                c = min(easy[b], s + MAX)
            s = min(c, e)
            cuts.append(s)
        if e > s:
            cuts.append(e)
        ptr.append(len(cuts))
    return np.array(cuts, np.int64), np.array(ptr)


def prints(data: np.ndarray, off: np.ndarray) -> list[Print]:
    """The fingerprint of each document: 48-bit digest -> length in bytes."""
    ends, ptr = boundaries(data, off)
    starts = np.empty_like(ends)
    if len(ends):
        starts[1:] = ends[:-1]
        starts[0] = 0
    digest = (spans_hash(data, starts, ends) >> np.uint64(16)).tolist()
    length = (ends - starts).tolist()
    ptr = ptr.tolist()
    return [dict(zip(digest[i:j], length[i:j])) for i, j in zip(ptr[:-1], ptr[1:])]


def render(p: Print) -> str:
    return " ".join([f"{d:012x}{n:x}" for d, n in sorted(p.items())])


def likeness(a: Print, b: Print) -> float:
    """Weight of the common chunks over the weight of the lighter fingerprint; 1 for two empty ones."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    return sum([n for d, n in a.items() if d in b]) / min(sum(a.values()), sum(b.values()))


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def compare_with_next(texts: pa.Array, following: pa.Array) -> list[pa.Array]:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every text and the one after it."""
    t, f = Text(texts), Text(following)
    lead = np.append(np.flatnonzero((t.data & 0xC0) != 0x80), len(t.data))
    lead_next = np.append(np.flatnonzero((f.data & 0xC0) != 0x80), len(f.data))
    at, at_next = np.searchsorted(lead, t.off), np.searchsorted(lead_next, f.off)
    n_chars, n_next = np.diff(at), np.diff(at_next)
    quarter = n_chars // 4
    stop = lead[at[1:] - quarter]
    stop = np.where(quarter > 0, stop, t.off[1:])
    stop_next = np.where(np.minimum(quarter, n_next) < n_next, lead_next[at_next[:-1] + np.minimum(quarter, n_next)], f.off[1:])
    data, data_next = t.data.tobytes(), f.data.tobytes()
    edited = [data[a:b] + data_next[c:d] for a, b, c, d in zip(t.off[:-1].tolist(), stop.tolist(), f.off[:-1].tolist(), stop_next.tolist())]
    own, other, changed = prints(t.data, t.off), prints(f.data, f.off), prints(*_pack(edited))
    return [
        pa.array(n_chars.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
        pa.array([render(p) for p in own]), pa.array([render(p) for p in changed]),
        pa.array([likeness(p, q) for p, q in zip(own, changed)], pa.float64()), pa.array([likeness(p, q) for p, q in zip(own, other)], pa.float64()),
    ]


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches):
    """Rows of whole parts in order. Every document is followed by its next one, or by the row that was added to the end of
    its part (``kind`` 1)."""
    held = None
    for b in batches:
        for s in slices(b, "text", 1 << 20):
            ids, kind, text = (s.column(c) for c in ("doc_id", "kind", "text"))
            if held is not None:
                ids, kind, text = (pa.concat_arrays([x, y]) for x, y in zip(held, (ids, kind, text)))
            n = len(ids) - 1
            own = pa.array(np.flatnonzero(kind.to_numpy()[:n] == 0))
            if len(own):
                following = pa.array(own.to_numpy() + 1)
                yield pa.RecordBatch.from_arrays([ids.take(own), *compare_with_next(text.take(own), text.take(following))], names=["doc_id", *COLUMNS])
            held = ids[n:], kind[n:], text[n:]


def _parted(src: DataFrame) -> DataFrame:
    """``src`` with a number ``part`` that rises with (doc, th): ranges of about equal size, four to a shuffle partition. An id that
    fills several ranges (rows without an id, above all) is cut by the hash of the text as often as it fills one."""
    n = 4 * int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, often = np.unique(np.array(src.approxQuantile("doc", [i / n for i in range(1, n)], 0.25 / n) or [], np.float64), return_counts=True)
    exact = (often > 1) & ((np.abs(cuts) < 2.0**53) | (cuts == -(2.0**63)))  # larger ids may differ and be equal as doubles
    crowded, pieces = cuts[exact], often[exact] + 1
    most = int(pieces.max(initial=0)) + 1  # the last piece of a range is what follows its crowded id

    @F.pandas_udf("int")
    def part(doc: pd.Series, th: pd.Series) -> pd.Series:
        d = doc.to_numpy().astype(np.float64)
        index = np.searchsorted(cuts, d, side="right")
        out = index * most + most - 1
        if len(crowded):
            at = np.minimum(np.searchsorted(crowded, d), len(crowded) - 1)
            place = (th.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64  # of the hash, from 0 to 1
            piece = np.minimum((place * pieces[at]).astype(np.int64), pieces[at] - 1)
            out = np.where(crowded[at] == d, index * most + piece, out)
        return pd.Series(out.astype(np.int32))

    return src.withColumn("part", part("doc", "th"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is the start of the next document.

    Documents are dealt out by fixed ranges of doc_id and sorted within them: one shuffle. Each range gets the first
    document of the next range as an extra last row, so that the last document finds its next one; there are as
    many such rows as ranges, whatever the number of documents.
    """
    spark = docs.sparkSession
    src = keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    src = _parted(src)
    firsts = src.groupBy("part").agg(F.min(F.struct("doc", "th")).alias("f")).select("part", "f.doc", "f.th").orderBy("part").collect()  # one row a range
    follow = [(r.part, n.doc, n.th) for r, n in zip(firsts, firsts[1:] + firsts[:1])]
    follow = F.broadcast(spark.createDataFrame(follow, "part int, doc long, th long"))
    ends = src.drop("part").join(follow, ["doc", "th"]).groupBy("part").agg(F.min("text").alias("text"))
    ends = ends.select("part", F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("doc", "th", "doc_id")], "text")
    rows = src.select("part", F.lit(0).alias("kind"), "doc", "th", "doc_id", "text").unionByName(ends)
    rows = rows.repartition("part").sortWithinPartitions("part", "kind", "doc", "th", "text")
    return rows.mapInArrow(_in_order, SCHEMA)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
