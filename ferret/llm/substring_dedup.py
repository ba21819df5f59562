"""Substring dedup by seeding and extending.

Seeds are runs of ``SEED`` words; the least seed hash of every window of ``length`` words is the window's anchor, so
two equal windows have equal anchors (winnowing). A row is an anchor occurrence with its *span*: the words of all the
consecutive windows that chose it. Rows are joined on the anchor; anchors that occur once are dropped. Extension goes
from coarse to fine: an occurrence whose whole span is equal to an earlier one's is a repeat as far as it reaches; of
the spans that differ, one occurrence each is extended word by word, as hashes of each of its windows (words are
compared by 128 bits: anchor and span, or two hashes of a window). A window is a repeat if an equal one starts earlier; the union of the repeats of a document are its maximal repeats of
at least ``length`` words, and their words are removed.

Repeats that one task sees itself are found there (in runs of ``CHUNK`` rows) and take no part in the joins, so a
passage that fills a third of all documents sends one row per task to its key.

Edge cases: a null text is an empty one; "earlier" is by doc_id, then start, all positions in the input; a null doc_id
comes last; rows that share a doc_id count in the order of a hash of their text, and exactly equal rows as one document;
shorter texts lose nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.llm.common import Text, U, keyed, long_array, mix64, ranges_hash, slices, stage, windows_hash

SEED, CHUNK = 6, 1 << 20


def anchor_spans(t: Text, length: int) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, span hash, first window and number of windows of every anchor occurrence."""
    h = t.word_hashes()
    doc = np.repeat(np.arange(t.n), np.diff(t.wptr))
    none = np.empty(0, np.int64)
    if len(h) < length:
        return none, none.astype(U), none.astype(U), none, none
    seeds = windows_hash(h, SEED)
    at = np.lib.stride_tricks.sliding_window_view(seeds, length - SEED + 1).argmin(axis=1)
    start = np.flatnonzero(doc[:len(h) - length + 1] == doc[length - 1:])
    if not len(start):
        return none, none.astype(U), none.astype(U), none, none
    chosen = start + at[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    low, pick = start[first], chosen[first]
    span = mix64(ranges_hash(h, low, low + count + length - 1) + (pick - low).astype(U))
    return doc[low], seeds[pick], span, low - t.wptr[doc[low]], count


def _local_repeats(key: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come after another one, in the given order, with their key; and those that another one equals in all."""
    by = np.lexsort((*reversed(order), key))
    later, copy = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[by[1:]] = same = key[by[1:]] == key[by[:-1]]
    copy[by[1:]] = np.logical_and.reduce([same, *[x[by[1:]] == x[by[:-1]] for x in order]])
    return later, copy


def _flush(held: list[list[np.ndarray]], names: list[str], key) -> pa.RecordBatch:
    cols = dict(zip(names, [np.concatenate(c) for c in zip(*held)]))
    dup, copy = _local_repeats(key(cols), cols["doc"], cols["th"], cols["lo"])
    if copy.any():  # of a row that is there twice; no repeat of itself
        cols, dup = {k: c[~copy] for k, c in cols.items()}, dup[~copy]
    arrays = [long_array(c) if c.dtype == U else pa.array(c) for c in cols.values()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(dup)], names=[*names, "dup"])


def _anchors(length: int):
    names = ["anchor", "span", "doc", "th", "lo", "n"]

    def run(batches):
        held, size = [], 0
        for b in batches:
            for part in slices(b, "text"):
                doc, anchor, span, low, count = anchor_spans(Text(part.column("text")), length)
                ids, th = part.column("doc").to_numpy(), part.column("th").to_numpy()
                held.append([anchor, span, ids[doc], th[doc], low.astype(np.int32), count.astype(np.int32)])
                size += len(doc)
                if size >= CHUNK:
                    yield _flush(held, names, lambda c: mix64(c["anchor"]) ^ c["span"])
                    held, size = [], 0
        if held:
            yield _flush(held, names, lambda c: mix64(c["anchor"]) ^ c["span"])

    return run


def _windows(length: int):
    names = ["window", "check", "doc", "th", "lo"]

    def run(batches):
        held, size = [], 0
        for b in batches:
            for part in slices(b, "text"):
                t = Text(part.column("text"))
                h = t.word_hashes()
                ids, th, spans = part.column("doc").to_numpy(), part.column("th").to_numpy(), part.column("spans")
                owner = np.repeat(np.arange(t.n), spans.value_lengths().to_numpy())
                lo, n = (spans.flatten().field(i).to_numpy() for i in (0, 1))
                row = np.repeat(np.arange(len(lo)), n)
                pos = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = t.wptr[owner[row]] + pos
                held.append([ranges_hash(h, at, at + length), ranges_hash(h, at, at + length, 77), ids[owner[row]], th[owner[row]], pos.astype(np.int32)])
                size += len(row)
                if size >= CHUNK:
                    yield _flush(held, names, lambda c: mix64(c["window"]) ^ c["check"])
                    held, size = [], 0
        if held:
            yield _flush(held, names, lambda c: mix64(c["window"]) ^ c["check"])

    return run


def _kept(length: int):
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                t = Text(part.column("text"))
                spans = part.column("spans")
                owner = np.repeat(np.arange(t.n), spans.value_lengths().fill_null(0).to_numpy())
                lo, n = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                depth = np.zeros(len(t.starts) + 1, np.int64)
                np.add.at(depth, t.wptr[owner] + lo, 1)
                np.add.at(depth, t.wptr[owner] + lo + n + length - 1, -1)
                keep = np.cumsum(depth[:-1]) == 0
                raw, s, e = t.data.tobytes(), t.starts.tolist(), t.ends.tolist()
                texts, gone = [], []
                for a, z in zip(t.wptr[:-1].tolist(), t.wptr[1:].tolist()):
                    words = [raw[s[i]:e[i]] for i in (np.flatnonzero(keep[a:z]) + a).tolist()]
                    gone.append(z - a - len(words))
                    texts.append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(t.wptr)), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "text"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, of every row."""
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    # local repeats get a salt of their own and so never crowd a key
    salt = F.when(F.col("dup"), F.xxhash64("doc", "th", "lo")).otherwise(F.lit(0))
    spans = rows.select("doc", "th", "text").mapInArrow(_anchors(length), "anchor long, span long, doc long, th long, lo int, n int, dup boolean").withColumn("salt", salt)
    own, order = Window.partitionBy("anchor", "salt"), ["doc", "th", "lo"]
    spans = spans.withColumn("met", F.count(F.lit(1)).over(own)).where("met > 1 or dup")
    # rank: copies of one row tie, so only an earlier occurrence makes a repeat
    equal = Window.partitionBy("anchor", "salt", "span").orderBy(*order)
    spans = spans.withColumn("rank", F.rank().over(equal)).withColumn("nth", F.row_number().over(equal))
    spans = spans.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(own))
    seeds = stage(spans.select("doc", "th", "lo", "n", (F.col("dup") | (F.col("rank") > 1)).alias("repeat"), "kinds").where("repeat or kinds > 1"), "seeds")
    texts = rows.repartition("doc", "th")  # the one shuffle of texts: both joins below read all its columns, so Spark reuses it
    per_doc = lambda d: d.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))  # noqa: E731  bounded by the document
    edges = texts.join(per_doc(seeds.where("not repeat")), ["doc", "th"])
    fine = edges.mapInArrow(_windows(length), "window long, check long, doc long, th long, lo int, dup boolean").withColumn("salt", salt)
    fine = fine.withColumn("rank", F.rank().over(Window.partitionBy("window", "check", "salt").orderBy(*order))).where("dup or rank > 1")
    repeats = seeds.where("repeat").select("doc", "th", "lo", "n").unionByName(fine.select("doc", "th", "lo", F.lit(1).alias("n")))
    out = texts.join(per_doc(repeats), ["doc", "th"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, text string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same in DuckDB SQL, every window as its words.
OP5_SQL = """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS p FROM docs WHERE len(words) >= 20)),
firsts AS (SELECT w, min(struct_pack(d := doc_id, p := p)) AS f FROM windows GROUP BY w),
repeats AS (SELECT doc_id, windows.p FROM windows JOIN firsts USING (w) WHERE struct_pack(d := doc_id, p := windows.p) <> f),
each_word AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM docs WHERE len(words) > 0)),
covered AS (
  SELECT e.doc_id, e.p, e.word, max(CASE WHEN r.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id ORDER BY e.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM each_word e LEFT JOIN repeats r ON r.doc_id = e.doc_id AND r.p = e.p),
kept AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '') AS text FROM covered GROUP BY doc_id)
SELECT docs.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""
