"""Line dedup with a deletion-neighbourhood join.

A line is what stands between line breaks; its content are its words, and blank lines are left alone. Lines with equal
content keep the earliest in the corpus. Lines of at least ``min_words`` words that are one edit apart (a word
replaced, inserted or deleted) keep the earliest too: the join emits, for each content, the hash of every variant with
one word deleted. Two contents of equal length are one replacement apart iff they share a variant at the same
place; a content is one insertion apart from another iff it equals a variant of it. So a grouped minimum of the first
occurrences over each variant finds an earlier neighbour, whatever the size of the group, and no pairs are listed. The
found neighbour of each line is then verified on the words themselves.

Variants are emitted only for contents that can have a neighbour: one edit leaves the first or the second half
of a line as it is, so contents that share no half (for any length a neighbour may have) are out first.

All is judged on the input: a line is removed if an earlier one is equal or one edit apart, removed itself or not.

Edge cases: null and empty texts have no lines; "earlier" is by doc_id, then line; a null doc_id comes last; rows that
share a doc_id count in the order of a hash of their text, exactly equal rows as one document; extra columns are kept, but for those
that bear the name of an output in any case (``prefix`` renames the outputs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ferret.llm.common import SMALL_SLICE, Text, U, keyed, long_array, mix64, powers, ranges_hash, slices, stage

MIN_WORDS, CHUNK = 10, 1 << 20


class Lines:
    """Lines with words of a slice: document, number within it (all lines counted), bounds in words, content hashes."""

    def __init__(self, t: Text):
        breaks = np.flatnonzero(t.data == 10)
        n_words = len(t.starts)
        doc = np.repeat(np.arange(t.n), np.diff(t.wptr))
        line = np.searchsorted(breaks, t.starts)  # line breaks before the word
        new = np.ones(n_words, bool)
        new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        self.lo = np.flatnonzero(new)
        self.hi = np.append(self.lo[1:], n_words)[:len(self.lo)]
        self.doc = doc[self.lo]
        self.number = line[self.lo] - np.searchsorted(breaks, t.off[self.doc])
        self.h = t.word_hashes()
        self.size = self.hi - self.lo
        self.c1, self.c2 = (ranges_hash(self.h, self.lo, self.hi, s) for s in (0, 77))


def _all_lines(batches):
    for b in batches:
        for part in slices(b, "text", SMALL_SLICE):
            x = Lines(Text(part.column("text")))
            ids, th = part.column("doc").to_numpy(), part.column("th").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [long_array(x.c1), long_array(x.c2), pa.array(ids[x.doc]), pa.array(th[x.doc]), pa.array(x.number.astype(np.int32))],
                names=["c1", "c2", "doc", "th", "line"])


def _halves(min_words: int):
    """(key, c1): hashes of the first and second half of a content, for its own length as the shorter and as the longer
    one of a pair. Each task emits a content once."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for part in slices(b, "text", SMALL_SLICE):
                x = Lines(Text(part.column("text")))
                ok = np.flatnonzero(x.size >= min_words)
                ok = ok[np.unique(x.c1[ok], return_index=True)[1]]
                ok = np.array([i for i, c in zip(ok.tolist(), x.c1[ok].tolist()) if c not in seen], np.int64)
                seen.update(x.c1[ok].tolist())
                if len(seen) > CHUNK // 2:  # forgetting only costs repeated rows
                    seen.clear()
                lo, hi, n = x.lo[ok], x.hi[ok], x.size[ok]
                keys = []
                for short in (n, n - 1):
                    left = short // 2
                    keys.append(mix64(ranges_hash(x.h, lo, lo + left) + short.astype(U)))
                    keys.append(mix64(ranges_hash(x.h, hi - (short - left), hi) + short.astype(U) + U(1 << 40)))
                yield pa.RecordBatch.from_arrays([long_array(np.concatenate(keys)), long_array(np.tile(x.c1[ok], 4))], names=["key", "c1"])

    return run


def _variants(batches):
    """Of the wanted lines: key and check (two hashes of a variant), role (S: variant at its place, D: variant, F: the
    whole line, which may be a variant of a longer one), c1 and the line's first occurrence."""
    roles = pa.array(["S", "D", "F"])
    for b in batches:
        for part in slices(b, "text", SMALL_SLICE):
            x = Lines(Text(part.column("text")))
            want = part.column("lines")
            at = {}
            for i, (d, k) in enumerate(zip(x.doc.tolist(), x.number.tolist())):
                at[d, k] = i
            owner = np.repeat(np.arange(part.num_rows), want.value_lengths().to_numpy())
            rows = np.array([at[d, k] for d, k in zip(owner.tolist(), want.flatten().to_pylist())], np.int64)
            ids, th = part.column("doc").to_numpy(), part.column("th").to_numpy()
            for i in range(0, len(rows), 1024):
                r = rows[i:i + 1024]
                n = x.size[r]
                line = np.repeat(np.arange(len(r)), n)
                place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
                lo, hi, cut = x.lo[r][line], x.hi[r][line], x.lo[r][line] + place
                both = []
                for seed in (0, 77):
                    g = mix64(x.h + U(seed)) if seed else x.h
                    acc = np.zeros(len(g) + 1, U)
                    np.cumsum(g * powers(False, len(g)), out=acc[1:])
                    inv = powers(True, len(g) + 2)
                    left, right = (acc[cut] - acc[lo]) * inv[lo], (acc[hi] - acc[cut + 1]) * inv[lo + 1]
                    both.append(mix64(left + right + (hi - lo - 1).astype(U) * U(0xD6E8FEB86659FD93)))
                key = np.concatenate([mix64(both[0] ^ mix64(place.astype(U) + U(1))), both[0], x.c1[r]])
                check = np.concatenate([both[1], both[1], x.c2[r]])
                role = roles.take(pa.array(np.repeat(np.arange(3), [len(line), len(line), len(r)])))
                line = np.concatenate([line, line, np.arange(len(r))])
                d = x.doc[r][line]
                yield pa.RecordBatch.from_arrays(
                    [long_array(key), long_array(check), role, long_array(x.c1[r][line]),
                     pa.array(ids[d]), pa.array(th[d]), pa.array(x.number[r][line].astype(np.int32))], names=["key", "check", "role", "c1", "doc", "th", "line"])


def _words_of(batches):
    """c1 and words of the wanted lines."""
    for b in batches:
        for part in slices(b, "text", SMALL_SLICE):
            t = Text(part.column("text"))
            x = Lines(t)
            want = {(d, k) for d, ks in enumerate(part.column("lines").to_pylist()) for k in ks}
            pick = [i for i, (d, k) in enumerate(zip(x.doc.tolist(), x.number.tolist())) if (d, k) in want]
            raw = t.data.tobytes()
            words = [" ".join(raw[t.starts[j]:t.ends[j]].decode() for j in range(x.lo[i], x.hi[i])) for i in pick]
            yield pa.RecordBatch.from_arrays([long_array(x.c1[pick]), pa.array(words, pa.string())], names=["c1", "words"])


def within_one(a: list, b: list) -> bool:
    """Whether at most one replacement, insertion or deletion turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _verified(batches):
    for b in batches:
        ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(b.column("words").to_pylist(), b.column("other").to_pylist())]
        yield b.filter(pa.array(ok, pa.bool_())).select(["c1"])


def _rebuild(names: list[str], at: int, outputs: list[str]):
    def run(batches):
        for b in batches:
            out, total, gone, near = [], [], [], []
            for text, drop, close in zip(b.column(at).to_pylist(), b.column("gone").to_pylist(), b.column("near").to_pylist()):
                lines = (text or "").split("\n")
                drop, full = set(drop or ()), 0
                full = sum(1 for x in lines if x.strip(" \t\n\v\f\r"))
                out.append(text if text is None or not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                total.append(full)
                gone.append(len(drop))
                near.append(close or 0)
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.int64()) for x in (total, gone, near)]], names=[*names, *outputs])

    return run


def near_lines(texts: DataFrame, rows: DataFrame, contents: DataFrame, min_words: int) -> DataFrame:
    """c1 of every content that has an earlier one within one edit. ``texts`` is dealt out by doc and th; all who read it
    take all its columns, so that Spark shuffles it once."""
    halves = rows.mapInArrow(_halves(min_words), "key long, c1 long")
    group = Window.partitionBy("key")
    maybe = halves.withColumn("least", F.min("c1").over(group)).withColumn("most", F.max("c1").over(group)).where("least <> most").select("c1").distinct()
    wanted = stage(contents.join(maybe, "c1").select("c1", "first.doc", "first.th", "first.line"), "candidates")
    lists = wanted.groupBy("doc", "th").agg(F.collect_list("line").alias("lines"))  # bounded by the document
    own = texts.join(lists, ["doc", "th"])
    v = own.mapInArrow(_variants, "key long, check long, role string, c1 long, doc long, th long, line int")
    v = v.select("key", "check", (F.col("role") == "S").alias("same"), "role", F.struct(F.struct("doc", "th", "line").alias("first"), "c1").alias("me"))
    by = Window.partitionBy("key", "check", "same")
    least = lambda r: F.min(F.when(F.col("role") == r, F.col("me"))).over(by)
    v = v.select("role", "me", least("S").alias("s"), least("D").alias("d"), least("F").alias("f"))
    witness = F.when(F.col("role") == "S", F.col("s")).when(F.col("role") == "D", F.col("f")).otherwise(F.col("d"))
    found = v.withColumn("w", witness).where(F.col("w.first") < F.col("me.first")).groupBy(F.col("me.c1").alias("c1")).agg(F.min("w").alias("w"))
    found = found.select("c1", F.col("w.c1").alias("other_c1"))
    words = own.mapInArrow(_words_of, "c1 long, words string")  # candidates are first occurrences: one row a content
    pairs = found.join(words, "c1").join(words.select(F.col("c1").alias("other_c1"), F.col("words").alias("other")), "other_c1").select("c1", "words", "other")
    return pairs.mapInArrow(_verified, "c1 long")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the kept lines as text, and n_lines (with words), n_removed and n_near (of those, the ones
    removed for a line that is not equal)."""
    outputs = [prefix + c for c in ("n_lines", "n_removed", "n_near")]
    names = [c for c in docs.columns if c.lower() not in outputs]
    fields = {c: docs.schema[c] for c in names}
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]
    rows = keyed(docs, *others, F.col("text").isNull().alias("no_text"))
    lines = stage(rows.mapInArrow(_all_lines, "c1 long, c2 long, doc long, th long, line int"), "lines")
    contents = stage(lines.groupBy("c1", "c2").agg(F.min(F.struct("doc", "th", "line")).alias("first")), "contents")
    texts = rows.repartition("doc", "th")
    near = near_lines(texts, rows, contents, min_words).distinct().withColumn("near", F.lit(True))
    judged = lines.join(contents, ["c1", "c2"]).join(near, "c1", "left").withColumn("later", F.struct("doc", "th", "line") != F.col("first"))
    gone = judged.where("later or near").groupBy("doc", "th").agg(F.collect_set("line").alias("gone"), F.collect_set(F.when(~F.col("later"), F.col("line"))).alias("near"))
    out = texts.join(gone, ["doc", "th"], "left").withColumn("text", F.when(~F.col("no_text"), F.col("text")))
    out = out.select(*[F.col("text" if c == "text" else f"c{i}") for i, c in enumerate(names)], "gone", F.size(F.coalesce("near", F.array().cast("array<int>"))).alias("near"))
    schema = StructType([fields[c] for c in names])
    for c in outputs:
        schema = schema.add(c, LongType())
    return out.mapInArrow(_rebuild(names, names.index("text"), outputs), schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB SQL: variants as lists of words with one left out.
OP6_SQL = f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line_text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
lines AS (
  SELECT doc_id, line_no, line_text, list_filter(regexp_split_to_array(line_text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM raw),
contents AS (
  SELECT words, min(struct_pack(d := doc_id, l := line_no)) AS first FROM lines WHERE len(words) > 0 GROUP BY words),
variants AS (
  SELECT words, first, i, list_concat(words[1:i - 1], words[i + 1:]) AS v
  FROM (SELECT words, first, unnest(generate_series(1, len(words))) AS i FROM contents WHERE len(words) >= {MIN_WORDS})),
near AS (
  SELECT a.words FROM variants a JOIN (SELECT v, i, min(first) AS f FROM variants GROUP BY v, i) b ON a.v = b.v AND a.i = b.i WHERE b.f < a.first
  UNION SELECT a.words FROM variants a JOIN contents c ON a.v = c.words WHERE len(c.words) >= {MIN_WORDS} AND c.first < a.first
  UNION SELECT c.words FROM variants a JOIN contents c ON a.v = c.words WHERE len(c.words) >= {MIN_WORDS} AND a.first < c.first),
judged AS (
  SELECT l.doc_id, l.line_no, l.line_text, len(l.words) > 0 AS full_line,
         coalesce(struct_pack(d := l.doc_id, l := l.line_no) <> c.first, false) AS later,
         l.words IN (SELECT words FROM near) AS close
  FROM lines l LEFT JOIN contents c ON l.words = c.words)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (full_line AND (later OR close)) AS n_removed,
       count(*) FILTER (full_line AND close AND NOT later) AS n_near,
       sha256(coalesce(string_agg(line_text, chr(10) ORDER BY line_no) FILTER (NOT (full_line AND (later OR close))), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
