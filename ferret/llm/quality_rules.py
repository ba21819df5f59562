"""Quality rules learned as an ordered decision list.

Statistics of every whole text are computed per Arrow batch. Rules that reject are learned by sequential covering:
a conjunction of thresholds is grown on two thirds of the labelled rows by information gain, pruned on the other
third, kept if it is precise enough there, and the rows it covers are taken away before the next is grown. The
list is emitted as one ``CASE WHEN`` expression over the statistics columns, first match wins.

Edge cases: null or empty texts have all statistics 0 (and fail the base test on n_words); with no labels, or
labels of one class, the list is empty and only the base test decides; repeated labels of one document count once
each; tables may be empty and may carry extra columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferret.llm.common import Text, mix64, slices, spans_hash, stage, windows_hash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _MARK = _lut(b"#*$%&|<>"), _lut(b"!?")
_UPPER = _lut(bytes(range(65, 91)))
_LETTER = _lut(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100)))


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=acc[1:])
    return acc[off[1:]] - acc[off[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it occurs twice or more, and whether an equal one stands earlier."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    t = Text(col)
    n_words = np.diff(t.wptr)
    in_word = np.zeros(len(t.data) + 1, np.int32)
    np.add.at(in_word, t.starts, 1)
    np.add.at(in_word, t.ends, -1)
    in_word = np.cumsum(in_word[:-1]) > 0
    out = {
        "n_words": n_words,
        "word_chars": _per_doc(in_word & ((t.data & 0xC0) != 0x80), t.off),
        "n_symbols": _per_doc(_SYMBOL[t.data], t.off),
        "n_upper": _per_doc(_UPPER[t.data], t.off),
        "n_letters": _per_doc(_LETTER[t.data], t.off),
        "n_marks": _per_doc(_MARK[t.data], t.off),
    }
    # lines with a word; those equal to an earlier one of their document
    breaks = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate([t.off[:-1], breaks + 1]))
    owner = np.searchsorted(t.off[1:], starts, side="right")
    inside = owner < t.n
    # a break that ends a text makes an empty line at the next text's start; it holds no word, so its owner does not matter
    starts, owner = starts[inside], owner[inside]
    ends = np.append(starts[1:], len(t.data))
    at_break = np.zeros(len(t.data) + 1, bool)
    at_break[breaks + 1] = True
    line_end = np.where(at_break[ends] & (ends > starts), ends - 1, ends)
    line_end = np.minimum(line_end, t.off[1:][owner])
    full = np.searchsorted(t.starts, line_end) > np.searchsorted(t.starts, starts)
    starts, line_end, owner = starts[full], line_end[full], owner[full]
    doc_key = mix64(np.arange(t.n, dtype=np.uint64) + np.uint64(1))
    _, later = _repeated(spans_hash(t.data, starts, line_end) ^ doc_key[owner])
    out["n_dup_lines"] = np.bincount(owner[later], minlength=t.n)
    out["n_lines"] = np.bincount(owner, minlength=t.n)
    # words in windows of three that are found twice or more in their document
    w = windows_hash(t.word_hashes(), 3)
    word_doc = np.repeat(np.arange(t.n), n_words)
    cover = np.zeros(len(t.starts), bool)
    if len(w):
        valid = np.flatnonzero(word_doc[:-2] == word_doc[2:])
        twice, _ = _repeated(w[valid] ^ doc_key[word_doc[valid]])
        hit = valid[twice]
        for k in range(3):
            cover[hit + k] = True
    out["n_repeat_words"] = np.bincount(word_doc[cover], minlength=t.n)
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                s = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(s[c].astype(np.int64)) for c in COUNTS]], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def ratios() -> dict[str, Column]:
    """What the rules may test: shares and means, so that a threshold means the same for short and long texts."""
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "mean_word_chars": r("word_chars", "n_words"), "symbol_share": r("n_symbols", "n_words"), "dup_line_share": r("n_dup_lines", "n_lines"),
        "repeat_share": r("n_repeat_words", "n_words"), "upper_share": r("n_upper", "n_letters"), "mark_share": r("n_marks", "n_words"),
        "words_per_line": r("n_words", "n_lines"),
    }


# ---------------------------------------------------------------- learning (driver, on a bounded sample)

Condition = tuple[int, bool, float]  # feature, is upper bound, threshold


def covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, upper, at in rule:
        hit &= x[:, f] <= at if upper else x[:, f] > at
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    hit = np.ones(len(x), bool)
    while len(rule) < max_conditions:
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p or not n:
            break
        base, best = math.log2(p / (p + n)), (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[hit, f])
            if len(values) < 2:
                continue
            mids = (values[1:] + values[:-1]) / 2
            mids = np.unique(mids[np.linspace(0, len(mids) - 1, min(cuts, len(mids))).astype(int)])
            order = np.sort(x[hit & bad, f]), np.sort(x[hit & ~bad, f])
            below = [np.searchsorted(o, mids, side="right") for o in order]
            for upper in (False, True):
                a = below[0] if upper else p - below[0]
                b = below[1] if upper else n - below[1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / np.maximum(a + b, 1)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, upper, float(mids[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = covers(rule, x)
    return rule


def learn_list(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, cuts: int = 128,
               min_precision: float = 0.9, min_cover: int = 3) -> list[list[Condition]]:
    """Ordered rules that mark ``bad`` rows. A row's part (grow or prune) is its position modulo three."""
    rules, left = [], np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules and (left & bad & ~third).any():
        rule = _grow(x[left & ~third], bad[left & ~third], max_conditions, cuts)
        if not rule:
            break

        def worth(r):
            hit = covers(r, x) & left & third
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), -len(r)))
        hit = covers(best, x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(best)
        left &= ~hit
    return rules


def decision(rules: list[list[Condition]], features: dict[str, Column]) -> Column:
    """The list as a Spark expression: number of the first rule that holds, null if none does."""
    cols = list(features.values())
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for f, upper, at in rule:
            cond = cond & ((cols[f] <= F.lit(at)) if upper else (cols[f] > F.lit(at)))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def rule_text(rules: list[list[Condition]]) -> list[str]:
    names = list(ratios())
    return [" and ".join(f"{names[f]} {'<=' if u else '>'} {at:g}" for f, u, at in r) for r in rules]


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000) -> tuple[DataFrame, list[str]]:
    """All statistics of every document, base_failed, rule (number of the first rejecting rule or null) and kept; and
    the rules as text.

    ``max_labelled`` bounds the labelled rows the list is learned from; they are those with the smallest hash of
    doc_id. Everything else covers all documents.
    """
    stats = stage(document_statistics(docs), "statistics")
    feats = ratios()
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    sample = marked.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "quality").limit(max_labelled)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stats.where(~base).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", *[c.alias(k) for k, c in feats.items()])
    rows = rows.limit(2 * max_labelled).toPandas().sort_values(["doc_id", "quality", *feats], kind="stable")  # repeated ids could double the rows
    x, bad = rows[list(feats)].to_numpy(float), (rows["quality"] == 0).to_numpy()
    order = np.argsort(mix64(np.arange(len(x), dtype=np.uint64)), kind="stable")  # thirds that do not follow doc_id
    rules = learn_list(x[order], bad[order]) if bad.any() and not bad.all() else []
    out = stats.withColumn("base_failed", base).withColumn("rule", decision(rules, feats))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out, rule_text(rules)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels)[0].select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
