"""Token counts of a byte-level BPE vocabulary by a map-side two-tier lookup.

A text falls into pre-tokens (words with their leading space, runs of digits, of signs, of white space), which the
vocabulary encodes one by one, so a count is the sum of the pre-tokens' lengths in tokens. Pre-tokens are found and hashed
(64 bits) on the code points of whole slices with numpy. Their lengths come from

1. a compact hash table (open addressing, ``TABLE_SLOTS`` slots of a hash and a length, so of a fixed size) of the frequent
   pre-tokens of all documents, which is broadcast, then
2. a cache of the Python worker, keyed by hash, of at most ``CACHE_WORDS`` pre-tokens; only what is in neither is encoded
   by the library, each distinct pre-token of a slice once.

No pre-token is ever shuffled. The frequent ones are found by a pass over all documents in which every task keeps a
Misra-Gries summary of ``SUMMARY`` pre-tokens; summaries, one row a task, are merged in a tree of tasks. The table only
decides which lookups are cheap; the counts are exact with any table.

White space, letters and digits are classed as the vocabulary's own library classes them (``code_point_classes`` asks it), since
Unicode versions differ. A special string inside a text is one token, as the library has it by default.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept, each row on its own;
a very long text is taken in pieces that end where a space follows another character, which is always a border of pre-tokens; an
empty table gives an empty result; extra columns of any name stay as they are unless they bear an output's name.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from ferret.llm.common import U, slices, spans_hash

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
TABLE_SLOTS, TABLE_WORDS = 1 << 16, 1 << 15
SUMMARY, FAN_IN = 1 << 13, 64
CACHE_WORDS, SLICE, PIECE = 500_000, 1 << 20, 1 << 20
MAX_VOCABULARY_BYTES = 64 << 20
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# the suffixes that the vocabulary's pattern splits from a word (fixed values)
SHORT_SUFFIXES, LONG_SUFFIXES = "stmd", ("re", "ve", "ll")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_TOKENIZER)


# ---------------------------------------------------------------- the vocabulary

def _library(raw: bytes):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(raw)


def read_vocabulary(path: str) -> tuple[bytes, list[str]]:
    """The file, which must be a byte-level BPE with the usual pattern, and its special strings."""
    raw = open(path, "rb").read()
    spec = json.loads(raw)
    pre = spec["pre_tokenizer"]
    if len(raw) > MAX_VOCABULARY_BYTES or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError(f"{path} is no byte-level BPE vocabulary without normaliser")
    special = [t["content"] for t in spec["added_tokens"]]
    if len(special) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("only one special string, without options, is supported")
    return raw, special


def code_point_classes(raw: bytes) -> np.ndarray:
    """Class of every code point: the library splits the string of all code points where the class changes, and tells of
    the last one of each part which neighbour it joins."""
    split = _library(raw).pre_tokenizer.pre_tokenize_str
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cps, out = np.array(every), np.full(0x110000, OTHER, np.uint8)
    bounds = [span for _, span in split("".join(map(chr, every)))]
    asked = {before: {a for _, (a, _) in split("".join(f"\n{before}{chr(cps[z - 1])}" for _, z in bounds))} for before in "x1!"}
    for i, (a, z) in enumerate(bounds):
        joined = [before for before in "x1!" if 3 * i + 2 not in asked[before]]
        out[cps[a:z]] = {"x": LETTER, "1": NUMBER, "!": OTHER}[joined[0]] if joined else SPACE
    out[0x20] = SPACE  # it has joined its neighbour
    return out


# ---------------------------------------------------------------- pre-tokens

def pieces(text: str, special: list[str]) -> list[str]:
    """The parts of a text between special strings, those over ``PIECE`` characters cut where a space follows another character."""
    out = []
    for part in text.split(special[0]) if special and special[0] in text else (text,):
        at = 0
        while len(part) - at > PIECE:
            cut = part.find(" ", at + PIECE)
            while cut > 0 and part[cut - 1].isspace():
                cut = part.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(part[at:cut])
            at = cut
        out.append(part[at:] if at else part)
    return out


def pretoken_bounds(cp: np.ndarray, seg: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the code points ``cp``; ``seg`` holds the starts of the pieces and their end."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = classes[cp]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    first = np.zeros(n + 1, bool)
    first[seg] = True
    first = first[:n]
    run |= first
    begin = run.copy()
    # white space before something else gives its last character away: a space joins what follows, any other stands alone
    after = np.flatnonzero(run[1:] & (kind[:-1] == SPACE) & ~first[1:]) + 1
    begin[after - 1] = True
    begin[after] = cp[after - 1] != 0x20
    # an apostrophe on its own takes one of the suffixes
    quote = np.flatnonzero((cp == 0x27) & begin)
    if len(quote):
        at = np.concatenate([cp, np.zeros(2, cp.dtype)])
        cut = np.concatenate([first, np.ones(3, bool)])
        same1, same2 = ~cut[quote + 1], ~cut[quote + 1] & ~cut[quote + 2]
        one = same1 & np.isin(at[quote + 1], [ord(c) for c in SHORT_SUFFIXES])
        two = np.zeros(len(quote), bool)
        for s in LONG_SUFFIXES:
            two |= same2 & (at[quote + 1] == ord(s[0])) & (at[quote + 2] == ord(s[1]))
        for which, size in ((one, 2), (two, 3)):
            q = quote[which]
            begin[q + 1] = False
            end = q + size
            end = end[end < n]
            begin[end[kind[end] == LETTER]] = True
    return np.flatnonzero(begin)


class Pretokens:
    """Distinct pre-tokens of a slice of texts: ``hashes``, ``counts``, and per text how often each occurs."""

    def __init__(self, texts: list[str], classes: np.ndarray, special: list[str]):
        parts, owner, self.specials = [], [], np.zeros(len(texts), np.int64)
        joined = any(special) and any(special[0] in t for t in texts)
        for i, t in enumerate(texts):
            p = pieces(t, special if joined else [])
            if joined:
                self.specials[i] = t.count(special[0])
            parts += p
            owner += [i] * len(p)
        cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts = np.concatenate([[0], ends])
        begin = pretoken_bounds(cp, starts, classes)
        stop = np.concatenate([begin[1:], [len(cp)]]) if len(begin) else begin
        h = spans_hash(cp, begin, stop)
        self.hashes, at, self.of, self.counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.begin, self.stop, self.cp = begin[at], stop[at], cp
        owner = np.array(owner, np.int64)
        self.row = owner[np.searchsorted(starts, begin, side="right") - 1] if len(begin) else begin

    def text(self, i: int) -> str:
        return self.cp[self.begin[i]:self.stop[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def only(self, which: np.ndarray) -> Pretokens:
        """The distinct pre-tokens ``which``, without the texts they come from."""
        part = object.__new__(Pretokens)
        part.hashes, part.begin, part.stop, part.cp = self.hashes[which], self.begin[which], self.stop[which], self.cp
        return part

    def per_text(self, lengths: np.ndarray) -> np.ndarray:
        """Sum of the lengths of each text's pre-tokens, plus its special strings."""
        return self.specials + np.bincount(self.row, lengths[self.of], len(self.specials)).astype(np.int64)


# ---------------------------------------------------------------- the two tiers

def build_table(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing; a length of 0 marks an empty slot."""
    keys, vals = np.zeros(TABLE_SLOTS, U), np.zeros(TABLE_SLOTS, np.uint16)
    for h, n in zip(hashes.tolist()[:TABLE_WORDS], lengths.tolist()):
        if n >= 1 << 16:
            continue
        at = h & (TABLE_SLOTS - 1)
        while vals[at]:
            at = (at + 1) & (TABLE_SLOTS - 1)
        keys[at], vals[at] = h, n
    return keys, vals


def probe(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Lengths of the hashes; 0 for those that the table does not hold."""
    keys, vals = table
    out = np.zeros(len(hashes), np.int64)
    at = (hashes & U(TABLE_SLOTS - 1)).astype(np.int64)
    todo = np.arange(len(hashes))
    while len(todo):
        v, hit = vals[at[todo]], keys[at[todo]] == hashes[todo]
        out[todo[hit & (v > 0)]] = v[hit & (v > 0)]
        todo = todo[~hit & (v > 0)]
        at[todo] = (at[todo] + 1) & (TABLE_SLOTS - 1)
    return out


class Counter:
    """Counts tokens; remembers the lengths of pre-tokens, up to ``CACHE_WORDS``. One per worker and vocabulary."""

    _kept: dict[int, Counter] = {}

    def __init__(self, raw: bytes, classes: np.ndarray, special: list[str]):
        self.library, self.classes, self.special = _library(raw), classes, special
        self.cache: dict[int, int] = {}
        self.encoded = 0

    @classmethod
    def of(cls, shipped) -> Counter:
        raw, classes, special = shipped
        key = hash(raw)
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(raw, np.frombuffer(classes, np.uint8), special)
        return cls._kept[key]

    def lengths(self, t: Pretokens, table=None) -> np.ndarray:
        out = probe(table, t.hashes) if table is not None else np.zeros(len(t.hashes), np.int64)
        miss = np.flatnonzero(out == 0)
        get = self.cache.get
        found = np.fromiter((get(h, 0) for h in t.hashes[miss].tolist()), np.int64, len(miss))
        out[miss] = found
        fresh = miss[found == 0]
        if len(fresh):
            if len(self.cache) + len(fresh) > CACHE_WORDS:
                self.cache.clear()
            coded = self.library.encode_batch_fast([t.text(i) for i in fresh.tolist()], add_special_tokens=False)
            out[fresh] = size = [len(e.ids) for e in coded]
            self.cache.update(zip(t.hashes[fresh].tolist(), size))
            self.encoded += len(fresh)
        return out


# ---------------------------------------------------------------- frequent pre-tokens

def trim(h: np.ndarray, n: np.ndarray, size: np.ndarray, keep: int = SUMMARY):
    """Misra-Gries: the ``keep`` most frequent (ties: the least hashes), their counts less the largest count that goes."""
    if len(h) <= keep:
        return h, n, size
    order = np.lexsort((h, -n))
    less, order = n[order[keep]], order[:keep]
    return h[order], n[order] - less, size[order]


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    h, n, size = (np.concatenate(x) for x in zip(*parts))
    h, at, of = np.unique(h, return_index=True, return_inverse=True)
    return h, np.bincount(of, n, len(h)).astype(np.int64), size[at]


SUMMARIES = "h binary, n binary, size binary"


def _row(s) -> pa.RecordBatch:
    h, n, size = s
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, n.astype(np.int64), size.astype(np.int64))], names=["h", "n", "size"])


def _rows(b: pa.RecordBatch):
    for h, n, size in zip(*(c.to_pylist() for c in b.columns)):
        yield np.frombuffer(h, U), np.frombuffer(n, np.int64), np.frombuffer(size, np.int64)


NOTHING = (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))


def frequent_pretokens(docs: DataFrame, column: str, shipped, keep: int = TABLE_WORDS):
    """Hashes and lengths of the frequent pre-tokens of all texts: summaries by task, merged ``FAN_IN`` at a time."""
    def summarise(batches):
        counter, have = Counter.of(shipped.value), NOTHING
        for b in batches:
            for s in slices(b, "text", SLICE):
                t = Pretokens([x or "" for x in s.column(0).to_pylist()], counter.classes, counter.special)
                h, n, size = trim(*merge([have, (t.hashes, t.counts, np.zeros(len(t.hashes), np.int64))]))
                fresh = np.flatnonzero(size == 0)
                size[fresh] = counter.lengths(t.only(np.searchsorted(t.hashes, h[fresh])))
                have = h, n, size
        yield _row(have)

    def combine(batches):
        have = NOTHING
        for b in batches:
            for s in _rows(b):
                have = trim(*merge([have, s]), 4 * SUMMARY)
        yield _row(have)

    level = docs.select(F.col(f"`{column}`").alias("text")).mapInArrow(summarise, SUMMARIES)
    tasks = level.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        level = level.repartition(tasks).mapInArrow(combine, SUMMARIES)
    got = [(np.frombuffer(r.h, U), np.frombuffer(r.n, np.int64), np.frombuffer(r.size, np.int64)) for r in level.collect()]  # at most FAN_IN rows
    h, _, size = trim(*merge([NOTHING, *got]), keep)
    return h, size


# ---------------------------------------------------------------- the operator

def count_tokens(docs: DataFrame, tokenizer: str | None = None, column: str = "text", limit: int = LIMIT, frequent: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``) of ``column``. ``frequent=False`` leaves the first tier and its
    pass out."""
    spark = docs.sparkSession
    raw, special = read_vocabulary(tokenizer or default_path())
    shipped = spark.sparkContext.broadcast((raw, code_point_classes(raw).tobytes(), special))  # at most 65 MB
    table = None
    if frequent:
        table = spark.sparkContext.broadcast(build_table(*frequent_pretokens(docs, column, shipped)))  # 640 KB
    outputs = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    at = kept.index(column)

    def run(batches):
        counter = Counter.of(shipped.value)
        for b in batches:
            b = b.rename_columns([f"c{i}" for i in range(b.num_columns)])
            for s in slices(b, f"c{at}", SLICE):
                texts = [x or "" for x in s.column(at).to_pylist()]
                t = Pretokens(texts, counter.classes, counter.special)
                n = t.per_text(counter.lengths(t, table.value if table else None))
                size = pa.array([len(x.encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*s.columns, size, pa.array(n), pa.array(n > limit)], names=[*kept, *outputs])

    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*src.schema.fields]).add("n_bytes", LongType()).add("n_tokens", LongType()).add("over_limit", BooleanType())
    return src.mapInArrow(run, schema)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
