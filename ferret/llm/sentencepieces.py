"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

A text gets a leading mark and its spaces become marks, then falls into marked words: a run of marks with what
follows it up to the next mark; line breaks and tabs stand alone, since no longer piece of the vocabulary holds one (checked). No
piece crosses these borders, so the best segmentation of a text is that of its words. The distinct words of an Arrow
slice that the task has not met yet are sorted and walked as a trie, depth first: the forward scores and the open
vocabulary pieces of a prefix are kept on a stack and reused by every word that shares it. Words then become ids by
array lookups. Nothing is shuffled, and the memory is bounded by ``CACHE_WORDS`` and the slice.

The vocabulary file is a BPE model whose scores are merge ranks, not log probabilities; their sum means
nothing. Ranks are turned into log probabilities by Zipf's law (``-ln(rank + 2)``), scaled to integers so that sums
are exact; of equally good segmentations the one with the longest last piece wins, at every position. A character
without a piece costs more than any piece and becomes its UTF-8 byte pieces.

Edge cases: null texts have null ids and decode to null; an empty text has no ids and decodes to an empty one; a mark
character (U+2581) that stands in the text itself decodes to a space, as in the format; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ferret.llm.common import slices

MARK = "▁"
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_WORDS, SLICE = 100_000, 1 << 19
_WORDS = re.compile(f"{MARK}+[^{MARK}\n\t]*|[^{MARK}\n\t]+|[\n\t]")


class Vocabulary:
    """Pieces, byte pieces and integer scores of a vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {}
        self.score: dict[str, tuple[int, int]] = {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[p] = (round(-math.log(max(0.0, -model.get_score(i)) + 2) * 65536), i)
        if any(c in p for p in self.score if len(p) > 1 for c in "\n\t") or any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces that cross word borders are not supported")
        self.unknown = min(s for s, _ in self.score.values()) - 10 * 65536
        self.trie: dict = {}
        for p, v in self.score.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[0] = v
        self._bytes = [b""] * n
        for p, (_, i) in self.score.items():
            self._bytes[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self._bytes[i] = bytes([b])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(b) for b in self._bytes])
        return np.frombuffer(b"".join(self._bytes), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]), size


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary file, read once a worker."""
    if path not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_sorted(words: list[str], voc: Vocabulary) -> list[list[int]]:
    """Best pieces of each of the sorted ``words``."""
    root, unknown, byte_id = voc.trie, voc.unknown, voc.byte_id
    best, back, open_, out, last = [0], [None], [()], [], ""
    for w in words:
        k, most = 0, min(len(w), len(last))
        while k < most and w[k] == last[k]:
            k += 1
        del best[k + 1:], back[k + 1:], open_[k + 1:]
        for j in range(k, len(w)):
            c, now, top, via = w[j], [], None, None
            for node, score, start in open_[j]:  # pieces begun earlier, the longest first
                node = node.get(c)
                if node is not None:
                    now.append((node, score, start))
                    end = node.get(0)
                    if end is not None and (top is None or score + end[0] > top):
                        top, via = score + end[0], (start, end[1])
            node = root.get(c)
            end = None
            if node is not None:
                now.append((node, best[j], j))
                end = node.get(0)
            score = best[j] + (unknown if end is None else end[0])
            if top is None or score > top:
                top, via = score, (j, -1 if end is None else end[1])
            best.append(top)
            back.append(via)
            open_.append(now)
        ids, j = [], len(w)
        while j:
            start, i = back[j]
            if i < 0:
                ids.extend(byte_id[b] for b in reversed(w[start:j].encode()))
            else:
                ids.append(i)
            j = start
        ids.reverse()
        out.append(ids)
        last = w
    return out


class Encoder:
    """Encodes slices of texts; remembers the pieces of the words it has met, up to ``CACHE_WORDS``."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's."""
        if len(self.number) > CACHE_WORDS:
            self._forget()
        words, ptr = [], [0]
        for x in texts:
            if x:
                words += _WORDS.findall(MARK + x.replace(" ", MARK))
            ptr.append(len(words))
        fresh = sorted(set(words).difference(self.number))
        if fresh:
            found = encode_sorted(fresh, self.voc)
            n = len(self.number)
            self.number.update(zip(fresh, range(n, n + len(fresh))))
            size = np.cumsum([len(f) for f in found]) + self.start[-1]
            self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.int32)])
            self.start = np.concatenate([self.start, size])
        w = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return gather(self.ids, self.start[w], self.start[w + 1] - self.start[w], np.array(ptr))


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the spans ``pool[start:start + size]``; ``ptr`` bounds the spans of each row."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pool[at], ends[ptr]


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of piece ids of ``column``."""
    kept = [c for c in docs.columns if c != ids]
    at = kept.index(column)

    def run(batches):
        encoder = Encoder(vocabulary_of(vocabulary))
        for b in batches:
            b = b.rename_columns([f"c{i}" for i in range(b.num_columns)])
            for s in slices(b, f"c{at}", SLICE):
                flat, ptr = encoder.encode(s.column(at).to_pylist())
                col = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(flat), mask=s.column(at).is_null())
                yield pa.RecordBatch.from_arrays([*s.columns, col], names=[*kept, ids])

    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    return src.mapInArrow(run, StructType([*src.schema.fields]).add(ids, ArrayType(IntegerType())))


def decode_ids(flat: np.ndarray, ptr: np.ndarray, tables) -> list[str]:
    """The text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
    pool, start, size = tables
    data, off = gather(pool, start[flat], size[flat], ptr)
    raw = data.tobytes()
    texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
    return [x[1:] if x[:1] == " " else x for x in texts]


def decode_documents(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` with a column of the texts that its ids stand for."""
    kept = [c for c in encoded.columns if c != column]
    at = kept.index(ids)

    def run(batches):
        tables = vocabulary_of(vocabulary).tables()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                lists = s.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ptr = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = decode_ids(flat, ptr, tables)
                col = pa.array([x if ok else None for x, ok in zip(texts, lists.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*s.columns, col], names=[*kept, column])

    src = encoded.select(*[F.col(f"`{c}`") for c in kept])
    return src.mapInArrow(run, StructType([*src.schema.fields]).add(column, StringType()))


def token_digests(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Encode and decode without leaving the task: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_sha256, round_trip (the decoded text is the text). A null text counts as empty."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        voc = vocabulary_of(vocabulary)
        encoder, tables = Encoder(voc), voc.tables()
        for b in batches:
            for s in slices(b, "text", SLICE):
                texts = [x or "" for x in s.column("text").to_pylist()]
                flat, ptr = encoder.encode(texts)
                decoded = decode_ids(flat, ptr, tables)
                flat = flat.astype("<i4", copy=False)
                yield pa.RecordBatch.from_arrays([
                    s.column("doc_id"), pa.array(np.diff(ptr)), pa.array([sha(flat[a:z].tobytes()) for a, z in zip(ptr[:-1], ptr[1:])], pa.string()),
                    pa.array([sha(x.encode()) for x in decoded], pa.string()), pa.array([x == y.replace(MARK, " ") for x, y in zip(decoded, texts)], pa.bool_())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
