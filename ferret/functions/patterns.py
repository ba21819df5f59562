"""Counts of many patterns in one pass over the bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20


class PatternCounter:
    """Counts the non-overlapping occurrences of all patterns in one pass over the UTF-8 bytes of a text column.

    The first two bytes of every position look up the patterns that begin with them; the few positions that remain are
    compared with the rest of their patterns. Patterns of one byte are looked up by it; an empty pattern never occurs.
    """

    def __init__(self, patterns: list[str]):
        self.raw = [p.encode() for p in patterns]
        self.one = {p[0]: [i for i, q in enumerate(self.raw) if q == p] for p in self.raw if len(p) == 1}
        starts = sorted({p[:2] for p in self.raw if len(p) > 1})
        self.code = np.zeros(1 << 16, np.uint16 if len(starts) < 1 << 16 else np.uint32)
        self.of = [[]]
        for s in starts:
            self.code[s[0] << 8 | s[1]] = len(self.of)
            self.of.append([i for i, q in enumerate(self.raw) if q[:2] == s])

    def counts(self, col: pa.Array) -> np.ndarray:
        """A row of counts for each text; a null text counts as empty."""
        col = col.cast(pa.large_string()).fill_null("")
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
        x = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
        off = off - off[0]
        out = np.zeros((len(col), len(self.raw)), np.int64)
        for byte, which in self.one.items():
            out[:, which] = np.diff(np.searchsorted(np.flatnonzero(x == byte), off))[:, None]
        if len(x) < 2:
            return out
        code = self.code[x[:-1].astype(np.uint16) << 8 | x[1:]]
        at = np.flatnonzero(code)
        kind, doc = code[at], np.searchsorted(off, at, side="right") - 1
        at, kind, doc = (v[at + 2 <= off[doc + 1]] for v in (at, kind, doc))
        order = np.argsort(kind, kind="stable")
        at, doc, bounds = at[order], doc[order], np.searchsorted(kind[order], np.arange(len(self.of) + 1))
        for k in range(1, len(self.of)):
            for i in self.of[k]:
                here, inside = at[bounds[k]:bounds[k + 1]], doc[bounds[k]:bounds[k + 1]]
                tail = self.raw[i][2:]
                if tail:
                    fits = here + len(self.raw[i]) <= off[inside + 1]
                    here, inside = here[fits], inside[fits]
                    for j, byte in enumerate(tail):
                        hit = x[here + 2 + j] == byte
                        here, inside = here[hit], inside[hit]
                if len(here) > 1 and (np.diff(here) < len(self.raw[i])).any():  # occurrences overlap: the leftmost count
                    taken, end = [], -1
                    for n, pos in enumerate(here.tolist()):
                        if pos >= end:
                            taken.append(n)
                            end = pos + len(self.raw[i])
                    inside = inside[taken]
                out[:, i] = np.bincount(inside, minlength=len(col))
        return out


def text_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``SLICE_BYTES`` of text, or one longer text."""
    off = np.frombuffer(b.column(1).cast(pa.large_string()).buffers()[1], np.int64)[b.column(1).offset:b.column(1).offset + b.num_rows + 1] if b.num_rows else []
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        yield b.slice(i, min(j, b.num_rows) - i)
        i = min(j, b.num_rows)
