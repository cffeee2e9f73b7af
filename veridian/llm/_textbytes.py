"""Byte-level text kernels shared by the text operators.

Everything here works on whole Arrow string columns: bytes are classified by a
256-entry table, words are found from class changes, and every word gets a
64-bit polynomial hash from one prefix sum.  No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The ASCII white space of the contract: 0x20 and 0x09-0x0D.
ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[list(ASCII_SPACE)] = True

#: Everything that cannot be part of a letter run: ASCII except a-z (text is lower-cased first).
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[ord("a") : ord("z") + 1] = False
NOT_LETTER[0x80:] = False

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Bytes that are hashed at once; they take some forty times as much, and the powers that a worker keeps another thirty.
WINDOW = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64 (kept per worker; n is WINDOW at most)."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for key, base in (("up", _MULT), ("down", _MULT_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls: empty) and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """The words of each row of a string column, as positions in its bytes.

    ``start``/``end``: byte range of each word; ``row``: index of the first word of each row
    (len rows + 1).  ``buf`` is the lower-cased bytes.
    """

    def __init__(self, column: pa.Array, separator: np.ndarray = SPACE):
        raw, self.offsets = text_bytes(column)
        self.raw = raw
        self.buf = LOWER[raw]
        inside = ~separator[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def hashes(self, first: int | None = None) -> np.ndarray:
        """One 64-bit hash for each word: equal bytes give equal hashes in every task.

        ``first``: of the first so many bytes of each word only.  A hash is a polynomial in the word's own
        bytes, so bytes are taken in windows of WINDOW and a long text needs no more than a short one.
        """
        end = self.end if first is None else np.minimum(self.end, self.start + first)
        out = np.empty(len(end), dtype=np.uint64)
        at = 0
        while at < len(end):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(end, base + WINDOW, side="right")))
            if end[at] - base > WINDOW:
                out[at] = self._long_word(int(base), int(end[at]))
                at += 1
                continue
            lo, hi = self.start[at:to] - base, end[at:to] - base
            up, down = _powers(int(hi[-1]))
            total = np.zeros(int(hi[-1]) + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum((self.buf[base : base + hi[-1]].astype(np.uint64) + np.uint64(1)) * up[: hi[-1]], out=total[1:])
                out[at:to] = (total[hi] - total[lo]) * down[lo]
            at = to
        with np.errstate(over="ignore"):
            return mix64(out + (end - self.start).astype(np.uint64))

    def _long_word(self, start: int, end: int) -> np.uint64:
        """The polynomial of a word longer than a window."""
        total, step, one = np.uint64(0), np.uint64(pow(int(_MULT), WINDOW, 1 << 64)), np.uint64(1)
        up, _ = _powers(WINDOW)
        with np.errstate(over="ignore"):
            for at in range(start, end, WINDOW):
                part = self.buf[at : min(end, at + WINDOW)].astype(np.uint64) + np.uint64(1)
                total += (part * up[: len(part)]).sum(dtype=np.uint64) * one
                one *= step
        return total

    def strings(self, which: np.ndarray | None = None) -> list[str]:
        """The text of the chosen words (few of them: this decodes one by one)."""
        pick = range(len(self.start)) if which is None else which
        data = self.buf.tobytes()
        return [data[self.start[i] : self.end[i]].decode("utf-8", "replace") for i in pick]


def row_blocks(batch: pa.RecordBatch, text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most_bytes`` of text each (a longer row stays whole)."""
    column = batch.column(batch.schema.names.index(text))
    _, off = text_bytes(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1
        to = min(len(column), max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each segment bounds[i]:bounds[i+1] (empty segments: 0), for 1-D or 2-D values."""
    shape = (len(bounds) - 1, *values.shape[1:])
    out = np.zeros(shape, dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out
