"""Whole-column encoding with a tokenizer file of the ``tokenizers`` library.

The word-level BPE of such a file never looks across white space, and its
pre-tokenizer always cuts between an ASCII letter run, an ASCII digit and other
ASCII marks.  So a column is cut into such pieces with byte tables, every
*distinct* piece is encoded once by the library, and the ids are gathered back.
Ids of pieces met before are found for a whole column at once, by the pieces' bytes.
Pieces that hold anything else (accents, apostrophes, control bytes) go through
the library's complete ``encode`` as they stand; a text that spells a special
token goes through it whole.  The result is equal to ``encode`` on each text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from veridian.llm._textbytes import LOWER, SPACE, mix64, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_WS, _LETTER, _DIGIT, _MARK, _OPEN = range(5)  # _OPEN: nothing may be cut after it
_CLASS = np.full(256, _OPEN, dtype=np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("'")] = _OPEN
_CLASS[SPACE] = _WS

#: Whether a pre-token boundary is certain between two neighbouring bytes, by their classes.
_CUT = np.zeros((5, 5), dtype=bool)
_CUT[_WS, :] = True
_CUT[_LETTER, [_DIGIT, _MARK]] = True
_CUT[_DIGIT, [_LETTER, _DIGIT, _MARK]] = True
_CUT[_MARK, [_LETTER, _DIGIT]] = True
_CUT = _CUT.ravel()

#: Pieces that no step before the model changes, but for their case.
_PLAIN = re.compile(r"[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_alphabet()
del _BYTES[ord(" ")]  # it stands between pieces


class PieceTable:
    """Ids of pieces of up to BYTES bytes and IDS ids.  A piece has one place, given by its bytes, and a later piece may take it."""

    BYTES, IDS = 15, 8
    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

    def __init__(self, dtype: type, slots: int = 1 << 19):
        self.low, self.high = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint64)
        self.count, self.ids = np.zeros(slots, dtype=np.uint8), np.zeros((slots, self.IDS), dtype=dtype)

    def keys(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of each piece and, above them, their number as two integers, and its place.  Longer pieces have BYTES + 1 there, so are never found."""
        raw, off = text_bytes(pieces)
        raw = np.append(raw, np.zeros(16, dtype=np.uint8))
        eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        n = np.diff(off)
        low = eight[off[:-1]] & self._MASK[np.minimum(n, 8)]
        high = eight[off[:-1] + np.minimum(n, 8)] & self._MASK[np.clip(n - 8, 0, 7)]
        high |= np.minimum(n, self.BYTES + 1).astype(np.uint64) << np.uint64(56)
        return low, high, (mix64(low ^ mix64(high)) % np.uint64(len(self.low))).astype(np.int64)

    def put(self, low: np.ndarray, high: np.ndarray, place: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keeps the pieces that fit, whose ``ids`` follow one another; which those are."""
        fits = (high >> np.uint64(56) <= self.BYTES) & (count <= self.IDS)
        rows = np.zeros((int(fits.sum()), self.IDS), dtype=self.ids.dtype)
        rows[np.arange(self.IDS) < count[fits, None]] = ids[np.repeat(fits, count)]
        at, last = np.unique(place[fits][::-1], return_index=True)
        last = len(rows) - 1 - last
        self.low[at], self.high[at], self.count[at], self.ids[at] = low[fits][last], high[fits][last], count[fits][last], rows[last]
        return fits


class ColumnEncoder:
    """Encodes string columns with one tokenizer file; keeps a bounded table of distinct pieces and a bounded cache, ids as bytes, of those too long for it."""

    def __init__(self, path: str, cache_size: int = 1 << 17):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype == np.uint16 else "I"
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.table = PieceTable(self.dtype)

    def _pieces(self, unique: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct pieces, one after another, and how many each has."""
        low, high, place = self.table.keys(unique)
        known = (self.table.low[place] == low) & (self.table.high[place] == high)
        kept = place[known]
        count = np.zeros(len(unique), dtype=np.int64)
        count[known] = self.table.count[kept]
        rows = self.table.ids[kept][np.arange(self.table.IDS) < count[known, None]]
        new = np.flatnonzero(~known)
        if not len(new):
            return rows, count
        raw, off = text_bytes(unique)
        data = raw.tobytes()
        texts = [data[a:b].decode() for a, b in zip(off[new].tolist(), off[new + 1].tolist())]
        found = self._encoded(texts)
        count[new] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        fresh = np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=int(count[new].sum()))
        fits = self.table.put(low[new], high[new], place[new], count[new], fresh)
        odd = np.flatnonzero(~fits)
        if len(odd) <= self.cache_size:
            self.cache.update((texts[i], array(self.code, found[i]).tobytes()) for i in odd)
        of_known = np.repeat(known, count)
        flat = np.empty(len(of_known), dtype=self.dtype)
        flat[of_known], flat[~of_known] = rows, fresh
        return flat, count

    def _encoded(self, texts: list[str]) -> list[Sequence[int]]:
        """The ids of each piece that the table does not hold."""
        if len(self.cache) > self.cache_size // 2:
            self.cache, self.older = {}, self.cache
        found: list = [self.cache.get(w) or self.older.get(w) for w in texts]
        plain, whole = [], []
        for i, ids in enumerate(found):
            if ids is not None:
                found[i] = array(self.code, ids)
            else:
                (plain if _PLAIN.fullmatch(texts[i]) else whole).append(i)
        if plain:
            mapped = " ".join([texts[i] for i in plain]).lower().encode().decode("latin-1").translate(_BYTES)
            for i, w in zip(plain, mapped.split(" ")):
                found[i] = [t.id for t in self.model.tokenize(w)]
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                found[i] = e.ids
        return found

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, one after another, and the row offsets in them.

        ``end_id`` is appended to each row.  Null rows count as empty.
        """
        raw, off = text_bytes(column)
        special = np.zeros(len(off) - 1, dtype=bool)
        if len(raw) > 1:
            at = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
            special[np.searchsorted(off, at, side="right") - 1] = True
        buf = LOWER[raw]
        kind = _CLASS[buf]
        if special.any():
            for r in np.flatnonzero(special):
                kind[off[r] : off[r + 1]] = _WS
        inside = kind != _WS
        first = inside.copy()
        first[1:] &= _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
        heads = off[:-1][off[:-1] < len(raw)]
        first[heads] = inside[heads]
        where = np.flatnonzero(first)
        rows = np.searchsorted(where, off)
        starts = np.flatnonzero(first[inside]).astype(np.int32)
        body = buf[inside]
        offsets = np.append(starts, np.int32(len(body)))
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, ulen = self._pieces(coded.dictionary)
        ustart = np.cumsum(ulen) - ulen
        lens = ulen[codes]
        ends = np.cumsum(lens)
        bounds = np.append(0, ends)[rows]
        # positions of the ids of each piece in the flat table of distinct pieces
        index = np.repeat((ustart[codes] - (ends - lens)).astype(np.int32), lens) + np.arange(int(lens.sum()), dtype=np.int32)
        ids = flat[index]
        if special.any():
            texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            parts = [ids[bounds[r] : bounds[r + 1]] for r in range(len(special))]
            for r in np.flatnonzero(special):
                parts[r] = np.array(self.tokenizer.encode(texts[int(r)].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
            bounds = np.append(0, np.cumsum([len(p) for p in parts]))
            ids = np.concatenate(parts) if parts else ids
        if end_id is not None:
            out = np.empty(len(ids) + len(off) - 1, dtype=self.dtype)
            n = np.arange(len(off))
            at_end = bounds[1:] + n[:-1]
            keep = np.ones(len(out), dtype=bool)
            keep[at_end] = False
            out[keep] = ids
            out[at_end] = end_id
            ids, bounds = out, bounds + n
        return ids, bounds


_ENCODERS: dict[str, ColumnEncoder] = {}


def encoder(path: str) -> ColumnEncoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ColumnEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
