"""Cached coding of texts by units that a byte-level BPE pattern can never straddle.

No match of the pre-token pattern
``'s|'t|... | ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` goes on from a character that is not
white space to one that is, or from a letter or digit to a mark, and no match looks back or,
beyond a run of white space, ahead. So a text can be cut before every run of white space and
between a letter and a mark, and the codes of its units joined. Cuts are made before ASCII white
space and, after an ASCII letter or digit, ASCII marks only, and not where another kind of white
space stands in front; leaving a cut out is always safe.

Units are found, told apart and put together again by Arrow and numpy over whole batches;
Python touches only the distinct units of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~_LETTER[33:127]

#: Entries of a cache's younger half. When it is full it becomes the older half, from which entries
#: that are met again come back; bounds a worker's memory, never the result.
CACHE_LIMIT = 100_000


def _other_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII ends before each place."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return two | general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def unit_starts(data: np.ndarray, text_starts: np.ndarray, whole: bytes = b"") -> np.ndarray:
    """Where units start in the joined UTF-8 bytes of texts that start at text_starts. No mark of
    ``whole`` starts a unit: special tokens may hold it."""
    white = _WHITE[data]
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    high = data[at - 1] >= 0x80
    if high.any():
        odd = np.flatnonzero(high)
        at = np.delete(at, odd[_other_space_before(data, at[odd])])
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    mark = _MARK.copy()
    mark[list(whole)] = False
    begins[1:-1] |= mark[data[1:]] & _LETTER[data[:-1]]
    begins[text_starts] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


class Units:
    """The units of an Arrow array of texts without nulls: distinct ones, and where each stands."""

    def __init__(self, texts: pa.StringArray | pa.BinaryArray, whole: bytes = b""):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first:last]
        starts = unit_starts(data, offsets - first, whole)
        ends = np.append(starts, len(data)).astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        self.indices, self.distinct = coded.indices, coded.dictionary
        #: number of units before each text, and in all
        self.text_at = np.searchsorted(starts, offsets - first)

    def joined(self, codes: list[bytes]) -> tuple[pa.Buffer | None, np.ndarray]:
        """codes: one for each distinct unit. The codes of all texts in a row, and where each text's begin and end."""
        out = pa.array(codes, pa.binary()).take(self.indices)
        return out.buffers()[2], np.frombuffer(out.buffers()[1], np.int32)[: len(out) + 1][self.text_at]


class UnitCache:
    """Codes units; those met before come from memory.

    encode_new: list of units -> list of codes. whole: see ``unit_starts``.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list[bytes]], whole: bytes = b"", limit: int = CACHE_LIMIT):
        self.encode_new, self.whole, self.limit = encode_new, whole, limit
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def codes(self, distinct: list[bytes]) -> list[bytes]:
        """The code of each of some distinct units."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [u for u in distinct if u not in known]
        known.update([(u, older[u]) for u in missing if u in older])
        new = [u for u in missing if u not in known]
        if new:
            known.update(zip(new, self.encode_new(new), strict=True))
        return [known[u] for u in distinct]

    def encode(self, texts: pa.StringArray) -> tuple[pa.Buffer | None, np.ndarray]:
        """The codes of all texts in a row, and where each text's begin and end."""
        units = Units(texts, self.whole)
        return units.joined(self.codes(units.distinct.to_pylist()))
