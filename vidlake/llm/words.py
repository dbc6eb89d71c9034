"""Words of many texts at once, as arrays over one byte buffer.

Word rules here are classes of ASCII bytes, and every byte of a character beyond ASCII has its
high bit set, so words of UTF-8 text can be found byte by byte without decoding it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on together.
CHUNK = 4 << 20

_ALL = np.arange(256)
#: Digits, letters in lower case and everything beyond ASCII (use with `lower`).
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: Everything but blanks.
SOLID = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
LOWERED = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8).tobytes()


@dataclass
class Words:
    """Words of some texts: word `w` is `data[start[w]:end[w]]`; text `t` has the words from
    `first[t]` up to `first[t + 1]` and the bytes from `offset[t]` up to `offset[t + 1]`."""

    data: bytes
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the words by number."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), pa.array([], pa.binary())
        # Words and the gaps between them, as slices of the one buffer.
        cuts = np.empty(2 * n, np.int32)
        cuts[::2], cuts[1::2] = self.start, self.end
        slices = pa.Array.from_buffers(pa.binary(), 2 * n - 1,
                                       [None, pa.py_buffer(cuts), pa.py_buffer(self.data)])
        words = slices.dictionary_encode()
        return words.indices.to_numpy()[::2].astype(np.int64), words.dictionary

    def hashed(self) -> np.ndarray:
        """64 bits of hash for each word, the same in every task."""
        codes, words = self.coded()
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64,
                            len(words))
        return table[codes]


def words_of(texts: pa.Array, inside: np.ndarray, lower: bool) -> Words:
    """`texts`: strings or binary; a null has no words. `inside`: for each byte, if it is part
    of a word (after A-Z are lowered, if `lower`)."""
    texts = texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = buffer.slice(offset[0], offset[-1] - offset[0]).to_pybytes() if buffer else b""
    offset = (offset - offset[0]).astype(np.int64)
    if lower:
        data = data.translate(LOWERED)
    mask = inside[np.frombuffer(data, np.uint8)]
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    edges = offset[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word ends with its text
    starts[edges], ends[edges - 1] = mask[edges], mask[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offset, start, end, np.searchsorted(start, offset))


def chunks(batches: Iterator[pa.RecordBatch], text: str,
           size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text; a longer text stands alone.

    What a worker has freed goes back to the system before and after: workers wait for other
    tasks, and are used again by them, and what they hold back is missing there."""
    _release()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)
                          [column.offset:column.offset + len(column) + 1].astype(np.int64)) \
            if len(column) else np.zeros(0, np.int64)
        at, ends = 0, np.cumsum(lengths)
        while at < len(column):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    del batches
    _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every system
        ctypes.CDLL(None).malloc_trim(0)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the hashes over all 64 (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def factors(n: int, seed: int) -> np.ndarray:
    """`n` odd multipliers, one for each place in a sequence."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 + np.uint64(seed)) | np.uint64(1)


def sequence_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of the `n` words from each place on; the last `n - 1` places have none."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for k, f in enumerate(factors(n, seed)):
        total += words[k:k + count] * f
    return mixed(total)


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(first - (np.cumsum(length) - length), length)
    return base + np.arange(total)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of the numbers below `n`, those inside any range."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
