"""Token ids of many texts at once, by a byte-level BPE tokenizer."""

from __future__ import annotations

import functools
import itertools
import json
import operator
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from vidlake.llm.words import spread

#: Bytes of stretches of text, and of their ids, that a worker process remembers.
REMEMBERED = 8 << 20

_ALL = np.arange(256)
_SPACE = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
_LETTER = ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
_ASCII = _ALL < 0x80
#: ASCII that is surely not white space: control characters x1C to x1F may count as such.
_SOLID = (_ALL > 0x20) & (_ALL < 0x7F)
#: How the tokenizer's vocabulary writes a byte: printable ones as the character of that number,
#: the others, in order, as characters from 256 up.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_AS_WRITTEN = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(c) for b, c in zip(sorted({*range(256)} - _PRINTABLE), range(256, 512), strict=False)}
#: ASCII that ends a run of letters and can't begin or be part of another one.
_MARK = _SOLID & ~_LETTER


class Encoder:
    """Encodes each distinct stretch of a batch once.

    A byte-level BPE first splits a text by a fixed pattern: words with the blank before them,
    digits, marks, white space. Where such a split is certain whatever stands around it, the
    texts are cut here already: before white space that follows something solid, between a
    letter and a mark, and after a single line break or tab. Stretches between cuts then encode
    as they would inside the text. Other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.splits = self._is_plain(added)
        self.added = [t.content.encode() for t in added]
        self._forget()

    def _is_plain(self, added: Iterable) -> bool:
        t = self.tokenizer
        if t.normalizer is not None or not isinstance(t.model, BPE) or not isinstance(
                t.pre_tokenizer, ByteLevel):
            return False
        pre = json.loads(t.pre_tokenizer.__getstate__())
        return (not pre["add_prefix_space"] and pre.get("use_regex", True)
                and not any(t.lstrip or t.rstrip or t.single_word or " " in t.content
                            for t in added))

    def _forget(self) -> None:
        self._seen = pa.array([], pa.binary())
        self._first, self._length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _cuts(self, data: np.ndarray, offset: np.ndarray, raw: bytes) -> np.ndarray:
        """Places where a stretch begins, each text's start included."""
        n = len(data)
        here, before = data[1:], data[:-1]
        second = np.concatenate((np.zeros(1, np.uint8), data[:-2]))  # two before `here`
        # Latin letters with accents: C3 and a second byte other than those of x and / signs.
        accented = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut = np.zeros(n + 1, bool)
        solid, letter = _SOLID[before] | accented, _LETTER[before] | accented
        cut[1:n] = (_SPACE[here] & solid) | (_MARK[here] & letter)
        lone = _SPACE[before] & (before != 0x20) & _SOLID[second] & _SOLID[here]
        cut[1:n] |= lone
        for token in self.added:  # these are found before anything is split
            at = raw.find(token)
            while at >= 0:
                cut[at + 1:at + len(token)] = False
                at = raw.find(token, at + 1)
        cut[offset[:-1]] = True
        return np.flatnonzero(cut[:n])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more number than texts)."""
        texts = texts.cast(pa.binary()).fill_null(b"")
        offset = np.frombuffer(texts.buffers()[1], np.int32)[
            texts.offset:texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = buffer.slice(offset[0], offset[-1] - offset[0]) if buffer else pa.py_buffer(b"")
        offset = (offset - offset[0]).astype(np.int64)
        size = int(offset[-1])
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        view = np.frombuffer(data, np.uint8)
        starts = np.unique(offset[:-1][np.diff(offset) > 0])
        if self.splits and size > 1:
            starts = self._cuts(view, np.append(starts, size), data.to_pybytes())
        stretches = pa.Array.from_buffers(
            pa.binary(), len(starts),
            [None, pa.py_buffer(np.append(starts, size).astype(np.int32)), data]).dictionary_encode()
        known = self._known(stretches.dictionary)
        codes = known[stretches.indices.to_numpy()]
        lengths = self._length[codes]
        ids = self._ids[spread(self._first[codes], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids, ends[np.searchsorted(starts, offset)]

    def _known(self, stretches: pa.Array) -> np.ndarray:
        """The number under which the ids of each stretch are remembered."""
        found = pc.index_in(stretches, value_set=self._seen)
        fresh = stretches.filter(found.is_null())
        if self._seen.nbytes + self._ids.nbytes + fresh.nbytes > REMEMBERED:
            self._forget()
            found, fresh = pa.nulls(len(stretches), pa.int32()), stretches
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(fresh):
            ids = self._new(fresh.to_pylist())
            out[out < 0] = len(self._seen) + np.arange(len(fresh))
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            first = len(self._ids) + np.cumsum(length) - length
            self._seen = pa.concat_arrays([self._seen, fresh])
            self._first = np.append(self._first, first)
            self._length = np.append(self._length, length)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum()))
            self._ids = np.append(self._ids, flat)
        return out

    def _new(self, stretches: list[bytes]) -> list[list[int]]:
        """Ids of stretches. One that is a single word, with or without a blank before it, is
        not split any further and goes to the tokenizer's model as it is."""
        ids: list = [None] * len(stretches)
        rest = []
        tokenize, number = self.tokenizer.model.tokenize, operator.attrgetter("id")
        for k, s in enumerate(stretches):
            text = s.decode()
            if self.splits and (text[1:] if text[0] == " " else text).isalpha():
                if text.isascii():
                    text = text.replace(" ", _AS_WRITTEN[0x20])
                else:
                    text = "".join(map(_AS_WRITTEN.__getitem__, s))
                ids[k] = list(map(number, tokenize(text)))
            else:
                rest.append(k)
        encoded = self.tokenizer.encode_batch([stretches[k].decode() for k in rest],
                                              add_special_tokens=False)
        for k, e in zip(rest, encoded, strict=True):
            ids[k] = e.ids
        return ids


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of this process: worker processes are used by one task after the other."""
    return Encoder(path)
