"""Benchmark passages in documents, found by an FM-index over each shard of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.llm.columns import schema_with, without
from vidlake.llm.sent import send
from vidlake.llm.words import ALNUM, chunks, covered, words_of

WINDOW = 10
#: Every so many-th place of a shard keeps its position.
SAMPLE = 8
#: Bytes of benchmark texts that are searched for together; more go in further passes.
PATTERN_BYTES = 8 << 20
#: Bytes of document text in one index.
SHARD = 2 << 20


class FMIndex:
    """An FM-index over numbers from 1 up; 0 ends the text.

    The last column of the sorted rotations is held as a wavelet matrix: one bit vector with
    running counts for each bit of a symbol. Searches take many patterns at once, and each step
    is a handful of array operations.
    """

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(text, 0)
        n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        self.top = int(text.max())
        self.size, self.levels = n, max(1, self.top.bit_length())
        counts = np.bincount(text, minlength=(1 << self.levels) + 1)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.zeros, self.ones = [], []
        symbols = last.astype(np.int32)
        for level in reversed(range(self.levels)):
            bit = (symbols & (1 << level)) != 0
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, dtype=np.int32, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.last = last
        kept = order % sample == 0
        self.kept_before = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=self.kept_before[1:])
        self.positions = order[kept]

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the last column."""
        low, high = np.zeros(len(places), np.int64), places.astype(np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            ones, bit = self.ones[k], ((symbols >> level) & 1).astype(bool)
            at_low, at_high = ones[low], ones[high]
            low = np.where(bit, self.zeros[k] + at_low, low - at_low)
            high = np.where(bit, self.zeros[k] + at_high, high - at_high)
        return high - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each pattern: from, to. `patterns` has a row for
        each, filled up on the right; a symbol of 0 is in no text."""
        n = len(patterns)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        alive = np.arange(n)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = alive[lengths[alive] >= back]
            if not len(on):
                break
            symbols = patterns[on, lengths[on] - back]
            symbols = np.where(symbols <= self.top, symbols, 0)
            both = self.rank(np.concatenate((symbols, symbols)),
                             np.concatenate((low[on], high[on])))
            base = self.below[symbols]
            low[on], high[on] = base + both[:len(on)], base + both[len(on):]
            high[on[symbols == 0]] = low[on[symbols == 0]]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a row whose position was kept."""
        found = np.full(len(rows), -1, np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            kept = self.kept_before[at + 1] > self.kept_before[at]
            found[todo[kept]] = self.positions[self.kept_before[at[kept]]] + steps
            todo, at = todo[~kept], at[~kept]
            symbols = self.last[at]
            at = self.below[symbols] + self.rank(symbols, at)
            steps += 1
        return found


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling over the groups still tied."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate((text, np.zeros(width, text.dtype)))
    for k in range(width):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    # The rank of a suffix is the first place of its group.
    heads = np.flatnonzero(new)
    ranks = np.empty(n, np.int64)
    ranks[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of two or more
    while len(tied):
        at = order[tied]
        after = at + width
        second = np.where(after < n, ranks[np.minimum(after, n - 1)], -1)
        group = ranks[at]
        inner = np.lexsort((second, group))
        at, second, group = at[inner], second[inner], group[inner]
        order[tied] = at
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        ranks[at] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order


class Patterns:
    """The windows of some benchmark items, each once, with the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        found: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            w = words_of(pa.array([text], pa.string()), ALNUM, lower=True)
            words = [w.data[s:e] for s, e in zip(w.start, w.end, strict=True)]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[k:k + window]), set()).add(number[item])
        self.holders = [sorted(h) for h in found.values()]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for p in found for w in p))}
        self.codes = np.full((len(found), window), -1, np.int64)
        for row, p in enumerate(found):
            self.codes[row, :len(p)] = [self.words[w] for w in p]
        self.holder_count = np.array([len(h) for h in self.holders], np.int64)
        self.holder_first = np.cumsum(self.holder_count) - self.holder_count
        self.holder = np.array([i for h in self.holders for i in h], np.int64)

    def in_codes(self, words: pa.Array) -> np.ndarray:
        """The windows in numbers of another vocabulary plus 1; 0 where it lacks the word."""
        own = pa.array(list(self.words), pa.binary())
        there = pc.fill_null(pc.index_in(own, value_set=words), -1).to_numpy()
        return np.append(there.astype(np.int64) + 1, 0)[self.codes]


def find(texts: pa.Array, patterns: Patterns) -> tuple:
    """Index these texts, then (words, hit, doc, item): which words lie inside an occurrence of
    a window, and pairs of text number and item number."""
    words = words_of(texts, ALNUM, lower=True)
    codes, names = words.coded()
    n, docs = len(codes), len(texts)
    hit, none = np.zeros(n, bool), np.zeros(0, np.int64)
    if not n or not len(patterns.lengths):
        return words, hit, none, none
    # A separator of its own number follows each text, so that no window runs over its end.
    lengths = np.diff(words.first)
    doc_of = np.repeat(np.arange(docs), lengths)
    place = np.arange(n) + doc_of
    text = np.full(n + docs, len(names) + 1, np.int64)
    text[place] = codes + 1
    index = FMIndex(text)
    wanted = patterns.in_codes(names)
    possible = np.flatnonzero(((wanted > 0) | (patterns.codes < 0)).all(axis=1))
    low, high = index.search(wanted[possible], patterns.lengths[possible])
    found = low < high
    pattern, low, high = possible[found], low[found], high[found]
    count = high - low
    if not len(pattern):
        return words, hit, none, none
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    pattern = np.repeat(pattern, count)
    at = index.locate(rows)
    doc = np.searchsorted(words.first + np.arange(docs + 1), at, "right") - 1
    start = at - doc
    hit = covered(start, start + patterns.lengths[pattern], n)
    held = patterns.holder_count[pattern]
    items = patterns.holder[np.repeat(patterns.holder_first[pattern] - (np.cumsum(held) - held),
                                      held) + np.arange(int(held.sum()))]
    pairs = np.unique(np.repeat(doc, held) * len(patterns.ids) + items)
    return words, hit, pairs // len(patterns.ids), pairs % len(patterns.ids)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with `n_words`, `n_hit`, `items` (sorted item ids as strings) and `spans`, the byte
    ranges of the text, as (from, to), that runs of hit words take.

    A document word is hit if it lies inside an occurrence of `window` consecutive words of a
    benchmark item, or of all words of a shorter one. Words are runs of digits, letters and
    characters beyond ASCII, with A-Z in lower case.

    Every task builds an FM-index over the words of a few MB of whole documents at a time,
    searches all windows backwards through the ranks of a wavelet matrix, and locates their
    occurrences by sampled positions. No document is shuffled. The benchmark is sent to the
    tasks in blocks of at most `PATTERN_BYTES` of text (one longer item is a block of its own);
    each further block is one more pass over the documents, so memory does not grow with it.

    Null texts have no words. Items without words, or null, occur nowhere; items with equal id
    count as one; a null item id is written as `null`. Repeated rows are judged alike. No rows
    give no rows. Other columns pass through; those called like a result are replaced.
    """
    return _found(docs, benchmark, window, cut=False)


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`cleaned(spans(docs, benchmark, window))`, with the last pass cutting as it searches, so
    that texts go to one Python worker once and not to a second one at the same time."""
    return _found(docs, benchmark, window, cut=True)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, cut: bool) -> DataFrame:
    rows, again = without(docs, "n_words", "n_hit", "items", "spans"), False
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        rows = _passed(rows, block, window, again, cut and following is None)
        block, again = following, True
    return rows


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded size; at least one block."""
    block, size = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"),
                             F.col("text").cast("string").alias("t"))
    for r in items.toLocalIterator():
        more = len((r["t"] or "").encode())
        if block and size + more > PATTERN_BYTES:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += more
    yield block


def _passed(rows: DataFrame, block: list, window: int, again: bool, cut: bool) -> DataFrame:
    """One block of items against all rows; `again`: add to what earlier blocks found; `cut`:
    return the rows with what was found cut out of their texts."""
    spark = rows.sparkSession
    sent = send(spark, Patterns(block, window))
    kept = [c for c in rows.columns if c not in ("n_words", "n_hit", "items", "spans")] \
        if again else rows.columns
    schema = rows.select(*kept).schema if cut else schema_with(
        rows.select(*kept), n_words="long", n_hit="long", items="array<string>",
        spans="array<struct<start:int,stop:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        for batch in chunks(batches, "text", SHARD):
            words, hit, doc, item = find(batch.column(batch.schema.get_field_index("text")),
                                         patterns)
            found = _rows(batch, kept, words, hit, doc, item, patterns, again)
            yield _cut(found, kept) if cut else found

    return rows.mapInArrow(run, schema)


def _rows(batch, kept, words, hit, doc, item, patterns, again) -> pa.RecordBatch:
    docs, first = len(words.first) - 1, words.first
    ids = [[] for _ in range(docs)]
    for d, i in zip(doc.tolist(), item.tolist(), strict=True):
        ids[d].append(patterns.ids[i])
    if again:
        # Words of spans found before are hit as well.
        for d, some in enumerate(batch.column("spans").to_pylist()):
            for s in some:
                a, b = np.searchsorted(words.start, (words.offset[d] + s["start"],
                                                     words.offset[d] + s["stop"]))
                hit[a:b] = True
        ids = [sorted({*new, *old}) for new, old in
               zip(ids, batch.column("items").to_pylist(), strict=True)]
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    n_hit = np.bincount(doc_of[hit], minlength=docs)
    begins, stops = hit.copy(), hit.copy()
    same = doc_of[1:] == doc_of[:-1]
    begins[1:] &= ~(hit[:-1] & same)
    stops[:-1] &= ~(hit[1:] & same)
    a, b = np.flatnonzero(begins), np.flatnonzero(stops)
    base = words.offset[doc_of[a]]
    runs = pa.StructArray.from_arrays(
        [pa.array(words.start[a] - base, pa.int32()), pa.array(words.end[b] - base, pa.int32())],
        names=["start", "stop"])
    cuts = np.searchsorted(a, first)
    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
    columns |= {"n_words": pa.array(np.diff(first), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array([sorted(i) for i in ids], pa.list_(pa.string())),
                "spans": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs)}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cleaned(found: DataFrame) -> DataFrame:
    """The rows of `spans` with the spans cut out of their `text`, each replaced by one space."""
    schema = found.drop("n_words", "n_hit", "items", "spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD):
            yield _cut(batch, schema.names)

    return found.mapInArrow(run, schema)


def _cut(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    for k, some in enumerate(batch.column("spans").to_pylist()):
        if some:
            data, out, done = texts[k].encode(), [], 0
            for s in some:
                out.append(data[done:s["start"]])
                done = s["stop"]
            texts[k] = b" ".join([*out, data[done:]]).decode().strip()
    kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
    kept[names.index("text")] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays(kept, names=names)
