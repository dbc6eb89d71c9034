"""Passages that occur more than once, found from winnowed anchors extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.llm.columns import known_id, schema_with, text_hash, without
from vidlake.llm.words import (
    SOLID, chunks, covered, factors, mixed, sequence_hashes, spread, words_of,
)
from vidlake.session import stage

LENGTH = 35
#: Words in an anchor.
GRAM = 6

_POS = np.uint64(0xFFFFFFFF)
_RUN = "_id long, _th long, _pos int, _lo int, _hi int, _a long, _r long"
_WINDOW = "_id long, _th long, _at int, _a long, _w long"


def runs_of(hashes: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple:
    """Winnow texts: every window of `length` words belongs to the anchor with the least hash
    among its `gram`-word sequences, the last of equal ones. Equal windows so choose equal
    anchors. Returns, for each run of consecutive windows with one anchor: its text, the anchor's
    place, the first and the last window, the anchor's hash."""
    n, span = len(hashes), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = sequence_hashes(hashes, gram)
    low = (grams & ~_POS) | (_POS - np.arange(len(grams), dtype=np.uint64))
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:width - span], low[span - width:])
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = np.flatnonzero(doc_of[:n - length + 1] == doc_of[length - 1:])
    anchor = (_POS - (low[window] & _POS)).astype(np.int64)
    if not len(window):
        return window, window, window, window, np.zeros(0, np.uint64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    heads = np.flatnonzero(new)
    lo, hi = window[heads], window[np.append(heads[1:], len(window)) - 1]
    anchor = anchor[heads]
    return doc_of[lo], anchor, lo, hi, grams[anchor]


def hashes_at(hashes: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(places), np.uint64)
    for k, f in enumerate(factors(length, 35)):
        total += hashes[places + k] * f
    return mixed(total)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), SOLID, lower=False)
            hashes = words.hashed()
            doc, anchor, lo, hi, a = runs_of(hashes, words.first, length, gram)
            c = factors(4, 4)
            before, after = anchor - lo, hi - anchor
            # A run's first and last window together hold all of its words.
            r = mixed(hashes_at(hashes, lo, length) * c[0] + hashes_at(hashes, hi, length) * c[1]
                      + before.astype(np.uint64) * c[2] + (after + length).astype(np.uint64) * c[3])
            base = words.first[doc]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(pa.array(doc)), batch.column("_th").take(pa.array(doc)),
                pa.array(anchor - base, pa.int32()), pa.array(-before, pa.int32()),
                pa.array(after, pa.int32()), pa.array(_signed(a)), pa.array(_signed(r)),
            ], names=["_id", "_th", "_pos", "_lo", "_hi", "_a", "_r"])
    return run


def _windows(length: int):
    """Every window of the runs that are extended, with its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), SOLID, lower=False)
            hashes = words.hashed()
            marks = batch.column("_marks")
            doc = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
            flat = marks.flatten()
            use = np.flatnonzero(flat.field("probe").to_numpy(zero_copy_only=False))
            pos, lo, hi, a = (flat.field(f).to_numpy()[use].astype(np.int64)
                              for f in ("pos", "lo", "hi", "a"))
            doc, count = doc[use], hi - lo + 1
            at = spread(pos + lo, count)
            doc = np.repeat(doc, count)
            w = hashes_at(hashes, words.first[doc] + at, length)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(pa.array(doc)), batch.column("_th").take(pa.array(doc)),
                pa.array(at, pa.int32()), pa.array(np.repeat(a, count)), pa.array(_signed(w)),
            ], names=["_id", "_th", "_at", "_a", "_w"])
    return run


def _kept(names: list[str], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            rows = zip(texts.to_pylist(), batch.column("_full").to_pylist(),
                       batch.column("_starts").to_pylist(), strict=True)
            for text, full, starts in rows:
                words = (text or b"").split()  # at x20 and x09 to x0D
                n_words.append(len(words))
                if full or starts:
                    begin = np.array([r["from"] for r in full or ()] + list(starts or ()), int)
                    end = np.array([r["to"] for r in full or ()] + list(starts or ()), int)
                    gone = covered(begin, end + length, len(words)).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words) if text is not None else None)
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            columns |= {"text": pa.array(kept, pa.binary()).cast(pa.string()),
                        "n_words": pa.array(n_words, pa.int64()),
                        "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with `text` cut down to the words that stay, joined by one space, and `n_words`,
    `n_removed`.

    A word goes if it lies in a window of `length` words that also starts elsewhere in the
    corpus, be it in the same document. Words are what stands between blanks.

    Seeds: each window chooses an anchor (see `runs_of`), about one for fifteen words, and only
    anchors go through the shuffle. Those that occur twice are extended over all windows that
    chose them: where another occurrence agrees in the whole of that stretch, equal hashes of the
    stretch tell so at once, however many occurrences there are. At the ends of repeats, where a
    stretch agrees in part, its windows are compared one by one, against one occurrence of each
    different stretch. No pairs are formed, so work is linear in the occurrences of a hot anchor;
    overlapping windows add up to the maximal repeats. An anchor's and a stretch's or window's
    hash make 128 bits.

    Null texts stay null and have no words. Documents are told apart by id and text; rows equal
    in both are repeats of each other, and a null id is like any other. No rows give no rows.
    Other columns pass through; those called like a result are replaced.
    """
    rows = without(docs, "n_words", "n_removed").withColumns({
        "_id": known_id(), "_th": text_hash(F.col("text"))})
    runs = stage(rows.select("_id", "_th", "text").where("text is not null")
                 .mapInArrow(_runs(length, gram), _RUN), "runs")
    seeds = runs.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"),
                                   (F.min("_r") != F.max("_r")).alias("_varied"))
    seeds = stage(seeds.where("_n > 1").drop("_n"), "seeds")
    hits = stage(runs.join(seeds, "_a"), "seed-hits")
    # One occurrence stands for each stretch when windows are compared.
    occurrence = F.xxhash64("_id", "_th", "_pos")
    stretches = stage(hits.groupBy("_a", "_r").agg(
        (F.count(F.lit(1)) > 1).alias("_whole"), F.min(occurrence).alias("_rep")), "stretches")
    marks = hits.join(stretches, ["_a", "_r"]).withColumn(
        "_probe", F.col("_varied") & (~F.col("_whole") | (occurrence == F.col("_rep"))))
    marks = marks.where("_whole or _probe").groupBy("_id", "_th").agg(F.collect_set(F.struct(
        F.col("_pos").alias("pos"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
        F.col("_a").alias("a"), F.col("_whole").alias("whole"),
        F.col("_probe").alias("probe"))).alias("_marks"))
    marked = rows.join(stage(marks, "marks"), ["_id", "_th"], "left")
    windows = stage(marked.where("exists(_marks, m -> m.probe)").select("_id", "_th", "text", "_marks")
                    .mapInArrow(_windows(length), _WINDOW), "windows")
    # Copies of a window in one stretch count by their stretch, so a window is repeated if two
    # stretches hold it, or one stretch twice.
    again = stage(windows.groupBy("_a", "_w").count().where("count > 1").drop("count"), "again")
    starts = windows.join(again, ["_a", "_w"]).groupBy("_id", "_th").agg(
        F.collect_set("_at").alias("_starts"))
    whole = F.transform(F.filter("_marks", lambda m: m["whole"]), lambda m: F.struct(
        (m["pos"] + m["lo"]).alias("from"), (m["pos"] + m["hi"]).alias("to")))
    out = marked.join(starts, ["_id", "_th"], "left").withColumn("_full", whole)
    names = [c for c in rows.columns if c not in ("_id", "_th")]
    schema = schema_with(rows.select(*names), n_words="long", n_removed="long")
    return out.select(*names, "_full", "_starts").mapInArrow(_kept(names, length), schema)
