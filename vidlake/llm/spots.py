"""Spot signatures: chains of content words that follow common words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.columns import known_id, schema_with, without
from vidlake.llm.jaccard import BLOCK, CELLS, _may_be_alike, _summed
from vidlake.llm.sent import send
from vidlake.llm.words import ALNUM, chunks, factors, mixed, words_of
from vidlake.session import stage

#: Common words of English, German, French and Spanish. Fingerprints made with
#: another list are not comparable.
ANCHORS = (
    "the a an and or of to in is was are for with that this it on as by at be from not "
    "der die das und ist ein eine von zu den mit im des auf für nicht dem sich "
    "le la les de du un une et est que dans pour qui sur pas au avec "
    "el los las y en del una por con se para su como lo al más").split()
#: Content words in a chain.
CHAIN = 3
#: A stretch of more words without a common one has anchors of its own.
STRETCH = 8
#: Similar documents share at least so many percent of their signatures.
PERCENT = 80
#: Characters of a fingerprint for each signature.
_HEX = 8


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """For each text its sorted distinct signatures, as 32-bit numbers.

    At every common word, and at the start of the text, stands an anchor; its signature is the
    anchor and the next `chain` content words (words that are not common), or as many as there
    are. Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case.

    Where a text has too few common words (other languages, code, tables, lists of numbers),
    its content places anchors: in a stretch of more than `STRETCH` words without a common one,
    or of more than `chain` words in a text that has none at all, the word of the least hash
    among each `chain` + 1 words in a row is an anchor, too. So every word of such a stretch,
    but for the few before its first anchor, enters a signature, and a change of words moves
    only the anchors beside it. Fingerprints made by another rule are not comparable.
    """
    words = words_of(texts, ALNUM, lower=True)
    hashes, first = words.hashed(), words.first
    common = _ANCHOR_HASHES[np.searchsorted(_ANCHOR_HASHES, hashes)
                            % len(_ANCHOR_HASHES)] == hashes
    content = hashes[~common]
    before = np.concatenate(([0], np.cumsum(~common)))  # content words before each word
    doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
    some = np.flatnonzero(np.diff(first))  # texts with words have an anchor at their start
    spots = np.sort(np.concatenate((
        np.flatnonzero(common), _own_anchors(hashes, common, doc_of, first, chain))))
    doc = np.concatenate((some, doc_of[spots]))
    at = np.concatenate((before[first[some]], before[spots] + ~common[spots]))
    total = np.concatenate((np.zeros(len(some), np.uint64), hashes[spots]))
    ends = before[first[1:]][doc]
    padded = np.append(content, np.zeros(chain, np.uint64))
    for k, f in enumerate(factors(chain, 9)):
        total = total + np.where(at + k < ends, padded[at + k], np.uint64(1)) * f
    values = mixed(total) >> np.uint64(32)
    keys = np.unique((doc.astype(np.uint64) << np.uint64(32)) | values)
    cuts = np.searchsorted(keys >> np.uint64(32), np.arange(len(texts) + 1))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _own_anchors(hashes: np.ndarray, common: np.ndarray, doc_of: np.ndarray, first: np.ndarray,
                 chain: int) -> np.ndarray:
    """Places of the anchors inside long stretches without common words."""
    begins = common.copy()
    begins[first[:-1][np.diff(first) > 0]] = True
    stretch = np.cumsum(begins)
    length = np.bincount(stretch[~common], minlength=len(hashes) + 1)
    has = np.bincount(doc_of[common], minlength=len(first) - 1) > 0
    longest = np.where(has, max(STRETCH, chain), chain)
    places = np.flatnonzero(~common & (length[stretch] > longest[doc_of]))
    if not len(places):
        return places
    near = np.lib.stride_tricks.sliding_window_view(mixed(hashes[places]), chain + 1)
    whole = stretch[places[:len(near)]] == stretch[places[chain:]]
    return places[np.unique((np.arange(len(near)) + near.argmin(axis=1))[whole])]


def _anchor_hashes() -> np.ndarray:
    words = words_of(pa.array([" ".join(sorted(set(ANCHORS)))]), ALNUM, lower=True)
    return np.sort(words.hashed())


_ANCHOR_HASHES = _anchor_hashes()


def written(signature: np.ndarray) -> str:
    """A fingerprint: the sorted signatures, 8 hexadecimal digits each. Equal texts have equal
    ones, and fingerprints can be compared without the texts."""
    return signature.tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray, at_least: float = 0.0) -> float:
    """The share of signatures in both among those in either; two empty sets are alike. If the
    sizes alone keep it under `at_least`, it counts as 0 and the sets are not compared."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if min(len(x), len(y)) < at_least * max(len(x), len(y)) - 1e-9:
        return 0.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """`docs` with `fingerprint` (see `written`). Null and empty texts and texts without words
    have an empty one. Nothing is shuffled; other columns pass through, and one called
    `fingerprint` is replaced."""
    rows = without(docs, "fingerprint")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = signatures(batch.column("text"), chain)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([written(s) for s in found], pa.string())],
                names=[*names, "fingerprint"])

    return rows.mapInArrow(run, schema_with(rows, fingerprint="string"))


def _read(prints: pa.Array) -> list[np.ndarray]:
    """The signatures of written fingerprints."""
    return [np.frombuffer(bytes.fromhex(f), ">u4") for f in prints.to_pylist()]


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in chunks(batches, "fingerprint"):
        cells = [s.astype(np.int64) >> 12 for s in _read(batch.column("fingerprint"))]
        total += np.bincount(np.concatenate([*cells, np.zeros(0, np.int64)]), minlength=CELLS)
    blocks = total.reshape(-1, BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([
        pa.array(used, pa.int32()),
        pa.array([blocks[k].astype("<i8").tobytes() for k in used], pa.binary())],
        names=["block", "counts"])


def length_cuts(percent: int) -> np.ndarray:
    """Where partitions of set sizes begin. A set whose size is in one of them can only be alike
    to sets in it and in the ones beside it: each begins above what fits the least size before."""
    cuts = [1]
    while cuts[-1] < 1 << 31:
        cuts.append(100 * cuts[-1] // percent + 1)
    return np.array(cuts)


def _rarest(percent: int, sent, cuts: np.ndarray):
    """Rows (partition, size, place, signature) of each set's prefix, rarest signatures first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in chunks(batches, "fingerprint"):
            sets = _read(batch.column("fingerprint"))
            prefixes = []
            for s in sets:
                v = s.astype(np.uint64)
                key = np.sort((levels[v >> np.uint64(12)] << np.uint64(32)) | v)
                keep = len(v) - -(-percent * len(v) // 100) + 1
                prefixes.append((key[:keep] & np.uint64(0xFFFFFFFF)).astype(np.int64))
            n = np.array([len(s) for s in sets], np.int64)
            part = np.searchsorted(cuts, n, "right") - 1
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array(part, pa.int32()), pa.array(n, pa.int32()),
                pa.array(prefixes, pa.list_(pa.int64()))], names=["_id", "_part", "_n", "_p"])
    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_x"):
            found = np.array([likeness(x, y, percent / 100) for x, y in zip(
                _read(batch.column("_x")), _read(batch.column("_y")), strict=True)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found)],
                names=["a", "b", "likeness"]).filter(pa.array(100 * found >= percent - 1e-9))
    return run


def alike(docs: DataFrame, percent: int = PERCENT, chain: int = CHAIN) -> DataFrame:
    """Similar documents of a whole table: `a`, `b` (ids) and `likeness` of their signatures, at
    least `percent` (1 to 100) of a hundred.

    Documents with equal fingerprints are one class, shown as pairs of its least id (`a`) with
    each other one. Least ids of different classes (`a` < `b`) are compared with each other: all
    such pairs are found, so any two similar documents are linked through their least ids.

    Sets are dealt by their size into partitions (see `length_cuts`), so that alike ones are in
    the same or in neighbouring partitions. Each set is listed there under the rarest of its
    signatures, as many as any alike set must share one of; rareness comes from one table of
    counts over all documents, as large for any input. Sets meet under a listed signature if
    their sizes and its places allow; whole sets are then compared by `likeness`.

    As all pairs are shown, a group of near copies with different fingerprints gives as many rows
    as it has pairs. Texts without signatures and rows with a null id are in no pair; of several
    texts with one id each is compared, and the greatest likeness shown. No rows give no rows.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), "text")
    prints = stage(fingerprints(rows, chain).where("fingerprint <> ''").select(
        "_id", "fingerprint").distinct(), "prints")
    classes = stage(prints.groupBy("fingerprint").agg(F.min("_id").alias("_id")), "classes")
    same = prints.join(classes.withColumnRenamed("_id", "a"), "fingerprint").where("a <> _id").select(
        "a", F.col("_id").alias("b"), F.lit(1.0).alias("likeness"))
    if percent == 100:
        return same.distinct()
    levels = np.zeros(CELLS, np.uint64)
    counted = classes.select("fingerprint").mapInArrow(_cell_counts, "block int, counts binary")
    for r in counted.repartition(CELLS // BLOCK, "block").mapInArrow(
            _summed, "block int, counts binary").toLocalIterator():
        levels[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = 4 * np.log2(
            np.frombuffer(r["counts"], "<i8") + 1)
    sent = send(spark, levels.astype(np.uint8).astype(np.uint64))
    listed = classes.select("_id", "fingerprint").mapInArrow(
        _rarest(percent, sent, length_cuts(percent)),
        "_id long, _part int, _n int, _p array<long>")
    listed = stage(listed.select("_id", "_part", "_n", F.posexplode("_p").alias("_i", "_t")),
                   "listed")
    # Each set looks for others in its own partition and in the next one.
    seeks = listed.withColumn("_in", F.explode(F.array("_part", F.col("_part") + 1)))
    x, y = seeks.alias("x"), listed.alias("y")
    met = x.join(y, (F.col("x._in") == F.col("y._part")) & (F.col("x._t") == F.col("y._t"))
                 & (F.col("x._id") != F.col("y._id"))
                 & ((F.col("x._part") < F.col("y._part")) | (F.col("x._id") < F.col("y._id")))
                 & _may_be_alike(F.col("x._n"), F.col("x._i"), F.col("y._n"), F.col("y._i"), percent))
    pairs = stage(met.select(F.least("x._id", "y._id").alias("a"),
                             F.greatest("x._id", "y._id").alias("b")).distinct(), "pairs")
    whole = pairs.join(classes.select(F.col("_id").alias("a"), F.col("fingerprint").alias("_x")), "a")
    whole = whole.join(classes.select(F.col("_id").alias("b"), F.col("fingerprint").alias("_y")), "b")
    found = same.unionByName(whole.select("a", "b", "_x", "_y").mapInArrow(
        _verified(percent), "a long, b long, likeness double"))
    return found.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def edited_pairs(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each document beside an edited copy of itself and beside the next one.

    The next document is the one with the next smaller id; after the least id comes the greatest.
    The edited text keeps all but the last third (rounded down) of the characters, and takes as
    many from the start of the next document, or all of it.

    Result: `doc_id`, `n_chars`, `edited_text`, `fingerprint`, `edited_fingerprint`,
    `near_edited`, `near_next`: how alike its signatures are to those of the edited text and of
    the next document, from 0 to 1.

    Documents are dealt by ranges of ids, one range to a task, sorted and streamed from the
    greatest id down, so each text moves once and only neighbours are held. The least id of a
    range meets a copy of the greatest one of the range below, which is one row per range.

    A null text counts as empty, a null id as the greatest. Rows with equal ids follow each other
    in order of their text; equal rows are each other's next. No rows give no rows. A single
    document is its own next. Columns other than `doc_id` and `text` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", known_id().alias("_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(
        "_id", [k / width for k in range(1, width)] or [0.5], 100 * width)).first()[0] or []
    # The range of an id: how many cuts it is above.
    rows = rows.withColumn("_range", _range(F.col("_id"), sorted(set(cuts))))
    # The last document of each range, at most one row for each: it is the next one of the first
    # document in the range above, and that of the highest range follows the very first.
    tops = rows.groupBy("_range").agg(F.max(F.struct("_id", F.xxhash64("text"))).alias("top"))
    tops = sorted((r["_range"], r["top"]) for r in tops.collect())
    goes = {below[1]: above[0] for below, above in zip(tops, tops[1:], strict=False)}
    if tops:
        goes.setdefault(tops[-1][1], tops[0][0])
    table = spark.createDataFrame([(t[0], t[1], r) for t, r in goes.items()],
                                  "_id long, _th long, _to int")
    ghosts = rows.withColumn("_th", F.xxhash64("text")).join(
        F.broadcast(table), ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    every = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts.select(
        "doc_id", "_id", "text", F.col("_to").alias("_range"), F.lit(True).alias("_ghost")))
    dealt = every.repartition(width, "_range").sortWithinPartitions(
        F.desc("_range"), F.asc("_ghost"), F.desc("_id"), "text")
    return dealt.select("doc_id", "_range", "_ghost", "text").mapInArrow(
        _beside(chain), _schema(docs))


def _range(value: Column, cuts: list[int]) -> Column:
    """Halve the cuts until one range is left: as many comparisons as the range has digits."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= cuts[middle], between(low, middle)).otherwise(
            between(middle + 1, high))
    return between(0, len(cuts))


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (f"doc_id {kind}, n_chars long, edited_text string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")


def _beside(chain: int):
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """(id, text, next text), some at a time."""
        last, some, size = None, [], 0
        for batch in chunks(batches, "text"):
            for doc, part, ghost, text in zip(*(c.to_pylist() for c in batch.columns),
                                              strict=True):
                if last is not None and last[1] == part:
                    some.append((last[0], last[2], text))
                    size += len(last[2])
                last = None if ghost else (doc, part, text)
                if size > 2 << 20:
                    yield some
                    some, size = [], 0
        yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in paired(batches):
            if not some:
                continue
            ids, texts, after = zip(*some, strict=True)
            edited = [t[:len(t) - len(t) // 3] + a[:len(t) // 3]
                      for t, a in zip(texts, after, strict=True)]
            own, changed = (signatures(pa.array(t, pa.string()), chain) for t in (texts, edited))
            # The next text of a row is mostly the text of the row after it.
            follows = [k + 1 < len(texts) and after[k] is texts[k + 1] for k in range(len(texts))]
            rest = iter(signatures(pa.array([a for a, f in zip(after, follows, strict=True)
                                             if not f], pa.string()), chain))
            beside = [own[k + 1] if f else next(rest) for k, f in enumerate(follows)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), pa.array([len(t) for t in texts], pa.int64()),
                pa.array(edited, pa.string()), pa.array([written(s) for s in own], pa.string()),
                pa.array([written(s) for s in changed], pa.string()),
                pa.array([likeness(x, y) for x, y in zip(own, changed, strict=True)]),
                pa.array([likeness(x, y) for x, y in zip(own, beside, strict=True)]),
            ], names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next"])
    return run
