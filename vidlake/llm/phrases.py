"""Collocations by set-oriented mining: relations of occurrences, grown a word at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.llm.words import chunks, mixed, words_of
from vidlake.session import stage

#: Phrases have up to so many words and occur at least so often.
LONGEST, LEAST = 4, 30
#: A phrase goes where a longer one around it has at least so many percent of its occurrences.
INSIDE = 80
#: Phrases reported for each language.
TOP = 2000
SCALE = 2_000_000
#: Bytes of text in a block, and bytes of all texts for each range of phrases.
BLOCK, RANGE = 4 << 20, 32 << 20
#: Numbers of words and phrases are below this; a phrase is a number and a word in one long.
NUMBERS = 2**32 - 1

_ALL = np.arange(256)
_ENDS = np.isin(_ALL, [*b".,;:!?", *range(0x0A, 0x0E)])
_INSIDE = ~(_ENDS | (_ALL == 0x20) | (_ALL == 0x09))

_PAIRS = "block long, `range` int, first long, keys {}, counts binary"
_COUNTED = "`range` int, block long, at binary, number binary, keys {}, totals binary"
_REPLY = "array<struct<base:long,at:binary,number:binary>>"


def _pack(values: np.ndarray) -> bytes:
    """Numbers with equal bytes of their differences together, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    raw = steps.view(np.uint8).reshape(len(steps), values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data) if data else b""
    kind = np.dtype(kind)
    cells = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T
    return np.cumsum(np.ascontiguousarray(cells).view(kind).ravel(), dtype=kind)


def _held(values: np.ndarray) -> bytes:
    """Numbers of words along a text: byte by byte, compressed."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unheld(data: bytes) -> np.ndarray:
    cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(cells.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _dealt(target: np.ndarray):
    """Distinct phrases by the range they are counted in: their order, and for each range its
    number, where it begins, and the slice of the order."""
    order = np.argsort(target, kind="stable")
    at = np.flatnonzero(np.diff(target[order], prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        yield int(target[order[a]]), a, order[a:b]


def _first(ranges: int):
    """Occurrences of words and, for each range of words, how often a block has them. A word is
    known with its language; a block numbers its words by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in chunks(batches, "text", BLOCK):
            words = words_of(batch.column("text"), _INSIDE, lower=True)
            if not len(words.start):
                continue
            codes, names = words.coded()
            tongue = batch.column("lang").fill_null("und").dictionary_encode()
            doc = np.repeat(np.arange(len(batch)), np.diff(words.first))
            lang = tongue.indices.to_numpy()[doc].astype(np.int64)
            pairs, own, counts = np.unique(codes * len(tongue.dictionary) + lang,
                                           return_inverse=True, return_counts=True)
            names, tongues = names.to_pylist(), [t.encode() for t in tongue.dictionary.to_pylist()]
            which, of = np.divmod(pairs, len(tongues))
            keys = [tongues[t] + b"\t" + names[w] for w, t in zip(which, of, strict=True)]
            target = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64,
                                 len(keys)) % np.uint64(ranges)
            target = target.astype(np.int64)
            block, n = base + n, n + 1
            rows = {k: [] for k in ("range", "first", "keys", "counts")}
            number = np.empty(len(keys), np.int64)
            for r, a, some in _dealt(target):
                number[some] = a + np.arange(len(some))
                for name, v in zip(rows, (r, a, [keys[k] for k in some],
                                          counts[some].astype("<i8").tobytes()), strict=True):
                    rows[name].append(v)
            # A gap between words that ends a piece takes a place of its own.
            ends = np.cumsum(_ENDS[np.frombuffer(words.data, np.uint8)], dtype=np.int64)
            ends = np.append(0, ends)
            breaks = (ends[words.start[1:]] > ends[words.end[:-1]]) | (doc[1:] != doc[:-1])
            along = np.full(len(own) + int(breaks.sum()), NUMBERS, np.int64)
            along[np.arange(len(own)) + np.append(0, np.cumsum(breaks))] = number[own]
            total = np.bincount(lang, minlength=len(tongues))
            m = len(rows["range"])
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (m + 1), pa.int64()), pa.array([None, *rows["range"]], pa.int32()),
                pa.array([None, *rows["first"]], pa.int64()),
                pa.array([None, *rows["keys"]], pa.list_(pa.binary())),
                pa.array([None, *rows["counts"]], pa.binary()),
                pa.array([_held(along), *[None] * m], pa.binary()),
                pa.array([tongue.dictionary.to_pylist(), *[None] * m], pa.list_(pa.string())),
                pa.array([total.tolist(), *[None] * m], pa.list_(pa.int64()))],
                names=["block", "range", "first", "keys", "counts", "words", "langs", "n"])
    return run


def _counted(least: int, text: bool):
    """Of one range: phrases that are frequent over all blocks, numbered from 0, and for each
    block which of its own phrases those are."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = []
        if text:
            column = table.column("keys").combine_chunks()
            sizes = column.value_lengths().to_numpy()
            coded = column.flatten().dictionary_encode()
            own, names = coded.indices.to_numpy(), coded.dictionary
            counts = [np.frombuffer(c, "<i8") for c in table.column("counts").to_pylist()]
        else:
            keys = [_unpack(k, "<u8") for k in table.column("keys").to_pylist()]
            counts = [_unpack(c, "<i4") for c in table.column("counts").to_pylist()]
            sizes = np.array([len(k) for k in keys])
            names, own = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, own, np.concatenate(counts))
        often = np.flatnonzero(totals >= least)
        number = np.full(len(names), -1, np.int64)
        number[often] = np.arange(len(often))
        blocks, at, numbers = [], [], []
        begin = 0
        for block, first, size in zip(table.column("block").to_pylist(),
                                      table.column("first").to_pylist(), sizes, strict=True):
            found = number[own[begin:begin + size]]
            begin += size
            place = np.flatnonzero(found >= 0)
            if len(place):
                blocks.append(block)
                at.append(_pack((first + place).astype("<i8")))
                numbers.append(_pack(found[place].astype("<i8")))
        m = len(blocks)
        kind = pa.list_(pa.binary()) if text else pa.binary()
        kept = names.take(pa.array(often)).to_pylist() if text else _pack(names[often])
        return pa.table({
            "range": pa.array([table.column("range")[0].as_py()] * (m + 1), pa.int32()),
            "block": pa.array([None, *blocks], pa.int64()),
            "at": pa.array([None, *at], pa.binary()),
            "number": pa.array([None, *numbers], pa.binary()),
            "keys": pa.array([kept, *[None] * m], kind),
            "totals": pa.array([totals[often].astype("<i8").tobytes(), *[None] * m], pa.binary())})
    return run


def _unfolded(text: bool):
    """A row for each frequent phrase of a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, keys, totals in zip(*(batch.column(c).to_pylist() for c in (
                    "base", "keys", "totals")), strict=True):
                total = np.frombuffer(totals, "<i8")
                number = pa.array(base + np.arange(len(total)))
                if text:
                    parts = [k.rpartition(b"\t") for k in keys]
                    own = [pa.array([p[0] for p in parts], pa.binary()).cast(pa.string()),
                           pa.array([p[2] for p in parts], pa.binary()).cast(pa.string())]
                else:
                    pairs = _unpack(keys, "<u8")
                    own = [pa.array((pairs >> np.uint64(32)).astype(np.int64)),
                           pa.array((pairs & np.uint64(NUMBERS)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [number, *own, pa.array(total)],
                    names=["id", *(("lang", "word") if text else ("head", "word")), "f"])
    return run


def _candidates(before: np.ndarray, words: np.ndarray, k: int):
    """Where two frequent phrases of `k - 1` words begin at adjacent places of a piece, the first
    and the last word of the second one are a phrase of `k`: places, and the distinct ones."""
    ok = (before[:-1] != NUMBERS) & (before[1:] != NUMBERS)
    at = np.flatnonzero(ok)
    at = at[at + k - 1 < len(words)]
    keys = (before[at].astype(np.uint64) << np.uint64(32)) | words[at + k - 1].astype(np.uint64)
    return at, *np.unique(keys, return_inverse=True, return_counts=True)


def _ranged(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(ranges)).astype(np.int64)


def _told(replies: list, size: int) -> np.ndarray:
    """The number of each of a block's own phrases; `NUMBERS` for those that are not frequent."""
    out = np.full(size, NUMBERS, np.int64)
    for r in replies or ():
        out[_unpack(r["at"], "<i8")] = r["base"] + _unpack(r["number"], "<i8")
    return out


def _grown(k: int, ranges: int):
    """From a block's relation of `k - 1` words, and which phrases of them are frequent, the
    relation and the counts of `k` words. The relation holds for each place its word and the
    number of the phrase of `k - 1` words that begins there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unheld(row["words"])
                if k == 2:
                    size = int(words[words != NUMBERS].max(initial=-1)) + 1
                    words = np.append(_told(row["replies"], size), NUMBERS)[
                        np.where(words == NUMBERS, size, words)]
                    before = words
                    covered = words != NUMBERS
                    covered[1:] |= covered[:-1]  # one place of each gap stays
                else:
                    last = _unheld(row["before"]) if k > 3 else words
                    at, keys, own, _ = _candidates(last, words, k - 1)
                    order = np.argsort(_ranged(keys, ranges), kind="stable")
                    place = np.empty(len(keys), np.int64)
                    place[order] = np.arange(len(keys))
                    before = np.full(len(words), NUMBERS, np.int64)
                    before[at] = _told(row["replies"], len(keys))[place[own]]
                    starts = before != NUMBERS
                    covered = starts.copy()
                    for j in range(1, k - 1):
                        covered[j:] |= starts[:-j]
                words, before = words[covered], before[covered]
                at, keys, _, counts = _candidates(before, words, k)
                rows = [(r, a, _pack(keys[some]), _pack(counts[some].astype("<i4")))
                        for r, a, some in _dealt(_ranged(keys, ranges))]
                m = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * (m + 1), pa.int64()),
                    pa.array([None, *[r[0] for r in rows]], pa.int32()),
                    pa.array([None, *[r[1] for r in rows]], pa.int64()),
                    pa.array([None, *[r[2] for r in rows]], pa.binary()),
                    pa.array([None, *[r[3] for r in rows]], pa.binary()),
                    pa.array([_held(words), *[None] * m], pa.binary()),
                    pa.array([_held(before) if k > 2 else None, *[None] * m], pa.binary())],
                    names=["block", "range", "first", "keys", "counts", "words", "before"])
    return run


def _level(grown: DataFrame, least: int, text: bool) -> tuple[DataFrame, DataFrame, int]:
    """The frequent phrases as rows with global numbers, and what to tell each block of them."""
    kind = "array<binary>" if text else "binary"
    pairs = grown.where("`range` is not null").select("block", "range", "first", "keys", "counts")
    counted = stage(pairs.groupBy("range").applyInArrow(_counted(least, text),
                                                        _COUNTED.format(kind)), "counted")
    # One row for each range from here to the join.
    size = F.expr("length(totals) div 8")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(counted.where("block is null").select("range", size.alias("size")).select(
        "range", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "bases")
    number = bases.agg(F.sum("size")).first()[0] or 0
    if number >= NUMBERS:
        raise ValueError(f"{number} frequent phrases of one length; numbers have 32 bits")
    bases = bases.select("range", "base")
    schema = "id long, lang string, word string, f long" if text else (
        "id long, head long, word long, f long")
    found = counted.where("block is null").join(bases, "range").select(
        "base", "keys", "totals").mapInArrow(_unfolded(text), schema)
    replies = counted.where("block is not null").join(bases, "range").groupBy("block").agg(
        F.collect_list(F.struct("base", "at", "number")).alias("replies"))
    return stage(found, "frequent"), replies, number


def _cut(k: int, head: str, tail: str, a: str = "f") -> Column:
    """Score of the cut after `k` words, with what it is the score of. Decimals hold products
    beyond 64 bits."""
    wide = "cast({} as decimal(25,0))"
    return F.expr(f"""named_struct(
        'score', {wide.format(a)} * {SCALE} div ({wide.format(head)} + {wide.format(tail)}),
        'k', {k}, 'l', {head}, 'r', {tail})""")


def _cutting(rows: DataFrame) -> DataFrame:
    best = F.array_min("cuts")
    return rows.withColumns({"score": best["score"], "l": best["l"], "r": best["r"]}).drop("cuts")


def mined(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to 4 words with `least` occurrences or more: `lang`, `phrase`, `size`, `a`
    (occurrences), `l`, `r`, `score`, `within` (it goes into a longer one); and for each `lang`
    its number of words `n`.

    A-Z are lowered, texts are split at `.,;:!?` and line ends into pieces, those at blanks and
    tabs into words. Everything is counted for each language by itself. A phrase is cut after
    its first k words: the score is 2,000,000 a / (l + r), rounded down, l and r being what the
    two parts occur; the lowest cut counts, of equal ones the first.

    The relation of occurrences is kept as sorted columns of blocks of bounded size, so joining
    it with itself at adjacent places of a piece merges two columns of a block. What a block has
    of each phrase is counted there, and the distinct phrases of all blocks meet in ranges by a
    hash: those are summed, and the frequent ones are numbered and told to the blocks that have
    them, a semi-join that costs a row for each block and range. Only occurrences of frequent
    phrases are in the next relation. Words are compared as texts, phrases by exact numbers.

    A null text has no words; a null language is `und`, as a language of that name is. Empty
    and very long texts, repeated rows (each counts) and no rows at all need nothing special.
    Columns other than `text` and `lang` are not read.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"),
                       F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2 * width, -(-total // RANGE))
    grown = stage(rows.mapInArrow(_first(ranges), _PAIRS.format("array<binary>")
                                  + ", words binary, langs array<string>, n array<long>"),
                  "words")
    sizes = grown.where("langs is not null").select(
        F.explode(F.arrays_zip("langs", "n")).alias("z")).groupBy(
        F.col("z.langs").alias("lang")).agg(F.sum("z.n").alias("n"))
    found = {}
    for k in range(2, LONGEST + 1):
        found[k - 1], replies, _ = _level(grown, least, k == 2)
        relation = grown.where("words is not null").select(
            "block", "words", *(["before"] if k > 2 else []))
        grown = stage(relation.join(replies, "block").mapInArrow(
            _grown(k, ranges), _PAIRS.format("binary") + ", words binary, before binary"),
            f"phrases-{k}")
    found[LONGEST], _, _ = _level(grown, least, False)

    # From here on only frequent phrases, with the counts of their parts; parts of a frequent
    # phrase are frequent.
    word = found[1].select(F.col("id").alias("w"), "lang", "word", F.col("f").alias("fw"))
    two = found[2].join(word.select(F.col("w").alias("head"), "lang", F.col("word").alias("t1"),
                                    F.col("fw").alias("first")), "head")
    two = two.withColumnRenamed("word", "w2").join(word.select(
        F.col("w").alias("w2"), F.col("word").alias("tail"), F.col("fw").alias("last")), "w2")
    two = stage(two.select("id", "lang", F.col("head").alias("w1"), "w2",
                           F.concat_ws(" ", "t1", "tail").alias("phrase"), "tail", "first",
                           "last", "f"), "two-words")
    three = found[3].alias("n").join(two.alias("x"), F.col("n.head") == F.col("x.id")).join(
        two.alias("y"), (F.col("x.w2") == F.col("y.w1")) & (F.col("n.word") == F.col("y.w2")))
    three = stage(three.select(
        "n.id", "x.lang", "x.w1", "x.w2", F.col("y.w2").alias("w3"),
        F.concat_ws(" ", "x.phrase", "y.tail").alias("phrase"), "y.tail", "x.first", "y.last",
        F.col("x.f").alias("f12"), F.col("y.f").alias("f23"), F.col("x.id").alias("b12"),
        F.col("y.id").alias("b23"), "n.f"), "three-words")
    four = found[4].alias("n").join(three.alias("x"), F.col("n.head") == F.col("x.id")).join(
        three.alias("y"), (F.col("x.w2") == F.col("y.w1")) & (F.col("x.w3") == F.col("y.w2"))
        & (F.col("n.word") == F.col("y.w3")))
    four = stage(four.select(
        "n.id", "x.lang", F.concat_ws(" ", "x.phrase", "y.tail").alias("phrase"), "n.f",
        F.array(_cut(1, "x.`first`", "y.f", "n.f"), _cut(2, "x.f12", "y.f23", "n.f"),
                _cut(3, "x.f", "y.`last`", "n.f")).alias("cuts"),
        F.array("x.id", "y.id").alias("threes"),
        F.array("x.b12", "x.b23", "y.b23").alias("twos")), "four-words")

    def around(*lists: DataFrame) -> DataFrame:
        every = lists[0]
        for more in lists[1:]:
            every = every.union(more)
        return stage(every.groupBy("id").agg(F.max("f").alias("longer")), "around")

    by_two = around(three.select(F.explode(F.array("b12", "b23")).alias("id"), "f"),
                    four.select(F.explode("twos").alias("id"), "f"))
    by_three = around(four.select(F.explode("threes").alias("id"), "f"))
    own = ["lang", "phrase", "size", "a", "l", "r", "score", "within"]

    def finished(rows: DataFrame, size: int, longer: DataFrame | None) -> DataFrame:
        rows = rows.join(longer, "id", "left") if longer else rows.withColumn("longer", F.lit(None))
        within = F.coalesce(F.col("longer").cast("decimal(25,0)") * 100
                            >= F.col("f").cast("decimal(25,0)") * inside, F.lit(False))
        return _cutting(rows).withColumns({
            "size": F.lit(size), "a": F.col("f"), "within": within}).select(own)

    out = finished(two.withColumn("cuts", F.array(_cut(1, "`first`", "`last`"))), 2, by_two)
    out = out.union(finished(three.withColumn("cuts", F.array(
        _cut(1, "`first`", "f23"), _cut(2, "f12", "`last`"))), 3, by_three))
    return out.union(finished(four, 4, None)), sizes


def best(docs: DataFrame, top: int = TOP, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """The `top` phrases of each language that go into no longer one, best first: `lang`, `rank`,
    `phrase`, `a`, `l`, `r`, `n`, `score`. Equal scores stand by occurrences, then by bytes."""
    every, sizes = mined(docs, least, inside)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = every.where(~F.col("within"))
    # The best of each of many parts first: no task sees all phrases of a language.
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(width))
    for by in (["lang", "_part"], ["lang"]):
        kept = kept.withColumn("_part", part) if "_part" in by else kept
        kept = kept.withColumn("rank", F.row_number().over(
            Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"),
                                           "phrase", "a", "l", "r", "n", "score")
