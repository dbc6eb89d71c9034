"""Documents with nearly equal sets of word shingles, joined by prefixes under several orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.llm.components import components
from vidlake.llm.phrases import _pack, _unpack
from vidlake.llm.words import SOLID, chunks, mixed, sequence_hashes, words_of
from vidlake.session import stage

SHINGLE = 3
#: Two sets are alike if 100 * common >= PERCENT * union.
PERCENT = 90
#: Cells of a table of frequencies as large for any input, cut into blocks (for `spots`).
CELLS, BLOCK = 1 << 20, 1 << 14
#: Groups of so many members are looked through for members that fit none.
FEW = 32
#: Bits of a filter on ids or shingles; it is as large for any input.
FILTER_BITS = 1 << 23  # at most 131,072 rows of 64 bits

#: Bytes of all texts for each range in which shingles are counted.
RANGE = 16 << 20
#: Shingles are counted by their hashes without so many bits.
DROPPED = np.uint64(16)

_SETS = ("_id long, _n int, _c long, _d long, _at array<int>, _p array<long>, _q array<int>, "
         "_r array<int>")


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, SOLID, lower=True)
    hashes, first = words.hashed(), words.first
    grams = sequence_hashes(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:  # all words as one shingle
            out.append(sequence_hashes(hashes[a:b], b - a, seed=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(),
                                 batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(counts, "<i8")
            total[block] = total[block] + more if block in total else more
    yield pa.RecordBatch.from_arrays([
        pa.array(list(total), pa.int32()),
        pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["block", "counts"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the block they are in: about `CHUNK` bytes of text, or one longer text."""
    block = TaskContext.get().partitionId() << 32
    for batch in chunks(batches, "text"):
        yield batch.append_column("block", pa.array([block] * len(batch), pa.int64()))
        block += 1


def _told(size: int, ranges: int):
    """The distinct shingles of each block, by the range of hashes in which they are counted,
    and in how many of its documents each is. A block read in pieces has a row for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sets = shingle_sets(batch.column("text").slice(a, b - a), size)
                keys, counts = np.unique(np.concatenate(sets) >> DROPPED, return_counts=True)
                if not len(keys):
                    continue
                target = _range_of(keys, ranges)
                at = np.flatnonzero(np.diff(target, prepend=-1))
                for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
                    rows.append((int(target[i]), int(block[a]), _pack(keys[i:j]),
                                 counts[i:j].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("range", "block", "keys", "counts"), r, strict=True)) for r in rows],
                schema=pa.schema([("range", pa.int32()), ("block", pa.int64()),
                                  ("keys", pa.binary()), ("counts", pa.binary())]))
    return run


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash without its dropped bits; ranges follow the order of hashes."""
    return (((keys >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _levelled(table: pa.Table) -> pa.Table:
    """Of one range: for each block, a level for each of its shingles there, in the order of
    their hashes."""
    blocks = table.column("block").to_numpy()
    keys = [_unpack(k, "<u8") for k in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, "<i4") for c in table.column("counts").to_pylist()])
    found, own = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(own, weights=counts, minlength=len(found))
    level = (4 * np.log2(total)).astype(np.uint8)
    at = np.cumsum([0, *map(len, keys)])
    out, order = [], np.argsort(blocks, kind="stable")
    cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
    for some in np.split(order, cuts[1:]):
        places = [own[at[k]:at[k + 1]] for k in some]
        mine = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
        out.append(level[mine].tobytes())
    return pa.table({"range": pa.array([table.column("range")[0].as_py()] * len(out), pa.int32()),
                     "block": pa.array(blocks[order][cuts], pa.int64()),
                     "levels": pa.array(out, pa.binary())})


def shingle_levels(blocks: DataFrame, size: int) -> DataFrame:
    """How common the shingles of each block are, from counts over all documents: rows `block`,
    `range`, `levels`, a byte for each distinct shingle of the block in that range, 4 times the
    logarithm (base 2) of the number of its documents. A shingle of level 0 is in no other one.

    Hashes are counted without their last `DROPPED` bits: what is then taken for one shingle is
    called more common than it is, nothing else. No task holds more than a range, which is about
    `RANGE` bytes of text, and nothing is sent to all tasks."""
    total = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    told = blocks.mapInArrow(_told(size, 1 + total // RANGE),
                             "`range` int, block long, keys binary, counts binary")
    return told.groupBy("range").applyInArrow(_levelled, "`range` int, block long, levels binary")


def _prefixes(size: int, percent: int):
    """A row per document: the hash of its set and its prefixes under three orders. Each order
    puts rare shingles first and breaks ties by a hash of its own. Shingles that are in no other
    document take their places in a prefix and are left out of it then."""
    def run(docs: pa.Table, levels: pa.Table) -> pa.Table:
        texts = docs.column("text").combine_chunks()
        sets = shingle_sets(texts, size)
        keys = np.unique(np.concatenate(sets) >> DROPPED)
        told = levels.sort_by("range").column("levels").to_pylist()
        level_of = np.frombuffer(b"".join(told), np.uint8)
        assert len(level_of) == len(keys), "the levels of a block are not those of its shingles"
        out = {k: [] for k in ("_n", "_c", "_d", "_at", "_p", "_q", "_r")}
        for s in sets:
            keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            level = level_of[np.searchsorted(keys, s >> DROPPED)]
            high = level.astype(np.uint64) << np.uint64(56)
            orders = [np.argsort(high | (mixed(s + np.uint64(seed)) >> np.uint64(8)))[:keep]
                      for seed in (1, 2, 3)]
            shared = [np.flatnonzero(level[o] > 0) for o in orders]
            data = s.tobytes()
            for name, value in zip(out, (
                    len(s), xxhash.xxh3_64_intdigest(data), xxhash.xxh64_intdigest(data, 1),
                    shared[0].astype(np.int32), s[orders[0][shared[0]]].view(np.int64),
                    s[orders[1][shared[1]]].astype(np.uint32).view(np.int32),
                    s[orders[2][shared[2]]].astype(np.uint32).view(np.int32)), strict=True):
                out[name].append(value)
        table = pa.table({
            "_id": docs.column("_id"), "_n": pa.array(out["_n"], pa.int32()),
            **{k: pa.array(np.array(out[k], np.uint64).view(np.int64)) for k in ("_c", "_d")},
            "_p": pa.array(out["_p"], pa.list_(pa.int64())),
            **{k: pa.array(out[k], pa.list_(pa.int32())) for k in ("_at", "_q", "_r")}})
        return table.select(["_id", "_n", "_c", "_d", "_at", "_p", "_q", "_r"])
    return run


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_x"):
            good = []
            for x, y in zip(shingle_sets(batch.column("_x"), size),
                            shingle_sets(batch.column("_y"), size), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                    pa.array(good, pa.bool_()))
    return run


def _may_be_alike(nx: Column, ix: Column, ny: Column, iy: Column, percent: int) -> Column:
    """What sizes, and the places of the first common shingle, allow."""
    need = F.ceil(F.lit(percent) * (nx + ny) / F.lit(100.0 + percent) - F.lit(1e-9))
    return ((100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
            & (F.least(nx - ix, ny - iy) >= need))


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id`.

    A document's set holds its distinct runs of `size` words (all its words, if there are
    fewer), A-Z in lower case, words being what stands between blanks. Two documents link if
    100 * common >= `percent` * union; the component is the least id reachable by links.

    Documents with equal sets are one class from the start. A class can only link to others with
    which it shares a shingle among the first of its set, under any order of all shingles. Three
    orders are used, each with rare shingles first by exact counts over all documents, made in
    ranges of hashes and told to the blocks of documents that asked. What only one document has
    meets nobody and is left out, so texts that are like no other add no rows: candidates come from the prefixes under the first order, and only those that
    also meet in the prefixes under the second and the third are verified, on whole sets.

    Candidates are taken in two rounds, so that no group of copies is expanded into its pairs.
    First every class meets one member of each of its prefix shingles, the one in which it comes
    earliest, and what is found alike is merged. Then all classes that share a prefix shingle
    and are in different components meet, if sizes and the places of that shingle allow a link.
    A pair that neither round brings up cannot link or is connected already.

    Null and empty texts and texts of blanks have an empty set and no link. A null id has a null
    component and links nothing. Rows with equal id are one document. No rows give no rows.
    Columns other than `doc_id` and `text` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    blocks = stage(rows.mapInArrow(_blocks, "_id long, text string, block long"), "blocks")
    levels = stage(shingle_levels(blocks, size), "levels")
    sets = stage(blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(
        _prefixes(size, percent), _SETS), "shingle-sets")
    used = sets.where("_n > 0 and _id is not null")
    classes = stage(used.groupBy("_c", "_d").agg(F.min("_id").alias("_rep")), "classes")

    members = used.select("_c", "_d", "_n", F.explode(F.arrays_zip("_at", "_p")).alias("_m"))
    members = members.select("_c", "_d", "_n", F.col("_m._at").alias("_i"),
                             F.col("_m._p").alias("_t"))
    place = F.shiftleft(F.col("_n").cast("long"), 32) + F.col("_i")
    tokens = members.groupBy("_t").agg(
        F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.count(F.lit(1)).alias("_rows"),
        F.min(place).alias("_p"), F.max(place).alias("_q"))
    # Most shared shingles have two holders that met by chance; their sizes and places tell.
    n, i = (lambda p: F.shiftright(p, 32)), (lambda p: F.col(p).bitwiseAND(F.lit(2**32 - 1)))
    tokens = tokens.where((F.col("_lo") != F.col("_hi")) & ((F.col("_rows") > 2) | _may_be_alike(
        n("_p"), i("_p"), n("_q"), i("_q"), percent)))
    tokens = stage(tokens.select("_t", "_rows"), "tokens")
    holders = members.join(tokens, "_t")
    own = ["_c", "_d", "_n", "_i"]
    # The like for other small groups: who fits none of the others there meets nobody by it.
    few = holders.where(F.col("_rows") <= FEW).groupBy("_t").agg(
        F.collect_set(F.struct(*own)).alias("_all"))
    few = few.select("_t", F.explode(F.filter("_all", lambda x: F.exists("_all", lambda y: (
        (x["_c"] != y["_c"]) & _may_be_alike(x["_n"], x["_i"], y["_n"], y["_i"], percent)))))
        .alias("_m")).select("_t", *[f"_m.{c}" for c in own])
    many = holders.where(F.col("_rows") > FEW).select("_t", *own).distinct()
    shared = few.union(many).join(classes, ["_c", "_d"]).drop("_c", "_d")
    shared = stage(shared, "shared-shingles")

    reps = stage(shared.select(F.col("_rep").alias("_id")).distinct(), "reps")
    orders = _masked(used.select("_id", "_q", "_r"), "_id", reps).join(reps, "_id")
    orders = stage(orders.withColumnRenamed("_id", "_rep").dropDuplicates(["_rep"]), "orders")
    # The member that meets the others: the one with the shingle earliest, by a packed key.
    key = F.shiftleft(F.least("_i", F.lit(1 << 21)).cast("long"), 41).bitwiseOR(
        F.col("_rep").bitwiseAND(F.lit((1 << 41) - 1)))
    first = stage(shared.groupBy("_t").agg(F.min(key).alias("_key")), "first")
    first = stage(shared.join(first, "_t").where(key == F.col("_key")).drop("_key"), "first")
    star = shared.alias("x").join(first.alias("y"), F.col("x._t") == F.col("y._t"))
    tried = _candidates(star, orders, percent)
    links = stage(_alike(rows, tried, size, percent), "links")

    found = components(links).select(F.col("id").alias("_rep"), "component")
    found = stage(found, "found")
    labelled = shared.join(found, "_rep", "left").withColumn(
        "_comp", F.coalesce("component", "_rep")).drop("component")
    labelled = stage(labelled, "labelled")
    open_ = labelled.groupBy("_t").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi"))
    open_ = stage(open_.where("_lo != _hi").select("_t"), "open")
    labelled = stage(labelled.join(open_, "_t"), "labelled")
    rest = labelled.alias("x").join(labelled.alias("y"), (F.col("x._t") == F.col("y._t"))
                                    & (F.col("x._comp") < F.col("y._comp")))
    more = _candidates(rest, orders, percent, tried)
    links = links.union(stage(_alike(rows, more, size, percent), "links"))

    found = stage(components(links), "found")
    classes = classes.join(found, classes["_rep"] == found["id"], "left").select(
        "_c", "_d", F.coalesce("component", "_rep").alias("_comp"))
    out = sets.select("_id", "_n", "_c", "_d").join(stage(classes, "classes"), ["_c", "_d"], "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_shingles"),
                      F.when(F.col("_id").isNotNull(), F.coalesce("_comp", "_id"))
                      .alias("component_id"))


def _candidates(met: DataFrame, orders: DataFrame, percent: int,
                tried: DataFrame | None = None) -> DataFrame:
    """Pairs that may be alike by size and place, and meet under the other orders too."""
    x, y = F.col("x._rep"), F.col("y._rep")
    fits = _may_be_alike(F.col("x._n"), F.col("x._i"), F.col("y._n"), F.col("y._i"), percent)
    pairs = met.where((x != y) & fits).select(
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        own = orders.select(F.col("_rep").alias(side), F.col("_q").alias(f"_q{side}"),
                            F.col("_r").alias(f"_r{side}"))
        pairs = pairs.join(own, side)
    meet = F.arrays_overlap("_qa", "_qb") & F.arrays_overlap("_ra", "_rb")
    return stage(pairs.where(meet).select("a", "b"), "candidates")


def _masked(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """`rows` without most of those whose `column` is not wanted, so that a join with `wanted`
    moves little: a filter of fixed size, 64 bits a row, is sent to every task. An input so
    large that all bits are set loses this saving and nothing else."""
    word = F.shiftright(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)), 6)
    bit = f"cast(pmod(xxhash64({column}), 64L) as int)"
    mask = wanted.groupBy(word.alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))
    mask = F.broadcast(stage(mask, "filter"))
    return rows.withColumn("_word", word).join(mask, "_word").where(
        f"(shiftright(_bits, {bit}) & 1L) = 1L").drop("_word", "_bits")


def _alike(rows: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs, those whose whole sets are alike."""
    wanted = pairs.select(F.col("a").alias("_id")).union(pairs.select("b"))
    # Whole texts move here: they compress, and their sets of hashes would not.
    texts = stage(_masked(rows, "_id", wanted), "texts")
    whole = pairs.join(texts.select(F.col("_id").alias("a"), F.col("text").alias("_x")), "a").join(
        texts.select(F.col("_id").alias("b"), F.col("text").alias("_y")), "b")
    return whole.select("a", "b", "_x", "_y").mapInArrow(_verified(size, percent),
                                                         "a long, b long")
