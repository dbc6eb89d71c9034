"""Vectors as short codes: a codebook for each part, by Lloyd's rounds over two trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidlake.llm.words import spread
from vidlake.session import stage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are held as integers of so many steps to one.
STEPS = 256
#: Vectors in one tree, and parts in a leaf of it, at most about.
BLOCK, LEAF = 4096, 16


@dataclass
class Tree:
    """A balanced tree over points: node `i` of level `l` has the points, in tree order, from
    `cut(l)[i]` up to `cut(l)[i + 1]`, and the box `low[l][i]`, `high[l][i]` around them."""

    points: np.ndarray
    levels: int
    low: list[np.ndarray]
    high: list[np.ndarray]

    @classmethod
    def over(cls, points: np.ndarray, levels: int) -> Tree:
        """`points` are in tree order already."""
        at = cuts(len(points), levels)[:-1]
        low, high = [np.minimum.reduceat(points, at)], [np.maximum.reduceat(points, at)]
        for _ in range(levels):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
        return cls(points, levels, low, high)

    def cut(self, level: int) -> np.ndarray:
        return cuts(len(self.points), level)


def cuts(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1) * n >> level


def tree_order(points: np.ndarray, levels: int) -> np.ndarray:
    """Each node is halved across its widest side."""
    order = np.arange(len(points))
    for level in range(levels):
        at = cuts(len(points), level)
        own = points[order]
        wide = (np.maximum.reduceat(own, at[:-1]) - np.minimum.reduceat(own, at[:-1])).argmax(1)
        node = np.repeat(np.arange(1 << level), np.diff(at))
        order = order[np.lexsort((own[np.arange(len(own)), wide[node]], node))]
    return order


def depth(n: int, leaf: int) -> int:
    return max(0, (n // leaf).bit_length() - 1)


def nearest(tree: Tree, entries: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """For each point of the tree its nearest entry, of equally near ones the first.

    Returns `whole`: (level, nodes, entry of each) for nodes all of whose points have one entry,
    and the other points (places in tree order) with theirs.

    A pair of nodes, one of each tree, goes on to its children unless the entries' box is
    farther from the points' box at its nearest than other entries are at their farthest. Single
    entries also go where another one is nearer to every corner of the points' box. All bounds
    are integers and strict, so ties stay to the end.
    """
    k = len(entries)
    last = max(0, (k - 1).bit_length())
    number = np.minimum(np.arange(1 << last), k - 1)
    padded = entries[number]  # the last one again, under numbers that lose every tie
    order = tree_order(padded, last)
    of = Tree.over(padded[order], last)
    whole = []
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = e_level = 0
    while len(node):
        plo, phi = tree.low[level][node], tree.high[level][node]
        elo, ehi = of.low[e_level][entry], of.high[e_level][entry]
        gap = np.maximum(np.maximum(elo - phi, plo - ehi), 0)
        far = np.maximum(np.abs(phi - elo), np.abs(ehi - plo))
        near, far = (gap * gap).sum(1), (far * far).sum(1)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        group = np.cumsum(np.concatenate(([0], (node[1:] != node[:-1]).astype(np.int64))))
        least = np.minimum.reduceat(far, first)
        keep = near <= least[group]
        if e_level == last:
            # The entry with the least far side stands against all others of its node.
            at = np.where(far == least[group], np.arange(len(far)), len(far))
            best = of.points[entry[np.minimum.reduceat(at, first)]][group]
            own = of.points[entry]
            side = 2 * (own - best)
            lead = np.maximum(side * plo, side * phi).sum(1)
            lead += (best * best).sum(1) - (own * own).sum(1)
            keep &= lead >= 0
        node, entry, group = node[keep], entry[keep], group[keep]
        if e_level == last:
            count = np.bincount(group, minlength=len(first))
            alone = count[group] == 1
            if alone.any():
                whole.append((level, node[alone], np.minimum(order[entry[alone]], k - 1)))
                node, entry = node[~alone], entry[~alone]
            if level == tree.levels:
                break
        if e_level < last:
            node = np.repeat(node, 2)
            entry = (2 * entry[:, None] + np.arange(2)).ravel()
            e_level += 1
        if level < tree.levels:
            node = np.concatenate((2 * node, 2 * node + 1))
            entry = np.concatenate((entry, entry))
            sort = np.argsort(node, kind="stable")
            node, entry = node[sort], entry[sort]
            level += 1
    if not len(node):
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Leaves that are not decided: each of their points meets each entry that is left.
    cut = tree.cut(level)
    leaf, first, count = np.unique(node, return_index=True, return_counts=True)
    size = cut[leaf + 1] - cut[leaf]
    points = spread(cut[leaf], size)
    n, begin = np.repeat(count, size), np.repeat(first, size)
    pair_entry = np.minimum(order[entry[spread(begin, n)]], k - 1)
    off = tree.points[np.repeat(points, n)] - entries[pair_entry]
    distance = (off * off).sum(1)
    at = np.cumsum(n) - n
    least = np.repeat(np.minimum.reduceat(distance, at), n)
    return whole, points, np.minimum.reduceat(np.where(distance == least, pair_entry, k), at)


def assigned(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, in tree order."""
    whole, points, own = nearest(tree, entries)
    out = np.empty(len(tree.points), np.int64)
    out[points] = own
    for level, nodes, entry in whole:
        cut = tree.cut(level)
        size = cut[nodes + 1] - cut[nodes]
        out[spread(cut[nodes], size)] = np.repeat(entry, size)
    return out


def summed(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points nearest to each entry; whole nodes add their stored sums."""
    whole, points, own = nearest(tree, entries)
    total, count = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    np.add.at(total, own, tree.points[points])
    np.add.at(count, own, 1)
    running = np.concatenate((np.zeros_like(tree.points[:1]), np.cumsum(tree.points, 0)))
    for level, nodes, entry in whole:
        cut = tree.cut(level)
        np.add.at(total, entry, running[cut[nodes + 1]] - running[cut[nodes]])
        np.add.at(count, entry, cut[nodes + 1] - cut[nodes])
    return total, count


def bound(dims: int) -> int:
    """Components are held within this: squared distances, summed over a vector, fit a long."""
    return 1 << (62 - max(1, dims).bit_length()) // 2 - 1


def steps(values: np.ndarray, width: int) -> np.ndarray:
    """The integers of vectors (rows), with zeros up to `width` at the end."""
    most = bound(width)
    out = np.zeros((len(values), width), np.int64)
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * STEPS)
    out[:, :values.shape[1]] = np.clip(scaled, -most, most)
    return out


def _blocks(parts: int, dims: int, kinds: list[pa.DataType]):
    """Vectors in blocks, each part in the order of its tree."""
    width = -(-dims // parts) * parts

    def block(ids, labels, values: np.ndarray) -> pa.RecordBatch:
        cells = steps(values, width).reshape(len(values), parts, -1).transpose(1, 0, 2)
        order = [tree_order(c, depth(len(c), LEAF)) for c in cells]
        held = np.stack([c[o] for c, o in zip(cells, order, strict=True)])
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(kinds[0])), pa.array([labels], pa.list_(kinds[1])),
            pa.array([held.astype("<i4").tobytes()], pa.binary()),
            pa.array([np.stack(order).astype("<i4").tobytes()], pa.binary())],
            names=["ids", "labels", "held", "order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values = [], [], []
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                some = batch.slice(k, BLOCK)
                ids += some.column("vec_id").to_pylist()
                labels += some.column("label").to_pylist()
                values.append(np.asarray(some.column("embedding").flatten(), np.float64)
                              .reshape(len(some), dims))
                if len(ids) >= BLOCK:
                    every = np.concatenate(values)
                    yield block(ids[:BLOCK], labels[:BLOCK], every[:BLOCK])
                    ids, labels, values = ids[BLOCK:], labels[BLOCK:], [every[BLOCK:]]
        if ids:
            yield block(ids, labels, np.concatenate(values))
    return run


def _trees(row: dict, parts: int) -> list[Tree]:
    n = len(row["ids"])
    held = np.frombuffer(row["held"], "<i4").astype(np.int64).reshape(parts, n, -1)
    return [Tree.over(points, depth(n, LEAF)) for points in held]


def _round(books: np.ndarray):
    """Sums and, behind them, counts of all entries over the blocks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, d = books.shape
        total = np.zeros((parts, k, d + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for own, tree, entries in zip(total, _trees(row, parts), books, strict=True):
                    sums, count = summed(tree, entries)
                    own[:, :d] += sums
                    own[:, d] += count
        flat = total.ravel()
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(flat[cell])],
                                         names=["cell", "total"])
    return run


def _coded(books: np.ndarray, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                order = np.frombuffer(row["order"], "<i4").reshape(parts, n)
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, (tree, entries) in enumerate(zip(_trees(row, parts), books, strict=True)):
                    own = assigned(tree, entries)
                    off = tree.points - entries[own]
                    codes[order[p], p] = own
                    error[order[p]] += (off * off).sum(1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], kinds[0]), pa.array(row["labels"], kinds[1]),
                    pa.array([c.tobytes().hex() for c in codes]), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])
    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
               rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """A row per vector: `vec_id`, `label`, `code` (two hex digits for each part), `error` (its
    squared distance from what the code stands for); and the codebooks, by part, entry, place.

    Each component x becomes floor(256 * x), and vectors are cut into `parts` equal parts. The
    codebook of a part starts as that part of the vectors with the least ids; at most 256
    `entries`. A round gives each part to its nearest entry, of equally near ones to the first,
    and moves each entry to the mean of its parts, rounded down; unused entries stay.

    Vectors are held in blocks of bounded size as a staged table, with the parts of each place
    in the order of a balanced tree; entries form a second tree, and each round walks both at
    once (`nearest`). Tasks return sums for each entry, added up by place in its codebook: what
    reaches the driver has the size of the codebooks, whatever the input.

    Left out are rows whose vector is null, holds null, NaN or infinite components, or differs
    in length from the vector of least id (of equal ids the least vector; null ids come last). A
    length that is no multiple of `parts` is filled up with zeros. Integers beyond `bound` stay
    at it, for a long holds no more; other values are exact. Repeated rows count each. Fewer
    vectors than `entries` make smaller codebooks; none give no rows. Columns other than
    `vec_id`, `embedding` and `label` are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>")).where(
        "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) "
        "and abs(x) < double('infinity'))")
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    start = [r["embedding"] for r in least.select("embedding").collect()]
    schema = T.StructType([f for f in kept.schema if f.name != "embedding"]).add(
        "code", "string").add("error", "long")
    if not start:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dims = len(start[0])
    kept = kept.where(F.size("embedding") == dims)
    values = np.array([v for v in start if len(v) == dims])
    if len(values) < len(start):  # others were among the first
        values = np.array([r["embedding"] for r in kept.orderBy(
            F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()])
    width = -(-dims // parts) * parts
    books = steps(values, width).reshape(len(values), parts, -1).transpose(1, 0, 2)

    own = [f"array<{kept.schema[c].dataType.simpleString()}>" for c in ("vec_id", "label")]
    kinds = [_arrow(kept.schema[c].dataType) for c in ("vec_id", "label")]
    blocks = stage(kept.mapInArrow(
        _blocks(parts, dims, kinds),
        f"ids {own[0]}, labels {own[1]}, held binary, `order` binary"), "vector-blocks")
    shape = (parts, books.shape[1], books.shape[2] + 1)
    for _ in range(rounds):
        found = blocks.select("ids", "held").mapInArrow(_round(books), "cell int, total long")
        total = np.zeros(int(np.prod(shape)), object)
        for r in found.groupBy("cell").agg(
                F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            total[r["cell"]] = int(r["total"])
        total = total.reshape(shape)
        count = total[:, :, -1:]
        moved = total[:, :, :-1] // np.where(count > 0, count, 1)
        books = np.where(count > 0, moved, books).astype(np.int64)
    return blocks.mapInArrow(_coded(books, kinds), schema), books


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds `label_error`: the errors of all rows with this label, nulls being one label; null
    where the sum is beyond a long. `coded` is read twice."""
    sums = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)")
                                      .alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
