"""Documents packed into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.llm.tokens import encoder
from vidlake.llm.words import chunks
from vidlake.session import stage

SEQUENCE = 2048
#: Id after each document.
END = 0
#: Pieces that are packed together, islands that try so, solutions on an island, generations
#: between migrations, migrations.
CELL, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 1500, 2, 4, 6, 2
#: Bytes of text encoded together.
TEXT_BYTES = 2 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE,
           ids: bool = False) -> DataFrame:
    """One row per piece of a document: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, and
    with `ids` the token ids themselves.

    A document is its ids and an end id. One of more than `sequence` ids is cut into pieces of
    that many; what is over comes first. A null text is empty and has only the end id.
    """
    schema = _PIECES + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        for batch in chunks(batches, "text", TEXT_BYTES):
            flat, at = own_encoder.encode(batch.column("text"))
            doc, piece, start, length, crc, own = [], [], [], [], [], []
            for k, d in enumerate(batch.column("doc_id").to_pylist()):
                text = np.append(flat[at[k]:at[k + 1]], END).astype("<u4")
                cuts = [0, *range(len(text) % sequence or min(sequence, len(text)), len(text),
                                  sequence), len(text)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d), piece.append(n), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(text[a:b].tobytes()))
                    if ids:
                        own.append(text[a:b].astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema)


# A solution is a list of bins, a bin a list of pieces. Lengths are looked up by piece.


def best_fit(bins: list[list[int]], loose: list[int], length: list[int], room: int) -> None:
    """Put pieces, longest first, where the least room is left that suffices; else open a bin."""
    left = sorted((room - sum(length[p] for p in b), k) for k, b in enumerate(bins))
    for p in sorted(loose, key=lambda p: (-length[p], p)):
        at = bisect.bisect_left(left, (length[p], -1))
        if at < len(left):
            free, k = left.pop(at)
            bins[k].append(p)
        else:
            free, k = room, len(bins)
            bins.append([p])
        if free > length[p]:
            bisect.insort(left, (free - length[p], k))


def worth(bins: list[list[int]], length: list[int], room: int) -> tuple[int, float]:
    """Few bins first; among as many, uneven filling is better, for it leaves one to empty."""
    return -len(bins), sum((sum(length[p] for p in b) / room) ** 2 for b in bins)


def crossed(mother: list, father: list, length: list[int], room: int,
            rng: random.Random) -> list[list[int]]:
    """A child: some well filled bins of the father go whole into the mother's solution, bins
    that hold a piece of theirs are dissolved, and the pieces so displaced are put by best fit,
    as are those of a few of the emptiest bins left."""
    def filled(b: list[int]) -> int:
        return sum(length[p] for p in b)

    best = sorted(father, key=filled, reverse=True)[:max(1, len(father) // 2)]
    injected = [list(b) for b in rng.sample(best, max(1, len(best) // 3))]
    inside = {p for b in injected for p in b}
    child, loose = injected, []
    rest = []
    for b in mother:
        if inside.isdisjoint(b):
            rest.append(b)
        else:
            loose.extend(p for p in b if p not in inside)
    rest.sort(key=filled)
    few = min(len(rest), 1 + rng.randrange(4))
    for b in rest[:few]:
        loose.extend(b)
    child += [list(b) for b in rest[few:]]
    best_fit(child, loose, length, room)
    return child


def evolved(population: list, length: list[int], room: int, size: int, generations: int,
            rng: random.Random) -> list:
    """The population after some generations, best first. It stops early at the least possible
    number of bins."""
    least = -(-sum(length) // room)
    population = list(population)
    while len(population) < size:
        if not population:
            bins: list = []
            best_fit(bins, list(range(len(length))), length, room)
        else:  # begin with a random part already placed
            bins = [[p] for p in rng.sample(range(len(length)), max(1, len(length) // 20))]
            inside = {p for b in bins for p in b}
            best_fit(bins, [p for p in range(len(length)) if p not in inside], length, room)
        population.append(bins)
        if len(bins) <= least:
            break
    population.sort(key=lambda b: worth(b, length, room), reverse=True)
    for _ in range(generations):
        if len(population[0]) <= least or len(population) < 2:
            break
        mother, father = rng.sample(population[:max(2, size)], 2)
        population.append(crossed(mother, father, length, room, rng))
        population.sort(key=lambda b: worth(b, length, room), reverse=True)
        del population[size:]
    return population


def _coded(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(coded: bytes) -> list[list[int]]:
    of = np.frombuffer(coded, np.int32)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [b.tolist() for b in np.split(order, cuts)] if len(of) else []


_ISLAND = "cell long, island int, lengths array<int>, solutions array<binary>"


def _evolve(sequence: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rng = random.Random(f"{epoch} {r['cell']} {r['island']}")
                start = [_bins(s) for s in r["solutions"] or ()]
                found = evolved(start, r["lengths"], sequence, population, generations, rng)
                out.append([_coded(b, len(r["lengths"])) for b in found])
            columns = [batch.column(c) for c in ("cell", "island", "lengths")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.binary()))],
                                             names=["cell", "island", "lengths", "solutions"])
    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the best of a cell's solutions: the one with the fewest bins."""
    for batch in batches:
        cell, item, number, offset, filled = [], [], [], [], []
        for r in batch.to_pylist():
            of = min((np.frombuffer(s, np.int32) for s in r["solutions"]),
                     key=lambda o: int(o.max()) + 1)
            lengths = np.array(r["lengths"], np.int64)
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(lengths[order])
            first = np.concatenate(([True], of[order][1:] != of[order][:-1]))
            base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
            total = np.bincount(of, lengths).astype(np.int64)
            cell.append(np.full(len(of), r["cell"]))
            item.append(np.array(r["items"], np.int64)[order])
            number.append(of[order].astype(np.int64))
            offset.append(ends - lengths[order] - base)
            filled.append(total[of[order]])
        if cell:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (cell, item, number, offset, filled)],
                names=["cell", "item", "number", "offset", "filled"])


def _packed(items: DataFrame, sequence: int, seed: int) -> DataFrame:
    """`items`: `item`, `length`, all shorter than a sequence. Returns `cell`, `item`, `number`
    (of the sequence in its cell), `offset`, `filled` (ids in the sequence).

    Pieces are dealt into cells of bounded size by a hash, so every cell has the lengths of the
    whole corpus. Several islands work on a cell, each in a task of its own; after an epoch each
    one sends its elite to the next island of its cell, through a join.
    """
    cells = max(1, -(-items.count() // CELL))
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(cells)))
    cells = dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(
        "length", "item"))).alias("all"))
    cells = stage(cells.select("cell", F.col("all.item").alias("items"),
                               F.col("all.length").cast("array<int>").alias("lengths")), "cells")
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
                         .alias("island"), "lengths",
                         F.lit(None).cast("array<binary>").alias("solutions"))
    for epoch in range(EPOCHS):
        if epoch:
            elite = state.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS))
                                 .alias("island"), F.slice("solutions", 1, 1).alias("elite"))
            state = state.join(elite, ["cell", "island"]).select(
                "cell", "island", "lengths",
                F.array_distinct(F.concat("elite", "solutions")).alias("solutions"))
        # One island is one row; deal them evenly, for the work is in the rows.
        state = state.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                                  "cell", "island")
        state = stage(state.mapInArrow(_evolve(sequence, POPULATION, GENERATIONS, epoch), _ISLAND),
                      "islands")
    best = state.groupBy("cell").agg(F.flatten(F.collect_list(F.slice("solutions", 1, 1)))
                                     .alias("solutions"))
    return cells.join(best, "cell").select("cell", "items", "lengths", "solutions").mapInArrow(
        _placed, "cell long, item long, number long, offset long, filled long")


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE,
           ids: bool = False) -> DataFrame:
    """`pieces(docs)` with `sequence_id` and `offset`: where each piece lies.

    Pieces of full length are a sequence of their own. The others, as narrow rows, go through the
    genetic algorithm (see `_packed`), each with a number of its own, so equal documents are
    told apart. What then lies in sequences that are not well filled, at least one for each cell,
    is packed once more together, in new cells.

    Texts may be null, empty or of any length; a null `doc_id` stays null; rows with equal ids
    are packed each. No rows give no rows. Columns other than `doc_id` and `text` are not read.
    """
    every = stage(pieces(docs, tokenizer, sequence, ids), "pieces", row_id=True)
    items = every.where(F.col("length") < sequence).select(
        F.col("row_id").alias("item"), "length")
    first = stage(_packed(items, sequence, 1), "packed")
    full = first.where(F.col("filled") >= F.lit(sequence * 0.99))
    open_ = first.where(F.col("filled") < F.lit(sequence * 0.99))
    again = items.join(open_.select("item"), "item")
    second = stage(_packed(stage(again, "loose"), sequence, 2), "packed")
    # Numbers: full pieces have the even ones of the rows, the others odd ones by round and cell.
    place = full.withColumn("_round", F.lit(0)).union(second.withColumn("_round", F.lit(1)))
    place = place.select(F.col("item").alias("row_id"), F.expr(
        f"((cell * {2 * CELL * 4} + number) * 2 + _round) * 2 + 1").alias("sequence_id"), "offset")
    out = every.join(place, "row_id", "left").withColumns({
        "sequence_id": F.coalesce("sequence_id", F.col("row_id") * 2),
        "offset": F.coalesce("offset", F.lit(0).cast("long"))})
    return out.drop("row_id")
