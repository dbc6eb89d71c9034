"""Sources mixed to target weights: copies of documents by weighted pivotal rounding."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.llm.columns import BLANKS, text_hash, without
from vidlake.session import stage

#: Weights of the sources in order of their names, again and again.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = Fraction(3, 2)
#: A source, and so a document, is taken so many times at most.
REPEATS = 2
#: Documents that are settled together in one step of the tree, on average.
FOLD = 128
#: Repeated rows that one task writes together.
CHUNK = 4096


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `nth`, from 0, in this order (nulls last): ranges are counted, and the counts
    of earlier ranges, one row per partition, are added. Equal rows are numbered in any order."""
    by = [F.col(c).asc_nulls_last() for c in order]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(width, *by).withColumn(
        "_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_part").orderBy(*by)
    return ranged.join(F.broadcast(starts), "_part").withColumn(
        "nth", F.col("_from") + F.row_number().over(inside) - 1).drop("_part", "_from")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """`sources`: `source`, `source_size` (a row for each). Adds `target`.

    All targets together are `share` of all sizes. A target is its source's weight times one
    level, but `repeats` times its size at most; the level rises until what full sources leave
    over is shared out. Each step is one sum over the sources, and sources once full stay so.
    """
    listed = stage(numbered(sources, "source").select(
        "source", "source_size",
        F.element_at(F.lit(list(weights)), (F.col("nth") % len(weights) + 1).cast("int"))
        .alias("_weight")), "source-weights")
    room = F.col("source_size") * repeats
    total, free = listed.agg(F.sum(F.col("source_size").cast("decimal(38,0)")),
                             F.sum(F.col("_weight").cast("long"))).first()
    words = share * int(total or 0)
    left, before = words, None
    while free and (left, free) != before:
        before = left, free
        level = F.lit(float(left)) * F.col("_weight") / F.lit(float(free))
        full, rest = listed.agg(
            F.sum(F.when(room <= level, room).cast("decimal(38,0)")),
            F.sum(F.when(room > level, F.col("_weight")).cast("long"))).first()
        if not rest:
            break
        left, free = words - int(full or 0), rest
    level = F.lit(float(left)) * F.col("_weight") / F.lit(float(free or 1))
    return listed.select("source", "source_size", F.least(room.cast("double"), level)
                         .alias("target"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f(value)`, with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _uniform(*of: Column) -> Column:
    """A number from 0 up to, not including, 1, that depends on these values alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(2**53))


def _with(item: Column, mass: Column) -> Column:
    return item.withField("mass", mass)


def _settled(item: Column, up: Column) -> Column:
    return F.struct(item["unit"].alias("unit"), up.cast("int").alias("up"))


def _pair(carry: Column, item: Column) -> Column:
    """One pivotal step. `mass` words of each are wanted, between none and its `room`. Words move
    from one to the other until one has none or all; which way is drawn so that each keeps its
    mass in expectation, and the sum of both is kept in any case."""
    c_room, i_room = carry["room"] - carry["mass"], item["room"] - item["mass"]
    gain, loss = F.least(c_room, item["mass"]), F.least(carry["mass"], i_room)
    rises = _uniform(carry["h"], item["h"]) * (gain + loss) < loss

    def decided(m: Column) -> Column:
        rises, gain, loss = m["rises"], m["gain"], m["loss"]
        c_ends = F.when(rises, c_room <= item["mass"]).otherwise(carry["mass"] <= i_room)
        i_ends = F.when(rises, item["mass"] <= c_room).otherwise(i_room <= carry["mass"])
        c_next = F.when(rises, carry["mass"] + gain).otherwise(carry["mass"] - loss)
        i_next = F.when(rises, item["mass"] - gain).otherwise(item["mass"] + loss)
        return F.struct(
            F.when(~c_ends, _with(carry, c_next)).when(~i_ends, _with(item, i_next))
            .alias("carry"),
            F.filter(F.array(F.when(c_ends, _settled(carry, rises)),
                             F.when(i_ends, _settled(item, ~rises))),
                     lambda x: x.isNotNull()).alias("done"))

    return _let(F.struct(rises.alias("rises"), gain.alias("gain"), loss.alias("loss")), decided)


def _given_up(state: Column, kind: str) -> Column:
    """The carry meets all units after it, together: what it gains or loses, each of them gives
    or takes by the same share of its mass or of its free room. What they have become is held as
    two factors, for their mass and their room. Where they are used up, the carry is drawn."""
    carry, rooms = state["carry"], state["rooms"]
    rest = F.greatest(F.lit(0.0), F.least(
        rooms, state["a"] * state["masses"] + state["b"] * rooms))

    def drawn(m: Column) -> Column:
        mass, room = carry["mass"], carry["room"]
        gain, loss = F.least(room - mass, m["rest"]), F.least(mass, m["free"])
        rises = _uniform(carry["h"], F.lit(1)) * (gain + loss) < loss
        ends = F.when(rises, room - mass <= m["rest"]).otherwise(mass <= m["free"])
        left = F.when(rises, mass + gain).otherwise(mass - loss)
        return F.struct(
            rises.alias("rises"),
            F.when(ends, rises).otherwise(_uniform(carry["h"]) * room < left).alias("up"),
            F.coalesce(F.when(rises, F.try_divide(gain, m["rest"]))
                       .otherwise(F.try_divide(loss, m["free"])), F.lit(0.0)).alias("share"))

    def after(d: Column) -> Column:
        kept = 1 - d["share"]
        return state.withField("a", state["a"] * kept).withField(
            "b", state["b"] * kept + F.when(d["rises"], 0.0).otherwise(d["share"])).withField(
            "done", F.concat(state["done"], F.array(_settled(carry, d["up"])))).withField(
            "carry", F.lit(None).cast(kind))

    found = F.struct(rest.alias("rest"), (rooms - rest).alias("free"))
    return _let(_let(found, drawn), after)


def _in_classes(state: Column, item: Column, kind: str) -> Column:
    """A step of the last fold. Units of about the same size settle each other in pairs; the one
    that is left of them is settled by all the smaller ones."""
    def paired(now: Column) -> Column:
        room = item["room"]
        mass = F.greatest(F.lit(0.0), F.least(room, now["a"] * item["mass"] + now["b"] * room))

        def joined(own: Column) -> Column:
            sure = (own["mass"] <= 0) | (own["mass"] >= room)
            alone = F.struct(own.alias("carry"), now["done"].alias("done"))
            ended = F.struct(now["carry"].alias("carry"), F.concat(
                now["done"], F.array(_settled(own, own["mass"] > 0))).alias("done"))
            both = _let(_pair(now["carry"], own), lambda p: F.struct(
                p["carry"].alias("carry"), F.concat(now["done"], p["done"]).alias("done")))
            return F.when(sure, ended).when(now["carry"].isNull(), alone).otherwise(both)

        return _let(_let(_with(item, mass), joined), lambda d: F.struct(
            now["a"].alias("a"), now["b"].alias("b"), (now["rooms"] - room).alias("rooms"),
            (now["masses"] - item["mass"]).alias("masses"), d["carry"].alias("carry"),
            d["done"].alias("done")))

    smaller = state["carry"].isNotNull() & (item["room"] * 2 <= state["carry"]["room"])
    return _let(F.when(smaller, _given_up(state, kind)).otherwise(state), paired)


def _folded(items: DataFrame, by: list[str], kind: str, last: bool = False) -> DataFrame:
    """`items`: `by` and `item`. For each group one row with `carry`, the item left over, or
    null, and `done`: the units settled. Larger items come first. A `last` fold goes through them
    class by class, so that what is left over at the end is one of the smallest."""
    carry = F.lit(None).cast(kind).alias("carry")
    done = F.array().cast(f"array<struct<unit:{_unit(kind)},up:int>>").alias("done")

    def step(state: Column, item: Column) -> Column:
        paired = _let(_pair(state["carry"], item), lambda p: F.struct(
            p["carry"].alias("carry"), F.concat(state["done"], p["done"]).alias("done")))
        return F.when(state["carry"].isNull(), F.struct(
            item.alias("carry"), state["done"].alias("done"))).otherwise(paired)

    groups = items.groupBy(*by).agg(F.sort_array(F.collect_list("item")).alias("items"))
    if last:
        def total(name: str) -> Column:
            return F.aggregate("items", F.lit(0.0), lambda x, i: x + i[name])

        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), total("room").alias("rooms"),
                         total("mass").alias("masses"), carry, done)
        found = F.aggregate("items", start, lambda s, i: _in_classes(s, i, kind))
    else:
        found = F.aggregate("items", F.struct(carry, done), step)
    return groups.select(*by, found.alias("s")).select(*by, "s.carry", "s.done")


def _unit(kind: str) -> str:
    """The type of the field `unit`, which is the last one of an item."""
    return kind[kind.index("unit:") + len("unit:"):-1]


def rounded(units: DataFrame, unit: list[str]) -> DataFrame:
    """`units`: `source`, the columns `unit`, `room` (words, above 0), `mass` (words wanted,
    between 0 and `room`). One row for each: `unit` as a struct and `up`, 1 where it is taken.

    The words taken of a source are those wanted, up to less than one unit, and each unit is
    taken with probability mass / room. Units are dealt by a hash, within their source and size
    class, into folds of about `FOLD`; each fold settles all its units but one, and those meet
    again in folds of the same kind, a tree whose height grows with the logarithm of the input.
    The last fold of a source goes through its size classes from the largest down; what is left
    of a class is settled by all the smaller units together. One fold of each class is kept whole
    for it, so that there are always units fine enough to settle the coarse ones. Draws depend on the units alone.
    """
    items = units.withColumn("item", F.struct(
        (-F.col("room")).alias("size"), F.xxhash64("source", *unit).alias("h"),
        F.col("room"), F.col("mass"), F.struct(*unit).alias("unit")))
    kind = items.schema["item"].dataType.simpleString()
    items = stage(items.select("source", F.floor(F.log2("room")).cast("int").alias("class"),
                               "item"), "pivotal-items")
    # For most inputs there is one row for each of a few sources and size classes.
    folds = stage(items.groupBy("source", "class").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(FOLD))).cast("long").alias("folds")), "folds")
    same = F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.class") == F.col("y.class"))
    dealt = stage(items.alias("x").join(folds.alias("y"), same).select(
        "x.source", "x.class", "item",
        F.pmod(F.col("item.h"), F.col("folds")).alias("fold")), "pivotal-folds")
    roots = [dealt.where("fold = 0").select("source", "item")]
    level, width = dealt.where("fold > 0"), folds.agg(F.max("folds")).first()[0] or 0
    out = []
    while width > 1:
        found = stage(_folded(level, ["source", "class", "fold"], kind), "pivotal-level")
        out.append(found.select("source", F.explode("done").alias("d")))
        level = found.where("carry is not null").select(
            "source", "class", F.col("carry").alias("item"),
            F.expr(f"fold div {FOLD}").alias("fold"))
        width = -(-width // FOLD)
        if width == 1:
            roots.append(level.select("source", "item"))
    last = roots[0] if len(roots) == 1 else roots[0].union(roots[1])
    found = stage(_folded(last, ["source"], kind, last=True), "pivotal-level")
    out.append(found.select("source", F.explode("done").alias("d")))
    end = F.col("carry")
    out.append(found.where("carry is not null").select("source", _settled(end, _uniform(
        end["h"]) * end["room"] < end["mass"]).alias("d")))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every.select("source", "d.unit", "d.up")


def _words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def _units(docs: DataFrame, weights: tuple[int, ...], share: Fraction, repeats: int) -> DataFrame:
    """Documents equal in source, id and text are a unit of `n` rows. Adds `times`: how often
    the rows of the unit are taken, together."""
    rows = docs.select("doc_id", "source", _words(F.col("text")).alias("size"),
                       text_hash(F.col("text")).alias("hash"))
    units = stage(rows.groupBy("source", "doc_id", "hash", "size").agg(
        F.count(F.lit(1)).alias("n")), "mix-units")
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = stage(targets(stage(sizes, "source-sizes"), weights, share, repeats), "targets")
    named = wanted.withColumnRenamed("source", "_source")
    units = units.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Without words there is nothing to take; such documents are in the mix as they are.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    units = units.withColumn("_want", rate * F.col("n"))
    units = units.withColumn("_whole", F.floor("_want"))
    units = units.withColumn("_part", F.col("_want") - F.col("_whole"))
    own = ["doc_id", "hash", "size", "n", "source_size", "target", "_whole"]
    units = stage(units.select("source", *own, "_part"), "mix-wanted")
    open_ = (F.col("_part") > 0) & (F.col("size") > 0)
    found = rounded(units.where(open_).withColumns({
        "room": F.col("size").cast("double"), "mass": F.col("size") * F.col("_part")}), own)
    sure = units.where(~open_).select("source", F.struct(*own).alias("unit"),
                                      F.lit(0).alias("up"))
    return found.union(sure).select(
        "source", "unit.*", "up").withColumn("times", F.col("_whole") + F.col("up")).drop(
            "_whole", "up")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
        repeats: int = REPEATS) -> DataFrame:
    """One row per document: `source`, `doc_id`, `size`, `source_size`, `target`, `copies`,
    `taken`.

    A document's `size` is its number of words, runs of anything but blanks. Sources in order of
    their names (code points, null last) get `weights` in turn; see `targets`. A source wants
    each of its documents target / source_size times: the whole part is taken, the rest is
    rounded by `rounded`, so that the words taken of a source miss its target by less than one
    document, a small one where small ones hold enough words, and every document is taken in
    expectation as often as wanted.

    Null texts and texts of blanks have no words; a null source is a source. Rows equal in
    source, id and text are taken as one unit and share its copies evenly. Draws depend on ids
    and texts alone, so a rerun gives the same mix whatever the partitions. No rows give no rows.
    Columns other than `doc_id`, `source` and `text` are not read.
    """
    units = _units(docs, weights, share, repeats)
    each, extra = F.expr("times div n"), F.expr("times % n")
    units = units.withColumn("_rows", F.explode(F.filter(F.array(
        F.struct((each + 1).alias("copies"), extra.alias("n")),
        F.struct(each.alias("copies"), (F.col("n") - extra).alias("n"))),
        lambda r: r["n"] > 0)))
    # A unit of very many rows is written by many tasks.
    parts = units.select("source", "doc_id", "hash", "size", "source_size", "target",
                         "_rows.copies", F.col("_rows.n").alias("_n"),
                         F.explode(F.expr(f"sequence(0L, (_rows.n - 1) div {CHUNK})")).alias("_k"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(width, "hash", "doc_id", "_k")
    parts = parts.withColumn("_row", F.explode(F.expr(
        f"sequence(1L, least({CHUNK}L, _n - _k * {CHUNK}))")))
    return parts.select("source", "doc_id", "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
          repeats: int = REPEATS) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken. See `mix`."""
    units = _units(docs, weights, share, repeats).select(
        F.col("source").alias("_source"), F.col("doc_id").alias("_doc"),
        F.col("hash").alias("_hash2"), "n", "times")
    units = stage(units.where("times > 0"), "mix-times").withColumnsRenamed(
        {"n": "_n", "times": "_times"})
    rows = docs.withColumn("_hash", text_hash(F.col("text")))
    same = (F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_hash2"))
            & F.col("doc_id").eqNullSafe(F.col("_doc")))
    found = rows.join(units, same)
    whole = found.withColumn("_copy", F.explode(F.expr(
        "filter(sequence(0L, _times div _n), i -> i > 0)")))
    # What is left over once every equal row has its share comes from the first of them.
    rest = found.where("_times % _n > 0").dropDuplicates(["_source", "_doc", "_hash"])
    rest = rest.withColumn("_copy", F.explode(F.expr("sequence(1L, _times % _n)")))
    return without(whole.union(rest), "_hash", "_hash2", "_source", "_doc", "_n", "_times", "_copy")
