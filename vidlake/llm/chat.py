"""Tool calls of conversations, linked with their results, ordered, checked and written as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidlake.session import ROW_ID, stage

#: A text argument that begins so names a call of the same conversation whose result it needs.
REFERENCE = "$"


@dataclass(frozen=True)
class Argument:
    """`kind`: string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True


#: How Spark names the types of values in JSON.
_KINDS = {
    "string": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))",
    "number": "^(BIGINT|DECIMAL|DOUBLE)", "boolean": "^BOOLEAN", "array": "^ARRAY",
    "object": "^OBJECT",
}


def problems_of(arguments: Column, name: Column,
                schemas: dict[str, tuple[Argument, ...]]) -> Column:
    """What is wrong with a call's arguments (a variant, null if they are no JSON), as sorted
    texts. Arguments that the schema does not name are problems, too."""
    def one(a: Argument) -> Column:
        value = F.variant_get(arguments, f"$.{a.name}", "variant")
        kind = F.schema_of_variant(value)
        lacks = value.isNull() | (kind == "VOID")
        wrong = ~lacks & ~kind.rlike(_KINDS[a.kind])
        missing = F.lit(f"missing {a.name}") if a.required else F.lit(None).cast("string")
        return F.when(wrong, F.lit(f"{a.name} is no {a.kind}")).when(lacks, missing)

    keys = F.map_keys(F.try_variant_get(arguments, "$", "map<string, variant>"))
    checked = F.array(F.lit("unknown tool"))
    for tool, known in schemas.items():
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(a.name) for a in known])
                                           .cast("array<string>")),
                            lambda k: F.concat(F.lit("unknown "), k))
        found = F.concat(F.array_compact(F.array(*[one(a) for a in known]).cast("array<string>")),
                         F.coalesce(extra, F.array().cast("array<string>")))
        checked = F.when(name == tool, found).otherwise(checked)
    is_object = F.schema_of_variant(arguments).startswith("OBJECT")
    return F.array_sort(F.when(F.coalesce(is_object, F.lit(False)), checked).otherwise(
        F.array(F.lit("arguments are no object"))))


def linked(calls: DataFrame, results: DataFrame,
           schemas: dict[str, tuple[Argument, ...]]) -> DataFrame:
    """One row per call, and per result without one: `conv_id`, `call_id`, `turn`, `depth`,
    `status`, `problems`, `json`. Ordered by (`conv_id`, `depth`, `turn`, `call_id`), every call
    comes after those whose results it needs.

    `calls`: `conv_id, turn, call_id, name, arguments` (JSON); `results`: `conv_id, turn,
    call_id, content`. Rows equal in all these columns count once. The calls of one conversation
    and identifier are numbered by turn (then name and arguments), so are its results (then
    content), and calls meet their results in a join on conversation, identifier and number,
    which no long conversation can make uneven; only rows of one identifier are sorted together.

    A need names the latest call of its identifier before the call's own turn; if there is none,
    the first one. `depth` is 0 for calls that need no other one, else one more than the deepest
    they need; it is found in rounds, each placing all calls whose needs are placed, so there are
    as many rounds as the longest chain has calls. Calls in or behind a circle have no depth.

    `status`: `duplicate` for a result whose number no call has, unless it is the first of its
    identifier, which is an `orphan`; for calls `circular`, else `invalid` if there are problems
    (see `problems_of`; needs that no call has are among them), else without a result `duplicate`
    if an earlier call has its identifier and `open` if not, else `done`. `json` is canonical:
    keys sorted, no spaces.

    Null identifiers: a call or result without conversation or identifier has no number, meets
    no result, is named by no need, and is a row of its own (`open`, `invalid`, `circular` or `orphan`).
    No rows give no rows. Further columns are not read.
    """
    keys = ["conv_id", "call_id"]
    call, loose_calls = _numbered(calls, "c", "turn", "name", "arguments")
    result, loose_results = _numbered(results, "r", "turn", "content")
    both = call.join(result, [*keys, "number"], "full").unionByName(
        loose_calls, allowMissingColumns=True).unionByName(
        loose_results, allowMissingColumns=True)
    arguments = F.try_parse_json(F.col("c.arguments"))
    named = F.try_variant_get(arguments, "$", "map<string, string>")
    both = both.withColumns({
        "called": F.col("c").isNotNull(), "arguments": arguments,
        "needs": F.when(F.col("c").isNotNull(), F.transform(
            F.filter(F.map_values(named), lambda v: v.startswith(REFERENCE)),
            lambda v: v.substr(F.lit(len(REFERENCE) + 1), F.length(v))))})
    both = both.withColumn("problems", F.when(F.col("called"), problems_of(
        F.col("arguments"), F.col("c.name"), schemas)))
    both = stage(both, "tool-calls", row_id=True)
    called = both.where("called").select(
        ROW_ID, *keys, "number", F.col("c.turn").alias("_turn"), "needs")
    asks = called.select(ROW_ID, "conv_id", F.explode(F.array_distinct("needs")).alias("need"),
                         "_turn", F.lit(None).cast("int").alias("number"))
    known = called.where("number is not null").select(
        ROW_ID, "conv_id", F.col("call_id").alias("need"), "_turn", "number")
    # Needs and calls of an identifier in order; a need comes before calls of its own turn.
    place = Window.partitionBy("conv_id", "need").orderBy("_turn", "number")
    held_by = F.when(F.col("number").isNotNull(), F.col(ROW_ID))
    asks = asks.unionByName(known).withColumn("need_row", F.coalesce(
        F.last(held_by, True).over(place.rowsBetween(
            Window.unboundedPreceding, Window.currentRow)),
        F.first(held_by, True).over(place.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))).where("number is null")
    asks = stage(asks.select(ROW_ID, "need", "need_row"), "needs")
    edges = asks.where("need_row is not null")
    lost = asks.where("need_row is null").groupBy(ROW_ID).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("no call "), "need"))).alias("lost"))

    # Only calls with needs go through the rounds; all others are at depth 0.
    waiting, placed, depth = edges.select(ROW_ID).distinct(), None, 0
    while True:
        waiting = stage(waiting, "waiting")
        held = edges.join(waiting.select(F.col(ROW_ID).alias("need_row")), "need_row",
                          "left_semi").select(ROW_ID).distinct()
        held = stage(held.join(waiting, ROW_ID, "left_semi"), "held")
        depth += 1
        ready = waiting.join(held, ROW_ID, "left_anti").withColumn("depth", F.lit(depth))
        ready = stage(ready, "ready")
        placed = ready if placed is None else placed.union(ready)
        if ready.isEmpty():
            break
        waiting = held
    circular = waiting.withColumn("depth", F.lit(-1))
    out = both.join(placed.union(circular), ROW_ID, "left").join(lost, ROW_ID, "left")
    out = out.withColumns({
        "problems": F.concat("problems", F.coalesce("lost", F.array().cast("array<string>"))),
        "depth": F.when(F.col("called") & (F.coalesce("depth", F.lit(0)) >= 0),
                        F.coalesce("depth", F.lit(0)))})
    again = F.coalesce(F.col("number") > 1, F.lit(False))
    status = (F.when(~F.col("called"), F.when(again, "duplicate").otherwise("orphan"))
              .when(F.col("depth").isNull(), "circular")
              .when(F.size("problems") > 0, "invalid")
              .when(F.col("r").isNull(), F.when(again, "duplicate").otherwise("open"))
              .otherwise("done"))
    out = out.withColumn("status", status).withColumn("problems", F.coalesce(
        "problems", F.array().cast("array<string>")))
    shown = F.when(F.col("arguments").isNotNull(), F.to_json("arguments"))
    fields = {  # in the order of their names
        "arguments": F.coalesce(shown, _quoted(F.col("c.arguments"))),
        "depth": F.coalesce(F.col("depth").cast("string"), F.lit("null")),
        "id": _quoted(F.col("call_id")), "name": _quoted(F.col("c.name")),
        "problems": F.to_json("problems"), "result": _quoted(F.col("r.content")),
        "status": _quoted(F.col("status")),
    }
    json = F.concat(F.lit("{"), F.concat_ws(",", *[
        F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))
    return out.select("conv_id", "call_id", F.coalesce("c.turn", "r.turn").alias("turn"),
                      "depth", "status", "problems", json.alias("json"))


def _numbered(rows: DataFrame, name: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Different rows with `fields` as a struct: those with both identifiers, numbered from 1 on
    in each, and those without."""
    keys = ["conv_id", "call_id"]
    rows = rows.select(*keys, F.struct(*fields).alias(name))
    has = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    known = rows.where(has).withColumn(
        "number", F.dense_rank().over(Window.partitionBy(*keys).orderBy(name)))
    return known.dropDuplicates([*keys, "number"]), rows.where(~has).distinct()


def _quoted(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    inside = F.to_json(F.array(text.cast("string")))
    return F.coalesce(inside.substr(F.lit(2), F.length(inside) - 2), F.lit("null"))
