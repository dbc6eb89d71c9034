"""Lines that several documents share are kept in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.llm.columns import BLANKS, known_id, lower_ascii, text_hash, without
from vidlake.session import stage

MIN_KEY = 10


def drop_shared_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """`docs` with `text` cut down to the lines that stay, and `n_lines`, `n_dropped`.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at
    least `min_key` characters that occur in two documents or more lose their lines in all but
    the smallest `doc_id`; within that document all of them stay.

    Lines are exploded once, with 128 bits of hash for each key, into a narrow staged table.
    Documents are counted per hash by their least and largest id, so that a key of a third of
    all documents is summed before it is shuffled; the join back onto hot keys is one that
    adaptive execution splits. Each document then gets its dropped positions, and its text is
    put together from the slices between them.

    Null and empty texts are one empty line and stay as they are. A null `doc_id` counts as the
    largest. Rows with equal id are one document: they never make a line shared. No rows give no
    rows. Other columns pass through; input columns called like a result are replaced.
    """
    rows = without(docs, "n_lines", "n_dropped").withColumns({
        "_id": known_id(), "_th": text_hash(F.col("text"))})
    keyed = rows.select("_id", "_th", F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    keyed = keyed.select("_id", "_th", "_pos",
                         lower_ascii(F.btrim("_line", F.lit(BLANKS))).alias("_key"))
    keyed = keyed.where(F.char_length("_key") >= min_key)
    lines = stage(keyed.select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h"),
                               F.xxhash64(F.lit("second"), "_key").alias("_g")), "lines")
    shared = lines.groupBy("_h", "_g").agg(F.min("_id").alias("_first"),
                                           F.max("_id").alias("_last"))
    # A staged side has its own exchange below the join, which lets a hot key be split.
    shared = stage(shared.where("_first < _last").select("_h", "_g", "_first"), "shared-lines")
    dropped = (lines.join(shared, ["_h", "_g"]).where("_id > _first")
               .groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_pos")).alias("_drop")))
    out = rows.join(dropped, ["_id", "_th"], "left").withColumns({
        "_drop": F.coalesce("_drop", F.array().cast("array<int>")),
        "_lines": F.split(F.coalesce("text", F.lit("")), "\n")})
    kept = F.expr("""
        array_join(flatten(transform(sequence(0, size(_drop)), i -> slice(_lines,
            if(i = 0, 1, get(_drop, i - 1) + 2),
            if(i = size(_drop), size(_lines), get(_drop, i))
                - if(i = 0, 0, get(_drop, i - 1) + 1)))), '\n')""")
    out = out.withColumns({
        "n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_drop").cast("long"),
        "text": F.when(F.size("_drop") > 0, kept).otherwise(F.col("text"))})
    return out.drop("_id", "_th", "_drop", "_lines")
