"""One registered query for each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.llm import (
    chat, codes, decontam, jaccard, language, lines, mixing, packing, phrases, shards, spots,
    substrings, urls,
)
from vidlake.session import stage

TOKENIZER = "byte_bpe_50k.json"

URL_RULES = [urls.host_rule(v, p) for v, p in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"))]

TOOLS = {
    "search": (chat.Argument("text", "string"), chat.Argument("turn", "integer"),
               chat.Argument("after", "string", required=False)),
    "lookup": (chat.Argument("text", "string"), chat.Argument("after", "string")),
    "count": (chat.Argument("turn", "number"),),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.fitted(language.sample(docs))
    return language.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.spans(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer of an assistant stands for a tool call with its whole text as an argument, the
    next turn of the user for its result. Calls need the one two turns before, but every fourth
    one begins anew; the third tool lacks arguments that are given, so its calls are invalid."""
    turns = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]),
                        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    own = F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("turn"))
    last = F.concat(F.lit("$call_"), F.col("conv_id"), F.lit("_"), F.col("turn") - 2)
    arguments = F.to_json(F.struct(
        F.when((F.col("turn") >= 2) & (F.pmod(F.expr("turn div 2"), F.lit(4)) != 0), last)
        .alias("after"), "text", "turn"))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", own.alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'user' and turn > 0").select(
        "conv_id", "turn", F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"),
                                    F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"))
    found = chat.linked(calls, results, TOOLS)
    return found.select("conv_id", "call_id", "turn", F.col("depth").cast("long").alias("depth"),
                        "status", F.array_join("problems", "; ").alias("problems"),
                        F.sha2("json", 256).alias("json_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spots.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    found = codes.with_label_error(stage(coded, "vector-codes"))
    return found.select("vec_id", "code", "error", "label_error",
                        F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_packing, op2_language, op3_decontamination, op4_substring_dedup, op5_jaccard_join,
        op6_tool_calls, op7_line_dedup, op8_url_filter, op9_spot_signatures, op10_byte_shards,
        op11_phrase_mining, op12_vector_codes, op13_source_mix)}
