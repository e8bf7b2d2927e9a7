"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm import (
    chat,
    decontaminate,
    lengths,
    licenses,
    pii,
    piecebpe,
    quality,
    reshard,
    runs,
    simhash,
    tokenfile,
    trie,
    winnowing,
)
from logharbor.llm.common import documents
from logharbor.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 old shards by source, very unequal ones, to 24 of equal bytes."""
    old = F.pmod(F.xxhash64("source"), F.lit(16))
    rows = reshard.reshard_documents(documents(spark, sf_dir), old, 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir))
    counts = [F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    base = F.sha2(pii.spelled("base"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.spelled("spans").alias("spans"))


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.edited_documents(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest(F.col("codes")).alias("fingerprint"),
        winnowing.digest(F.col("edited_codes")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = lengths.token_lengths(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return lengths.suffix_sums(lengths.histogram(encoded))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_index(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rebuilt with up to eight first turns of the one that its group of five begins with."""
    conv = F.col("conv_id")
    turns = trie.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.trie(*trie.shared_heads(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8))


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of two turns full of control strings."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    rows = chat.format_conversations(given.unionByName(more))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*chat.TRAINED)), lambda t: t["text"]), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with a period planted into their ends."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    start, period = g % F.col("_n"), 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))
    found = runs.with_runs(runs.with_planted_period(docs, h % 10 == 0, start, period))
    rows = found.withColumn("_best", runs.strongest(F.col("runs")))
    best = {c: F.col(f"_best.{c}") for c in ("start", "length", "period")}
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[v.alias(c) for c, v in best.items()],
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(runs.spelled(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
