"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are encoded once and only their lengths are kept: a row per distinct length, summed before and after the
shuffle. Suffix sums over the lengths (in two levels, so that no task sees all of them) then hold every answer:

* at least n tokens: ``docs_from``, ``tokens_from``;
* tokens left when every document is cut at n: ``truncated`` = tokens of shorter documents + n * docs_from;
* quantiles: the length of the document of any rank.

Results: null and empty texts have length 0; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import cut, kept, read_bytes, small_slices, texts
from logharbor.llm.tokenfile import WordEncoder

#: Lengths per block of the two-level sums.
BLOCK = 4096


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    source = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))

    def run(batches):
        key = ("tokenfile", hashlib.sha256(source.value).digest())
        encoder = kept(key, lambda: WordEncoder(source.value))
        for batch in small_slices(batches):
            counts = [len(ids) // 4 for ids in encoder.encode(batch.column("text").to_pylist())]
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs): how many documents have each length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with ``docs_from`` and ``tokens_from`` (this length or more), ``docs_to`` (this length or less)
    and ``truncated`` (all tokens left when documents are cut at this length)."""
    hist = cut(hist)  # used twice, and made from all documents
    rows = hist.withColumn("_tokens", F.col("n_tokens") * F.col("docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    # A row for each BLOCK lengths that occur.
    above = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(every).alias("_docs"),
        F.sum("_t").over(every).alias("_all"),
    )
    inside = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    docs_from = F.sum("docs").over(inside) + F.col("_docs_above")
    tokens_from = F.sum("_tokens").over(inside) + F.col("_tokens_above")
    return (
        rows.join(blocks, "_block")
        .withColumn("docs_from", docs_from)
        .withColumn("tokens_from", tokens_from)
        .select(
            "n_tokens",
            "docs",
            "docs_from",
            "tokens_from",
            (F.col("_docs") - F.col("docs_from") + F.col("docs")).alias("docs_to"),
            (F.col("_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated"),
        )
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_cut, truncated) for any context limits, occurring lengths or not; docs_cut are longer than limit.

    Both follow from the shortest length above the limit: below it ``truncated`` falls by docs_from for each token.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit bigint")
    total = sums.agg(F.coalesce(F.max("truncated"), F.lit(0)).alias("_total"))
    longer = asked.join(sums, F.col("n_tokens") > F.col("limit")).groupBy("limit").agg(
        F.min(F.struct("n_tokens", "docs_from", "truncated")).alias("_next")
    )
    after = F.col("_next.truncated") - (F.col("_next.n_tokens") - F.col("limit")) * F.col("_next.docs_from")
    # ``total`` is one row.
    return asked.distinct().join(longer, "limit", "left").join(total, F.lit(True)).select(
        "limit",
        F.coalesce("_next.docs_from", F.lit(0)).alias("docs_cut"),
        F.coalesce(after, "_total").alias("truncated"),
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    docs = F.col("docs_to") + F.col("docs_from") - F.col("docs")
    return asked.join(sums, F.col("docs_to") >= F.ceil(F.col("share") * docs)).groupBy("share").agg(
        F.min("n_tokens").alias("n_tokens")
    )
