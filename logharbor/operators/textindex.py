"""A term index: which documents hold a word, and where, read by bucket instead of by scanning texts.

    <path>/bucket=<hash of the term mod buckets>/*.parquet      (term, id, deltas), sorted by term and id

A posting is a term of a document with its positions, each as the distance to the one before (the first from -1), so that small
numbers are stored. A search names the buckets of its terms, which prunes folders, and the terms, which prunes row groups inside.
Words are what ``match_any_term`` takes for words: runs of letters, digits and underscores, lower-cased.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators.filters import query_terms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of an index unless given.
BUCKETS = 64
#: Documents that are inverted at once.
SLICE_ROWS = 512
#: Shares of the ids that a bucket's postings are dealt by.
SHARES = 16
#: What stands between words.
NO_WORD = r"[^\p{L}\p{N}_]+"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(term, id, deltas) of every term of every document. A row's text has all positions of its terms, so rows are not
    brought together; rows of one id have postings of their own."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield _inverted(batch.slice(at, SLICE_ROWS))

    words = F.filter(F.split(F.lower(F.col(text)), NO_WORD), lambda w: w != "")
    kind = docs.schema[ident].dataType.simpleString()
    each = docs.select(F.col(ident).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    return each.mapInArrow(run, f"term STRING, id {kind}, deltas ARRAY<INT>")


def _inverted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (id, words) as rows (term, id, deltas)."""
    lists = batch.column("words")
    counts = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    # By term, as like rows in a row shrink the shuffle. Stable, so that positions of one term of one row stay in order.
    order = np.argsort(code.astype(np.int64) * batch.num_rows + row, kind="stable")
    row, code, at = row[order], code[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    before = np.roll(at, 1)
    before[new] = -1
    starts = np.flatnonzero(new)
    offsets = pa.array(np.append(starts, len(row)), pa.int32())
    deltas = pa.ListArray.from_arrays(offsets, pa.array(at - before, pa.int32()))
    columns = [words.dictionary.take(pa.array(code[starts])), batch.column("id").take(pa.array(row[starts])), deltas]
    return pa.RecordBatch.from_arrays(columns, names=["term", "id", "deltas"])


def build_index(docs: DataFrame, path: str, ident: str, text: str, buckets: int = BUCKETS) -> None:
    """Write the index of a table of documents. Postings are dealt by bucket and one of SHARES shares of the ids, so that a word
    which most documents have is spread, and texts are gone through once, not sampled before."""
    rows = postings(docs, ident, text).withColumn("bucket", _bucket(F.col("term"), buckets))
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
    dealt = rows.repartition("bucket", share).sortWithinPartitions("bucket", "term", "id")
    dealt.write.partitionBy("bucket").parquet(path)
    dealt.sparkSession.createDataFrame([(buckets,)], "buckets INT").coalesce(1).write.json(f"{path}-layout")


def _asked(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """The postings of some terms; other buckets are not opened."""
    buckets = spark.read.schema("buckets INT").json(f"{path}-layout").first()[0]
    named = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    wanted = sorted({r[0] for r in named.select(_bucket(F.col("term"), buckets)).collect()})
    index = spark.read.parquet(path)
    return index.filter(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))


def search_any(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The ids of documents that hold any word of the query, and how many of its words they hold."""
    terms = query_terms(query)
    if not terms:
        return spark.read.parquet(path).limit(0).select("id", F.lit(0).alias("hits"))
    return _asked(spark, path, terms).groupBy("id").agg(F.count_distinct("term").cast("int").alias("hits"))


def search_phrase(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """(id, times): documents that hold the words of a phrase one after the other, and how often.

    The k-th word's positions less k meet in one number for each occurrence. Lists of them meet by document, not each
    position by itself.
    """
    words = [w for w in re.split(r"[^\w]+", phrase.lower()) if w]
    if not words:
        return spark.read.parquet(path).limit(0).select("id", F.lit(0).alias("times"))
    places = {w: [k for k, x in enumerate(words) if x == w] for w in dict.fromkeys(words)}
    offsets = spark.createDataFrame([(w, k) for w, ks in places.items() for k in ks], "term STRING, k INT")
    held = with_positions(_asked(spark, path, list(places)))
    starts = F.transform("at", lambda p: p - F.col("k")).alias("starts")
    # A list for each word of the phrase; they are folded into those that all have.
    met = held.join(offsets, "term").select("id", "k", starts).groupBy("id", "k").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    met = met.groupBy("id").agg(F.collect_list("starts").alias("lists")).filter(F.size("lists") == len(words))
    shared = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    return met.select("id", F.size(F.array_distinct(shared)).alias("times")).filter("times > 0")


def with_positions(held: DataFrame) -> DataFrame:
    """(term, id, at) of postings: deltas summed up, a batch of lists at once."""

    def run(batches):
        for batch in batches:
            lists = batch.column("deltas")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = np.concatenate(([0], np.cumsum(lists.flatten().to_numpy(), dtype=np.int64)))
            # Each list starts from -1.
            at = sums[1:] - np.repeat(sums[offsets[:-1]], np.diff(offsets)) - 1
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("id"), column], names=["term", "id", "at"])

    kind = held.schema["id"].dataType.simpleString()
    return held.select("term", "id", "deltas").mapInArrow(run, f"term STRING, id {kind}, at ARRAY<INT>")
