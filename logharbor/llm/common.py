"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logharbor.session import cut, load, save, scratch  # noqa: F401

#: Rows handled at once inside a worker; bounds memory when texts are long.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row; a null text reads as empty, all other columns are left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def extended(schema: StructType, ddl: str) -> StructType:
    """schema with further fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def kept(key: tuple, make: Callable):
    """What make() returns, built once per Python worker process and kept for its later tasks."""
    name = "_logharbor_llm_kept"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class WordCache:
    """Values by word, in two generations: the older half is dropped when the newer one is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size // 2, {}, {}

    def get(self, word: str):
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is not None:
                self.put(word, found)
        return found

    def put(self, word: str, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[word] = value


def small_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most SLICE_ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read where the driver runs; its content is what travels to the workers."""
    with open(path, "rb") as file:
        return file.read()
