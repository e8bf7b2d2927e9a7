"""Request limiter with a fixed window that opens at a key's first request.

A window opens at the first request after the previous window has expired and
lasts ``expire`` seconds. The first ``limit`` requests inside it are accepted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logharbor.operators.ranking import rank_within
from logharbor.session import cut, load, save

# Python workers get the stateful processor by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# A span is searched in this many slots, so that a busy key is cut finer than one window.
SLOTS_PER_SPAN = 64


def _next_window(points: DataFrame, key: str, span: int) -> DataFrame:
    """For each request time the first request time at least ``span`` later, per key.

    Time is cut into slots. The answer is in the slot of time + span or is the
    first request of a later slot, so no task sees more of a key than one slot
    and the list of its slots.
    """
    slot = F.floor(F.col("at") / max(span // SLOTS_PER_SPAN, 1))
    none = F.lit(None).cast("bigint")
    probes = points.select(key, F.col("at").alias("source"), (F.col("at") + span).alias("at"), none.alias("point"))
    targets = points.select(key, none.alias("source"), "at", F.col("at").alias("point"))
    both = probes.unionByName(targets).withColumn("slot", slot)
    # Backwards in time, with the request itself in front of a probe at the same instant.
    back = Window.partitionBy(key, "slot").orderBy(F.desc("at"), F.desc_nulls_last("point"))
    inside = both.withColumn(
        "inside", F.last("point", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    ).filter("source IS NOT NULL")

    slots = both.groupBy(key, "slot").agg(F.min("point").alias("first"))
    later = Window.partitionBy(key).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    following = slots.select(key, "slot", F.last("first", ignorenulls=True).over(later).alias("following"))
    return inside.join(following, [key, "slot"]).select(
        key, F.col("source").alias("at"), F.coalesce("inside", "following").alias("next")
    )


def _piece_starts(points: DataFrame, key: str, span: int) -> DataFrame:
    """Request times with a silence of at least ``span`` before them: a window opens at each of them."""
    rows = points.withColumn("slot", F.floor(F.col("at") / max(span // SLOTS_PER_SPAN, 1)))
    near = F.lag("at").over(Window.partitionBy(key, "slot").orderBy("at"))
    slots = rows.groupBy(key, "slot").agg(F.max("at").alias("last"))
    far = slots.select(key, "slot", F.lag("last").over(Window.partitionBy(key).orderBy("slot")).alias("before"))
    before = F.coalesce("near", "before")
    return (
        rows.withColumn("near", near)
        .join(far, [key, "slot"])
        .filter(before.isNull() | (F.col("at") - before >= span))
        .select(key, "at")
    )


def window_starts(requests: DataFrame, key: str, at: str, span: int) -> DataFrame:
    """The window starts (key, at) of every key. Times are whole numbers, e.g. microseconds.

    Behind a silence of one span a window opens whatever came before, so requests fall into pieces that
    do not depend on each other. The starts of a piece are the orbit of its first request under "next
    window"; following all of them at once by doubling takes about log2(windows per piece) rounds of equi-joins.
    """
    spark = requests.sparkSession
    points = cut(requests.select(key, F.col(at).alias("at")).distinct())
    first = cut(_piece_starts(points, key, span))
    # A step into the next piece ends at its start, which is known already.
    steps = _next_window(points, key, span).filter("next IS NOT NULL")
    jump = cut(steps.join(first.select(key, F.col("at").alias("next")), [key, "next"], "left_anti"))
    schema, written = first.schema, [save(first)]
    while True:
        starts = load(spark, schema, *written)
        reached = save(starts.join(jump, [key, "at"]).select(key, F.col("next").alias("at")))
        if load(spark, schema, reached).isEmpty():
            return starts
        written.append(reached)
        hop = jump.select(key, F.col("at").alias("next"), F.col("next").alias("_to"))
        jump = cut(jump.join(hop, [key, "next"]).select(key, "at", F.col("_to").alias("next")))


def limit_requests(
    requests: DataFrame, key: str, at: Column, ident: str, limit: int, expire: float
) -> DataFrame:
    """Add ``window_start`` and ``accepted`` to every request; ties in time go by ident."""
    span = int(expire * 1_000_000)
    rows = requests.withColumn("_at", at).withColumn("_slot", F.floor(F.col("_at") / span))
    starts = window_starts(rows, key, "_at", span).select(
        key, F.col("at").alias("_start"), F.floor(F.col("at") / span).alias("_slot")
    )
    # A slot is one span long, so it holds at most one start per key.
    here = starts.withColumnRenamed("_start", "_here")
    before = starts.select(key, F.col("_start").alias("_before"), (F.col("_slot") + 1).alias("_slot"))
    placed = rows.join(here, [key, "_slot"], "left").join(before, [key, "_slot"], "left").withColumn(
        "window_start", F.when(F.col("_here") <= F.col("_at"), F.col("_here")).otherwise(F.col("_before"))
    )
    placed = cut(placed.select(*requests.columns, "_at", "window_start"))
    quota = max(limit, 1)
    window = [key, "window_start"]
    # Only windows with more requests than the quota need an order.
    crowded = placed.groupBy(*window).agg(F.count("*").alias("_n")).filter(F.col("_n") > quota).select(*window)
    contested = placed.join(crowded, window, "left_semi").select(*window, "_at", ident)
    last = (
        rank_within(contested, window, ["_at", ident], "_rank")
        .filter(F.col("_rank") == quota)
        .select(*window, F.struct("_at", ident).alias("_last"))
    )
    return placed.join(last, window, "left").select(
        *requests.columns,
        "window_start",
        F.coalesce(F.struct("_at", ident) <= F.col("_last"), F.lit(True)).alias("accepted"),
    )


class Limiter(StatefulProcessor):
    """Streaming form: the open window and its count are the state of a key, kept until the watermark passes the window's end."""

    def __init__(self, limit: int, expire: float):
        self.limit = max(limit, 1)
        self.span = int(expire * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState(
            "window",
            T.StructType([T.StructField("start", T.LongType()), T.StructField("taken", T.LongType())]),
        )

    def _over(self, start: int) -> int:
        """The millisecond of event time from which a window is over for good; event time is one ahead of requests."""
        return -(-(start + self.span) // 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A key's requests of one micro-batch, which the trigger bounds; one step per window, not per row.
        batch = pd.concat(list(rows)).sort_values(["at", "ident"])
        at, n = batch["at"].to_numpy(), len(batch)
        starts, ranks = np.zeros(n, np.int64), np.zeros(n, np.int64)
        start, taken = self.window.get() if self.window.exists() else (None, 0)
        held, begin = start, 0
        while begin < n:
            if start is None or at[begin] >= start + self.span:
                start, taken = int(at[begin]), 0
            end = max(begin + 1, int(np.searchsorted(at, start + self.span)))
            starts[begin:end] = start
            ranks[begin:end] = taken + np.arange(end - begin)
            taken, begin = min(self.limit, taken + end - begin), end
        self.window.update((start, int(taken)))
        if held != start:
            if held is not None:
                self.handle.deleteTimer(self._over(held))
            self.handle.registerTimer(self._over(start))
        yield pd.DataFrame(
            {
                "key": batch["key"].to_numpy(),
                "ident": batch["ident"].to_numpy(),
                "window_start": starts,
                "accepted": ranks < self.limit,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No request inside the window can arrive any more; the next one opens a new window in any case.
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, limit: int, expire: float, delay_millis: int = 0) -> DataFrame:
    """Limiter over a stream of (key, at in microseconds since 1970, ident); needs the RocksDB state store.

    Requests of a micro-batch are taken in order of (at, ident), micro-batches as they come. A request more than
    ``delay_millis`` older than the newest one of the micro-batches before is late and lost. A key's state goes when the
    watermark has passed the end of its window, so only keys with an open window have any.
    """
    kinds = dict(stream.dtypes)
    # Spark takes a row at the watermark for late: a millisecond on either side keeps requests of one instant together.
    event_time = F.timestamp_micros(F.col("at") + 1000).alias("event_time")
    timed = stream.select("key", "at", "ident", event_time).withWatermark("event_time", f"{delay_millis + 1} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, expire),
        outputStructType=T.StructType.fromDDL(
            f"key {kinds['key']}, ident {kinds['ident']}, window_start BIGINT, accepted BOOLEAN"
        ),
        outputMode="append",
        timeMode="eventTime",
    )
