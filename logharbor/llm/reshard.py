"""Resharding with the fewest bytes moved.

Rows live in old shards. New shards have capacities. Bytes that stay cost nothing, bytes that change shards cost one
each, so how much goes where is a minimum-cost flow from the old shards' sizes to the new shards' capacities. The flow
is solved on shard totals and laid over blocks, pieces of an old shard of about sqrt(rows) rows each, so that both the
number of blocks and the rows of one stay small: blocks move whole, and only the rows of blocks in which an amount
ends (as many as old and new shards together at most) are dealt one by one, largest first, to the shard of the block
that lacks most. What the rows' sizes leave uneven is evened out by single rows that move beside the flow.

Shards are folders ``shard=N`` of a Parquet table. Shards that give and take nothing keep their files; the others are
written anew under another root.

Results: a null text counts ROW_BYTES and stays null; a null doc_id is an ordinary value; repeated rows are placed one
by one; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor.llm.common import scratch

#: Bytes a row takes besides its text.
ROW_BYTES = 8
LAYOUT = "doc_id bigint, text string, size bigint, text_crc32 bigint, slot bigint, shard int"


def row_size(text: str = "text"):
    """UTF-8 bytes of the text, none for null, and ROW_BYTES."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Amounts from old to new shards, all supply placed, the fewest units between different shards.

    Successive shortest paths over the bipartite graph; costs are 0 (stay) and 1 (move), so a path is found by a
    search with a two-ended queue over residual edges, negative ones having been relaxed first.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("capacities are too small")
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = dict(supply), dict(capacity)
    for s in supply:  # what can stay stays: these paths cost nothing
        amount = min(left[s], room.get(s, 0))
        if amount:
            flow[s, s] = amount
            left[s] -= amount
            room[s] -= amount
    while any(left.values()):
        cost = {("s", s): 0 for s in supply if left[s]}
        came: dict[tuple[str, int], tuple[str, int] | None] = dict.fromkeys(cost)
        queue = deque(cost)
        while queue:
            node = queue.popleft()
            kind, k = node
            if kind == "s":
                steps = [(("t", t), 0 if t == k else 1) for t in capacity]
            else:
                steps = [(("s", s), 0 if s == k else -1) for s in supply if flow[s, k]]
            for other, price in steps:
                if cost[node] + price < cost.get(other, 1 << 60):
                    cost[other] = cost[node] + price
                    came[other] = node
                    queue.append(other)
        end = min((("t", t) for t in capacity if room[t] and ("t", t) in cost), key=lambda n: (cost[n], n))
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "t":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "s":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def plan(blocks: list[tuple[int, int, int, int]], capacity: dict[int, int]):
    """(amounts, whole, cut): the flow, the new shard of each block that moves whole, and the new shards among which
    the rows of each other block are dealt. blocks are (shard, block, bytes, rows)."""
    supply: dict[int, int] = defaultdict(int)
    for shard, _, size, _ in blocks:
        supply[shard] += size
    flow = min_cost_flow(dict(supply), capacity)
    whole: dict[tuple[int, int], int] = {}
    cut: dict[tuple[int, int], list[int]] = {}
    for shard in supply:
        # What stays comes first.
        amounts = sorted(((t, v) for (s, t), v in flow.items() if s == shard), key=lambda x: (x[0] != shard, x[0]))
        at, k, end = 0, 0, amounts[0][1]
        for _, block, size, _ in sorted(b for b in blocks if b[0] == shard):
            targets = [amounts[k][0]]
            at += size
            while at > end and k + 1 < len(amounts):
                k += 1
                end += amounts[k][1]
                targets.append(amounts[k][0])
            if len(targets) == 1:
                whole[shard, block] = targets[0]
            else:
                cut[shard, block] = targets
            if at == end and k + 1 < len(amounts):
                k += 1
                end += amounts[k][1]
    return flow, whole, cut


def deal(loose: list[tuple[int, int, int, int]], cut: dict, lack: dict[int, int]) -> dict[tuple[int, int, int], int]:
    """New shards of rows (shard, block, rank, size): largest first, each to the shard of its block that lacks most."""
    out = {}
    for shard, block, rank, size in sorted(loose, key=lambda r: (-r[3], r[:3])):
        target = max(cut[shard, block], key=lambda t: (lack[t], -t))
        out[shard, block, rank] = target
        lack[target] -= size
    return out


def even_out(dealt: dict[tuple[int, int, int], int], sizes: dict, lack: dict[int, int]) -> None:
    """Move single dealt rows to the shard that lacks most until no row evens the shards out; each move lessens the sum of
    squared differences, so it ends."""
    have: dict[int, list] = defaultdict(list)
    for row, target in dealt.items():
        insort(have[target], (sizes[row], row))
    while True:
        to, best = max(lack, key=lambda t: (lack[t], -t)), None
        for shard, rows in have.items():
            gap = lack[to] - lack[shard]
            at = bisect_left(rows, (gap / 2,))
            for size, row in rows[max(0, at - 1) : at + 1]:
                gain = size * (gap - size)
                if shard != to and gain > 0 and (best is None or gain > best[0]):
                    best = gain, shard, size, row
        if best is None:
            return
        _, shard, size, row = best
        have[shard].remove((size, row))
        insort(have[to], (size, row))
        dealt[row] = to
        lack[shard] += size
        lack[to] -= size


def write_layout(docs: DataFrame, path: str, shard) -> None:
    """docs at path, one folder for each value of the expression shard (an int)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", shard.cast("int").alias("shard"))
    rows.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)


def _blocked(spark: SparkSession, path: str) -> DataFrame:
    """The layout at path with sizes and blocks; a block is all rows of a shard whose hash says so."""
    rows = spark.read.schema("doc_id bigint, text string, shard int").parquet(path)
    rows = rows.withColumn("size", row_size()).withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    sizes = dict(rows.groupBy("shard").count().collect())
    n = max(1, math.isqrt(sum(sizes.values())))
    blocks = F.lit(1)
    for shard, count in sizes.items():
        blocks = F.when(F.col("shard") == shard, max(1, count // n)).otherwise(blocks)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), blocks).cast("int"))


def reshard(spark: SparkSession, old: str, new: str, shards: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Deal the rows of the layout at ``old`` to shards 0 to shards - 1 of near equal bytes.

    Returns the new layout (LAYOUT, read from its files; slot counts a shard's rows from 0 without gaps) and the
    amounts that the flow moves, by old and new shard. Changed shards are written at ``new``.
    """
    rows = _blocked(spark, old)
    counted = rows.groupBy("shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    blocks = [tuple(r) for r in counted.collect()]  # about sqrt(rows) of them
    total = sum(b[2] for b in blocks)
    capacity = even_capacities(total, shards)
    flow, whole, cut = plan(blocks, capacity)
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    lack = dict(capacity)
    for shard, block, size, _ in blocks:
        if (shard, block) in whole:
            lack[whole[shard, block]] -= size
    loose: list[tuple[int, int, int, int]] = []
    named = None
    if cut:
        # At most old + new shards blocks are cut, of about sqrt(rows) rows each: few enough names to broadcast.
        named = F.broadcast(spark.createDataFrame(sorted(cut), "shard int, block int"))
        narrow = rows.join(named, ["shard", "block"], "left_semi").select(
            "shard", "block", (F.row_number().over(order) - 1).alias("rank"), "size"
        )
        loose = [tuple(r) for r in narrow.collect()]
    dealt = deal(loose, cut, lack)
    even_out(dealt, {row[:3]: row[3] for row in loose}, lack)
    # Slots: whole blocks first, then single rows, each new shard in the order of old shard, block and rank.
    at: dict[int, int] = defaultdict(int)
    starts, single = [], []
    for shard, block, _, n in sorted(blocks):
        if (shard, block) in whole:
            target = whole[shard, block]
            starts.append((shard, block, target, at[target]))
            at[target] += n
    for (shard, block, rank), target in sorted(dealt.items()):
        single.append((shard, block, rank, target, at[target]))
        at[target] += 1
    starts = pd.DataFrame(starts, columns=["shard", "block", "to", "start"], dtype="int64")
    single = pd.DataFrame(single, columns=["shard", "block", "rank", "to", "slot"], dtype="int64")
    same = {t for t in capacity if all((s == t) == (u == t) for s, u in flow) and flow.get((t, t), 0)}
    ranked = rows if named is None else rows.join(named, ["shard", "block"], "left_anti")
    kept = ["doc_id", "text", "size", "text_crc32", F.col("slot"), F.col("to").cast("int").alias("shard")]
    placed = (
        ranked.withColumn("rank", F.row_number().over(order) - 1)
        .join(spark.createDataFrame(starts, "shard bigint, block bigint, to bigint, start bigint"), ["shard", "block"])
        .withColumn("slot", F.col("start") + F.col("rank"))
        .select(*kept)
    )
    if named is not None:
        # Only the rows of cut blocks meet the table of single rows.
        cut_rows = rows.join(named, ["shard", "block"], "left_semi").withColumn("rank", F.row_number().over(order) - 1)
        one = spark.createDataFrame(single, "shard bigint, block bigint, rank bigint, to bigint, slot bigint")
        placed = placed.unionByName(cut_rows.join(one, ["shard", "block", "rank"]).select(*kept))
    changed = placed.filter(~F.col("shard").isin(*same)) if same else placed
    changed.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(new)
    layout = spark.read.schema(LAYOUT).parquet(new)
    if same:
        # These shards hold the same rows as before; only their slots are counted anew.
        layout = layout.unionByName(placed.filter(F.col("shard").isin(*same)))
    return layout, flow


def reshard_documents(docs: DataFrame, shard, shards: int) -> DataFrame:
    """Write docs in old shards, reshard them, and describe the rows of the new files.

    Columns: doc_id, size, text_crc32 (of the text as read back), shard, slot.
    """
    spark = docs.sparkSession
    old, new = scratch(spark, "shards-old"), scratch(spark, "shards-new")
    write_layout(docs, old, shard)
    layout, _ = reshard(spark, old, new, shards)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return layout.select("doc_id", row_size().alias("size"), crc.alias("text_crc32"), "shard", "slot")
