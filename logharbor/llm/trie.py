"""Prefix trie of conversations, with totals of every subtree by time-forward processing.

A node is a distinct sequence of first turns (role, text). It is named by its smallest member and its depth, so the nodes
that one conversation names are a stretch of its own path, and every node's parent is one depth above.

1. Turns are numbered, and a prefix is known by four running sums of 33 bits, each of a hash of (number, role, text): equal for
   equal prefixes, else different but for a chance of 2^-132. Numbers and sums run over range partitions, so that one
   conversation of very many turns is spread; the parts before a part give what its sums begin with.
2. Nodes are the groups of equal prefixes. All is counted by partial aggregates, however many members a node has.
3. Subtree totals: nodes are cut into shards, ranges of (conv_id, depth) of about equal size. In a shard they are sorted in reverse
   level order (Spark's external sort) and each hands its total to its parent through a priority queue that spills
   (``SpillingQueue``): when a node's turn comes, all its children of the shard have been there.
4. Across shards: the parts of a shard that hang together have a shard root each. Totals of shard roots go to the shard roots above
   at doubling distances, so a chain of shards takes log2(its length) rounds. What shard roots send to nodes of other
   shards is added to these nodes' own values, and the shards are gone through again.
5. Digests of the ids that end at a node are fed in order: whole groups inside a partition at once, groups at its
   edges as pieces of text that one later fold reads one after the other, so no list of ids is held.

Results for odd rows: a null role or text reads as empty; rows of equal turn come by a hash of role and text; repeated rows are
turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table has no nodes; extra
columns are left behind.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import cut

#: Bits of each of the SUMS running sums; 2^30 turns of a conversation fit a long.
SUM_BITS, SUMS = 33, 4
PREFIX = [f"p{i}" for i in range(SUMS)]
#: Messages a queue holds in memory before it spills, and how many of a spilled run are read at once.
QUEUE_ITEMS, READ_ITEMS = 1 << 18, 1 << 12
#: Bytes of ids in one piece of a group that goes over the edge of a partition.
PIECE_BYTES = 1 << 20


class SpillingQueue:
    """Messages (level, node, first, second), smallest (level, node) first. Beyond ``limit`` messages the ones in memory are
    written, sorted, to an unnamed temporary file of the task, which ends with it; popping merges the runs."""

    def __init__(self, limit: int = QUEUE_ITEMS):
        self.limit, self.held, self.heads = limit, [], []

    def push(self, level: int, node: int, first: int, second: int) -> None:
        heapq.heappush(self.held, (level, node, first, second))
        if len(self.held) > self.limit:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        np.array(sorted(self.held), np.int64).tofile(run)
        run.seek(0)
        self.held = []
        self._advance(self._read(run))

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        while data := run.read(READ_ITEMS * 32):
            yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist())
        run.close()

    def _advance(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.heads, (head, id(run), run))

    def take(self, level: int, node: int) -> tuple[int, int]:
        """The sums of all messages to a node, which leave the queue."""
        first = second = 0
        key = (level, node)
        while self.held and self.held[0][:2] == key:
            message = heapq.heappop(self.held)
            first, second = first + message[2], second + message[3]
        while self.heads and self.heads[0][0][:2] == key:
            message, _, run = heapq.heappop(self.heads)
            first, second = first + message[2], second + message[3]
            self._advance(run)
        return first, second

    def __bool__(self) -> bool:
        return bool(self.held or self.heads)


def _running(rows: DataFrame, key: str, order: Sequence[Column | str], values: dict[str, Column]) -> DataFrame:
    """rows with running sums of values within each key, in order; a key of very many rows is spread over range partitions."""
    parts = cut(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(key, "_part").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    many = sums.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A part shares at most its first and its last key with others: two rows for each partition at most.
    edges = sums.join(many, key, "left_semi")
    edges = cut(edges.select(key, "_part", *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in values]))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.select(*parts.columns, *[F.sum(v).over(inside).alias(n) for n, v in values.items()])
    total = {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in values}
    placed = summed.join(F.broadcast(edges), [key, "_part"], "left").withColumns(total)
    return placed.drop("_part", *[f"_{n}" for n in values])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, number from 0, a, b, bytes) of every turn in order; a and b are hashes of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("bigint").alias("bytes"),
        # Deals out repeated rows, whose order makes no difference.
        F.monotonically_increasing_id().alias("_row"),
    )
    ranked = _running(turns, "conv_id", [F.col("turn").asc_nulls_first(), "a", "b", "_row"], {"number": F.lit(1)})
    return ranked.select("conv_id", (F.col("number") - 1).alias("number"), "a", "b", "bytes")


def shared_heads(turns: DataFrame, group: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with another one's head: the first ``head`` turns of conversation ``group``, then the own turns
    after as many. ``group`` and ``head`` are expressions of conv_id, head is at most ``most``. Gives the turns, numbered from
    1, and (conv_id, length) of every conversation."""
    turns = cut(turns)
    counts = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    convs = counts.withColumns({"base": group, "h": head})
    bases = counts.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most)).alias("_m"))
    taken = F.least("h", F.coalesce("_m", F.lit(0)))
    convs = cut(convs.join(bases, "base", "left").select("conv_id", "n", "base", "h", taken.alias("taken")))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter(F.col("number") >= F.col("h"))
    own = own.select("conv_id", (F.col("number") - F.col("h") + F.col("taken") + 1).alias("number"), "a", "b", "bytes")
    first = turns.filter(F.col("number") < most).withColumnRenamed("conv_id", "base")
    heads = first.join(convs.select("conv_id", "base", "taken"), "base").filter(F.col("number") < F.col("taken"))
    heads = heads.select("conv_id", (F.col("number") + 1).alias("number"), "a", "b", "bytes")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(heads), lengths


def _prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, p0.., q0..) of every prefix of every conversation, the empty one at depth 0; q is the parent's."""
    start = lengths.select("conv_id", F.lit(0).cast("bigint").alias("number"), *[F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "bytes")])
    mask = (1 << SUM_BITS) - 1
    parts = {
        p: F.when(F.col("number") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(i), "number", "a", "b").bitwiseAND(F.lit(mask)))
        for i, p in enumerate(PREFIX)
    }
    rows = turns.unionByName(start).withColumns({f"x{p}": v for p, v in parts.items()}).drop("a", "b")
    run = _running(rows, "conv_id", ["number"], {p: F.col(f"x{p}") for p in PREFIX})
    above = [(F.col(p) - F.col(f"x{p}")).alias(f"q{i}") for i, p in enumerate(PREFIX)]
    return run.select("conv_id", F.col("number").alias("depth"), "bytes", *PREFIX, *above)


def _ends(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, p0.., ends_sha256) of the prefixes that are whole conversations: SHA-256 of their ids, ascending, joined by commas."""
    last = prefixes.join(lengths, "conv_id").filter(F.col("depth") == F.col("length")).select("depth", *PREFIX, "conv_id")
    keys = ["depth", *PREFIX]

    def fold(batches):
        # The first and the last group of a partition may go on in others: they leave as pieces, the rest as digests.
        group, held, size, begin, edge = None, [], 0, None, True

        def out(piece=None, sha=None):
            row = dict(zip(keys, group, strict=True)) | {"begin": begin, "piece": piece, "sha": sha}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            done = []
            for *key, conv in zip(*columns, batch.column("conv_id").to_pylist(), strict=True):
                if key != group:
                    if held and edge:
                        done.append(out(piece=",".join(held)))
                    elif held:
                        done.append(out(sha=hashlib.sha256(",".join(held).encode()).hexdigest()))
                    edge, group, held, size = group is None, key, [], 0
                if not held:
                    begin = conv
                held.append(str(conv))
                size += len(held[-1]) + 1
                if size > PIECE_BYTES:
                    # A group this large leaves in pieces wherever it stands.
                    done.append(out(piece=",".join(held)))
                    edge, held, size = True, [], 0
            yield from pa.Table.from_batches(done, schema).combine_chunks().to_batches()
        if held:
            yield out(piece=",".join(held))

    def join(batches):
        group, digest = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                key = [r[k] for k in keys]
                if key != group:
                    if group is not None:
                        done.append({**dict(zip(keys, group, strict=True)), "sha": digest.hexdigest()})
                    group, digest = key, hashlib.sha256(r["piece"].encode())
                else:
                    digest.update(b"," + r["piece"].encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, whole)
        if group is not None:
            yield pa.RecordBatch.from_pylist([{**dict(zip(keys, group, strict=True)), "sha": digest.hexdigest()}], whole)

    longs = [(k, pa.int64()) for k in keys]
    schema = pa.schema([*longs, ("begin", pa.int64()), ("piece", pa.string()), ("sha", pa.string())])
    whole = pa.schema([*longs, ("sha", pa.string())])
    ddl = ", ".join(f"{k} bigint" for k in keys)
    sorted_ids = last.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    folded = cut(sorted_ids.mapInArrow(fold, f"{ddl}, begin bigint, piece string, sha string"))
    pieces = folded.filter("sha IS NULL").drop("sha").repartition(*keys).sortWithinPartitions(*keys, "begin")
    done = folded.filter("sha IS NOT NULL").select(*keys, "sha")
    return done.unionByName(pieces.mapInArrow(join, f"{ddl}, sha string")).withColumnRenamed("sha", "ends_sha256")


def _nodes(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, own, saved, ends_sha256) of every node."""
    keys = ["depth", *PREFIX]
    above = [f"q{i}" for i in range(SUMS)]
    groups = prefixes.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), *[F.min(q).alias(q) for q in above]
    )
    groups = cut(groups)
    parents = groups.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), *[F.col(p).alias(q) for p, q in zip(PREFIX, above, strict=True)]
    )
    below = groups.filter("depth > 0")
    linked = below.join(parents, ["depth", *above]).select("conv_id", "depth", "parent_conv_id", "n_convs", "bytes", *PREFIX)
    top = groups.filter("depth = 0").select("conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "bytes", *PREFIX)
    linked = cut(linked.unionByName(top))
    children = linked.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))
    rows = linked.join(ends, keys, "left").join(children, ["conv_id", "depth"], "left")
    n_children = F.coalesce("n_children", F.lit(0).cast("bigint"))
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"),
        F.when(n_children == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _parent_inside(batch: pa.RecordBatch, bounds: dict) -> list[bool]:
    """Whether the parent of each row is in the row's shard; a shard holds every node between its bounds."""
    shards, depths, parents = (batch.column(c).to_pylist() for c in ("shard", "depth", "parent_conv_id"))
    inside = []
    for s, d, p in zip(shards, depths, parents, strict=True):
        low, high = bounds[s]
        inside.append(p is not None and low <= (p, d - 1) <= high)
    return inside


def _shard_roots(shards: DataFrame, bounds: dict) -> DataFrame:
    """(conv_id, depth, root_conv_id, root_depth) of every node: the shard root above it, or itself. Goes down level by level;
    a level's roots are kept for the next one."""

    def run(batches):
        at, level, above, here = None, None, {}, {}
        for batch in batches:
            roots = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "depth", "parent_conv_id")), _parent_inside(batch, bounds), strict=True)
            for shard, conv, depth, parent, inside in rows:
                if shard != at or depth != level:
                    above = here if shard == at and depth == level + 1 else {}
                    at, level, here = shard, depth, {}
                root = above[parent] if inside else (conv, depth)
                here[conv] = root
                roots.append(root)
            conv, depth = zip(*roots, strict=True) if roots else ((), ())
            columns = [batch.column("conv_id"), batch.column("depth"), pa.array(conv, pa.int64()), pa.array(depth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "root_conv_id", "root_depth"])

    levels = _dealt(shards, bounds).sortWithinPartitions("shard", "depth", "conv_id")
    return levels.select("shard", "conv_id", "depth", "parent_conv_id").mapInArrow(
        run, "conv_id bigint, depth bigint, root_conv_id bigint, root_depth bigint"
    )


def _dealt(shards: DataFrame, bounds: dict) -> DataFrame:
    """Each shard in a partition of its own."""
    return shards.repartitionById(max(bounds, default=0) + 1, F.col("shard"))


def _forward(shards: DataFrame, bounds: dict, limit: int = QUEUE_ITEMS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, leaves, saved, outside): totals of every node over what its shard holds of its subtree,
    and whether its parent is in another shard. Nodes come in reverse level order, their totals go up through the queue."""

    def run(batches):
        queue, at = SpillingQueue(limit), None
        for batch in batches:
            names = ("shard", "conv_id", "depth", "parent_conv_id", "leaves", "saved")
            inside = _parent_inside(batch, bounds)
            leaves, saved = [], []
            for (shard, conv, depth, parent, own, value), up in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), inside, strict=True):
                if shard != at:
                    if queue:
                        raise ValueError("a message has met no node")
                    at = shard
                first, second = queue.take(-depth, conv)
                first, second = first + own, second + value
                leaves.append(first)
                saved.append(second)
                if up:
                    queue.push(1 - depth, parent, first, second)
            columns = [batch.column("conv_id"), batch.column("depth"), batch.column("parent_conv_id"), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.array([not x for x in inside])]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "parent_conv_id", "leaves", "saved", "outside"])

    reverse = _dealt(shards, bounds).sortWithinPartitions("shard", F.desc("depth"), "conv_id")
    return reverse.select("shard", "conv_id", "depth", "parent_conv_id", "leaves", "saved").mapInArrow(
        run, "conv_id bigint, depth bigint, parent_conv_id bigint, leaves bigint, saved bigint, outside boolean"
    )


def _across(roots: DataFrame, above: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, saved) of every shard root with those below it, where above (conv_id, depth, to_conv_id,
    to_depth) names the shard root over its parent. After r rounds sums reach 2^r shard roots far."""
    key = ["conv_id", "depth"]
    sums, jump = cut(roots.select(*key, "leaves", "saved")), cut(above)
    while not jump.isEmpty():
        got = jump.join(sums, key).groupBy(F.col("to_conv_id").alias("conv_id"), F.col("to_depth").alias("depth"))
        got = got.agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        more = {"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))}
        sums = cut(sums.join(got, key, "left").withColumns(more).select(*key, "leaves", "saved"))
        hop = jump.select(F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), F.col("to_conv_id").alias("_c"), F.col("to_depth").alias("_d"))
        jump = cut(jump.join(hop, ["to_conv_id", "to_depth"]).select(*key, F.col("_c").alias("to_conv_id"), F.col("_d").alias("to_depth")))
    return sums


def subtree_totals(nodes: DataFrame, limit: int = QUEUE_ITEMS) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums of ``leaves`` and ``saved`` over every node's subtree, the node included.

    nodes (conv_id, depth, parent_conv_id, leaves, saved, ...) holds every parent, at (parent_conv_id, depth - 1).
    """
    key = ["conv_id", "depth"]
    values = nodes.select(*key, "parent_conv_id", "leaves", "saved")
    shards = cut(values.repartitionByRange(*key).withColumn("shard", F.spark_partition_id()))
    ends = shards.groupBy("shard").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high"))
    # One row for each partition.
    bounds = {r["shard"]: (tuple(r["low"]), tuple(r["high"])) for r in ends.collect()}
    roots = cut(_forward(shards, bounds, limit).filter("outside").drop("outside"))
    placed = _shard_roots(shards, bounds)
    sent = roots.filter("parent_conv_id IS NOT NULL")
    over = placed.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("root_conv_id").alias("to_conv_id"), F.col("root_depth").alias("to_depth")
    )
    above = sent.join(over, ["parent_conv_id", "depth"]).select(*key, "to_conv_id", "to_depth")
    full = _across(roots, above)
    mail = full.join(sent.select(*key, "parent_conv_id"), key)
    mail = mail.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    mail = mail.agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    more = {"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))}
    told = shards.join(mail, key, "left").withColumns(more).drop("_l", "_s")
    return _forward(told, bounds, limit).select(*key, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every node of the trie of turns (conv_id, number from 1, a, b, bytes); lengths (conv_id, length) names every conversation,
    turnless ones too. Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = cut(_prefixes(turns, lengths))
    nodes = cut(_nodes(prefixes, cut(_ends(prefixes, lengths))))
    totals = cut(subtree_totals(nodes))
    return nodes.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
