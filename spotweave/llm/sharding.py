"""Sharding by best-fit-decreasing bin packing of groups of equal texts.

Groups, largest first, go to the bin with the tightest remaining capacity that takes them,
found in a balanced tree. To do so at any size, groups are dealt by hash to cells of about
``CELL_ITEMS``; each cell packs its groups into blocks of a small fixed capacity; blocks are
dealt and packed again until at most ``CELL_ITEMS`` are left, and those are packed into the shards with the
smallest capacity that suffices. A group stays in one shard, unless it alone exceeds
a fair share by more than ``SLACK``: then sizes could not be near equal, and it is split by id.

Defined results: a NULL text is empty and equal to an empty one; rows that repeat an id each
get a slot; rows with a NULL id are placed like others; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.session import cut_lineage

SHARDS = 24
CELL_ITEMS = 4_000
# Blocks a shard is made of, about.
BLOCKS = 256
SLACK = 0.05
# Rows that are numbered together.
RUN_ROWS = 256
ROW_BYTES = 8


class Remaining:
    """Ordered (capacity left, bin): a search tree of one inner level, whose leaves are split
    when full, so every operation touches one leaf."""

    FULL = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]  # lower bound of each leaf

    def add(self, left: int, number: int) -> None:
        i = bisect_left(self.least, (left, number + 1)) - 1
        leaf = self.leaves[i]
        insort(leaf, (left, number))
        if len(leaf) > self.FULL:
            half = len(leaf) // 2
            self.leaves.insert(i + 1, leaf[half:])
            self.least.insert(i + 1, leaf[half])
            del leaf[half:]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least capacity of at least ``size``."""
        i = max(0, bisect_left(self.least, (size, -1)) - 1)
        while i < len(self.leaves):
            leaf = self.leaves[i]
            at = bisect_left(leaf, (size, -1))
            if at < len(leaf):
                found = leaf.pop(at)
                if not leaf and i:
                    del self.leaves[i], self.least[i]
                return found
            i += 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; an item above ``capacity`` has a bin of its own."""
    bins, left, out = 0, Remaining(), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = left.take(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), bins)
            bins += 1
        out[i] = found[1]
        left.add(found[0] - sizes[i], found[1])
    return out


def fewest_capacity(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing into at most ``bins`` bins of the smallest capacity that a
    bisection finds."""
    total = sum(sizes)
    fair = max(1, -(-total // bins))
    low, high = fair, 2 * max([fair, *sizes])
    best = best_fit_decreasing(sizes, high)
    while low < high:
        middle = (low + high) // 2
        got = best_fit_decreasing(sizes, middle)
        if max(got, default=0) < bins:
            best, high = got, middle
        else:
            low = middle + 1
    return best


def _pack_cells(items: DataFrame, n_cells: int, capacity: int) -> DataFrame:
    """``items(key, part, bytes, rows)`` with ``cell``, ``block`` and ``before``, the rows
    placed earlier in the block."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("key", "ascending"), ("part", "ascending")])
        blocks = best_fit_decreasing(cell.column("bytes").to_pylist(), capacity)
        filled: dict[int, int] = {}
        before = []
        for block, rows in zip(blocks, cell.column("rows").to_pylist()):
            before.append(filled.get(block, 0))
            filled[block] = before[-1] + rows
        return cell.append_column("block", pa.array(blocks, pa.int32())).append_column("before", pa.array(before, pa.int64()))

    dealt = items.withColumn("cell", F.pmod(F.xxhash64("key", "part"), F.lit(n_cells)))
    return dealt.groupBy("cell").applyInArrow(run, "key binary, part int, bytes bigint, rows bigint, cell bigint, block int, before bigint")


def place_items(items: DataFrame, shards: int, fair: int) -> DataFrame:
    """``(key, part, shard, base)`` of ``items(key, part, bytes, rows)``; ``base`` is the
    number of rows before the item in its shard."""
    spark = items.sparkSession
    n = items.count()
    capacity = max(1, fair // BLOCKS)
    levels = []
    while True:
        packed = cut_lineage(_pack_cells(items, n // CELL_ITEMS + 1, capacity))
        levels.append(packed)
        name = F.encode(F.concat_ws(":", "cell", "block"), "utf-8")
        items = packed.groupBy("cell", "block").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        items = items.select(name.alias("key"), F.lit(0).alias("part"), "bytes", "rows")
        before, n = n, items.count()
        if n <= CELL_ITEMS * 4 or n >= before:
            break
    top = sorted((bytes(r["key"]), r["bytes"], r["rows"]) for r in items.collect())  # 4 * CELL_ITEMS at most, but for groups of a block's size
    chosen = fewest_capacity([t[1] for t in top], shards)
    filled = [0] * shards
    rows = []
    for (key, _, count), shard in zip(top, chosen):
        rows.append((bytearray(key), shard, filled[shard]))
        filled[shard] += count
    placed = F.broadcast(spark.createDataFrame(rows, "name binary, shard int, start bigint"))
    for packed in reversed(levels):
        own = packed.withColumn("name", F.encode(F.concat_ws(":", "cell", "block"), "utf-8")).join(placed, "name")
        placed = own.select(F.col("key").alias("name"), "part", "shard", (F.col("start") + F.col("before")).alias("start"))
        if packed is not levels[0]:
            placed = placed.drop("part")
    return placed.withColumnRenamed("name", "key").withColumnRenamed("start", "base")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, size, CRC-32, shard and slot. Sizes of the shards are near equal."""
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(content) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(content).alias("text_crc32"), F.unhex(F.md5(content)).alias("key"))
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    fair = max(1, -(-total // shards))
    # Copies are numbered in runs; only groups above a shard's capacity have several parts.
    runs = F.ceil(F.col("n") / F.lit(RUN_ROWS)).cast("int")
    parts = F.when(F.col("bytes") > fair * (1 + SLACK), F.ceil(F.col("bytes") * 8 / F.lit(fair))).otherwise(1).cast("int")
    drawn = F.xxhash64("doc_id", F.lit(1))
    rows = rows.join(groups.select("key", runs.alias("runs"), parts.alias("parts")), "key")
    rows = rows.select("doc_id", "size", "text_crc32", "key", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.pmod(drawn, F.col("runs")).cast("int").alias("run"))
    rows = cut_lineage(rows)
    counted = cut_lineage(rows.groupBy("key", "part", "run").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    items = counted.groupBy("key", "part").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    placed = place_items(items, shards, fair)
    earlier = F.sum("rows").over(W.partitionBy("key", "part").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    starts = counted.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(placed, ["key", "part"])
    starts = starts.select("key", "part", "run", "shard", (F.col("base") + F.col("earlier")).alias("start"))
    rank = F.row_number().over(W.partitionBy("key", "part", "run").orderBy("doc_id"))
    out = rows.withColumn("rank", rank).join(starts, ["key", "part", "run"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
