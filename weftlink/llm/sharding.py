"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that no shard boundary may cut.  Groups
of at least 1/``UNITS`` of all bytes are units of their own (there are at most
``UNITS`` of them); the smaller ones are gathered by their hash into ``UNITS``
more.  So at most twice ``UNITS`` units, whatever the input, reach the driver.
There, units sorted by size enter the bin with the tightest room that holds
them, found in a balanced tree of rooms; the least capacity that needs no more
than the asked number of bins is found by bisection.

A null text is the empty one (size 1).  Equal documents keep their group; ties
go to the smaller unit number.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common

#: Units of small groups, and inverse least share of a group that is a unit of its own.
UNITS = 4096
SHARDS = 8


class RoomTree:
    """Bins by remaining room: an AVL tree over (room, bin) that answers the least one >= a size."""

    __slots__ = ("root",)

    class Node:
        __slots__ = ("height", "key", "left", "right")

        def __init__(self, key: tuple[int, int]):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _height(n: Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: Node) -> None:
        n.height = 1 + max(self._height(n.left), self._height(n.right))

    def _turn(self, n: Node, side: str, other: str) -> Node:
        up = getattr(n, side)
        setattr(n, side, getattr(up, other))
        setattr(up, other, n)
        self._fix(n)
        self._fix(up)
        return up

    def _even(self, n: Node) -> Node:
        self._fix(n)
        lean = self._height(n.left) - self._height(n.right)
        for sign, side, other in ((1, "left", "right"), (-1, "right", "left")):
            if sign * lean > 1:
                child = getattr(n, side)
                if self._height(getattr(child, other)) > self._height(getattr(child, side)):
                    setattr(n, side, self._turn(child, other, side))
                return self._turn(n, side, other)
        return n

    def add(self, key: tuple[int, int]) -> None:
        def put(n):
            if n is None:
                return RoomTree.Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._even(n)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(n, key):
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None:
                return n.right
            elif n.right is None:
                return n.left
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = cut(n.right, least.key)
            return self._even(n)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, bins opened as needed; None if a size exceeds the capacity or more than ``most`` bins are needed."""
    tree, bins, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] > capacity:
            return None
        room = tree.tightest(sizes[i])
        if room is None:
            if bins == most:
                return None
            room, bins = (capacity, bins), bins + 1
        else:
            tree.remove(room)
        out[i] = room[1]
        tree.add((room[0] - sizes[i], room[1]))
    return out


def level(sizes: list[int], shards: int) -> list[int]:
    """Bins 0..shards-1 for sizes by the least capacity that bisection finds enough for best-fit-decreasing."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    high, found = max(low, 1), None
    while (found := best_fit_decreasing(sizes, high, shards)) is None:
        high += max(1, high // 8)
    while low < high:
        mid = (low + high) // 2
        at = best_fit_decreasing(sizes, mid, shards)
        if at is None:
            low = mid + 1
        else:
            high, found = mid, at
    return found


def shards_by_bytes(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; sizes near equal, equal texts together."""
    docs = common.base(df, id_col, text_col)
    rows = common.saved(
        docs.select("doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), common.crc32_of(F.col("text")).alias("text_crc32"), F.xxhash64("text").alias("g1"), F.xxhash64("text", F.lit(1)).alias("g2")),
        "sizes",
    )
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * UNITS >= F.lit(total)
    # One row for each large group (at most UNITS) and each gathering of small ones (UNITS).
    units = (
        groups.withColumn("big", large)
        .withColumn("unit", F.pmod("g1", F.lit(UNITS)).cast("int"))
        .groupBy("big", F.when(F.col("big"), F.col("g1")).alias("k1"), F.when(F.col("big"), F.col("g2")).alias("k2"), "unit")
        .agg(F.sum("size").alias("size"))
        .collect()
    )
    units.sort(key=lambda r: (not r["big"], r["unit"], r["k1"] or 0, r["k2"] or 0))
    at = level([r["size"] for r in units], shards)
    spark = df.sparkSession
    big = spark.createDataFrame([(r["k1"], r["k2"], a) for r, a in zip(units, at) if r["big"]], "g1 long, g2 long, big_shard int")
    small = spark.createDataFrame([(r["unit"], a) for r, a in zip(units, at) if not r["big"]], "unit int, small_shard int")
    dealt = (
        rows.join(F.broadcast(big), ["g1", "g2"], "left")
        .withColumn("unit", F.pmod("g1", F.lit(UNITS)).cast("int"))
        .join(F.broadcast(small), "unit", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "small_shard").alias("shard"))
    )
    out = common.ranked(dealt, "shard", ["doc_id", "text_crc32"], "slots", "slot")
    common.dropped(rows)
    return common.null_ids(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_bytes(common.documents(spark, sf_dir))
