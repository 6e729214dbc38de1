"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that stays in one shard. Groups, largest first, enter the open shard with the
tightest remaining capacity that still holds them, found in a balanced tree (a treap keyed by remaining capacity). With a
capacity given, shards are opened as needed; with a number of shards given, the capacity is the least one, searched from
the mean upwards, under which the packing needs no more shards, so their sizes come out nearly equal (law `bytes`).

Scale: packing only depends on the multiset of group sizes. For it, sizes are rounded up to SIGNIFICANT leading bits (those
below 2048 bytes are exact, larger ones too long by less than a thousandth), so that the driver gets at most 1,024 rows
(size, number of groups) for each doubling of the size, whatever the corpus, and places equal sizes in runs. Each group then
looks its run up by its rank among groups of its size, which is counted in hash buckets, so no size and no shard is ever
ordered in one task. A group larger than a shard can't stay whole: it's cut into pieces of whole documents, each as
large as fits the mean shard; there are fewer such groups than shards.

Size is the UTF-8 length plus 16. Null and empty texts count as equal, with size 16. Repeated rows are documents of their
own. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
OVERHEAD = 16
#: Leading bits of a group's size that the packing sees.
SIGNIFICANT = 11


class Treap:
    """A balanced search tree of (key, item) pairs with deterministic priorities."""

    __slots__ = ("root", "state")

    def __init__(self):
        self.root, self.state = None, 88172645463325252

    def _priority(self) -> int:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    def _split(self, t, key):
        """Nodes below key, and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self._priority(), None, None]), b)

    def ceiling(self, key):
        """The least stored key that isn't below key, or None."""
        t, best = self.root, None
        while t is not None:
            if t[0] < key:
                t = t[3]
            else:
                best, t = t[0], t[2]
        return best

    def remove(self, key) -> None:
        a, b = self._split(self.root, key)
        _, c = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, c)


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, shard, number of groups) of best-fit decreasing over (size, number of groups), largest first; None if more than `most` shards are needed.

    Once a group has entered the tightest shard, that shard is the tightest for the next group of the same size as long
    as it fits, so equal sizes are placed together.
    """
    tree, opened, out = Treap(), 0, []
    for size, left in sizes:
        if size > capacity:
            return None
        while left:
            key = tree.ceiling((size, -1))
            if key is None:
                if most is not None and opened >= most:
                    return None
                key, opened = (capacity, opened), opened + 1
            else:
                tree.remove(key)
            room, shard = key
            n = min(left, room // size)
            out.append((size, shard, n))
            left -= n
            if room - n * size:
                tree.insert((room - n * size, shard))
    return out


def pack(sizes: list[tuple[int, int]], shards: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The least capacity found under which the groups fit the shards, and the packing."""
    sizes = sorted(sizes, reverse=True)
    total = sum(s * n for s, n in sizes)
    low = max(-(-total // shards), sizes[0][0])
    if runs := best_fit(sizes, low, shards):
        return low, runs
    step = 1
    while (runs := best_fit(sizes, low + step, shards)) is None:
        step *= 2
    bad, good = low + step // 2, low + step
    while good - bad > max(1, (good - low) // 64):
        mid = (bad + good) // 2
        if found := best_fit(sizes, mid, shards):
            good, runs = mid, found
        else:
            bad = mid
    return good, runs


def rounded(size: Column) -> Column:
    """A size rounded up to a multiple of the power of two that leaves it SIGNIFICANT bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - SIGNIFICANT, F.lit(0))).cast("long")
    return F.ceil(size / unit).cast("long") * unit


def number(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """df with a gapless number from 0 within each group, by hash bucket and then `order`; no group is ordered in one task."""
    b = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order)) - 1
    return b.withColumn("__i", inside).join(first, [*by, "__bucket"]).withColumn(name, (F.col("__first") + F.col("__i")).cast("long")).drop("__bucket", "__n", "__first", "__i")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot (gapless from 0 within the shard), grown_shard (null under this law), piece (of a cut group, else 0)."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("key"))
    )
    groups = materialize(rows.groupBy("key").agg(F.count("*").alias("copies"), F.max("size").alias("size")).withColumn("bytes", F.col("copies") * F.col("size")))
    head = groups.agg(F.sum("bytes").alias("total"), F.sum("copies").alias("rows")).first()
    schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, piece long"
    if not head["rows"]:
        return spark.createDataFrame([], schema)
    mean = -(-head["total"] // shards)
    buckets = max(16, head["rows"] // 200_000)

    # Fewer than `shards` groups exceed the mean, since together they hold no more than the total.
    cut = F.broadcast(groups.where(F.col("bytes") > mean).select("key", F.greatest(F.lit(1), F.floor(F.lit(mean) / F.col("size"))).alias("per_piece")))
    whole = rows.join(cut, "key", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    parts = number(rows.join(cut, "key"), ["key"], ["doc_id"], "at", buckets).withColumn("piece", F.floor(F.col("at") / F.col("per_piece")))
    rows = materialize(whole.unionByName(parts.select(whole.columns)))
    units = rows.groupBy("key", "piece").agg(F.count("*").alias("copies"), rounded(F.sum("size")).alias("bytes"))
    units = materialize(number(units, ["bytes"], ["key", "piece"], "rank", buckets))

    sizes = [(r["bytes"], r["count"]) for r in units.groupBy("bytes").count().collect()]
    _, runs = pack(sizes, shards)
    plan = pd.DataFrame(runs, columns=["bytes", "shard", "n"])
    plan["last"] = plan.groupby("bytes")["n"].cumsum()
    plan["first"] = plan["last"] - plan["n"]
    # Bounded by construction: a run for each of the bounded number of sizes, and one more for each shard that a size fills.
    plan = F.broadcast(spark.createDataFrame(plan[["bytes", "shard", "first", "last"]]))
    placed = units.join(plan, "bytes").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).select("key", "piece", F.col("shard").cast("int").alias("shard"), "copies")
    placed = materialize(placed)

    # At most a thousand units hold more than a thousandth of the rows each; their documents need no shuffle to find them.
    share = F.col("copies") * 1000 > head["rows"]
    hot = F.broadcast(placed.where(share).drop("copies"))
    found = rows.join(hot, ["key", "piece"]).unionByName(rows.join(hot, ["key", "piece"], "left_anti").join(placed.where(~share).drop("copies"), ["key", "piece"]))
    slots = number(found, ["shard"], ["doc_id", "text_crc32", "size"], "slot", buckets)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("piece").cast("long").alias("piece"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
