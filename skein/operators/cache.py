"""Statistics and clean-up of a cache table (schema, bytes, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = (("1h", 3600), ("1d", 86_400), ("7d", 604_800), ("30d", 2_592_000), ("90d", 7_776_000), ("older", None))


def band(age_seconds: Column) -> Column:
    out = None
    for name, upto in BANDS[:-1]:
        out = F.when(age_seconds < upto, name) if out is None else out.when(age_seconds < upto, name)
    return out.otherwise("older")


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def by_schema(entries: DataFrame, current: str) -> DataFrame:
    """The current schema first, then by bytes."""
    g = entries.groupBy("schema").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))
    return g.orderBy(F.when(F.col("schema") == current, 0).otherwise(1), F.desc("bytes"), "schema")


def age_bands(entries: DataFrame, now: Column) -> DataFrame:
    """(band, entries, bytes) with a row for empty bands too."""
    spark = entries.sparkSession
    all_ = spark.createDataFrame([(n,) for n, _ in BANDS], "band string")
    got = entries.groupBy(band(F.unix_timestamp(now) - F.unix_timestamp("ts")).alias("band")).agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))
    return all_.join(got, "band", "left").select("band", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def eviction_hours(entries: DataFrame, budget: int) -> DataFrame:
    """(hour, bytes, running): the oldest hours whose entries go, the whole boundary hour included. Only the hour histogram is ordered in one task."""
    hours = entries.groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.sum("bytes").alias("bytes"))
    run = hours.withColumn("running", F.sum("bytes").over(Window.orderBy("hour"))).withColumn("total", F.sum("bytes").over(Window.partitionBy()))
    need = F.col("total") - budget
    return run.where((need > 0) & (F.col("running") - F.col("bytes") < need)).select("hour", "bytes", "running")


def collect_garbage(entries: DataFrame, current: str, budget: int, prune_stale: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): stale schemas, then the oldest hours beyond the budget."""
    stale = F.col("schema") != current if prune_stale else F.lit(False)
    fresh = entries.where(~stale)
    last = eviction_hours(fresh, budget).agg(F.max("hour")).first()[0]
    old = F.floor(F.unix_timestamp("ts") / 3600) <= (last if last is not None else -1)
    return fresh.where(~old), entries.where(stale | old)


def stage_timings(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """(stage, n, nanos) between two snapshots of counters."""
    e = earlier.select("stage", F.col("n").alias("n0"), F.col("nanos").alias("t0"))
    return later.join(e, "stage", "left").select("stage", (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"), (F.col("nanos") - F.coalesce("t0", F.lit(0))).alias("nanos"))


def batch_waste(batches: DataFrame) -> DataFrame:
    """Shares of padding in tokens and in area over (count, tokens, longest), and the mean count."""
    full, area = F.col("count") * F.col("longest"), F.col("count") * F.col("longest") * F.col("longest")
    return batches.agg((1 - F.sum("tokens") / F.sum(full)).alias("token_waste"), (1 - F.sum(F.col("tokens") * F.col("tokens") / F.col("count")) / F.sum(area)).alias("area_waste"), F.avg("count").alias("mean_count"))
