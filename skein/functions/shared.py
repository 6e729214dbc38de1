"""Tables in the cluster's shared folder, size-checked broadcasts, and joins in which one key may hold a third of all rows."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is hinted for broadcast only after it was counted to have at most so many rows and bytes.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20
#: A key with more rows than this is hot: its rows are spread over several tasks.
HOT_ROWS = 200_000
#: Bytes of stored tables for which a shuffle gets a task of its own, whatever the session's setting.
TASK_BYTES = 8 << 20


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may do without, below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: the executors of a cluster need a folder that all of them share")
        base = "file:/tmp/skein-shared"
    return base.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A fresh folder below the shared one; it goes when the driver exits."""
    path = f"{shared_base(spark)}/skein-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session ended first; the folder is the cluster's to clean
            pass

    atexit.register(remove)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
    if isinstance(kind, T.StructType):
        out = F.lit(8)
        for f in kind.fields:
            out = out + _bytes(c[f.name], f.dataType)
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.lit(8) * F.greatest(F.size(c), F.lit(1)).cast("long")
        return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(8))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def is_small(df: DataFrame, rows: int | None = None, most: int | None = None) -> bool:
    """Whether df has at most so many rows and bytes. It's cut at the bound, so a large one isn't read whole; it should be cheap to count."""
    rows = BROADCAST_ROWS if rows is None else rows
    most = BROADCAST_BYTES if most is None else most
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        size = size + _bytes(F.col(f"`{f.name}`"), f.dataType)
    r = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return r["n"] <= rows and r["b"] <= most


def small(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it was measured to be small."""
    return F.broadcast(df) if is_small(df, rows, most) else df


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is made from, a table as often as it's read; only metadata is looked at."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    each = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in each if x.getClass().getSimpleName() == "LogicalRelation")


def by_size(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys into tasks whose number grows with the input, so that no task does; small inputs are left as they are."""
    n = min(-(-stored_bytes(df) // TASK_BYTES), 20_000)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def hot_keys(rows: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame | None:
    """(keys, __salts) of the keys with more than `hot` rows, or None; there are at most count(rows) / hot of them."""
    hot = HOT_ROWS if hot is None else hot
    counts = materialize(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(*keys, F.ceil(F.col("__n") / hot).cast("int").alias("__salts")))
    return None if counts.isEmpty() else counts


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], how: str = "inner", hot: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with lookup, where a key may hold a third of all rows.

    A lookup measured to be small is broadcast. Else the keys with more than `hot` rows are counted out (there are at most
    count(rows) / hot of them); only their lookup rows are repeated, once for each task that their rows are spread over.
    Rows with a null key match nothing. counted: a cheaper table with as many rows of each key, if the lookup is known to be large.
    """
    hinted = small(lookup) if counted is None else lookup
    if hinted is not lookup:
        return rows.join(hinted, keys, how)
    return salted_join(rows, lookup, keys, spread, hot_keys(rows if counted is None else counted, keys, hot), how)


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], hot: DataFrame | None, how: str = "inner", sized: bool = False) -> DataFrame:
    """spread_join() of tables known to be large, with the hot keys counted before; sized: in as many tasks as by_size() gives rows."""
    if hot is None:
        return (by_size(rows, *keys) if sized else rows).join(lookup, keys, how)
    counts = small(hot)
    cut = rows.join(counts, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    many = lookup.join(counts, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return (by_size(cut, *keys, "__salt") if sized else cut).join(many, [*keys, "__salt"], how).drop("__salt")
