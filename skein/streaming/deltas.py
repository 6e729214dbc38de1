"""The delta log as a stream: append-only rows (generation, op, key, columns), applied in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions.shared import shared_path
from skein.operators.delta import apply_map


#: Micro-batches after which the kept deltas are folded into a new state.
FOLD = 16


class OutOfOrder(Exception):
    """A generation that doesn't follow the last one that was applied."""


def follow(spark: SparkSession, log: str, schema: StructType, base: DataFrame, key: str = "id", start: int = 0, per_batch: int = 8, fold: int = FOLD) -> tuple[DataFrame, int]:
    """Apply all that the log holds now to base: (state, last generation).

    A micro-batch writes only its own keys' last operations; the state is written anew every `fold` batches, so a small change
    never rewrites a large state, and what was folded is deleted. Memory holds none of it. Generations must come without
    gaps; a missing or late one is an error, not a late event to drop.
    """
    at = {"state": base, "generation": start, "folder": None, "deltas": []}
    where = shared_path(spark)
    order = list(base.columns)

    def merged() -> DataFrame:
        """The state with the kept deltas: the last operation on each key, one join for all of them."""
        if not at["deltas"]:
            return at["state"]
        every = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in at["deltas"]])
        rest = [c for c in every.columns if c != key]
        last = every.groupBy(key).agg(F.max_by(F.struct(*rest), "generation").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
        return apply_map(at["state"], last.drop("generation"), key).select(*order)

    def apply(batch: DataFrame, epoch: int) -> None:
        found = [r[0] for r in batch.select("generation").distinct().orderBy("generation").collect()]
        for g in found:
            if g != at["generation"] + 1:
                raise OutOfOrder(f"generation {g} after {at['generation']}")
            at["generation"] = g
        if not found:
            return
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), "generation").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
        last.write.mode("overwrite").parquet(f"{where}/delta-{epoch}")
        at["deltas"].append(f"{where}/delta-{epoch}")
        if len(at["deltas"]) >= fold:
            state, old = merged(), [*at["deltas"], *([at["folder"]] if at["folder"] else [])]
            at["folder"] = f"{where}/state-{epoch}"
            state.write.mode("overwrite").parquet(at["folder"])
            at["state"], at["deltas"] = spark.read.schema(state.schema).parquet(at["folder"]), []
            for path in old:
                gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(log)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(), at["generation"]
