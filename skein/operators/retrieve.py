"""Hybrid retrieval: lexical, vector and structural arms merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOPS = 3
LIMIT = 50


def unified(entities: DataFrame, lexical: DataFrame | None = None, vector: DataFrame | None = None, hops: DataFrame | None = None, anchor=None, limit: int = LIMIT) -> DataFrame:
    """(id, lexical_score, vector_distance, graph_hops, role): any arm may be absent.

    The limit holds for the lexical and the vector arm each; the structural arm is unlimited and leaves the anchor out.
    There is no fused score: consumers order by what they need, here the result comes by key.
    """
    spark = entities.sparkSession
    kind = entities.schema["id"].dataType.simpleString()
    empty = lambda c, t: spark.createDataFrame([], f"id {kind}, {c} {t}")
    lex = lexical.orderBy(F.desc("score"), "id").limit(limit).select("id", F.col("score").alias("lexical_score")) if lexical is not None else empty("lexical_score", "double")
    vec = vector.orderBy("distance", "id").limit(limit).select("id", F.col("distance").alias("vector_distance")) if vector is not None else empty("vector_distance", "double")
    hop = hops.where(F.col("id") != anchor).select("id", F.col("hops").alias("graph_hops")) if hops is not None else empty("graph_hops", "int")
    merged = lex.join(vec, "id", "full_outer").join(hop, "id", "full_outer")
    roles = entities.select("id", "role") if "role" in entities.columns else entities.select("id", F.lit(None).cast("string").alias("role"))
    return merged.join(roles, "id", "left").orderBy("id")
