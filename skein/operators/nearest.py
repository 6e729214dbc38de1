"""Exact nearest neighbours by cosine distance, vector upkeep, and the embedding pipeline around a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.vectors import cosine_distance, sanitize, storable

FIELDS = ("provider", "model", "revision", "epoch", "dims", "embedder", "stamp")


def knn(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, key: str = "id", vec: str = "embedding") -> DataFrame:
    """(key, distance) of the k nearest, ties by key. A condition applies before the top is taken, which is a heap per task and never a sort of all."""
    v = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return v.select(key, F.round(cosine_distance(F.col(vec), q), 6).alias("distance")).orderBy("distance", key).limit(k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vec: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, key, distance) of the k nearest of every query row (query, q), exactly. Queries come in blocks of bounded size against all rows: numpy keeps the k best of a task's rows, and only these are shuffled."""
    blocks, parts = max(1, -(-queries.count() // block)), []
    for b in range(blocks):
        asked = queries.select("query", "q").where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()
        ids, q = asked["query"].tolist(), asked["q"].tolist()
        parts.append(vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).mapInArrow(_best_of(ids, q, k), "query long, id long, distance double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("__r", rank).where(F.col("__r") <= k).select("query", F.col("id").alias(key), "distance")


def _matrix(column: pa.Array) -> np.ndarray:
    """One row of unit length (or zero) for each vector."""
    x = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _best_of(ids: list, q: list, k: int):
    unit = np.array(q, np.float64).reshape(len(ids), -1)
    unit = unit / np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), 1e-300)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            d = np.round(1 - unit @ _matrix(batch.column(1)).T, 6) + 0.0
            top = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[rows]), pa.array(own[top.ravel()].astype(np.int64)), pa.array(d[rows, top.ravel()])], names=["query", "id", "distance"])

    return run


def fit_lists(vectors: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 12, key: str = "id", vec: str = "embedding") -> np.ndarray:
    """Centres of an inverted-list index: spherical k-means over at most `sample` rows, those of least id hash."""
    x = _matrix(pa.array(vectors.select(vec, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(sample).toPandas()[vec].tolist()))
    lists = max(1, min(lists, len(x)))
    centres = x[:lists].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def with_list(vectors: DataFrame, centres: np.ndarray, vec: str = "embedding") -> DataFrame:
    """vectors with the number of their nearest centre in `list`. Written with partitionBy("list"), a search reads the lists it probes only."""

    @F.pandas_udf("int")
    def nearest_list(col: pd.Series) -> pd.Series:
        return pd.Series((_matrix(pa.array(col.tolist())) @ centres.T).argmax(axis=1).astype("int32") if len(col) else [], dtype="int32")

    return vectors.withColumn("list", nearest_list(F.col(vec)))


def ann_search(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, key: str = "id", vec: str = "embedding") -> DataFrame:
    """(query, key, distance): the k nearest among the rows of each query's `probes` nearest lists. With all lists probed it's exact. queries: a block that the driver can hold."""
    asked = queries.select("query", "q").toPandas()
    if not len(asked):
        return knn_many(indexed, queries, k, key, vec)
    order = np.argsort(-(_matrix(pa.array(asked["q"].tolist())) @ centres.T), axis=1, kind="stable")[:, :probes]
    spark, parts = indexed.sparkSession, None
    for at in sorted(set(order.ravel().tolist())):
        rows = [(int(i), [float(v) for v in q]) for i, q, probed in zip(asked["query"], asked["q"], order) if at in probed]
        own = indexed.where(F.col("list") == at).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).mapInArrow(_best_of([r[0] for r in rows], [r[1] for r in rows], k), "query long, id long, distance double")
        parts = own if parts is None else parts.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return parts.withColumn("__r", rank).where(F.col("__r") <= k).select("query", F.col("id").alias(key), "distance")


def semantic_search(vectors: DataFrame, text: str, k: int, model: Callable[[list[str]], list[list[float]]], where: Column | None = None, key: str = "id", vec: str = "embedding") -> DataFrame:
    """(key, distance): embed the query with the model that made the vectors, then the k nearest."""
    return knn(vectors, check_response(list(enumerate(model([text]))), 1)[0], k, where, key, vec)


def with_roles(found: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Neighbours with the role of their entity, null for others; distances are as they were."""
    return found.join(entities.select(key, "role"), key, "left")


def remove_vectors(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def key_set_token(vectors: DataFrame, key: str = "id") -> str:
    """A token of the set of keys, whatever their order."""
    r = vectors.select(key).distinct().agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(key)), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), F.col(key))), F.lit(0)).alias("y")).first()
    return f"{r['n']}:{r['x']}:{r['y']}"


def upsert_vectors(base: DataFrame, rows: DataFrame, dims: int, key: str = "id", vec: str = "embedding") -> DataFrame:
    """Keyed replacement; running it fails on a vector of another length."""
    checked = rows.withColumn(vec, F.when(F.size(vec) == dims, F.col(vec)).otherwise(F.raise_error(F.lit(f"a vector hasn't {dims} elements")).cast(rows.schema[vec].dataType)))
    return base.join(rows.select(key), key, "left_anti").unionByName(checked)


def sanitized(vectors: DataFrame, dims: int, vec: str = "embedding") -> DataFrame:
    return vectors.withColumn(vec, sanitize(F.col(vec), dims))


def missing_vectors(entities: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    return entities.join(vectors.select(key), key, "left_anti").select(key)


def orphan_vectors(entities: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    return vectors.join(entities.select(key), key, "left_anti").select(key)


def count_present(vectors: DataFrame, keys: DataFrame, key: str = "id") -> int:
    return keys.select(key).distinct().join(vectors.select(key), key, "left_semi").count()


def salvage(vectors: DataFrame, live: DataFrame, key: str = "id") -> tuple[DataFrame, int]:
    """Vectors whose key lives, and how many were retired."""
    return vectors.join(live.select(key), key, "left_semi"), vectors.join(live.select(key), key, "left_anti").count()


def classify_sidecar(stored: dict, current: dict) -> tuple[str, str | None]:
    """exact, stamp_drift or refuse, with the first field that differs; a zero stamp is refused."""
    for f in FIELDS[:-1]:
        if stored.get(f) != current.get(f):
            return "refuse", f
    if not stored.get("stamp") or not str(stored["stamp"]).strip("0"):
        return "refuse", "stamp"
    return ("exact", None) if stored["stamp"] == current.get("stamp") else ("stamp_drift", "stamp")


def cache_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def split_misses(texts: DataFrame, cache: DataFrame, namespace: str, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with hash, distinct misses): equal texts are embedded once."""
    hashed = texts.select(key, text, cache_key(F.col(text)).alias("hash"))
    known = cache.where(F.col("namespace") == namespace).select("hash")
    return hashed, hashed.select("hash", text).dropDuplicates(["hash"]).join(known, "hash", "left_anti")


def embed_all(texts: DataFrame, cache: DataFrame, namespace: str, model: Callable[[list[str]], list[list[float]]], dims: int, key: str = "id", text: str = "text", token_budget: int = 32_768) -> tuple[DataFrame, DataFrame]:
    """(key, embedding) of all texts, and the new cache rows. Misses are embedded once each, in packed batches, and scattered back by hash."""
    hashed, misses = split_misses(texts, cache, namespace, key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for batch in pack_batches([len(t) // 4 + 1 for t in f[text]], token_budget):
                part = f.iloc[batch]
                yield pd.DataFrame({"hash": part["hash"].to_numpy(), "embedding": check_response(list(enumerate(model(part[text].tolist()))), len(part))})

    fresh = sanitized(misses.mapInPandas(run, T.StructType([T.StructField("hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])), dims)
    new = fresh.where(storable(F.col("embedding"))).select(F.lit(namespace).alias("namespace"), "hash", "embedding")
    every = cache.where(F.col("namespace") == namespace).select("hash", "embedding").unionByName(fresh)
    return hashed.join(every, "hash").select(key, "embedding"), new


def pack_batches(lengths: list[int], token_budget: int, area_cap: int = 8_388_608) -> list[list[int]]:
    """Positions in batches: longest first, closed when the tokens or count * longest squared would pass their limits. One item is always admitted."""
    out: list[list[int]] = []
    batch: list[int] = []
    used = longest = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        top = max(longest, lengths[i])
        if batch and (used + lengths[i] > token_budget or (len(batch) + 1) * top * top > area_cap):
            out.append(batch)
            batch, used, top = [], 0, lengths[i]
        batch.append(i)
        used, longest = used + lengths[i], top
    return [*out, batch] if batch else out


def split_devices(weights: list[int], ratio: float) -> tuple[list[int], list[int]]:
    """Positions for a slow and a fast device: the slow one takes the shortest that fit a share of 1 / (ratio + 1)."""
    target, used, slow, fast = sum(weights) / (ratio + 1), 0, [], []
    for i in sorted(range(len(weights)), key=lambda i: (weights[i], i)):
        if used + weights[i] <= target:
            slow.append(i)
            used += weights[i]
        else:
            fast.append(i)
    return slow, fast


def check_response(rows: list[tuple[int, list[float]]], n: int) -> list[list[float]]:
    """Vectors in the order of their indexes; refuses an index that is out of range, repeated or missing."""
    out: list = [None] * n
    for i, v in rows:
        if not 0 <= i < n:
            raise ValueError(f"index {i} is out of range")
        if out[i] is not None:
            raise ValueError(f"index {i} came twice")
        out[i] = v
    if None in out:
        raise ValueError(f"index {out.index(None)} is missing")
    return out


def rerank(query: str, docs: DataFrame, model: Callable[[str, list[str]], list[float]], text: str = "text") -> DataFrame:
    """docs with the score that a model gives each text."""

    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        return pd.Series(model(query, col.tolist())) if len(col) else pd.Series([], dtype=float)

    return docs.withColumn("score", score(F.col(text)))


def provider(env: dict[str, str]) -> str:
    """The embedding provider that settings name; unknown ones mean local."""
    name = env.get("SKEIN_EMBED_PROVIDER", "local").strip().lower()
    return name if name in ("local", "openai", "lmstudio", "compatible") else "local"
