"""Indexes kept beside a catalog: versions of tables with a descriptor that says what they were made from.

A version's folders are written first, then its descriptor is published whole, so a reader sees an old version or a new one.
An index is opened only if its stamp or descriptor fits what it's wanted for; otherwise it's built anew.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators import nearest, search
from skein.operators.index import distinct_incoming
from skein.sources.catalog import CatalogError, Files, sealed, unsealed


class Sidecars:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.files, self.root, self.read_only = spark, Files(spark, root), root.rstrip("/"), read_only

    def versions(self, name: str) -> list[int]:
        return [int(m[1]) for n in self.files.names("sidecars") if (m := re.fullmatch(rf"{re.escape(name)}-(\d{{12}})\.json", n))]

    def peek(self, name: str) -> dict | None:
        """The descriptor of the newest whole version; no table is read."""
        for v in sorted(self.versions(name), reverse=True):
            if (m := unsealed(self.files.read(f"sidecars/{name}-{v:012d}.json"))) is not None:
                return m
        return None

    def save(self, name: str, tables: dict[str, DataFrame], descriptor: dict, partition: dict[str, str] | None = None) -> int:
        if self.read_only:
            raise CatalogError("the sidecars were opened read-only")
        entries = {}
        for t, df in sorted(tables.items()):
            path = f"sidecars/data/{name}-{t}-{uuid.uuid4().hex}"
            w = df.write.partitionBy(partition[t]) if partition and t in partition else df.write
            w.parquet(f"{self.root}/{path}")
            entries[t] = {"path": path, "schema": df.schema.json()}
        version = max([0, *self.versions(name)]) + 1
        if not self.files.create(f"sidecars/{name}-{version:012d}.json", sealed({"name": name, "version": version, "descriptor": descriptor, "tables": entries})):
            raise CatalogError(f"version {version} of {name} is already published")
        return version

    def load(self, name: str) -> tuple[dict, dict[str, DataFrame]] | None:
        m = self.peek(name)
        if m is None:
            return None
        return m["descriptor"], {t: self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{self.root}/{e['path']}") for t, e in m["tables"].items()}


class TextIndex:
    """Postings with staged changes: searches see what was committed, and an upsert replaces a document."""

    def __init__(self, store: Sidecars, key_type: str, name: str = "text", key: str = "id"):
        self.store, self.name, self.key = store, name, key
        found = store.load(name)
        self.stamp = found[0].get("stamp") if found else None
        empty = lambda s: store.spark.createDataFrame([], s)
        self.post = found[1]["postings"] if found else empty(f"token string, {key} {key_type}, tf double, length int")
        self.lengths = found[1]["lengths"] if found else empty(f"{key} {key_type}, length int")
        self._puts: DataFrame | None = None
        self._gone: DataFrame | None = None

    @staticmethod
    def peek_stamp(store: Sidecars, name: str = "text") -> str | None:
        m = store.peek(name)
        return m["descriptor"].get("stamp") if m else None

    def upsert(self, fielded: DataFrame) -> None:
        """fielded: (key, fields). Later ones replace earlier ones of the same key."""
        keys = fielded.select(self.key)
        self._puts = fielded if self._puts is None else self._puts.join(keys, self.key, "left_anti").unionByName(fielded)
        self._gone = keys if self._gone is None else self._gone.unionByName(keys)

    def remove(self, keys: DataFrame) -> None:
        keys = keys.select(self.key)
        if self._puts is not None:
            self._puts = self._puts.join(keys, self.key, "left_anti")
        self._gone = keys if self._gone is None else self._gone.unionByName(keys)

    def rebuild(self, fielded: DataFrame) -> None:
        """Stage fielded as the whole index."""
        self._puts, self._gone = fielded, self.lengths.select(self.key)

    def rollback(self) -> None:
        self._puts = self._gone = None

    def commit(self, stamp: str | None = None) -> int:
        post, lengths = self.post, self.lengths
        if self._gone is not None:
            gone = self._gone.distinct()
            post, lengths = post.join(gone, self.key, "left_anti"), lengths.join(gone, self.key, "left_anti")
        if self._puts is not None:
            fresh = search.postings(self._puts, self.key)
            post = post.unionByName(fresh.select(*post.columns))
            lengths = lengths.unionByName(fresh.select(*lengths.columns).distinct())
        version = self.store.save(self.name, {"postings": post, "lengths": lengths}, {"stamp": stamp if stamp is not None else self.stamp})
        descriptor, tables = self.store.load(self.name)
        self.post, self.lengths, self.stamp = tables["postings"], tables["lengths"], descriptor["stamp"]
        self.rollback()
        return version

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        return search.search_postings(self.post, self.lengths, query, limit, self.key)

    def doc_frequency(self, query: str) -> int:
        return search.doc_frequency(self.post, query)

    def live_document_count(self) -> int:
        return self.lengths.count()

    def contains(self, keys: DataFrame) -> DataFrame:
        """(key, contained) for the keys asked."""
        return keys.select(self.key).join(self.lengths.select(self.key, F.lit(True).alias("__c")), self.key, "left").select(self.key, F.coalesce("__c", F.lit(False)).alias("contained"))


class VectorIndex:
    """Vectors by key, their descriptor (provider, model, revision, epoch, dims, embedder, stamp) and, once fitted, inverted lists."""

    def __init__(self, store: Sidecars, descriptor: dict, vectors: DataFrame, name: str = "vectors", key: str = "id", vec: str = "embedding"):
        self.store, self.descriptor, self.vectors, self.name, self.key, self.vec = store, descriptor, vectors, name, key, vec
        self.dimensions = int(descriptor["dims"])

    @classmethod
    def load_compatible(cls, store: Sidecars, current: dict, live: DataFrame | None = None, name: str = "vectors", key: str = "id", vec: str = "embedding") -> tuple[VectorIndex | None, str, str | None]:
        """(index, exact | stamp_drift | refuse | absent, first field that differs). After drift only vectors of live keys are salvaged."""
        found = store.load(name)
        if found is None:
            return None, "absent", None
        what, field = nearest.classify_sidecar(found[0], current)
        if what == "refuse":
            return None, what, field
        vectors = found[1]["vectors"]
        if what == "stamp_drift" and live is not None:
            vectors, _ = nearest.salvage(vectors, live, key)
        return cls(store, current, vectors, name, key, vec), what, field

    def upsert(self, rows: DataFrame) -> None:
        self.vectors = nearest.upsert_vectors(self.vectors, rows.select(*self.vectors.columns), self.dimensions, self.key, self.vec)

    def remove(self, keys: DataFrame) -> None:
        self.vectors = nearest.remove_vectors(self.vectors, keys, self.key)

    def get(self, key) -> list[float] | None:
        r = self.vectors.where(F.col(self.key) == key).select(self.vec).first()
        return list(r[0]) if r else None

    def contains(self, key) -> bool:
        return not self.vectors.where(F.col(self.key) == key).isEmpty()

    def keys(self) -> DataFrame:
        return self.vectors.select(self.key)

    def key_set_token(self) -> str:
        return nearest.key_set_token(self.vectors, self.key)

    def __len__(self) -> int:
        return self.vectors.count()

    def save(self, stamp: str | None = None) -> int:
        if stamp is not None:
            self.descriptor = self.descriptor | {"stamp": stamp}
        version = self.store.save(self.name, {"vectors": self.vectors}, self.descriptor)
        self.vectors = self.store.load(self.name)[1]["vectors"]
        return version

    def search(self, query: list[float], k: int, where=None) -> DataFrame:
        return nearest.knn(self.vectors, query, k, where, self.key, self.vec)


def save_read_index(store: Sidecars, entities: DataFrame, relations: DataFrame, stamp: str) -> int:
    """The views that reads start from: entities by file and kind with their name tokens, and distinct incoming counts."""
    from skein.functions.names import tokens

    names = entities.select("id", "kind", "file_origin", F.lower("name").alias("low"), tokens(F.col("name")).alias("tokens")).sortWithinPartitions("file_origin", "kind")
    return store.save("read-index", {"names": names, "incoming": distinct_incoming(relations)}, {"stamp": stamp})


def load_read_index(store: Sidecars, stamp: str) -> dict[str, DataFrame] | None:
    """The views, or None if there are none or they were made from another graph."""
    found = store.load("read-index")
    return found[1] if found and found[0]["stamp"] == stamp else None


def embed_with_checkpoints(store: Sidecars, texts: DataFrame, namespace: str, model: Callable[[list[str]], list[list[float]]], dims: int, parts: int = 8, key: str = "id", text: str = "text", name: str = "embed-progress") -> DataFrame:
    """(hash, embedding) of all distinct texts, embedded part by part; each part is published when it's done, so a run that was cut off goes on where it was.

    Parts are ranges of the texts' hashes, so the same text falls into the same part in every run.
    """
    part_of = F.pmod(F.xxhash64(nearest.cache_key(F.col(text))), F.lit(parts))
    found = store.load(name)
    done, cache = (found[0]["parts"], found[1]["cache"]) if found and found[0]["namespace"] == namespace and found[0]["of"] == parts else ([], store.spark.createDataFrame([], "namespace string, hash string, embedding array<float>"))
    for p in range(parts):
        if p not in done:
            _, new = nearest.embed_all(texts.where(part_of == p), cache, namespace, model, dims, key, text)
            done = [*done, p]
            store.save(name, {"cache": cache.unionByName(new)}, {"namespace": namespace, "of": parts, "parts": done})
            cache = store.load(name)[1]["cache"]
    return cache.select("hash", "embedding")
