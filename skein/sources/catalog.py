"""A versioned catalog of tables on any Hadoop file system.

A generation is a manifest file that names the Parquet folders of a full snapshot and of the deltas on top of it, with a
digest of each. Folders are written first; the manifest of generation n + 1 is then written under a temporary name and
moved to its own, which fails if another writer was faster. Readers only ever see whole generations: a manifest that an
interrupted writer left torn is passed over, and `recover` promotes what was complete and discards the rest. Tables
stay columnar and untouched by the driver; only manifests pass through it.

Moving without overwriting is atomic on HDFS (rename) and on local disks (hard links). Object stores without conditional
writes need the writer lock, which every writer takes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.delta import apply_map, diff_map, live_relations, merge_hot_into_cold, reference_problems, tree_problems
from skein.operators.index import fits_hot, partial_hydrate

VERSION = 1
#: Seconds after which a lock file on a file system without real locks counts as left behind.
LEASE = 3600


class CatalogError(Exception):
    """A catalog that can't be read or written as asked."""


class Conflict(CatalogError):
    """Another writer published the generation first, or holds the lock."""


class Rejected(CatalogError):
    """A delta that its guards refuse; nothing was published."""


class Files:
    """The few operations needed of the file system that holds a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self.conf)
        self.local = str(self.fs.getUri().getScheme()) == "file"

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def at(self, name: str) -> Path:
        """A name's place on a local disk."""
        return Path(str(self._path(f"{self.root}/{name}").toUri().getPath()))

    def names(self, sub: str = "") -> list[str]:
        at = self._path(f"{self.root}/{sub}")
        return sorted(n for s in self.fs.listStatus(at) if not (n := s.getPath().getName()).startswith(".")) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(f"{self.root}/{name}")).getLength()

    def stage(self, name: str, data: bytes) -> str:
        """Write data in full under a temporary name, which is given back."""
        temp = f"tmp/{name.replace('/', '~')}.{uuid.uuid4().hex}"
        if self.local:
            at = self.at(temp)
            at.parent.mkdir(parents=True, exist_ok=True)
            with at.open("wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        else:
            out = self.fs.create(self._path(f"{self.root}/{temp}"), True)
            out.write(bytearray(data))
            out.hsync()
            out.close()
        return temp

    def move(self, old: str, new: str) -> bool:
        """Rename a file; False if the new name is taken."""
        if self.local and self.at(old).is_file():
            self.at(new).parent.mkdir(parents=True, exist_ok=True)
            try:
                os.link(self.at(old), self.at(new))
            except FileExistsError:
                return False
            self.at(old).unlink()
            return True
        return self.rename(old, new)

    def rename(self, old: str, new: str) -> bool:
        """The same by the file system's own rename, for folders too."""
        to = self._path(f"{self.root}/{new}")
        self.fs.mkdirs(to.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(self._path(f"{self.root}/{old}"), to, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def create(self, name: str, data: bytes) -> bool:
        """Publish a new file whole; False if the name is taken."""
        if self.exists(name):
            return False
        temp = self.stage(name, data)
        if not self.move(temp, name):
            self.delete(temp)
            return False
        return True

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


class Lock:
    """One writer, or any number of readers that want the folders they read to stay.

    Local disks have locks that end with the process. Elsewhere lock files are used, which count as left behind after LEASE seconds.
    """

    def __init__(self, files: Files, shared: bool = False, wait: float = 0):
        self.files, self.shared, self.wait = files, shared, wait
        self.name, self.handle = f"locks/{'reader' if shared else 'writer'}-{uuid.uuid4().hex}", None

    def _held(self) -> bool:
        for n in self.files.names("locks"):
            if n != self.name.split("/")[1] and not (self.shared and n.startswith("reader-")):
                try:
                    since = float(self.files.read(f"locks/{n}") or b"0")
                except Exception:  # let go meanwhile
                    continue
                if time.time() - since < LEASE:
                    return True
                self.files.delete(f"locks/{n}")
        return False

    def _try(self) -> bool:
        if self.files.local:
            import fcntl

            at = self.files.at(".lock")
            at.parent.mkdir(parents=True, exist_ok=True)
            self.handle = at.open("a")
            try:
                fcntl.flock(self.handle, (fcntl.LOCK_SH if self.shared else fcntl.LOCK_EX) | fcntl.LOCK_NB)
            except OSError:
                self.handle.close()
                return False
            return True
        self.files.create(self.name, str(time.time()).encode())
        if self._held():
            self.files.delete(self.name)
            return False
        return True

    def __enter__(self) -> Lock:
        until = time.time() + self.wait
        while not self._try():
            if time.time() >= until:
                raise Conflict("the catalog is locked by another " + ("writer" if self.shared else "writer or reader"))
            time.sleep(0.1)
        return self

    def __exit__(self, *_) -> None:
        if self.files.local:
            self.handle.close()
        else:
            self.files.delete(self.name)


def digest(df: DataFrame) -> dict:
    """Rows and an order-free hash of all their columns, in one pass with map-side combination."""
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.coalesce(F.sum(F.xxhash64(F.lit(7), *df.columns).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return {"rows": r["n"], "hash": f"{r['x'] or 0}:{r['s']}"}


def sealed(m: dict) -> bytes:
    """A manifest as bytes with its checksum."""
    m = {k: v for k, v in m.items() if k != "sha256"}
    return json.dumps(m | {"sha256": hashlib.sha256(json.dumps(m, sort_keys=True).encode()).hexdigest()}, sort_keys=True).encode()


def unsealed(data: bytes) -> dict | None:
    """A manifest, or None if its bytes are cut off. One that is whole but doesn't match its checksum is an error."""
    try:
        m = json.loads(data)
        own = m.pop("sha256")
    except (ValueError, AttributeError, KeyError, TypeError):
        return None
    if hashlib.sha256(json.dumps(m, sort_keys=True).encode()).hexdigest() != own:
        raise CatalogError("the manifest doesn't match its checksum")
    return m


class GraphCatalog:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.files, self.root, self.read_only = spark, Files(spark, root), root.rstrip("/"), read_only
        self._lock: Lock | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, mode: str = "write", bootstrap: dict[str, DataFrame] | None = None, wait: float = 0) -> GraphCatalog:
        """mode `write` holds the writer's lock until close(), `read` keeps writers from cleaning up, `locate` only reads manifests and takes none. bootstrap: tables of an empty catalog's first snapshot."""
        c = cls(spark, root, read_only=mode != "write")
        if mode != "locate":
            c._lock = Lock(c.files, shared=mode == "read", wait=wait).__enter__()
        if mode == "write":
            c.recover()
            if bootstrap is not None and c.head() is None:
                c.save(bootstrap)
        return c

    def close(self) -> None:
        if self._lock:
            self._lock.__exit__()
            self._lock = None

    def _writing(self):
        """The writer's lock for one change, unless it's held already."""
        from contextlib import nullcontext

        if self.read_only:
            raise CatalogError("the catalog was opened read-only")
        return nullcontext() if self._lock else Lock(self.files, wait=30)

    # manifests

    def generations(self) -> list[int]:
        return [int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"manifest-(\d{12})\.json", n))]

    def _manifest(self, generation: int) -> dict | None:
        return unsealed(self.files.read(f"manifest-{generation:012d}.json"))

    def head(self) -> dict | None:
        all_ = sorted(self.generations(), reverse=True)
        m = next((x for g in all_ if (x := self._manifest(g)) is not None), None)
        if m is None:
            if not all_ and self.files.names("data"):
                raise CatalogError("there are tables but no manifest")
            return None
        if m["version"] != VERSION:
            raise CatalogError(f"version {m['version']} isn't supported")
        if unknown := set(m) - {"version", "generation", "snapshot", "tables", "deltas", "keys", "kinds", "retired"}:
            raise CatalogError(f"unknown fields {sorted(unknown)}")
        if lacking := {"generation", "snapshot", "tables", "deltas", "keys"} - set(m):
            raise CatalogError(f"fields {sorted(lacking)} are missing")
        last = m["snapshot"]
        for d in m["deltas"]:
            if d["generation"] != last + 1:
                raise CatalogError(f"delta {d['generation']} doesn't follow {last}")
            last = d["generation"]
        return m

    def _publish(self, m: dict) -> int:
        name = f"manifest-{m['generation']:012d}.json"
        if self.files.exists(name) and self._manifest(m["generation"]) is None:
            self.files.move(name, f"torn/{name}.{uuid.uuid4().hex}")
        if not self.files.create(name, sealed(m)):
            raise Conflict(f"generation {m['generation']} is already published")
        return m["generation"]

    def _write(self, tables: dict[str, DataFrame]) -> dict:
        out = {}
        for name, df in sorted(tables.items()):
            path = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{path}")
            out[name] = {"path": path, "schema": df.schema.json(), **digest(self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}"))}
        return out

    def _read(self, entry: dict, verify: bool) -> DataFrame:
        from pyspark.sql.types import StructType

        df = self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{entry['path']}")
        if verify and digest(df) != {"rows": entry["rows"], "hash": entry["hash"]}:
            raise CatalogError(f"{entry['path']} doesn't match its digest")
        return df

    @staticmethod
    def _entries(m: dict) -> list[dict]:
        return [*m["tables"].values(), *(x for d in m["deltas"] for x in d["tables"].values())]

    # snapshots and deltas

    def save(self, tables: dict[str, DataFrame], expected: int | None = None, keys: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> int:
        """Publish a full snapshot as the next generation; expected is the generation that the caller saw. kinds: `tree` or `references` for tables whose deltas have guards."""
        with self._writing():
            now = self.head()
            at = now["generation"] if now else 0
            if expected is not None and expected != at:
                raise Conflict(f"expected generation {expected}, found {at}")
            # What earlier generations retired stays listed until it's gone.
            retired = [*self._entries(now), *(e for e in now.get("retired", []) if self.files.exists(e["path"]))] if now else []
            return self._publish({"version": VERSION, "generation": at + 1, "snapshot": at + 1, "tables": self._write(tables), "deltas": [], "keys": keys or {}, "kinds": kinds if kinds is not None else (now or {}).get("kinds", {}), "retired": retired})

    def save_delta(self, deltas: dict[str, DataFrame], expected: int | None = None, validate: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> int | None:
        """Publish rows (op, key, columns) on top of the head; None if all are empty.

        All or nothing: keys named twice, the guards of the tables' kinds and `validate` (problems of the tables as they would
        be) are looked at before anything is published; any problem rejects the whole delta.
        """
        with self._writing():
            now = self.head()
            if now is None:
                raise CatalogError("there is no snapshot to build on")
            if expected is not None and expected != now["generation"]:
                raise Conflict(f"expected generation {expected}, found {now['generation']}")
            if unknown := set(deltas) - set(now["tables"]):
                raise CatalogError(f"unknown tables {sorted(unknown)}")
            some = {k: d for k, d in deltas.items() if not d.isEmpty()}
            if not some:
                return None
            base = self.load()
            for name, d in sorted(some.items()):
                key, kind = now["keys"].get(name, "id"), now.get("kinds", {}).get(name)
                self._refuse(f"{name}: operation", d.where(~F.col("op").isin("added", "modified", "removed")).select("op"))
                self._refuse(f"{name}: key named twice", d.groupBy(key).count().where("count > 1").select(key))
                if kind == "tree":
                    self._refuse(name, tree_problems(base[name], d))
                elif kind == "references":
                    self._refuse(name, reference_problems(base[name], d))
            if validate is not None:
                staged = {k: apply_map(t, some[k], now["keys"].get(k, "id")) if k in some else t for k, t in base.items()}
                self._refuse("as a whole", validate(staged))
            g = now["generation"] + 1
            return self._publish(now | {"generation": g, "deltas": [*now["deltas"], {"generation": g, "tables": self._write(some)}]})

    @staticmethod
    def _refuse(what: str, problems: DataFrame) -> None:
        if found := problems.limit(5).collect():
            raise Rejected(f"{what}: {[tuple(r) for r in found]}")

    def compute_delta(self, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
        old = self.load()
        keys = self.head()["keys"]
        return {k: diff_map(old[k], d, keys.get(k, "id")) for k, d in new.items()}

    def load(self, tables: list[str] | None = None, columns: dict[str, list[str]] | None = None, verify: bool = False) -> dict[str, DataFrame]:
        """Tables at the head, deltas replayed in order. Only those asked for are read, and only their columns."""
        m = self.head()
        if m is None:
            raise CatalogError("the catalog is empty")
        if absent := set(tables or ()) - set(m["tables"]):
            raise CatalogError(f"tables {sorted(absent)} are missing")
        out = {}
        for name in tables or sorted(m["tables"]):
            df = self._read(m["tables"][name], verify)
            for d in m["deltas"]:
                if name in d["tables"]:
                    df = apply_map(df, self._read(d["tables"][name], verify), m["keys"].get(name, "id"))
            out[name] = df.select(*columns[name]) if columns and name in columns else df
        return out

    def deltas_since(self, generation: int) -> list[dict]:
        if generation < 0:
            raise CatalogError("a generation isn't negative")
        m = self.head()
        return [d for d in (m["deltas"] if m else []) if d["generation"] > generation]

    def clear_deltas(self) -> int:
        """Fold the deltas into a new snapshot; then the folders that only older manifests name go through quarantine."""
        with self._writing():
            held, self._lock = self._lock, self._lock or Lock(self.files)
            try:
                m = self.head()
                g = self.save(self.load(), m["generation"], m["keys"])
            finally:
                self._lock = held
            for old in self.generations():
                if old < g:
                    self.files.delete(f"manifest-{old:012d}.json")
            for entry in self.head()["retired"]:
                if self.files.exists(entry["path"]):
                    place = f"quarantine/{g:012d}-{uuid.uuid4().hex}"
                    self.files.create(f"{place}/entry.json", sealed(entry))
                    self.files.rename(entry["path"], f"{place}/data")
            self.empty_quarantine()
            return g

    def empty_quarantine(self) -> int:
        """Delete quarantined folders whose rows still match their digest; one that doesn't stays and is an error. Goes on where an earlier clean-up was cut off."""
        from pyspark.sql.types import StructType

        n = 0
        for name in self.files.names("quarantine"):
            place = f"quarantine/{name}"
            entry = unsealed(self.files.read(f"{place}/entry.json")) if self.files.exists(f"{place}/entry.json") else None
            if entry is not None and self.files.exists(f"{place}/data"):
                df = self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{place}/data")
                if digest(df) != {"rows": entry["rows"], "hash": entry["hash"]}:
                    raise CatalogError(f"{place} isn't what was superseded; it isn't deleted")
            elif self.files.exists(f"{place}/data"):
                raise CatalogError(f"{place} doesn't say what it holds; it isn't deleted")
            self.files.delete(place)
            n += 1
        return n

    def recover(self) -> list[str]:
        """What an interrupted writer left: a manifest that is complete, follows the head and names whole folders is promoted; other temporary files and folders without a manifest are discarded."""
        done = []
        with self._writing():
            m = self.head()
            at = m["generation"] if m else 0
            for name in self.files.names("tmp"):
                kept = None
                if found := re.fullmatch(r"manifest-(\d{12})\.json\.[0-9a-f]{32}", name):
                    try:
                        kept = unsealed(self.files.read(f"tmp/{name}"))
                        for entry in self._entries(kept) if kept and kept["generation"] == at + 1 == int(found[1]) else ():
                            self._read(entry, True).count()
                    except Exception:  # a folder is missing or damaged
                        kept = None
                    if kept and kept["generation"] == at + 1 and self.files.move(f"tmp/{name}", f"manifest-{at + 1:012d}.json"):
                        done.append(f"promoted {at + 1}")
                        at += 1
                        continue
                self.files.delete(f"tmp/{name}")
                done.append(f"discarded tmp/{name}")
            for path in self.unnamed():
                self.files.delete(path)
                done.append(f"discarded {path}")
        return done

    def compact(self, nodes: str = "entities", relations: str = "relations") -> int | None:
        """Drop relations with a dead end; None, and nothing is written, if there are none."""
        m, t = self.head(), self.load()
        kept = live_relations(t[nodes], t[relations])
        return None if kept.count() == t[relations].count() else self.save(t | {relations: kept}, m["generation"], m["keys"])

    def unnamed(self) -> list[str]:
        """Folders that no whole manifest names: left by writers that were interrupted. Readers never see them."""
        named = {e["path"] for g in self.generations() if (m := self._manifest(g)) for e in [*self._entries(m), *m.get("retired", [])]}
        return [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in named]

    # tiers

    def load_tiered(self, budget: int, hot: int, nodes: str = "entities", relations: str = "relations") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """(hot, cold): all tables are hot if the snapshot fits the budget; else the first `hot` nodes and the relations between them, over all of the rest."""
        t, m = self.load(), self.head()
        if fits_hot(sum(self.files.size(e["path"]) for e in self._entries(m)), budget):
            return t, {k: d.limit(0) for k, d in t.items()}
        e, r = partial_hydrate(t[nodes], t[relations], hot)
        return t | {nodes: e, relations: r}, t

    def save_tiered(self, hot: dict[str, DataFrame], nodes: str = "entities", relations: str = "relations", expected: int | None = None) -> int:
        """Merge hot tables into the stored ones and publish: hot nodes replace by key, relations whose ends are gone are dropped."""
        m, cold = self.head(), self.load()
        out = dict(cold)
        for name, df in hot.items():
            out[name] = merge_hot_into_cold(df, cold[name], F.lit(False), m["keys"].get(name, "id"))
        if relations in out and nodes in out:
            out[relations] = live_relations(out[nodes], out[relations])
        return self.save(out, m["generation"] if expected is None else expected, m["keys"])

    # sidecars of a session, and blobs

    def save_overlay(self, repo: str, session: str, df: DataFrame) -> None:
        """A new version beside the old one, then a pointer to it; readers see either."""
        with self._writing():
            base, path = f"overlays/{repo}/{session}", f"overlays/{repo}/{session}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{path}")
            n = max([0, *(int(m[1]) for x in self.files.names(base) if (m := re.fullmatch(r"v(\d{12})", x)))])
            self.files.create(f"{base}/v{n + 1:012d}", path.encode())

    def load_overlay(self, repo: str, session: str) -> DataFrame | None:
        base = f"overlays/{repo}/{session}"
        versions = [n for n in self.files.names(base) if re.fullmatch(r"v\d{12}", n)]
        return self.spark.read.parquet(f"{self.root}/{self.files.read(f'{base}/{versions[-1]}').decode()}") if versions else None

    def delete_overlay(self, repo: str, session: str) -> None:
        with self._writing():
            self.files.delete(f"overlays/{repo}/{session}")

    def put_blob(self, data: bytes) -> str:
        """Store bytes under their hash; storing them again changes nothing, unless what is there is damaged."""
        with self._writing():
            name = hashlib.sha256(data).hexdigest()
            at = f"blobs/{name}"
            if not self.files.create(at, data) and (self.files.size(at) != len(data) or self.files.read(at) != data):
                self.files.move(at, f"torn/{name}.{uuid.uuid4().hex}")
                self.files.create(at, data)
            return name

    def get_blob(self, name: str, limit: int) -> bytes:
        """The bytes, if they are no more than the limit; that is known before any is read."""
        if self.files.size(f"blobs/{name}") > limit:
            raise CatalogError(f"blob {name} is larger than {limit} bytes")
        data = self.files.read(f"blobs/{name}")
        if hashlib.sha256(data).hexdigest() != name:
            raise CatalogError(f"blob {name} doesn't match its hash")
        return data


def list_repos(spark: SparkSession, root: str) -> list[str]:
    return [n for n in Files(spark, root).names() if any(x.startswith("manifest-") for x in Files(spark, f"{root}/{n}").names())]


def verified_blobs(blobs: DataFrame, limit: int) -> DataFrame:
    """blobs (sha256, bytes) with `ok`: the hash is right and the size within the limit."""
    return blobs.withColumn("ok", (F.octet_length("bytes") <= limit) & (F.sha2("bytes", 256) == F.col("sha256")))
