"""Authority frames: a chain of changes to the authority's tables, each frame sealed over the one before.

A frame is a small manifest (sequence, hash of the previous frame, tables with the digest of their delta rows); the rows
themselves are Parquet. Frames are drained into a log, verified as a chain, applied to a copy and proved against a target.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from skein.operators.delta import apply_map, diff_map, prove
from skein.sources.catalog import CatalogError, Conflict, Files, digest, sealed, unsealed

FORMAT = 2


def encode(frame: dict) -> bytes:
    return sealed(frame | {"format": FORMAT})


def decode(data: bytes) -> dict:
    frame = unsealed(data)
    if frame is None:
        raise CatalogError("the frame is cut off")
    if frame.get("format") != FORMAT:
        raise CatalogError(f"frames of format {frame.get('format')} aren't read")
    if set(frame) != {"format", "sequence", "previous", "tables", "keys"}:
        raise CatalogError("the frame has unknown or missing fields")
    return frame


class FrameLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def _name(self, n: int) -> str:
        return f"frames/frame-{n:012d}.json"

    def sequences(self) -> list[int]:
        return [int(m[1]) for n in self.files.names("frames") if (m := re.fullmatch(r"frame-(\d{12})\.json", n))]

    def frames(self, since: int = 0) -> list[dict]:
        """All frames after a sequence number, checked: no gap, and every one names the hash of the one before."""
        out, previous = [], ""
        for i, n in enumerate(sorted(self.sequences()), 1):
            raw = self.files.read(self._name(n))
            f = decode(raw)
            if n != i or f["sequence"] != i or f["previous"] != previous:
                raise CatalogError(f"frame {n} doesn't follow the one before")
            previous = hashlib.sha256(raw).hexdigest()
            if n > since:
                out.append(f)
        return out

    def drain(self, old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, str] | None = None) -> int | None:
        """Append the changes between two states as one frame; None if there are none."""
        keys, tables = keys or {}, {}
        for t, df in sorted(new.items()):
            d = diff_map(old[t], df, keys.get(t, "id"))
            path = f"frames/data/{t}-{uuid.uuid4().hex}"
            d.write.parquet(f"{self.root}/{path}")
            what = digest(self.spark.read.schema(d.schema).parquet(f"{self.root}/{path}"))
            if what["rows"]:
                tables[t] = {"path": path, "schema": d.schema.json(), **what}
        if not tables:
            return None
        n = len(self.frames())
        previous = hashlib.sha256(self.files.read(self._name(n))).hexdigest() if n else ""
        if not self.files.create(self._name(n + 1), encode({"sequence": n + 1, "previous": previous, "tables": tables, "keys": keys})):
            raise Conflict(f"frame {n + 1} is already there")
        return n + 1

    def apply(self, base: dict[str, DataFrame], since: int = 0) -> dict[str, DataFrame]:
        """base with the frames after a sequence number, each table's rows checked against their digest."""
        out = dict(base)
        for f in self.frames(since):
            for t, e in f["tables"].items():
                d = self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{self.root}/{e['path']}")
                if digest(d) != {"rows": e["rows"], "hash": e["hash"]}:
                    raise CatalogError(f"{e['path']} doesn't match its digest")
                out[t] = apply_map(out[t], d, f["keys"].get(t, "id"))
        return out

    def prove(self, base: dict[str, DataFrame], target: dict[str, DataFrame], since: int = 0) -> str | None:
        """The first table that the frames don't bring to its target; None if all match."""
        return prove(self.apply(base, since), target)
