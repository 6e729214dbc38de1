"""Content hashes, their folds, and verification.

Hashes are SHA-256 over bytes that this engine defines; they detect change, they aren't meant to equal any other system's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.shared import by_size, hot_keys, materialize, salted_join, small
from skein.operators.traverse import reach


def entity_hash(columns: list[str], prefix: str = "entity-v1:") -> Column:
    """Hex hash of a prefix and the columns, each ended by a bar; nulls are empty."""
    return F.sha2(F.concat(F.lit(prefix), *[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")) for c in columns]).cast("binary"), 256)


def metadata_part(metadata: Column) -> Column:
    """Sorted `meta:key=json` parts of a map column."""
    return F.array_join(F.transform(F.sort_array(F.map_keys(metadata)), lambda k: F.concat(F.lit("meta:"), k, F.lit("="), metadata[k])), "")


@F.pandas_udf(T.BinaryType())
def float_bytes(x: pd.Series) -> pd.Series:
    """Four little-endian bytes of a float; Spark can't cast one to binary."""
    raw = x.to_numpy("<f4").tobytes()
    return pd.Series([raw[i : i + 4] for i in range(0, len(raw), 4)], index=x.index, dtype=object)


def relation_hash(kind: str = "kind", src: str = "src", dst: str = "dst", confidence: str = "confidence", origin: str = "origin") -> Column:
    text = lambda c: F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")).cast("binary")
    return F.sha2(F.concat(F.lit("relation-v1:").cast("binary"), text(kind), text(src), text(dst), float_bytes(F.col(confidence)), text(origin)), 256)


def node_hash(tag: Column, id_: Column) -> Column:
    return F.sha2(F.concat(F.lit("node-v1:"), tag, F.lit("|"), id_).cast("binary"), 256)


def _digest_of(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, n, digest): one hash of the values in order."""
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    inside = F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda b: b["v"]), "")
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(inside.cast("binary"), 256).alias("digest"))


def fold(hashed: DataFrame, name: str) -> DataFrame:
    """(name, n, digest) of a multiset of hex hashes.

    A tree by leading digits: up to a million leaves of five digits, 256 nodes above them, one root. A leaf of ten billion hashes
    holds ten thousand of them, so no task holds many.
    """
    one = hashed.select("hash", F.lit(1).cast("long").alias("n"), F.substring("hash", 1, 5).alias("leaf"))
    leaves = _digest_of(one, ["leaf"], "hash", "hash")
    nodes = _digest_of(leaves.withColumn("node", F.substring("leaf", 1, 2)), ["node"], "leaf", "digest")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda b: b["digest"]), "")
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined.alias("all")).select(F.lit(name).alias("name"), "n", F.sha2(F.concat(F.lit(f"{name}:"), F.col("n").cast("string"), F.lit(":"), "all").cast("binary"), 256).alias("digest"))


def fold_sql(hashes: str, name: str) -> str:
    """The same over a table expression with a column hash."""
    return (
        f"SELECT '{name}' AS name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(concat('{name}:', CAST(coalesce(sum(n), 0) AS BIGINT), ':', string_agg(digest, '' ORDER BY node))) AS digest FROM ("
        "SELECT substr(leaf, 1, 2) AS node, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY leaf)) AS digest FROM ("
        f"SELECT substr(hash, 1, 5) AS leaf, count(*) AS n, sha256(string_agg(hash, '' ORDER BY hash)) AS digest FROM {hashes} GROUP BY 1) GROUP BY 1)"
    )


def group_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, digest) of the multiset of hex hashes of each key, by buckets of four digits, so a hub's hashes are never in one task."""
    one = rows.select(key, F.col(value).alias("__v"), F.lit(1).cast("long").alias("n"), F.substring(value, 1, 4).alias("__b"))
    buckets = _digest_of(one, [key, "__b"], "__v", "__v")
    return _digest_of(buckets, [key], "__b", "digest").select(key, "digest")


def root(domains: list[DataFrame]) -> str:
    """One hash of the folds of all domains, by name."""
    rows = sorted(d.first() for d in domains)
    return hashlib.sha256("".join(f"{r['name']}:{r['n']}:{r['digest']};" for r in rows).encode()).hexdigest()


def subgraph_hashes(entities: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """(id, hash) after `depth` rounds of refinement: a node's hash covers its own and its sorted relations with their targets' previous hashes.

    Unlike a depth-first hash it doesn't depend on the order of ids or roots, and cycles are no special case.
    """
    own = materialize(entities.select("id", "hash"))
    if not depth:
        return own
    # Relations are made once; each round moves them to their targets and, as 32 bytes each, to their sources.
    edges = materialize(relations.select("src", "kind", "dst").where("src is not null"))
    hubs, heads = hot_keys(edges, ["dst"]), hot_keys(edges, ["src"])
    state = own
    for _ in range(depth):
        previous = state.select(F.col("id").alias("dst"), F.col("hash").alias("h"))
        hinted = small(previous)
        below = edges.join(hinted, "dst", "left") if hinted is not previous else salted_join(edges, previous, ["dst"], ["src", "kind"], hubs, "left", sized=True)
        part = below.select(F.col("src").alias("id"), F.sha2(F.concat_ws("|", F.lit("edge"), "kind", F.coalesce("h", node_hash(F.lit("absent"), F.col("dst").cast("string")))).cast("binary"), 256).alias("e"))
        if heads is None:
            state = materialize(_covered(own, part))
            continue
        many = small(heads.select(F.col("src").alias("id")))
        lists = group_digest(part.join(many, "id", "left_semi"), "id", "e").withColumnRenamed("digest", "all")
        hot = own.join(many, "id", "left_semi").join(lists, "id", "left").select("id", F.sha2(F.concat(F.lit("subgraph-v1:"), "hash", F.coalesce("all", F.lit(""))).cast("binary"), 256).alias("hash"))
        state = materialize(_covered(own.join(many, "id", "left_anti"), part.join(many, "id", "left_anti")).unionByName(hot))
    return state


def _covered(own: DataFrame, part: DataFrame) -> DataFrame:
    """(id, hash) of own (id, hash) over group_digest() of part (id, e), in one pass: both come to one task by id, a node's own hash first and its relations in order."""
    kind = own.schema["id"].dataType
    both = own.select("id", F.col("hash").alias("own"), F.lit(None).cast("binary").alias("e")).unionByName(part.select("id", F.lit(None).cast("string").alias("own"), F.unhex("e").alias("e")))
    placed = by_size(both, "id")
    placed = placed if placed is not both else both.repartition("id")
    return placed.sortWithinPartitions("id", F.asc_nulls_first("e")).mapInArrow(_cover, T.StructType([T.StructField("id", kind), T.StructField("hash", T.StringType())]))


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, own, e) by id, those with own first. No more than the digests of a node's 65,536 buckets are kept, so it may have any number of relations."""
    sha, now, owns, digests, bucket, run, found = hashlib.sha256, None, [], [], None, b"", ([], [])

    def close() -> None:
        if run:
            digests.append(sha(run).hexdigest())
        tail = sha("".join(digests).encode()).hexdigest() if digests else ""
        for o in owns:
            found[0].append(now)
            found[1].append(None if o is None else sha(f"subgraph-v1:{o}{tail}".encode()).hexdigest())

    def taken(kind: pa.DataType) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(found[0], kind), pa.array(found[1], pa.string())], ["id", "hash"])
        found[0].clear()
        found[1].clear()
        return out

    kind = None
    for batch in batches:
        kind, at = batch.column(0).type, 0
        text = b"".join(batch.column(2).drop_null().to_pylist()).hex().encode()
        for id_, own, none in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).is_null().to_pylist()):
            if id_ != now:
                close()
                now, owns, digests, bucket, run = id_, [], [], None, b""
            if none:
                owns.append(own)
                continue
            x = text[at : at + 64]
            at += 64
            if x[:4] == bucket:
                run += x
            else:
                if run:
                    digests.append(sha(run).hexdigest())
                bucket, run = x[:4], x
        yield taken(kind)
    close()
    if found[0]:
        yield taken(kind)


def component_hashes(entities: DataFrame, relations: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, hash) over the hashes of the members of each component. labels: (id, component)."""
    return group_digest(entities.select("id", "hash").join(labels, "id"), "component", "hash").withColumnRenamed("digest", "hash")


def verify(asked: DataFrame, entities: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (id) with status valid, tampered or missing (no entity or no stored hash), expected and actual."""
    e = entities.select("id", F.col("hash").alias("actual"))
    s = stored.select("id", F.col("hash").alias("expected"))
    status = F.when(F.col("actual").isNull() | F.col("expected").isNull(), "missing").when(F.col("actual") == F.col("expected"), "valid").otherwise("tampered")
    return asked.select("id").join(e, "id", "left").join(s, "id", "left").select("id", status.alias("status"), "expected", "actual")


def canonical_hash(df: DataFrame) -> Column:
    """Hex hash of a row as JSON with its columns by name; nulls are left out, so an absent column equals a null one."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).cast("binary"), 256)


def domain_digest(df: DataFrame, name: str) -> DataFrame:
    """fold() of the rows of any table; repeats count."""
    return fold(df.select(canonical_hash(df).alias("hash")), name)


def versioned_root(version: int, domains: dict[str, DataFrame], derived: tuple[str, ...] = ("outgoing", "incoming", "change_children", "entity_revisions")) -> tuple[int, str]:
    """(version, hash) over all tables but derived ones. Two of them match only if both parts do."""
    return version, root([domain_digest(df, name) for name, df in sorted(domains.items()) if name not in derived])


def graph_root(hashes: DataFrame) -> str:
    """One hash of all subgraph hashes; an empty graph has one too."""
    return fold(hashes.select("hash"), "graph-root-v1").first()["digest"]


def refresh(previous: DataFrame, entities: DataFrame, relations: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """subgraph_hashes() after some entities (id) changed, recomputed only where a change can be seen; all anew if that's half of the graph.

    A hash of depth d sees d steps ahead, so changes reach d steps back, and what they reach reads d steps ahead again.
    """
    back = relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    touched = materialize(reach(back, changed.select(F.col("id").alias("node")), depth).select(F.col("node").alias("id")))
    if touched.count() * 2 >= entities.count():
        return subgraph_hashes(entities, relations, depth)
    # Small sets of nodes are broadcast, so tables stay where they are and relations are filtered before they're made.
    region, touched = small(materialize(reach(relations, touched.select(F.col("id").alias("node")), depth).select(F.col("node").alias("id")))), small(touched)
    inside = entities.join(region, "id", "left_semi")
    edges = relations.join(region.select(F.col("id").alias("src")), "src", "left_semi")
    fresh = subgraph_hashes(inside, edges, depth).join(touched, "id", "left_semi")
    return previous.join(touched, "id", "left_anti").unionByName(fresh)


def verify_subgraph(start, entities: DataFrame, relations: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status, depth) of all that can be reached from start; missing nodes are walked through and left out."""
    seeds = entities.sparkSession.range(1).select(F.lit(start).cast(relations.schema["src"].dataType).alias("node"))
    found = materialize(reach(relations.select("src", "dst"), seeds, None).withColumnRenamed("node", "id"))
    return verify(found, entities, stored).where("status != 'missing'").join(found, "id").select("id", "status", "depth")
