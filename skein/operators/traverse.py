"""Graph traversal as iterated joins.

A level is one join of the frontier with the edges. Small searches keep their bounded frontier on the driver. Larger ones
anti-join each level against what was visited and write it to the shared folder, so the plan doesn't grow with the depth;
a frontier is broadcast only after it was counted to be small, so levels of millions of nodes shuffle instead. A node at the
depth limit isn't expanded, so edges between two nodes at the limit aren't returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from skein.functions.paths import is_magic_method, is_nonproduction
from skein.functions.shared import by_size, materialize, small

#: Visited nodes up to which a search keeps its frontier on the driver.
LOCAL_NODES = 20_000

DEAD_CODE_KINDS = ("function", "method", "class", "interface", "trait_def", "type_alias", "enum_def", "constant", "static_var")


def of_kinds(relations: DataFrame, kinds: list[str] | None) -> DataFrame:
    """An empty list means all kinds."""
    return relations.where(F.col("kind").isin(*kinds)) if kinds else relations


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """(node, depth) of everything within max_depth steps along edges (src, dst), seeds at depth 0; without a limit, to the fixpoint.

    While at most LOCAL_NODES nodes were visited, a level is one job: the frontier is a broadcast of proven size, and the
    next one comes back through a limit. It's a semi join, which the optimizer moves below the unions and groupings that
    make the edges, so only edges of the frontier are made. From the level on that would exceed the bound, frontiers stay
    tables, and so do the edges if several levels may follow.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    schema = StructType([StructField("node", kind), StructField("depth", IntegerType())])
    got = seeds.select("node").where("node is not null").distinct().limit(LOCAL_NODES + 1).collect()
    if len(got) > LOCAL_NODES:
        seen = materialize(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
        return _reach_tables(edges, seen, seen, 0, max_depth)
    found, frontier, depth = {r[0]: 0 for r in got}, [r[0] for r in got], 0
    while frontier and (max_depth is None or depth < max_depth):
        here = spark.createDataFrame([(n,) for n in frontier], StructType([StructField("src", kind)]))
        got = edges.join(F.broadcast(here), "src", "left_semi").select(F.col("dst").alias("node")).where("node is not null").distinct().limit(LOCAL_NODES + 1).collect()
        fresh = [r[0] for r in got if r[0] not in found]
        if len(got) > LOCAL_NODES or len(found) + len(fresh) > LOCAL_NODES:
            seen = materialize(spark.createDataFrame(list(found.items()), schema))
            return _reach_tables(edges, seen, seen.where(F.col("depth") == depth), depth, max_depth)
        depth += 1
        found |= dict.fromkeys(fresh, depth)
        frontier = fresh
    return spark.createDataFrame(list(found.items()), schema)


def _reach_tables(edges: DataFrame, seen: DataFrame, frontier: DataFrame, depth: int, max_depth: int | None) -> DataFrame:
    parts = [seen]
    if max_depth is None or max_depth - depth > 1:
        edges = materialize(edges.select("src", "dst"))
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        here = frontier.select(F.col("node").alias("src"))
        hinted = small(here)
        step = (edges if hinted is not here else by_size(edges.select("src", "dst"), "src")).join(hinted, "src", "left_semi").select(F.col("dst").alias("node")).where("node is not null").distinct()
        known = reduce(DataFrame.unionByName, parts).select("node")
        frontier = materialize(step.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _walked(relations: DataFrame, found: DataFrame, max_depth: int, ends: tuple[str, ...]) -> DataFrame:
    """Relations with an end that was expanded."""
    inner = small(found.where(F.col("depth") < max_depth).select(F.col("node").alias("__n")))
    parts = [relations.join(inner, relations[e] == inner["__n"], "left_semi") for e in ends]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["id"])


def neighborhood(entities: DataFrame, relations: DataFrame, start, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Outgoing search over all kinds: (entities with depth, relations). An absent start gives nothing; absent targets are walked through but not returned."""
    seeds = entities.where(F.col("id") == start).select(F.col("id").alias("node"))
    found = reach(relations.select("src", "dst"), seeds, max_depth)
    nodes = entities.join(found.withColumnRenamed("node", "id"), "id")
    return nodes, _walked(relations, found, max_depth, ("src",))


def expand(entities: DataFrame, relations: DataFrame, starts: list, kinds: list[str] | None, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Undirected search from several seeds over some kinds; absent seeds are dropped."""
    rel = of_kinds(relations, kinds)
    seeds = entities.where(F.col("id").isin(*starts)).select(F.col("id").alias("node"))
    found = reach(both_ways(rel), seeds, max_depth)
    return entities.join(found.withColumnRenamed("node", "id"), "id"), _walked(rel, found, max_depth, ("src", "dst"))


def traverse(relations: DataFrame, start, kinds: list[str] | None, max_depth: int) -> DataFrame:
    """(node, depth), undirected over nodes of every domain; the start is returned even if nothing mentions it."""
    rel = of_kinds(relations, kinds)
    kind = rel.schema["src"].dataType
    seeds = relations.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    return reach(both_ways(rel), seeds, max_depth)


def downstream_impact(entities: DataFrame, relations: DataFrame, start, max_depth: int) -> DataFrame:
    """Entities that depend on start, by incoming edges, with their depth; without start. Absent ones are walked through but not returned."""
    back = relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    kind = relations.schema["src"].dataType
    seeds = relations.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"))
    found = reach(back, seeds, max_depth).where("depth > 0").withColumnRenamed("node", "id")
    return entities.join(found, "id")


def hop_distances(entities: DataFrame, relations: DataFrame, starts: list, kinds: list[str] | None, max_depth: int) -> DataFrame:
    """(id, hops) of the entities that expand() finds."""
    return expand(entities, relations, starts, kinds, max_depth)[0].select("id", F.col("depth").alias("hops"))


def component(relations: DataFrame, starts: list) -> DataFrame:
    """Nodes of the weakly connected components of the seeds."""
    seeds = both_ways(relations).where(F.col("src").isin(*starts)).select(F.col("src").alias("node"))
    return reach(both_ways(relations), seeds, None).select("node")


def _from_other_files(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(dst, src_file, known): for each target the distinct files of its sources, told apart before the join with the targets, where a hub has one row a file."""
    src = entities.select(F.col("id").alias("src"), F.col("file_origin").alias("src_file"), F.lit(True).alias("known"))
    return relations.join(src, "src", "left").select("dst", "src_file", "known").distinct()


def has_incoming(entities: DataFrame, relations: DataFrame, kinds: list[str] | None, exclude_same_file: bool) -> DataFrame:
    """(id) of entities with an incoming relation of some kinds; None means all kinds, an empty list matches nothing.

    Excluding the same file, a source that isn't in entities counts, and a null file differs from any other but not from null.
    If relations tell the domain of their sources (src_tag), those that aren't entities are then passed over.
    """
    rel = relations if kinds is None else relations.where(F.col("kind").isin(*kinds)) if kinds else relations.limit(0)
    if not exclude_same_file:
        return entities.join(rel.select(F.col("dst").alias("id")), "id", "left_semi").select("id")
    if "src_tag" in rel.columns:
        rel = rel.where(F.col("src_tag") == "Entity")
    hits = _from_other_files(entities, rel).join(entities.select(F.col("id").alias("dst"), "file_origin"), "dst")
    hits = hits.where(F.col("known").isNull() | ~F.col("src_file").eqNullSafe(F.col("file_origin")))
    return hits.select(F.col("dst").alias("id")).distinct()


def dead_code(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Production entities of the candidate kinds that no entity of another file refers to; dunder methods are left out."""
    candidate = F.col("kind").isin(*DEAD_CODE_KINDS) & ~is_nonproduction(F.col("file_origin")) & ~is_magic_method(F.col("kind"), F.col("name"))
    files = _from_other_files(entities, relations).where("known")
    used = files.join(entities.select(F.col("id").alias("dst"), "file_origin"), "dst").where(~F.col("src_file").eqNullSafe(F.col("file_origin")))
    return entities.where(candidate).join(used.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def first_parent_lineage(changes: DataFrame, target) -> DataFrame:
    """(id, distance): the change and its first-parent ancestors. changes: id, parents."""
    first = changes.select(F.col("id").alias("src"), F.try_element_at("parents", F.lit(1)).alias("dst")).where("dst is not null")
    seeds = changes.where(F.col("id") == target).select(F.col("id").alias("node"))
    return reach(first, seeds, None).select(F.col("node").alias("id"), F.col("depth").alias("distance"))


def first_parent_lineages(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, change, distance): the lineages of many targets (id) at once, a level of all of them a join. Lineages that run into a cycle are an error."""
    first = changes.select(F.col("id").alias("change"), F.try_element_at("parents", F.lit(1)).alias("parent")).where("parent is not null")
    frontier = materialize(targets.join(changes.select("id"), "id", "left_semi").select(F.col("id").alias("target"), F.col("id").alias("change"), F.lit(0).alias("distance")))
    parts, most = [frontier], changes.count()
    while not frontier.isEmpty():
        if len(parts) > most:
            raise ValueError("a lineage runs into a cycle")
        frontier = materialize(frontier.join(first, "change").select("target", F.col("parent").alias("change"), (F.col("distance") + 1).alias("distance")))
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def first_parent_cycles(changes: DataFrame) -> DataFrame:
    """Changes that no root reaches along first parents (and whose parents are all present): they lie on or below a cycle."""
    first = changes.select("id", F.try_element_at("parents", F.lit(1)).alias("parent"))
    missing = first.join(changes.select(F.col("id").alias("parent")), "parent", "left_anti")
    down = first.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    good = reach(down, missing.select(F.col("id").alias("node")), None)
    return first.select("id").join(good.select(F.col("node").alias("id")), "id", "left_anti")


