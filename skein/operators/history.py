"""Change history: lineage, state at a change, validation, children.

Deltas are rows (seq, id, op, old, new) along a lineage; op is added, modified or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.delta import absent_ends
from skein.operators.traverse import first_parent_cycles, first_parent_lineage


def state_at(deltas: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, value): the last delta of each identity along the lineage (id, distance), without removed ones.

    A maximum over (nearness) structs, so a long-lived identity's deltas are combined before the shuffle.
    """
    near = deltas.join(lineage.select(F.col("id").alias("change"), "distance"), "change")
    last = near.groupBy("id").agg(F.min_by(F.struct("op", "new"), F.col("distance")).alias("last"))
    return last.where("last.op != 'removed'").select("id", F.col("last.new").alias("value"))


def trees_at(deltas: DataFrame, lineages: DataFrame) -> DataFrame:
    """(target, id, value) for many targets at once. lineages: (target, change, distance)."""
    near = deltas.join(lineages, "change")
    last = near.groupBy("target", "id").agg(F.min_by(F.struct("op", "new"), F.col("distance")).alias("last"))
    return last.where("last.op != 'removed'").select("target", "id", F.col("last.new").alias("value"))


def problems(deltas: DataFrame, branch: str = "branch") -> DataFrame:
    """(branch, seq, id, problem) of deltas that don't fit the state before them on their branch."""
    w = Window.partitionBy(branch, "id").orderBy("seq")
    d = deltas.withColumn("__op", F.lag("op").over(w)).withColumn("__new", F.lag("new").over(w))
    there = F.col("__op").isNotNull() & (F.col("__op") != "removed")
    problem = (
        F.when((F.col("op") == "added") & there, "added but present")
        .when((F.col("op") != "added") & ~there, F.concat("op", F.lit(" but absent")))
        .when((F.col("op") != "added") & ~F.col("old").eqNullSafe(F.col("__new")), "stale old value")
    )
    return d.withColumn("problem", problem).where("problem is not null").select(branch, "seq", "id", "problem")


def validate(changes: DataFrame, deltas: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """(problem, id): all that is wrong with a history, in one table.

    changes: key, id, parents, payload; deltas: change, id, op, old, new, and branch and seq, which order them along first parents.
    Told are ids that don't match their key or come with two payloads, missing parents, changes on or below a cycle of
    first parents, deltas of unknown changes, deltas that don't fit the state before them, and relations with a dead end.
    """
    told = lambda df, what, c="id": df.select((F.lit(what) if isinstance(what, str) else what).alias("problem"), F.col(c).cast("string").alias("id"))
    known = changes.dropDuplicates(["id"])
    out = told(id_problems(changes), "id or payload differs").unionByName(told(missing_parents(known), "missing parent"))
    out = out.unionByName(told(first_parent_cycles(known.select("id", "parents")), "cycle of first parents"))
    out = out.unionByName(told(deltas.join(known.select(F.col("id").alias("change")), "change", "left_anti"), "delta of an unknown change", "change"))
    out = out.unionByName(told(problems(deltas), F.col("problem")))
    if entities is not None and relations is not None:
        out = out.unionByName(told(dangling(relations, entities), F.concat(F.lit("dangling "), "side")))
    return out


def invert(deltas: DataFrame) -> DataFrame:
    """Deltas that rewind: newest first, old and new swapped."""
    op = F.when(F.col("op") == "added", "removed").when(F.col("op") == "removed", "added").otherwise(F.col("op"))
    return deltas.select((-F.col("seq")).alias("seq"), "id", op.alias("op"), F.col("new").alias("old"), F.col("old").alias("new"))


def children(changes: DataFrame) -> DataFrame:
    """(parent, children): sorted ids of the changes that name a parent."""
    return changes.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).groupBy("parent").agg(F.sort_array(F.collect_list("child")).alias("children"))


def revisions(deltas: DataFrame) -> DataFrame:
    """(id, revision, since, ended_by, value): every value an identity had, and the delta that ended it."""
    w = Window.partitionBy("id").orderBy("seq")
    r = deltas.withColumn("ended_by", F.lead("seq").over(w)).withColumn("revision", F.sum(F.when(F.col("op") != "removed", 1).otherwise(0)).over(w))
    return r.where("op != 'removed'").select("id", "revision", F.col("seq").alias("since"), "ended_by", F.col("new").alias("value"))


def missing_parents(changes: DataFrame) -> DataFrame:
    """(id, parent) of parents that no change has."""
    each = changes.select("id", F.explode("parents").alias("parent"))
    return each.join(changes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")


def dangling(relations: DataFrame, nodes: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """(id, side) of relations with an end that isn't among the nodes; only touched ones (id) if given."""
    gone = absent_ends(nodes, relations)
    out = None
    for end in ("src", "dst"):
        for part in (relations.join(gone.withColumnRenamed("end", end), end, "left_semi"), relations.where(F.col(end).isNull())):
            part = part.select("id", F.lit(end).alias("side"))
            out = part if out is None else out.unionByName(part)
    # Only what dangles is looked up among the touched ones.
    return out if touched is None else out.join(touched.select("id"), "id", "left_semi")


def admission_problems(entities: DataFrame, relations: DataFrame, artifacts: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(problem, id): dangling ends, and enrichment rows (file_id) whose file isn't in the tree (path)."""
    ends = dangling(relations, entities).select(F.concat(F.lit("dangling "), "side").alias("problem"), F.col("id").cast("string").alias("id"))
    files = enrichment.join(artifacts.select(F.col("path").alias("file_id")), "file_id", "left_anti").select(F.lit("file not in tree").alias("problem"), F.col("file_id").cast("string").alias("id"))
    return ends.unionByName(files)


def id_problems(changes: DataFrame) -> DataFrame:
    """(id) of changes whose key isn't the id they carry, or whose id comes with two payloads. Equal repeats are fine."""
    own = changes.where(~F.col("key").eqNullSafe(F.col("id"))).select("id")
    two = changes.select("id", "payload").distinct().groupBy("id").count().where("count > 1").select("id")
    return own.unionByName(two).distinct()


__all__ = ["admission_problems", "children", "dangling", "first_parent_lineage", "id_problems", "invert", "missing_parents", "problems", "revisions", "state_at", "trees_at", "validate"]
