"""Diff, patch and compaction of keyed tables and of multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import by_size, materialize, small


def _row(df: DataFrame, columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def diff_map(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(op, key, columns of new): added, modified (with the new value) and removed rows; a row is modified if any column differs, null-safely.

    The comparison is of whole rows inside one full outer join, so equal rows never leave their task.
    """
    rest = [c for c in new.columns if c != key]
    o = old.select(F.col(key), F.lit(True).alias("__o"), _row(old, rest).alias("__ov"))
    n = new.select(F.col(key), F.lit(True).alias("__n"), _row(new, rest).alias("__nv"))
    op = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("__ov").eqNullSafe(F.col("__nv")), "modified")
    return o.join(n, key, "full_outer").withColumn("op", op).where("op is not null").select("op", key, *[F.col(f"__nv.{c}").alias(c) for c in rest])


def apply_map(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Remove, then put the added and the modified."""
    puts = delta.where("op != 'removed'").select(*base.columns)
    return base.join(delta.select(key), key, "left_anti").unionByName(puts)


def _missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, repeats kept, that don't occur in right at all; nulls equal nulls."""
    cond = None
    r = right.distinct().select(*[F.col(c).alias(f"__{c}") for c in right.columns])
    for c in left.columns:
        e = left[c].eqNullSafe(r[f"__{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, "left_anti")


def diff_multiset(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, columns): every new element absent in old, with its repeats, and every old one absent in new. Counts aren't compared."""
    return _missing(new, old).select(F.lit("added").alias("op"), "*").unionByName(_missing(old, new).select(F.lit("removed").alias("op"), "*"))


def apply_multiset(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Drop all equals of what was removed, append what was added."""
    gone = delta.where("op = 'removed'").select(*base.columns)
    return _missing(base, gone).unionByName(delta.where("op = 'added'").select(*base.columns))


def tree_diff(graph: DataFrame, files: DataFrame) -> DataFrame:
    """(op, path) between two tables (path, hash)."""
    j = graph.select("path", F.col("hash").alias("g")).join(files.select("path", F.col("hash").alias("f")), "path", "full_outer")
    return j.withColumn("op", F.when(F.col("g").isNull(), "added").when(F.col("f").isNull(), "removed").when(F.col("g") != F.col("f"), "modified")).where("op is not null").select("op", "path")


def tree_problems(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(problem, value): artifact ids that a tree delta names twice, and paths that the result would hold twice."""
    twice = delta.groupBy("id").count().where("count > 1").select(F.lit("id named twice").alias("problem"), F.col("id").cast("string").alias("value"))
    after = apply_map(base, delta)
    same = after.groupBy("path").count().where("count > 1").select(F.lit("path held twice").alias("problem"), F.col("path").cast("string").alias("value"))
    return twice.unionByName(same)


def reference_problems(base: DataFrame, delta: DataFrame) -> DataFrame:
    """External references never change: (problem, id) for modified ones, ids named twice, adding a present one, removing an absent one."""
    p = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("id").cast("string").alias("id"))
    out = p(delta.where("op = 'modified'"), "modified").unionByName(p(delta.groupBy("id").count().where("count > 1"), "named twice"))
    out = out.unionByName(p(delta.where("op = 'added'").join(base.select("id"), "id", "left_semi"), "added but present"))
    return out.unionByName(p(delta.where("op = 'removed'").join(base.select("id"), "id", "left_anti"), "removed but absent"))


def delta_counts(deltas: dict[str, DataFrame]) -> dict[str, int]:
    """Changes by table; a delta is empty if all are 0."""
    return {k: d.count() for k, d in deltas.items()}


def absent_ends(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(end) of relations, each once, that aren't among the nodes (id); nulls are left out.

    Ends are far fewer than relations, and absent ones mostly few: what they decide needs no relation to be moved.
    """
    ends = relations.select(F.explode(F.array("src", "dst")).alias("end")).where("end is not null")
    return small(materialize(by_size(ends, "end").distinct().join(nodes.select(F.col("id").alias("end")), "end", "left_anti")))


def live_relations(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose ends both live. nodes: (id) of all domains."""
    gone = absent_ends(nodes, relations)
    out = relations.where("src is not null and dst is not null")
    for end in ("src", "dst"):
        out = out.join(gone.withColumnRenamed("end", end), end, "left_anti")
    return out.select(*relations.columns)


def compact(nodes: DataFrame, relations: DataFrame, owned: dict[str, tuple[DataFrame, str, DataFrame]]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(kept relations, kept owned tables, stats). owned: name -> (table, column, table of live ids).

    Stats (what, removed): rows, and for adjacency the keys that lose all their entries.
    """
    # Only distinct ends are looked up; kept relations and all counts come from those that are absent.
    gone = absent_ends(nodes, relations)
    kept, marked = relations.where("src is not null and dst is not null"), relations
    for end in ("src", "dst"):
        one = gone.withColumnRenamed("end", end)
        kept, marked = kept.join(one, end, "left_anti"), marked.join(one.withColumn(f"__{end}", F.lit(True)), end, "left")
    kept = kept.select(*relations.columns)
    n = lambda df: df.agg(F.count("*").alias("n"))

    def stat(what: str, before: DataFrame, after: DataFrame) -> DataFrame:
        both = before.unionByName(after.select((-F.col("n")).alias("n")))
        return both.agg(F.sum("n").alias("removed")).select(F.lit(what).alias("what"), "removed")

    # One row an end and side says how many relations it loses and whether it keeps any.
    dead = F.col("__src").isNotNull() | F.col("__dst").isNotNull() | F.col("src").isNull() | F.col("dst").isNull()
    sides = F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(e).alias("end")) for w, e in (("outgoing", "src"), ("incoming", "dst"))]))
    each = marked.select(dead.alias("dead"), sides.alias("s")).groupBy("s.what", "s.end").agg(F.sum(F.col("dead").cast("long")).alias("lost"), F.min("dead").alias("all"))
    each = materialize(each.groupBy("what").agg(F.sum("lost").alias("lost"), F.sum(F.col("all").cast("long")).alias("keys")))
    of = lambda what, side, c: each.where(F.col("what") == side).agg(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias("removed")).select(F.lit(what).alias("what"), "removed")
    stats = of("relations", "outgoing", "lost").unionByName(of("outgoing", "outgoing", "keys")).unionByName(of("incoming", "incoming", "keys"))
    tables = {}
    for name, (df, column, live) in owned.items():
        tables[name] = df.join(live.select(live.columns[0]).distinct().withColumnRenamed(live.columns[0], column), column, "left_semi")
        stats = stats.unionByName(stat(name, n(df), n(tables[name])))
    return kept, tables, stats


def merge_absent(base: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """base and more; fails when run if a key is in both."""
    both = more.join(base.select(key), key, "left_semi")
    return base.unionByName(more.withColumn(key, F.col(key))) if both.isEmpty() else _raise(f"keys are in both tables: {[r[0] for r in both.select(key).limit(5).collect()]}")


def absent_from(base: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    return more.join(base.select(key), key, "left_anti")


def require_sorted_unique(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key) of rows, in their stated order, that don't rise above the key before them. Only neighbours are compared: ranges of the order are handed on by their last key."""
    from pyspark.sql import Window

    cut = rows.select(key, order).withColumn("__part", F.floor(F.col(order) / 100_000))
    inside = cut.withColumn("__before", F.lag(key).over(Window.partitionBy("__part").orderBy(order)))
    last = cut.groupBy("__part").agg(F.max_by(key, order).alias("__last"))
    handed = last.select(F.lead("__part").over(Window.orderBy("__part")).alias("__part"), "__last").where("__part is not null")
    both = inside.join(handed, "__part", "left").withColumn("__before", F.coalesce("__before", "__last"))
    return both.where(F.col("__before").isNotNull() & (F.col("__before") >= F.col(key))).select(key)


def total_changes(deltas: dict[str, DataFrame], left_out: tuple[str, ...] = ("outgoing", "incoming", "change_children", "entity_revisions")) -> int:
    """Changes in the tables that a short total counts; a delta can be non-empty and yet have none of them."""
    return sum(d.count() for k, d in deltas.items() if k not in left_out)


def patch_setting(old: Column, new: Column) -> Column:
    return F.when(old.eqNullSafe(new), "unchanged").when(new.isNull(), "cleared").otherwise("set")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def prove(patched: dict[str, DataFrame], target: dict[str, DataFrame]) -> str | None:
    """The first table, by name, that a patch didn't bring to its target; None if all match."""
    return next((k for k in sorted(target) if k not in patched or not same_rows(patched[k], target[k])), None)


def merge_hot_into_cold(hot: DataFrame, cold: DataFrame, managed: Column, key: str = "id") -> DataFrame:
    """Cold rows in the managed scope give way to hot ones; outside it hot rows replace by key."""
    return cold.where(~managed).join(hot.select(key), key, "left_anti").unionByName(hot)


def _raise(why: str):
    raise ValueError(why)
