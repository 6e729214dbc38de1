"""Point reads, filters, name search and overview counts over entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.names import compile_pattern, name_matches, python_tokens, tokens
from skein.functions.shared import by_size, materialize
from skein.operators.traverse import of_kinds

TOKEN_CAP = 32
#: Rows up to which one task may take the first ones in order.
ORDERED_ROWS = 100_000


def query_entities(entities: DataFrame, name_pattern: str | None = None, file_path: str | None = None, kinds: list[str] | None = None, languages: list[str] | None = None, roles: list[str] | None = None) -> DataFrame:
    """All conditions that are given must hold; they reach the scan as pushed filters where they can."""
    out = entities
    if name_pattern is not None:
        out = out.where(name_matches(F.col("name"), name_pattern))
    if file_path is not None:
        out = out.where(F.col("file_origin") == file_path)
    for column, values in (("kind", kinds), ("language", languages), ("role", roles)):
        if values:
            out = out.where(F.col(column).isin(*values))
    return out


def token_matches(entities: DataFrame, pattern: str) -> DataFrame:
    """Entities whose name has all tokens of the pattern; none if the pattern has no token."""
    want = sorted(set(python_tokens(pattern)))
    if not want:
        return entities.limit(0)
    have = tokens(F.col("name"))
    out = entities
    for t in want:
        out = out.where(F.array_contains(have, t))
    return out


def by_name_pattern(entities: DataFrame, pattern: str, cap: int = TOKEN_CAP) -> DataFrame:
    """entities with `tier`: wildcard forms scan; a plain name takes exact (0) and, if at most cap, token (1) hits, and only without either any substring (2)."""
    mode, needle = compile_pattern(pattern)
    if mode != "contains":
        return entities.where(name_matches(F.col("name"), pattern)).withColumn("tier", F.lit(0))
    low = F.lower(F.col("name"))
    want = sorted(set(python_tokens(pattern)))
    have = tokens(F.col("name"))
    token_hit = F.lit(bool(want))
    for t in want:
        token_hit = token_hit & F.array_contains(have, t)
    hits = entities.where((low == needle) | token_hit | low.contains(needle)).withColumn("__token", token_hit)
    # Two counts decide for all hits.
    n = hits.agg(F.sum((low == needle).cast("int")).alias("exact"), F.sum(F.col("__token").cast("int")).alias("tokens")).first()
    exact, tokened = n["exact"] or 0, n["tokens"] or 0
    tier = F.when(low == needle, 0)
    if tokened <= cap:
        tier = tier.when(F.col("__token"), 1)
    if not exact and not 0 < tokened <= cap:
        tier = tier.when(low.contains(needle), 2)
    return hits.withColumn("tier", tier).where("tier is not null").drop("__token")


def outgoing(relations: DataFrame, entity, kinds: list[str] | None = None) -> DataFrame:
    return of_kinds(relations, kinds).where(F.col("src") == entity)


def touching(relations: DataFrame, entity) -> DataFrame:
    return relations.where((F.col("src") == entity) | (F.col("dst") == entity))


def entity_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose ends are both known entities."""
    ids = entities.select("id")
    return relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def remove_file(entities: DataFrame, relations: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept entities, kept relations, removed entities). Relations into the file from others stay, dangling."""
    gone = entities.where(F.col("file_origin") == path)
    kept = entities.where(~F.col("file_origin").eqNullSafe(F.lit(path)))
    return kept, relations.join(gone.select(F.col("id").alias("src")), "src", "left_anti"), gone


def upsert(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return base.join(rows.select(key), key, "left_anti").unionByName(rows)


def remove(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def tier_union(hot: DataFrame, cold: DataFrame, key: str = "id") -> DataFrame:
    """Hot rows, and the cold ones that hot doesn't have."""
    return hot.unionByName(cold.join(hot.select(key), key, "left_anti"))


def tier_names(hot: DataFrame, cold: DataFrame, pattern: str) -> DataFrame:
    """Name search over both tiers with rank 0 for the bare name. The cold tier takes the pattern, stars and all, as a substring."""
    hits = tier_union(hot.where(name_matches(F.col("name"), pattern)), cold.where(F.lower("name").contains(pattern.lower())))
    return hits.withColumn("rank", F.when(F.lower("name") == pattern.lower().replace("*", ""), 0).otherwise(1))


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows by key. Many aren't gathered in order: keys are counted in ranges, and only the range that holds the last one is sorted."""
    if n <= ORDERED_ROWS:
        return df.orderBy(key).limit(n)
    ranges = -(-df.count() // ORDERED_ROWS) + 1
    placed = materialize(df.select(key).repartitionByRange(ranges, key).withColumn("__range", F.spark_partition_id()))
    below = 0
    for r in sorted(placed.groupBy("__range").count().collect()):
        if below + r["count"] >= n:
            rest = placed.where(F.col("__range") == r["__range"]).orderBy(key).limit(n - below)
            last = rest.agg(F.max(key)).first()[0]
            break
        below += r["count"]
    else:
        return df
    if last is None:
        return df.where(F.col(key).isNull()).limit(n)
    under = F.col(key).isNull() | (F.col(key) < last)
    return df.where(under).unionByName(df.where(F.col(key) == last).limit(n - placed.where(under).count()))


def partial_hydrate(entities: DataFrame, relations: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n entities by id and the relations between them."""
    hot = first_rows(entities, n)
    return hot, entity_edges(hot, relations)


def fits_hot(file_bytes: int, budget: int) -> bool:
    """Whether a snapshot of that size is loaded whole."""
    return file_bytes * 4 <= budget


def default_budget(free_bytes: int) -> tuple[int, int]:
    """Half of the free memory, and how many entities that holds."""
    return free_bytes // 2, free_bytes // 2 // 200


def overview(entities: DataFrame, relations: DataFrame, languages: bool = False) -> DataFrame:
    """(what, name, n): counts of entities by kind, of all entities, and of relations between known ones."""
    kinds = entities.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "name", "n")
    total = entities.agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), F.lit("all").alias("name"), "n")
    edges = entity_edges(entities, relations).agg(F.count("*").alias("n")).select(F.lit("relations").alias("what"), F.lit("all").alias("name"), "n")
    out = kinds.unionByName(total).unionByName(edges)
    if languages:
        out = out.unionByName(entities.groupBy(F.col("language").alias("name")).agg(F.count("*").alias("n")).select(F.lit("language").alias("what"), "name", "n"))
    return out


def distinct_incoming(relations: DataFrame) -> DataFrame:
    """(id, n): distinct sources by target. Duplicates go before the shuffle on the target, so a hub's sources aren't gathered."""
    return by_size(relations.select("src", "dst"), "src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def incoming_lists(relations: DataFrame, ids: list) -> DataFrame:
    """Sorted distinct sources of some targets."""
    return relations.where(F.col("dst").isin(*ids)).groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("sources"))


def coverage(entities: DataFrame, relations: DataFrame, kinds: list[str]) -> DataFrame:
    """total_entities and covered_entities: those that a relation of a covering kind points to."""
    hit = of_kinds(relations, kinds).select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(1))
    return entities.join(hit, "id", "left").agg(F.count("*").alias("total_entities"), F.count("hit").alias("covered_entities"))


def latest_audit(events: DataFrame, limit: int, actor: Column | None = None) -> DataFrame:
    out = events if actor is None else events.where(actor)
    return out.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


