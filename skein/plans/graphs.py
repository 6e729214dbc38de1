"""Graphs over the supplied tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.shared import by_size


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Entities: table, id prefix, key, kind, name, file.
_ENTITIES = (
    ("part", "part", "p_partkey", "function", "p_name", "p_brand"),
    ("supplier", "supplier", "s_suppkey", "class", "s_name", "concat('nation_', cast(s_nationkey as {s}))"),
    ("customer", "customer", "c_custkey", "interface", "c_name", "c_mktsegment"),
    ("nation", "nation", "n_nationkey", "module", "n_name", "cast(null as {s})"),
    ("region", "region", "r_regionkey", "package", "r_name", "cast(null as {s})"),
    ("orders", "order", "o_orderkey", "method", "concat('order_', cast(o_orderkey as {s}))", "o_orderpriority"),
)
_EDGES = (
    ("select distinct o_orderkey as a, o_custkey as b, 1 as n from orders", "oc", "references", "order", "customer"),
    ("select l_orderkey as a, l_partkey as b, count(*) as n from lineitem group by l_orderkey, l_partkey", "op", "calls", "order", "part"),
    ("select l_partkey as a, l_suppkey as b, count(*) as n from lineitem group by l_partkey, l_suppkey", "ps", "uses_type", "part", "supplier"),
    ("select c_custkey as a, c_nationkey as b, 1 as n from customer", "cn", "owned_by", "customer", "nation"),
    ("select s_suppkey as a, s_nationkey as b, 1 as n from supplier", "sn", "owned_by", "supplier", "nation"),
    ("select n_nationkey as a, n_regionkey as b, 1 as n from nation", "nr", "owned_by", "nation", "region"),
)


def _entities(s: str) -> str:
    return " UNION ALL ".join(f"SELECT concat('{tag}:', cast({key} as {s})) AS id, '{kind}' AS kind, {name.format(s=s)} AS name, {file.format(s=s)} AS file_origin FROM {t}" for t, tag, key, kind, name, file in _ENTITIES)


#: Tables whose rows are grouped for relations of a tag, and the keys.
_GROUPED = {"oc": ("orders", ("o_orderkey", "o_custkey")), "op": ("lineitem", ("l_orderkey", "l_partkey")), "ps": ("lineitem", ("l_partkey", "l_suppkey"))}


def _edges(s: str, views: bool = False) -> str:
    def of(q: str, tag: str) -> str:
        return q.replace(f"from {_GROUPED[tag][0]}", f"from skein_{_GROUPED[tag][0]}_{tag}") if views and tag in _GROUPED else q

    return " UNION ALL ".join(
        f"SELECT concat('{tag}:', cast(a as {s}), ':', cast(b as {s})) AS id, '{kind}' AS kind, concat('{x}:', cast(a as {s})) AS src, concat('{y}:', cast(b as {s})) AS dst, cast(n as bigint) AS occurrence_count FROM ({of(q, tag)}) q"
        for q, tag, kind, x, y in _EDGES
    )


#: Common table expressions for the SQL side.
P_SQL = f"entities AS MATERIALIZED ({_entities('VARCHAR')}), relations AS MATERIALIZED ({_edges('VARCHAR')})"


def graph_p(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, kind, name, file_origin) and relations (id, kind, src, dst, occurrence_count) over the sales tables."""
    views = {}
    for t in ("part", "supplier", "customer", "nation", "region", "orders", "lineitem"):
        views[t] = table(spark, sf, t)
    for t, df in views.items():
        df.createOrReplaceTempView(f"skein_{t}")
    for tag, (t, keys) in _GROUPED.items():
        by_size(views[t].select(*keys), *keys).createOrReplaceTempView(f"skein_{t}_{tag}")

    def named(q: str) -> str:
        for t in views:
            q = q.replace(f"FROM {t} ", f"FROM skein_{t} ").replace(f"from {t} ", f"from skein_{t} ").replace(f"from {t})", f"from skein_{t})")
            if q.endswith(f"FROM {t}"):
                q = q[: -len(t)] + f"skein_{t}"
        return q

    e = spark.sql(named(_entities("STRING")))
    return e, spark.sql(named(_edges("STRING", True)))


def s_sql(per: int = 5) -> str:
    return (
        "size AS (SELECT count(*) AS n FROM events), "
        "entities AS MATERIALIZED (SELECT event_id AS id, ['function', 'class', 'method', 'module', 'interface'][event_id % 5 + 1] AS kind, concat('entity_', event_id) AS name, concat('src/mod_', event_id // 50, '.rs') AS file_origin FROM events), "
        f"relations AS MATERIALIZED (SELECT id * {per} + r AS id, ['calls', 'imports', 'references'][r % 3 + 1] AS kind, id AS src, (id * 6 + r * 12 + 1) % n AS dst FROM entities, size, range({per}) u(r) WHERE (id * 6 + r * 12 + 1) % n <> id)"
    )


def graph_s(spark: SparkSession, sf: str, per: int = 5) -> tuple[DataFrame, DataFrame]:
    """The benchmark graph over the stored events: an entity for each (100,000 at sf 0.1), `per` relations each, cyclic, without self-loops; ids are numbers. About half of it nothing refers to."""
    ids = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    n = ids.count()
    kinds = F.array(*[F.lit(k) for k in ("function", "class", "method", "module", "interface")])
    e = ids.select("id", F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit("entity_"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("src/mod_"), F.floor(F.col("id") / 50).cast("string"), F.lit(".rs")).alias("file_origin"))
    rel = F.array(*[F.lit(k) for k in ("calls", "imports", "references")])
    r = ids.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    r = r.select((F.col("id") * per + F.col("r")).alias("id"), F.element_at(rel, (F.col("r") % 3 + 1).cast("int")).alias("kind"), F.col("id").alias("src"), ((F.col("id") * 6 + F.col("r") * 12 + 1) % n).alias("dst"))
    return e, r.where("src != dst")
