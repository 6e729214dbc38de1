"""Queries over graphs: traversal, points and filters, counts, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.paths import is_nonproduction_sql
from skein.functions.names import python_tokens, tokens_sql
from skein.operators import history, index, merkle, traverse
from skein.plans.graphs import P_SQL, graph_p, graph_s, s_sql, table

_DEAD = ", ".join(f"'{k}'" for k in traverse.DEAD_CODE_KINDS)
_MAGIC = "(kind = 'method' AND starts_with(list_extract(string_split(name, '.'), -1), '__') AND ends_with(list_extract(string_split(name, '.'), -1), '__'))"


def dead_code(spark, sf):
    return traverse.dead_code(*graph_p(spark, sf)).select("id", "kind", "name", "file_origin")


def has_incoming(spark, sf):
    return traverse.has_incoming(*graph_p(spark, sf), ["calls", "uses_type"], True)


def neighborhood_out_d2(spark, sf):
    nodes, _ = traverse.neighborhood(*graph_p(spark, sf), "order:1", 2)
    return nodes.select("id", "name", "depth")


def neighborhood_edges_d2(spark, sf):
    _, rel = traverse.neighborhood(*graph_p(spark, sf), "order:1", 2)
    return rel.select("id", "kind", "src", "dst")


_SEEDS = ["supplier:1", "nation:3", "nobody:1"]


def expand_undirected_d3(spark, sf):
    nodes, _ = traverse.expand(*graph_p(spark, sf), _SEEDS, ["uses_type", "owned_by"], 3)
    return nodes.select("id", "kind", "depth")


def traverse_typed(spark, sf):
    _, rel = graph_p(spark, sf)
    return traverse.traverse(rel, "supplier:1", ["uses_type", "owned_by"], 2).select(F.col("node").alias("id"), "depth")


def downstream_impact_d4(spark, sf):
    return traverse.downstream_impact(*graph_p(spark, sf), "region:1", 4).select("id", "name", "depth")


def hop_distance(spark, sf):
    return traverse.hop_distances(*graph_p(spark, sf), ["part:1"], None, 2)


def connected_component(spark, sf):
    _, r = graph_p(spark, sf)
    return traverse.component(r.where("kind = 'uses_type'"), ["part:1"]).select(F.col("node").alias("id"))


def _bfs(cte: str, step: str, seed: str, depth: int) -> str:
    return f"WITH RECURSIVE {cte}, edges AS MATERIALIZED ({step}), r(node, depth) AS ({seed} UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < {depth}), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"


_BOTH = "SELECT src, dst FROM relations {w} UNION ALL SELECT dst, src FROM relations {w}"


def query_entities_filter(spark, sf):
    e, _ = graph_p(spark, sf)
    return index.query_entities(e, "*1", None, ["class", "interface"]).select("id", "name")


def query_entities_file(spark, sf):
    e, _ = graph_p(spark, sf)
    return index.query_entities(e, None, "Brand#12", ["function"]).select("id", "name")


def _names(pattern):
    def run(spark, sf):
        p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
        return index.by_name_pattern(p, pattern).select("id", "name", "tier")

    return run


def token_and(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return index.token_matches(p, "Plate.blue").select("id", "name")


_PART = "parts AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS low FROM part)"


def _tiered_sql(pattern: str) -> str:
    low = pattern.lower()
    toks = ", ".join(f"'{t}'" for t in sorted(set(python_tokens(pattern))))
    return (
        f"WITH {_PART}, h AS (SELECT id, name, low = '{low}' AS e, list_has_all({tokens_sql('name')}, [{toks}]) AS t, contains(low, '{low}') AS s FROM parts), "
        f"n AS (SELECT count(*) FILTER (e) AS ne, count(*) FILTER (t) AS nt FROM h), "
        f"j AS (SELECT id, name, CASE WHEN e THEN 0 WHEN t AND nt <= 32 THEN 1 WHEN s AND ne = 0 AND NOT (nt > 0 AND nt <= 32) THEN 2 END AS tier FROM h, n) SELECT id, name, tier FROM j WHERE tier IS NOT NULL"
    )


def relations_by_kind(spark, sf):
    _, r = graph_p(spark, sf)
    return index.outgoing(r, "order:1", ["calls", "references"]).select("id", "kind", "dst", "occurrence_count")


def relations_touching(spark, sf):
    _, r = graph_p(spark, sf)
    return index.touching(r, "supplier:3").select("id", "kind", "src", "dst")


def entity_edges(spark, sf):
    e, r = graph_p(spark, sf)
    return index.entity_edges(e.where("kind in ('function', 'class')"), r).select("id", "kind", "src", "dst")


def remove_file(spark, sf):
    e, r = graph_p(spark, sf)
    _, rel, gone = index.remove_file(e, r, "Brand#12")
    return gone.groupBy(F.lit("entities").alias("what")).agg(F.count("*").alias("n")).unionByName(rel.groupBy(F.lit("kept relations").alias("what")).agg(F.count("*").alias("n")))


def tier_union_ranked(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return index.tier_names(p.where("id % 2 = 0"), p.where("id % 3 = 0"), "plate").select("id", "name", "rank")


def partial_hydrate(spark, sf):
    e, r = graph_p(spark, sf)
    hot, rel = index.partial_hydrate(e, r, e.count() // 2)
    return rel.select("id", "kind", "src", "dst")


def overview_counts(spark, sf):
    return index.overview(*graph_p(spark, sf))


def distinct_incoming(spark, sf):
    return index.distinct_incoming(graph_p(spark, sf)[1])


def incoming_lists(spark, sf):
    return index.incoming_lists(graph_p(spark, sf)[1], ["nation:1", "nation:2", "region:0", "part:5"]).select("id", F.array_join("sources", ",").alias("sources"))


def coverage_summary(spark, sf):
    return index.coverage(*graph_p(spark, sf), ["calls"])


def latest_audit(spark, sf):
    return index.latest_audit(table(spark, sf, "events"), 50, F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


_HASHED = ["kind", "name", "file_origin"]
_HASH_SQL = "sha256(concat('entity-v1:', coalesce(kind, ''), '|', coalesce(name, ''), '|', coalesce(file_origin, ''), '|'))"


def entity_hash(spark, sf):
    e, _ = graph_p(spark, sf)
    return e.select("id", merkle.entity_hash(_HASHED).alias("hash"))


def domain_digest(spark, sf):
    e, _ = graph_p(spark, sf)
    return merkle.fold(e.select(merkle.entity_hash(_HASHED).alias("hash")), "entities")


def _number():
    return F.split_part("id", F.lit(":"), F.lit(2)).cast("long")


def verify_entities(spark, sf):
    e, _ = graph_p(spark, sf)
    h = e.select("id", merkle.entity_hash(_HASHED).alias("hash"), _number().alias("n"))
    stored = h.where("n % 5 != 0").select("id", F.when(F.col("n") % 7 == 0, "bad").otherwise(F.col("hash")).alias("hash"))
    return merkle.verify(h, h, stored).select("id", "status")


def relation_hash(spark, sf):
    _, r = graph_p(spark, sf)
    h = r.withColumn("confidence", F.expr("CASE occurrence_count % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 ELSE 0.5 END").cast("float")).withColumn("origin", F.when(F.col("kind") != "calls", "parsed"))
    return h.select("id", merkle.relation_hash().alias("hash"))


_REL_HASH = (
    "sha256(encode(concat('relation-v1:', kind, '|', src, '|', dst, '|')) || CASE occurrence_count % 3 WHEN 0 THEN '\\x00\\x00\\x80\\x3E'::BLOB WHEN 1 THEN '\\x00\\x00\\x80\\x3F'::BLOB ELSE '\\x00\\x00\\x00\\x3F'::BLOB END || encode(CASE WHEN kind <> 'calls' THEN 'parsed|' ELSE '|' END))"
)


def node_hash(spark, sf):
    """Hashes of the ends of relations that aren't entities of the graph."""
    e, r = graph_p(spark, sf)
    ends = r.select(F.col("dst").alias("id")).distinct().join(e.where("kind != 'module'"), "id", "left_anti")
    return ends.select("id", merkle.node_hash(F.lit("absent"), F.col("id")).alias("hash"))


def subgraph_hash_d2(spark, sf):
    e, r = graph_p(spark, sf)
    return merkle.subgraph_hashes(e.select("id", merkle.entity_hash(_HASHED).alias("hash")), r, 2)


_SUB = "s{k} AS (SELECT e.id, sha256(concat('subgraph-v1:', e.h, coalesce(d.h, ''))) AS h FROM s0 e LEFT JOIN (SELECT src, sha256(string_agg(b, '' ORDER BY k)) AS h FROM (SELECT src, substr(x, 1, 4) AS k, sha256(string_agg(x, '' ORDER BY x)) AS b FROM (SELECT r.src, sha256(concat('edge|', r.kind, '|', p.h)) AS x FROM relations r JOIN s{j} p ON p.id = r.dst) GROUP BY 1, 2) GROUP BY src) d ON d.src = e.id)"


def verify_subgraph(spark, sf):
    """All that order 1 reaches, against stored hashes of which some are missing and some wrong."""
    e, r = graph_p(spark, sf)
    h = e.select("id", merkle.entity_hash(_HASHED).alias("hash"))
    n = _number()
    stored = h.where(n % 11 != 0).select("id", F.when(n % 5 == 0, "bad").otherwise(F.col("hash")).alias("hash"))
    return merkle.verify_subgraph("order:1", h, r, stored)


def customer_digest(spark, sf):
    return merkle.domain_digest(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer")


def relation_revisit(spark, sf):
    """An incremental refresh after one entity changed equals a full pass."""
    e, r = graph_p(spark, sf)
    before = e.select("id", merkle.entity_hash(_HASHED).alias("hash"))
    after = before.withColumn("hash", F.when(F.col("id") == "supplier:3", F.sha2(F.lit("new").cast("binary"), 256)).otherwise(F.col("hash")))
    return merkle.refresh(merkle.subgraph_hashes(before, r, 1), after, r, e.where("id = 'supplier:3'"), 1)


def scale_neighborhood_2hop(spark, sf):
    return traverse.neighborhood(*graph_s(spark, sf), 12, 2)[0].select("id", "depth")


def scale_impact_d5(spark, sf):
    return traverse.downstream_impact(*graph_s(spark, sf), 13, 5).select("id", "depth")


def scale_dead_code(spark, sf):
    return traverse.dead_code(*graph_s(spark, sf)).select("id", "kind")


def scale_lookups(spark, sf):
    """A thousand point reads at sf 0.1 as one semi join with stored rows; the ids asked for are the only broadcast side."""
    asked = F.broadcast(spark.createDataFrame([(100 * i,) for i in range(1000)], "id long"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return e.join(asked, "id", "left_semi")


def list_all(spark, sf):
    """All entities and relations of the graph as rows."""
    e, r = graph_p(spark, sf)
    return e.select("id", "kind", "name").unionByName(r.select("id", "kind", F.concat_ws(">", "src", "dst").alias("name")))


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.array(F.concat_ws("/", "conv_id", F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))


def first_parent_lineage(spark, sf):
    """The lineage of the last turn of the longest conversation, over all conversations."""
    c = table(spark, sf, "conversations")
    last = c.orderBy(F.desc("turn"), "conv_id").first()
    return history.first_parent_lineage(_turns(spark, sf), f"{last['conv_id']}/{last['turn']}")


def first_parent_cycles(spark, sf):
    """Every tenth conversation's first turn names its last one as parent, which closes a cycle."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    odd = c.join(last, "conv_id").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1).when(F.col("conv_id") % 10 == 0, F.col("last")))
    rows = odd.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("parent").isNotNull(), F.array(F.concat_ws("/", "conv_id", "parent"))).otherwise(F.array().cast("array<string>")).alias("parents"))
    return traverse.first_parent_cycles(rows)


QUERIES = {
    "dead_code": (
        dead_code,
        f"WITH {P_SQL} SELECT id, kind, name, file_origin FROM entities c WHERE kind IN ({_DEAD}) AND NOT {is_nonproduction_sql('file_origin')} AND NOT coalesce({_MAGIC}, false) "
        "AND NOT EXISTS (SELECT 1 FROM relations r JOIN entities s ON s.id = r.src WHERE r.dst = c.id AND s.file_origin IS DISTINCT FROM c.file_origin)",
    ),
    "has_incoming_of_kinds": (
        has_incoming,
        f"WITH {P_SQL} SELECT DISTINCT d.id FROM relations r JOIN entities d ON d.id = r.dst LEFT JOIN entities s ON s.id = r.src WHERE r.kind IN ('calls', 'uses_type') AND (s.id IS NULL OR s.file_origin IS DISTINCT FROM d.file_origin)",
    ),
    "neighborhood_out_d2": (neighborhood_out_d2, _bfs(P_SQL, "SELECT src, dst FROM relations", "SELECT 'order:1', 0", 2) + " SELECT id, name, depth FROM m JOIN entities ON id = node"),
    "neighborhood_edges_d2": (neighborhood_edges_d2, _bfs(P_SQL, "SELECT src, dst FROM relations", "SELECT 'order:1', 0", 2) + " SELECT r2.id, r2.kind, r2.src, r2.dst FROM relations r2 JOIN m ON r2.src = m.node WHERE m.depth < 2"),
    "expand_undirected_d3": (expand_undirected_d3, _bfs(P_SQL, _BOTH.format(w="WHERE kind IN ('uses_type', 'owned_by')"), "SELECT id, 0 FROM entities WHERE id IN ('supplier:1', 'nation:3', 'nobody:1')", 3) + " SELECT id, kind, depth FROM m JOIN entities ON id = node"),
    "traverse_typed": (traverse_typed, _bfs(P_SQL, _BOTH.format(w="WHERE kind IN ('uses_type', 'owned_by')"), "SELECT 'supplier:1', 0", 2) + " SELECT node AS id, depth FROM m"),
    "downstream_impact_d4": (downstream_impact_d4, _bfs(P_SQL, "SELECT dst AS src, src AS dst FROM relations", "SELECT 'region:1', 0", 4) + " SELECT id, name, depth FROM m JOIN entities ON id = node WHERE depth > 0"),
    "hop_distance": (hop_distance, _bfs(P_SQL, _BOTH.format(w=""), "SELECT 'part:1', 0", 2) + " SELECT id, depth AS hops FROM m JOIN entities ON id = node"),
    "connected_component": (
        connected_component,
        f"WITH RECURSIVE {P_SQL}, edges AS MATERIALIZED ({_BOTH.format(w="WHERE kind = 'uses_type'")}), r(id) AS (SELECT 'part:1' UNION SELECT dst FROM r JOIN edges ON src = id) SELECT id FROM r",
    ),
    "query_entities_filter": (query_entities_filter, f"WITH {P_SQL} SELECT id, name FROM entities WHERE ends_with(lower(name), '1') AND kind IN ('class', 'interface')"),
    "query_entities_file": (query_entities_file, f"WITH {P_SQL} SELECT id, name FROM entities WHERE file_origin = 'Brand#12' AND kind = 'function'"),
    "name_suffix": (_names("*plate"), f"WITH {_PART} SELECT id, name, 0 AS tier FROM parts WHERE ends_with(low, 'plate')"),
    "name_prefix": (_names("B*"), f"WITH {_PART} SELECT id, name, 0 AS tier FROM parts WHERE starts_with(low, 'b')"),
    "name_contains": (_names("lu"), _tiered_sql("lu")),
    "name_pattern_tiered": (_names("small"), _tiered_sql("small")),
    "token_and": (token_and, f"WITH {_PART} SELECT id, name FROM parts WHERE list_has_all({tokens_sql('name')}, ['blue', 'plate'])"),
    "relations_by_kind": (relations_by_kind, f"WITH {P_SQL} SELECT id, kind, dst, occurrence_count FROM relations WHERE src = 'order:1' AND kind IN ('calls', 'references')"),
    "relations_touching": (relations_touching, f"WITH {P_SQL} SELECT id, kind, src, dst FROM relations WHERE src = 'supplier:3' OR dst = 'supplier:3'"),
    "entity_edges": (entity_edges, f"WITH {P_SQL}, k AS (SELECT id FROM entities WHERE kind IN ('function', 'class')) SELECT id, kind, src, dst FROM relations WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"),
    "remove_entities_for_file": (
        remove_file,
        f"WITH {P_SQL}, g AS (SELECT id FROM entities WHERE file_origin = 'Brand#12') SELECT 'entities' AS what, count(*) AS n FROM g HAVING count(*) > 0 UNION ALL SELECT 'kept relations', count(*) FROM relations WHERE src NOT IN (SELECT id FROM g)",
    ),
    "tier_union_ranked": (
        tier_union_ranked,
        f"WITH {_PART}, hot AS (SELECT * FROM parts WHERE id % 2 = 0 AND contains(low, 'plate')), cold AS (SELECT * FROM parts WHERE id % 3 = 0 AND contains(low, 'plate') AND id NOT IN (SELECT id FROM hot)) SELECT id, name, CASE WHEN low = 'plate' THEN 0 ELSE 1 END AS rank FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold)",
    ),
    "partial_hydrate": (partial_hydrate, f"WITH {P_SQL}, h AS MATERIALIZED (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM entities) WHERE k <= (SELECT count(*) FROM entities) // 2) SELECT id, kind, src, dst FROM relations WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h)"),
    "overview_counts": (
        overview_counts,
        f"WITH {P_SQL} SELECT 'kind' AS what, kind AS name, count(*) AS n FROM entities GROUP BY kind UNION ALL SELECT 'entities', 'all', count(*) FROM entities UNION ALL SELECT 'relations', 'all', count(*) FROM relations WHERE src IN (SELECT id FROM entities) AND dst IN (SELECT id FROM entities)",
    ),
    "distinct_incoming": (distinct_incoming, f"WITH {P_SQL} SELECT dst AS id, count(DISTINCT src) AS n FROM relations GROUP BY dst"),
    "incoming_lists": (incoming_lists, f"WITH {P_SQL} SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS sources FROM (SELECT DISTINCT src, dst FROM relations WHERE dst IN ('nation:1', 'nation:2', 'region:0', 'part:5')) GROUP BY dst"),
    "coverage_summary": (coverage_summary, f"WITH {P_SQL} SELECT (SELECT count(*) FROM entities) AS total_entities, (SELECT count(*) FROM entities WHERE id IN (SELECT dst FROM relations WHERE kind = 'calls')) AS covered_entities"),
    "audit_latest": (latest_audit, "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50"),
    "entity_hash": (entity_hash, f"WITH {P_SQL} SELECT id, {_HASH_SQL} AS hash FROM entities"),
    "graph_domain_digest": (
        domain_digest,
        f"WITH {P_SQL}, h AS (SELECT {_HASH_SQL} AS hash FROM entities) {merkle.fold_sql('h', 'entities')}",
    ),
    "verify_entities": (verify_entities, f"WITH {P_SQL}, n AS (SELECT id, CAST(split_part(id, ':', 2) AS BIGINT) AS n FROM entities) SELECT id, CASE WHEN n % 5 = 0 THEN 'missing' WHEN n % 7 = 0 THEN 'tampered' ELSE 'valid' END AS status FROM n"),
    "relation_hash": (relation_hash, f"WITH {P_SQL} SELECT id, {_REL_HASH} AS hash FROM relations"),
    "node_hash": (node_hash, f"WITH {P_SQL} SELECT DISTINCT dst AS id, sha256(concat('node-v1:', 'absent', '|', dst)) AS hash FROM relations WHERE dst NOT IN (SELECT id FROM entities WHERE kind <> 'module')"),
    "list_all": (list_all, f"WITH {P_SQL} SELECT id, kind, name FROM entities UNION ALL SELECT id, kind, concat(src, '>', dst) FROM relations"),
    "first_parent_cycles": (first_parent_cycles, "SELECT concat(conv_id, '/', turn) AS id FROM conversations WHERE conv_id % 10 = 0"),
    "subgraph_hash_d2": (subgraph_hash_d2, f"WITH {P_SQL}, s0 AS MATERIALIZED (SELECT id, {_HASH_SQL} AS h FROM entities), {_SUB.format(k=1, j=0).replace('s1 AS (', 's1 AS MATERIALIZED (')}, {_SUB.format(k=2, j=1)} SELECT id, h AS hash FROM s2"),
    "verify_subgraph": (
        verify_subgraph,
        _bfs(P_SQL, "SELECT src, dst FROM relations", "SELECT 'order:1', 0", 1000) + ", n AS (SELECT node, depth, CAST(split_part(node, ':', 2) AS BIGINT) AS k FROM m) SELECT node AS id, CASE WHEN k % 5 = 0 THEN 'tampered' ELSE 'valid' END AS status, depth FROM n WHERE k % 11 <> 0",
    ),
    "domain_digest_rows": (
        customer_digest,
        "WITH h AS (SELECT sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR) AS hash FROM customer) " + merkle.fold_sql("h", "customer"),
    ),
    "subgraph_refresh": (relation_revisit, f"WITH {P_SQL}, s0 AS MATERIALIZED (SELECT id, CASE WHEN id = 'supplier:3' THEN sha256('new') ELSE {_HASH_SQL} END AS h FROM entities), {_SUB.format(k=1, j=0)} SELECT id, h AS hash FROM s1"),
    "scale_neighborhood_2hop": (scale_neighborhood_2hop, _bfs(s_sql(), "SELECT src, dst FROM relations", "SELECT 12, 0", 2) + " SELECT node AS id, depth FROM m"),
    "scale_impact_d5": (scale_impact_d5, _bfs(s_sql(), "SELECT dst AS src, src AS dst FROM relations", "SELECT 13, 0", 5) + " SELECT node AS id, depth FROM m WHERE depth > 0"),
    "scale_dead_code": (
        scale_dead_code,
        f"WITH {s_sql()}, used AS MATERIALIZED (SELECT DISTINCT r.dst FROM relations r JOIN entities s ON s.id = r.src JOIN entities d ON d.id = r.dst WHERE s.file_origin <> d.file_origin) SELECT id, kind FROM entities e WHERE kind IN ({_DEAD}) AND NOT EXISTS (SELECT 1 FROM used WHERE used.dst = e.id)",
    ),
    "scale_lookups": (scale_lookups, "SELECT event_id AS id, event_type FROM events WHERE event_id % 100 = 0 AND event_id < 100000"),
    "first_parent_lineage": (first_parent_lineage, "WITH t AS (SELECT conv_id, turn FROM conversations ORDER BY turn DESC, conv_id LIMIT 1) SELECT concat(c.conv_id, '/', c.turn) AS id, CAST(t.turn - c.turn AS INT) AS distance FROM conversations c JOIN t ON t.conv_id = c.conv_id"),
}
