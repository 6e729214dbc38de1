"""Domain stores: work, reviews, verification, provenance, sessions. All are keyed tables; what differs is one filter each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_scope(items: DataFrame, tag: str, id_: str) -> DataFrame:
    """Items (scopes: array<struct<tag, id>>) that name a node."""
    return items.where(F.exists("scopes", lambda s: (s["tag"] == tag) & (s["id"] == id_)))


def work_items(items: DataFrame, kind: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("kind", kind), ("status", status)):
        if value is not None:
            items = items.where(F.col(column) == value)
    return items


def tests_for(entity, tests: DataFrame, relations: DataFrame) -> DataFrame:
    """Tests with a covering relation to an entity."""
    hit = relations.where((F.col("kind") == "covers") & (F.col("dst") == entity)).select(F.col("src").alias("test_id"))
    return tests.join(hit, "test_id", "left_semi")


def runs_of(test_id: str, runs: DataFrame) -> DataFrame:
    return runs.where(F.array_contains("test_ids", test_id))


def approvals_for(change, approvals: DataFrame) -> DataFrame:
    return approvals.where(F.col("change_id") == change)


def audit(events: DataFrame, actor: str | None, limit: int) -> DataFrame:
    out = events if actor is None else events.where(F.col("actor_id") == actor)
    return out.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def traffic(intents: DataFrame, sessions: DataFrame, warnings: DataFrame, now) -> DataFrame:
    """(tag, id, intents, sessions, warnings) for every node that an unexpired intent of a known session names."""
    live = intents.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))).join(sessions.select("session_id"), "session_id", "left_semi")
    each = live.select("intent_id", "session_id", F.explode("scopes").alias("s"))
    w = warnings.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("warnings"))
    g = each.groupBy(F.col("s.tag").alias("tag"), F.col("s.id").alias("id")).agg(F.countDistinct("intent_id").alias("intents"), F.countDistinct("session_id").alias("sessions"))
    return g.join(w, "id", "left").select("tag", "id", "intents", "sessions", F.coalesce("warnings", F.lit(0)).alias("warnings"))
