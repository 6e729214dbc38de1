"""Full-text search: weighted fields, postings, BM25, search at a point of history.

Score = sum over query tokens of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf the sum of field weights over the token's places, length the number of tokens.
A token that only holds the query's token as a part counts with PART of its weight, so `adrea` finds QuadReader's parts too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.names import python_tokens, tokens
from skein.functions.shared import materialize

K1, B = 1.2, 0.75
PART = 0.25
#: Rows whose tokens are counted in one task.
POSTING_ROWS = 50_000


def with_fields(docs: DataFrame, fields: Column, key: str = "id") -> DataFrame:
    """(key, fields) ready for postings(); fields: array<struct<text, weight>>."""
    return docs.select(key, fields.alias("fields"))


def postings(fielded: DataFrame, key: str = "id") -> DataFrame:
    """(token, key, tf, length): one row per token and document, combined before the shuffle."""
    # One row a field first, so that each text is cut into tokens once.
    # Short rows hold many tokens for their bytes, so they are spread by their number before they're cut up.
    n = -(-fielded.select(key).count() // POSTING_ROWS)
    if n > 1:
        fielded = fielded.repartition(max(n, int(fielded.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    each = fielded.select(key, F.explode("fields").alias("f")).select(key, F.col("f.weight").alias("w"), tokens(F.col("f.text")).alias("t"))
    cut = each.select(key, F.explode("t").alias("token"), "w").groupBy(key, "token").agg(F.sum("w").alias("tf"), F.count("*").cast("int").alias("n"))
    from pyspark.sql import Window

    # Only combined rows are moved once more for the lengths.
    return cut.withColumn("length", F.sum("n").over(Window.partitionBy(key)).cast("int")).select("token", key, "tf", "length")


def _idf(n: float, df: float) -> Column:
    return F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))


def query_hits(post: DataFrame, query: str, key: str = "id", part: float = PART) -> DataFrame:
    """(key, length, t, tf): for every document and query token the weight of its places, whole tokens and parts of tokens."""
    want = sorted(set(python_tokens(query)))
    if part:
        each = F.filter(F.array(*[F.when(F.col("token").contains(t), F.struct(F.lit(t).alias("t"), F.when(F.col("token") == t, 1.0).otherwise(part).alias("w"))) for t in want]), lambda x: x.isNotNull()) if want else F.array().cast("array<struct<t:string,w:double>>")
        found = post.select(key, "length", "tf", F.explode(each).alias("x"))
        return found.groupBy(key, "length", F.col("x.t").alias("t")).agg(F.sum(F.col("tf") * F.col("x.w")).alias("tf"))
    return post.where(F.col("token").isin(*want)).select(key, "length", F.col("token").alias("t"), "tf")


def search_postings(post: DataFrame, lengths: DataFrame, query: str, limit: int | None = None, key: str = "id", k1: float = K1, b: float = B, part: float = PART) -> DataFrame:
    """(key, score), best first with ties by key. lengths: (key, length) of all documents. With part = 0 only whole tokens match, and the token filter is pushed into the scan."""
    head = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    hits = materialize(query_hits(post, query, key, part))
    df = {r["t"]: r["df"] for r in hits.groupBy("t").agg(F.count("*").alias("df")).collect()}
    if not df:
        return lengths.limit(0).select(key, F.lit(0.0).alias("score"))
    idf = F.create_map(*[x for t, d in df.items() for x in (F.lit(t), _idf(head["n"], d))])[F.col("t")]
    share = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / head["mean"]))
    out = hits.groupBy(key).agg(F.round(F.sum(share), 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def search_texts(docs: DataFrame, query: str, limit: int | None = None, key: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """The same over one unweighted text column without an index: one pass for the counts, one for the scores, no shuffle but the top."""
    want = sorted(set(python_tokens(query)))
    t = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))

    def places(word: str) -> Column:
        return F.size(F.filter("t", lambda x: x == word)).cast("double")

    tfs = [places(w).alias(f"tf{i}") for i, w in enumerate(want)]
    # A few numbers a document, kept so that texts are cut into tokens once.
    m = materialize(t.select(key, F.size("t").alias("length"), *tfs))
    head = m.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(want))]).first()
    if not head["n"] or not want:
        return docs.limit(0).select(key, F.lit(0.0).alias("score"))
    norm = k1 * (1 - b + b * F.col("length") / F.lit(head["mean"] or 1.0))
    score = reduce(lambda x, y: x + y, [_idf(head["n"], head[f"df{i}"]) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(want))])
    hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(want))])
    out = m.where(hit).select(key, F.round(score, 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def doc_frequency(post: DataFrame, query: str) -> int:
    """Documents with the query's rarest token; 0 if any token is unknown."""
    want = sorted(set(python_tokens(query)))
    found = {r["token"]: r["df"] for r in post.where(F.col("token").isin(*want)).groupBy("token").agg(F.count("*").alias("df")).collect()}
    return min((found.get(t, 0) for t in want), default=0)


def text_frequencies(docs: DataFrame, queries: list[str], text: str = "text") -> list[int]:
    """doc_frequency() of each query over one text column without an index: one pass over the texts, which moves only counts."""
    wants = [sorted(set(python_tokens(q))) for q in queries]
    every = sorted({t for w in wants for t in w})
    if not every:
        return [0] * len(queries)
    # The pieces are an array that is made once a row and read by one lambda.
    have = docs.select(F.array_intersect(tokens(F.coalesce(F.col(text), F.lit(""))), F.array(*[F.lit(t) for t in every])).alias("t"))
    found = {r["t"]: r["n"] for r in have.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    return [min((found.get(t, 0) for t in w), default=0) for w in wants]


def active_at(introduced: Column, ended: Column, at: Column) -> Column:
    """Introduced no later than the point, and not ended by it: what ends there is inactive."""
    return (introduced <= at) & (ended.isNull() | (at < ended))


def search_at(ranked: DataFrame, annotations: DataFrame, at: int, limit: int, key: str = "id") -> DataFrame:
    """Of the best 3 * limit hits those active at a point, at most limit. Hits without annotation are dropped, so fewer may come."""
    top = ranked.orderBy(F.desc("score"), key).limit(3 * limit)
    alive = annotations.where(active_at(F.col("introduced"), F.col("ended"), F.lit(at))).select(key)
    return top.join(alive, key, "left_semi").orderBy(F.desc("score"), key).limit(limit)


def resolve_roles(hits: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """hits with the role of entities, null for others."""
    return hits.join(entities.select(key, "role"), key, "left")
