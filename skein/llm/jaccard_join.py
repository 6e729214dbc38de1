"""N-gram Jaccard join by size-aware heavy-light processing, exact at any threshold given as a whole percentage.

A document's set is its distinct word shingles. Documents with equal sets form one class; only classes are joined.

* Light sets (size up to a boundary): every subset of a fixed size that a partner could share is enumerated and hashed.
  Two sets of sizes m <= n link only if they share ceil(t*n/100) elements, so both emit a common subset of that size.
* Heavy sets: inverted lists. A list belongs to a block, a range of the hash space, and to the block's whole content
  rather than to one shingle: a passage that a third of all documents share makes one shingle's list quadratic, while
  unrelated sets hardly ever agree on a whole block. A linked pair whose larger set has at most U elements differs in
  at most D = floor(2U(100-t)/(100+t)) of them; with D + 1 + SPARE blocks at least 1 + SPARE agree. Sets with more than
  SPARE empty blocks also list those, so no pair is lost.
* The boundary is the one of least cost under the measured sizes of the sets: emitted subsets against list entries.

Only keys that two classes share matter; they are found by an aggregate that combines before the shuffle, and the lists of
the others are dropped where they were made. Hot lists are cut into chunks that meet in separate tasks. Candidates are
compared exactly; components are found by alternating large-star and small-star steps, whose hubs are spread over tasks.
No text is shuffled: which documents to read again, and which to drop, is told by broadcast filters of bounded size.
Null and empty texts have no set and no link. A repeated row counts as another document. Columns other than the id and the
text aren't read, so they may have any name.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cascade_of, filter_of, fresh, is_in, is_small, lower, materialize, mix, passes, run_hashes, runs, spread_join, text_bounds, text_slices, tidy

#: Up to 9 one subset is emitted, up to 19 subsets lack one element, up to 29 two, up to 39 three.
BOUNDARIES = (5, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 34, 39)
#: What a list entry costs against an emitted subset: it is shuffled as well, and its list is scanned.
ENTRY_COST = 4.0
BAND_RATIO = 1.3
SPARE = 2
#: Members of a list that meet in one task; longer lists are cut.
CHUNK = 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_C = U64(0xD6E8FEB86659FD93)
_K1, _K2, _K3 = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    buf = lower(buf)
    n = len(off) - 1
    starts, ends, doc = runs(~_SPACE[buf], off)
    with np.errstate(over="ignore"):
        h = run_hashes(buf, starts, ends)
        bound = text_bounds(doc, n)
        m = len(h) - width + 1
        if m > 0:
            s = h[:m].copy()
            for k in range(1, width):
                s = s * _C + h[k : m + k]
            s = mix(s + U64(width))
        out = []
        for d in range(n):
            a, b = bound[d], bound[d + 1]
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:
                x = h[a]
                for k in range(a + 1, b):
                    x = x * _C + h[k]
                out.append(mix(np.array([x + U64(b - a)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def signature(u: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        s1, s2 = mix(u ^ _K1).sum(dtype=U64), mix(u ^ _K2).sum(dtype=U64)
    return int(s1.view(np.int64)), int(s2.view(np.int64))


def bands(boundary: int, largest: int = 1 << 40) -> list[int]:
    """First size of each band of heavy sets."""
    out, x = [], boundary + 1
    while x <= largest:
        out.append(x)
        x = max(x + 1, int(x * BAND_RATIO))
    return out


def blocks(upper: int, t: int) -> int:
    return (2 * upper * (100 - t)) // (100 + t) + 1 + SPARE


def keys_of(u: np.ndarray, t: int, boundary: int, first: list[int]) -> np.ndarray:
    """The keys under which a set meets every set that it may link with."""
    n = len(u)
    if not n:
        return np.zeros(0, U64)
    least, most = -(-t * n // 100), n * 100 // t
    out = []
    with np.errstate(over="ignore"):
        m = mix(u ^ _K3)
        if n <= boundary:
            total = m.sum(dtype=U64)
            for k in range(n - least + 1):
                if k == 0:
                    sums = total.reshape(1)
                elif k == 1:
                    sums = total - m
                else:
                    pick = np.array(list(combinations(range(n), k)))
                    sums = total - m[pick].sum(axis=1, dtype=U64)
                out.append(mix(sums + U64(n - k) * _C))
        if most > boundary:
            lo = max(0, int(np.searchsorted(first, max(n, boundary + 1), "right")) - 1)
            hi = int(np.searchsorted(first, most, "right")) - 1
            cum = np.concatenate([np.zeros(1, U64), np.cumsum(m, dtype=U64)])
            for band in range(lo, hi + 1):
                p = blocks(first[band + 1] - 1, t)
                at = ((u >> U64(32)) * U64(p)) >> U64(32)
                bound = np.searchsorted(at, np.arange(p + 1, dtype=U64))
                keep = np.diff(bound) > 0
                if p - keep.sum() > SPARE:
                    keep[:] = True
                sums = cum[bound[1:]] - cum[bound[:-1]]
                out.append(mix((sums ^ mix(np.arange(p, dtype=U64) + U64(band + 1) * U64(1 << 32)))[keep]))
    return np.concatenate(out) if out else np.zeros(0, U64)


def cost(sizes: dict[int, int], boundary: int, t: int) -> float:
    """Of handling the measured sets: subsets of the light ones, list entries of the heavy ones and of their neighbours in size."""
    first, total = bands(boundary, 1 << 12), 0.0
    for n, count in sizes.items():
        least, most = -(-t * n // 100), n * 100 // t
        if n <= boundary:
            total += count * sum(comb(n, k) for k in range(n - least + 1))
        if most > boundary:
            lo = max(0, int(np.searchsorted(first, max(n, boundary + 1), "right")) - 1)
            hi = int(np.searchsorted(first, most, "right")) - 1
            total += count * ENTRY_COST * sum(blocks(first[b + 1] - 1, t) for b in range(lo, hi + 1))
    return total


def choose_boundary(docs: DataFrame, text: str, t: int, width: int) -> int:
    """By the number of sets of each size up to twice the largest boundary, over all documents."""
    cap = 2 * max(BOUNDARIES)
    words = F.size(F.split(F.trim(F.col(text)), r"[\x20\x09-\x0D]+"))
    hist = (
        docs.where(F.length(F.col(text)) < 64 * cap)
        .select(F.greatest(words - (width - 1), F.lit(1)).alias("n"))
        .where(F.col("n") <= cap)
        .groupBy("n")
        .count()
        .collect()
    )
    sizes = {r["n"]: r["count"] for r in hist}
    return min(BOUNDARIES, key=lambda b: (cost(sizes, b, t), b))


def _emit(t: int, width: int, boundary: int):
    """Columns behind the text are passed on."""
    first = bands(boundary)

    def run(batches):
        seen: set = set()  # classes that this task has listed; bounded, so a class may be listed again, which is harmless
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            for lo, hi, buf, off in text_slices(col):
                n, s1, s2, keys = [], [], [], []
                for u in shingle_sets(buf, off, width):
                    n.append(len(u))
                    a, b = signature(u)
                    s1.append(a)
                    s2.append(b)
                    if not len(u) or (a, b) in seen:
                        keys.append(None)
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add((a, b))
                    keys.append(keys_of(u, t, boundary, first).view(np.int64))
                more = [batch.column(i).slice(lo, hi - lo) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *more],
                    names=["doc_id", "n", "s1", "s2", "keys", *batch.schema.names[2:]],
                )

    return run


def _sets(width: int):
    def run(batches):
        seen: set = set()
        for batch in batches:
            for _, _, buf, off in text_slices(batch.column(0)):
                rows = []
                for u in shingle_sets(buf, off, width):
                    sig = signature(u)
                    if len(u) and sig not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(sig)
                        rows.append((*sig, u.view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["s1", "s2", "u"])

    return run


def _entries_of(shared):
    """Rows (k, s1, s2, n) of the listed keys that pass a broadcast filter."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            k = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            keep = passes(shared.value, k, k)
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), *(batch.column(i).take(at) for i in range(3))], names=["k", "s1", "s2", "n"])

    return run


def _sid(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}s1").alias("s1"), F.col(f"{prefix}s2").alias("s2"))


def shared_entries(listed: DataFrame) -> DataFrame:
    """Distinct rows (k, s1, s2, n) of the keys that at least two classes list (and some more keys if these are many). listed: s1, s2, n, keys."""
    keys = listed.select(F.explode("keys").alias("k"), "s1").groupBy("k").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo != hi")
    shared, _ = filter_of(materialize(keys.select(F.col("k").alias("h"), F.col("k").alias("g"))))
    found = listed.sparkSession.sparkContext.broadcast(shared)
    return materialize(listed.select("s1", "s2", "n", "keys").mapInArrow(tidy(_entries_of(found)), "k long, s1 long, s2 long, n long").distinct())


def candidate_pairs(entries: DataFrame) -> DataFrame:
    """Pairs a < b of classes that share a key, with their sizes, over distinct rows (k, s1, s2, n). A key may belong to a third of all classes."""
    many = entries.groupBy("k").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("c")).where("c > 1")
    cut = spread_join(entries, materialize(many), ["k"], ["s1", "s2"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    left = cut.select("k", F.pmod(F.xxhash64("s1", "s2"), F.col("c")).cast("int").alias("chunk"), _sid().alias("a"), F.col("n").alias("na"))
    right = cut.select("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("chunk"), _sid().alias("b"), F.col("n").alias("nb"))
    return left.join(right, ["k", "chunk"]).where(F.col("a") < F.col("b"))


def verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, compared exactly.

    A candidate group of m sets has up to m * m / 2 pairs, so whole sets aren't sent to pairs. Each set is written once as
    its difference from a hub, its least candidate partner: removed and added elements, few among near copies. With a
    common hub H, |A & B| = |H| - |Ra | Rb| + |Da & Db|. Pairs without a common hub get their whole sets.
    """
    hubs = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("hub"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    of = ids.join(hubs, "id", "left").select("id", F.coalesce("hub", "id").alias("hub"))
    core = sets.select(F.col("id").alias("hub"), F.col("u").alias("h"))
    of = materialize(of)
    diff = (
        spread_join(sets.join(of, "id"), core, ["hub"], ["id"], counted=of)
        .select("id", "hub", F.array_except("h", "u").alias("r"), F.array_except("u", "h").alias("d"), F.size("u").cast("long").alias("n"), F.size("h").cast("long").alias("hn"))
    )
    diff = materialize(diff)
    side = lambda x: diff.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("hub", "r", "d", "n", "hn")])
    reach = F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * t
    both = spread_join(spread_join(pairs, side("a"), ["a"], ["b"], counted=pairs), side("b"), ["b"], ["a"], counted=pairs)
    same = both.where(F.col("hub_a") == F.col("hub_b")).withColumn(
        "both", F.col("hn_a") - F.size(F.array_union("r_a", "r_b")).cast("long") + F.size(F.array_intersect("d_a", "d_b")).cast("long")
    )
    apart = spread_join(spread_join(pairs, of.withColumnRenamed("id", "a"), ["a"], ["b"]), of.select(F.col("id").alias("b"), F.col("hub").alias("hub_b")), ["b"], ["a"])
    apart = materialize(apart.where(F.col("hub") != F.col("hub_b")).select("a", "b"))
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("u").alias(f"u_{x}"), F.size("u").cast("long").alias(f"n_{x}"))
    other = spread_join(spread_join(apart, whole("a"), ["a"], ["b"], counted=apart), whole("b"), ["b"], ["a"], counted=apart).withColumn("both", F.size(F.array_intersect("u_a", "u_b")).cast("long"))
    return same.where(reach).select("a", "b").unionByName(other.where(reach).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component. Large-star and small-star steps alternate until nothing changes."""

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r["n"], r["x"]

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e, last = materialize(e), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both, least, ["a"], ["b"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = spread_join(large, low, ["a"], ["b"])
        step = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        e = materialize(step)
        now = mark(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _classes(src: DataFrame, threshold: int, width: int, boundary: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, s1, s2, further columns of src) and the classes that have a link or copies: (s1, s2, n_similar, component, root).

    component is the least id and root the least class of the linked ones. src: doc_id, text and any columns to pass on.
    """
    if boundary is None:
        boundary = choose_boundary(src, "text", threshold, width)
    more = src.drop("doc_id", "text").schema
    listed = materialize(src.mapInArrow(tidy(_emit(threshold, width, boundary)), ", ".join(["doc_id long, n long, s1 long, s2 long, keys array<long>", *(f"{c.name} {c.dataType.simpleString()}" for c in more)])))
    rows = listed.drop("keys")
    classes = materialize(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    within = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold
    pairs = materialize(candidate_pairs(shared_entries(listed.where("keys is not null"))).where(within).select("a", "b").distinct())

    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().select("a.s1", "a.s2")
    ids = materialize(classes.join(wanted, ["s1", "s2"]).select("rep").distinct())
    if is_small(ids):
        ids = F.broadcast(ids)
        texts = src.join(ids, src["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")
    else:
        # Documents that the filter lets pass by mistake only give sets that no pair names.
        marks = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))
        chosen, _ = filter_of(ids.select(*(m.alias(n) for m, n in zip(marks(F.col("rep")), "hg"))))
        texts = src.where(is_in([chosen], *marks(F.col("doc_id")))).select("text")
    sets = materialize(texts.mapInArrow(tidy(_sets(width)), "s1 long, s2 long, u array<long>").dropDuplicates(["s1", "s2"]))
    links = materialize(verified(pairs, sets.select(_sid().alias("id"), "u"), threshold))

    copies = classes.select(_sid().alias("b"), "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("near"))
    tree = components(links)
    named = classes.select(_sid().alias("node"), "rep", "copies").join(tree, "node")
    best = named.groupBy("root").agg(F.min("rep").alias("least"))
    linked = spread_join(named, best, ["root"], ["node"]).join(near.withColumnRenamed("a", "node"), "node").select("node.s1", "node.s2", "least", "near", "root")
    known = classes.join(linked, ["s1", "s2"], "left").where("copies > 1 or least is not null")
    known = known.select("s1", "s2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"), F.coalesce("least", "rep").alias("component"), F.coalesce("root", _sid()).alias("root"))
    return rows, known


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 90, width: int = 5, boundary: int | None = None) -> DataFrame:
    """Per document: n_shingles, n_similar (other documents whose sets reach the threshold, in percent) and component_id (least id reachable by links).

    A null id stays null and can't be the least of its component unless all are null.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, known = _classes(src, threshold, width, boundary)
    # A class of copies may hold a third of all rows.
    return spread_join(rows, materialize(known.drop("root")), ["s1", "s2"], ["doc_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, threshold: int = 90) -> DataFrame:
    """Of each component of linked documents one row, with the least id that isn't null if there is any; its columns as they are.

    Decided by row, told by id and text, so rows that share an id or have none don't share their fate. Rows without a set
    have no links and stay.
    """
    # The literal comes first: a hash seeds that of the next column, so behind it there would be no new bits.
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    src = docs.select(id_.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    rows, known = _classes(src, threshold, 5, None)
    known = materialize(known.select("s1", "s2", F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2")))
    # A class of copies may hold a third of all rows; rows of one id and text are counted first.
    linked = materialize(spread_join(rows, known, ["s1", "s2"], ["doc_id", "t1"]).groupBy("r1", "r2", "doc_id", "t1", "t2").agg(F.count("*").alias("copies")))
    first = linked.groupBy("r1", "r2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    decided = spread_join(linked, first, ["r1", "r2"], ["doc_id", "t1"]).select("doc_id", "t1", "t2", "copies", stays.alias("stays"))
    marks = lambda: [F.xxhash64("doc_id", "t1").alias("h"), F.xxhash64(F.lit(2), F.col("doc_id"), F.col("t2")).alias("g")]
    decided = materialize(decided.select(*marks(), "copies", "stays"))
    gone, twice = decided.where("not stays").select("h", "g"), decided.where("stays and copies > 1").select("h", "g")

    h, g = fresh(docs, "__h"), fresh(docs, "__g")
    marked = docs.select("*", F.xxhash64(id_, F.xxhash64(text)).alias(h), F.xxhash64(F.lit(2), id_, F.xxhash64(F.lit(1), text)).alias(g))
    far = gone.select(F.col("h").alias(h), F.col("g").alias(g))
    if is_small(gone):
        kept = marked.join(F.broadcast(far), [h, g], "left_anti")
    elif (dropped := cascade_of(gone, rows.select(*marks()).join(gone, ["h", "g"], "left_anti"))) is not None:
        kept = marked.where(~is_in(dropped, F.col(h), F.col(g)))
    else:
        kept = marked.join(far, [h, g], "left_anti")
    if twice.isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    # One of rows with the same id and text: only these are shuffled.
    again, _ = filter_of(twice)
    kept = kept.withColumn(fresh(kept, "__again"), is_in([again], F.col(h), F.col(g)))
    flag = kept.columns[-1]
    return kept.where(~F.col(flag)).unionByName(kept.where(F.col(flag)).dropDuplicates([h, g])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_sql(threshold: int = 90, width: int = 5) -> str:
    """The same in SQL, by counting common shingles of all pairs that have any; for small tables."""
    upper, lower_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = "concat_ws(' ', " + ", ".join(f"w[i + {k}]" for k in range(width)) + ")"
    return (
        rf"WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower_}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), "
        f"g AS (SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: {grams}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t), "
        "s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(s) AS x FROM g), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
        "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2), "
        f"l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {threshold} * (na.n + nb.n - k)), "
        "r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c) "
        "SELECT d.doc_id, coalesce((SELECT n FROM n WHERE n.doc_id = d.doc_id), 0) AS n_shingles, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_similar, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d"
    )
