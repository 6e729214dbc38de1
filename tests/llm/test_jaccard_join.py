import re
from itertools import combinations

import numpy as np
import pytest
from skein.llm import jaccard_join as j


def shingles(t, width=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, t):
    """rows: (doc_id, text). Per row (doc_id, n, links, component)."""
    sets = [shingles(x) for _, x in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            par[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), links[k], least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("t", "boundary"), [(90, None), (90, 29), (80, 9)])
def test_against_brute_force(spark, docs, t, boundary):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = j.jaccard_join(docs, threshold=t, boundary=boundary).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, t)


def test_null_ids_and_no_rows(spark, none):
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, j.jaccard_join(d, boundary=9).collect()), key=str)
    assert got == sorted([(None, 2, 1, 4), (4, 2, 1, 4), (None, 1, 0, None), (None, 0, 0, None)], key=str)
    assert j.jaccard_join(none).count() == 0


def test_keep_one(spark, docs):
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _, _, c in brute(rows, 90) if i == c})


def test_keep_one_decides_by_row(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None), (5, "A A A"), (5, "B B B"), (1, "B B B"), (7, "p q r"), (7, "s t u"), (None, "copy"), (None, "copy"), (8, "x y"), (8, "x y"), (9, ""), (9, "")]
    kept = j.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(4, "a b c d e f"), (None, "z"), (None, None), (5, "A A A"), (1, "B B B"), (7, "p q r"), (7, "s t u"), (None, "copy"), (8, "x y"), (9, ""), (9, "")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("boundary", j.BOUNDARIES)
def test_linked_sets_always_share_a_key(boundary):
    """Random pairs at the very edge of the threshold."""
    rng, first = np.random.default_rng(boundary), j.bands(boundary)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        out = int(rng.integers(0, n // 10 + 1))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - out], rng.integers(0, 2**63, int(rng.integers(0, out + 1)), dtype=np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 90 * (len(a) + len(b) - both):
            assert np.intersect1d(j.keys_of(a, 90, boundary, first), j.keys_of(b, 90, boundary, first)).size


def test_cost_prefers_lists_for_large_sets():
    assert min(j.BOUNDARIES, key=lambda b: j.cost({25: 10**6}, b, 90)) < 29
    assert min(j.BOUNDARIES, key=lambda b: j.cost({12: 10**6}, b, 90)) >= 12
    assert len({min(j.BOUNDARIES, key=lambda b: j.cost({n: 10**6, 2 * n: 10**5}, b, 90)) for n in range(3, 40)}) > 3


def shuffled(df):
    """The columns that the exchanges of a plan move."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return set(re.findall(r"(\w+)#", " ".join(re.findall(r"\n\(\d+\) Exchange *\nInput \[\d+\]: \[(.*?)\]\n", plan))))


def test_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    """Nothing fits a broadcast, every key is hot, lists are cut: the same links and rows, and no text moves."""
    from skein.functions import shared

    seen, real = [], shared.materialize
    docs = real(docs.select("doc_id", "text"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(j, "CHUNK", 4)
    monkeypatch.setattr(j, "materialize", lambda df: seen.append(shuffled(df)) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = brute(rows, 90)
        assert sorted(map(tuple, j.jaccard_join(docs, boundary=19).collect()), key=str) == want
        assert any("k" in c for c in seen) and any("u" in c for c in seen) and not any("text" in c for c in seen)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cascade_is_exact_and_moves_no_row(spark, monkeypatch):
    from pyspark.sql import functions as F
    from skein.functions import shared
    from skein.llm import common

    d = spark.range(60_000).select(F.xxhash64("id").alias("h"), F.xxhash64(F.lit(1), F.col("id")).alias("g"), (F.col("id") % 5 == 0).alias("in"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 17)
    levels = common.cascade_of(d.where("in").select("h", "g"), d.where("not in").select("h", "g"))
    assert len(levels) > 2 and levels[0][0] is not None and levels[-1][0] is None
    marked = d.withColumn("got", common.is_in(levels, F.col("h"), F.col("g")))
    assert marked.where("got != in").count() == 0 and not shuffled(marked)
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 13)
    assert common.cascade_of(d.where("in").select("h", "g"), d.where("not in").select("h", "g")) is None


def test_keep_one_with_filters(spark, docs, monkeypatch):
    from skein.functions import shared

    odd = docs.withColumn("__h", docs["n"]).withColumn("__G", docs["n"]).withColumn("__again", docs["n"])
    want = sorted(((r.doc_id, r.text) for r in j.keep_one(docs).collect()), key=str)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    for filters in (j.cascade_of, lambda a, b: None):
        monkeypatch.setattr(j, "cascade_of", filters)
        kept = j.keep_one(odd)
        assert kept.columns == odd.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want


def test_components_of_a_chain(spark):
    from pyspark.sql import functions as F

    e = spark.range(40).select(F.struct(F.col("id").alias("s1"), F.lit(0).alias("s2")).alias("a"), F.struct((F.col("id") + 1).alias("s1"), F.lit(0).alias("s2")).alias("b"))
    assert {r.root.s1 for r in j.components(e).collect()} == {0} and j.components(e).count() == 41
