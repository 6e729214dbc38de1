"""Mixing, sharding, decontamination and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from skein.llm import decontaminate as dec
from skein.llm import mixing, queries, sharding

# mixing


def cells(n=60, seed=1):
    rng = random.Random(seed)
    rows = {(f"s{rng.randrange(6)}", f"l{rng.randrange(4)}", f"t{rng.randrange(3)}") for _ in range(n)}
    return pd.DataFrame([(*k, rng.randrange(0, 5000)) for k in sorted(rows)], columns=["source", "lang", "topic", "tokens"])


def test_raking_reaches_all_marginals():
    c = cells(400)
    want = {"source": {f"s{i}": 1 / 6 for i in range(6)}, "lang": {"l0": 0.4, "l1": 0.3, "l2": 0.2, "l3": 0.1}, "topic": {f"t{i}": 1 / 3 for i in range(3)}}
    w = mixing.rake(c, want, sweeps=200) * c["tokens"]
    for d, shares in want.items():
        got = w.groupby(c[d]).sum() / w.sum()
        assert all(abs(got[k] - v) < 1e-6 for k, v in shares.items())


def test_table_and_driver_rake_alike(spark):
    c = cells()
    for targets in (None, {"lang": {"l0": 1.0, "l1": 2.0}}):
        got = mixing.rake_table(spark.createDataFrame(c), targets, sweeps=3).toPandas().sort_values(["source", "lang", "topic"])
        assert np.allclose(got["factor"], mixing.rake(c, targets, sweeps=3))
        f = got["factor"].to_numpy()
        assert mixing._calibrate_table(spark.createDataFrame(got), 0.7) == pytest.approx(mixing.calibrate(got["tokens"].to_numpy(float), f, 0.7), rel=1e-6)


@pytest.mark.parametrize("keep", [0.1, 0.5, 0.9, 1.0])
def test_calibration(keep):
    rng = np.random.default_rng(3)
    t, f = rng.integers(1, 100, 50).astype(float), rng.random(50) * 5 + 0.01
    assert (t * np.minimum(1, mixing.calibrate(t, f, keep) * f)).sum() == pytest.approx(keep * t.sum())


def test_mixing_frames(spark, docs, none):
    w = mixing.weigh(docs).collect()
    assert len(w) == docs.count() and all(r["__prob"] is not None for r in w)
    for r in w:
        u = int(hashlib.md5(f"{r.doc_id}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["__draw"] == u and r["__tokens"] == len([x for x in (r.text or "").split() if x])
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and mixing.sample(none).count() == 0
    every = mixing.sample(docs, keep=1.0)
    assert every.count() == docs.count()
    odd = docs.withColumn("__draw", F.lit("x")).withColumn("__TEXT", F.lit(1)).withColumn("__source", F.lit(None).cast("string"))
    assert mixing.sample(odd).columns == odd.columns and mixing.sample(odd).count() == kept.count()


def plain_topic(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    hits = [sum(w in ws.split() for w in words) for ws in mixing.TOPICS.values()]
    return list(mixing.TOPICS)[hits.index(max(hits))] if max(hits) else "general"


def test_topics_equal_a_scalar_version():
    rng = random.Random(4)
    vocab = [w for ws in mixing.TOPICS.values() for w in ws.split()] + ["the", "Ünd", "x1", "liga,", "LICENSE", "río.", "(tier)"]
    texts = ["", "  ", "liga", None, "contrato-ley"] + [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    raw = [(t or "").encode() for t in texts]
    got, tokens = mixing.Lexicon(mixing.TOPICS).measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got == [plain_topic(t) for t in texts] and tokens.tolist() == [len((t or "").split()) for t in texts]
    assert len(mixing.TOPICS) > 4 and len(set(got)) > 10


def test_raking_ends_when_the_targets_are_met():
    for seed in range(5):
        c = cells(400, seed)
        m = mixing.marginals(c, mixing.rake(c))
        assert np.allclose(m["weighted"], m["target"], rtol=1e-9) and set(m["dimension"]) == set(mixing.DIMENSIONS)
    apart = pd.DataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], columns=["source", "lang", "topic", "tokens"])
    m = mixing.marginals(apart, mixing.rake(apart, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}), {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    assert (m["weighted"] / m["target"] - 1).abs().max() > 0.5  # out of reach, and reported


def test_a_hot_source_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    from skein.functions import shared

    want = sorted(r.doc_id for r in mixing.sample(docs).where("doc_id is not null").collect())
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    assert sorted(r.doc_id for r in mixing.sample(docs).where("doc_id is not null").collect()) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(name, spark, sf, duck):
    from compare import rows

    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())


# sharding


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        i = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
        rooms[i] -= s
        out.append((s, i))
    return collections.Counter(out)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 50), 7, 20]) for _ in range(rng.randrange(1, 200))]
    hist = sorted(collections.Counter(sizes).items(), reverse=True)
    got = collections.Counter()
    for s, shard, n in sharding.best_fit(hist, 60):
        got[s, shard] += n
    assert got == plain_best_fit(sizes, 60)


def test_sizes_are_rounded_up_to_leading_bits(spark):
    sizes = [1, 16, 2047, 2048, 2049, 2051, 4095, 4097, 10**6, 10**9 + 7, 2**40 + 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x long").select(sharding.rounded(F.col("x"))).collect()]
    for x, y in zip(sizes, got):
        unit = 1 << max(0, x.bit_length() - sharding.SIGNIFICANT)
        assert y == -(-x // unit) * unit and x <= y < x * (1 + 2**-10) + 1


def test_packing_is_quick_for_any_corpus():
    import time

    sizes = [(k << e, 1 + (k * 7919) % 50) for e in range(24) for k in range(1024, 2048)]
    began = time.thread_time()
    capacity, runs = sharding.pack(sizes, 40)
    assert time.thread_time() - began < 60 and sum(n for _, _, n in runs) == sum(n for _, n in sizes)
    assert capacity <= 1.001 * max(sum(s * n for s, n in sizes) / 40, max(s for s, _ in sizes)) + 1


def test_treap():
    t, held, rng = sharding.Treap(), [], random.Random(0)
    for _ in range(2000):
        k = (rng.randrange(50), rng.randrange(50))
        if rng.random() < 0.6 and k not in held:
            t.insert(k)
            held.append(k)
        elif held:
            gone = held.pop(rng.randrange(len(held)))
            t.remove(gone)
        assert t.ceiling(k) == min((h for h in held if h >= k), default=None)


def check_shards(rows, source, shards):
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in source)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in rows)
    return {k: sum(r.size for r in v) for k, v in by.items()}


def test_shards(spark, docs, none):
    source = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = sharding.shard(docs, 5).collect()
    loads = check_shards(rows, source, 5)
    mean = sum(loads.values()) / 5
    text = dict(source)
    where = collections.defaultdict(set)
    for r in rows:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        where[t].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items()) and max(loads.values()) <= max(mean * 1.3, max(r.size for r in rows))
    assert sharding.shard(none).count() == 0


def test_a_group_larger_than_a_shard_is_cut(spark):
    d = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = sharding.shard(d, 8).collect()
    loads = check_shards(rows, [(i, None) for i in range(600)], 8)
    assert max(loads.values()) < 1.02 * sum(loads.values()) / 8 and len({r.piece for r in rows}) > 1


# decontamination

ITEMS = [(1, "What colour is the tall green castle on the northern hill. It is emerald mostly."), (2, "Name the river that runs through seven old cities and one lake. The silver river."), (3, "Short one"), (4, None), (5, ""), (6, "Name the river that runs through seven old cities and one lake. The silver river."), (7, "one sentence without any end that goes on for rather many words here")]


def brute_scores(words, items, stats):
    total, mean, df = stats
    out = {}
    for i, w in items.items():
        tf = collections.Counter(w)
        imp = {t: np.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in tf.items()}
        out[i] = sum(v for t, v in imp.items() if t in words) / sum(imp.values())
    return out


def test_search_finds_all_above_the_threshold():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab[: rng.choice([5, 60])]) for _ in range(rng.randrange(3, 30))) for _ in range(150)]
    words = {i: [int(x) for x in dec.words_of_text(t)] for i, t in enumerate(texts)}
    df = collections.Counter(x for w in words.values() for x in set(w))
    stats = len(texts), float(np.mean([len(w) for w in words.values()])), df
    for threshold in (0.35, 0.6, 0.9):
        ix = dec.Index(list(words), texts, *stats, threshold=threshold)
        for _ in range(60):
            q = {int(x) for x in dec.words_of_text(" ".join(rng.sample(vocab, rng.randrange(1, 40))))}
            terms = np.flatnonzero(np.isin(ix.terms, np.array(list(q), np.uint64)))
            got = {ix.ids[i]: s for g in range(int(ix.group_of.max()) + 1) for i, s in ix.search(terms, g)}
            want = {i: s for i, s in brute_scores(q, words, stats).items() if s >= threshold}
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-5 for i in got)
            live = set(np.flatnonzero(ix.bound[terms].sum(axis=0) >= threshold - dec.COMMON - 1e-5).tolist())
            assert {int(ix.group_of[ix.ids.index(i)]) for i in want} <= live


def plain_leaks(docs, items, threshold=0.6, overlap=0.6):
    """(doc, item) by scoring every item against all windows of its own length class, one by one."""
    split = {i: dec.split_item(t or "") for i, t in items}
    split = {i: p for i, p in split.items() if len(p[0])}
    words = {i: [int(x) for x in p[0]] for i, p in split.items()}
    df = collections.Counter(x for w in words.values() for x in set(w))
    stats = len(words), float(np.mean([len(w) for w in words.values()])), df
    out = set()
    for d, t in docs:
        h = dec.words_of_text(t or "")
        for i, w in words.items():
            size = max(8, 1 << (len(w) - 1).bit_length())
            for s in range(0, max(1, len(h) - size + 1), size):
                part = h[s : s + 2 * size]
                if len(part) and brute_scores({int(x) for x in part}, {i: w}, stats)[i] >= threshold - 1e-6:
                    g = {tuple(part[k : k + n].tolist()) for n in (1, 2, 3) for k in range(len(part) - n + 1)}
                    share = lambda x: np.mean([v in g for v in {tuple(x[k : k + min(3, len(x))].tolist()) for k in range(len(x) - min(3, len(x)) + 1)}]) if len(x) else 1.0
                    if share(split[i][1]) >= overlap and share(split[i][2]) >= overlap:
                        out.add((d, i))
    return out


def leaky(seed):
    """Texts with whole items, halves of items, and questions far from their answers; items of 5 to 3,000 words."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, f"{say(n)}. {say(max(1, n // 3))}.") for k, n in enumerate([4, 6, 9, 14, 20, 30, 50, 90, 14, 20])]
    docs = []
    for k in range(40):
        q, a, _ = rng.choice(items)[1].split(".")
        gap = rng.choice([0, 0, 5, 40, 500])
        docs.append((k, f"{say(rng.randrange(200))} {q if rng.random() < 0.8 else ''} {say(gap)} {a if rng.random() < 0.8 else ''} {say(rng.randrange(60))}"))
    return docs, items, [(99, f"{say(2600)}. {say(400)}.")]


def test_leaks_equal_a_search_of_every_window(spark, monkeypatch):
    docs, items, more = leaky(3)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    run = lambda own: {(r.doc_id, r.item_id): (r.first_word, r.question_overlap) for r in dec.find_leaks(frame(docs, "doc_id"), frame(own, "item_id")).collect()}
    got = run(items)
    assert set(got) == plain_leaks(docs, items) and len(got) > 5
    # An unrelated long item changes the windows of no other; neither do blocks.
    assert {k: v for k, v in run(items + more).items() if k[1] != 99} == got
    monkeypatch.setattr(dec, "ITEM_BLOCK", 1)
    assert run(items) == got
    monkeypatch.setattr(dec, "ITEM_BLOCK", 100)
    monkeypatch.setattr(dec, "WORD_BLOCK", 60)
    assert run(items) == got
    odd = frame(docs, "doc_id").selectExpr("*", "1 as __words", "2 as __WORDS_")
    assert dec.clean(odd, frame(items, "item_id")).columns == odd.columns


def test_leaks(spark, docs, none):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = "lorem ipsum dolor sit amet " * 30
    planted = [(900, filler + ITEMS[0][1] + " " + filler), (901, ITEMS[1][1].upper().replace(".", " -")), (902, "Name the river that runs through seven old cities and one lake."), (903, "the silver river"), (904, "a short one b"), (905, "x " + ITEMS[6][1]), (906, None)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect()}
    assert found == {(900, 1), (901, 2), (901, 6), (904, 3), (905, 7)}
    kept = dec.clean(d, b)
    assert {900, 901, 904, 905}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == d.count() - 4
    assert dec.clean(docs, b).columns == docs.columns and dec.find_leaks(none, b).count() == 0
    assert dec.find_leaks(docs, b.limit(0)).count() == 0 and dec.clean(docs, b.limit(0)).count() == docs.count()


def test_leaks_query_against_substrings(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in dec.op3_decontaminate(spark, sf).collect()}
    assert {(d.doc_id, i) for d in docs for i, t in items.items() if t in d.text} <= found
    grams = lambda t: {tuple(w[k : k + 3]) for w in [dec.words_of_text(t).tolist()] for k in range(len(w) - 2)}
    text = {d.doc_id: d.text for d in docs}
    assert all(len(grams(items[i]) & grams(text[d])) > 0.5 * len(grams(items[i])) for d, i in found)


def test_blocks_of_items_find_the_same(spark, sf, monkeypatch):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect()}
    monkeypatch.setattr(dec, "ITEM_BLOCK", 9)
    assert {(r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect()} == one


# pipeline


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as p
    from test_jaccard_join import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(p.STAGES)
    good = p.materialize(stage["quality_classifier"](spark, docs, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels[i] == 0 for i in kept & set(labels)) <= 0.1 * sum(v == 0 for v in labels.values()) + 1
    assert sum(labels[i] == 1 for i in kept & set(labels)) >= 0.95 * sum(v == 1 for v in labels.values())
    one = p.materialize(stage["ngram_jaccard_join"](spark, good, sf))
    want = {i for i, _, _, c in brute([(r.doc_id, r.text) for r in good.collect()], 90) if i == c}
    assert {r.doc_id for r in one.collect()} == want
    clean = p.materialize(stage["benchmark_decontamination"](spark, one, sf))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in one.collect()}
    leaks = {i for i, t in rows.items() if any(x in t for x in items)}
    assert {r.doc_id for r in clean.collect()} == set(rows) - leaks
    mixed = p.materialize(stage["mixing"](spark, clean, sf))
    assert {r.doc_id for r in mixed.collect()} < {r.doc_id for r in clean.collect()} and mixed.columns == docs.columns
    last = stage["sharding"](spark, mixed, sf).collect()
    check_shards(last, [(r.doc_id, r.text) for r in mixed.collect()], 40)
    assert all(x.columns == docs.columns for x in (good, one, clean))
    assert {(r.doc_id, r.shard, r.slot) for r in p.run(spark, sf).collect()} == {(r.doc_id, r.shard, r.slot) for r in last}


def test_pipeline_stages_take_odd_rows(spark, docs, none, sf):
    import corpus_pipeline as p

    for rows in (docs, none):
        d = rows.withColumnRenamed("n", "n_chars").select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in p.STAGES:
            d = stage(spark, p.materialize(d), sf)
        assert (d.count() > 0) == (rows is docs)


def test_registered_queries():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
