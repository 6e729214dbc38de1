"""Quality trees and language machines: against scalar versions, and held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skein.llm import language_id as lang
from skein.llm import quality_gbdt as q
from skein.llm.common import crc_of_id, text_slices


def packed(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_statistics_don_t_depend_on_neighbours(texts):
    together = q.statistics(*packed(texts))
    for i in (0, 5, len(texts) - 1, len(texts) - 7, len(texts) - 6):
        assert np.allclose(together[i], q.statistics(*packed([texts[i]]))[0])
    x = dict(zip(q.FEATURES, q.statistics(*packed(["Ab ab ab É"]))[0]))
    assert x["words"] == np.log1p(4) and x["repeat_next"] == 0.25 and x["distinct"] == 0.75 and x["capital_words"] == 0.5 and x["chars"] == np.log1p(10)


def plain_statistics(t):
    """The 21 statistics, word by word and character by character."""
    import collections
    import math

    raw = t.encode()
    words = [w for w in re.split(b"[\x20\x09-\x0d]+", raw) if w]
    chars, n = len(t), len(words)
    c, w = max(chars, 1), max(n, 1)
    count = lambda those: sum(x in those for x in t)
    caps = sum("A" <= x <= "Z" or "\u00c0" <= x <= "\u00de" for x in t)
    firsts = sum(x > "\x7f" for x in t)  # leading bytes of characters beyond ASCII
    lower = sum("a" <= x <= "z" for x in t)
    tally = collections.Counter(words)
    symbols, quotes = "#$%&*@^~+=<>_\\", "\"'()[]{}"
    known = symbols + quotes + ".,!| \t\n\x0b\x0c\r"
    other = sum(x < "\x80" and not x.isalnum() and x not in known for x in t)
    ends = symbols + "!|"
    return [
        math.log1p(chars), math.log1p(n), sum(map(len, words)) / w, caps / max(lower + caps + firsts, 1), count("0123456789") / c, count(" \t\x0b\x0c\r") / c, count("\n") / w, count(".") / w, count(",") / w, count("!") / w, count("|") / w,
        count(symbols) / c, count(quotes) / c, other / c, firsts / c, len(tally) / w, max(tally.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w, sum(chr(x[-1]) in ends for x in words) / w,
        sum(65 <= x[0] <= 90 or x[0] >= 0xC0 for x in words) / w, math.log1p(max(map(len, words), default=0)),
    ]


def test_statistics_equal_a_scalar_version(texts):
    rng = random.Random(5)
    odd = ["".join(rng.choice("aZ9é É\u00d7日.,!|#_'\"()-:; \n\t") for _ in range(rng.randrange(60))) for _ in range(300)]
    some = [t or "" for t in texts[:40]] + odd
    assert np.allclose(q.statistics(*packed(some)), [plain_statistics(t) for t in some])


def test_trigrams_equal_a_scalar_version():
    def plain(t):
        fold, raw = bytearray(), t.encode()
        for i, x in enumerate(raw):
            if i and raw[i - 1] == 0xC3 and 0x80 <= x <= 0x9E:
                x += 32
            fold.append(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32)
        out = np.zeros(lang.DIMS)
        for a, b, c in zip(fold, fold[1:], fold[2:]):
            if not (a == b == 32 or b == c == 32):
                out[(a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 20] += 1
        out = np.sqrt(out)
        return out / max(np.sqrt((out * out).sum()), 1e-9)

    rng = random.Random(6)
    some = ["".join(rng.choice("abcÄéÉ ÷日9 -") for _ in range(rng.randrange(40))) for _ in range(200)]
    assert np.allclose(lang.trigram_features(*packed(some)), [plain(t) for t in some], atol=1e-6)


def test_many_languages_and_short_texts(spark, monkeypatch):
    """No language is left out, and rows are made a few at a time however short the texts are."""
    words = [f"{a}{b}{c}" for a in "bdfghjklmn" for b in "aeiou" for c in "prstvwxyz"]
    rows = [(i, " ".join(words[(i % 40) * 11 + k] for k in (i % 7, i % 5 + 3, i % 3 + 8)), f"x{i % 40}") for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes, real = [], lang.trigram_features
    model = lang.train(d, per_lang=500, max_rows=400)
    assert sum(len(v) for v in model.langs.values()) == 40
    monkeypatch.setattr(lang, "trigram_features", lambda buf, off: sizes.append(len(off) - 1) or real(buf, off))
    for lo, hi, buf, off in text_slices(pa.array(["tiny text"] * 2000), rows=lang.SLICE_ROWS):
        lang.trigram_features(buf, off)
    assert max(sizes) == lang.SLICE_ROWS and sum(sizes) == 2000
    assert lang.train(d.where("lang = 'x3'").limit(1).withColumn("doc_id", F.lit(1)), max_rows=1).langs == {"only x3": ["x3"]}


def test_clashing_names(spark, docs):
    d = docs.withColumn("__text", F.lit("t")).withColumn("__QUALITY_score", F.lit(1)).limit(5)
    assert q.reject(d, docs.select("doc_id", F.lit(1).alias("quality"))).columns == d.columns


def test_held_out_is_never_null(spark, tmp_path):
    d = spark.createDataFrame([(None, "text", "en"), (1, None, None), (4, "more text", "de"), (7, "text", "en")], "doc_id long, text string, lang string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    d.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    for query in (q.op2_quality_gbdt, lang.op10_language_id):
        assert query(spark, str(tmp_path)).where("held_out is null").count() == 0


def test_forest_equals_scalar_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = q.fit(x, y, trees=30, depth=3)

    def one(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert np.allclose(f.raw(x), [one(r) for r in x])
    assert ((f.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_first_split_is_the_best_one():
    x = np.array([[0.0, 5], [1, 5], [2, 6], [3, 6], [4, 5], [5, 6]] * 5)
    y = (x[:, 0] > 2).astype(float)
    f = q.fit(x, y, trees=1, depth=1, least=1)
    assert f.feature[f.roots[0]] == 0 and f.threshold[f.roots[0]] == 2.5


def test_fit_without_labels_or_with_one_class(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.s for r in q.with_score(docs, q.train(docs, labels), name="s").collect()} == {0.5}
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert min(r.s for r in q.with_score(docs, q.train(docs, ones), name="s").collect()) > 0.5
    assert q.with_score(none, q.train(none, ones), name="s").count() == 0
    assert q.reject(docs, labels).columns == docs.columns and q.reject(docs, labels).count() == docs.count()


def test_bad_labels_are_ignored(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).unionByName(spark.createDataFrame([(1, None), (None, 1), (2, 7), (10**9, 0)], "doc_id long, quality int"))
    assert q.train(docs, labels).value.size


def test_quality_query(spark, sf):
    got = q.op2_quality_gbdt(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    j = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("score < 0 or score > 1").count() == 0
    assert (j.quality == j.predicted).mean() > 0.9


def test_trigrams_don_t_cross_texts():
    texts = ["abc", "", "ab", "Écoute là", "!!", "d"]
    together = lang.trigram_features(*packed(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], lang.trigram_features(*packed([t]))[0], atol=1e-6)
    assert np.allclose(lang.trigram_features(*packed(["ÉCOUTE"])), lang.trigram_features(*packed(["écoute"])))


def test_svm_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = np.where(x @ [1, -2, 0.5] + 0.3 > 0, 1.0, -1.0)
    w = lang.svm(x, y, c=100, epochs=60)
    assert (np.sign(np.column_stack([x, np.ones(200)]) @ w) == y).mean() > 0.97


def test_prediction_equals_machine_by_machine():
    rng = np.random.default_rng(3)
    names = ["en", "de", "nl", "fr", "es", "xx"]
    centre = rng.normal(size=(6, 20))
    y = [names[i % 6] for i in range(300)]
    x = (np.array([centre[i % 6] for i in range(300)]) + rng.normal(size=(300, 20)) * 0.4).astype(np.float32)
    m = lang.fit(x, y)
    got, score = m.predict(x)
    for i in range(0, 300, 7):
        v = np.append(x[i], 1)
        fam = m.families[int(np.argmax(m.first @ v))]
        langs = m.langs[fam]
        wins = {k: sum((m.pairs[a, b] @ v > 0) == (k == a) for a, b in m.pairs if k in (a, b) and a in langs and b in langs) for k in langs}
        assert wins[got[i]] == max(wins.values())
    assert np.mean([a == b for a, b in zip(got, y)]) > 0.95 and score.min() >= 0 and score.max() <= 1


def test_languages_of_odd_texts(spark, docs, none):
    model = lang.train(docs)
    got = {r.doc_id: r for r in lang.identify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, "stone7 river")], "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and got[5].lang_pred in ("en", "de")
    assert lang.train(none) is None and {r.lang_pred for r in lang.identify(docs, None).collect()} == {"und"}
    assert lang.identify(none, model).count() == 0


def test_language_query(spark, sf):
    got = lang.op10_language_id(spark, sf).toPandas()
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("h", F.pmod(crc_of_id(), F.lit(4)) == 2).toPandas().merge(got, on="doc_id")
    assert len(got) == len(d) and (d.h == d.held_out).all()
    assert (d.lang == d.lang_pred)[d.held_out].mean() > 0.9


@pytest.mark.parametrize("t", ["abc", "日本", "ß"])
def test_letters(t):
    assert lang.has_letter(t) and not lang.has_letter("12 ,.")
