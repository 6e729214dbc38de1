"""Language identification by hierarchical discrimination.

A text's features are the square roots of its counts of hashed byte trigrams (words in lower case, padded by blanks),
scaled to length one. A first level of one-versus-rest linear support vector machines chooses the language family; within
the family, one-versus-one linear machines for each pair of its languages vote, ties going to the larger summed margin,
then to the first name. All machines are trained by dual coordinate descent with the squared hinge loss.

Learned from text and non-null lang only, of rows whose crc32(doc_id) mod 4 isn't 2: of every language about
min(per_lang, max_rows / languages) rows, one at least, chosen by id hash. max_rows bounds what the driver holds (16 kB a
row); no language is left out. Every whole text is predicted, a few hundred at a time, so that memory doesn't depend on how
short texts are. `und` with score 0 if a text is null, empty or has no letter, or if nothing could be learned. Ids,
languages and sources are no inputs. A null id isn't held out, nor learned from. Repeated rows repeat their result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, materialize, spread_join, text_slices

DIMS = 4096
#: Feature rows that are made at once: 8 MB of counts.
SLICE_ROWS = 256
PER_LANG = 500
MAX_ROWS = 16_000
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi bn mr ne gu pa ur",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    """A language without a known family is one of its own."""
    return FAMILY_OF.get(lang.lower().split("-")[0], "only " + lang)


def trigram_features(buf: np.ndarray, off: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """One row of unit length (or zero) for each text."""
    n = len(off) - 1
    if len(buf) < 3:
        return np.zeros((n, dims), np.float32)
    b = _FOLD[buf]
    # Capitals of Latin-1: C3, then 80 to 9E.
    b[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] += 32
    b = b.astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 12)
    inside = np.ones(len(code), bool)
    inside &= ~((b[:-2] == 32) & (b[1:-1] == 32)) & ~((b[1:-1] == 32) & (b[2:] == 32))
    for k in (1, 2):  # trigrams that would reach into the next text
        at = off[1:-1] - k
        inside[at[(at >= 0) & (at < len(code))]] = False
    size = np.minimum(off[1:], len(code)) - np.minimum(off[:-1], len(code))
    doc = np.repeat(np.arange(n, dtype=np.int64) * dims, size)
    at = (doc + code % np.uint32(dims))[inside]
    out = np.sqrt(np.bincount(at, minlength=n * dims).astype(np.float32)).reshape(n, dims)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by dual coordinate descent; y is +-1."""
    q = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1 + 1 / (2 * c)
    a, w = np.zeros(len(x)), np.zeros(x.shape[1] + 1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            row = np.append(x[i], 1.0)  # one row at a time in double precision, so that the sample isn't copied
            g = y[i] * (row @ w) - 1 + a[i] / (2 * c)
            new = max(0.0, a[i] - g / q[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * row
                a[i] = new
    return w


@dataclass
class Model:
    """weights: one row per machine; families with one language need no pair."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    first: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        one = np.column_stack([x, np.ones(len(x), x.dtype)])
        sure = lambda margin: 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        top = one @ self.first.T
        best = top.argmax(axis=1)
        out, score = np.empty(len(x), object), sure(top[np.arange(len(x)), best])
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.langs[name]
            if not len(rows):
                continue
            votes, margins, own = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for i, j in combinations(range(len(langs)), 2):
                m = one[rows] @ self.pairs[langs[i], langs[j]]
                for k, v in ((i, m), (j, -m)):
                    votes[:, k] += v > 0
                    margins[:, k] += v
                    own[:, k] = np.minimum(own[:, k], v)
            win = (votes + 0.5 * np.tanh(margins / (1 + np.abs(margins).max(initial=0)))).argmax(axis=1)
            out[rows] = np.array(langs, object)[win]
            if len(langs) > 1:
                score[rows] *= sure(own[np.arange(len(rows)), win])
        return list(out), score


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array(langs)
    fams = np.array([family(k) for k in langs])
    m = Model(sorted(set(fams)))
    m.langs = {f: [k for k in names if family(k) == f] for f in m.families}
    m.first = np.stack([svm(x, np.where(fams == f, 1.0, -1.0)) if len(m.families) > 1 else np.append(np.zeros(x.shape[1]), 1.0) for f in m.families])
    for f in m.families:
        for a, b in combinations(m.langs[f], 2):
            pick = (y == a) | (y == b)
            m.pairs[a, b] = svm(x[pick], np.where(y[pick] == a, 1.0, -1.0))
    return m


def has_letter(t: str) -> bool:
    return any(c.isalpha() for c in t)


def train(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, left_out: tuple[int, int] = (4, 2)) -> Model | None:
    """Fit on about per_lang rows of each language, max_rows in all; rows whose crc32(doc_id) mod left_out[0] is left_out[1] aren't used."""
    use = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.pmod(crc_of_id(), F.lit(left_out[0])) != left_out[1])
    )
    counts = use.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id", F.lit(17))).alias("first"))
    each = F.least(F.lit(float(per_lang)), F.greatest(F.lit(1.0), F.lit(float(max_rows)) / F.lit(max(1, counts.count()))))
    # One hash threshold per language: a sample of bounded expected size without ranking any language's rows. The row of least hash is always in.
    parts = counts.select("lang", "first", F.least(F.lit(1.0), each / F.col("n")).alias("share"))
    h = F.xxhash64("doc_id", F.lit(17))

    def measure(batches):
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column(2), rows=SLICE_ROWS):
                x = trigram_features(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    drawn = spread_join(use, materialize(parts), ["lang"], ["doc_id"]).where((F.pmod(h, F.lit(1 << 30)) / (1 << 30) < F.col("share")) | (h == F.col("first")))
    rows = drawn.select("doc_id", "lang", "text").mapInArrow(measure, "doc_id long, lang string, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "lang", "x"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]])
    return fit(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(batches):
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            for lo, hi, buf, off in text_slices(col, rows=SLICE_ROWS):
                n = hi - lo
                pred, score = ["und"] * n, np.zeros(n)
                if model is not None:
                    pred, score = model.predict(trigram_features(buf, off))
                is_letter = np.zeros(256, bool)
                is_letter[65:91] = is_letter[97:123] = True
                plain = np.concatenate([[0], np.cumsum(is_letter[buf])])
                for d in np.flatnonzero(plain[off[1:]] == plain[off[:-1]]):
                    if not has_letter(buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")):
                        pred[d], score[d] = "und", 0.0
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array(pred, pa.string()), pa.array(score.astype(float))], names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
