"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for whole texts, vectorised over the bytes of an Arrow batch: one histogram of byte classes and
one pass of word hashes serve a few thousand documents at a time. Trees are grown on binned statistics with second-order
logistic gradients, then flattened into arrays (feature, threshold, left, right, value), so that a batch descends all
trees level by level with numpy gathers.

Only labelled rows that aren't held out are learned from, and of them at most max_rows (those of least id hash: the bound
is what the driver holds). Labels, languages, sources and ids are no inputs. A null id isn't held out. Null and empty texts have statistics of zero
and get a score like any other. Without any usable label every score is 0.5. Repeated rows repeat their result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_of_id, fresh, run_hashes, runs, text_bounds, text_slices, tidy, with_text

FEATURES = (
    "chars", "words", "word_length", "upper", "digit", "space", "newline", "stop", "comma", "bang", "pipe", "symbol", "quote", "other_punct", "high",
    "distinct", "top_word", "repeat_next", "symbol_end", "capital_words", "longest_word",
)
MAX_ROWS = 20_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: lower, upper, digit, space, newline, stop, comma, bang, pipe, symbol, quote, other punctuation, high first, high rest
_CLASS = np.full(256, 11, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
for _c, _k in ((".", 5), (",", 6), ("!", 7), ("|", 8), ("#$%&*@^~+=<>_\\", 9), ("\"'()[]{}", 10)):
    _CLASS[[ord(x) for x in _c]] = _k
_CLASS[0xC0:] = 12
_CLASS[0x80:0xC0] = 13
N_CLASSES = 14


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n, dtype=np.int64) * N_CLASSES, size)
    h = np.bincount(doc + _CLASS[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    # A capital of Latin-1 is two bytes, C3 and 80 to 9E.
    caps = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) if len(buf) > 1 else np.zeros(0, bool)
    upper = h[:, 1] + np.bincount(np.searchsorted(off, np.flatnonzero(caps), "right") - 1, minlength=n)[:n]
    chars = h.sum(axis=1) - h[:, 13]
    starts, ends, wdoc = runs(~_SPACE[buf], off)
    hashes = run_hashes(buf, starts, ends)
    bound = text_bounds(wdoc, n)
    words = np.diff(bound).astype(np.float64)
    lengths = (ends - starts).astype(np.float64)
    some = words > 0
    at = bound[:-1][some]
    longest = np.zeros(n)
    length = np.zeros(n)
    if some.any():
        longest[some] = np.maximum.reduceat(lengths, at)
        length[some] = np.add.reduceat(lengths, at)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (wdoc[1:] == wdoc[:-1])
    last, first = _CLASS[buf[ends - 1]] if len(ends) else np.zeros(0), _CLASS[buf[starts]] if len(starts) else np.zeros(0)
    odd_end = ((last == 9) | (last == 7) | (last == 8)).astype(np.float64)
    capital = ((first == 1) | (first == 12)).astype(np.float64)
    distinct, top = np.zeros(n), np.zeros(n)
    for d in np.flatnonzero(some):
        u, c = np.unique(hashes[bound[d] : bound[d + 1]], return_counts=True)
        distinct[d], top[d] = len(u), c.max()

    def by_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(wdoc, weights=x, minlength=n)[:n] if len(x) else np.zeros(n)

    letters = np.maximum(h[:, 0] + upper + h[:, 12], 1)
    c, w = np.maximum(chars, 1), np.maximum(words, 1)
    return np.column_stack(
        [
            np.log1p(chars), np.log1p(words), length / w, upper / letters, h[:, 2] / c, h[:, 3] / c, h[:, 4] / w, h[:, 5] / w, h[:, 6] / w, h[:, 7] / w, h[:, 8] / w, h[:, 9] / c, h[:, 10] / c, h[:, 11] / c, h[:, 12] / c,
            distinct / w, top / w, by_doc(same) / w, by_doc(odd_end) / w, by_doc(capital) / w, np.log1p(longest),
        ]
    )


@dataclass
class Forest:
    """All trees in flat arrays; a leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds between neighbouring values: all of them, or quantiles if there are more than bins."""
    out = []
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        if len(u) > bins:
            u = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)))
        out.append((u[1:] + u[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 63, l2: float = 1.0, least: int = 10) -> Forest:
    """Histogram gradient boosting with the logistic loss; ties between splits go to the lower feature and threshold."""
    n, m = x.shape if x.size else (0, len(FEATURES))
    if n == 0:
        z = np.zeros(1, np.int64)
        return Forest(z, z, np.zeros(1), z, z, np.zeros(1), 0.0, 0)
    edges = bin_edges(x, bins)
    b = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]).astype(np.int64)
    width = bins + 1
    slot = b + np.arange(m) * width
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(value))
        right.append(len(value))
        value.append(v)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            me = leaf(-rate * gs / (hs + l2))
            if level < depth and len(rows) >= 2 * least:
                s = slot[rows].ravel()
                hist = [np.bincount(s, weights=np.repeat(v[rows], m), minlength=m * width).reshape(m, width).cumsum(axis=1)[:, :-1] for v in (g, h)]
                count = np.bincount(s, minlength=m * width).reshape(m, width).cumsum(axis=1)[:, :-1]
                gl, hl = hist
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(count < least) | (len(rows) - count < least)] = -1
                for f in range(m):
                    gain[f, len(edges[f]) :] = -1
                best = int(gain.argmax())
                f, cut = divmod(best, width - 1)
                if gain[f, cut] > 1e-9:
                    go = b[rows, f] <= cut
                    feature[me], threshold[me] = f, float(edges[f][cut])
                    left[me], right[me] = grow(rows[go], level + 1), grow(rows[~go], level + 1)
                    return me
            raw[rows] += value[me]
            return me

        roots.append(grow(np.arange(n), 0))
    arr = lambda v, k: np.array(v, k)
    return Forest(arr(roots, np.int64), arr(feature, np.int64), arr(threshold, float), arr(left, np.int64), arr(right, np.int64), arr(value, float), base, depth)


def train(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on labelled rows whose crc32(doc_id) isn't divisible by held_out_mod, at most max_rows of them."""
    use = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(held_out_mod)) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def measure(batches):
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column(2)):
                x = statistics(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_rows ids, so the side has a proven bound.
    found = text.join(F.broadcast(use), "doc_id").select("doc_id", "quality", "text").mapInArrow(tidy(measure), "doc_id long, quality int, x array<double>").dropDuplicates(["doc_id"]).toPandas()
    found = found.sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, found["quality"].to_numpy(float))


def with_score(docs: DataFrame, forest: Forest, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text as one more column."""

    src, at = with_text(docs, text)
    keep = docs.schema.fields

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, buf, off in text_slices(batch.column(at)):
                out[lo:hi] = forest.score(statistics(buf, off))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], names=[*batch.schema.names[: len(keep)], name])

    return src.mapInArrow(tidy(run), StructType([*keep, StructField(name, DoubleType())]))


def reject(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`; columns as they were."""
    names = docs.columns
    score = fresh(docs, "__quality_score")
    return with_score(docs, train(docs, labels), name=score).where(F.col(score) >= least).select(*[f"`{c}`" for c in names])


def op2_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    src = docs.select("doc_id", F.coalesce(F.pmod(crc_of_id(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "text")
    scored = with_score(src, forest)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
