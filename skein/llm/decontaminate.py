"""Benchmark decontamination: a BM25 index of the test items, block-max WAND over every training passage, verified overlap.

Index. Each benchmark item is a document of the index; an impact is its BM25 term weight (k1, b, idf over all items)
divided by the item's own total, so a score of 1 means that a passage holds every distinct word of the item and one
threshold serves items of any length. Postings are ordered by item number in blocks that keep their largest impact.

Search. Items are classed by length, in powers of two: those of up to L words are looked for in windows of 2 L words that
start every L words, so an item that a text holds lies whole in one, and its own length alone decides where it is looked
for: no result depends on what else is in the benchmark, but for the statistics of words. A window is a query; all
items of its class whose score reaches the threshold are retrieved, none is ruled out by a top-k. The items of a class are cut
into ranges, at most GROUPS for each; block maxima per term and range settle most texts, and then most windows, in one numpy
step: an item's most common words, up to COMMON of its weight, are set aside as if present, and the largest impacts
of the other distinct words must add up to the rest. Ranges that remain are searched by block-max WAND, whose
pivots skip items and blocks that can't reach the threshold.

Verification. The last sentence of an item is its answer, the words before it the question (an item of one sentence is
cut at two thirds). Of both, the share of word trigrams that the window holds must reach min_overlap.

Words are runs of ASCII letters, digits and bytes from 128 up, in lower case, without general punctuation (U+2000 to
U+206F). Null and empty texts match nothing. Null, empty and wordless items are never found; equal items are each found.
Repeated rows repeat their result. An empty benchmark gives an empty result. The benchmark is handled in blocks of about
ITEM_BLOCK items and WORD_BLOCK words at most (a longer item is a block of its own), so that what is broadcast is bounded,
with statistics counted over all items; every block takes one pass over the corpus.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, materialize, mix, run_hashes, runs, text_bounds, text_slices, tidy, with_text

K1, B = 1.2, 0.75
THRESHOLD = 0.6
MIN_OVERLAP = 0.6
COMMON = 0.3
GROUPS = 32
POSTINGS_BLOCK = 16
ITEM_BLOCK = 20_000
#: 16 bytes for each posting and its verification: about 64 MB.
WORD_BLOCK = 2_000_000

_FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if 48 <= _c < 58 or 97 <= _c < 123 or _c >= 128:
        _FOLD[_c] = _c
    elif 65 <= _c < 91:
        _FOLD[_c] = _c + 32


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n + 1 bounds of each text's words."""
    b = _FOLD[buf]
    if len(b) > 2:
        b[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] += 32
        at = np.flatnonzero((buf[:-2] == 0xE2) & ((buf[1:-1] == 0x80) | (buf[1:-1] == 0x81)))
        for k in range(3):
            b[at + k] = 0
    starts, ends, doc = runs(b > 0, off)
    return run_hashes(b, starts, ends), text_bounds(doc, len(off) - 1)


def words_of_text(t: str) -> np.ndarray:
    raw = np.frombuffer(t.encode("utf-8"), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct hashes of n consecutive words; of all words if there are fewer."""
    n = min(n, len(h))
    if n == 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        s = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            s = s * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(mix(s + U64(n)))


def split_item(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, the question's and the answer's."""
    whole = words_of_text(t)
    parts = [w for w in (words_of_text(s) for s in re.split(r"(?<=[.!?])\s+|\n+", t)) if len(w)]
    if len(parts) > 1:
        answer = parts[-1]
    else:
        answer = whole[max(1, len(whole) * 2 // 3) :]
    return whole, whole[: len(whole) - len(answer)], answer


class Index:
    """Normalised impacts by term, as postings in item order with block maxima. Plain arrays, so that it can be broadcast."""

    def __init__(self, ids: list[int], texts: list[str], total: int, mean_words: float, df: dict[int, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        kept = [(i, *split_item(t or "")) for i, t in zip(ids, texts)]
        kept = sorted((k for k in kept if len(k[1])), key=lambda k: len(k[1]))
        self.ids = [k[0] for k in kept]
        self.question = [grams(k[2]) for k in kept]
        self.answer = [grams(k[3]) for k in kept]
        rows, essential = [], []
        for n, (_, words, _, _) in enumerate(kept):
            terms, tf = np.unique(words, return_counts=True)
            idf = np.array([np.log(1 + (total - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            w = w / w.sum()
            rows.append((terms, np.full(len(terms), n), w))
            common = np.lexsort((terms, idf))
            rest = w.copy()
            rest[common[np.cumsum(w[common]) <= COMMON]] = 0
            essential.append(rest)
        term = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, U64)
        item = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
        impact = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0)
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        rest = np.concatenate(essential)[order] if essential else np.zeros(0)
        #: Length classes: (words of the longest item that belongs, first range, end of ranges); ranges never mix classes.
        self.classes, parts, groups = [], [], 0
        size = np.array([max(8, 1 << (len(k[1]) - 1).bit_length()) for k in kept], np.int64)
        for longest, count in zip(*np.unique(size, return_counts=True)):
            own = min(GROUPS, int(count))
            parts.append(groups + np.arange(count) * own // count)
            self.classes.append((int(longest), groups, groups + own))
            groups += own
        self.group_of = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        #: Largest impact of a term within a range of items: of all words, and without those set aside as common.
        self.top = np.zeros((len(self.terms) + 1, max(1, groups)), np.float32)
        self.bound = np.zeros((len(self.terms) + 1, max(1, groups)), np.float32)
        slot = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        np.maximum.at(self.top, (slot, self.group_of[self.item]), self.impact)
        np.maximum.at(self.bound, (slot, self.group_of[self.item]), rest)
        self.postings = {}

    def lists(self, t: int, group: int) -> tuple[list[int], list[float], list[float], list[int]]:
        """A term's postings within a range of items: items, impacts, block maxima and each block's last item."""
        got = self.postings.get((t, group))
        if got is None:
            a, b = self.first[t], self.first[t + 1]
            lo, hi = np.searchsorted(self.group_of[self.item[a:b]], [group, group + 1]) + a
            items, impacts = self.item[lo:hi].tolist(), self.impact[lo:hi].tolist()
            cuts = range(0, len(items), POSTINGS_BLOCK)
            got = items, impacts, [max(impacts[c : c + POSTINGS_BLOCK]) for c in cuts], [items[min(c + POSTINGS_BLOCK, len(items)) - 1] for c in cuts]
            self.postings[t, group] = got
        return got

    def search(self, query: np.ndarray, group: int) -> list[tuple[int, float]]:
        """All (item, score) of a range of items whose score reaches the threshold, by block-max WAND over the query's distinct terms."""
        threshold = self.threshold
        eps = 1e-6
        top = self.top[query, group]
        some = np.flatnonzero(top)
        cursors = [[self.lists(t, group), 0, v] for t, v in zip(query[some].tolist(), top[some].tolist())]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2]
                if bound >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == item:
                pivot += 1
            # Block maxima of the blocks in which the item would stand, and the first item after any of them.
            tight, beyond = 0.0, None
            for (items, _, tops, lasts), at, _ in cursors[: pivot + 1]:
                k = at // POSTINGS_BLOCK
                while k < len(lasts) and lasts[k] < item:
                    k += 1
                if k < len(lasts):
                    tight += tops[k]
                    beyond = lasts[k] + 1 if beyond is None else min(beyond, lasts[k] + 1)
            if tight >= threshold - eps:
                if cursors[0][0][0][cursors[0][1]] == item:
                    score, target = 0.0, item + 1
                    for (items, impacts, _, _), at, _ in cursors[: pivot + 1]:
                        score += impacts[at]
                    if score >= threshold - eps:
                        out.append((item, score))
                else:
                    target = item
            else:
                target = max(item + 1, beyond) if beyond is not None else item + 1
                if pivot + 1 < len(cursors):
                    target = min(target, max(item + 1, cursors[pivot + 1][0][0][cursors[pivot + 1][1]]))
            left = []
            for i, c in enumerate(cursors):
                if i <= pivot:
                    items, at = c[0][0], c[1]
                    n = len(items)
                    while at < n and items[at] < target:
                        at += 1
                    c[1] = at
                    if at >= n:
                        continue
                left.append(c)
            cursors = left
        return out


def term_ids(h: np.ndarray, index: Index) -> np.ndarray:
    """Each word's number in the index, or -1."""
    if not len(index.terms):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    return np.where(index.terms[at] == h, at, -1)


def match_text(h: np.ndarray, index: Index, min_overlap: float, ids: np.ndarray | None = None) -> dict[int, tuple[float, float, float, int]]:
    """item number -> best (score, question overlap, answer overlap, first word of the window) of the verified matches of a text's words."""
    found: dict[int, tuple[float, float, float, int]] = {}
    n = len(h)
    if not n or not len(index.terms):
        return found
    if ids is None:
        ids = term_ids(h, index)
    least = index.threshold - COMMON - 1e-5
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return found
    # A window can't reach what the whole text doesn't.
    whole = index.bound[np.unique(ids[known])].sum(axis=0) >= least
    for longest, first, end in index.classes:
        live = first + np.flatnonzero(whole[first:end])
        if not len(live):
            continue
        for s in range(0, max(1, n - longest + 1), longest):
            a, b = np.searchsorted(known, (s, s + 2 * longest))
            if a == b:
                continue
            terms = np.unique(ids[known[a:b]])
            some = live[index.bound[terms[:, None], live].sum(axis=0) >= least] if len(live) < 8 else live[index.bound[terms][:, live].sum(axis=0) >= least]
            hits = [x for group in some.tolist() for x in index.search(terms, group)]
            if hits:
                words = h[s : s + 2 * longest]
                g = grams(words)
                for item, score in hits:
                    q, a_ = index.question[item], index.answer[item]
                    qo = float(np.isin(q, _with_short(g, q, words)).mean()) if len(q) else 1.0
                    ao = float(np.isin(a_, _with_short(g, a_, words)).mean()) if len(a_) else 1.0
                    if qo >= min_overlap and ao >= min_overlap and (item not in found or (score, qo, ao) > found[item][:3]):
                        found[item] = (score, qo, ao, s)
    return found


def _with_short(g: np.ndarray, part: np.ndarray, h: np.ndarray) -> np.ndarray:
    """g and the shorter runs of h, since a part of fewer than three words is one run."""
    return g if len(part) > 1 else np.concatenate([g, grams(h, 2), grams(h, 1)])


def build(benchmark: DataFrame, threshold: float = THRESHOLD, item_id: str = "item_id", text: str = "text"):
    """Yield indexes of about ITEM_BLOCK items and WORD_BLOCK words at most, under statistics of all items."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def count(batches):
        for batch in batches:
            terms, n = [], []
            for _, _, buf, off in text_slices(batch.column(1)):
                h, bound = words_of(buf, off)
                for d in range(len(off) - 1):
                    w = h[bound[d] : bound[d + 1]]
                    terms.append(np.unique(w).view(np.int64))
                    n.append(len(w))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["item_id", "text", "terms", "n"])

    counted = items.select("item_id", "text").mapInArrow(count, "item_id long, text string, terms array<long>, n long").where("n > 0")
    head = counted.agg(F.count("*").alias("total"), F.avg("n").alias("mean"), F.sum("n").alias("words")).first()
    if not head["total"]:
        return
    blocks = max(-(-head["total"] // ITEM_BLOCK), -(-head["words"] // WORD_BLOCK))
    if blocks > 1:
        counted = materialize(counted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    df = counted.select(F.explode("terms").alias("t")).groupBy("t").count()
    if blocks > 1:
        df = materialize(df)
    for k in range(blocks):
        own = counted if blocks == 1 else counted.where(F.col("block") == k)
        rows = own.select("item_id", "text").orderBy("item_id", "text").collect()
        # One row for each distinct word of the block; which side is moved is left to the sizes that the plan knows.
        part = df if blocks == 1 else own.select(F.explode("terms").alias("t")).distinct().join(df, "t")
        counts = {r["t"] & 0xFFFFFFFFFFFFFFFF: r["count"] for r in part.collect()}
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows], head["total"], head["mean"], counts, threshold)


def _matcher(min_overlap: float):
    def match(col: pa.Array, ix: Index):
        """(row, matches) of the texts with any."""
        for lo, hi, buf, off in text_slices(col):
            h, bound = words_of(buf, off)
            if not len(h) or not len(ix.terms):
                continue
            ids = term_ids(h, ix)
            for d in range(hi - lo):
                a, b = bound[d], bound[d + 1]
                if m := match_text(h[a:b], ix, min_overlap, ids[a:b]):
                    yield lo + d, m

    return match


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): the best window of every verified document and item."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for ix in build(benchmark, threshold):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(ix))
        match = _matcher(min_overlap)

        def run(batches, match=match, shared=shared):
            ix = pickle.loads(shared.value)
            for batch in batches:
                ids, rows = batch.column(0), []
                for d, m in match(batch.column(1), ix):
                    rows += [(ids[d].as_py(), ix.ids[i], *v) for i, v in sorted(m.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()])], names=names)

        part = src.mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """The rows of docs that hold no benchmark item; columns as they were. No join: rows are dropped where they're read."""
    kind = docs.schema
    for ix in build(benchmark, threshold):
        match, shared = _matcher(min_overlap), docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ix))
        src, at = with_text(docs)

        def run(batches, match=match, shared=shared, at=at, n=len(kind)):
            ix = pickle.loads(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for d, _ in match(batch.column(at), ix):
                    keep[d] = False
                if keep.any():
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:n]], names=batch.schema.names[:n])

        docs = src.mapInArrow(tidy(run), kind)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
