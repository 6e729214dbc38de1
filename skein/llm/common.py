"""Shared helpers: zero-copy text access and numpy hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.shared import is_small, materialize, small, spread_join  # noqa: F401, what the operators take from here

#: A filter takes at most so many bits (64 MB), 16 for each member below that.
FILTER_BITS = 1 << 29

#: Texts are handled in slices of about so many bytes, so numpy's temporaries stay small. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MUL = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(max(n - 1, 0), base, U64)]))


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def release() -> None:
    """Give back what a worker no longer uses: workers live on from stage to stage and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run):
    """A function over batches that gives memory back when a partition is done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def text_slices(column: pa.Array, budget: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over whole texts, at most `rows` at a time; null texts are empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    raw, off = offsets_of(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, nothing else."""
    return _LOWER[buf]


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that don't cross texts: starts, ends, and the text of each."""
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[off[off <= n]] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = member[:-1]
    starts = np.flatnonzero(member & (~prev | cut[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = member[1:]
    ends = np.flatnonzero(member & (~nxt | cut[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run."""
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        first = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
        vals = _BYTE[buf[pos + np.repeat(starts, lens)]]
        vals *= powers(int(lens.max()))[pos]
        return mix(np.add.reduceat(vals, first) + lens.astype(U64) * _MUL)


def text_bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the items of each text, from the items' sorted text numbers."""
    return np.searchsorted(doc, np.arange(n + 1))


def with_text(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """docs for a function over batches, and the position of its text: the column itself, or if that's no string a last one that is."""
    at = next((i for i, f in enumerate(docs.schema.fields) if f.name == text and isinstance(f.dataType, StringType)), None)
    return (docs, at) if at is not None else (docs.select("*", F.col(text).cast("string").alias(fresh(docs, "__text"))), len(docs.columns))


def crc_of_id(doc_id: str = "doc_id"):
    """crc32 of the id as text, as the held-out rules use it; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or a variant of it that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Members told by two 64-bit hashes: sorted exactly if they are few, else a bit array of bounded size with some false positives.
#: (bits or None, h, g): plain arrays, so that workers need no class of this package.
Filter = tuple


def passes(level: Filter, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    bits, known_h, known_g = level
    h, g = h.view(U64), g.view(U64)
    if bits is None:
        lo, hi, out = np.searchsorted(known_h, h, "left"), np.searchsorted(known_h, h, "right"), np.zeros(len(h), bool)
        while (open_ := np.flatnonzero((lo < hi) & ~out)).size:
            out[open_] = known_g[lo[open_]] == g[open_]
            lo[open_] += 1
        return out
    out, mask = np.ones(len(h), bool), U64(len(bits) * 64 - 1)
    for x in (h, h >> U64(32), g, g >> U64(32)):
        at = x & mask
        out &= (bits[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)
    return out


def filter_of(members: DataFrame) -> tuple[Filter, bool]:
    """A filter of the rows (h, g) of a table, and whether it's exact. The bits are made where the rows are; the driver joins words of them."""
    if is_small(members):
        rows = members.toPandas()
        h, g = rows["h"].to_numpy(np.int64).view(U64), rows["g"].to_numpy(np.int64).view(U64)
        order = np.lexsort((g, h))
        return (None, h[order], g[order]), True
    size = min(FILTER_BITS, max(1 << 13, 1 << (16 * members.count()).bit_length()))
    at = F.explode(F.array("h", F.shiftrightunsigned("h", 32), "g", F.shiftrightunsigned("g", 32)))
    places = members.select(at.alias("x")).select(F.col("x").bitwiseAND(F.lit(size - 1)).alias("x"))
    words = places.groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(size // 64, U64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(U64)
    return (bits, None, None), False


def belongs(levels: list[Filter], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Membership by a cascade of filters, each of the false positives of the one before."""
    out, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for k, level in enumerate(levels):
        open_ = open_[passes(level, h[open_], g[open_])]
        out[open_] = k % 2 == 0
    return out


def cascade_of(inside: DataFrame, outside: DataFrame) -> list[Filter] | None:
    """Filters for belongs() that are exact for all rows (h, g) of both tables, so that no row need be moved; None if there are too many for filters."""
    levels = []
    while True:
        level, exact = filter_of(inside)
        levels.append(level)
        if exact:
            return levels
        if 8 * inside.count() > FILTER_BITS:
            return None
        inside, outside = materialize(outside.where(is_in([level], F.col("h"), F.col("g")))), inside


def is_in(levels: list[Filter], h: Column, g: Column) -> Column:
    """Whether rows belong to the members of a cascade, by their hashes; only these go to Python."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(levels)

    @F.arrow_udf("boolean")
    def test(h: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array(belongs(shared.value, h.to_numpy(zero_copy_only=False), g.to_numpy(zero_copy_only=False)))

    return test(h, g)
