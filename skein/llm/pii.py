"""Personal data with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found on the text as it is, leftmost and without overlap per kind, in time
linear in the text. Texts that show a disguise then pass through three transducers, each of which keeps for every
character of its output the span of source characters that it came from: homoglyphs and invisible characters, spelled
digits, and at/dot disguises. Identifiers found on the normalised text are mapped back to source characters and added
unless they overlap a base one of their kind. Offsets count code points, ends are exclusive. Null texts are empty.
Repeated rows give repeated results; other columns aren't read.

The words `at` and `dot` alone are prose as well: `x at y.z` (or `x @ y.z`) is an address only if it ends in the suffix of a
domain (and, if the last dot isn't spelled, in none that is a file's suffix too). With a closed-up @ or brackets any will do.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(t: str) -> list[Span]:
    out, cursor, at = [], 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > cursor and t[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(t, at + 1)):
            out.append(("email", lo, m.end()))
            cursor = m.end()
            at = t.find("@", cursor)
        else:
            # What lies left of this sign can't belong to a later match: the sign itself isn't a local character.
            at = t.find("@", at + 1)
    return out


def _ips(t: str) -> list[Span]:
    out = []
    for chain in _CHAIN.finditer(t):
        runs = [(m.start(), m.end()) for m in _NUMBER.finditer(t, chain.start(), chain.end())]
        for i in range(0, len(runs) - 3, 4):
            if all(len(s := t[a:b].lstrip("0")) <= 3 and int(s or "0") <= 255 for a, b in runs[i : i + 4]):
                out.append(("ip", runs[i][0], runs[i + 3][1]))
    return out


def _cards(t: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def _phones(t: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


_DIGITS = re.compile("[0-9]")


def base_spans(t: str) -> list[Span]:
    """In the order of KINDS, then by start."""
    out = _emails(t) if "@" in t else []
    if _DIGITS.search(t):
        out += _ips(t)
        out += _cards(t)
        if "+" in t:
            out += _phones(t)
    return out


class Layer(NamedTuple):
    """One pass of disjoint edits in order: where each replacement stands in the new text, its end, and the span of the old text that it's for."""

    start: list[int]
    end: list[int]
    old_start: list[int]
    old_end: list[int]

    def back(self, at: int) -> tuple[int, int]:
        """The span of the old text that a character of the new one came from."""
        i = bisect_right(self.start, at) - 1
        if i < 0:
            return at, at + 1
        if at < self.end[i]:
            return self.old_start[i], self.old_end[i]
        at += self.old_end[i] - self.end[i]
        return at, at + 1


class Tape(NamedTuple):
    """A text and the edits that led to it. Memory grows with the edits, not with the text."""

    text: str
    layers: tuple[Layer, ...] = ()

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first text that a span of this one came from."""
        first, last = start, end - 1
        for layer in reversed(self.layers):
            first, last = layer.back(first)[0], layer.back(last)[1] - 1
        return first, last + 1


_HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS")) | dict(zip("αοορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aooprikABEZHIKMNOPTYX"))
_HOMOGLYPHS["ν"], _HOMOGLYPHS["ι"], _HOMOGLYPHS["κ"] = "v", "i", "k"
_HOMOGLYPHS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"　": " ", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "｡": ".", "。": "."}
for _base, _first, _n in ((48, 0x1D7CE, 10), (48, 0x1D7D8, 10), (48, 0x1D7E2, 10), (48, 0x1D7EC, 10), (48, 0x1D7F6, 10), (48, 0x0660, 10), (48, 0x06F0, 10), (65, 0x1D400, 26), (97, 0x1D41A, 26), (65, 0x1D5A0, 26), (97, 0x1D5BA, 26), (65, 0x1D670, 26), (97, 0x1D68A, 26)):
    _HOMOGLYPHS |= {chr(_first + i): chr(_base + i) for i in range(_n)}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile("[" + re.escape("".join(_HOMOGLYPHS)) + _INVISIBLE + "]")

_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_WORD = "|".join(sorted(_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?(?:{_WORD})(?:[\s,-]+(?:{_WORD}|[0-9]))*[\s,-]+(?:{_WORD})\b", re.I)
_ONE_WORD = re.compile(rf"{_WORD}|plus|[0-9]", re.I)
_AT = re.compile(r"\s*[\[({<] ?(?:at|@|arroba) ?[\])}>]\s*", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*|\s*[\[({<]\.[\])}>]\s*", re.I)
_PLAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\s++at\s++|\s*+@\s*+)([A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++)", re.I)
_PLAIN_IP = re.compile(r"(?<!\w)[0-9]{1,3}(?:\s++dot\s++[0-9]{1,3}){3}\b", re.I)
_PLAIN_DOT = re.compile(r"\s+dot\s+", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
SUFFIXES = frozenset(
    "com org net edu gov mil int info biz name pro io co dev app ai me tv xyz online site tech eu uk us ca au nz ie de at ch fr be nl lu it es pt dk se no fi is pl cz sk hu ro bg gr tr ru ua by lt lv ee si hr rs ba mk al md in pk bd lk cn hk tw jp kr sg my th vn id ph il ae sa eg za ng ke ma br ar mx cl pe ve uy".split()
)
#: Suffixes of domains that are those of files too.
FILE_LIKE = frozenset("pl rs md".split())
#: What every match of _AT or _DOT holds, and what every edit of _plain() or _PLAIN_IP replaces.
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|arroba|dot|punkt|punto|point|\.)\s*[\])}>]", re.I)
_BETWEEN = re.compile(r"\s(?:at|dot)\s|\s@|@\s", re.I)
#: All odd characters but the soft hyphen lie here; this search is a hundred times as fast as theirs.
_FAR = re.compile(r"[^\x00-\u024f]")
_DIGIT_WORDS = frozenset(_WORDS)
_RUN = re.compile(r"\w+")
#: Without regard to case these match the letters i, s and k, but lower() doesn't make those of them.
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def _odd(t: str) -> bool:
    return not t.isascii() and bool(_FAR.search(t) or "\xad" in t)


def _counts(t: str) -> bool:
    """Whether a text has the two words that every match of _SPELLED begins and ends with."""
    if not t.isascii() and _FOLDED.search(t):
        return True
    return len([w for w in _RUN.findall(t.lower()) if w in _DIGIT_WORDS]) > 1


def disguised(t: str) -> bool:
    """Whether any transducer could change the text: cheap tests that never miss one."""
    return bool(_BRACKETED.search(t) or _BETWEEN.search(t) or _odd(t) and _ODD.search(t) or _counts(t) and _SPELLED.search(t))


def tape(t: str) -> Tape:
    return Tape(t)


def rewrite(x: Tape, edits: list[tuple[int, int, str]]) -> Tape:
    """Replace disjoint, ordered spans; every new character covers the whole span that it stands for."""
    if not edits:
        return x
    t, parts, layer, at, size = x.text, [], Layer([], [], [], []), 0, 0
    for s, e, new in edits:
        parts += [t[at:s], new]
        size += s - at
        layer.start.append(size)
        size += len(new)
        layer.end.append(size)
        layer.old_start.append(s)
        layer.old_end.append(e)
        at = e
    parts.append(t[at:])
    return Tape("".join(parts), (*x.layers, layer))


def _glyphs(x: Tape) -> Tape:
    if not _odd(x.text):
        return x
    return rewrite(x, [(m.start(), m.end(), _HOMOGLYPHS.get(m[0], "")) for m in _ODD.finditer(x.text)])


def _spelled(x: Tape) -> Tape:
    if not _counts(x.text):
        return x
    edits = []
    for run in _SPELLED.finditer(x.text):
        words = list(_ONE_WORD.finditer(x.text, run.start(), run.end()))
        for i, m in enumerate(words):
            end = words[i + 1].start() if i + 1 < len(words) else m.end()
            edits.append((m.start(), m.end(), {"plus": "+"}.get(m[0].lower()) or _WORDS.get(m[0].lower(), m[0])))
            if end > m.end():
                edits.append((m.end(), end, ""))
    return rewrite(x, edits)


def _plain(t: str) -> list[tuple[int, int, str]]:
    """Edits of addresses whose at or dots are words."""
    edits = []
    for m in _PLAIN.finditer(t):
        word = m[1] != "@"
        own = [(m.start(1), m.end(1), "@")] if word else []
        labels = list(_LABEL.finditer(t, m.start(2), m.end(2)))
        last = len(labels) - 1
        if word:
            spelled = lambda k: t[labels[k].start() - 1] != "."
            last = next((k for k in range(last, 0, -1) if (x := labels[k][0].lower()) in SUFFIXES and (spelled(k) or x not in FILE_LIKE)), 0)
        if last:
            own += [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(t, m.start(2), labels[last].end())]
            edits += own
    return edits


def _signs(x: Tape) -> Tape:
    if _BRACKETED.search(x.text):
        x = rewrite(x, [(m.start(), m.end(), "@") for m in _AT.finditer(x.text)])
        x = rewrite(x, [(m.start(), m.end(), ".") for m in _DOT.finditer(x.text)])
    x = rewrite(x, _plain(x.text))
    if "dot" in x.text.lower():
        x = rewrite(x, [(d.start(), d.end(), ".") for m in _PLAIN_IP.finditer(x.text) for d in _PLAIN_DOT.finditer(x.text, m.start(), m.end())])
    return x


TRANSDUCERS = (_glyphs, _spelled, _signs)


def added_spans(t: str, base: list[Span]) -> list[Span]:
    """base and what the normalised text shows besides, by kind as listed, then start."""
    x = tape(t)
    for step in TRANSDUCERS:
        x = step(x)
    if not x.layers:
        return list(base)
    out = []
    shown = base_spans(x.text)
    for kind in KINDS:
        own = [p for p in base if p[0] == kind]
        starts, reached = [p[1] for p in own], -1
        fresh = []
        for k, s, e in shown:
            if k == kind:
                a, b = x.source(s, e)
                i = bisect_left(starts, b) - 1  # spans of a kind are ordered and disjoint, so only the last that starts before b can overlap
                if a >= reached and (i < 0 or own[i][2] <= a):
                    fresh.append((kind, a, b))
                    reached = b
        out += sorted(own + fresh, key=lambda p: p[1]) if fresh else own
    return out


def all_spans(t: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those that only the normalised text shows, by kind as listed, then start."""
    base = base_spans(t) if base is None else base
    return added_spans(t, base) if disguised(t) else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the number of base identifiers by kind, base_spans and spans as kind:start:end lists, n_added."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or ""
                base = base_spans(t)
                full = all_spans(t, base)
                count = dict.fromkeys(KINDS, 0)
                for k, _, _ in base:
                    count[k] += 1
                rows.append((i, *count.values(), _joined(base), _joined(full), len(full) - len(base)))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long")


def mask(text: str | None) -> str | None:
    """The text with every identifier, disguised or not, replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for k, a, b in sorted(all_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = b
    return "".join(out) + text[at:]


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")
