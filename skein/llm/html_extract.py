"""HTML extraction by equivalence-class template deduction.

Deduction. A page is read as a sequence of tokens: tags with the path of their open containers, and text runs with the
path they stand on. For every host and token one aggregate keeps the number of pages with the token and a fingerprint of
its occurrence vector (sums of hashes of (page, count) over its pages). Tokens of a host with the same fingerprint and
page count share their occurrence vector: they form an equivalence class. A class is valid if it has at least
MIN_CLASS tokens, occurs on at least SUPPORT of the host's pages, and its tokens nest: the container of each text
run is a tag of a valid class (the containers around it then occur as often, so they are frequent too). Valid classes
nested by path are the host's template; text runs in it are boilerplate. Pages of a host with equal html count once, and
text in an article or main element is never boilerplate. Where nothing of a page would stay, the text runs of its rarest
class do: they are a story that most pages of the host repeat. All that is left of a page is its slots. The aggregates
are combined before the shuffle and no host's pages are ever gathered in one task.

Extraction. The page's article (or main element) gives blocks as it is; a page without one gives those of all its slots,
without the template's text. Both go without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, which are told by element, role or class. Inside an article a class counts only if one of its names is
as a whole that of such a part (`related-posts`, never `related-work`), and outside it headings are never told by class.
Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by two
newlines. Pages are cut in time linear in their length, whatever is left unclosed: a tag with an unclosed quote ends at its
first `>`, and one that the page breaks off in isn't text. Null html is empty; pages without any text give an empty
string. Rows with null urls share one unnamed host. Repeated rows repeat their result and change no other page's. Columns
other than the id, the url and the html aren't read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, spread_join

MIN_PAGES = 4
MIN_CLASS = 3
SUPPORT = 0.6

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
_DROP = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog head menu object title xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
) - {"br"}
#: Blocks of text; the other blocks are containers, and paths are made of containers only.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr td th caption summary figcaption legend option".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "html", "body", "head"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = frozenset("ul ol table article section div body html aside nav main td th blockquote form footer header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of parts that are no main text, wherever they stand in a class name of an element outside articles.
_ANYWHERE = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|sidebar|navbar|breadcrumbs?|footer|masthead|comments?|disqus|cookies?|gdpr|popup|modal|newsletter|signup|toolbar|pagination|pager|skip)(?:[_-]|$)", re.I)
_PART = r"banner|menu|nav|navigation|repl(?:y|ies)|respond|consent|notice|overlay|subscribe|subscription|login|share|sharing|social|related|recommend(?:ed|ations?)|widget|search|form|disclaimer|alert|header"
#: These only as whole names, with words that say where or as what the part stands.
_OUTSIDE = re.compile(rf"(?:(?:site|page|main|top|global|primary|secondary|bottom|left|right|user)[_-])*(?:{_PART})(?:[_-](?:bar|box|form|links?|buttons?|list|container|wrapper|panel|block|area|inner|posts?|articles?|stories|items?|media))*", re.I)
#: Whole names of such parts of an article, and of article elements that aren't the page's.
_INSIDE = re.compile(
    r"ads?|advert\w*|adsense|ad[_-]?(?:box|slot|unit|banner|container|wrapper)|sponsor(?:ed)?|promo(?:tion)?s?|(?:share|sharing|social)(?:[_-](?:share|bar|box|links?|buttons?|tools|media|icons))*|related(?:[_-](?:posts?|articles?|links?|stories|content|items?))?|recommend(?:ed|ations?)(?:[_-](?:posts?|articles?|links?|stories))?|"
    r"newsletter(?:[_-]?(?:signup|form|box))?|subscribe|signup|(?:reader[_-])?comments?(?:[_-]?(?:list|section|form|thread|area|body))?|repl(?:y|ies)|respond|disqus(?:[_-]thread)?|cookies?(?:[_-]?(?:notice|banner|bar|consent))?|consent|notice|popup|modal|overlay|sidebar|widget|breadcrumbs?|pagination|pager|toolbar|menu|nav|navbar|navigation|login|teasers?", re.I
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: What follows a tag's name, up to its end. Only behind an equals sign do quotes enclose.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+>")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _text_key(path: int, text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{path} {text}"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unwanted(name: str, attrs: str, inside: bool) -> tuple[bool, str, bool]:
    """Whether an element and all in it is no main text, its class names, and whether its role makes it an article. inside: within an article or main element."""
    if name in _DROP:
        return True, "", False
    article = name in ("article", "main")
    if name == "header":
        return not inside, "", False
    if not attrs or name in ("html", "body"):
        return False, "", article
    classes: list[str] = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            if value.lower() in _ROLES:
                return True, value, False
            article |= value.lower() in ("main", "article")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, "", False
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, "", False
        elif key in ("class", "id"):
            classes += value.split()
    known = " ".join(classes).lower()
    if name in _HEADINGS or name in ("b", "i", "em", "strong"):
        return False, known, article
    if inside or article:
        return any(_INSIDE.fullmatch(c) for c in classes), known, article
    return any(_ANYWHERE.search(c) or _OUTSIDE.fullmatch(c) for c in classes), known, article


Block = tuple[str, int, bool]


def parse(html: str, memo: dict) -> tuple[list[Block], list[tuple[int, int]]]:
    """(text, path, whether in an article) of every block with wanted text, and (path, path around it) of every container.

    memo keeps what tags mean from page to page.
    """
    if len(memo) > 100_000:
        memo.clear()
    blocks: list[Block] = []
    opens: list[tuple[int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, path, unwanted, article
    where: dict[str, list[int]] = {}  # positions in the stack by name
    scopes: list[int] = []
    bad = good = path = path_of = good_of = 0
    at = start = 0
    n, last = len(html), html.rfind(">")

    def cut(to: int) -> None:
        """Close all elements from a position in the stack on."""
        nonlocal bad, good, path
        while len(stack) > to:
            name, _, u, a = stack.pop()
            bad -= u
            good -= a
            where[name].pop()
            if name in _SCOPE:
                scopes.pop()
        path = stack[-1][1] if stack else 0

    def flush() -> None:
        nonlocal parts
        if parts:
            if t := " ".join(unescape("".join(parts)).split()):
                blocks.append((t, path_of, good_of > 0))
            parts = []

    while True:
        lt = html.find("<", at)
        if lt < 0:
            break
        m = _NAME.match(html, lt + 1)
        if m is None:
            if html.startswith("!--", lt + 1):
                end = html.find("-->", lt + 2)
                after = n if end < 0 else end + 3
            elif html.startswith("![CDATA[", lt + 1):
                end = html.find("]]>", lt)
                after = n if end < 0 else end + 3
            elif lt + 1 < n and html[lt + 1] in "!?":
                end = html.find(">", lt)
                after = n if end < 0 else end + 1
            else:
                at = lt + 1
                continue
            if not bad and lt > start:
                path_of, good_of = path, good
                parts.append(html[start:lt])
            at = start = after
            continue
        if lt > start and not bad:
            path_of, good_of = path, good
            parts.append(html[start:lt])
        if m.end() > last:
            start = n
            break
        rest = _REST.match(html, m.end())
        end = rest.end() - 1 if rest else html.find(">", m.end())
        name, attrs = m[0].lower(), html[m.end() : end]
        at = start = end + 1
        if name[0] == "/":
            name = name[1:]
            if where.get(name):
                cut(where[name][-1])
            if name in _BLOCK:
                flush()
            continue
        closes = _SAME.get(name) or (("p",) if name in _CLOSES_P else ())
        while closes:
            top = max((where[c][-1] for c in closes if where.get(c)), default=-1)
            above = next((s for s in reversed(scopes) if s <= top or stack[s][0] not in closes), -1)
            if top < 0 or above > top:
                break
            cut(top)
            if name != "tr":
                break
        tag = name, attrs, good > 0
        known = memo.get(tag)
        if known is None:
            known = unwanted(*tag)
            if len(attrs) < 500:
                memo[tag] = known
        u, classes, article = known
        if name in _RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = start = end.end() if end else n
            continue
        if name in _BLOCK:
            flush()
        if name in _VOID or attrs.endswith("/"):
            if name not in _BLOCK and not bad:
                parts.append(" ")
            continue
        below = path
        if name in _BLOCK and name not in _LEAF:
            path = memo.get((below, name, classes))
            if path is None:
                path = memo[below, name, classes] = _signed(xxhash.xxh3_64_intdigest(f"{below} {name} {classes}"))
            opens.append((path, below))
        where.setdefault(name, []).append(len(stack))
        if name in _SCOPE:
            scopes.append(len(stack))
        stack.append((name, path, u, article))
        bad += u
        good += article
    if start < n and not bad:
        path_of, good_of = path, good
        parts.append(html[start:])
    flush()
    return blocks, opens


TAG, TEXT = 0, 1


def page_tokens(html: str, memo: dict) -> dict[tuple[int, int, int], int]:
    """(kind, key, enclosing path) -> count of the template candidates of a page."""
    out: dict[tuple[int, int, int], int] = {}
    blocks, opens = parse(html, memo)
    for new, above in opens:
        key = TAG, new, above
        out[key] = out.get(key, 0) + 1
    for text, path, good in blocks:
        if not good:
            key = TEXT, _text_key(path, text), path
            out[key] = out.get(key, 0) + 1
    return out


def _count(batches):
    memo: dict = {}
    for batch in batches:
        acc: dict[tuple, list[int]] = {}
        for host, page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            of: dict[int, tuple[int, int, int]] = {}
            for key, n in page_tokens(html.as_py() or "", memo).items():
                v = of.get(n)
                if v is None:
                    h = xxhash.xxh3_128_intdigest(f"{page} {n}")
                    v = of[n] = h & 0x7FFFFFFF, h >> 31 & 0x7FFFFFFF, h >> 62 & 0x7FFFFFFF
                a = acc.setdefault((host, *key), [0, 0, 0, 0])
                a[0] += 1
                for k in range(3):
                    a[k + 1] += v[k]
        keys, vals = list(acc), list(acc.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string())]
            + [pa.array([k[i] for k in keys], pa.int32() if i == 1 else pa.int64()) for i in (1, 2, 3)]
            + [pa.array([v[i] for v in vals], pa.int64()) for i in range(4)],
            names=["host", "kind", "key", "path", "pages", "v1", "v2", "v3"],
        )


COUNT_SCHEMA = "host string, kind int, key long, path long, pages long, v1 long, v2 long, v3 long"
#: A fingerprint has three sums of 31 bits a page, which can't overflow for fewer than 2^32 pages.
VECTOR = ["v1", "v2", "v3"]


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _marks() -> list[Column]:
    # The literal comes first: a hash seeds that of the next column, so behind it there would be no new bits.
    return [F.xxhash64("html").alias("page"), F.xxhash64(F.lit(1), F.col("html")).alias("again")]


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, page, html): one row for each html of a host. Only html that a host repeats is shuffled. pages: host, html."""
    marked = pages.select("host", *_marks(), "html")
    by = ["host", "page", "again"]
    more = small(materialize(marked.groupBy(by).count().where("count > 1").select(by)))
    once = marked.join(more, by, "left_anti")
    return once.unionByName(marked.join(more, by, "left_semi").dropDuplicates(by)).select("host", "page", "html")


def templates(pages: DataFrame) -> DataFrame:
    """(host, boilerplate): hashes of the text runs in valid classes with their number of pages. pages: host, html."""
    counted = distinct_pages(pages).mapInArrow(_count, COUNT_SCHEMA)
    stats = counted.groupBy("host", "kind", "key", "path").agg(F.sum("pages").alias("pages"), *[F.sum(v).alias(v) for v in VECTOR])
    stats = materialize(stats.where(f"pages >= {MIN_PAGES}"))
    n_pages = materialize(pages.select("host", *_marks()).distinct().groupBy("host").agg(F.count("*").alias("n")).where(f"n >= {MIN_PAGES}"))
    # A host may hold a third of all pages, and so of all tokens.
    frequent = spread_join(stats, n_pages, ["host"], ["key"]).where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), SUPPORT * F.col("n")))
    classes = frequent.groupBy("host", "pages", *VECTOR).agg(F.count("*").alias("members"), F.sum(F.when(F.col("kind") == TAG, 1).otherwise(0)).alias("tags")).where(f"members >= {MIN_CLASS} and tags > 0")
    valid = frequent.join(classes.drop("members", "tags"), ["host", "pages", *VECTOR])
    # Nested: the container that holds a text run is itself a tag of a valid class of the host.
    held = valid.where(f"kind = {TAG}").select("host", F.col("key").alias("path")).distinct()
    # What a host repeats on most of its pages is no more than two thirds beyond the size of one page.
    return valid.where(f"kind = {TEXT}").join(held, ["host", "path"], "left_semi").groupBy("host").agg(F.collect_set(F.struct("key", "pages")).alias("boilerplate"))


def slots(blocks: list[tuple[str, int]], boilerplate: dict[int, int]) -> str:
    """Text of the (text, key) blocks of a page without an article. boilerplate: number of pages by key of the text run."""
    on = [boilerplate.get(key, 0) for _, key in blocks]
    least = min(on, default=0)  # 0 unless all of the page is boilerplate
    return "\n\n".join(b[0] for b, n in zip(blocks, on) if n == least)


def read_page(html: str, memo: dict) -> tuple[str | None, list[tuple[str, int]]]:
    """The article's text, or None and all (text, key) blocks of a page without one."""
    blocks, _ = parse(html, memo)
    if any(b[2] for b in blocks):
        return "\n\n".join(b[0] for b in blocks if b[2]), []
    return None, [(b[0], _text_key(b[1], b[0])) for b in blocks]


def main_text(html: str, boilerplate: dict[int, int] | None = None) -> str:
    text, blocks = read_page(html, {})
    return slots(blocks, boilerplate or {}) if text is None else text


def _read(batches):
    memo: dict = {}
    for batch in batches:
        rows = [read_page(h.as_py() or "", memo) for h in batch.column(3)]
        kind = pa.list_(pa.struct([("t", pa.string()), ("k", pa.int64())]))
        blocks = pa.array([None if t is not None else [{"t": x, "k": k} for x, k in b] for t, b in rows], kind)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array([t for t, _ in rows], pa.string()), blocks], names=["page_id", "url", "host", "text", "blocks"])


def _fill(batches):
    known: dict[str, dict[int, int]] = {}
    for batch in batches:
        text = []
        for host, blocks, rules in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = {x["key"]: x["pages"] for x in rules.as_py() or ()}
            text.append(slots([(b["t"], b["k"]) for b in blocks.as_py()], known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(text, pa.string())], names=["page_id", "url", "host", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, host) of every page."""
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host_of(url).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rules = materialize(templates(src.select("host", "html")))
    read = materialize(src.mapInArrow(_read, "page_id long, url string, host string, text string, blocks array<struct<t:string,k:long>>"))
    # Only pages without an article meet the templates, and only with their blocks. A host may hold a third of them.
    rest = spread_join(read.where("text is null").drop("text"), rules, ["host"], ["page_id", "url"], "left")
    filled = rest.select("page_id", "url", "host", "blocks", "boilerplate").mapInArrow(_fill, "page_id long, url string, host string, text string")
    return read.where("text is not null").drop("blocks").unionByName(filled).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
