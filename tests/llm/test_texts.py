"""Licenses, personal data, MPEG audio and HTML against brute force and round trips."""

import hashlib
import random
import re
import zlib

import pytest
from skein.llm import html_extract as html
from skein.llm import license_scan as lic
from skein.llm import mpeg_audio as mp
from skein.llm import pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_license_base(spark, docs, none):
    extra = ["GNU General-Public  license, CC BY-NC 4.0; mit\nLICENSE mit license", "the apache licenses", "cc by cc by", "Ünder the MIT License.", "x mit licenseé"]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = {}
    for r in d.collect():
        w = WORD.findall(low(r.text))
        places, labels = [], set()
        for phrase, label in lic.PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        want[r.doc_id] = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    got = lic.scan(d).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got) and lic.scan(none).count() == 0
    assert want[900][1] == 4


def regex_of(markup):
    """A template as a regular expression over words joined by blanks."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
        out += {"<<optional>>": "(?:", "<<end>>": ")?"}.get(part) or (rf"(?:\S+ ){{0,{part[5:-2].strip()}}}" if part.startswith("<<var") else re.escape(part) + " ")
    return re.compile(r"(?:^|(?<= ))" + out)


@pytest.mark.parametrize("label", sorted(lic.TEMPLATES))
def test_automata_equal_regular_expressions(label):
    rng, markup = random.Random(label), lic.TEMPLATES[label]
    a, rx = lic.Automaton(markup), regex_of(markup)
    words = [w for w in re.findall(r"<<[^>]*>>|[^\s<>]+", markup) if not w.startswith("<<")]
    for _ in range(60):
        seq = [w for w in words if rng.random() > rng.choice([0, 0, 0.02, 0.3])]
        for _ in range(rng.randrange(4)):
            seq.insert(rng.randrange(len(seq) + 1), rng.choice([*words, "zzz"]))
        got = any(a.accepts_at([w.encode() for w in seq], i) for i in range(len(seq) + 1))
        assert got == bool(rx.search(" ".join(seq) + " "))


def test_license_templates(spark):
    d = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (2, lic._PERMISSION.replace("<<optional>> including the next paragraph <<end>>", "")), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "permission is hereby granted")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in lic.scan(d).collect()}
    assert got[1] == ("cc-by,text:cc-by-nc-4.0-notice", 1.0) and got[2] == ("text:mit-text", 1.0) and got[4] == ("", 0.0)
    assert "text:gpl-3.0-version" in got[3][0] and "text:gpl-notice" in got[3][0]


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base():
    rng = random.Random(4)
    for alphabet in ("a1.@+- 2(-", "4 -12.", "@.a@b", "+1 ()5é"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("1" * 50_000 + "@" * 10) == []


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to john (at) example [dot] com now", "email", "john (at) example [dot] com"),
        ("mary at mail dot example dot org,", "email", "mary at mail dot example dot org"),
        ("é аdmin@ехample.com", "email", "аdmin@ехample.com"),
        ("a jo​hn@ex­ample.com b", "email", "jo​hn@ex­ample.com"),
        ("dial plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("pay four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("host 10 dot 0 dot 0 dot 7 up", "ip", "10 dot 0 dot 0 dot 7"),
        ("１０.0.0.7", "ip", "１０.0.0.7"),
    ],
)
def test_disguises_map_back(text, kind, source):
    spans = pii.all_spans(text)
    assert (kind, text.index(source), text.index(source) + len(source)) in spans
    assert f"[{kind}]" in pii.mask(text)


def test_plain_words_are_no_disguise():
    for t in ("he was at home. dot", "one two", "look at the dotted line", "at a point (at noon)", "seven, eight"):
        assert pii.all_spans(t) == []


@pytest.mark.parametrize("text", ["john at example.com", "john<@>example.com", "john@example<.>com", "john\u00a0AT\u00a0example.com", "(one 2 3 4 5 6 7 8 9 1 2 3 4 5 6 seven) plus"])
def test_pii_gate_sees(text):
    assert pii.disguised(text)


def test_pii_gate_misses_nothing():
    """Whatever a transducer changes passes the gate, so gated and ungated spans agree."""
    rng = random.Random(5)
    parts = "john example com 4111 192 168 1 0 @ . + at AT dot Dot arroba punkt po\u0131nt po\u0130nt point ( ) [ ] { } < > <@> <.> (at) [dot] one Two \u017fix s\u0131x \u017feven plus fünf FÜNF, - _ \t \n \u00a0 \u00ad \u200b а ａ １ ․ é".split(" ") + [" ", " ", " "]
    changed = 0
    for _ in range(20_000):
        t = rng.choice(("", " ")).join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        x = pii.tape(t)
        for step in pii.TRANSDUCERS:
            x = step(x)
        changed += x.text != t
        assert x.text == t or pii.disguised(t), t
        assert pii.all_spans(t) == pii.added_spans(t, pii.base_spans(t)), t
    assert changed > 1000
    assert pii.mask("write to john at example.com or john<@>example.com") == "write to [email] or [email]"


def plain_tape(t):
    """The transducers' result with the source span of every character, by rewriting lists of characters."""
    x, chars = pii.tape(t), [(c, i, i + 1) for i, c in enumerate(t)]
    for step in pii.TRANSDUCERS:
        before = len(x.layers)
        x = step(x)
        for layer in x.layers[before:]:
            out, at, shift = [], 0, 0
            for s, e, old_s, old_e in zip(*layer):
                out += chars[at:old_s]
                out += [("?", chars[old_s][1], chars[old_e - 1][2])] * (e - s)
                at = old_e
            chars = out + chars[at:]
    return x, chars


def test_spans_map_back_like_character_by_character():
    rng = random.Random(7)
    parts = "john example com 4111 1 0 @ . at dot (at) [dot] one two six plus - \u200b а １ ․ é".split(" ") + [" ", " "]
    for _ in range(4000):
        t = rng.choice(("", " ")).join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        x, chars = plain_tape(t)
        assert len(chars) == len(x.text)
        for i in range(len(chars)):
            assert x.source(i, i + 1) == chars[i][1:]
        out = base = pii.base_spans(t)
        for k, s, e in pii.base_spans(x.text):
            a, b = chars[s][1], chars[e - 1][2]
            if not any(k == kk and a < f and b > g for kk, g, f in out):
                out = [*out, (k, a, b)]
        assert pii.all_spans(t, base) == sorted(out, key=lambda p: (pii.KINDS.index(p[0]), p[1], p[2])), t


def test_unrelated_sentences_change_no_span():
    rng = random.Random(8)
    texts = ["write to mary at mail.example.org now", "john (at) example [dot] com", "dial plus one five five five one two three four five six seven ok", "host 10 dot 0 dot 0 dot 7 up", "a@b.co", "jo\u200bhn@example.com", "look at node.js now", "at a point"]
    more = ["An anecdote. ", "Look at node.js now. ", "It is (at) noon [dot]. ", "Two plus one. ", "See setup.py at work. ", "Ünïcode а. ", "mail me @ home. "]
    for t in texts:
        want = pii.all_spans(t)
        for _ in range(40):
            head, tail = "".join(rng.sample(more, rng.randrange(4))), "".join(rng.sample(more, rng.randrange(3)))
            got = pii.all_spans(head + t + ". " + tail)
            assert got == [(k, a + len(head), b + len(head)) for k, a, b in want], (head, t, tail)


def test_disguises_without_caps():
    for n in (64, 65, 5000):
        assert pii.all_spans("x" * n + " at example dot com") == [("email", 0, n + 19)]
        assert pii.all_spans("a at " + "y" * n + ".org. Then") == [("email", 0, n + 9)]
    for t in ("an anecdote. look at node.js now", "look at main.rs", "see it at www.thing.py", "he is at home.Then dot"):
        assert pii.all_spans(t) == []
    assert pii.all_spans("me at x dot rs") == [("email", 0, 14)] and pii.all_spans("me@x dot internal") == [("email", 0, 17)]
    assert pii.all_spans("me @ x.y dot org") == [("email", 0, 16)] and pii.all_spans("see you @ 10.30") == []


@pytest.mark.parametrize("unit", ["a at b ", "a@b.co ", "one two ", "(at) ", "a dot ", "at  ", "1.1.1.1 dot ", "+1 ", "x.", "\u200b", "a-"])
def test_pii_is_linear(unit):
    import time

    took = []
    for n in (100_000, 200_000):
        began = time.thread_time()
        pii.all_spans("a@b.co dot " + unit * (n // len(unit)))
        took.append(time.thread_time() - began)
    assert took[1] < 4 * took[0] + 0.5


def test_pii_frames(spark, docs, none):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.co a@b.co 1.2.3.4"), (3, "a@b.co a@b.co 1.2.3.4")], "doc_id long, text string")
    got = sorted(map(tuple, pii.find_pii(d).collect()))
    assert got[0] == (1, 0, 0, 0, 0, "", "", 0) and got[2] == got[3] == (3, 2, 1, 0, 0, "email:0:6,email:7:13,ip:14:21", "email:0:6,email:7:13,ip:14:21", 0)
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(none).count() == 0


def test_pii_query(spark, sf):
    got = {r.doc_id: r for r in pii.op7_pii(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = brute_pii(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[r.doc_id].n_email == sum(k == "email" for k, _, _ in base)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1151, 1152, 1344, 1345, 30000])
def test_audio_round_trip(n):
    payload = mp.pad(random.Random(n).randbytes(n))
    assert len(payload) % 192 == 0 and len(payload) >= 192
    stream = mp.encode(payload)
    back, s = mp.decode(stream)
    assert back == payload and s["crc_bad"] == 0 and s["table"]["frames"] == len(s["offsets"]) and s["tags"]
    assert s["samples"] == 1152 * len(s["offsets"]) and s["duration"] * 32000 == s["samples"]
    assert all(mp.frame_header(stream, o)[0] == k for o, k in zip(s["offsets"], s["lengths"]))
    assert mp.decode(stream + b"TAG" + bytes(125))[0] == payload


def test_audio_resynchronises_and_checks():
    stream = mp.encode(mp.pad(b"a" * 5000))
    _, s = mp.decode(stream)
    junk = b"\xff\xfb\x00noise" + stream[len(mp.ID3) :]
    assert mp.decode(junk)[0] == mp.pad(b"a" * 5000) and mp.decode(junk)[1]["skipped"] > 0
    broken = bytearray(stream)
    broken[s["offsets"][1] + 7] ^= 1
    assert mp.parse_stream(bytes(broken))["crc_bad"] == 1
    assert mp.parse_stream(b"")["samples"] == 0 and mp.parse_stream(b"\xff" * 500)["offsets"] == []
    bits = lambda data: int(bin(int.from_bytes(data))[2:] or "0", 2)
    crc, poly = 0xFFFF, 0x8005
    for byte in b"frame":
        for k in range(7, -1, -1):
            top = (crc >> 15) ^ (byte >> k & 1)
            crc = ((crc << 1) & 0xFFFF) ^ (poly if top else 0)
    assert mp.crc16(b"frame") == crc and bits(b"\x01") == 1


def with_crc(head, body, bits, length):
    crc = 0xFFFF
    data = int.from_bytes(head[2:] + body)
    total = 16 + 8 * len(body)
    for k in range(16 + bits):
        top = (crc >> 15) ^ (data >> (total - 1 - k) & 1)
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return (head + crc.to_bytes(2) + body).ljust(length, b"\0")


def test_checksums_of_layers_one_and_two():
    # Layer I, 32 kHz, 32 kbit/s: 48 bytes a frame; mono has 32 allocations of 4 bits.
    head = bytes((0xFF, 0xFE, 1 << 4 | 2 << 2, 0xC0))
    frame = with_crc(head, bytes(range(40)), 128, 48)
    assert mp.frame_header(frame, 0)[0] == 48
    good = mp.parse_stream(frame * 3)
    assert (good["crc_ok"], good["crc_bad"], good["samples"]) == (3, 0, 1152)
    assert mp.parse_stream(frame * 2 + frame[:10] + b"\x55" + frame[11:])["crc_bad"] == 1
    # Joint stereo with bound 4: four pairs of allocations, then 28 shared ones.
    joint = with_crc(head[:3] + bytes((0x40,)), bytes(range(40)), 4 * (8 + 28), 48)
    assert mp.parse_stream(joint * 3)["crc_ok"] == 3
    # Layer II, 48 kHz, 32 kbit/s, mono: table of eight subbands, 4 4 3 3 3 3 3 3 bits; two of them used.
    head = bytes((0xFF, 0xFC, 1 << 4 | 1 << 2, 0xC0))
    body = int.to_bytes((0b0001_0000_101_000_000_000_000_000 << 6), 4) + bytes(60)
    assert mp.layer2_table(3, 32, 1, 48000) == (4, 4, 3, 3, 3, 3, 3, 3)
    length = mp.frame_header(head + bytes(8), 0)[0]
    frame = with_crc(head, body, 26 + 4, length)
    assert mp.parse_stream(frame * 3)["crc_ok"] == 3 and mp.parse_stream(frame * 2 + frame[:6] + b"\xf0" + frame[7:])["crc_bad"] == 1
    assert [len(t) for t in mp.LAYER2_BITS] == [27, 30, 8, 12, 30] and [sum(t) for t in mp.LAYER2_BITS] == [88, 94, 26, 38, 75]


def test_any_bytes_can_be_read():
    rng = random.Random(12)
    cut = bytes((0xFF, 0xE3, 8 << 4 | 2 << 2, 0xC0)).ljust(36, b"\0") + b"VBRI" + bytes(8)
    assert mp.parse_stream(cut)["table"] is None
    for _ in range(3000):
        b = bytearray(rng.choice((b"", mp.ID3, b"ID3", b"APETAGEX", mp.encode(mp.pad(b"x" * rng.randrange(600))))) + rng.randbytes(rng.randrange(80)))
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at:at] = rng.choice((b"\xff\xfb", b"\xff\xe3\x84\xc0", b"\xff\xfc\x14\xc0", b"\xff\xfe\x18\x40", b"Xing", b"VBRI", b"TAG", b"\0" * 40, rng.randbytes(3)))
        if rng.random() < 0.5:
            b = b[: rng.randrange(len(b) + 1)]
        s = mp.parse_stream(bytes(b))
        assert all(mp.frame_header(bytes(b), o) for o in s["offsets"]) and s["crc_ok"] + s["crc_bad"] <= len(s["offsets"]) + 1
        mp.decode(bytes(b))


def test_audio_columns(spark, docs, none):
    rows = {r.doc_id: r for r in mp.digests(mp.store(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        p, got = mp.pad(raw), rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert mp.digests(mp.store(none)).count() == 0
    one = mp.stream_columns(mp.store(docs.limit(2))).select("stream.*").collect()
    assert all(r.crc_bad == 0 and r.table == "Xing" and r.frames == len(r.offsets) for r in one)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">menu</a></ul></nav>
<div class="ad">buy</div><div class="cookie-notice">cookies</div>{body}<aside>side</aside><div id="comments"><p>first!</div><form><input>send</form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; b</h1><p><b>One\n two.<br><p>Three <i>f</i>our</p></article>", "A & b\n\nOne two.\n\nThree four"),
        ("<article><p>x<!-- <p>no --><script>if(a<b){}</script>y</p><ul><li>a<li>b</ul><div class='share'>tweet</div></article>", "xy\n\na\n\nb"),
        ("<main><h2>&#72;i &lt;p&gt;</h2><table><tr><td>1<td>2</table></main>", "Hi <p>\n\n1\n\n2"),
        ("<article></article>", ""),
        ("<div class='content'><p>no article &nbsp; here</p></div>", "no article here"),
        ("<article><p>a <span class='ad'>no</span>b</p><article class='comment'>c</article></article>", "a b"),
        ("<p title='a>b'>q</p><p>3 < 4 & 5</p>", "q\n\n3 < 4 & 5"),
    ],
)
def test_main_text(body, want):
    assert html.main_text(PAGE.format(body=body)) == want


def test_templates_are_deduced(spark):
    page = lambda i: f"<body><div class=wrap><p>Welcome to our site<p>Read more here<div class=inner><p>story {i} is long and tells of {i * 7}<p>another part {i}</div></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(90, "http://other.example/", page(90)), (91, None, None), (92, "nonsense", ""), (92, "nonsense", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 is long and tells of 21\n\nanother part 3"
    assert got[91] == "" and got[92] == "" and "story 90" in got[90]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def extracted(spark, pages):
    rows = [(i, f"http://{host}.example/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_repeated_articles_stay(spark):
    page = lambda body, i: f"<body><div class=wrap><p>Welcome to our site<p>Read more here</div>{body}<div class=x><p>{i}</p></div></body>"
    story = "<article class=story><h1>Title</h1><div class=part><p>one</div><p>two</article>"
    copies = [("copy", page(story, 0))] * 6  # equal pages
    variants = [("variant", page(story, i)) for i in range(6)]  # the same article on pages that differ elsewhere
    shared = [("shared", page(f"<main><p>Summary</p><p>story {i}</p></main>", i)) for i in range(6)]
    lone = [("lone", "<body><div class=a><div class=b><p>one<p>two</div></div></body>")] * 4
    bare = [("bare", f"<body><div class=wrap><p>Welcome</div><div class=a><p>a story {i * (i > 6)} of its own</p></div><!-- {i} --></body>") for i in range(10)]
    got = extracted(spark, copies + variants + shared + lone + bare)
    assert got[:12] == ["Title\n\none\n\ntwo"] * 12
    assert got[12:18] == [f"Summary\n\nstory {i}" for i in range(6)]
    assert got[18:22] == ["one\n\ntwo"] * 4
    assert got[22:] == [f"a story {i * (i > 6)} of its own" for i in range(10)]


def test_all_slots_stay(spark):
    terms = "<div class=legal><p>" + "the same terms again and again " * 20 + "</p><p>and more</p></div>"
    page = lambda i: f"<body>{terms}<div class=post><h1>Title {i}</h1><p class=lead>lead {i}</p><div class=entry><p>story {i}</p></div></div><div class=more><p><a href=x>part {i}</a></div></body>"
    assert extracted(spark, [("long", page(i)) for i in range(6)]) == [f"Title {i}\n\nlead {i}\n\nstory {i}\n\npart {i}" for i in range(6)]


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_repeated_rows_change_nothing(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(10).select("page_id", "url", "html")
    bare = [(1000 + i, "http://bare.example/", f"<body><div class=wrap><p>Welcome<p>Read more</div><div class=a><p>story {i // 2}</p></div></body>") for i in range(12)]
    d = pages.unionByName(pages_frame(spark, bare)).cache()
    once = {r.page_id: r.text for r in html.extract(d).collect()}
    twice = html.extract(d.union(d)).collect()
    assert len(twice) == 2 * len(once) and all(r.text == once[r.page_id] for r in twice) and once[1004] == "story 2"
    alone = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(once[k] == v for k, v in alone.items())


def test_classes_inside_and_outside_of_articles():
    keep = "<h2 class='section-header'>Methods</h2><section class='related-work'><p>before</p></section><div class='search-results'><p>found</p></div><h3 class=related>More</h3>"
    drop = "<div class='related-posts'>x</div><div class='post comments'>x</div><div id=share>x</div><div class='ad-slot'>x</div><div class=newsletter-signup>x</div>"
    assert html.main_text(PAGE.format(body=f"<article>{keep}{drop}</article>")) == "Methods\n\nbefore\n\nfound\n\nMore"
    outside = "<div class=site-header>x</div><div class='search-box'>x</div><div class='left-sidebar'>x</div><div class='cookie-bar'>x</div><div class=main-nav>x</div>"
    assert html.main_text(PAGE.format(body=keep + outside)) == "Methods\n\nbefore\n\nfound\n\nMore"


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<a b="', "<b>", "<td>", "</x>", "<div></p>", "<table><b><p>", "<a =\"'>", "<!--", "<p class=x", "< ", "<![CDATA["])
def test_broken_pages_are_read_in_linear_time(unit):
    import time

    began = time.thread_time()
    html.main_text("<p>text" + unit * (300_000 // len(unit)))
    half = time.thread_time() - began
    html.main_text("<p>text" + unit * (600_000 // len(unit)))
    assert time.thread_time() - began - half < 4 * half + 1.5


@pytest.mark.parametrize(("page", "want"), [("<p>a<p class='x", "a"), ("<p>a</p><a href=it's>b</a> don't", "a\n\nb don't"), ("a <a t=\"x>b</a> c", "a b c"), ("x<!-->y-->z", "xy-->z"), ("1 < 2 </ 3", "1 < 2 </ 3"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), (None, "")])
def test_broken_markup(page, want):
    assert html.main_text(page or "") == want


def test_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    from skein.functions import shared

    page = lambda i: f"<body><div class=wrap><p>Welcome to our site<p>Read more here<div class=inner><p>story {i}</div></div></body>"
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    assert extracted(spark, [("h", page(i)) for i in range(12)]) == [f"story {i}" for i in range(12)]


def test_pages_query(spark, sf):
    import html as std

    got = {r.page_id: r for r in html.op5_html_extract(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("</?(?:p|h1)>", "\0", inner))).split("\0")
        want = "\n\n".join(x for x in (" ".join(std.unescape(b).split()) for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
