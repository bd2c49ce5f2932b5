import hashlib
import json
import random
import re

import numpy as np
import pytest

from quarry.llm import language as G
from quarry.llm import quality as Q
from quarry.llm import url_filter as U
from quarry.llm import warc as W
from tests.llm import brute

# ---- quality rules --------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = brute.WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    lost = sum(sum(map(len, brute.WORD.findall(x))) for x in lines if Q.line_fails(x))
    kept = not failed and 100 * lost <= 50 * sum(map(len, words))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed, kept


def test_quality_counts(docs, texts):
    short = {i for i, t in texts if len(t or "") < 8000}
    got = {r.doc_id: tuple(r)[2:9] for r in Q.quality(docs).collect()}
    assert {i: got[i] for i in short} == {i: plain_counts(t) for i, t in texts if i in short}


def test_quality_of_odd_rows(odd, empty, texts):
    assert Q.quality(odd).count() == len(texts) + 4 and Q.quality(empty).collect() == []
    kept = Q.keep_clean(odd)
    assert kept.columns == odd.columns
    assert all(r.n_chars == len(r.text) and r.kept == "clash" for r in kept.collect())


@pytest.mark.parametrize(
    "line, rule",
    [
        ("This is a plain sentence that ends as it should.", None),
        ("Home | About | Contact | Login", "navigation"),
        ("Menu", "navigation"),
        ("All rights reserved.", "boilerplate"),
        ("Please enable JavaScript to see this page.", "boilerplate"),
        ("Alle Rechte vorbehalten.", "boilerplate"),
        ("Accueil du site", "navigation"),
        ("Política de privacidad y más.", "boilerplate"),
        ("a line cut short", "punctuation"),
        ("A long line, with a comma inside, whose end was cut off by the crawler at some", None),
        ('He said "yes."', None),
        ("This work is licensed under the MIT License.", None),
    ],
)
def test_line_rules(line, rule):
    assert Q.line_fails(line) == rule


def test_failing_lines_go():
    assert Q.clean_lines("A good line is here.\nHome | News | Shop\nA good line is here.\n\nEnd of it.") == ("A good line is here.\nA good line is here.\n\nEnd of it.", 14, 1, 1)


# ---- URL filter -------------------------------------------------------------------------------------


def plain_fit(rule, host, path):
    glob = lambda g: "".join(".*" if c == "*" else re.escape(c) for c in g)
    lead = "" if rule.host.startswith("*") else r"(?:.*\.)?"
    tail = "" if rule.path.endswith("$") else ".*"
    return re.fullmatch(lead + glob(rule.host), host, re.S) and re.fullmatch(glob(rule.path.removesuffix("$")) + tail, path, re.S)


URLS = [
    None,
    "",
    "no scheme",
    "http://org/",
    "http://a.org",
    "http://a.org/",
    "https://EXAMPLE.org/es/x",
    "https://m.example.org/en/1234?q",
    "https://myexample.org/es/",
    "http://x.com/fr/",
    "http://x.com/de/#a",
    "http://x.com/a.org/",
    "http://x.net/wp-admin/x",
    "http://x.net/f.EXE",
    "http://x.net/f.exe",
    "http://x.net/f.exe/more",
    "http://ads.x.net/",
    "http://badads.x.net/",
    "http://user@x.org:80/p://q",
    "http://é.org/ü",
    "x://org/" + "a" * 30_000,
]


def test_automaton_equals_regular_expressions():
    rng = random.Random(4)
    hosts, paths = ["org", "example.org", "x.com", "ads.example.com", "a.doubleclick.net", "net", ""], ["", "/", "/es/", "/en/1", "/fr/a", "/de/", "/a/login", "/b.pdf", "/robots.txt", "/x/cgi-bin/y.exe"]
    urls = URLS + [f"http://{rng.choice(['', 'm.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a', '#b'])}" for _ in range(500)]
    rules = U.NAMED_RULES + U.OWN_RULES
    parts = [U.split_url(u) for u in urls]
    got = U.ShiftAnd(rules).run([U.encode(*p) for p in parts])
    assert got.tolist() == [[bool(plain_fit(r, *p)) for r in rules] for p in parts]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://a.org/", "x")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in U.filter_urls(pages).collect()}
    assert got[0] == ("", None, "block") and got[3] == ("org", "org/", "allow") and got[4] == ("a.org", None, "allow")
    assert got[6] == ("example.org", "example.org/es/", "block") and got[7] == ("m.example.org", "example.org/en/1", "block")
    assert got[8][1] == "org/" and got[10][2] == "block" and got[14][2] == "block" and got[16][2] == "block" and got[17][2] == "allow"
    assert got[None] == ("a.org", "org/", "allow")
    assert U.filter_urls(pages.limit(0)).collect() == []


# ---- WARC ---------------------------------------------------------------------------------------------

PAGE = """<html><head><title>A &amp; B</title><style>p{}</style><script>var x = "<p>no</p>";</script></head>
<body><!-- no --><h1>Head</h1><p>One&nbsp;two<br>three <b>four</b></p><a href="/x?a=1&amp;b=2">link</a></body></html>"""


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (None, "http://b/", "plain", "x"), (1, "http://a/", PAGE, "x")], "page_id long, url string, html string, record string")
    rows = W.report(pages).collect()
    assert len(rows) == 4 and all(r.refers_to == r.response_id for r in rows)
    one = [r for r in rows if r.page_id == 1]
    assert one[0] == one[1] and one[0].title == "A & B" and one[0].n_links == 1 and one[0].target_uri == "http://a/"
    assert one[0].payload_digest == W.digest(PAGE.encode())
    assert one[0].text_sha256 == hashlib.sha256("Head\nOne two\nthree four\nlink".encode()).hexdigest()
    assert W.report(pages.limit(0)).collect() == []


def test_records_round_trip_and_survive_damage():
    record = W.response_record(5, "http://a/\r\nX: y", PAGE)
    (headers, block), *more = W.parse(record)
    assert not more and W.get(headers, "warc-type") == "response" and W.get(headers, "X") is None
    status, http, payload = W.split_http(block)
    assert payload.decode() == PAGE and W.get(http, "content-type").startswith("text/html")
    meta, text = W.derive(headers, block)
    whole = record + meta + text
    kinds = [W.get(h, "WARC-Type") for h, _ in W.parse(whole)]
    assert kinds == ["response", "metadata", "conversion"]
    facts = json.loads([b for h, b in W.parse(meta)][0])
    assert facts["links"] == ["/x?a=1&b=2"] and dict(facts["warc_headers"])["WARC-Record-ID"] == W.get(headers, "WARC-Record-ID")
    assert len(list(W.parse(whole[:-20]))) == 2 and list(W.parse(b"not a record")) == []


class Plain(__import__("html.parser").parser.HTMLParser):
    """Title, text by lines and links of a page by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.skip, self.inside = [], [], None, None, False
        self.feed(source)
        self.close()
        self.text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.out).split("\n")) if x)
        self.title = " ".join((self.title or "").split())

    def handle_starttag(self, tag, attrs):
        if tag in W._LINKED and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        if tag in W._DROPPED and self.skip is None:
            self.skip = tag
            self.out.append(" ")
        elif tag == "title" and self.title is None:
            self.inside, self.title = True, ""
        elif tag in W._BREAKS:
            self.out.append("\n")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        elif tag == "title" and self.inside:
            self.inside = False
        elif tag in W._BREAKS and self.skip is None:
            self.out.append("\n")

    def handle_comment(self, data):
        if self.skip is None:
            self.out.append(" ")

    handle_decl = handle_comment

    def handle_data(self, data):
        if self.inside:
            self.title += data
        elif self.skip is None:
            self.out.append(data)


def test_all_pages_equal_the_standard_parser(spark):
    """The registered query on the whole table of pages against html.parser."""
    import os

    from quarry.llm.queries import op6_warc_derivatives

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    want = {}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        page = Plain(r.html or "")
        want[r.page_id] = (r.url or "", page.title, len(page.links), len(page.text), hashlib.sha256(page.text.encode()).hexdigest(), W.digest((r.html or "").encode()))
    got = {r.page_id: (r.target_uri, r.title, r.n_links, r.n_chars, r.text_sha256, r.payload_digest) for r in op6_warc_derivatives(spark, d).collect()}
    assert got == want


def response(head, body):
    return W.build([("WARC-Type", "response"), ("WARC-Record-ID", W.record_id(head))], f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body)


def test_codings_and_media_types():
    import gzip
    import zlib

    page, want = PAGE.encode(), "Head\nOne two\nthree four\nlink"
    chunked = lambda b: b"".join(f"{len(b[i : i + 50]):x};x=y\r\n".encode() + b[i : i + 50] + b"\r\n" for i in range(0, len(b), 50)) + b"0\r\n\r\n"
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    cases = [
        ("Content-Type: text/html", page, want),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked", chunked(page), want),
        ("Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked(gzip.compress(page)), want),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(page), want),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", raw.compress(page) + raw.flush(), want),
        ("Content-Type: text/plain; charset=latin-1", "é <b>".encode("latin-1"), "é <b>"),
        ("Content-Type: image/png", b"\x89PNG", None),
        ("Content-Type: text/html\r\nContent-Encoding: br", b"\0\1", None),
        ("Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(page)[:30], None),
    ]
    for head, body, text in cases:
        meta, conv = W.derive(*next(W.parse(response(head, body))))
        assert (None if conv is None else next(W.parse(conv))[1].decode()) == text, head
        assert json.loads(next(W.parse(meta))[1])["payload_digest"] == W.digest(body)


def test_damage_is_counted_and_reading_goes_on(spark):
    good = [W.response_record(i, f"http://a/{i}", PAGE) for i in range(4)]
    torn = good[0] + good[1][: len(good[1]) // 2] + good[2] + good[3]
    plain = b"".join(next(W._members(g, [])) for g in good)
    short = plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    rows = W.derivatives(spark.createDataFrame([(1, bytearray(torn)), (2, bytearray(short)), (3, bytearray(b"none"))], "page_id long, record binary")).collect()
    per = lambda i: (sum(r.response_id is not None for r in rows if r.page_id == i), sum(r.damaged for r in rows if r.page_id == i))
    assert per(1) == (3, 1) and per(2) == (3, 1) and per(3) == (0, 0)


def test_responses_of_a_whole_file(spark):
    data = b"".join(W.response_record(i, f"http://a/{i}", PAGE) for i in range(3))
    rows = W.derivatives(spark.createDataFrame([(None, bytearray(data)), (None, None)], "page_id long, record binary")).collect()
    assert len(rows) == 3 and len({r.response_id for r in rows}) == 3


# ---- language -------------------------------------------------------------------------------------------


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = G.tables(rng, 3, 4)
    G.quiet_pad(w, 3)
    codes, labels = rng.integers(0, 257, (7, 5)), rng.integers(0, 4, 5)

    def loss():
        p = G.probabilities(w, codes)
        real = codes != 256
        return -(np.log(p[:, labels, np.arange(5)]) * real).sum() / real.sum()

    grad = G.gradients(w, codes, labels)
    for name in w:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            if name[0] == "x":
                at = (at[0], codes[codes != 256][rng.integers(0, 20)])
            old = w[name][at]
            w[name][at] = old + 3e-2
            up = loss()
            w[name][at] = old - 3e-2
            down = loss()
            w[name][at] = old
            assert abs(grad[name][at] - (up - down) / 6e-2) < 4e-3


def test_padding_changes_nothing():
    w = G.tables(np.random.default_rng(1), 4, 3)
    G.quiet_pad(w, 4)
    codes = np.array([[10], [20], [30]])
    longer = np.array([[10], [20], [30], [256], [256]])
    assert np.allclose(G.probabilities(w, codes), G.probabilities(w, longer)[:3], atol=1e-6)


def test_languages_of_held_out_texts(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    rows = G.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_pools_equal_a_byte_at_a_time():
    """Probabilities of each segment by itself, summed over a document's bytes."""
    rng = np.random.default_rng(2)
    w = G.tables(rng, G.HIDDEN, 3)
    G.quiet_pad(w, G.HIDDEN)
    model = G.Model(["a", "b", "c"], w)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 500)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = next(G.pooled(model, iter([(np.frombuffer(b"".join(texts), np.uint8), offsets)])))
    for t, row in zip(texts, got):
        want = np.zeros(3)
        for at in range(0, len(t), G.SEGMENT):
            want += G.probabilities(w, np.frombuffer(t[at : at + G.SEGMENT], np.uint8).astype(np.intp)[:, None])[:, :, 0].sum(axis=0)
        assert np.allclose(row, want, atol=1e-3)


def scalar_states(w, side, codes):
    """The gated recurrent unit number by number, from its definition."""
    n = w["h" + side].shape[1]
    squash = lambda v: v / (1 + abs(v))
    gate = lambda v: 0.5 * squash(v) + 0.5
    h, out = [0.0] * n, {}
    for t in range(len(codes)) if side == "f" else reversed(range(len(codes))):
        into = [[float(w["x" + side][k * n + i][codes[t]]) for i in range(n)] for k in range(3)]
        back = [[sum(float(w["h" + side][k * n + i][j]) * h[j] for j in range(n)) for i in range(n)] for k in range(3)]
        new = []
        for i in range(n):
            update, reset = gate(into[0][i] + back[0][i]), gate(into[1][i] + back[1][i])
            candidate = squash(into[2][i] + reset * back[2][i])
            new.append(update * h[i] + (1 - update) * candidate)
        h = out[t] = new
    return out


def test_network_equals_its_definition():
    rng = np.random.default_rng(4)
    w = G.tables(rng, 3, 4)
    G.quiet_pad(w, 3)
    codes = [int(c) for c in rng.integers(0, 256, 9)]
    sides = {side: scalar_states(w, side, codes) for side in "fb"}
    got = G.probabilities(w, np.array(codes)[:, None])
    for t in range(len(codes)):
        logits = [float(w["b"][k][0]) + sum(float(w["o" + side][k][j]) * sides[side][t][j] for side in "fb" for j in range(3)) for k in range(4)]
        total = sum(np.exp(v) for v in logits)
        assert np.allclose(got[t, :, 0], [np.exp(v) / total for v in logits], atol=1e-5)


def test_seventy_languages(spark, monkeypatch):
    """Every language is learned from, however many there are; longer training tells them apart."""
    monkeypatch.setattr(G, "STEPS", 600)
    rng = random.Random(12)
    scripts = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(70)]
    rows = [(i, "".join(rng.choice(scripts[i % 70]) for _ in range(30)), f"l{i % 70:02d}", "s", None, *["clash"] * 7) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sha string, block string, tie string, kept string, rep string, h string, key string")
    drawn = G.sample(docs)
    assert {lang for _, lang in drawn} == {r[2] for r in rows}
    got = G.identify(docs).collect()
    assert len({r.lang_pred for r in got}) >= 60


def test_draws_are_bounded_by_rows_and_reach_whole_texts(spark, monkeypatch):
    sizes = {f"l{k}": {n: 1 + (n * 7) % 50 for n in range(1, 301)} for k in range(5)}
    drawn = G.draws(sizes)
    for lang, own in sizes.items():
        rows = {n: parts for name, n, parts in drawn if name == lang}
        assert all(0 <= p < own[n] for n, parts in rows.items() for p in parts)
        assert sum(map(len, rows.values())) == min(sum(own.values()), -(-G.STEPS * G.BATCH // 5))
    monkeypatch.setattr(G, "SAMPLE_TOTAL", 20)
    assert {lang: {n for name, n, _ in G.draws(sizes) if name == lang} <= {1, 2, 3, 4} for lang in sizes} == dict.fromkeys(sizes, True)
    monkeypatch.setattr(G, "SAMPLE_TOTAL", 2)
    assert {name for name, *_ in G.draws(sizes)} == set(sizes)
    text = "".join(chr(97 + i // 64 % 26) for i in range(64 * 26 * 4))
    docs = spark.createDataFrame([(1, text, "en"), (2, "é" * 40, "fr")], "doc_id long, text string, lang string")
    found = {s for s, lang in G.sample(docs) if lang == "en"}
    assert found == {text[i : i + 64].encode() for i in range(0, len(text), 64)}


def test_language_of_odd_rows(odd, empty, texts):
    rows = G.identify(odd).collect()
    assert len(rows) == len(texts) + 4
    by = {r.doc_id: r for r in rows}
    for i, t in texts:
        if not re.search(r"[^\W\d_]", t or ""):
            assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[None].held_out and G.identify(empty).collect() == []
