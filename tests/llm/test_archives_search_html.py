"""WARC round trips, exact search and HTML rendering."""

import hashlib
import random

import pytest

from tests.llm.helpers import CLASH, clashing, prose, save
from turnmill.llm import html_text as H, topk as K, warc as W

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    rng = random.Random(1)
    big = prose(rng, 30000)
    long = "x" * 150
    bodies = [None, "", "short", "short", long, long, "é" * 60, "é" * 60, big, big, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 5, "0\r\n\r\n", "\r\n\r\n", "ü😀" * 20000, *[prose(rng, rng.randint(1, 4000)) for _ in range(30)]]
    rows = [(100 - i, f"http://h/{i}\r\nX: y" if i % 3 else None, b) for i, b in enumerate(bodies)]
    rows.append((None, "u", "short"))
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages(spark)
    df = spark.createDataFrame(rows, PAGES)
    save(clashing(df), tmp_path, "pages")
    got = {r.page_id: r for r in W.op4_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    assert len(got) == len(rows)
    for i, _, b in rows:
        x = (b or "").encode()
        r = got[i]
        again = len(x) >= 100 and i != first[b or ""]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", first[b or ""] if again else None), i


def test_ids_that_repeat(spark, tmp_path):
    """A revisit belongs to the response with its id and its digest; equal rows are responses of their own; ids may be any strings."""
    a, b = "A" * 200, "B" * 200
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a * 3), (4, a * 3), (5, a * 3)]
    save(spark.createDataFrame([(i, "u", t) for i, t in rows], PAGES), tmp_path, "pages")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in W.op4_warc(spark, str(tmp_path)).collect())
    want = [(1, sha(a), "response", None), (1, sha(b), "response", None), (2, sha(a), "revisit", 1), (3, sha(b), "revisit", 1), *[(4, sha(a * 3), "response", None)] * 2, (5, sha(a * 3), "revisit", 4)]
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(map(str, got)) == sorted(map(str, want))
    to = tmp_path / "named"
    to.mkdir()
    odd = [(" x\r\nWARC-Type: y ", a), ("%41", a), ("", b), ("é", b * 200), ("é ", b * 200)]
    save(spark.createDataFrame([(i, " h p\n", t) for i, t in odd], "page_id string, url string, html string"), to, "pages")
    got = {r.page_id: r for r in W.op4_warc(spark, str(to)).collect()}
    assert {i: r.payload_digest for i, r in got.items()} == {i: sha(t) for i, t in odd}
    assert {i: r.refers_to for i, r in got.items() if r.refers_to is not None} == {"%41": " x\r\nWARC-Type: y ", "é ": "é"}


def test_revisits_name_records(spark, tmp_path):
    rows = [(i, "u", prose(random.Random(i % 5), 50) * (1 + 20 * (i % 5))) for i in range(20)]
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame(rows, PAGES), path, segment=2000)
    import glob
    import re

    text = "".join(open(f, encoding="utf-8", newline="").read() for f in glob.glob(path + "/*.txt"))
    responses = {x for kind, x in re.findall(r"WARC-Type: (\w+)\r\nWARC-Record-ID: (\S+)", text) if kind == "response"}
    named = re.findall(r"WARC-Refers-To: (\S+)", text)
    assert len(named) == 15 and set(named) == responses and len(responses) == 5


def test_segments(spark, tmp_path):
    rows = pages(spark)
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame(rows, PAGES), path, segment=700, revisit_from=10**9, broadcast_rows=-1)
    records = W.read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 100
    back = {r.page_id: r for r in W.reassemble(records).collect()}
    assert all(back[None if i is None else str(i)].payload == (b or "").encode() for i, _, b in rows)
    # a segment that is missing, and one that is double
    cut = W.reassemble(records.where("coalesce(segment, 0) <> 2"))
    assert cut.where("NOT intact").count() > 5 and cut.where("NOT intact AND payload IS NOT NULL").count() == 0
    twice = W.reassemble(records.unionByName(records.where("segment = 2")))
    assert twice.where("NOT intact").count() == cut.where("NOT intact").count()


def test_framing():
    for n in (0, 1, 8191, 8192, 8193, 50000):
        x = bytes(range(256)) * (n // 256 + 1)
        assert W.unchunked(W.chunked(x[:n])) == x[:n]
    assert W.unchunked(b"5;a=b\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    for bad in (b"", b"5\r\nhel", b"zz\r\nhello\r\n0\r\n\r\n", b"5\r\nhelloxx0\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n"):
        assert W.unchunked(bad) is None


def test_no_pages(spark, tmp_path):
    save(spark.createDataFrame([], PAGES), tmp_path, "pages")
    assert W.op4_warc(spark, str(tmp_path)).count() == 0


def slow_search(rows, queries, k=5):
    import math

    vec = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in [x for x in vec if x[0] % queries == 0]:
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in vec if j != i)[:k]
        out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def test_search(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [round(rng.choice([0.0, 0.0, rng.uniform(-1, 1)]), 2) for _ in range(8)]) for i in range(180)]
    rows += [(200, None), (250, [float("nan")] * 8), (300, [None] * 8), (350, [float("inf")] * 8), (400, [0.5, 0.5]), (450, []), (500, [0.0] * 8), (None, [1.0] * 8), (7, rows[7][1]), (501, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int")
    save(clashing(df), tmp_path, "embeddings")
    import numpy as np

    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in K.op7_topk(spark, str(tmp_path)).collect()) == slow_search(single, 50)
    q = K.quantized(df)
    for a, b in ((1, 1), (3, 7)):
        got = K.top_k(q.where("vec_id % 20 = 0"), q, 9, query_block=a, candidate_block=b)
        assert sorted(tuple(r) for r in got.collect()) == slow_search(single, 20, 9)
    assert K.top_k(q.limit(0), q).count() == 0 and K.top_k(q.where("vec_id = 50"), q.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)], "vec_id bigint, embedding array<float>")  # all tie
    tied = K.top_k(K.quantized(same).where("vec_id IN (0, 2, 2999)"), K.quantized(same), 3, candidate_block=700).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in tied) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (2, 1, 0), (2, 2, 1), (2, 3, 3), (2999, 1, 0), (2999, 2, 1), (2999, 3, 2)]
    few = q.where("vec_id IN (0, 1, 2)")
    assert K.top_k(few.where("vec_id = 0"), few).count() == 2


def test_search_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.0])], "vec_id bigint, embedding array<double>")
    got = K.top_k(K.quantized(df).where("vec_id = 0"), K.quantized(df)).collect()
    assert [r.vec_id for r in got] == [1, 2] and got[0].score == (1 << 63) - 1


CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>n<th>long head<tr><td>aaa<td>b</table>", "n   | long head\naaa | b"),
    ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here | z\na | b          | c"),
    ("<head><title>t</title></head>x<script>if(a<b)</script>y<style>p{}</style><!-- c -->z", "xyz"),
    ("<div hidden>no</div><p style='color:red; display: none'>no</p><span style=\"visibility:hidden\">no</span>yes", "yes"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a &amp; b &lt;i&gt; &eacute; &#8364;", "a & b <i> é €"),
    ("1 < 2 and a<3", "1 < 2 and a<3"),
    ("<b>un<i>closed", "unclosed"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<details><summary>s</summary>body</details><details open><summary>o</summary>shown</details>", "s\no\nshown"),
    ("<a href='x>y'>link</a><img alt='no'>", "link"),
    ("  a \n\t b  <span> c</span>", "a b c"),
    ("<h1>T</h1><div>x</div><div>y</div>", "T\n\nx\ny"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a  | b\n   |\nin |"),
    ("text after <table>loose<tr><td>c</table>", "text after\n\nloose\nc"),
    ("<select><option>a<option>b</select><input type=hidden value=q><input type=submit value=Go>", "a\nb\nGo"),
    ("", ""), ("<", "<"), ("<!-- open", ""), ("<p", "<p"), ("</p>x", "x"), ("<td>loose cell", "loose cell"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_render(source, want):
    assert H.render(source) == want


@pytest.mark.parametrize("around", [1, 150, 3000])
def test_raw_text_at_any_depth(around):
    source = "<div>" * around + "a<textarea>b &lt; c</textarea><xmp>d <i></xmp><script>no</script>e" + "</div>" * around
    assert H.render(source) == "a\n\nb < c\n\nd <i>e"


@pytest.mark.parametrize("source, want", [
    ("<p>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds", "so x+1 holds"),
    ("a <math><mfrac><mi>p</mi><mi>q</mi></mfrac></math> b", "a p q b"),
    ("<math><semantics><mi>y</mi><annotation encoding='application/x-tex'>\\\\y</annotation></semantics><mphantom><mi>z</mi></mphantom></math>", "y"),
    ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text x='1'>North</text><text>South <tspan>pole</tspan></text></svg>", "North South pole"),
    ("<svg><metadata>m</metadata><text display='none'>n</text><style>s</style><g><text>shown</text></g></svg> after", "shown after"),
    ("<svg><defs/><path d='M0 0'/><title/><text>label</text></svg><p>next", "label\n\nnext"),
    ("<svg><foreignObject><p>one<p>two</foreignObject></svg>", "one\n\ntwo"),
    ("<svg><defs><p>left the drawing</p>", "left the drawing"),
    ("<svg/>x <desc>y</desc>", "x y"),
    ("<svg hidden><text>no</text></svg>yes", "yes"),
])
def test_render_formulas_and_drawings(source, want):
    assert H.render(source) == want


@pytest.mark.parametrize("source, want", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>x<td rowspan=0>all<td>y<tr><td>longer<td>z</table>", "x      | all | y\nlonger |     | z"),
    ("<table><tbody><tr><td rowspan=5>a<td>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
    ("<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d</table>", "ab | c\n   | d"),
    ("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
    ("<table><tr><td>" + "w " * 60 + "<td>x<tr><td>y<td>z</table>", " ".join("w" * 60) + " | x\n" + "y".ljust(119) + " | z"),
    ("<table><tr style='display:none'><td>no<tr><td colspan=900>a<tr><td>b<td>c</table>", "a\nb | c"),
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no</div>!", "yes\n!"),
    ("<p style='display:none;display:block'>shown<p style='display:block;display:none !important'>no", "shown"),
    ("<ol><li style='visibility:hidden'>no<li>two<li hidden>no<li>three</ol>", "2. two\n3. three"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", " | yes"),
    ("<pre style='visibility:hidden'>no<b style='visibility:visible'>yes</b></pre>", "yes"),
    ("<svg visibility='hidden'><text>no</text><text visibility='visible'>yes</text></svg>", "yes"),
    ("<div>" * 149 + "<div style='display:none'>no</div>" + "</div>" * 149 + "yes", "yes"),
    ("<div hidden>" + "<div>" * 348 + "no" + "</div>" * 348 + "no</div>yes", "yes"),
])
def test_render_tables_and_visibility(source, want):
    assert H.render(source) == want


def test_render_visibility_against_brute_force():
    """Random nests of elements whose visibility is known as they are made."""
    rng = random.Random(9)

    def made(depth, seen):
        """(source, visible words)."""
        kind, mark = rng.choice([("", seen), ("", seen), (" hidden", None), (" style='display:none'", None), (" style='visibility:hidden'", False), (" style='visibility:visible'", True)])
        tag, word = rng.choice(["div", "span", "b", "section"]), f"w{rng.randrange(10**6)}"
        inner = [made(depth - 1, mark) for _ in range(rng.randint(0, 3))] if depth and mark is not None else [("never", [])] * (mark is None)
        return f"<{tag}{kind}> {word} {' '.join(x for x, _ in inner)} </{tag}>", [word] * bool(mark) + [w for _, ws in inner for w in ws]

    for _ in range(300):
        source, words = made(6, True)
        assert H.render(source).split() == words


def test_render_tables_against_brute_force():
    """Random tables without long cells, against a grid filled cell by cell."""
    rng = random.Random(10)
    for _ in range(200):
        grid, source, n_rows = {}, "", rng.randint(1, 6)
        for r in range(n_rows):
            source += "<tr>"
            for _ in range(rng.randint(1, 5)):
                c = next(k for k in range(99) if (r, k) not in grid)
                deep, word = rng.randint(1, 3), "x" * rng.randint(1, 9)
                grid |= {(r + d, c): word if d == 0 else "" for d in range(min(deep, n_rows - r))}
                source += f"<td rowspan={deep}>{word}"
        widths = [max(len(w) for (_, k), w in grid.items() if k == c) for c in range(1 + max(k for _, k in grid))]
        want = []
        for r in range(n_rows):
            cells = [k for (q, k), w in grid.items() if q == r and w]
            want.append(" | ".join(grid.get((r, c), "").ljust(widths[c]) for c in range(1 + max(cells))).rstrip())
        assert H.render(f"<table>{source}</table>").split("\n") == want


def test_render_bounds():
    """Long tables with a long cell, deep nests and indents stay linear."""
    import time

    began = time.time()
    out = H.render("<table><tr><td>" + "y" * 200_000 + "<td>b" + "<tr><td>a<td>b" * 20_000 + "</table>")
    assert out.count("b") == 20_001 and len(out) < 30_000_000
    assert H.render("<blockquote>x" * 20_000).count("x") == 20_000
    assert H.render("<table><tr><td>" * 2000 + "x").strip() == "x"
    assert H.render("<p><li>" * 20_000 + "<span>" * 50_000 + "<li>x").endswith("x")
    assert time.time() - began < 60


def test_render_deep_and_odd():
    assert H.render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert H.render("<ul><li>" * 400 + "x").endswith("x")
    assert H.render("<a <a <a " * 3000 + "'") .startswith("<a")
    assert H.render("<table><tr>" + "<td>a" * 3000 + "</table>").count("a") == 3000
    assert H.render(None) is None


def test_render_query_keeps_all_text(spark, tmp_path):
    """Against the text nodes that the standard parser finds: the same visible characters in the same order."""
    from html.parser import HTMLParser

    class Nodes(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    rng = random.Random(4)
    made = []
    for i in range(60):
        body = "".join(rng.choice(["<p>{}", "<div>{}</div>", "{}<br>", "<b>{}</b>", "&amp;{}", "<h2>{}</h2>", "<span>{}"]).format(prose(rng, 3)) for _ in range(rng.randint(0, 30)))
        made.append((i, "u", f"<html><head><title>t{i}</title><script>var x = '<p>';</script></head><body>{body}</body></html>"))
    df = spark.createDataFrame([*made, (70, "u", None), (71, "u", "")], PAGES)
    save(df.withColumns({c: df.url for c in CLASH}), tmp_path, "pages")
    got = {r.page_id: r for r in H.op10_html_text(spark, str(tmp_path)).collect()}
    for i, _, x in made:
        n = Nodes()
        n.feed(x)
        n.close()
        assert "".join(got[i].text.split()) == "".join("".join(n.out).split())
    assert (got[70].text, got[70].n_chars, got[71].text) == (None, None, "")
