"""HTML extraction by layout: a tree with implied tags, visibility rules, and a rendering of all visible text.

The parser opens and closes elements that HTML lets authors leave out (p, li, dt, dd, option, tr, td, tbody and so on) and never
fails: what is no tag is text. Nothing is judged boilerplate; all that a browser would show as text is emitted, in order.

Hidden: head, script, style, template, noscript, iframe, object, audio, video, canvas, datalist and the like; of svg, titles, descriptions and
what is only defined (defs, symbol, mask and so on); of math, annotations and phantoms; `hidden` attributes; inline styles display:none;
hidden inputs; closed details but for their summary; closed dialogs; comments. visibility:hidden is inherited, and what is visible inside it is shown.

Layout: blocks start on lines of their own, paragraphs and headings with a blank line around them; list items carry a bullet or number
and are indented by level (to `INDENT` characters at most); pre keeps its blanks; the cells of a table are padded to columns, colspan and rowspan
counted, head rows first and foot rows last. Padding is bounded by `PADDING` and 16 times the table's own text: where a few very long cells in a
long table would go beyond, columns stay narrower than these cells, and what follows such a cell in its row isn't aligned (no text is lost).

Defined results: null html gives null text; empty html gives ""; elements may be nested to any depth, pages may have any length (neither parser nor
rendering recurses); repeated rows keep one row each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.common import arrow_map, chunks, table

INDENT = 128
PADDING = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas datalist".split())
#: Hidden inside svg, and inside math.
HIDDEN_SVG = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
HIDDEN_MATH = frozenset("annotation annotation-xml mphantom".split())
#: Within these svg and math hold HTML again; the start tags that leave svg and math anywhere else.
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li main menu nav optgroup option section summary tbody tfoot thead tr td th caption".split())
#: Start tags that close an open p.
ENDS_P = BLOCK - frozenset("body html option optgroup td th tr tbody thead tfoot caption legend dd dt li".split()) | frozenset(("li", "dd", "dt"))
#: What a start tag closes, and the elements that it doesn't look beyond.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
}
IN_HEAD = frozenset("head title meta link script style base noscript template html".split())

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_attr = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_blank = re.compile(r"[ \t\n\r\f]+")
_self_closing = re.compile(r"(?<!=)(?:^|[\"'\s]|\s[^\s=\"']+)/\s*\Z")


class Node:
    __slots__ = ("tag", "attrs", "kids", "gone", "apart", "seen")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.apart = False  # in svg and math: set off by blanks
        self.gone = tag in HIDDEN  # with all that is inside
        self.seen: bool | None = None  # whether its own text is visible; None: as its parent's
        if attrs:
            low = attrs.lower()
            if "hidden" in low:
                self.gone = self.gone or self.get("hidden") is not None or tag == "input" and (self.get("type") or "").lower() == "hidden"
            if "style" in low and (style := self.get("style")):
                self.styled(style)

    def styled(self, style: str) -> None:
        """Inline style: of several declarations the last holds."""
        found = {}
        for x in style.lower().split(";"):
            k, _, v = x.partition(":")
            found[k.strip()] = v.replace("!important", "").strip()
        self.gone = self.gone or found.get("display") == "none"
        self.shown(found.get("visibility"))

    def shown(self, visibility: str | None) -> None:
        if visibility in ("hidden", "collapse"):
            self.seen = False
        elif visibility == "visible":
            self.seen = True

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for k, v in _attr.findall(self.attrs):
            if k.lower() == name:
                return html.unescape(v.strip("\"'"))
        return None


def tree(text: str) -> Node:
    """The document's tree; texts are str children with their entities decoded."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of each tag's open elements, in the stack
    at, last = 0, text.rfind(">")

    def open_(x: Node) -> None:
        places.setdefault(x.tag, []).append(len(stack))
        stack.append(x)

    def close_to(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def nearest(names: frozenset | tuple) -> int:
        """The place of the innermost open element of these names; 0 without any."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def put(x: str) -> None:
        if x:
            if stack[-1].tag == "head" and not x.isspace():
                close_to(len(stack) - 1)
            stack[-1].kids.append(html.unescape(x) if "&" in x else x)

    def close(names: frozenset, stop: frozenset) -> None:
        """Close the outermost open element of these names that lies within the nearest of `stop`."""
        if any(places.get(n) for n in names):
            from_ = nearest(stop)
            found = [p[k] for n in names if (p := places.get(n)) and (k := bisect_right(p, from_)) < len(p)]
            if found:
                close_to(min(found))

    def foreign() -> int:
        """The place of the svg or math whose rules hold here; 0 in HTML."""
        k = nearest(("svg", "math"))
        return k if k and k > nearest(HTML_AGAIN) else 0

    def within(x: Node, root: str) -> None:
        if root == "svg":
            x.gone = x.gone or x.tag in HIDDEN_SVG or (x.get("display") or "").strip().lower() == "none"
            if x.seen is None:
                x.shown((x.get("visibility") or "").strip().lower())
            x.apart = x.tag == "text"
        else:
            x.gone = x.gone or x.tag in HIDDEN_MATH
            x.apart = x.tag in ("mtr", "mtd") or stack[-1].tag == "mfrac"

    def start(name: str, attrs: str) -> Node:
        """Make an element, and open it if it can hold others."""
        if name == "html":
            return root
        if (k := foreign()) and name in LEAVES:
            close_to(k)
            k = 0
        if k:
            x = Node(name, attrs)
            within(x, stack[k].tag)
            stack[-1].kids.append(x)
            if not _self_closing.search(attrs):
                open_(x)
            return x
        if stack[-1].tag == "head" and name not in IN_HEAD:
            close_to(len(stack) - 1)
        if name in ENDS_P and places.get("p"):
            close(frozenset(("p",)), frozenset(("td", "th", "table", "button", "caption")))
        if name in CLOSES:
            close(*CLOSES[name])
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            start("tr", "")
        if name == "tr" and stack[-1].tag == "table":
            start("tbody", "")
        x = Node(name, attrs)
        if name == "svg":
            within(x, name)
        stack[-1].kids.append(x)
        if name not in VOID and not (name in ("svg", "math") and _self_closing.search(attrs)):
            open_(x)
        return x

    while at <= last:
        k = text.find("<", at)
        if k < 0 or k > last:
            break
        m = _tag.match(text, k)
        if not m:
            put(text[at : k + 1])
            at = k + 1
            continue
        put(text[at:k])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                start("br", "")
            elif places.get(name):
                k = places[name][-1]
                if name != "body" and (name == "table" or k > nearest(("table",))):
                    close_to(k)
            elif name == "p":
                start("p", "")
                close_to(len(stack) - 1)
        elif name := (m[2] or m[4] or "").lower():
            attrs = m[3] if m[2] else m[5]
            inside = foreign()
            made = start(name, attrs or "")
            if name in RAW and not (inside and _self_closing.search(attrs or "")):
                end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(text, at)
                inner = text[at : end.start() if end else len(text)]
                if inner and name not in HIDDEN:
                    made.kids.append(html.unescape(inner) if name == "textarea" else inner)
                if stack[-1] is made:
                    close_to(len(stack) - 1)
                at = end.end() if end else len(text)
    put(text[at:].partition("<!--")[0])  # an open comment hides what follows
    return root


class Page:
    """Lines of a rendering. Blanks collapse across inline elements; blocks break lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a blank waits for the next word
        self.indent = ""
        self.first = ""  # a bullet for the next line, in place of the indent

    def words(self, x: str) -> None:
        if not x:
            return
        parts = _blank.sub(" ", x)
        if parts[0] == " ":
            self.space = True
            parts = parts[1:]
        if not parts:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = parts[-1] == " "
        self.now.append(parts[:-1] if self.space else parts)

    def line(self) -> None:
        """End the line, if there is one."""
        if self.now:
            self.lines.append((self.first or self.indent) + "".join(self.now))
            self.now, self.first = [], ""
        self.space = False

    def gap(self) -> None:
        self.line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def raw(self, text: str) -> None:
        self.line()
        for x in text.split("\n"):
            self.lines.append((self.first or self.indent) + x.rstrip("\r"))
            self.first = ""

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def _plain(x: Node, seen: bool) -> str:
    """The visible text below an element as it is."""
    out, todo = [], [(x, seen)]
    while todo:
        k, seen = todo.pop()
        if isinstance(k, str):
            out.append(k if seen else "")
        elif k is not x and k.tag == "br":
            out.append("\n")
        elif k is x or not k.gone:
            seen = seen if k.seen is None else k.seen
            todo += [(c, seen) for c in reversed(k.kids)]
    return "".join(out)


def show(x: Node, page: Page, level: int = 0, seen: bool = True) -> Iterator[Iterator]:
    """Render an element's children and its own breaks. seen: whether text is visible here. A generator of the parts to render in between (see drive)."""
    tag = x.tag
    if x.gone or tag == "dialog" and x.get("open") is None:
        return
    seen = seen if x.seen is None else x.seen
    if tag == "br":
        if page.now:
            page.line()
        elif page.lines and page.lines[-1]:
            page.lines.append("")
        return
    if tag == "hr":
        page.gap()
        return
    if tag == "input":
        if seen and (x.get("type") or "").lower() in ("submit", "button", "reset"):
            page.words(x.get("value") or "")
        return
    if tag == "table":
        page.gap()
        yield grid(x, page, level, seen)
        page.gap()
        return
    if tag == "pre" or tag == "textarea":
        page.gap()
        if body := _plain(x, seen).strip("\n"):
            page.raw(body)
        page.gap()
        return
    if x.apart:
        page.space = True
    nested = tag in ("ul", "ol") and level > 0
    apart = page.gap if tag in PARAGRAPH and not nested else page.line if tag in BLOCK else None
    if apart:
        apart()
    kids = x.kids
    if tag == "details" and x.get("open") is None:
        kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"]
    if tag in ("ul", "ol", "menu", "dir"):
        n = x.get("start") if tag == "ol" else None
        n = int(n) if n and n.lstrip("-").isdigit() and len(n) < 9 else 1
        for k in kids:
            if isinstance(k, str):
                if seen:
                    page.words(k)
            elif k.tag == "li" and not k.gone:
                page.line()
                before = page.indent
                if (seen if k.seen is None else k.seen) and len(before) < INDENT:
                    mark = f"{n}. " if tag == "ol" else "- "
                    page.first, page.indent = before + mark, before + " " * len(mark)
                elif seen if k.seen is None else k.seen:
                    page.first = before + (f"{n}. " if tag == "ol" else "- ")
                yield show(k, page, level + 1, seen)
                page.line()
                page.first, page.indent = "", before
                n += 1
            else:
                yield show(k, page, level + 1, seen)
    else:
        before = page.indent
        if tag in ("blockquote", "dd") and len(before) < INDENT:
            page.indent = before + "  "
        for k in kids:
            if not isinstance(k, str):
                yield show(k, page, level, seen)
            elif seen:
                page.words(k)
        if apart:
            page.line()
        page.indent = before
    if x.apart:
        page.space = True
    if apart:
        apart()


def drive(part: Iterator[Iterator]) -> None:
    """Run a rendering: what a part yields is run before it goes on."""
    running = [part]
    while running:
        inner = next(running[-1], None)
        if inner is None:
            running.pop()
        else:
            running.append(inner)


def _span(x: Node, name: str, least: int, most: int) -> int:
    n = x.get(name) or ""
    return min(most, max(least, int(n))) if n.isascii() and n.isdigit() and len(n) < 8 else 1


class Cell:
    __slots__ = ("at", "end", "lines", "longest")

    def __init__(self, at: int, end: int, lines: list[str]):
        self.at, self.end, self.lines, self.longest = at, end, lines, max(map(len, lines))


def widths_of(rows: list[list[Cell]]) -> list[int]:
    """The columns' widths: of a column's longest cell, and what cells over several columns need beyond these. Columns where no cell starts are left out of the cells' places."""
    starts = sorted({c.at for row in rows for c in row})
    for row in rows:
        for c in row:
            c.at, c.end = bisect_left(starts, c.at), bisect_left(starts, c.end)
    cells = sorted((c for row in rows for c in row), key=lambda c: c.end - c.at)
    size = sum(c.longest for c in cells)
    height = sum(max((len(c.lines) for c in row), default=0) for row in rows)
    cap = max((c.longest for c in cells), default=0)
    while True:
        widths = [0] * len(starts)
        for c in cells:
            have = sum(widths[c.at : c.end - 1]) + 3 * (c.end - c.at - 1)
            widths[c.end - 1] = max(widths[c.end - 1], min(cap, c.longest) - have)
        if cap < 40 or sum(widths) * height <= PADDING + 16 * size:
            return widths
        cap //= 2


def grid(x: Node, page: Page, level: int, seen: bool) -> Iterator[Iterator]:
    """A table: its caption, and rows of cells padded to columns."""
    groups: list[tuple[int, list[Node], bool]] = []  # (head, body or foot; rows; visible)
    loose: list[tuple[Node | str, bool]] = []
    for k in x.kids:
        if isinstance(k, str):
            if not k.isspace():
                loose.append((k, seen))
        elif k.gone:
            continue
        elif k.tag in ("tbody", "thead", "tfoot"):
            inside = seen if k.seen is None else k.seen
            trs = [c for c in k.kids if not isinstance(c, str) and c.tag == "tr" and not c.gone]
            loose += [(c, inside) for c in k.kids if not (c.isspace() if isinstance(c, str) else c.tag == "tr")]
            kind = ("thead", "tbody", "tfoot").index(k.tag)
            groups.append((1 if kind != 1 and any(g[0] == kind for g in groups) else kind, trs, inside))
        elif k.tag == "tr":
            groups.append((1, [k], seen))
        else:
            loose.append((k, seen))
    rows: list[list[Cell]] = []
    for _, trs, inside in sorted(groups, key=lambda g: g[0]):
        taken: dict[int, int] = {}  # columns that a cell above reaches into, and to which row
        for r, tr in enumerate(trs):
            visible = inside if tr.seen is None else tr.seen
            row, at = [], 0
            for c in tr.kids:
                if isinstance(c, str):
                    if not c.isspace():
                        loose.append((c, visible))
                elif c.tag not in ("td", "th"):
                    loose.append((c, visible))
                elif not c.gone:
                    cell = Page()
                    yield show(c, cell, 0, visible)
                    span, deep = _span(c, "colspan", 1, 1000), _span(c, "rowspan", 0, 65534)
                    while taken.get(at, -1) >= r:
                        at += 1
                    row.append(Cell(at, at + span, cell.text().split("\n")))
                    if deep != 1:
                        taken.update(dict.fromkeys(range(at, at + span), r + deep - 1 if deep else len(trs)))
                    at += span
            rows.append(row)
    for k, visible in loose:  # captions, and what has no place in a table, go before it as in browsers
        if not isinstance(k, str):
            yield show(k, page, level, visible)
        elif visible:
            page.words(k)
    page.line()
    widths = widths_of(rows)
    shift = [0]
    for w in widths:
        shift.append(shift[-1] + w + 3)
    for row in rows:
        for n in range(max((len(c.lines) for c in row), default=0)):
            out, end = [], 0
            for c in row:
                out += [" " * w for w in widths[end : c.at]]  # columns that cells above reach into
                out.append((c.lines[n] if n < len(c.lines) else "").ljust(shift[c.end] - shift[c.at] - 3))
                end = c.end
            page.now = [" | ".join(out).rstrip()]
            if page.now[0]:
                page.line()
            page.now = []


def render(text: str | None) -> str | None:
    if text is None:
        return None
    page = Page()
    drive(show(tree(text), page))
    return page.text()


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The `keep` columns and text."""
    rows = pages.select(*[pages[c] for c in keep], pages[html_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 22):
            found = pa.array([render(x) for x in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=b.schema.names)

    return arrow_map(rows, run, rows.schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"))
