"""Operator 8: layout-aware text of HTML pages.

A page is cut into tags and text, a tree is built with the tags that HTML lets authors leave out,
elements that are never shown or are hidden by attribute or inline style are left out, and the
visible rest is laid out: blocks stand on lines of their own with blank lines where browsers leave a
margin, list items carry their mark and depth, preformatted text keeps its white space, and the
cells of a table are padded to common column widths, also below a cell that spans rows. Formulas give
their symbols (the parts of fractions and scripts a space apart), images in SVG the labels they show;
`use` references are not followed.

A null page has the null text, an empty page the empty one. Broken markup never fails: unknown end
tags are ignored and open elements end with the page. Repeated rows and null ids pass through.
Nesting may be of any depth; nothing here recurses.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.llm.common import table

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER_SHOWN = frozenset(
    "head script style template noscript title meta link base iframe object embed audio video canvas "
    "datalist noembed noframes param rp area source track dialog".split()
)
# inside svg and math
FOREIGN_HIDDEN = frozenset(
    "desc defs metadata annotation annotation-xml mphantom symbol clippath mask pattern marker lineargradient "
    "radialgradient filter".split()
)
HTML_INSIDE = frozenset("foreignobject mi mo mn ms mtext".split())
LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
APART = frozenset("mfrac msup msub msubsup munder mover munderover mroot mmultiscripts mtable mtr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre "
    "search section summary table caption thead tbody tfoot tr td th ul xmp".split()
)
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir listing xmp fieldset".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt tr td th thead tbody tfoot caption legend option optgroup summary".split())
SCOPE = frozenset("table td th caption button html template object".split())
# an opening tag ends the open elements named here, up to the fence
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
_SPACES = re.compile(r"[ \t\r\n\f]+")


class Node:
    """`foreign` is "math", "svg", "text" for what lies in a text element of svg, and empty in HTML."""

    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: str = ""):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign


def _foreign(tag: str, parent: Node) -> str:
    if tag in ("svg", "math"):
        return tag
    if not parent.foreign or parent.tag in HTML_INSIDE:
        return ""
    return "text" if parent.foreign == "svg" and tag == "text" else parent.foreign


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def tree(page: str) -> Node:
    """The element tree; strings are text with entities resolved."""
    root = Node("html", {})
    stack = [root]
    position = 0

    def add_text(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text))

    def end(names: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        """Ends the open elements down to the outermost of `names` above the fence."""
        lowest = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                lowest = depth
            elif stack[depth].tag in fence:
                break
        if lowest:
            del stack[lowest:]

    while True:
        m = _TAG.search(page, position)
        if not m:
            add_text(page[position:])
            return root
        add_text(page[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                # a table's end tag ends anything open in it; other end tags do not leave a cell
                fence = frozenset() if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
                    if stack[depth].tag in fence:
                        break
            continue
        node = Node(tag, attributes_of(m[3]) if m[3].strip() else {})
        if tag in ("html", "body"):
            if tag == "body":
                end(*ENDS["body"])
            target = root if tag == "html" else next((n for n in stack if n.tag == "body"), None)
            if target is not None:
                for name, value in node.attributes.items():
                    target.attributes.setdefault(name, value)
                continue
        if tag in LEAVES_FOREIGN and stack[-1].tag not in HTML_INSIDE:
            while stack[-1].foreign and stack[-1].tag not in HTML_INSIDE:
                stack.pop()
        node.foreign = _foreign(tag, stack[-1])
        if tag in CLOSES_P:
            end({"p"}, SCOPE)
            if stack[-1].tag == "head":
                stack.pop()
        if tag in ENDS:
            end(*ENDS[tag])
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        stack[-1].children.append(node)
        if tag in VOID or node.foreign and m[3].rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)|$", re.I).search(page, position)
            raw = page[position : close.start()] if close else page[position:]
            if raw:
                node.children.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
            position = close.end() if close else len(page)
            continue
        stack.append(node)


def hidden(node: Node) -> bool:
    a = node.attributes
    return (
        node.tag in NEVER_SHOWN
        and not (node.tag == "dialog" and "open" in a)
        or "hidden" in a
        or node.tag == "input"
        or bool(node.foreign)
        and (node.tag in FOREIGN_HIDDEN or a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse"))
        or bool(a.get("style")) and bool(_HIDDEN_STYLE.search(a["style"]))
    )


def _columns(text: str) -> int:
    """Character cells: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction; `gap` is the number of blank lines owed before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now = ""
        self.gap = 0
        self.space = False
        self.lead = ""
        self.mark = ""

    def text(self, words: str) -> None:
        flat = _SPACES.sub(" ", words)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or bool(flat)
            return
        if self.now:
            if self.space or flat[0] == " ":
                self.now += " "
        else:
            self._open()
        self.now += body
        self.space = flat[-1] == " "

    def _open(self) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        self.now = self.lead + self.mark
        if self.mark:
            self.mark = ""

    def keep(self, words: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(words.replace("\r\n", "\n").split("\n")):
            if k:
                if not self.now:
                    self.lines.append("")
                self.end_line()
            if line:
                if not self.now:
                    self._open()
                self.now += line

    def end_line(self) -> None:
        if self.now:
            self.lines.append(self.now.rstrip(" "))
        self.now, self.space = "", False

    def block(self, margin: bool) -> None:
        self.end_line()
        if margin:
            self.gap = 1

    def put(self, lines: list[str]) -> None:
        for line in lines:
            self._open()
            self.now += line
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of cells; a cell that spans rows keeps its columns in the rows below."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.below: dict[int, int] = {}
        self.taken: set[int] = set()

    def row(self) -> None:
        self.taken = set(self.below)
        self.below = {column: n - 1 for column, n in self.below.items() if n > 1}
        self.rows.append([])

    def cell(self, text: str, across: int, down: int) -> None:
        row = self.rows[-1]
        while len(row) in self.taken:
            row.append("")
        if down > 1:
            self.below |= dict.fromkeys(range(len(row), len(row) + across), down - 1)
        row += [text] + [""] * (across - 1)

    def group(self) -> None:
        """No span leaves its row group."""
        self.below = {}


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1")
    return min(int(value), most) if value.isdecimal() else 1


def render(root: Node) -> str:
    """Text of the visible tree. Work items on a stack stand for the steps still to be done."""
    page = Page()
    pages = [page]
    tables: list[Table] = []
    captions: list[list[str]] = []
    work: list[tuple] = [("node", root, False, 0)]
    counters: list[list] = []
    while work:
        step = work.pop()
        kind = step[0]
        page = pages[-1]
        if kind == "text":
            (page.keep if step[2] else page.text)(step[1])
        elif kind == "node":
            _open_node(step[1], step[2], step[3], work, pages, tables, captions, counters)
        elif kind == "close":
            step[1](page)
        elif kind == "cell":
            pages.pop()
            tables[-1].cell("\n".join(page.done()), step[1], step[2])
        elif kind == "caption":
            pages.pop()
            captions[-1] += page.done()
        elif kind == "table":
            rows, heads = tables.pop().rows, captions.pop()
            page.block(True)
            page.put(heads + aligned(rows))
            page.block(True)
    return "\n".join(pages[0].done())


def _open_node(node, kept, depth, work, pages, tables, captions, counters) -> None:
    if hidden(node):
        return
    page, tag = pages[-1], node.tag
    closing: list[tuple] = []
    if tag == "br":
        if page.now:
            page.end_line()
        elif page.lines:
            page.gap = max(page.gap, 1)
        return
    if tag == "hr":
        page.block(True)
        return
    if tag == "img":
        if node.attributes.get("alt", "").strip():
            page.text(node.attributes["alt"])
        return
    if tag == "textarea" or tag in ("pre", "listing", "xmp", "plaintext"):
        kept = True
    if tag == "table":
        tables.append(Table())
        captions.append([])
        closing.append(("table",))
    elif tag == "caption" and tables:
        pages.append(Page())
        closing.append(("caption",))
    elif tag == "tr" and tables:
        tables[-1].row()
    elif tag in ("thead", "tbody", "tfoot") and tables:
        tables[-1].group()
        closing.append(("close", lambda p, table=tables[-1]: table.group()))
    elif tag in ("td", "th") and tables:
        if not tables[-1].rows:
            tables[-1].row()
        pages.append(Page())
        # no rows means all rows of the group
        closing.append(("cell", _span(node, "colspan", 1000) or 1, _span(node, "rowspan", 65534) or 65534))
    elif node.foreign == "math" and tag == "math" and node.attributes.get("display") == "block":
        page.block(False)
        closing.append(("close", lambda p: p.block(False)))
    elif node.foreign == "text" and tag == "text":
        page.text(" ")
        closing.append(("close", lambda p: p.text(" ")))
    elif tag in BLOCK:
        margin = tag in MARGIN and not (tag in ("ul", "ol", "menu", "dir") and depth)
        page.block(margin)
        lead = page.lead
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attributes.get("start", "1")
            first = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            counters.append([tag == "ol", first])
            depth += 1
        elif tag == "li":
            ordered = bool(counters) and counters[-1][0]
            mark = f"{counters[-1][1]}. " if ordered else "- "
            if ordered:
                counters[-1][1] += 1
            page.mark, outer = mark, page.lead

            def indent(p, width=len(mark), outer=outer):
                p.lead = outer + " " * width

            # the first line carries the mark, further ones are indented under it
            work_first = ("close", indent)
            closing.append(("close", lambda p, outer=outer: (p.block(False), setattr(p, "lead", outer), setattr(p, "mark", ""))))
            _push(node, kept, depth, work, closing, work_first)
            return
        elif tag == "blockquote":
            page.lead = lead + "> "
        elif tag == "dd":
            page.lead = lead + "  "

        def close(p, margin=margin, lead=lead, tag=tag):
            p.block(margin)
            p.lead = lead
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()

        closing.append(("close", close))
    _push(node, kept, depth, work, closing, None)


def _push(node, kept, depth, work, closing, after_first) -> None:
    work.extend(reversed(closing))
    steps = [("text", c, kept) if isinstance(c, str) else ("node", c, kept, depth) for c in node.children]
    if node.foreign == "svg" and node.tag not in HTML_INSIDE:
        # of an image only labels are text
        steps = [s for s in steps if s[0] == "node"]
    elif node.foreign == "math" and node.tag in APART:
        steps = [x for s in steps for x in (s, ("text", " ", False))][:-1]
    elif node.foreign == "math" and node.tag not in HTML_INSIDE:
        steps = [s for s in steps if s[0] == "node" or s[1].strip()]
    if after_first is not None:
        # the mark is used up by the first text, so the indent may be set behind it
        at = next((i for i, s in enumerate(steps) if s[0] == "node" or s[1].strip()), len(steps))
        steps.insert(min(at + 1, len(steps)), after_first)
    work.extend(reversed(steps))


def aligned(rows: list[list[str]]) -> list[str]:
    """Rows of cells as lines; columns are as wide as their widest cell."""
    rows = [[cell.split("\n") for cell in row] for row in rows if any(cell.strip() for cell in row)]
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for k, cell in enumerate(row):
            widths[k] = max([widths[k], *map(_columns, cell)])
    lines = []
    for row in rows:
        for k in range(max(len(cell) for cell in row)):
            parts = [cell[k] if k < len(cell) else "" for cell in row]
            padded = [p + " " * (w - _columns(p)) for p, w in zip(parts, widths)]
            lines.append(" | ".join(padded).rstrip(" "))
    return lines


def visible_text(page: str | None) -> str | None:
    return None if page is None else render(tree(page))


def extracted(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """All columns of `pages` but the markup, and the visible text."""
    kept = [c for c in pages.columns if c not in (column, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = pa.array([visible_text(p) for p in part.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], texts], [*kept, name])

    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(name, T.StringType())])
    return pages.mapInArrow(run, schema)


def op8_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_layout_text": op8_layout_text}
SQL: dict[str, str] = {}
