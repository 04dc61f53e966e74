"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer of boxes.

Nothing visible is taken away (menus, footers and all): only what a browser would not show. Blocks are set apart,
lists get their markers and indents, and the cells of a table's columns are aligned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col

# Fixed values of the HTML standard, as far as they matter here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
INVISIBLE = set("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist dialog area param source track col colgroup title meta link base".split())
BLOCKS = set("html body address article aside blockquote center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp plaintext listing".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote dl ul ol menu dir figure pre table hr fieldset listing xmp".split())
#: Start tags that end an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt listing xmp".split())
#: Start tag: open elements that it closes by implication, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, {"html"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "button", "object", "template"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute, or what stands between two. An opening quote without its end leaves `=` to the caller.
_ATTRIBUTE = re.compile(r"[\s/]++|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?+")
_OPEN_QUOTE = re.compile(r"\s*+=\s*+[\"']")
_COMMENT_END = re.compile(r"--!?>")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Deeper elements than this are put next to each other instead of inside, as browsers do.
DEEPEST = 200
#: Padding of a line of a table: so many places, and so many times the places its own texts take. Cells that would need more
#: follow at two spaces. With it, a page's text stays in proportion to the page.
PADDING, PADDING_TIMES = 64, 4
#: Places of indent; what is nested deeper than that is not indented further.
MOST_INDENT = 40
#: Columns and rows that a cell spans at most.
MOST_SPAN = 1000


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _tag_at(source: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes of the tag whose name ends at `at`, and the place after its `>`; (None, end) where the source ends first.

    Every character is passed once: a quote that is never closed takes the rest of the source with it, as in browsers.
    """
    found: dict[str, str] | None = None
    n = len(source)
    while at < n:
        if source[at] == ">":
            return found or {}, at + 1
        m = _ATTRIBUTE.match(source, at)
        at = m.end()
        if m[1]:
            if m[2] is None and m[3] is None and m[4] is None and _OPEN_QUOTE.match(source, at):
                break
            found = found or {}
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return None, n


def _tokens(source: str) -> Iterator[tuple[str, str, dict[str, str], int]]:
    """(kind, name or text, attributes, place after it): text, start tags and end tags in order, in linear time.

    The consumer may send a place to go on from (after the raw text of a script, say). Comments and declarations are
    passed over; a `<` that opens none of these is text.
    """
    at, n, kept = 0, len(source), 0
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            break
        after = source[lt + 1 : lt + 2]
        m = _NAME.match(source, lt + 2 if after == "/" else lt + 1)
        if not m and after not in ("!", "?") and not (after == "/" and lt + 2 < n):
            at = lt + 1
            continue
        if lt > kept:
            yield "text", source[kept:lt], {}, lt
        if m:
            attributes, at = _tag_at(source, m.end())
            if attributes is None:
                return
            to = yield "end" if after == "/" else "start", m[0].lower(), attributes, at
            at = at if to is None else to
        elif source.startswith("<!--", lt):
            end = lt + 5 if source.startswith("<!-->", lt) else lt + 6 if source.startswith("<!--->", lt) else 0
            found = None if end else _COMMENT_END.search(source, lt + 4)
            at = end or (found.end() if found else n)
        else:
            end = source.find(">", lt)
            at = end + 1 if end >= 0 else n
        kept = at
    if kept < n:
        yield "text", source[kept:], {}, n


def parse(source: str) -> Node:
    """The tree of a page, with what authors may leave out put in."""
    root = Node("html")
    stack = [root]

    def pop_to(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    tokens, to = _tokens(source), None
    while True:
        try:
            kind, tag, attributes, at = tokens.send(to)
        except StopIteration:
            return root
        to = None
        if kind == "text":
            if stack[-1].tag == "head" and tag.strip():
                stack.pop()
            stack[-1].children.append(html.unescape(tag) if "&" in tag else tag)
            continue
        if kind == "end":
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                inside = SCOPE - {tag} if tag not in ("html", "body", "table", "tr", "tbody", "thead", "tfoot") else {"html"} - {tag}
                pop_to({tag}, inside)
            continue
        if tag == "html" or (tag == "body" and any(x.tag == "body" for x in stack)):
            stack[0 if tag == "html" else 1].attributes.update(attributes)
            continue
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            while any(x.tag in closed for x in stack[1:]):
                before = len(stack)
                pop_to(closed, stop)
                if len(stack) == before:
                    break
                if tag in ("li", "dt", "dd", "td", "th"):
                    break
        if tag in ENDS_P:
            pop_to({"p"}, SCOPE)
        if stack[-1].tag == "head" and tag not in INVISIBLE:
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _ends_of(tag).search(source, at)
            raw = source[at : end.start()] if end else source[at:]
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            to = source.find(">", end.end()) + 1 or len(source) if end else len(source)
        elif tag == "plaintext":
            node.children.append(source[at:])
            to = len(source)
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)


@lru_cache(maxsize=None)
def _ends_of(tag: str) -> re.Pattern:
    """The end tag of one of the RAW elements."""
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in INVISIBLE and not (node.tag == "dialog" and "open" in a):
        return False
    if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not ("style" in a and _HIDDEN.search(a["style"]))


def wide(text: str) -> int:
    """Columns that a text takes."""
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class _Sub:
    """Lines that are indented together: `first` stands before the first of them, `rest` before the others; before a blank one
    nothing, or the mark of a quotation."""

    __slots__ = ("first", "rest", "lines")

    def __init__(self, first: str, rest: str, lines: list):
        self.first, self.rest, self.lines = first, rest, lines


def _flat(lines: list) -> list[str]:
    """The lines with their indents, which are put together once for each line however deep it stands."""
    out: list[str] = []
    # of the boxes around a line: its indent, the one of the innermost quotation's blank lines, the marks not yet written
    todo, around, fresh = [iter(lines)], [("", "")], []
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            around.pop()
            if fresh:
                fresh.pop()
        elif isinstance(x, _Sub):
            before, blank = around[-1]
            indent = before + x.rest if len(before) < MOST_INDENT else before
            around.append((indent, indent.rstrip() if x.rest == "> " else blank))
            todo.append(iter(x.lines))
            fresh.append(x.first)
        elif fresh:
            at = len(around) - 1 - len(fresh)
            marks = "".join(fresh if x else fresh[: next((i + 1 for i in range(len(fresh) - 1, -1, -1) if fresh[i].strip()), 0)])
            out.append(around[at][0] + marks + x if x or marks else around[-1][1])
            fresh = []
        else:
            out.append(around[-1][0] + x if x else around[-1][1])
    return out


class _Flow:
    """Lines of one box: words are joined by single spaces, blocks begin lines, `gap` blank lines stand between."""

    def __init__(self) -> None:
        self.lines: list[str | _Sub] = []
        self.open: list[str] = []  # parts of the line that is being written
        self.space = False
        self.gap = 0

    def words(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not text:
            return
        if text[0] == " ":
            self.space = True
        body = text.strip(" ")
        if not body:
            return
        self._begin()
        if self.space and self.open:
            self.open.append(" ")
        self.open.append(body)
        self.space = text[-1] == " "

    def kept(self, text: str) -> None:
        """Preformatted text: its lines and spaces as they are."""
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self._begin()
            self.open.append(first)
        for x in rest:
            self.lines.append("".join(self.open))
            self.open = [x] if x else []

    def _begin(self) -> None:
        if self.gap and self.lines and not self.open:
            self.lines.extend([""] * self.gap)
        self.gap = 0

    def end_line(self, gap: int = 0) -> None:
        if self.open:
            self.lines.append("".join(self.open))
            self.open = []
        self.space = False
        self.gap = max(self.gap, gap) if self.lines else 0

    def put(self, lines: list, gap: int) -> None:
        self.end_line(gap)
        if lines:
            self._begin()
            self.lines.extend(lines)
        self.end_line(gap)

    def break_line(self) -> None:
        if self.open:
            self.end_line()
        else:
            self._begin()
            self.lines.append("")
        self.space = False


def _inside(node: Node, depth: int = 0, pre: bool = False) -> list[str | _Sub]:
    flow = _Flow()
    _render(node, flow, depth, pre)
    flow.end_line()
    while flow.lines and isinstance(flow.lines[-1], str) and not flow.lines[-1].strip():
        flow.lines.pop()
    return flow.lines


def _render(node: Node, flow: _Flow, depth: int, pre: bool) -> None:
    number = 0
    if node.tag == "ol":
        start = node.attributes.get("start", "1").strip()
        number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
    for child in node.children:
        if isinstance(child, str):
            if pre:
                flow.kept(child)
            else:
                flow.words(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        gap = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and depth) else 0
        if tag == "br":
            flow.break_line()
        elif tag == "hr":
            flow.put(["---"], 1)
        elif tag == "img":
            if child.attributes.get("alt", "").strip():
                flow.words(" " + child.attributes["alt"] + " ")
        elif tag == "input":
            if child.attributes.get("type", "text").lower() not in ("checkbox", "radio", "image", "password", "file", "color", "range"):
                flow.words(" " + (child.attributes.get("value") or child.attributes.get("placeholder", "")) + " ")
        elif tag == "wbr":
            continue
        elif tag == "table":
            flow.put(_table(child, depth), 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.put(_inside(child, depth + 1), gap)
        elif tag == "li":
            if node.tag == "ol":
                value = child.attributes.get("value", "").strip()
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number + 1
            mark = f"{number}. " if node.tag == "ol" else "- "
            flow.put([_Sub(mark, " " * len(mark), _inside(child, max(depth, 1)) or [""])], 0)
        elif tag == "dd":
            lines = _inside(child, depth)
            flow.put([_Sub("    ", "    ", lines)] if lines else [], 0)
        elif tag == "blockquote":
            lines = _inside(child, depth)
            flow.put([_Sub("> ", "> ", lines)] if lines else [], 1)
        elif tag in ("pre", "listing", "xmp", "plaintext", "textarea"):
            lines = _inside(child, depth, True)
            flow.put(lines[1:] if lines and not lines[0] else lines, 1)
        elif tag == "q":
            flow.words('"')
            _render(child, flow, depth, pre)
            flow.words('"')
        elif tag in BLOCKS:
            flow.end_line(gap)
            _render(child, flow, depth, pre)
            flow.end_line(gap)
        else:
            _render(child, flow, depth, pre)


def _span(cell: Node, name: str) -> int:
    v = cell.attributes.get(name, "1")
    return max(1, min(MOST_SPAN, int(v))) if v.isascii() and v.isdigit() and len(v) < 5 else 1


def _table(node: Node, depth: int) -> list[str]:
    """Captions, then rows whose cells begin where their columns do, as far as PADDING allows; a cell's lines stay in its column."""
    captions: list = []
    rows: list[Node] = []

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                if c.strip():
                    captions.append(_SPACE.sub(" ", c).strip())
            elif visible(c):
                if c.tag == "tr":
                    rows.append(c)
                elif c.tag in ("tbody", "thead", "tfoot"):
                    walk(c)
                else:
                    captions.extend(_inside(_holder(c), depth))

    walk(node)
    grid: list[list[tuple[int, list[str]]]] = []
    width: dict[int, int] = {}
    held: list[tuple[int, int, int]] = []  # columns that cells above span: begin, end, and the row where they end
    for r, row in enumerate(rows):
        cells, new, at, i = [], [], 0, 0
        for c in row.children:
            if isinstance(c, str) and not c.strip() or isinstance(c, Node) and not visible(c):
                continue
            while i < len(held) and held[i][0] <= at:
                at, i = max(at, held[i][1]), i + 1
            cell = c if isinstance(c, Node) and c.tag in ("td", "th") else _holder(c)
            lines = _flat(_inside(cell, depth))
            cells.append((at, lines))
            width[at] = max([width.get(at, 0), *map(wide, lines)])
            end, down = at + _span(cell, "colspan"), _span(cell, "rowspan")
            if down > 1 and new and new[-1][1:] == (at, r + down):
                new[-1] = (new[-1][0], end, r + down)
            elif down > 1:
                new.append((at, end, r + down))
            at = end
        if new or any(x[2] <= r + 1 for x in held):
            held = sorted([x for x in held if x[2] > r + 1] + new)
        grid.append(cells)
    begin, place = {}, 0
    for k in sorted(width):
        begin[k], place = place, place + width[k] + 2
    out = _flat(captions)
    for cells in grid:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            texts = [(begin[k], lines[i]) for k, lines in cells if i < len(lines) and lines[i]]
            left = PADDING + PADDING_TIMES * sum(wide(x) for _, x in texts)
            parts, at = [], 0
            for k, x in texts:
                pad = k - at if at else k
                least = 2 if parts else 0
                if pad < least or pad - least > left:
                    pad = least
                left -= pad - least
                parts += [" " * pad, x]
                at += pad + wide(x)
            out.append("".join(parts).rstrip())
    return out


def _holder(child: Node | str) -> Node:
    box = Node("div")
    box.children.append(child)
    return box


def text_of_node(node: Node) -> str:
    return "\n".join(x.rstrip() for x in _flat(_inside(node))).strip("\n")


def text_of(source: str | None) -> str:
    """All visible text of a page; of null or of nothing visible, an empty string."""
    if not source:
        return ""
    return text_of_node(parse(source))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row. Null pages have an empty text; null ids and repeated rows are kept as they are;
    other columns are not read; an empty table gives no rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(x) for x in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    rows = pages.select(col(pages, id_col).cast("long").alias("page_id"), F.coalesce(col(pages, html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string")
