"""HTML to text by a tree and a layout-aware rendering (operator 9).

``parse`` builds a tree with the implied tags of HTML (a block ends an open ``p``, text or a tag of the body an open
head, an item the item before it, a cell without a row gets one, unclosed elements end with their parent). ``render`` walks it and emits all visible
text: blocks start on their own line, paragraphs and headings stand between blank lines, list items get a dash or
their number and an indent, ``pre`` keeps its line ends, and table cells stand in aligned columns.

Invisible: the head, scripts, styles, templates and the like, elements with ``hidden``, ``display:none`` or
``visibility:hidden``, closed dialogs, comments. Null or empty pages give an empty text. Markup left
open at the end of the page is dropped, as browsers do. Text in ``svg`` and ``math`` is visible, but for descriptions,
definitions and annotations. After a closed head, ``noscript`` is hidden like the other fallbacks.

Neither function recurses, and time grows with the page's length, not with its depth: open elements are found by an index of
the stack, lines are indented by at most ``WIDEST`` columns, and tables nested more than ``TABLES`` deep are laid out as
plain blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
HIDDEN = frozenset("head script style template title noscript noframes noembed iframe datalist audio video canvas object colgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = HEADINGS | frozenset("p ul ol dl pre blockquote table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header html legend li main nav option search section summary tr caption menu".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("tr caption option legend body html".split())
#: Elements that an open tag of the first kind ends, and what it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: What may stand in the head; any other start tag ends it, and so does text that is not blank.
IN_HEAD = frozenset("title meta link base style script noscript noframes template".split())
SCOPE = frozenset("table td th caption button object template".split())

#: Hidden inside ``svg`` and ``math``.
UNDRAWN = {"svg": frozenset("desc defs metadata symbol clippath mask".split()), "math": frozenset("annotation annotation-xml".split())}

WIDEST = 120  # columns of indentation
TABLES = 24  # nested tables with aligned cells
PAD = 40  # the widest cell that others of its column are padded to
SPAN = 1000  # HTML's own limit of colspan

_MARK = re.compile(r"<(?=[a-zA-Z/!?])")
_LETTER = re.compile(r"[a-zA-Z]")
# Attributes as HTML's tokenizer takes them: a quote opens a value only directly after "=", elsewhere it is a character.
_NAME, _IS, _BARE = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+", r"[ \t\n\f\r]*+=[ \t\n\f\r]*+", r"[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_NAME}(?:{_IS}(?:\"[^\"]*+\"|'[^']*+'|{_BARE}|(?=>))|(?!{_IS})))*+)>")
_ATTR = re.compile(rf"({_NAME})(?:{_IS}(?:\"([^\"]*+)\"|'([^']*+)'|({_BARE})|(?=>|\Z)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", s, ""), ("open", tag, attributes) and ("close", tag, "") in order."""
    at, n = 0, len(html)
    while at < n:
        m = _MARK.search(html, at)
        start = m.start() if m else n
        if start > at:
            yield "text", html[at:start], ""
        if not m:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if html[start + 1] in "!?" or html[start + 1] == "/" and not _LETTER.match(html, start + 2):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, start)
        if not m:
            return  # no ">" ends the tag before the page does
        tag, at = m[2].lower(), m.end()
        yield ("close" if m[1] else "open"), tag, m[3]
        if not m[1] and tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            if tag == "textarea":
                yield "text", html[at:stop], ""
            at = stop


def parse(html: str) -> Node:
    """The tree of a page; implied tags are put in, attributes are unescaped, texts are plain strings."""
    root = Node("#root", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # of each open tag in the stack

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((at[-1] for t in tags if (at := places.get(t))), default=0)

    def close(names, scope) -> bool:
        """Ends the nearest open element of ``names`` that stands inside ``scope``."""
        found = last(names)
        if not found or found < last(scope - names):
            return False
        cut(found)
        return True

    def put(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        return node

    def end_head() -> None:
        """Ends the open head, unless a template in it is open."""
        nonlocal head
        if stack[head + 1 : head + 2] and stack[head + 1].tag == "template":
            return
        cut(head)
        head = 0

    head = 0  # where an open head stands in the stack
    for kind, name, rest in tokens(html):
        if head and len(stack) <= head:
            head = 0
        if kind == "text":
            name = unescape(name) if "&" in name else name
            if head and name.strip(" \t\n\f\r"):
                end_head()
            if stack[-1].tag == "pre" and not stack[-1].children:  # the line end after the tag is no text
                name = name.removeprefix("\r").removeprefix("\n")
            stack[-1].children.append(name)
        elif kind == "open":
            if name in ("html", "body") and len(stack) > 1 and any(x.tag == name for x in stack[:3]):
                continue
            if head and name not in IN_HEAD:
                end_head()
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in ENDS:
                close(*ENDS[name])
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(put("tr", {}))
            attrs = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(rest)} if rest else {}
            for around, names in UNDRAWN.items():
                if name in names and places.get(around):
                    attrs["hidden"] = ""
            node = put(name, attrs)
            if name not in VOID and not rest.endswith("/") or name in BLOCKS:
                push(node) if name not in VOID else None
                if name == "head" and not head:
                    head = len(stack) - 1
        elif name == "br":
            put("br", {})
        elif name == "p" and not close({"p"}, SCOPE):
            put("p", {})
        elif name != "p":
            close({name}, SCOPE - {name} if name in SCOPE | BLOCKS | {"tbody", "thead", "tfoot"} else SCOPE | {"li", "p"} & BLOCKS)
    return root


class Lines:
    """Lines of text under construction; blocks and blank lines collapse as margins do."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is open
        self.space, self.blank = False, 0
        self.indent: list[int] = []
        self.width = 0  # sum of the indents
        self.mark = ""

    def text(self, s: str) -> None:
        words = _SPACE.split(s.replace("\xa0", " ") if "\xa0" in s else s)
        lead, trail = not words[0], not words[-1]
        words = [w for w in words if w]
        if not words:
            self.space |= lead or trail
            return
        if self.parts and (self.space or lead):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.space = trail

    def flush(self, keep: bool = False) -> None:
        """Ends the open line; ``keep``: also an empty one."""
        line = "".join(self.parts)
        if line or keep:
            if self.blank and self.lines:
                self.lines.extend([""] * self.blank)
            self.blank = 0
            margin = " " * min(self.width, WIDEST)
            if self.mark:
                margin = margin[: len(margin) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((margin + line).rstrip())
        self.parts, self.space = [], False

    def enter(self, indent: int) -> None:
        self.indent.append(indent)
        self.width += indent

    def leave(self) -> None:
        if self.indent:
            self.width -= self.indent.pop()

    def block(self, margin: int) -> None:
        self.flush()
        if not self.mark:
            self.blank = max(self.blank, margin)

    def result(self) -> str:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not ("style" in node.attrs and _UNSEEN.search(node.attrs["style"]))


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(int(value), SPAN) if value.isdecimal() and int(value or 0) else 1


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table's rows of (text, colspan, rowspan)."""
    grid, held = [], {}  # held: column -> rows that a cell above still covers
    for row in rows:
        line, col = [], 0
        for text, wide, high in row:
            while held.get(col, 0) > 0:
                held[col] -= 1
                line.append((col, ""))
                col += 1
            line.append((col, text))
            for c in range(col, col + wide):
                held[c] = high - 1
            col += wide
        for c in [c for c in held if c >= col and held[c] > 0]:
            held[c] -= 1
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for (col, text), after in zip(line, [*line[1:], None]):
            if after and after[0] == col + 1:
                width[col] = max(width.get(col, 0), *(len(x) if len(x) <= PAD else 0 for x in text.split("\n")))
    out = []
    for line in grid:
        cells = [text.split("\n") for _, text in line]
        for k in range(max(map(len, cells), default=0)):
            padded = [
                (c[k] if k < len(c) else "").ljust(sum(width.get(x, 0) for x in range(col, upto)) + 2 * (upto - col - 1))
                for c, (col, _), upto in zip(cells, line, [*(x[0] for x in line[1:]), line[-1][0]])
            ]
            out.append("  ".join(padded).rstrip())
    return [x for x in out if x]


def render(root: Node) -> str:
    """All visible text of a tree, laid out."""
    out, outer = Lines(), []  # outer: what a cell's lines interrupt
    tables: list[list[list[tuple[str, int, int]]] | None] = []  # None: laid out as blocks
    lists: list[list] = []
    pre = 0
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if pre:
                first, *more = node.split("\n")
                out.parts.append(first)
                for s in more:
                    out.flush(keep=True)
                    out.parts.append(s)
            else:
                out.text(node)
            continue
        tag = node.tag
        cell = tag in ("td", "th") and bool(tables) and tables[-1] is not None
        if tag in ("td", "th") and tables and tables[-1] is None:
            out.flush()
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                out.flush(keep=True)
                continue
            if tag == "wbr":
                continue
            if tag in BLOCKS:
                out.block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if start.lstrip("-").isdecimal() and len(start) < 10 else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.enter(len(mark))
                out.mark = mark
            elif tag in ("blockquote", "dd"):
                out.enter(2)
            elif tag == "table" and len(tables) >= TABLES:
                tables.append(None)
            elif tag == "table":
                outer.append((out, lists, pre))
                tables.append([])
                out, lists, pre = Lines(), [], 0
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif cell:
                outer.append((out, lists, pre))
                out, lists, pre = Lines(), [], 0
            todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
            continue
        if cell:
            text = out.result()
            out, lists, pre = outer.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((text, _span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "table" and tables[-1] is None:
            tables.pop()
        elif tag == "table":
            loose = out.result()  # captions and what stands outside the cells
            out, lists, pre = outer.pop()
            for line in [*(loose.split("\n") if loose else []), *_aligned(tables.pop())]:
                out.parts.append(line)
                out.flush()
        if tag == "pre":
            pre -= 1
        elif tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        if tag in BLOCKS:
            out.block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
        if tag == "li" and out.indent:
            out.leave()
            out.mark = ""
        elif tag in ("blockquote", "dd"):
            out.leave()
    return out.result()


def html_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text`` for each row of ``pages``: the visible text. No shuffle."""

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([html_text(h) for h in htmls], dtype=object)

    return pages.select(F.col(id_col), text(F.col(html_col)).alias("text"))
