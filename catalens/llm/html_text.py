"""Visible text of HTML pages by a small layout: a tree with implied tags, visibility rules, and block rendering.

Tokens (tags, text, comments) are cut in one pass; where a tag ends is looked up in a list of all quotes and ``>``
made once, so unfinished tags cost no second scan of the page. The tree builder opens and closes what HTML implies: a new
block ends an open paragraph, an item ends the item before it, rows and cells end each other, end tags close what
is open inside. Rendering walks the tree without recursion: hidden elements (script, style, head matter,
``hidden``, ``display:none``; ``aria-hidden`` is visible to the eye and stays) give nothing; ``visibility`` is
inherited node by node, so that a visible element in a hidden one shows; what SVG's ``use`` repeats is not followed;
blocks start on lines of their own, with an empty line around paragraphs, headings, lists and tables; list items
get ``- `` or their number and are indented; table cells are padded to the width of their column, however deep
tables nest, and cells over several columns or rows keep the columns of others free; a closed ``details`` shows its
summary; rules in style sheets are not evaluated; ``pre`` keeps its white space. All other white space collapses to single spaces. Of SVG the text
elements (and HTML in them) show, each set apart by spaces; of MathML the tokens without the white space between
them, parts of fractions, cells and rows set apart; of select the options, one a line.

All visible text is emitted; boilerplate is not judged. Null html gives an empty text. Broken markup never fails:
stray end tags are dropped, open elements end with the page, an unfinished tag is text. Rows are independent.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import text_rows

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template title noscript iframe object datalist audio video canvas".split())
#: never drawn in SVG and MathML
FOREIGN_UNSEEN = frozenset(
    "desc metadata defs symbol clippath mask pattern marker annotation annotation-xml mphantom".split()
)
RAW = frozenset("script style textarea title iframe noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption dd details dialog div dt fieldset figcaption footer form header hgroup hr "
    "html legend li main menu nav search section summary tbody tfoot thead tr".split()
)
ENDS_P = BLOCK - frozenset("html body caption tbody tfoot thead tr".split())
LISTS = frozenset("ul ol menu".split())
LINES = frozenset("option optgroup".split())  # start on lines of their own when rendered, end no paragraph
MATH_TOKENS = frozenset("mi mn mo ms mtext".split())
#: HTML in SVG and MathML: tags that end it, and elements in which they do not
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = MATH_TOKENS | {"foreignobject", "desc", "title", "annotation-xml"}
APART = frozenset("td th mtd mtr mfrac".split())
#: what a start tag ends, and the element at which the search for it stops
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
TAG_MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: The most columns and rows that a cell may span in HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    found = ((k.lower(), entities.unescape(v.strip("\"'"))) for k, v in ATTRIBUTE.findall(text))
    return dict(reversed([*found]))  # the first of equal names counts


class TagEnds:
    """For a place in a page, the ``>`` that ends the tag there: the first one outside quotes, or -1."""

    def __init__(self, page: str):
        self.marks = [m.start() for m in TAG_MARK.finditer(page)]
        count = len(self.marks)
        self.ends = [-1] * (count + 1)
        later = {'"': count, "'": count}  # number of the next quote of each kind
        for i in range(count - 1, -1, -1):
            mark = page[self.marks[i]]
            if mark == ">":
                self.ends[i] = self.marks[i]
            else:
                self.ends[i] = self.ends[min(later[mark] + 1, count)]
                later[mark] = i

    def after(self, at: int) -> int:
        return self.ends[bisect_left(self.marks, at)]


def tree(page: str) -> Node:
    """The page as nested nodes; text is strings."""
    root = Node("#root")
    path = [root]
    is_open: Counter[str] = Counter()  # so that nothing is searched for that is not there
    at, end, last, tag_ends = 0, len(page), page.rfind(">"), TagEnds(page)

    def text(upto: int) -> int:
        part = page[at:upto]
        path[-1].children.append(entities.unescape(part) if "&" in part else part)
        return upto

    def cut(i: int) -> None:
        is_open.subtract(x.tag for x in path[i:])
        del path[i:]

    def close(tags: set[str], stops: set[str]) -> None:
        i = len(path) - 1
        while i > 0 and any(is_open[x] for x in tags):
            if path[i].tag in tags:
                cut(i)
            elif path[i].tag in stops:
                return
            i -= 1

    while at < end:
        foreign = is_open["svg"] or is_open["math"]
        if foreign and page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            path[-1].children.append(page[at + 9 : stop if stop >= 0 else end])
            at = stop + 3 if stop >= 0 else end
            continue
        if page[at] != "<":
            start = page.find("<", at)
            at = text(start if start >= 0 else end)
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        token = NAME.match(page, at)
        if token is None:
            comment = page.startswith(("<!", "<?", "</"), at) and at + 2 < end
            stop = page.find(">", at) if comment and last >= at else -1
            at = stop + 1 if stop >= 0 else text(at + 1)
            continue
        stop = tag_ends.after(token.end())
        if stop < 0:
            at = text(at + 1)
            continue
        name, inside, at = token[2], page[token.end() : stop], stop + 1
        name = name.lower()
        if token[1]:
            if name == "p" and not is_open["p"]:
                path[-1].children.append(Node("p"))
            elif is_open[name]:
                barrier = {"td", "th", "table"} - {name} if name not in BLOCK else set()
                for i in range(len(path) - 1, 0, -1):
                    if path[i].tag == name:
                        cut(i)
                        break
                    if path[i].tag in barrier:
                        break
            continue
        if foreign and name in BREAKS_OUT:
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag in HOLDS_HTML:
                    break
                if path[i].tag in ("svg", "math"):
                    cut(i)
            foreign = is_open["svg"] or is_open["math"]
        if name in ENDS_P:
            close({"p"}, {"td", "th", "table", "button"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        node = Node(name, attributes_of(inside))
        path[-1].children.append(node)
        if foreign and inside.rstrip().endswith("/"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "textarea":
                node.children.append(entities.unescape(page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif name not in VOID and (name in BLOCK or not inside.rstrip().endswith("/")):  # a slash closes no block
            path.append(node)
            is_open[name] += 1
    return root


def gone(node: Node, place: str) -> bool:
    """Whether a node and all below it give nothing."""
    a = node.attributes
    if place and (node.tag in FOREIGN_UNSEEN or a.get("display", "").strip().lower() == "none"):
        return True
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return True
    return (node.tag == "dialog" and "open" not in a) or ("style" in a and bool(HIDING.search(a["style"])))


@dataclass(frozen=True)
class State:
    """What nodes inherit: kept white space, visibility, and the place.

    It is ``svg`` (where no text shows), ``svg text``, ``math``, ``math token`` or empty in HTML.
    """

    keep: bool = False
    shown: bool = True
    place: str = ""

    def below(self, node: Node) -> State:
        tag, place, shown = node.tag, self.place, self.shown
        if tag in ("svg", "math"):
            place = tag
        elif place == "svg" and tag == "text":
            place = "svg text"
        elif place and tag == "foreignobject":
            place = ""
        elif place == "math" and tag in MATH_TOKENS:
            place = "math token"
        value = node.attributes.get("visibility", "").strip().lower() if place else ""
        if "style" in node.attributes:
            found = VISIBILITY.findall(node.attributes["style"])
            value = found[-1].lower() if found else value
        if value in ("hidden", "collapse"):
            shown = False
        elif value in ("visible", "initial"):
            shown = True
        keep = self.keep or tag in ("pre", "textarea")
        return self if (keep, shown, place) == (self.keep, self.shown, self.place) else State(keep, shown, place)


class Lines:
    """Rendered lines; white space between words and between blocks is decided when the next text comes."""

    def __init__(self):
        self.done: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = 0
        self.prefix: list[str] = []
        self.marker: str | None = None

    def text(self, value: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(value.split("\n")):
                if i:
                    self.end_line()
                    self.gap = max(self.gap, 0)
                if line:
                    self.word(line)
            return
        parts = WHITE.split(value)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                self.word(part)

    def word(self, part: str) -> None:
        if not self.words and self.done and self.gap:
            self.done += [""] * self.gap
        if self.words and self.space:
            self.words.append(" ")
        self.gap, self.space = 0, False
        self.words.append(part)

    def end_line(self, forced: bool = False) -> None:
        if self.words or self.marker is not None:
            if self.marker is not None and not self.words and self.done and self.gap:
                self.done += [""] * self.gap
                self.gap = 0
            lead = "".join(self.prefix)
            if self.marker is not None:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.done.append((lead + "".join(self.words)).rstrip())
            self.words, self.marker = [], None
        elif forced:
            self.done.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        if self.words:
            self.end_line()
        if spaced and self.marker is None:
            self.gap = 1


def table_lines(node: Node, state: State):
    """Rows of a table with every column padded to its widest cell; asks for the texts of cells."""
    rows, captions, waiting = [], [], [(x, state, 0) for x in reversed(node.children)]
    groups = 0
    while waiting:
        x, state, group = waiting.pop()
        if isinstance(x, str):
            if x.strip():
                captions.append((x, state))
            continue
        if gone(x, state.place):
            continue
        below = state.below(x)
        if x.tag == "tr":
            row = []
            for c in x.children:
                if isinstance(c, str):
                    if c.strip():
                        row.append((((yield [c], below)).split("\n"), 1, 1))
                elif not gone(c, below.place):
                    lines = ((yield c.children, below.below(c))).split("\n")
                    row.append((lines, span(c, "colspan", MOST_COLUMNS) or 1, span(c, "rowspan", MOST_ROWS)))
            rows.append((group, row))
        elif x.tag in ("td", "th"):
            rows.append((group, [(((yield x.children, below)).split("\n"), 1, 1)]))
        elif x.tag in ("tbody", "thead", "tfoot"):
            groups += 1
            waiting += [(c, below, groups) for c in reversed(x.children)]
        else:
            captions.append((x, state))
    out = []
    for x, state in captions:
        out += [line for line in ((yield [x], state)).split("\n") if line]
    return out + aligned(placed(rows))


def span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1").strip()
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def placed(rows: list) -> list[list[tuple]]:
    """Cells ``(lines, first column, column after the last)`` per row; a cell of several rows keeps its columns.

    It does so up to the end of its row group, as it does with a row span of 0.
    """
    out, held, at_group = [], [], None
    for number, (group, row) in enumerate(rows):
        if group != at_group:
            held, at_group = [], group
        held = sorted(h for h in held if h[2] > number)
        cells, column, i = [], 0, 0
        for lines, across, down in row:
            while i < len(held) and held[i][0] <= column:
                column = max(column, held[i][1])
                i += 1
            cells.append((lines, column, column + across))
            if down != 1:
                held.append((column, column + across, number + down if down else len(rows)))
            column += across
        out.append(cells)
    return out


def aligned(rows: list[list[tuple]]) -> list[str]:
    """Every column padded to its widest cell; columns in which no cell starts take no room."""
    number = {c: i for i, c in enumerate(sorted({first for row in rows for _, first, _ in row}))}
    starts = [*number]
    widths = [0] * len(starts)
    wide = []
    for row in rows:
        for lines, first, after in row:
            i, j, width = number[first], bisect_left(starts, after), max(map(len, lines))
            if j - i == 1:
                widths[i] = max(widths[i], width)
            else:
                wide.append((j - i, i, j, width))
    for _, i, j, width in sorted(wide):
        widths[j - 1] += max(0, width - sum(widths[i:j]) - 2 * (j - i - 1))
    places = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            parts, length = [], 0
            for lines, first, _ in row:
                if k < len(lines) and lines[k]:
                    gap = places[number[first]] - length
                    parts += [" " * gap, lines[k]]
                    length += gap + len(lines[k])
            out.append("".join(parts).rstrip())
    return out


def rendering(nodes: list, state: State):
    """The text of nodes; a generator that yields ``(nodes, state)`` of what it needs the text of first."""
    out = Lines()
    waiting: list[tuple] = [("open", x, state) for x in reversed(nodes)]
    while waiting:
        step, node, state = waiting.pop()
        if step == "close":
            if node.tag in BLOCK or node.tag in LINES:
                out.block(node.tag in SPACED and not (node.tag in LISTS and out.prefix))
            else:
                out.space = True
            if node.tag == "li" or node.tag in ("blockquote", "dd"):
                if node.tag == "li" and out.marker is not None:
                    out.end_line()
                out.prefix.pop()
            continue
        if isinstance(node, str):
            if state.shown and state.place != "svg" and not (state.place == "math" and node.isspace()):
                out.text(node, state.keep)
            continue
        tag = node.tag
        if gone(node, state.place):
            continue
        apart = tag in APART or (tag == "text" and state.place == "svg")
        in_fraction = tag == "mfrac"
        state = state.below(node)
        if tag in ("br", "img", "input"):
            if not state.shown or state.place == "svg":
                continue
            if tag == "br":
                out.end_line(forced=not out.words)
            else:
                out.text(node.attributes.get("alt" if tag == "img" else "value", ""), False)
        elif tag == "hr":
            out.block(True)
        elif tag == "table":
            out.block(True)
            for line in (yield from table_lines(node, state)):
                if line:
                    out.word(line)
                    out.end_line()
            out.block(True)
        else:
            if tag in BLOCK or tag in LINES:
                nested = tag in LISTS and out.prefix
                out.block(tag in SPACED and not nested)
                if tag == "li":
                    mark = node.attributes.get("#mark", "- ")
                    out.prefix.append(" " * len(mark))
                    if state.shown:
                        out.marker = mark
                elif tag in ("blockquote", "dd"):
                    out.prefix.append("  ")
                waiting.append(("close", node, state))
            elif apart:
                out.space = True
                waiting.append(("close", node, state))
            if tag in LISTS:
                number_items(node)
            label = node.attributes.get("label", "") if tag in LINES else ""
            children = [label] if label and tag == "option" else node.children
            if label and tag == "optgroup":
                children = [Node("option", {}, [label]), *children]
            if tag == "details" and "open" not in node.attributes:
                children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
            if in_fraction:
                children = [y for x in children for y in (x, Node("mtd"))]
            waiting += [("open", child, state) for child in reversed(children)]
            if tag in ("td", "th"):
                out.space = True
    out.end_line()
    return "\n".join(out.done).strip("\n")


def render(root: Node) -> str:
    """The text of a tree; what waits for the texts of cells stands on a stack of its own, so any depth will do."""
    stack, text = [rendering([root], State())], None
    while stack:
        try:
            wanted = stack[-1].send(text)
        except StopIteration as done:
            stack.pop()
            text = done.value
        else:
            stack.append(rendering(*wanted))
            text = None
    return text


def number_items(node: Node) -> None:
    start = node.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            child.attributes["#mark"] = f"{number}. " if node.tag == "ol" else "- "
            number += 1


def visible_text(page: str) -> str:
    return render(tree(page))


def html_texts(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, text, n_lines`` of every page."""

    def work(pages):
        texts = [visible_text(x) for x in pages]
        return [(x, x.count("\n") + 1 if x else 0) for x in texts]

    return text_rows(df, key, html, work, "text string, n_lines bigint")
