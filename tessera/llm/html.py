"""Layout-aware text of web pages.

A tree builder reads the markup with the usual implied tags (a new paragraph, list item, row or cell ends the one
before it; a head ends where content of the body begins; an end tag closes what is open inside) and a renderer walks
the tree by visibility and layout: all text that a reader would see, blocks apart from each other as they stand on the
page, list items behind bullets or numbers and indented by depth, table cells in columns of equal width, preformatted
text as it is. Cells that span rows or columns keep their places free of others; columns without any text take no room.

The tree is walked without recursion and tables are laid out from the innermost to the outermost, so depth is no
limit, and each page is one row of one batch: nothing is gathered across pages.

Defined cases: null and empty pages give the empty text; unclosed, stray and unknown tags are tolerated; markup that
breaks off inside a tag ends there; drawings and formulas give their text, form fields their content and choices, and
objects, which are not loaded, what stands in for them; what ``visibility`` hides is left out, but for elements inside
that it shows again; entities without semicolon are read as browsers read them; repeated rows give equal texts; an
empty table gives an empty result; extra columns pass through ``extract`` untouched, but for one of the name that the
text gets, which the text replaces.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Fixed values of the HTML standard: elements without content, without visible text, and of block layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe audio video canvas datalist annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table ul caption tr td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
_CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "tr", "td", "th"} | {"hr"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Of a drawing, what holds text to see, and what is only defined and never drawn where it stands.
DRAWN = frozenset(("text", "foreignobject"))
DEFINED = frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient filter".split())
#: Start tags that end a drawing or formula, unless an element of the second kind lies between.
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_FOREIGN, _HOSTS = ("svg", "math"), ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
#: An open element of the kind ends at any other start tag than these, and at text that is not blank.
ONLY = {"head": frozenset("base basefont bgsound link meta title style script template noscript".split()), "colgroup": frozenset(("col", "template"))}
#: Fixed values of the HTML standard: most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SCOPE = frozenset("table td th caption html button".split())
#: End tags that reach out of a table cell.
_WALLED = frozenset("table td th tr tbody thead tfoot body html".split())
_RAW_ENDS = {tag: re.compile(f"</{tag}[\\s/>]|\\Z", re.I) for tag in RAW}

_S = r"[\x20\t\n\f\r]"
#: A quote opens a value only directly behind the equals sign of its attribute; anywhere else it is a character as any other.
_VALUE = rf"{_S}*+={_S}*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\x20\t\n\f\r>\"'][^\x20\t\n\f\r>]*+)?"
_NAME = r"[^\x20\t\n\f\r/>][^\x20\t\n\f\r/>=]*+"
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\x20\t\n\f\r/>]*+)((?:{_NAME}(?:{_VALUE})?+|[\x20\t\n\f\r/]++)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_S}*+={_S}*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\x20\t\n\f\r>\"'][^\x20\t\n\f\r>]*+))?)?+")
#: A property's name begins the style or stands behind a semicolon.
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_SAYS_VISIBILITY = re.compile("visibility", re.I)
#: Kinds of form fields, and those whose value is on the screen, as text or on a button.
KINDS = frozenset("hidden text search tel url email password date month week time datetime-local number range color checkbox radio file submit image reset button".split())
SHOWN = frozenset("text search tel url email number date time month week datetime-local submit reset button".split())
_BLANK = re.compile(r"[\x20\t\n\f\r]+")


class Node:
    """``unseen``: hidden by visibility, which its elements may revoke. ``lines``: the layout of a table, once it is known."""

    __slots__ = ("tag", "attrs", "children", "unseen", "lines")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.unseen, self.lines = tag, attrs, [], False, None

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)}

    def closed(self) -> bool:
        """Whether the tag ends with a slash that is not part of a value."""
        return self.attrs.endswith("/") and all(m.end() < len(self.attrs) for m in _ATTRIBUTE.finditer(self.attrs))


class Open:
    """The open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element among the tags, 0 if none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_above(self, tags, floor: int) -> int:
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, floor)) < len(p)]
        return min(found, default=0)

    def leave(self, tag: str = "") -> None:
        """Before a start tag or, with none, before text that is not blank."""
        if (now := self.nodes[-1].tag) in ONLY and tag not in ONLY[now]:
            self.cut(len(self.nodes) - 1)

    def imply(self, tag: str) -> None:
        self.leave(tag)
        if tag in _BREAKS and (p := self.foreign()):
            self.cut(p)
        if tag in _CLOSES_P and (p := self.last(("p",))) > self.last(_SCOPE):
            self.cut(p)
        if tag in IMPLIED:
            ends, within = IMPLIED[tag]
            if at := self.first_above(ends, self.last(within)):
                self.cut(at)

    def foreign(self) -> int:
        """The place of the drawing or formula whose own elements come next, 0 if none."""
        at = self.last(_FOREIGN)
        return at if at and at > self.last(_HOSTS) else 0

    def close(self, tag: str) -> None:
        at = self.last((tag,))
        wall = 0 if tag in _WALLED else self.last(("table", "td", "th"))
        if at and at >= wall:
            self.cut(at)
        elif tag == "p":  # an end tag without a start is an empty paragraph
            self.nodes[-1].children.append(Node("p"))


def tree(page: str) -> Node:
    root = Node("#root")
    stack, at = Open(root), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text = page[at:end]
            text = entities.unescape(text) if "&" in text else text
            if stack.nodes[-1].tag in ONLY and _BLANK.sub("", text):
                stack.leave()
            stack.nodes[-1].children.append(text)
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            stack.close(tag)
            continue
        stack.imply(tag)
        node = Node(tag, m[3] or "")
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            stop = _RAW_ENDS[tag].search(page, at)
            text = page[at : stop.start()]
            node.children.append(entities.unescape(text) if tag == "textarea" else text)
            closing = page.find(">", stop.start())
            at = len(page) if closing < 0 else closing + 1
        elif tag not in VOID and not (node.attrs.endswith("/") and (tag in _FOREIGN or stack.foreign()) and node.closed()):
            stack.push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if node.attrs:
        a = node.attributes()
        if "hidden" in a or (a.get("style") and _GONE.search(a["style"])):
            return False
        return node.tag != "dialog" or "open" in a
    return node.tag != "dialog"


def _value(field: Node) -> str:
    """What a form field shows."""
    a = field.attributes() if field.attrs else {}
    kind = a.get("type", "text").strip().lower()
    if kind in KINDS:
        return a.get("value", "") if kind in SHOWN else a.get("alt", "") if kind == "image" else ""
    return a.get("value", "")  # an unknown kind is a text field


def _whole(given: str | None) -> int | None:
    return int(given) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", given or "") else None


class _Numbers:
    """The marks of a list's items."""

    def __init__(self, node: Node):
        a = node.attributes() if node.attrs else {}
        self.step = -1 if "reversed" in a else 1
        items = sum(isinstance(c, Node) and c.tag == "li" and visible(c) for c in node.children)
        start = _whole(a.get("start"))
        self.next = start if start is not None else items if self.step < 0 else 1
        self.kind = a.get("type", "1").strip()

    def mark(self, item: Node) -> str:
        a = item.attributes() if item.attrs else {}
        n = _whole(a.get("value"))
        n = self.next if n is None else n
        self.next = n + self.step
        return self._shown(n, a.get("type", self.kind).strip()) + ". "

    @staticmethod
    def _shown(n: int, kind: str) -> str:
        if kind in ("a", "A") and n > 0:
            out = ""
            while n:
                n, k = divmod(n - 1, 26)
                out = chr(ord(kind) + k) + out
            return out
        if kind in ("i", "I") and 0 < n < 4000:
            out = ""
            for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
                out, n = out + sign * (n // value), n % value
            return out.upper() if kind == "I" else out
        return str(n)


def columns(s: str) -> int:
    """How many columns a text takes: wide characters two, marks that combine none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Me", "Mn") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def veil(root: Node) -> None:
    """Marks what visibility hides and takes its own text away."""
    todo = [(root, False)]
    while todo:
        node, unseen = todo.pop()
        if node.attrs and (found := _VISIBILITY.findall(node.attributes().get("style") or "")):
            unseen = found[-1].lower() in ("hidden", "collapse")
        node.unseen = unseen
        if unseen:
            node.children = [c for c in node.children if isinstance(c, Node)]
        todo += [(c, unseen) for c in node.children if isinstance(c, Node)]


def lay_tables(root: Node) -> None:
    """Lays out all tables, those inside others first."""
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "table":
            tables.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and visible(c)]
    for table in reversed(tables):
        table.lines = grid(table)


class Lines:
    """Text laid out in lines. ``gap`` is how many empty lines stand before the next text."""

    def __init__(self):
        self.lines, self.now, self.indent, self.gap, self.bullet = [], [], 0, 0, ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.expandtabs(8).split("\n")
            self.now.append(first)
            for line in more:
                self.end(keep=True)
                self.now.append(line)
            return
        s = _BLANK.sub(" ", s)
        if not self.now or self.now[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one counts only if kept."""
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if not line and not keep:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = " " * self.indent
        if self.bullet:
            lead = lead[: max(0, self.indent - len(self.bullet))] + self.bullet
            self.bullet = ""
        self.lines.append((lead + line).rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, int(spaced))


#: Ends the line.
_LINE = Node("#line")


def _drawn(svg: Node) -> list[Node]:
    """The pieces of text of a drawing, each a line of its own."""
    found, todo = [], list(reversed(svg.children))
    while todo:
        item = todo.pop()
        if isinstance(item, str) or item.tag in DEFINED or not visible(item):
            continue
        if item.tag in DRAWN:
            found += [_LINE, item, _LINE]
        else:
            todo += reversed(item.children)
    return found


def render(root: Node) -> str:
    """The text below a node whose tables are laid out."""
    out = Lines()
    # Steps still to take: a string, a node to open, or (a node, what it changed) to close.
    todo: list = [(child, False) for child in reversed(root.children)]
    numbers: list[_Numbers | None] = []
    while todo:
        item, pre = todo.pop()
        if isinstance(item, str):
            out.text(item, pre)
            continue
        if isinstance(item, tuple):
            node, indent = item
            out.block(node.tag in SPACED and not (node.tag in ("ul", "ol") and numbers[1:]))
            out.indent = indent
            if node.tag in ("ul", "ol", "menu", "dir"):
                numbers.pop()
            continue
        if not visible(item):
            continue
        tag = item.tag
        if tag == "br":
            out.end(keep=True)
        elif item.unseen and tag in ("hr", "img", "input"):
            out.block(False) if tag == "hr" else None
        elif tag == "hr":
            out.block(False)
            out.now.append("---")
            out.end()
        elif tag == "img":
            alt = item.attributes().get("alt", "") if item.attrs else ""
            if alt:
                out.text(alt, False)
        elif tag == "input":
            if shown := _value(item):
                out.text(f" {shown} ", False)
        elif tag == "svg":
            todo += [(x, False) for x in reversed(_drawn(item))]
        elif tag == "textarea":
            out.block(False)
            todo += [(_LINE, False), (item.children[0].removeprefix("\n") if item.children else "", True)]
        elif tag in ("option", "optgroup"):
            label = item.attributes().get("label", "") if item.attrs and not item.unseen else ""
            out.block(False)
            todo.append((_LINE, False))
            todo += [(child, pre) for child in reversed(item.children)] if tag == "optgroup" or not label else []
            todo += [(_LINE, False), (label, False)] if label else []
        elif item is _LINE:
            out.block(False)
        elif tag == "table":
            out.block(True)
            for line in item.lines or ():
                out.now.append(line)
                out.end(keep=True)
            out.block(True)
        elif tag in BLOCK:
            out.block(tag in SPACED and not (tag in ("ul", "ol") and numbers))
            todo.append(((item, out.indent), False))
            if tag in ("ul", "ol", "menu", "dir"):
                numbers.append(_Numbers(item) if tag == "ol" else None)
            elif tag == "li":
                bullet = numbers[-1].mark(item) if numbers and numbers[-1] else "- "
                out.indent += len(bullet)
                out.bullet = "" if item.unseen else bullet
            elif tag in ("blockquote", "dd"):
                out.indent += 2
            inner = item.children
            if tag == "pre" and inner and isinstance(inner[0], str):  # a line feed right behind the tag is no text
                inner = [re.sub(r"\A\r?\n", "", inner[0]), *inner[1:]]
            todo += [(child, pre or tag == "pre") for child in reversed(inner)]
        else:
            todo += [(child, pre) for child in reversed(item.children)]
    out.end()
    return "\n".join(out.lines)


def _rows(node: Node) -> tuple[list[str], list[list[Node]]]:
    """The captions and rows of a table; tables inside its cells are theirs."""
    captions, rows, todo = [], [], list(reversed(node.children))
    loose: list = []
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if item.strip():
                captions.append(_BLANK.sub(" ", item).strip())
        elif not visible(item):
            continue
        elif item.tag == "tr":
            cells, rest = _cells(item)
            rows.append(cells)
            captions += [render(_wrap(*run)) for run in rest]
        elif item.tag in ("td", "th"):
            loose.append(item)
        elif item.tag == "caption":
            captions.append(render(item))
        elif item.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(item.children)
        elif item.tag == "colgroup":
            todo += reversed(item.children)
        elif item.tag != "col":
            captions.append(render(_wrap(item)))
    if loose:
        rows.append(loose)
    return [c for c in captions if c], rows


def _cells(row: Node) -> tuple[list[Node], list[list]]:
    """The cells of a row, also those inside other elements, and the runs of what else stands in it."""
    around, parents, todo = set(), {}, [row]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str) or not visible(c):
                continue
            if c.tag in ("td", "th"):
                up = node
                while up is not row and up not in around:
                    around.add(up)
                    up = parents[up]
            elif c.tag != "table":
                parents[c] = node
                todo.append(c)
    cells, rest, run = [], [], []
    todo = list(reversed(row.children))
    while todo:
        item = todo.pop()
        if isinstance(item, Node) and item.tag in ("td", "th"):
            if visible(item):
                cells.append(item)
        elif item in around:
            todo += reversed(item.children)
        else:
            run.append(item)
            continue
        rest.append(run)
        run = []
    return cells, [r for r in [*rest, run] if r]


def _wrap(*children) -> Node:
    node = Node("#part")
    node.children = list(children)
    return node


def _span(cell: Node, name: str, most: int) -> int:
    """How many columns or rows a cell covers; 0 rows stand for all that follow."""
    given = cell.attributes().get(name, "").strip() if cell.attrs else ""
    n = int(given) if re.fullmatch(r"[0-9]{1,9}", given) else 1
    return min(n, most) if n else most if name == "rowspan" else 1


def grid(node: Node) -> list[str]:
    """A table in aligned columns, cells of several lines included. A cell stands in the first column that none of the rows above covers."""
    captions, rows = _rows(node)
    cells: list[list[tuple[int, list[str]]]] = []
    covered: list[tuple[int, int, int]] = []  # first column, the one behind the last, rows left
    for row in rows:
        line, at, k, new = [], 0, 0, []
        for c in row:
            while k < len(covered) and covered[k][0] <= at:
                at = max(at, covered[k][1])
                k += 1
            text = render(_wrap(*c.children))
            if text:
                line.append((at, text.split("\n")))
            wide, tall = _span(c, "colspan", MOST_COLUMNS), _span(c, "rowspan", MOST_ROWS)
            if tall > 1:
                new.append((at, at + wide, tall))
            at += wide
        covered = sorted((a, b, n - 1) for a, b, n in covered + new if n > 1)
        if line:
            cells.append(line)
    widths: dict[int, int] = {}
    for row in cells:
        for at, text in row:
            widths[at] = max(widths.get(at, 0), *map(columns, text))
    used = sorted(widths)
    out = [s for c in captions for s in c.split("\n")]
    for row in cells:
        of = dict(row)
        for k in range(max(len(text) for _, text in row)):
            parts = [(of[at][k] if at in of and k < len(of[at]) else "", at) for at in used]
            out.append("  ".join(x + " " * (widths[at] - columns(x)) for x, at in parts).rstrip(" "))
    return out


def text_of(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    if _SAYS_VISIBILITY.search(page):
        veil(root)
    lay_tables(root)
    return render(root)


def _extractor():
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in columns:
            yield pages.map(text_of)

    return F.pandas_udf(run, "string")


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with a column of the visible text."""
    return pages.withColumn(to, _extractor()(F.col(html)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return got.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
