"""HTML to text by layout: a tree with implied tags, visibility rules, and a renderer that keeps blocks, lists and tables.

Nothing here recurses, and the scanner goes through a page once, so deep, long or cut-off pages take time and memory in
proportion. Visible is what neither the tag, the hidden attribute, a style attribute nor a plain rule of a style element
hides. Plain rules are those outside @ blocks whose selectors are a tag, #id and .classes put together, without
combinators; others are not looked at, nor are style sheets elsewhere.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Content is text up to the end tag; of the first ones it is never shown.
RAW = set("script style xmp iframe noembed noframes title textarea".split())
UNSEEN = set(
    "head script style title template noscript iframe noembed noframes object audio video canvas datalist "
    "param svg math area base link meta source track".split()
)
BLOCK = set(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul "
    "caption tr".split()
)
#: Blocks with an empty line before and after.
SPACED = set("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol ul menu pre table hr fieldset".split())
#: A tag that begins closes these, as far up as the second set.
_LISTS, _TABLE = set("ul ol menu".split()), {"table"}
_ENDS_P = BLOCK - set("html body li dd dt option optgroup caption tr legend summary".split()) | {"li", "dd", "dt"}
CLOSES = {
    "li": ({"li"}, _LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, _TABLE),
    **{t: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, _TABLE) for t in ("thead", "tbody", "tfoot")},
}
#: What an inline end tag does not reach beyond.
_SCOPE = set("td th table caption li button body html".split())
#: What may stand in a head; any other tag, and text, ends it.
_IN_HEAD = set("title meta link base basefont bgsound style script noscript noframes template head".split())
#: What a tag stands in, if it is not there: row parts in a row, rows in a table.
_NEEDS = {"td": "tr", "th": "tr"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+([\"']|[^\s>\"'][^\s>]*+)?)?)")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*+|\*)?((?:[.#][\w-]++)*+)")
_BLANK = re.compile(r"[ \t\n\r\f]*")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def tag_at(html: str, at: int) -> tuple[str, dict[str, str], bool, int] | None:
    """(name, attributes, whether it ends itself, where it ends) of the start tag at `at`; None if the page's end cuts it off.

    Each attribute is matched once where the one before it ended; a quote without its fellow ends the page.
    """
    m = _NAME.match(html, at + 1)
    name, attributes, at = m[0].lower(), {}, m.end()
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            return None
        if m[1]:
            return name, attributes, html[m.end() - 2] == "/", m.end()
        key, value, at = m[2].lower(), m[3] or "", m.end()
        if value in ("'", '"'):
            end = html.find(value, at)
            if end < 0:
                return None
            value, at = html[at:end], end + 1
        if at == len(html):
            return None
        attributes.setdefault(key, unescape(value))


def parse(html: str) -> Node:
    """The tree. Text is a plain string among a node's children."""
    root = Node("html")
    stack = [root]
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag stands, outermost first
    at, end = 0, len(html)

    def end_head() -> None:
        """Text or a tag that no head holds closes an open head and begins the body."""
        if stack[-1].tag == "head":
            cut(len(stack) - 1)
            put("body")

    def put(tag: str, attributes: dict[str, str] | None = None) -> Node:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        opened[tag].append(len(stack))
        stack.append(node)
        return node

    def cut(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag].pop()

    def innermost(tags: set[str]) -> int:
        """The last place of any of tags; 0 if none is open."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(tags: set[str], within: set[str]) -> None:
        """Closes the innermost of tags, and again, while it stands inside the nearest of within."""
        barrier, depth = innermost(within), len(stack)
        for t in tags:
            if opened.get(t) and opened[t][-1] > barrier:
                depth = min(depth, opened[t][bisect(opened[t], barrier)])
        cut(depth)

    def end_tag(tag: str) -> None:
        if tag in ("br", "p"):
            end_head()
        if tag == "br":
            stack[-1].children.append(Node("br"))
        elif tag == "p" and not opened.get("p"):
            stack[-1].children.append(Node("p"))
        elif tag not in VOID and tag not in ("html", "body"):
            stop = set() if tag in BLOCK or tag in _SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else _SCOPE
            if tag not in ("table",) and tag in CLOSES:
                stop = CLOSES[tag][1]
            if tag not in ("table", "div", "form", "section", "article", "main"):
                stop = stop | _TABLE
            if opened.get(tag) and opened[tag][-1] >= innermost(stop):
                cut(opened[tag][-1])

    while at < end:
        opening = html.find("<", at)
        if opening != at:
            text = html[at : opening if opening > 0 else end]
            at += len(text)
        elif html.startswith("<!--", at):
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, at)), None)
            m = _COMMENT_END.search(html, at + 4) if short is None else None
            at = at + len(short) if short else m.end() if m else end
            continue
        elif html[at + 1 : at + 2] in ("!", "?"):
            shut = html.find(">", at)
            at = shut + 1 if shut > 0 else end
            continue
        elif html[at + 1 : at + 2] == "/" and (m := _NAME.match(html, at + 2)):
            tag, shut = m[0].lower(), html.find(">", m.end())
            at = shut + 1 if shut > 0 else end
            end_tag(tag)
            continue
        elif _NAME.match(html, at + 1):
            text = None
        else:
            text, at = "<", at + 1
        if text is not None:
            if not _BLANK.fullmatch(text):
                end_head()
            stack[-1].children.append(text)
        else:
            found = tag_at(html, at)
            if found is None:  # a tag that the page's end cuts off
                break
            tag, attributes, closed, at = found
            if tag in ("html", "body"):
                for k, v in attributes.items():
                    root.attributes.setdefault(k, v) if tag == "html" else None
                if tag == "body":
                    close({"head"}, set())
                    put("body", attributes)
                continue
            if tag not in _IN_HEAD:
                end_head()
            if tag in _ENDS_P:
                close({"p"}, _SCOPE)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in _NEEDS and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                put(_NEEDS[tag])
            node = put(tag, attributes)
            if tag in VOID or (closed and tag in ("svg", "math", "path")):
                cut(len(stack) - 1)
            elif tag in RAW or tag == "plaintext":
                m = None if tag == "plaintext" else _raw_end(tag).search(html, at)
                stop = m.start() if m else end
                node.children.append(html[at:stop])
                cut(len(stack) - 1)
                shut = html.find(">", stop)
                at = end if shut < 0 or stop == end else shut + 1
    return root


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


def declared(style: str) -> tuple[bool | None, bool | None]:
    """Whether declarations take an element out of the page, and whether they hide it; None where they do not say."""
    gone = hidden = None
    for part in style.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.replace("!important", "").strip().lower()
        if name == "display":
            gone = value == "none"
        elif name == "visibility":
            hidden = value in ("hidden", "collapse")
    return gone, hidden


class Rules:
    """The plain rules of a page's style elements that bear on what is visible."""

    def __init__(self, root: Node):
        self.by: dict[str, list[tuple]] = defaultdict(list)
        todo: list[Node] = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                self.read("".join(c for c in node.children if isinstance(c, str)))
            todo.extend(c for c in node.children if isinstance(c, Node))

    def read(self, sheet: str) -> None:
        sheet = "".join(part.partition("*/")[2] if i else part for i, part in enumerate(sheet.split("/*")))
        depth = 0
        for part in sheet.split("}"):
            head, brace, body = part.rpartition("{")
            plain = depth == 0 and "{" not in head and "@" not in head
            depth = max(0, depth + part.count("{") - 1)
            said = declared(body) if brace and plain else (None, None)
            if said == (None, None):
                continue
            for selector in head.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if m and selector.strip():
                    tag = (m[1] or "*").lower()
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*")
                    self.by[marks[0] if marks else tag].append((weight, len(self.by), tag, marks, said))

    def of(self, node: Node) -> tuple[bool | None, bool | None]:
        if not self.by:
            return None, None
        a = node.attributes
        own = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
        fits = [r for k in (*own, node.tag, "*") for r in self.by.get(k, ()) if r[2] in ("*", node.tag) and own.issuperset(r[3])]
        gone = hidden = None
        for *_, said in sorted(fits, key=lambda r: r[:2]):
            gone, hidden = (b if b is not None else a for a, b in zip((gone, hidden), said))
        return gone, hidden


def seen(node: Node, rules: Rules, above: bool) -> tuple[bool, bool]:
    """(whether the node is part of the page, whether its text shows); above: whether its parent's text shows."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False, False
    if node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False, False
    gone, hidden = rules.of(node)
    if "style" in a:
        own = declared(a["style"])
        gone, hidden = (y if y is not None else x for x, y in zip((gone, hidden), own))
    return not gone, above if hidden is None else not hidden


class Flow:
    """Lines of text as they grow: collapsed white space, wanted empty lines, indents and list marks."""

    def __init__(self):
        self.lines, self.line, self.space, self.gap = [], [], False, 0
        self.indents, self.mark, self.pre = [], None, 0

    def text(self, s: str) -> None:
        if self.pre:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end_line(True)
                if part:
                    self.line.append(part)
            return
        parts = _WHITE.split(s)
        if not parts[0]:
            self.space = True
        for i, part in enumerate(parts):
            if part:
                if (self.space or i) and self.line and not (len(self.line) and self.line[-1].endswith(" ")):
                    self.line.append(" ")
                self.line.append(part)
                self.space = False
        if not parts[-1] and len(parts) > 1:
            self.space = True

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.line)
        self.line, self.space = [], False
        if not line and not keep_empty:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indents)
        if self.mark is not None:
            indent, self.mark = indent[: len(indent) - len(self.mark)] + self.mark, None
        self.lines.append((indent + line).rstrip() if not self.pre else indent + line)

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def take(self, lines: list[str]) -> None:
        for x in lines:
            self.line = [x]
            self.end_line(True)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self, widest: int) -> list[str]:
        """Columns as wide as their longest cell of at most `widest` characters, two spaces apart. A cell over several
        columns widens the last of them if they are too narrow for it."""
        grid: list[dict[int, tuple[list[str], int]]] = []
        held: dict[int, int] = {}
        widths: dict[int, int] = {}
        wide: list[tuple[int, int, int]] = []
        for row in self.rows:
            cells, column = {}, 0
            for lines, across, down in row:
                while held.get(column, 0):
                    column += 1
                cells[column] = lines, across
                for c in range(column, column + across):
                    if down > 1:
                        held[c] = down
                fit = max((len(x) for x in lines if len(x) <= widest), default=0)
                if across == 1:
                    widths[column] = max(widths.get(column, 0), fit)
                else:
                    wide.append((across, column, fit))
                column += across
            held = {c: n - 1 for c, n in held.items() if n > 1}
            grid.append(cells)
        whole = lambda c, n: sum(widths.get(k, 0) for k in range(c, c + n)) + 2 * (n - 1)
        for across, column, fit in sorted(wide):
            last = column + across - 1
            widths[last] = widths.get(last, 0) + max(0, fit - whole(column, across))
        out = []
        for cells in grid:
            for i in range(max((len(lines) for lines, _ in cells.values()), default=0)):
                line, at = [], 0
                for c, (lines, across) in sorted(cells.items()):
                    if at < c:
                        line.append(" " * whole(at, c - at))
                    line.append((lines[i] if i < len(lines) else "").ljust(whole(c, across)))
                    at = c + across
                out.append("  ".join(line).rstrip())
        return out


def _number(value: str, default: int, most: int) -> int:
    m = re.match(r"\s*+(-?\d{1,11})", value or "")
    return max(-most, min(int(m[1]), most)) if m else default


def render(root: Node, widest: int = 60) -> str:
    """All visible text of the tree."""
    flow, flows, tables, lists = Flow(), [], [], []
    rules, shows = Rules(root), [True]
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if shows[-1]:
                flow.text(unescape(node))
            continue
        tag = node.tag
        if not leaving:
            there, text_shows = seen(node, rules, shows[-1])
            if not there:
                continue
            shows.append(text_shows)
            todo.append((node, True))
            if tag == "br":
                flow.end_line(True)
            elif tag == "wbr":
                pass
            elif not shows[-1] and tag in ("img", "input", "q"):
                pass
            elif tag == "img" and node.attributes.get("alt"):
                flow.text(node.attributes["alt"])
            elif tag == "input" and node.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset"):
                flow.text(f" {node.attributes.get('value', '')} ")
            elif tag == "q":
                flow.text('"')
            elif tag in BLOCK and tag not in ("tr", "table"):
                flow.block(1 if tag in SPACED and not (tag in _LISTS and lists) else 0)
            if tag == "hr" and shows[-1]:
                flow.take(["---"])
                flow.gap = 1
            elif tag in _LISTS or tag == "dl":
                start = _number(node.attributes.get("start", ""), 1, 2**31 - 1)
                lists.append([tag, start])
            elif tag == "li":
                owner = lists[-1] if lists else ["ul", 1]
                value = _number(node.attributes.get("value", ""), owner[1], 2**31 - 1)
                mark = f"{value}. " if owner[0] == "ol" else "- "
                owner[1] = value + 1
                flow.indents.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag == "pre":
                flow.pre += 1
            elif tag == "table":
                flow.block(1)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                flows.append((flow, lists))
                flow, lists = Flow(), []
            elif tag == "details" and "open" not in node.attributes:
                first = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
                if first is not None:
                    todo.append((first, False))
                continue
            todo.extend((c, False) for c in reversed(node.children))
            continue
        shown = shows.pop()
        if tag == "q" and shown:
            flow.text('"')
        elif tag == "pre":
            flow.end_line()
            flow.pre -= 1
        elif tag in ("td", "th") and tables:
            across = max(1, _number(node.attributes.get("colspan", ""), 1, 1000))
            down = max(1, _number(node.attributes.get("rowspan", ""), 1, 65_534))  # both limits are HTML's own
            cell = flow.done()
            flow, lists = flows.pop()
            tables[-1].rows[-1].append((cell, across, down))
        elif tag == "table":
            lines = tables.pop().lines(widest)
            if tables and not flows:
                lines = [x for x in lines if x]
            flow.end_line()
            flow.gap = max(flow.gap, 1 if flow.lines else 0)
            flow.take(lines)
            flow.block(1)
        if tag in BLOCK and tag not in ("tr", "table"):
            flow.block(1 if tag in SPACED and not (tag in _LISTS and len(lists) > 1) else 0)
        if tag in _LISTS or tag == "dl":
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            if tag == "li":
                flow.mark = None
            flow.indents.pop()
    return "\n".join(flow.done())


def to_text(html: str | None, widest: int = 60) -> str:
    return render(parse(html), widest) if html else ""


def title_of(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _WHITE.sub(" ", unescape("".join(c for c in node.children if isinstance(c, str)))).strip()
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return None


def extract(pages: DataFrame, html: str = "html", widest: int = 60) -> DataFrame:
    """pages without the html, with title and text (replaced where they exist).

    Null or empty html: empty text, null title. What is no HTML is text. Null ids and repeated rows: a row each. Pages
    are read whole, however long or deep; a tag that the page's end cuts off is dropped. A cell wider than `widest`
    characters is kept whole but does not widen its column. Ties do not arise. Empty input: no rows.
    """
    keep = [c for c in pages.columns if c not in (html, "title", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                titles, texts = [], []
                for page in part.column(part.num_columns - 1).to_pylist():
                    root = parse(page or "")
                    titles.append(title_of(root))
                    texts.append(render(root, widest))
                arrays = [*part.columns[:-1], pa.array(titles, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "title", "text"])

    schema = pages.select(*keep).schema.add("title", "string").add("text", "string")
    return pages.select(*keep, F.col(html).cast("string")).mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page, as `extract` defines it; nulls, long pages and empty tables likewise."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
