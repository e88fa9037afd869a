"""Layout-aware text of HTML pages.

``TreeBuilder`` turns a page into balanced open, close and text events: it closes what a tag
implies to be closed (paragraphs, list items, cells, the head), opens missing rows, drops
stray end tags and swallows raw-text elements. ``Renderer`` follows the events, leaves out
what is not visible and lays out the rest: blocks on lines of their own, blank lines where
margins are, lists with marks and indents, table cells in aligned columns.

* null and empty pages give an empty text. A page cut off in the middle is rendered as far as
  it goes. Repeated rows are rendered one by one; extra columns stay, and ``text`` replaces a
  column of that name. An empty table gives an empty result.
* labels of drawings (SVG) and formulas (MathML) are text; titles, descriptions, definitions and
  annotations in them are not, and what a drawing repeats by reference is not repeated.
* nesting is followed at any depth. Items, quotes and cells within MAX_DEPTH others keep their
  marks and line breaks but are indented and aligned no further: deep items on lines of their
  own, the cells of a row behind each other. Cells wider than MAX_ALIGN characters are written whole but push no others to the right, so the
  output is linear in the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quorum.llm.common import map_batches

MAX_DEPTH = 512
MAX_ALIGN = 120
MAX_SPAN = 1000

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea noscript template".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HIDDEN = frozenset(
    "head script style template noscript title iframe noembed noframes datalist object video audio canvas".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd li fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCK = CLOSES_P | frozenset("body html caption legend optgroup option tr td th tbody thead tfoot".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("tbody thead tfoot".split())
#: Elements that end tags and implied ends don't reach across.
BARRIER = frozenset("table td th caption html object template foreignobject desc annotation-xml".split())
#: Drawings and formulas: their children without a place of their own on the page, and those
#: that hold HTML.
FOREIGN = ("svg", "math")
UNSEEN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask marker pattern".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: HTML elements that end a drawing or formula they stand in.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
TABLE_TAGS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# Quotes count only after an equals sign, as in the standard.
REST = re.compile(r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=(?!\s*+["']))*+""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Attributes that matter here; other tags skip parsing theirs.
TELLING = re.compile(r"hidden|style|open|start|value|span|reversed|display|visibility", re.I)


class TreeBuilder:
    """Balanced events of a page, for a renderer with ``open``, ``close`` and ``text``."""

    def __init__(self, out):
        self.out = out
        self.stack: list[str] = []
        self.at: dict[str, list[int]] = {}  # where in the stack the elements of a name are

    def push(self, name: str, attributes: dict) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(name)
        self.out.open(name, attributes)

    def pop(self) -> str:
        name = self.stack.pop()
        self.at[name].pop()
        self.out.close(name)
        return name

    def innermost(self, names) -> int:
        """Where the innermost of ``names`` is, -1 if none is open. No walk over the stack: pages
        may be deep."""
        return max((at[-1] for n in names if (at := self.at.get(n))), default=-1)

    def pop_to(self, names, barrier=BARRIER) -> bool:
        """Close everything down to the innermost of ``names``, unless a barrier is in between."""
        i = self.innermost(names)
        if i < 0 or i < self.innermost(barrier):
            return False
        while len(self.stack) > i:
            self.pop()
        return True

    def foreign(self) -> str:
        """The drawing or formula that a tag would be part of, or nothing."""
        if not any(map(self.at.get, FOREIGN)):
            return ""
        at, name = max((self.innermost((n,)), n) for n in FOREIGN)
        return name if at >= 0 and at > self.innermost(HOLDS_HTML) else ""

    def start_foreign(self, name: str, attributes: dict, around: str, ended: bool) -> None:
        style = ";".join(f"{k}:{attributes[k]}" for k in ("display", "visibility") if k in attributes)
        if around == "svg" and style:
            attributes = attributes | {"style": f"{style};{attributes.get('style', '')}"}
        if name in UNSEEN[around]:
            attributes = attributes | {"hidden": ""}
        label = around == "svg" and name == "text"
        if label:
            self.out.label()
        self.push(name, attributes)
        if ended:
            self.pop()

    def start(self, name: str, attributes: dict) -> None:
        if name in ("html", "body"):
            if name == "body":
                self.pop_to(("head",))
            if not self.at.get(name):
                self.push(name, attributes)
            return
        if self.at.get("head") and self.stack[-1] == "head" and name not in HEAD:
            self.pop()
        if name in CLOSES_P:
            self.pop_to(("p",))
        if name == "li":
            self.pop_to(("li",), BARRIER | LISTS)
        elif name in ("dt", "dd"):
            self.pop_to(("dt", "dd"), BARRIER | {"dl"})
        elif name in HEADINGS and self.stack and self.stack[-1] in HEADINGS:
            self.pop()
        elif name in ("option", "optgroup"):
            self.pop_to(("option",) if name == "option" else ("option", "optgroup"), BARRIER | {"select"})
        elif name in SECTIONS or name in ("caption", "colgroup"):
            self.pop_to(("tr", *SECTIONS, "caption", "colgroup"), {"table"})
        elif name == "tr":
            self.pop_to(("tr", "caption", "colgroup"), {"table", *SECTIONS})
        elif name in ("td", "th"):
            self.pop_to(("td", "th", "caption", "colgroup"), {"table", "tr"})
            if self.stack and (self.stack[-1] == "table" or self.stack[-1] in SECTIONS):
                self.push("tr", {})
        self.push(name, attributes)
        if name in VOID and self.stack and self.stack[-1] == name:
            self.pop()

    def end(self, name: str) -> None:
        if name in ("br", "p") and not self.at.get(name):
            self.start(name, {})  # a stray end of these makes an empty element
            self.pop_to((name,))
        elif name not in ("html", "body") and name not in VOID:
            self.pop_to((name,), {"table"} - {name} if name in TABLE_TAGS else BARRIER)

    def text(self, text: str) -> None:
        if self.stack and self.stack[-1] == "head" and text.strip(" \t\n\r\f"):
            self.pop()
        self.out.text(text)

    def feed(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 == size:
                self.text(html.unescape(page[at:]))
                break
            sign = page[lt + 1]
            if sign.isascii() and sign.isalpha():
                begin = lt + 1
            elif sign == "/" and NAME.match(page, lt + 2):
                begin = lt + 2
            elif sign in "!?/":
                if lt > at:
                    self.text(html.unescape(page[at:lt]))
                if page.startswith("<![CDATA[", lt) and self.foreign():
                    end = page.find("]]>", lt)
                    self.text(page[lt + 9 : end if end >= 0 else size])
                    at = size if end < 0 else end + 3
                    continue
                mark = "-->" if page.startswith("<!--", lt) else ">"
                # "<!-->" and "<!--->" are whole comments.
                end = page.find(mark, lt + 2)
                at = size if end < 0 else end + len(mark)
                continue
            else:
                self.text(html.unescape(page[at : lt + 1]))
                at = lt + 1
                continue
            if lt > at:
                self.text(html.unescape(page[at:lt]))
            name_end = NAME.match(page, begin).end()
            name = page[begin:name_end].lower()
            end = REST.match(page, name_end).end()
            if end >= size or page[end] != ">":
                break  # the tag, or a quoted value in it, never ends
            at = end + 1
            if begin == lt + 2:
                self.end(name)
                continue
            inner = page[name_end:end]
            attributes = {}
            if inner and TELLING.search(inner):
                for key, *values in ATTRIBUTE.findall(inner):
                    attributes.setdefault(key.lower(), html.unescape("".join(values)))
            around = self.foreign()
            while around and name in BREAKS_OUT:
                self.pop_to((around,), ())
                around = self.foreign()
            if around:
                ended = inner.endswith("/")
                self.start_foreign(name, attributes, around, ended)
                if ended or name not in ("script", "style", "title"):
                    continue
            else:
                self.start(name, attributes)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                stop = close.start() if close else size
                raw = page[at:stop]
                self.out.text(html.unescape(raw) if name in ("title", "textarea") else raw)
                self.pop_to((name,), ())
                at = size if not close else page.find(">", stop) + 1 or size
        while self.stack:
            self.pop()


class Lines:
    """Text under layout: finished lines, and one that is still open."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []
        self.space = False  # white space is waiting for the next word
        self.gap = 0  # blank lines asked for before the next text
        self.some = False  # the open line is to be kept even if empty
        self.marks: list[str] = []  # of deep list items that have no text yet

    def inline(self, text: str) -> None:
        words = SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        self._mark()
        if (self.space or words[0] == " ") and self.open:
            self.open.append(" ")
        self.open.append(words.strip(" "))
        self.space = words[-1] == " "

    def verbatim(self, text: str) -> None:
        self._mark()
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.open.append(first)
        for line in more:
            self.break_line()
            self.open.append(line)

    def _mark(self) -> None:
        if self.marks:
            self.open.append("".join(self.marks))
            self.marks, self.space = [], False

    def break_line(self) -> None:
        self._finish(keep=not self.marks)

    def next_cell(self) -> None:
        if self.open:
            self.open.append("  ")
            self.space = False

    def end_line(self) -> None:
        self._finish(keep=False)

    def _finish(self, keep: bool) -> None:
        if self.open or keep:
            self._blank()
            self.done.append("".join(self.open).rstrip(" "))
        self.open, self.space = [], False

    def _blank(self) -> None:
        if self.done and self.gap:
            self.done += [""] * self.gap
        self.gap = 0

    def ask_gap(self, n: int) -> None:
        self.end_line()
        self.gap = max(self.gap, n)

    def block(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            self._blank()
            mark, self.marks = "".join(self.marks), []
            self.done += [mark + lines[0], *lines[1:]] if mark else lines

    def finish(self) -> list[str]:
        self.end_line()
        lines = self.done
        begin, end = 0, len(lines)
        while begin < end and not lines[begin]:
            begin += 1
        while end > begin and not lines[end - 1]:
            end -= 1
        return lines[begin:end]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.held: dict[int, int] = {}  # column: rows it is still taken by a cell above

    def row(self) -> None:
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1}
        self.rows.append([])

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.rows.append([])
        row = self.rows[-1]
        at = row[-1][0] + row[-1][2] if row else 0
        while self.held.get(at):
            at += 1
        row.append((at, lines, across))
        if down > 1:
            for c in range(at, at + across):
                self.held[c] = down

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, lines, across in row:
                if across == 1:
                    wide = max(map(len, lines), default=0)
                    widths[at] = max(widths.get(at, 0), wide if wide <= MAX_ALIGN else 0)
        columns = sorted({at for row in self.rows for at, _, _ in row})
        left, where = 0, {}
        for c in columns:
            where[c] = left
            left += widths.get(c, 0) + 2
        out = []
        for row in self.rows:
            for i in range(max((len(lines) for _, lines, _ in row), default=0)):
                line = ""
                for at, lines, _ in row:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(min(where[at], len(line) + left)) if len(line) <= where[at] else line + "  "
                        line += lines[i]
                if line:
                    out.append(line)
        return out


def _number(text: str | None, default: int, least: int = 1, most: int = MAX_SPAN) -> int:
    try:
        return min(max(int((text or "").strip()), least), most)
    except ValueError:
        return default


class Renderer:
    """Lays out the visible text of the events it gets."""

    def __init__(self):
        self.lines = Lines()
        self.outer: list[Lines] = []
        self.frames: list[tuple] = []  # per open element: what has to be undone
        self.hidden = 0
        self.unseen = False
        self.pre = 0
        self.lists: list[list] = []
        self.tables: list[Table | None] = []  # None: too deep to be aligned
        self.flat: list[int | None] = []  # per open item or quote: None, or the marks before it if too deep for lines of its own
        self.cells: list[tuple[int, int]] = []

    def open(self, name: str, attributes: dict) -> None:
        style = {k.lower(): v.lower() for k, v in STYLE.findall(attributes.get("style", ""))}
        before = (self.unseen, self.pre)
        gone = (
            name in HIDDEN
            or ("hidden" in attributes and attributes["hidden"].lower() != "until-found")
            or style.get("display") == "none"
            or (name == "dialog" and "open" not in attributes)
            or (bool(self.frames) and self.frames[-1][4] and name != "summary")
        )
        if "visibility" in style:
            self.unseen = style["visibility"] in ("hidden", "collapse")
        space = style.get("white-space", "")
        if name in ("pre", "textarea", "xmp") or space.startswith("pre"):
            self.pre += 1
        elif space in ("normal", "nowrap"):
            self.pre = 0
        folded = name == "details" and "open" not in attributes
        self.frames.append((name, gone, *before, folded))
        if gone:
            self.hidden += 1
        if self.hidden:
            return
        if name == "br":
            self.lines.break_line()
        elif name in ("td", "th") and self.tables and self.tables[-1] is None:
            self.lines.next_cell()
        elif name in BLOCK:
            nested_list = name in LISTS and self.lists
            self.lines.ask_gap(1 if name in SPACED and not nested_list else 0)
        if name in LISTS:
            ordered = name == "ol"
            first = _number(attributes.get("start"), 1, -(10**9), 10**9)
            self.lists.append([ordered, first, -1 if "reversed" in attributes else 1])
        elif name == "li":
            if self.lists and "value" in attributes:
                self.lists[-1][1] = _number(attributes["value"], self.lists[-1][1], -(10**9), 10**9)
            self._indent()
            if self.flat[-1] is not None:
                self.lines.marks.append(self._item_mark())
        elif name in ("dd", "blockquote"):
            self._indent()
        elif name == "table":
            if len(self.outer) >= MAX_DEPTH:
                self.tables.append(None)
            else:
                self.tables.append(Table())
                self.outer.append(self.lines)  # stray text of the table goes before it
        elif name == "tr" and self.tables and self.tables[-1]:
            self.tables[-1].row()
        elif name in ("td", "th") and self.tables and self.tables[-1]:
            self.cells.append((_number(attributes.get("colspan"), 1), _number(attributes.get("rowspan"), 1)))
            self._inner()

    def label(self) -> None:
        """Labels of a drawing stand apart from what is before them."""
        if not self.hidden:
            self.lines.space = True

    def _indent(self) -> None:
        deep = len(self.outer) >= MAX_DEPTH
        self.flat.append(len(self.lines.marks) if deep else None)
        if not deep:
            self._inner()

    def _item_mark(self) -> str:
        if not self.lists:
            return "- "
        ordered, number, step = self.lists[-1]
        self.lists[-1][1] = number + step
        return f"{number}. " if ordered else "- "

    def _inner(self) -> None:
        self.outer.append(self.lines)
        self.lines = Lines()

    def _leave(self) -> list[str]:
        lines = self.lines.finish()
        self.lines = self.outer.pop()
        return lines

    def close(self, name: str) -> None:
        _, gone, unseen, pre, _ = self.frames.pop()
        if not self.hidden:
            self._close_visible(name)
        self.unseen, self.pre = unseen, pre
        if gone:
            self.hidden -= 1

    def _close_visible(self, name: str) -> None:
        if name in ("li", "dd", "blockquote"):
            marks = self.flat.pop()
            if marks is not None:
                self.lines.end_line()
                del self.lines.marks[marks:]  # an item without text has no mark
            elif name == "li":
                mark, lines = self._item_mark(), self._leave()
                pad = " " * len(mark)
                self.lines.block([(pad if i else mark) + x if x else x for i, x in enumerate(lines)])
            else:
                lines = self._leave()
                self.lines.block(["    " + x if x else x for x in lines])
            if name != "li":
                self.lines.ask_gap(1 if name == "blockquote" else 0)
        elif name in ("td", "th") and self.tables and not self.tables[-1]:
            pass
        elif name in ("td", "th") and self.tables and self.cells:
            self.tables[-1].cell(self._leave(), *self.cells.pop())
        elif name == "table" and self.tables:
            table = self.tables.pop()
            if table:
                self.outer.pop()
                self.lines.block(table.lines())
            self.lines.ask_gap(1)
        elif name in LISTS:
            if self.lists:
                self.lists.pop()
            self.lines.ask_gap(0 if self.lists else 1)
        elif name in BLOCK:
            self.lines.ask_gap(1 if name in SPACED else 0)

    def text(self, text: str) -> None:
        if self.hidden or self.unseen or (self.frames and self.frames[-1][4]):
            return
        text = text.replace("\xa0", " ") if self.pre else text
        (self.lines.verbatim if self.pre else self.lines.inline)(text)

    def result(self) -> str:
        return "\n".join(self.lines.finish()).replace("\xa0", " ")


def render(page: str | None) -> str:
    renderer = Renderer()
    TreeBuilder(renderer).feed(page or "")
    return renderer.result()


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the visible text of ``column``, in its place."""
    pages = pages.drop("text") if column != "text" else pages
    at = pages.columns.index(column)
    names = ["text" if c == column else c for c in pages.columns]
    fields = [T.StructField("text", T.StringType(), False) if c == column else pages.schema[c] for c in pages.columns]

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([render(p.as_py()) for p in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(pages, run, T.StructType(fields))
