"""HTML extraction by layout-aware rendering.

A page is read tag by tag into a tree of boxes: tags that authors leave out are implied (a new paragraph, list item, row, cell
or option ends the one that is open; blocks end paragraphs; end tags close what is open inside them), and subtrees that a
browser does not show are left out (scripts, styles, head matter, templates, comments, `hidden`, `aria-hidden`, display:none,
visibility:hidden but for what is visible in it, closed dialogs, what closed details hold
below their summary, options that a drop-down list does not show, what media, objects
and canvases hold for browsers without them, annotations of formulas, titles and definitions of drawings). The tree is then laid out as plain text: blocks on lines of their own, one empty line
around paragraphs, headings, lists and tables, items with bullets or numbers by depth, cells of a table padded to the width of
their column, preformatted text as it stands. All text that is visible comes out, menus and footers included.

Size and time stay in proportion to the page. Lines of a cell are wrapped at `WIDEST` columns; a row that would take over `PADDED` characters for each
letter and cell in it gives its cells one below another; lists are indented up to `INDENTED` levels. No letter is lost by that. Tags are
looked for once, open elements are found by their kind, so no page walks the same text or the open elements again and again.

Each page is rendered on its own, within one pass over the table; Spark deals the pages and nothing is shuffled.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (an unclosed comment or script
hides the rest); nesting beyond 200 levels (2000 where hidden) stays at that level, its text is kept;
a number of a character that is too long to be one gives U+FFFD; repeated rows are rendered alike; an empty
table gives an empty result; null ids are passed on; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's elements by how they are shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe object canvas audio video datalist".split())
RAW = frozenset("script style title template iframe noscript".split())
#: In drawings and formulas, what is not shown, what holds HTML, and the tags of HTML that end them elsewhere.
UNSEEN_THERE = frozenset("desc metadata defs symbol clippath mask annotation annotation-xml".split())
HTML_INSIDE = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside details summary dialog dd div dt figcaption footer form header hgroup hr li main menu nav option section tr thead tbody tfoot caption center legend".split()
)
#: What a start tag ends, and within which elements it looks for it.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot caption colgroup", "table"), "tfoot": ("thead tbody tfoot", "table"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
    "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPES = frozenset("table td th button".split())
#: Inline elements whose end tag ends blocks in them too.
HOLDERS = frozenset("select datalist svg math object canvas audio video".split())
DEEPEST, DEEPEST_HIDDEN = 200, 2000
WIDEST, PADDED, INDENTED = 80, 24, 16

NAME_END, CLOSERS = re.compile(r"[\s/>]"), re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([^\s/=][^\s/=>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Tags without these letters have no attribute that matters here.
MAY_MATTER = re.compile(r"hidden|style|open|selected|disabled|multiple|size", re.I)
STYLE_MARK = re.compile("[;\"'()]")
ZEROS, TOO_LONG = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
START = re.compile(r"(?:^|\s)start\s*=\s*[\"']?(\d{1,9})", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


def decoded(text: str) -> str:
    """text with its character references read."""
    if "&#" in text:
        text = TOO_LONG.sub("\ufffd", ZEROS.sub("&#", text))
    return unescape(text)


class Tags:
    """Comments, declarations and tags of a page, one after another. What can't be one is text; each quote or > is walked over once in vain at most, so a
    page takes time in proportion to its length."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.closers = [m.start() for m in CLOSERS.finditer(html)]
        self.vain: set[int] = set()
        self.name_end = 0

    def _end(self, at: int) -> int:
        """The > that ends a tag, outside of quotes; -1 if none does."""
        k, walked = bisect_left(self.closers, at), []
        while k < len(self.closers) and k not in self.vain:
            walked.append(k)
            p = self.closers[k]
            if self.html[p] == ">":
                return p
            p = self.html.find(self.html[p], p + 1)
            if p < 0:
                break
            k = bisect_left(self.closers, p + 1)
        self.vain.update(walked)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it is an end tag, name or None, attributes) of the first one from `at` on."""
        html, p = self.html, self.html.find("<", at)
        while p >= 0:
            after = html[p + 1 : p + 2]
            if html.startswith("!--", p + 1):
                end = html.find("-->", p + 4)
                return p, end + 3 if end >= 0 else len(html), False, None, ""
            if p > self.last:
                p = html.find("<!--", p)
                continue
            if after in ("!", "?"):
                return p, html.find(">", p) + 1, False, None, ""
            first = p + 1 + (after == "/")
            letter = html[first : first + 1]
            if letter.isascii() and letter.isalpha():
                if first >= self.name_end:
                    m = NAME_END.search(html, first)
                    self.name_end = m.start() if m else len(html)
                end = self._end(self.name_end)
                if end >= 0:
                    return p, end + 1, after == "/", html[first : self.name_end].lower(), html[self.name_end : end]
            p = html.find("<", p + 1)
        return None


class Box:
    """shown: in the tree; visible: as CSS says, which boxes inside may change; foreign: of a drawing or formula."""

    __slots__ = ("attributes", "children", "foreign", "shown", "start", "tag", "visible")

    def __init__(self, tag: str, start: int = 1, attributes: dict | None = None):
        self.tag, self.children, self.start, self.attributes = tag, [], start, attributes or {}
        self.shown = self.visible = True
        self.foreign = False


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name in small letters; of equal names the first counts."""
    found: dict[str, str] = {}
    if MAY_MATTER.search(text):
        for m in ATTRIBUTE.finditer(text):
            value = m[2] or ""
            found.setdefault(m[1].lower(), decoded(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def declarations(style: str) -> Iterator[str]:
    """What stands between semicolons outside of quotes and brackets; what is not closed goes on to the end."""
    style, begin, at, inside = re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S), 0, 0, 0
    while m := STYLE_MARK.search(style, at):
        mark, at = m[0], m.end()
        if mark in "\"'":
            at = style.find(mark, at) + 1 or len(style)
        elif mark != ";":
            inside = max(0, inside + (1 if mark == "(" else -1))
        elif not inside:
            yield style[begin : at - 1]
            begin = at
    yield style[begin:]


def styles_of(style: str) -> dict[str, str]:
    """display and visibility as a style attribute leaves them."""
    found: dict[str, tuple[bool, str]] = {}
    for one in declarations(style):
        name, _, value = one.partition(":")
        name, (value, bang, _) = name.strip().lower(), value.strip().lower().partition("!")
        if name in ("display", "visibility") and value and (bang or not found.get(name, (False,))[0]):
            found[name] = bool(bang), value.strip()
    return {k: v for k, (_, v) in found.items()}


def parse(html: str) -> Box:
    """The tree of what is visible; strings are text."""
    root, tags = Box("html"), Tags(html)
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag, the root left out

    def push(box: Box) -> None:
        places.setdefault(box.tag, []).append(len(stack))
        stack.append(box)

    def pop(k: int) -> None:
        for box in stack[k:]:
            places[box.tag].pop()
        del stack[k:]

    def close(kinds: frozenset, within: frozenset) -> None:
        """Ends the innermost open element of these kinds unless one of `within` lies inside it."""
        k = max((found[-1] for t in kinds if (found := places.get(t))), default=0)
        if k == 0:
            return
        if len(stack) - k <= len(within):
            barred = any(b.tag in within for b in stack[k + 1 :])
        else:
            barred = any(found[-1] > k for t in within if (found := places.get(t)))
        if not barred:
            pop(k)

    def text(raw: str) -> None:
        if stack[-1].visible:
            stack[-1].children.append(decoded(raw))

    while at < len(html):
        found = tags.next(at)
        if found is None:
            text(html[at:])
            break
        begin, end, closing, tag, attributes = found
        if begin > at:
            text(html[at:begin])
        at = end
        if tag is None:
            continue
        if closing:
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Box("p"))
            outer = SCOPES if tag in HOLDERS else frozenset() if tag in SCOPES or tag in ("tr", "tbody", "thead", "tfoot") else SCOPES if tag in BLOCKS else SCOPES | BLOCKS
            close(frozenset((tag, "svg " + tag)), outer)
            continue
        if tag in RAW or tag in UNSEEN & VOID:
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                at = _past(html, at, tag, tags.last)
            continue
        if stack[-1].foreign and tag in BREAKS_OUT:
            k = len(stack)
            while stack[k - 1].foreign:
                k -= 1
            pop(k)
        if tag in BLOCKS:
            close(frozenset("p"), SCOPES)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag == "head":
            push(Box("head"))  # what it may hold is unseen by itself
            root.children.append(stack[-1])
            continue
        start = START.search(attributes) if tag == "ol" else None
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Box("tr")
            row.shown, row.visible = stack[-1].shown, stack[-1].visible
            stack[-1].children.append(row)
            if len(stack) < DEEPEST:
                push(row)
        known, above = attributes_of(attributes), stack[-1]
        style = styles_of(known.get("style", ""))
        box = Box(tag, int(start[1]) if start else 1, known)
        box.foreign = tag in ("svg", "math") or above.foreign and tag not in HTML_INSIDE
        if box.foreign and tag == "text":
            box.tag = "svg text"
        hides = tag in UNSEEN or above.foreign and tag in UNSEEN_THERE or known.get("aria-hidden", "").strip().lower() == "true"
        hides = hides or style.get("display", "none" if "hidden" in known and tag != "option" else "") == "none" or tag == "dialog" and "open" not in known
        box.shown = above.shown and not hides
        box.visible = style["visibility"] == "visible" if style.get("visibility") in ("visible", "hidden", "collapse") else above.visible
        if box.shown:
            above.children.append(box)
        if tag == "textarea":
            end = re.compile(r"</textarea(?=[\s/>])[^>]*>", re.I).search(html, at, tags.last + 1)
            if box.visible:
                box.children.append(decoded(html[at : end.start() if end else len(html)].removeprefix("\n")))
            at = end.end() if end else len(html)
            continue
        if (box.foreign or above.foreign) and attributes.endswith("/"):
            continue
        # What is hidden is not rendered, but tags are matched in it as elsewhere, so that it ends where it should.
        if tag not in VOID and len(stack) < (DEEPEST if box.shown else DEEPEST_HIDDEN):
            push(box)
    return root


def _past(html: str, at: int, tag: str, last: int) -> int:
    """Behind the end of an element that is not shown, of which no tag ends after `last`. Templates may nest; in the others all but the end tag is text."""
    pattern, depth = re.compile(rf"<({'/?' if tag == 'template' else '/'}){tag}(?=[\s/>])[^>]*>", re.I), 1
    for m in pattern.finditer(html, at, last + 1):
        depth += -1 if m[1] else 1
        if depth == 0:
            return m.end()
    return len(html)


def width(text: str) -> int:
    """Columns that the text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def wrapped(line: str) -> list[str]:
    """line in pieces of at most WIDEST columns, broken at spaces where there are some, else anywhere but before a combining mark."""
    if len(line) <= WIDEST // 2 or width(line) <= WIDEST:
        return [line]
    pieces, begin, space, columns = [], 0, -1, 0
    for k, c in enumerate(line):
        w = width(c)
        if columns + w > WIDEST and k > begin:
            if c == " ":
                pieces.append(line[begin:k])
                begin, columns = k + 1, 0
                continue
            cut = space if space > begin else k
            pieces.append(line[begin:cut])
            begin = cut + (cut < k)
            columns = width(line[begin:k])
        columns += w
        if c == " ":
            space = k
    return [p.rstrip() for p in [*pieces, line[begin:]]]


class Layout:
    """Lines so far; the line that is open; empty lines that the next text is due."""

    def __init__(self):
        self.lines, self.line, self.due, self.space = [], [], 0, False

    def end(self, empty: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.due, self.space = max(self.due, empty), False

    def text(self, text: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.lines.append("".join(self.line).rstrip())
                    self.line = []
                if part:
                    self._put(part)
            return
        words = SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if not words:
            return
        self._put((" " if self.space and self.line else "") + words.rstrip(" "))
        self.space = words.endswith(" ")

    def _put(self, text: str) -> None:
        if not self.line and self.due and self.lines:
            self.lines.extend([""] * self.due)
        self.due = 0
        self.line.append(text)
        self.space = False


def _cells(table: Box) -> Iterator[list[Box]]:
    for child in table.children:
        if isinstance(child, Box) and child.tag in ("thead", "tbody", "tfoot"):
            yield from _cells(child)
        elif isinstance(child, Box) and child.tag == "tr":
            yield [c for c in child.children if isinstance(c, Box) and c.tag in ("td", "th")]


def _outside_cells(box: Box) -> Iterator[Box | str]:
    """What stands in a table but in no cell: captions and stray content, in order."""
    for child in box.children:
        if isinstance(child, Box) and child.tag in ("thead", "tbody", "tfoot", "tr"):
            yield from _outside_cells(child)
        elif isinstance(child, str) or child.tag not in ("td", "th"):
            yield child


def _table(box: Box, out: Layout, depth: int) -> None:
    for child in _outside_cells(box):
        _render(child, out, False, depth) if isinstance(child, Box) else out.text(child, False)
    out.end()
    rows = [[[x for line in _lines(cell, depth) for x in wrapped(line)] for cell in row] for row in _cells(box)]
    columns = max(map(len, rows), default=0)
    widths = [0] * columns
    for row in rows:
        for k, lines in enumerate(row):
            widths[k] = max(widths[k], max(map(width, lines), default=0))
    for row in rows:
        height, held = max(map(len, row), default=0), sum(len(x) - x.count(" ") for lines in row for x in lines)
        if height * (sum(widths[: len(row)]) + 2 * len(row)) > PADDED * (held + len(row)):
            aligned = (x for lines in row for x in lines)
        else:
            aligned = ("  ".join(x + " " * (widths[k] - width(x)) for k, lines in enumerate(row) for x in [lines[i] if i < len(lines) else ""]) for i in range(height))
        for line in map(str.rstrip, aligned):
            if line:
                out.text(line, True)
                out.end()


def _lines(box: Box, depth: int) -> list[str]:
    inner = Layout()
    for child in box.children:
        _render(child, inner, False, depth) if isinstance(child, Box) else inner.text(child, False)
    inner.end()
    return inner.lines


def _is_list(select: Box) -> bool:
    """Whether all options are shown, not only the chosen one."""
    size = select.attributes.get("size", "").strip()
    return "multiple" in select.attributes or size.isdecimal() and int(size) > 1


def _options(select: Box) -> list[Box]:
    """The options that are shown."""
    found = []
    for child in select.children:
        if isinstance(child, Box):
            off = child.tag == "optgroup" and "disabled" in child.attributes
            found += [(o, off or "disabled" in o.attributes) for o in ([child] if child.tag == "option" else child.children) if isinstance(o, Box) and o.tag == "option"]
    if _is_list(select):
        return [o for o, _ in found if "hidden" not in o.attributes]
    chosen = [o for o, _ in found if "selected" in o.attributes][-1:]
    return chosen or [o for o, off in found if not off][:1]


def _render(box: Box, out: Layout, pre: bool, depth: int) -> None:
    tag = box.tag
    if tag == "br":
        out.lines.append("".join(out.line).rstrip()) if out.line else None
        out.line, out.space = [], False
        return
    if tag in ("svg text", "textarea") or tag == "select" and _is_list(box):
        out.end()
    gap = (1 if tag in PARAGRAPHS and not (depth and tag in ("ul", "ol", "p")) else 0) if tag in BLOCKS else -1
    if gap >= 0:
        out.end(gap)
    if tag == "table":
        _table(box, out, depth)
    elif tag in ("ul", "ol", "menu"):
        n = box.start
        for child in box.children:
            if isinstance(child, str):
                out.text(child, pre)
            elif child.tag == "li":
                mark = f"{n}. " if tag == "ol" else "- "
                n += 1
                for k, line in enumerate(_lines(child, depth + 1)):
                    out.text((mark if k == 0 else " " * len(mark) if depth < INDENTED else "") + line if line else "", True)
                    out.end()
            else:
                _render(child, out, pre, depth + 1)
    elif tag == "select":
        out.space = True
        for option in _options(box):
            for child in option.children:
                _render(child, out, pre, depth) if isinstance(child, Box) else out.text(child, pre)
            if _is_list(box):
                out.end()
        out.space = True
    else:
        pre = pre or tag in ("pre", "textarea")
        closed = tag == "details" and "open" not in box.attributes
        for child in [c for c in box.children if isinstance(c, Box) and c.tag == "summary"][:1] if closed else box.children:
            _render(child, out, pre, depth) if isinstance(child, Box) else out.text(child, pre)
        if tag in ("td", "th"):
            out.space = True
    if gap >= 0 or tag in ("svg text", "textarea"):
        out.end(max(gap, 0))


def render(html: str | None) -> str:
    if not html:
        return ""
    out = Layout()
    _render(parse(html.replace("\r\n", "\n").replace("\x00", "")), out, False, 0)
    out.end()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines, n_chars: one row for each row of pages."""
    narrow = pages.select(pages[id_col].alias("page_id"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x.as_py()) for x in b.column(1)], pa.string())], names=["page_id", "text"])

    text = narrow.mapInArrow(run, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return text.select("page_id", "text", lines.cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
