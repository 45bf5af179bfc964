"""HTML extraction: a tree with implied tags, rendered to text as a browser lays it out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_IN_VALUE = re.compile(r"=\s*[^\s\"'>]+/$")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))(?![\w-])", re.I)
#: What the start of a list may be; anything else counts as 1.
_START = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
#: Inputs that don't show their value as text.
_NO_TEXT = {"hidden", "password", "checkbox", "radio", "file", "image", "color", "range"}

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"script", "style", "head", "template", "noscript", "iframe", "noembed", "noframes", "object", "datalist", "audio", "video", "canvas", "title", "dialog"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "hr", "fieldset", "menu", "dir"}
BLOCKS = SPACED | {
    "html", "body", "div", "article", "aside", "section", "nav", "header", "footer", "main", "address", "form", "li", "dt", "dd",
    "tr", "thead", "tbody", "tfoot", "caption", "details", "summary", "figcaption", "center", "hgroup", "search", "legend",
}
#: Elements of svg and math that show nothing, those whose content is HTML, and those that stand apart from what is before them.
UNDRAWN = {
    "svg": {"defs", "symbol", "clippath", "mask", "pattern", "marker", "desc", "metadata", "lineargradient", "radialgradient", "filter"},
    "math": {"annotation", "annotation-xml", "mphantom"},
}
HTML_INSIDE = {"svg": {"foreignobject", "desc", "title"}, "math": {"mi", "mo", "mn", "ms", "mtext", "annotation-xml"}}
APART = {"text", "foreignobject", "mtr", "mtd"}
#: Start tags that end open svg and math.
BREAK_OUT = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup",
    "table", "tt", "u", "ul", "var",
}
#: Start tag: the open elements it ends, and those that stop the search for them.
_ITEM, _ROW, _TABLE = {"ul", "ol", "menu", "dir"}, {"table"}, {"table"}
ENDS = {
    "li": ({"li"}, _ITEM), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, _ROW), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, _TABLE), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, _TABLE),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, _TABLE), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "input": ({"select"}, _TABLE), "textarea": ({"select"}, _TABLE), "select": ({"select"}, _TABLE), "body": ({"head"}, set()),
}
_P = ({"p"}, {"table", "td", "th", "caption", "button", "object", "template", *HTML_INSIDE["svg"], *HTML_INSIDE["math"]})
#: Elements beyond which an end tag finds no start tag.
_FENCES = {"table", "td", "th", "caption", "foreignobject"}
DEEPEST_TABLE = 20
#: Columns of a cell at most (as in browsers), and those that a cell of several rows keeps empty below it; no text hangs on it.
WIDEST = 1000


class Node:
    """``inside`` is what the content belongs to: svg (or text in it), math, or nothing for HTML."""

    __slots__ = ("tag", "attributes", "children", "inside")

    def __init__(self, tag: str, attributes: dict[str, str], inside: str = ""):
        self.tag, self.attributes, self.children, self.inside = tag, attributes, [], inside


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


def parse(html: str) -> Node:
    """The tree of a page. End tags that may be left out are implied; a stray end tag is ignored
    (but ``</p>`` and ``</br>`` break the line); what stays open ends with the page."""
    root = Node("html", {})
    stack, at = [root], 0

    def close(ended: set[str], stops: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ended:
                del stack[depth:]
                return
            if stack[depth].tag in stops:
                return

    def add(text: str) -> None:
        text = unescape(text) if "&" in text else text
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            stack.pop()
        if text and stack[-1].inside != "svg":
            stack[-1].children.append(text)

    def foreign(tag: str, attributes: str) -> None:
        """Opens an element of svg or math, or svg or math itself."""
        inside = stack[-1].inside
        kind = inside.partition(" ")[0] or tag
        node = Node(tag, _attributes(attributes))
        if tag in UNDRAWN[kind] or node.attributes.get("display") == "none" or node.attributes.get("visibility") in ("hidden", "collapse"):
            node.attributes["hidden"] = ""
        if inside and tag in HTML_INSIDE[kind] and (tag != "annotation-xml" or "html" in node.attributes.get("encoding", "").lower()):
            node.inside = ""
        else:
            node.inside = "svg text" if inside == "svg" and tag == "text" else tag if tag in ("svg", "math") else inside
        if tag in APART or stack[-1].tag == "mfrac" and stack[-1].children:
            stack[-1].children.append(" ")
        stack[-1].children.append(node)
        if not attributes.endswith("/") or _IN_VALUE.search(attributes):
            stack.append(node)

    while (m := _MARKUP.search(html, at)) is not None:
        add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if stack[-1].inside and html.startswith("<![CDATA[", m.start()):
                end = html.find("]]>", m.start())
                text, at = html[m.start() + 9 : end if end >= 0 else len(html)], end + 3 if end >= 0 else len(html)
                add(text.replace("&", "&amp;"))
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if stack[-1].inside and (tag in ("p", "br") if ending else tag in BREAK_OUT or tag == "font" and {"color", "face", "size"} & _attributes(attributes).keys()):
            while stack[-1].inside:
                stack.pop()
        if ending:
            if tag in ("p", "br"):
                if tag == "br" or not any(n.tag == "p" for n in stack):
                    stack[-1].children.append(Node("br", {}))
            close({tag}, _FENCES - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        if tag == "html":
            continue
        if stack[-1].inside:
            foreign(tag, attributes)
            continue
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in BLOCKS:
            close(*_P)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        if tag != "title" and stack[-1].tag == "head" and tag not in ("meta", "link", "base", "script", "style", "noscript", "template"):
            stack.pop()
        if tag in ("svg", "math"):
            foreign(tag, attributes)
            continue
        node = Node(tag, _attributes(attributes) if attributes.strip(" /\n\t") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            text = html[at : end.start() if end else len(html)]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else len(html)
        elif tag not in VOID:
            stack.append(node)
    add(html[at:])
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN and not (node.tag == "dialog" and "open" in node.attributes):
        return False
    if not node.attributes:
        return True
    style = node.attributes.get("style", "")
    return not ("hidden" in node.attributes or style and _HIDDEN_STYLE.search(style))


class _Page:
    """Lines of text; ``gap`` is how many line ends are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.indent, self.marker, self.some = 0, False, "", "", False

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first, True)
            for line in rest:
                self.end()
                self._put(line, True)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and self.line:
            self.space = True
        if body := text.strip(" "):
            self._put((" " if self.space and self.line else "") + body, False)
            self.space = text.endswith(" ")

    def _put(self, text: str, keep: bool) -> None:
        if not text:
            return
        if not self.line:
            if self.gap > 1 and self.some:
                self.lines.append("")
            self.gap = 0
            text = self.indent[: len(self.indent) - len(self.marker)] + self.marker + text if self.marker else self.indent + text
            self.marker = ""
        self.line.append(text)
        self.some = True

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, 2 if spaced else 1)

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _span(cell: Node, name: str, most: int) -> int:
    text = cell.attributes.get(name, "")
    return 1 if not text.isdecimal() else most if len(text) > 9 else min(int(text), most)


def _shown(select: Node) -> list[str]:
    """What a select shows: its chosen option, the last if several, else the first that can be; of a list box everything."""
    options: list[tuple[Node, bool]] = []
    waiting = [(child, False) for child in reversed(select.children)]
    while waiting:
        node, off = waiting.pop()
        if isinstance(node, str):
            continue
        off = off or "disabled" in node.attributes
        if node.tag in ("option", "optgroup"):
            options.append((node, off))
        if node.tag != "option":
            waiting += ((child, off) for child in reversed(node.children))
    if "multiple" not in select.attributes and _span(select, "size", 9) <= 1:
        options = [x for x in options if x[0].tag == "option"]
        chosen = [x for x in options if "selected" in x[0].attributes][-1:]
        options = chosen or [x for x in options if not x[1] and visible(x[0])][:1]
    texts = []
    for node, _ in options:
        if visible(node):
            label = unescape(node.attributes.get("label", ""))
            texts.append(label if label or node.tag == "optgroup" else _words(node))
    return texts


def _words(option: Node) -> str:
    parts, waiting = [], [*reversed(option.children)]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            parts.append(node)
        elif visible(node):
            waiting += reversed(node.children)
    return " ".join("".join(parts).split())


def _table(node: Node, depth: int) -> list[str]:
    """The rows of a table, cells padded to the width of their column; below a cell of several rows its columns stay empty."""
    rows: list[list[str]] = []
    captions, waiting = [], [*reversed(node.children)]
    number, taken = 0, {}  # of the row, and by column the last row that a cell above reaches
    while waiting:
        child = waiting.pop()
        if child is None:  # the end of a group of rows
            taken = {}
        elif isinstance(child, str):
            if child.strip():
                captions.append(_SPACE.sub(" ", child).strip())
        elif not visible(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            taken = {}
            waiting += [None, *reversed(child.children)]
        elif child.tag == "tr":
            cells: list[str] = []
            number += 1
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip():
                        cells.append(_SPACE.sub(" ", cell).strip())
                elif visible(cell):
                    while taken.get(len(cells), 0) >= number:
                        cells.append("")
                    wide, high = _span(cell, "colspan", WIDEST), _span(cell, "rowspan", 65534) or 65534
                    if high > 1:
                        taken |= dict.fromkeys(range(len(cells), min(len(cells) + max(wide, 1), WIDEST)), number + high - 1)
                    cells.append(" ".join(x for x in render(cell, depth + 1).split("\n") if x))
                    cells += [""] * (wide - 1)
            if any(cells):
                rows.append(cells)
        else:
            text = render(child, depth + 1)
            captions += [text] if text else []
    widths = [max(len(row[n]) for row in rows if n < len(row)) for n in range(max(map(len, rows), default=0))]
    return [*captions, *("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip(" ") for row in rows)]


def render(root: Node, depth: int = 0) -> str:
    """All visible text below root. Blocks start lines, paragraphs and the like stand apart by an empty
    line, list items are indented and marked, cells of a table row share a line. Tables nested more than
    ``DEEPEST_TABLE`` deep are laid out as plain blocks."""
    page = _Page()
    work: list = [(root, False)]
    numbers: list[int | None] = []
    keeping = 0
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            page.text(node, keeping > 0)
            continue
        tag = node.tag
        if leaving:
            if tag in ("pre", "textarea"):
                keeping -= 1
            elif tag in ("ul", "ol", "menu", "dir"):
                numbers.pop()
            elif tag == "li":
                page.end()
                page.indent, page.marker = page.indent[:-node.attributes["\0width"]], ""
            elif tag == "dd":
                page.end()
                page.indent = page.indent[:-2]
            elif tag == "svg":
                page.text(" ", False)
            if tag in BLOCKS:
                page.block(tag in SPACED and not (numbers and tag in ("ul", "ol", "menu", "dir")))
            continue
        if node is not root and not visible(node):
            continue
        if tag == "br":
            if not page.line:
                page.gap = max(page.gap, 2)
            page.end()
            continue
        if tag == "img":
            if alt := node.attributes.get("alt", "").strip():
                page.text(f" {unescape(alt)} ", False)
            continue
        if tag == "input":
            if node.attributes.get("type", "text").strip().lower() not in _NO_TEXT:
                page.text(f" {unescape(node.attributes.get('value', ''))} ", False)
            continue
        if tag == "select":
            for text in _shown(node):
                page.text(f" {text} ", False)
            continue
        if tag == "svg":
            page.text(" ", False)
        if tag in ("td", "th") and depth >= DEEPEST_TABLE:
            page.text(" ", False)
        if tag in BLOCKS and node is not root:
            page.block(tag in SPACED and not (numbers and tag in ("ul", "ol", "menu", "dir")))
        if tag == "table" and depth < DEEPEST_TABLE:
            for line in _table(node, depth):
                for part in line.split("\n"):
                    page._put(part, True)
                    page.end()
            page.block(True)
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            start = _START.match(node.attributes.get("start", "1"))
            numbers.append((int(start[1]) if start else 1) if tag == "ol" else None)
        elif tag == "li":
            number = numbers[-1] if numbers else None
            page.marker = "- " if number is None else f"{number}. "
            if number is not None:
                numbers[-1] = number + 1
            node.attributes["\0width"] = len(page.marker)
            page.indent += " " * len(page.marker)
        elif tag == "dd":
            page.indent += "  "
        elif tag in ("pre", "textarea"):
            keeping += 1
        work.append((node, True))
        work += ((child, False) for child in reversed(node.children))
    return page.done()


def extract(html: str | None) -> str:
    """The visible text of a page; empty for null or empty input."""
    return render(parse(html)) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html.as_py()) for html in batch.column(1)]
        lengths, lines = [len(t) for t in texts], [t.count("\n") + bool(t) for t in texts]
        columns = [batch.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(lengths, pa.int64()), pa.array(lines, pa.int64())]
        yield pa.record_batch(columns, names=["page_id", "text", "n_chars", "n_lines"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every row of pages (page_id, html).

    Malformed markup is read as a browser would: nothing visible is lost. Text in svg and
    math comes in the order of the source; a select gives the options that it shows. Null or
    empty html gives an empty text; repeated rows and null ids are kept; other
    columns are ignored.
    """
    return pages.select("page_id", "html").mapInArrow(_extract, "page_id long, text string, n_chars long, n_lines long")
