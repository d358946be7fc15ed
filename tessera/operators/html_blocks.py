"""Web pages as blocks: headings, paragraphs, list items, tables, images and code, with their places in the page's text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.operators.chunkers import MAX_HEADING, in_groups

#: Fixed values of HTML: elements that begin and end blocks, elements without content of their own, and elements whose content isn't shown.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu meta nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template title noscript textarea select object iframe".split())
MAX_COLSPAN = 1000
#: A table whose spans make it so many times larger than its cells is hostile; its cells then count as one place each.
MAX_GRID = 64
GAP = "\n\n"

BLOCK = ArrayType(StructType([*(StructField(c, StringType()) for c in ("kind", "caption", "text")), *(StructField(c, LongType()) for c in ("char_start", "char_end"))]))

_SPACE = re.compile(r"[ \t\n\r\f]+")


def _lines(parts: list[str]) -> str:
    """The text of parts whose white space counts once; a None-like part ``\\0`` is a line's end. Blank lines go."""
    text = _SPACE.sub(" ", "".join(parts))
    return "\n".join(line for line in (part.strip(" ") for part in text.split("\0")) if line)


def _count(value: str | None, most: int) -> int:
    digits = re.match(r"\s*(\d{1,6})", value or "")
    return min(max(int(digits[1]), 1), most) if digits else 1


class _Table:
    """Rows of an open table, as cells (text, columns, rows)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []
        self.caption = ""
        self.parts: list[str] | None = None
        self.in_caption = False
        self.spans = (1, 1)

    def row(self) -> None:
        self.cell_end()
        self.rows.append([])

    def cell(self, columns: int, rows: int) -> None:
        self.cell_end()
        if not self.rows:
            self.row()
        self.parts, self.spans = [], (columns, rows)

    def cell_end(self) -> None:
        if self.parts is None:
            return
        text, self.parts = _lines(self.parts).replace("\n", " "), None
        if self.in_caption:
            self.caption, self.in_caption = text, False
        else:
            self.rows[-1].append((text, *self.spans))

    def texts(self) -> list[str]:
        self.cell_end()
        return [text for row in self.rows for text, _, _ in row if text]

    def grid(self) -> list[list[str]]:
        """Texts by row and column. A cell's text stands in the first of its places; the others are empty."""
        rows = [r for r in self.rows if r]
        room = MAX_GRID * sum(map(len, rows))
        grid: list[list[str]] = []
        below: dict[int, int] = {}
        for cells in rows:
            line: list[str] = []
            left = {c: n - 1 for c, n in below.items() if n > 1}
            for text, columns, down in cells:
                while below.get(len(line)):
                    line.append("")
                if down > 1:
                    left |= {len(line) + c: down - 1 for c in range(columns)}
                line += [text, *[""] * (columns - 1)]
            room -= len(line) + len(left)
            if room < 0:
                return [[text for text, _, _ in r] for r in rows]
            grid.append(line)
            below = left
        return grid

    def markdown(self) -> str:
        """The rows with bars, a rule below the first, which is made as wide as the widest. Empty if no cell has a text."""
        if not self.texts():
            return ""
        grid = self.grid()
        width = max(map(len, grid))
        grid[0] += [""] * (width - len(grid[0]))
        lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in grid]
        return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class PageParser(HTMLParser):
    """Collects (kind, caption, text) of a page's blocks, in order.

    It keeps a stack of open lists and one of open tables, so that unclosed and misplaced tags do no harm: a block
    ends where the next begins. The text of a table inside a table's cell belongs to that cell.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str | None, str]] = []
        self.parts: list[str] = []
        self.level = 0
        self.lists: list[int | None] = []
        self.mark = ""
        self.code = False
        self.tables: list[_Table] = []
        self.hidden: list[str] = []

    def flush(self) -> None:
        text = "".join(self.parts).strip("\n\r") if self.code else _lines(self.parts)
        self.parts = []
        if not text.strip():
            return
        if self.code:
            # Blank lines would part the block's text.
            self.add("text", None, "```\n" + re.sub(r"\n\s*\n", "\n", text.replace("\r\n", "\n")).rstrip() + "\n```")
        elif self.level:
            title = text.replace("\n", " ")
            self.add("heading", title[:MAX_HEADING], "#" * self.level + " " + title)
        else:
            self.add("text", None, self.mark + text)
            self.mark = ""

    def add(self, kind: str, caption: str | None, text: str) -> None:
        self.blocks.append((kind, caption or None, text))

    def end_table(self) -> None:
        table = self.tables.pop()
        if self.tables:
            self.text(f" {table.caption} {' '.join(table.texts())} ")
        elif text := table.markdown():
            self.add("table", table.caption[:MAX_HEADING], text)
        elif table.caption:
            self.add("text", None, table.caption)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden or tag in HIDDEN:
            if tag in HIDDEN:
                self.hidden.append(tag)
            return
        found = dict(attrs)
        table = self.tables[-1] if self.tables else None
        if tag == "table":
            if not table:
                self.flush()
            self.tables.append(_Table())
        elif table and tag in ("tr", "td", "th", "caption"):
            if tag == "tr":
                table.row()
            elif tag == "caption":
                table.cell_end()
                table.parts, table.in_caption = [], True
            else:
                table.cell(_count(found.get("colspan"), MAX_COLSPAN), _count(found.get("rowspan"), 65534))
        elif tag == "img":
            self.image(found)
        elif tag == "br":
            self.text("\n" if self.code else "\0")
        elif table:
            if tag in BLOCKS:
                self.text(" ")
        elif tag in BLOCKS:
            self.flush()
            self.open(tag, found)

    def open(self, tag: str, found: dict[str, str | None]) -> None:
        if tag in ("ul", "ol", "menu"):
            self.lists.append(_count(found.get("start"), 10**6) if tag == "ol" else None)
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            self.mark = "  " * (len(self.lists) - 1) + ("- " if number is None else f"{number}. ")
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "pre":
            self.code = True
        if tag[0] == "h" and tag[1:].isdigit():
            self.level = int(tag[1])

    def image(self, found: dict[str, str | None]) -> None:
        """An image with a source is a block; in a cell, it is its alternative text."""
        alt = _SPACE.sub(" ", found.get("alt") or "").strip(" ").replace("[", "(").replace("]", ")")
        if self.tables:
            self.text(f" {alt} ")
        elif (found.get("src") or "").strip():
            self.flush()
            self.add("image", alt, f"![{alt}]({_SPACE.sub('%20', found['src'].strip())})")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if self.tables:
            if tag == "table":
                self.end_table()
            elif tag in ("td", "th", "tr", "caption"):
                self.tables[-1].cell_end()
            elif tag in BLOCKS:
                self.text(" ")
        elif tag in BLOCKS and tag not in VOID:
            self.flush()
            if tag == "pre":
                self.code = False
            elif tag == "li":
                self.mark = ""
            elif tag in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
            if tag[0] == "h" and tag[1:].isdigit():
                self.level = 0

    def text(self, data: str) -> None:
        if not self.tables:
            self.parts.append(data)
        elif self.tables[-1].parts is not None:
            self.tables[-1].parts.append(data)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text(data.replace("\0", ""))


def page_blocks(html: str | None) -> Iterator[tuple[str, str | None, str, int, int]]:
    """(kind, caption, text, start, end) of a page's blocks; their texts joined by blank lines are the page's text."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    while parser.tables:
        parser.end_table()
    parser.flush()
    at = 0
    for kind, caption, text in parser.blocks:
        yield kind, caption, text, at, at + len(text)
        at += len(text) + len(GAP)


@F.arrow_udf(BLOCK)
def _blocks_of(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind, names = to_arrow_type(BLOCK), BLOCK.elementType.names
    for batch in pages:
        for part in in_groups(batch):
            yield pa.array([[dict(zip(names, b, strict=True)) for b in page_blocks(h)] for h in part.to_pylist()], kind)


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages without their html, once for each block: element_index, kind, caption, text, char_start, char_end.

    Kinds are heading, text, table and image. Scripts, styles, titles and comments aren't shown. Null, empty and blank pages have no blocks; nothing
    is shuffled. Columns of the pages that have the name of a result are dropped.
    """
    made = ("element_index", "kind", "caption", "text", "char_start", "char_end")
    kept = [c for c in pages.columns if c != html and c not in made]
    found = pages.select(*(F.col(f"`{c}`") for c in kept), F.posexplode(_blocks_of(F.col(html))).alias("_place", "_block"))
    return found.select(*(F.col(f"`{c}`") for c in kept), F.col("_place").cast("long").alias("element_index"), "_block.kind", "_block.caption", "_block.text", "_block.char_start", "_block.char_end")


def html_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with their text in place of the html; empty if there are no blocks."""
    kept = [f"`{c}`" for c in pages.columns if c not in (html, "text")]
    return pages.select(*kept, F.array_join(F.transform(_blocks_of(F.col(html)), lambda b: b["text"]), GAP).alias("text"))
