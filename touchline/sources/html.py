"""HTML tables as rows of cells, from markup as it is found: unclosed cells and rows, stray ends, tables in tables, spans."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the HTML standard: spans beyond these count as these.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534
CELLS = "table int, table_id string, row int, column int, header boolean, section string, text string"


class _Table:
    def __init__(self, number: int, table_id: str | None):
        self.number, self.id = number, table_id
        self.row, self.section = -1, "body"
        self.held: dict[int, list] = {}  # column -> [rows still to fill, text, header]: what rowspans hold of the rows to come
        self.cells: list[tuple] = []
        self.column, self.open = 0, None  # open: (header, columns, rows, text pieces)

    def new_row(self) -> None:
        self.end_row()
        self.row, self.column = self.row + 1, 0

    def end_row(self) -> None:
        self.end_cell()
        if self.row >= 0:
            self._fill(None)

    def _put(self, column: int, header: bool, text: str) -> None:
        self.cells.append((self.number, self.id, self.row, column, header, self.section, text))

    def _fill(self, before: int | None) -> None:
        """Cells that earlier rows hold in this one: at the column the row has come to, or all that are left."""
        while self.held and (self.column in self.held if before is not None else any(c >= self.column for c in self.held)):
            column = self.column if before is not None else min(c for c in self.held if c >= self.column)
            rows, text, header = self.held[column]
            self._put(column, header, text)
            if rows > 1:
                self.held[column] = [rows - 1, text, header]
            else:
                del self.held[column]
            self.column = column + 1

    def begin_cell(self, header: bool, columns: int, rows: int) -> None:
        self.end_cell()
        if self.row < 0:
            self.new_row()
        self.open = (header, columns, rows, [[]])

    def end_cell(self) -> None:
        if self.open is None:
            return
        header, columns, rows, pieces = self.open
        self.open = None
        text = "".join("".join(p).strip() for p in pieces)
        for _ in range(columns):
            self._fill(0)
            self._put(self.column, header, text)
            if rows > 1:
                # takes effect from the next row on; this row has passed the column
                self.held[self.column] = [rows - 1, text, header]
            self.column += 1

    def new_section(self, name: str) -> None:
        self.end_row()
        self.held.clear()  # spans end with their section
        self.column, self.section = 10**9, name


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[_Table] = []
        self.stack: list[_Table] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.stack.append(_Table(len(self.tables), given.get("id")))
            self.tables.append(self.stack[-1])
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                t.new_row()
            elif tag in ("td", "th"):
                t.begin_cell(tag == "th", _span(given.get("colspan"), MOST_COLUMNS), _span(given.get("rowspan"), MOST_ROWS))
            elif tag in ("thead", "tbody", "tfoot"):
                t.new_section(tag[1:])
            elif t.open:
                t.open[3].append([])  # a new text node

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.stack:
            t = self.stack[-1]
            if tag == "table":
                t.end_row()
                self.stack.pop()
            elif tag in ("td", "th"):
                t.end_cell()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                t.end_row()
                t.column = 10**9
                if tag != "tr":
                    t.new_section("body")
            elif t.open:
                t.open[3].append([])

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].open and not self.silent:
            self.stack[-1].open[3][-1].append(data)

    def close(self) -> None:
        super().close()
        while self.stack:
            self.stack.pop().end_row()


def _span(value: str | None, most: int) -> int:
    """The number a span attribute begins with; 1 if it has none or says 0."""
    digits = ""
    for c in (value or "").strip():
        if not ("0" <= c <= "9"):
            break
        digits += c
    return min(max(1, int(digits[:9] or 1)), most)


def cells_of(html: str) -> list[tuple]:
    """All cells of all tables, as ``CELLS``, by table and row."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return [c for t in parser.tables for c in sorted(t.cells, key=lambda c: (c[2], c[3]))]


def tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and ``CELLS``: a row for each cell of each table of each page, spans laid out on the grid. A cell's text nodes are stripped and put
    together; a table within a cell is a table of its own. Pages without tables, and null ones, have no rows."""
    rows = pages.select(key, html).where(F.contains(F.lower(html), F.lit("<table")))
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(CELLS).fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for batch in batches:
            for k, page in zip(batch.column(0), batch.column(1)):
                found = cells_of(page.as_py())
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), shape[0].type), *[pa.array(c, f.type) for c, f in zip(columns, list(shape)[1:])]], schema=shape)

    return rows.mapInArrow(parse, schema)


def records(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """key, table, row, values: the body rows with data cells of each table as a map by the names in its head's cells (``column n`` without any)."""
    names = cells.where("section = 'head' and header").groupBy(key, "table", "column").agg(F.max_by("text", "row").alias("name"))
    body = cells.where("section = 'body' and not header").join(names, [key, "table", "column"], "left")
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.concat(F.lit("column "), F.col("column")))
    # of columns with one name the first counts
    first = body.groupBy(key, "table", "row", name.alias("name")).agg(F.min_by("text", "column").alias("text"))
    return first.groupBy(key, "table", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("values"))
