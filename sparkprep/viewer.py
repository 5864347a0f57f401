"""Paging, cells and details of tables as text."""

from __future__ import annotations

import datetime as dt
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.core import materialize, with_row_id
from sparkprep.errors import IndexOutOfBounds
from sparkprep.operators import rows as ops


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def truncate(text: str, most: int) -> str:
    if width(text) <= most:
        return text
    out, used = "", 0
    for c in text:
        if used + width(c) > most - 3:
            break
        out, used = out + c, used + width(c)
    return out + "..."[: max(0, most)]


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.2f}" if abs(value) < 1e15 else f"{value:e}"
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes>"
    if isinstance(value, dict) or hasattr(value, "asDict"):
        return "<struct>"
    if isinstance(value, (list, tuple)):
        return "<list>"
    return value.isoformat(" ") if isinstance(value, dt.datetime) else str(value)


@dataclass
class Scroll:
    """Which of ``total`` rows a window of ``visible`` shows, and the selected one."""

    total: int
    visible: int
    offset: int = 0
    selected: int | None = None

    @property
    def last(self) -> int:
        return max(0, self.total - self.visible)

    def move(self, by: int) -> None:
        self.offset = min(self.last, max(0, self.offset + by))

    def page(self, pages: int) -> None:
        self.move(pages * self.visible)

    def home(self) -> None:
        self.offset = 0

    def end(self) -> None:
        self.offset = self.last

    def select(self, row: int | None) -> None:
        """Select a row, within the table, and bring it into view."""
        self.selected = None if row is None or not self.total else min(self.total - 1, max(0, row))
        if self.selected is not None:
            self.show(self.selected)

    def step(self, by: int) -> None:
        self.select(0 if self.selected is None else self.selected + by)

    def show(self, row: int) -> None:
        self.offset = min(self.last, max(row - self.visible + 1, min(self.offset, row), 0))

    def shows(self, row: int) -> bool:
        return self.offset <= row < min(self.total, self.offset + self.visible)

    def bar(self) -> tuple[float, float] | None:
        """(place, size) of the scroll bar, as shares; None if all rows are in view."""
        return (self.offset / self.last, self.visible / self.total) if self.total > self.visible else None


class SchemaInspector:
    """The columns of a table as lines of text."""

    def __init__(self, df: DataFrame, most: int = 80):
        self.fields, self.most = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], most

    def lines(self) -> list[str]:
        wide = [max([len(title), *(width(f[i]) for f in self.fields)]) for i, title in enumerate(("column", "type"))]
        rows = [("column", "type", "null"), *((n, t, "yes" if null else "no") for n, t, null in self.fields)]
        return [truncate(" | ".join((n + " " * (wide[0] - width(n)), t + " " * (wide[1] - width(t)), null)), self.most) for n, t, null in rows]


class Viewer:
    """Pages through a table in an order; only the rows of a page are fetched."""

    def __init__(self, df: DataFrame, order_by: str, page: int = 20):
        self.columns, self.page, self.order = df.columns, page, order_by
        self._rows = materialize(with_row_id(df, order_by))
        self.df, self.total = df, self._rows.count()
        self.scroll = Scroll(max(self.total, 1), 1)

    def rows(self, start: int, count: int) -> list:
        got = self._rows.filter(F.col("_row_id").between(start, start + count - 1)).collect()
        return sorted(got, key=lambda r: r["_row_id"])

    @property
    def at(self) -> int:
        return self.scroll.offset

    def move(self, by: int) -> None:
        self.scroll.move(by)

    def down(self) -> None:
        self.move(self.page)

    def up(self) -> None:
        self.move(-self.page)

    def find(self, text: str) -> int | None:
        hit = ops.search(self.df, text, self.order, self.at)
        if hit is not None:
            self.move(hit - self.at)
        return hit

    def render(self, most: int = 24) -> str:
        rows = [[truncate(cell(r[c]), most) for c in self.columns] for r in self.rows(self.at, self.page)]
        wide = [max([width(c), *(width(r[i]) for r in rows)]) for i, c in enumerate(self.columns)]
        line = lambda cells: " | ".join(x + " " * (w - width(x)) for x, w in zip(cells, wide, strict=True)).rstrip()
        return "\n".join([line(self.columns), "-+-".join("-" * w for w in wide), *map(line, rows), f"rows {min(self.at + 1, self.total)}-{min(self.at + self.page, self.total)} of {self.total}"])

    def detail(self, i: int) -> str:
        got = self.rows(i, 1)
        if not got:
            raise IndexOutOfBounds(f"no row {i}")
        return "\n".join(f"{c}: {cell(got[0][c])}" for c in self.columns)
