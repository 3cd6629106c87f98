"""Tables of HTML documents as rows."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def cells(document: Column, number: int = 0) -> Column:
    """Rows of the table of this number as lists of texts; none if there is no such table."""

    def run(page: str | None) -> list[list[str]]:
        p = _Tables()
        p.feed(page or "")
        return [r for r in p.tables[number] if r] if number < len(p.tables) else []

    return F.udf(run, "array<array<string>>", useArrow=True)(document)


def table(df: DataFrame, document: str, columns: list[str], number: int = 1, header_rows: int = 1) -> DataFrame:
    """The columns asked for (by the last header row's names) of a table of each document; lists of strings in, strings out."""
    all_ = df.select(cells(F.col(document), number).alias("c")).withColumn("h", F.element_at("c", header_rows))
    rows = all_.select("h", F.explode(F.slice("c", header_rows + 1, F.greatest(F.size("c") - header_rows, F.lit(0)))).alias("r"))
    return rows.select(*[F.get("r", F.array_position("h", c).cast("int") - 1).alias(c) for c in columns])
