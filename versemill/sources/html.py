"""Rendered lines and metadata of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

# Elements that end a line, elements whose text is not shown, metadata that is kept.
BLOCKS = {"p", "div", "li", "pre", "blockquote", "h1", "h2", "h3", "h4", "article", "section", "br"}
HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "svg"}
META = {"author", "article:author", "article:published_time", "date", "datepublished", "og:title"}

SCHEMA = StructType([StructField("lines", ArrayType(StringType())), StructField("meta", MapType(StringType(), StringType()))])


_EDGE = "\x00"


class _Pieces(HTMLParser):
    """What a page consists of, in order: (step, text, given), where step is 1 for an element opened, -1 for one
    closed and 0 for text; elements have their name as text."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, list]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append((1, tag, attrs))

    def handle_endtag(self, tag):
        self.found.append((-1, tag, []))

    def handle_data(self, data):
        self.found.append((0, data.replace(_EDGE, ""), []))


def _depths(pieces: list[tuple[int, str, list]]) -> Iterator[int]:
    """How many hidden elements are open at each piece; a closing tag too many counts nothing."""
    steps = (step if step and name in HIDDEN else 0 for step, name, _ in pieces)
    return islice(accumulate(steps, lambda depth, step: max(0, depth + step), initial=0), 1, None)


def _named(given: list) -> tuple[str, str | None]:
    values = dict(given)
    return (values.get("name") or values.get("property") or "").lower(), values.get("content")


def rendered(html: str | None) -> dict | None:
    """lines and meta of one page; null for null.

    The shown text is put together with a mark at each edge of a block and then cut at the marks.
    """
    if html is None:
        return None
    pieces = _Pieces(html).found
    shown = [p for p, depth in zip(pieces, _depths(pieces)) if depth == 0]
    edges = lambda step, name: name in BLOCKS and (step > 0 or name != "br")
    text = "".join(x if step == 0 else _EDGE for step, x, _ in shown if step == 0 or edges(step, x))
    lines = [re.sub("[ \t\xa0]+", " ", line).strip() for line in text.split(_EDGE)]
    meta = dict((name, content.strip()) for name, content in (_named(given) for step, x, given in pieces if step > 0 and x == "meta") if name in META and content)
    return {"lines": [line for line in lines if line], "meta": list(meta.items())}


def _render(pages: pa.Array) -> pa.Array:
    kind = pa.struct([("lines", pa.list_(pa.string())), ("meta", pa.map_(pa.string(), pa.string()))])
    return pa.array([rendered(x) for x in pages.to_pylist()], kind)


_udf = F.arrow_udf(_render, SCHEMA)


def page_lines(df: DataFrame, html: str = "html") -> DataFrame:
    """`df` with `page`, the lines and metadata of its pages, and the title, author and date they name."""
    rows = df.withColumn("page", _udf(F.col(html)))
    meta = lambda *names: F.coalesce(*[F.col("page.meta")[n] for n in names])
    short = F.get(F.filter("page.lines", lambda x: F.length(x) < 180), F.lit(0))
    return rows.select("*", F.coalesce(meta("og:title"), short, F.lit("")).alias("title"), meta("author", "article:author").alias("author"), meta("article:published_time", "date", "datepublished").alias("published"))
