"""XML records and HTML tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import q
from plumbline.sources.names import unique_names

MAX_XML_DEPTH = 50
DTD_PATTERN = r"(?i)<!(DOCTYPE|ENTITY)"


def split_dtd(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose XML text is safe to parse, and rows rejected for DTD or entity declarations."""
    bad = F.coalesce(q(column).rlike(DTD_PATTERN), F.lit(False))
    return df.filter(~bad), df.filter(bad)


def find_row_tags(spark: SparkSession, path: str) -> list[str]:
    """Names of all children of the root elements, in text order. A file is parsed as a stream by one task."""

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.parsers import expat

        for batch in batches:
            found: set[str] = set()
            for text in batch["value"]:
                depth = [0]
                parser = expat.ParserCreate()

                def opened(name, _, depth=depth):
                    depth[0] += 1
                    if depth[0] == 2:
                        found.add(name)

                def closed(_, depth=depth):
                    depth[0] -= 1

                parser.StartElementHandler, parser.EndElementHandler = opened, closed
                parser.Parse(text.encode(), True)
            yield pd.DataFrame({"tag": sorted(found)}, dtype=object)

    # a declared encoding no longer holds: the text is read already
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s*<\?xml[^>]*\?>", "").alias("value"))
    found = sorted(r["tag"] for r in whole.mapInPandas(children, "tag string").distinct().collect())
    if not found:
        raise ValueError(f"no XML record found in {path!r}")
    return found


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Each ``row_tag`` element as a row of text columns; by default every child of the root, whatever its name
    (columns are joined by name)."""
    if not spark.read.text(path).filter(F.col("value").rlike(DTD_PATTERN)).isEmpty():
        raise ValueError("XML with DTD or entity declarations is not read; export plain elements")
    frames = []
    for tag in [row_tag] if row_tag else find_row_tags(spark, path):
        reader = spark.read.format("xml").option("rowTag", tag).option("inferSchema", False)
        reader = reader.option("attributePrefix", "@").option("valueTag", "#text")
        frames.append(flatten_xml(reader.load(path), tag))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flatten_xml(df: DataFrame, tag: str = "") -> DataFrame:
    """Nested XML rows as flat text columns: ``a_b`` for nesting, ``a_1, a_2`` for repeats, ``a@x`` for attributes."""
    leaves = list(_xml_leaves(df, df.columns, df.schema, lambda n: q(n), "", 1))
    if not leaves:
        return df
    out = []
    for col, name in leaves:
        own = name.strip("_")
        if own.startswith("@"):
            own = f"{tag}{own}"
        elif own == "#text" or own == "":
            own = tag or "value"
        out.append((col.cast("string"), own))
    names = unique_names([n for _, n in out])
    return df.select(*[c.alias(n) for (c, _), n in zip(out, names)])


def _xml_leaves(df, names, schema, get, prefix, depth):
    if depth > MAX_XML_DEPTH:
        raise ValueError("XML nesting is too deep to process")
    for field in schema.fields:
        if field.name not in names and names is not None:
            continue
        col = get(field.name)
        if field.name.startswith("@"):
            yield col, f"{prefix}{field.name}"
        elif field.name == "#text":
            yield col, prefix
        else:
            yield from _xml_value(df, col, field.dataType, f"{prefix}_{field.name}" if prefix else field.name, depth)


def _xml_value(df: DataFrame, col: Column, kind: T.DataType, name: str, depth: int):
    if isinstance(kind, T.ArrayType):
        size = F.size(col)
        bounds = df.agg(F.max(size).alias("most"), F.count_if(size == 1).alias("single")).first()
        if bounds["single"]:
            yield from _xml_value(df, F.when(size == 1, F.get(col, 0)), kind.elementType, name, depth + 1)
        for i in range(bounds["most"] if (bounds["most"] or 0) > 1 else 0):
            yield from _xml_value(df, F.when(size > 1, F.get(col, i)), kind.elementType, f"{name}_{i + 1}", depth + 1)
    elif isinstance(kind, T.StructType):
        yield from _xml_leaves(df, kind.names, kind, lambda n: col.getField(n), name, depth + 1)
    else:
        yield col, name


# pages of plain tags, quoted or bare attributes and text without references, whose tags a pattern finds as the parser does
_BLANK = r"[\t\n\r\f ]"
_ATTRIBUTE = rf"""{_BLANK}++[a-zA-Z][a-zA-Z0-9-]*+=(?:"[^"<>&]*+"|'[^'<>&]*+'|[a-zA-Z0-9_%#.;:-]++)"""
_PLAIN = re.compile(rf"[^<&]*+(?:<(?:/[a-zA-Z][a-zA-Z0-9]*+|[a-zA-Z][a-zA-Z0-9]*+(?:{_ATTRIBUTE})*+){_BLANK}*+>[^<&]*+)*+")
# what follows these is not read as tags
_RAW = re.compile(r"(?i)<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)")
_TAG = re.compile(r"<(/?)([a-zA-Z0-9]+)([^>]*)>([^<]*)")
_PAIR = re.compile(r"""([a-zA-Z0-9-]+)=(?:"([^"]*)"|'([^']*)'|([^\t\n\r\f ]+))""")


class _Marks(HTMLParser):
    """Writes a page down as one mark per table event (T t: table, R r: row, D d: cell) with what each cell holds."""

    CODES = {"table": "T", "tr": "R", "td": "D", "th": "D"}

    def __init__(self):
        super().__init__()
        self.marks, self.cells, self.rowspan = [], [], False

    def read(self, html: str) -> None:
        """``feed``, several times faster for plain pages."""
        if not _PLAIN.fullmatch(html) or _RAW.search(html):
            self.feed(html)
            return
        for end, tag, attributes, data in _TAG.findall(html):
            if end:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), [(k.lower(), a or b or c) for k, a, b, c in _PAIR.findall(attributes)] if attributes else [])
            if data:
                self.handle_data(data)

    def handle_starttag(self, tag, attrs):
        code = self.CODES.get(tag)
        if code:
            self.marks.append(code)
            if not attrs:
                self.cells.append([1, ""])
                return
            wide, tall = ([int(v) for k, v in attrs if k == name and v and v.strip().isdecimal()] or [1] for name in ("colspan", "rowspan"))
            self.cells.append([min(max(wide[-1], 1), 100), ""])
            self.rowspan |= code == "D" and tall[-1] > 1

    def handle_endtag(self, tag):
        if tag in self.CODES:
            self.marks.append(self.CODES[tag].lower())
            self.cells.append([0, ""])

    def handle_data(self, data):
        if self.marks and self.marks[-1] == "D":
            self.cells[-1][1] += data


# a table that closes before another opens, its closed rows, and their closed cells
_TABLE, _ROW, _CELL = re.compile("T[^Tt]*t"), re.compile("R[^Rr]*r"), re.compile("Dd")


def largest_table(html: str | None) -> tuple[str, list[list[str]]]:
    """``(status, rows)`` of a page: header first, rows padded; status tells why there is none.

    The table with most rows is taken, then with the widest first row, then the first one; a table has two rows.
    """
    page = _Marks()
    page.read(html or "")
    if page.rowspan:
        return "rowspan", []
    marks = "".join(page.marks)
    tables = []
    for table in _TABLE.finditer(marks):
        rows = []
        for row in _ROW.finditer(marks, *table.span()):
            found = [page.cells[m.start()] for m in _CELL.finditer(marks, *row.span())]
            rows.append([text for span, raw in found for text in [" ".join(raw.split())] + [""] * (span - 1)])
        rows = [r for r in rows if r]
        if len(rows) > 1:
            tables.append(rows)
    if not tables:
        return "no table", []
    head, *body = max(tables, key=lambda t: (len(t), len(t[0])))
    width = max(map(len, (head, *body)))
    seen: dict[str, int] = {}
    header = []
    for name in (*head, *(f"column_{i}" for i in range(len(head), width))):
        seen[name] = seen.get(name, 0) + 1
        header.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return "ok", [header, *(row + [""] * (width - len(row)) for row in body)]


def extract_html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, status, row_no, header, cells)``: the largest table of every page, one output row per table row.

    Pages without a usable table keep one row that says why.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, status string, row_no int, header array<string>, cells array<string>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[key], batch[html]):
                status, rows = largest_table(text)
                if status != "ok":
                    out.append((page, status, None, None, None))
                out.extend((page, status, i, rows[0], row) for i, row in enumerate(rows[1:], 1))
            yield pd.DataFrame(out, columns=[key, "status", "row_no", "header", "cells"])

    return df.select(q(key), q(html)).mapInPandas(work, schema)
