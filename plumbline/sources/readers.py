"""Reading files into tables: one entry point that picks the reader by file ending."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import any_of, q, text_columns
from plumbline.session import scratch_path, stored
from plumbline.sources.delimited import classify_text_tables, detect_delimiter, read_lines
from plumbline.sources.markup import extract_html_tables, read_xml
from plumbline.sources.names import flatten, normalize_columns, serialize_nested, unique_names
from plumbline.sources.records import first_places, quoted_records

# File endings and the reader each one takes.
FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".ndjson": "jsonl",
    ".parquet": "parquet",
    ".xml": "xml",
    ".html": "html",
    ".htm": "html",
    ".txt": "text",
    ".log": "text",
    ".md": "text",
    ".rst": "text",
    ".sql": "text",
}
# Encodings tried in this order (a byte order mark is stripped by the reader).
ENCODINGS = ("UTF-8", "windows-1252")
# Spark reads ISO-8859-1, of which windows-1252 differs only in these positions.
_WESTERN = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_WESTERN = {k: v for k, v in _WESTERN.items() if v}


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, max_rows: int | None = None, **options
) -> DataFrame:
    """Read a file or folder of files as one table with clean column names and no nested cells."""
    fmt = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt == "csv":
        df = read_delimited(spark, path, **options)
    elif fmt == "text":
        df = read_text_table(spark, path, **options)
    elif fmt == "html":
        df = read_html(spark, path)
    elif fmt == "tsv":
        df = read_delimited(spark, path, sep="\t", **options)
    elif fmt == "json":
        df = read_json(spark, path)
    elif fmt == "jsonl":
        df = flatten(spark.read.json(path, **options))
    elif fmt == "parquet":
        df = spark.read.parquet(path, **options)
    elif fmt == "xml":
        df = read_xml(spark, path, **options)
    else:
        raise ValueError(f"no reader for {path!r}; supported endings: {', '.join(sorted(FORMATS))}")
    df = serialize_nested(normalize_columns(df))
    return df if max_rows is None else df.limit(max_rows)


def choose_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode as UTF-8; then the western single-byte code page."""
    lines = spark.read.text(path)
    return ENCODINGS[0] if lines.filter(~F.is_valid_utf8("value")).isEmpty() else ENCODINGS[1]


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Delimited text with a header line. Give a schema to skip inference on large inputs.

    Files of a folder whose header lines differ are read apart and joined by column name. Line breaks inside
    quotes belong to the cell; UTF-8 files with such cells are read block by block (``quoted_records``), other
    encodings, files with lone carriage returns and calls with reader options of their own a file a task.
    """
    encoding = encoding or choose_encoding(spark, path)
    lines = read_lines(spark, path)
    if sep is None:
        found = {r["sep"] for r in detect_delimiter(lines).select("sep").distinct().collect()}
        if len(found) > 1:
            raise ValueError(f"the files under {path!r} use different separators: {sorted(found)}; read them one by one")
        sep = found.pop() if found else ","
    by_blocks = False
    if "multiLine" not in options:
        own_options = bool(options)
        open_quote = F.contains("line", F.lit('"')) & F.col("line").rlike(r'(?:^|\Q' + sep + r'\E)"(?:[^"]|"")*$')
        options["multiLine"] = not lines.filter(open_quote).isEmpty()
        if options["multiLine"] and not own_options and encoding.upper() == "UTF-8" and len(sep) == 1:
            by_blocks = spark.read.option("lineSep", "\n").text(path).filter(F.col("value").rlike("\r[^\r]")).isEmpty()
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("line", "line_id").alias("head"))
    heads = first.groupBy("head").agg(F.count(F.lit(1)).alias("files")).orderBy("head").limit(2).collect()
    if len(heads) < 2:
        read = _read_records if by_blocks else _read_alike
        return read(spark, path, sep, encoding, schema, options)
    groups = first.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    frames = [_read_alike(spark, [unquote(f) for f in g["files"]], sep, encoding, schema, options) for g in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _read_alike(spark: SparkSession, path, sep: str, encoding: str, schema, options: dict) -> DataFrame:
    """Files with one header line."""
    western = encoding.lower() in ("windows-1252", "cp1252")
    base = {"sep": sep, "encoding": "ISO-8859-1" if western else encoding, "quote": '"', "escape": '"', **options}
    # Names are taken from a headerless look at the first line: the reader itself would rename repeats.
    head = spark.read.options(**base).option("header", False).csv(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    names = [(v or "").lstrip("\ufeff") for v in head[0]]
    reader = spark.read.options(**base).option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    df = reader.csv(path)
    if western:
        names = ["".join(_WESTERN.get(ch, ch) for ch in n) for n in names]
        old, new = "".join(_WESTERN), "".join(_WESTERN.values())
        texts = set(text_columns(df))
        df = df.select(*[F.translate(q(c), old, new).alias(c) if c in texts else q(c) for c in df.columns])
    return df.toDF(*unique_names(names))


def _read_records(spark: SparkSession, path, sep: str, encoding: str, schema, options: dict) -> DataFrame:
    """Files with one header and line breaks in cells, read block by block; types are found from the records."""
    settings = {"sep": sep, "quote": '"', "escape": '"'}
    records = quoted_records(spark, path, sep)
    names = spark.read.options(encoding=encoding, multiLine=True, **settings).csv(path).limit(1).collect()
    names = unique_names([(v or "").lstrip("\ufeff") for v in names[0]])
    rows = records.join(F.broadcast(first_places(spark, path)), "file").filter(F.struct("block", "line_id") != F.col("start")).select("record")
    if schema is None:
        rows = stored(rows)
        # a record a line, so that the reader itself finds the types in its tasks
        flat = scratch_path(spark, "flat")
        rows.select(F.regexp_replace("record", r"[\r\n]+", " ")).write.text(flat)
        found = [f.dataType for f in spark.read.options(inferSchema=True, **settings).csv(flat).schema]
        kinds = [found[i] if i < len(found) else T.StringType() for i in range(len(names))]
    else:
        kinds = [f.dataType for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)]
    fields = ", ".join(f"c{i} {kind.simpleString()}" for i, kind in enumerate(kinds))
    parsed = rows.select(F.from_csv("record", fields, settings).alias("r"))
    return parsed.select("r.*").toDF(*names)


def read_text_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text files that are tables; prose and other text is refused with the reason."""
    if "sep" in options:
        return read_delimited(spark, path, **options)
    judged = classify_text_tables(read_lines(spark, path))
    bad = judged.filter(~F.col("is_table")).orderBy("file").limit(3).collect()
    if bad:
        raise ValueError("not a table: " + "; ".join(f"{os.path.basename(r['file'])}: {r['reason']}" for r in bad))
    seps = [r["sep"] for r in judged.select("sep").distinct().limit(2).collect()]
    if len(seps) > 1:
        raise ValueError(f"the files under {path!r} use different separators: {sorted(seps)}; read them one by one")
    return read_delimited(spark, path, sep=seps[0] if seps else ",", **options)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """The largest table of every HTML file, joined by column name; a file without a usable table is an error."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = extract_html_tables(pages, "file", "value")
    bad = found.filter("status <> 'ok'").orderBy("file").limit(3).collect()
    if bad:
        raise ValueError("no table read: " + "; ".join(f"{os.path.basename(r['file'])}: {r['status']}" for r in bad))
    frames = []
    for header in [r["header"] for r in found.select("header").distinct().orderBy("header").collect()]:
        own = found.filter(F.col("header") == F.array(*map(F.lit, header)))
        frames.append(own.select(*[F.get("cells", i).alias(n) for i, n in enumerate(unique_names(header))]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents as a table: arrays of records, one record list, columnar lists, or one record a file."""
    docs = spark.read.option("multiLine", True).json(path)
    lists = any(isinstance(f.dataType, T.ArrayType) for f in docs.schema.fields)
    if lists and docs.groupBy("_metadata.file_path").count().filter("count > 1").isEmpty():
        docs = json_records(docs)
    return flatten(docs)


def json_records(docs: DataFrame) -> DataFrame:
    """Unfold documents by their shape: the records of their one record list, or the rows of columnar lists."""
    lists = [f for f in docs.schema.fields if isinstance(f.dataType, T.ArrayType)]
    records = [f.name for f in lists if isinstance(f.dataType.elementType, T.StructType)]
    if len(records) > 1:
        raise ValueError(f"ambiguous JSON: several record lists ({', '.join(sorted(records))})")
    if len(records) == 1:
        return docs.select(F.inline(q(records[0])))
    if lists and len(lists) == len(docs.columns):
        size = F.size(q(lists[0].name))
        uneven = any_of([F.size(q(f.name)) != size for f in lists]) | (size <= 0)
        if docs.filter(F.coalesce(uneven, F.lit(True))).isEmpty():
            return docs.select(F.inline(F.arrays_zip(*[q(f.name) for f in lists])))
    return docs


def extract_options(query: str, column: str, bounds: tuple, partitions: int) -> dict[str, str]:
    """JDBC options that read a query in ``partitions`` connections, each a range of ``column``.

    ``bounds`` only place the ranges: rows outside, and rows without a value, are read too. A column without values
    or with one value leaves a single connection.
    """
    low, high = bounds
    if low is None or low == high or partitions <= 1:
        return {"dbtable": f"({query}) extract_rows"}
    return {
        "dbtable": f"({query}) extract_rows",
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def sql_extract(
    spark: SparkSession, query: str, url: str | None = None, split_by: str | None = None, partitions: int = 16, **options
) -> DataFrame:
    """Rows of a query: over a JDBC source when ``url`` is given, otherwise over registered views.

    ``split_by`` names a number, date or time column of the query; one aggregate query finds its bounds, and the rows
    then come over ``partitions`` connections at once. Without it a single connection reads everything.
    """
    query = query.strip().rstrip(";")
    if url is None:
        return spark.sql(query)
    source = spark.read.format("jdbc").option("url", url).options(**options)
    if split_by is None:
        return source.option("query", query).load()
    ends = source.option("query", f"SELECT min({split_by}) AS low, max({split_by}) AS high FROM ({query}) extract_bounds").load().first()
    split = spark.read.format("jdbc").option("url", url).options(**options)
    return split.options(**extract_options(query, split_by, (ends[0], ends[1]), partitions)).load()


def list_tables(spark: SparkSession, url: str | None = None, catalog_query: str | None = None) -> DataFrame:
    """Tables that can be extracted from; for JDBC pass the database's own catalog query."""
    if url is not None:
        return sql_extract(spark, catalog_query or "select table_name from information_schema.tables", url)
    names = [(t.name, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "name string, temporary boolean")


def parse_delimited_text(df: DataFrame, column: str, schema: str, sep: str = ",") -> DataFrame:
    """Pasted delimited text, one record per row of ``column``, as typed columns."""
    parsed = F.from_csv(F.col(column), schema, {"sep": sep, "mode": "PERMISSIVE"})
    return df.select(parsed.alias("r")).select("r.*")
