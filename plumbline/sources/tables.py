"""Merging sources, table identity, the catalog, and writing tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.exprs import free_name, missing, q, text_columns, total, value_of
from plumbline.functions.wide import distinct_counts, union_all

# Bounds a single-machine user would check a table against (all optional here).
GUARD_LIMITS = {"rows": 1_000_000, "columns": 200, "cells": 20_000_000, "high_cardinality_cells": 5_000_000}
HIGH_CARDINALITY_SHARE = 0.7
# bytes of a file that one task hashes at a time
SIGNATURE_BLOCK = 64 << 20

# Text that a spreadsheet would run as a formula, and text that is just a number.
FORMULA_TRIGGER = r"^[\t\r]|^\s*[=+\-@]"
NUMBER_TEXT = (
    r"^\s*[+\-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+\-]?\d+)?\s*$"
    r"|^\s*[+\-]?(?i:inf|infinity|nan)\s*$"
)


# Names of the column that says where a row comes from, the first free one is used.
PROVENANCE = ("source_file", "uploaded_file")


def provenance_name(taken: Sequence[str]) -> str:
    """The first of the fixed names that no data column has, else the first one with a free number."""
    open_ = [n for n in PROVENANCE if n not in set(taken)]
    return open_[0] if open_ else free_name(PROVENANCE[0], taken)


def merge_sources(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union by column name, nulls where a source lacks a column, first column naming the source."""
    if not frames:
        raise ValueError("nothing to merge: no source was given")
    name = provenance_name([c for _, df in frames for c in df.columns])
    named = (df.select(F.lit(str(label)).alias(name), *map(q, df.columns)) for label, df in frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row identifying a table's content and schema, whatever the row order."""
    hashed = F.xxhash64(*[value_of(df, c) for c in df.columns], *[missing(df, c) for c in df.columns])
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    sums = df.select(hashed.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.expr("bit_xor(h)").alias("x"),
    )
    text = F.concat_ws("|", F.lit(schema), "rows", F.coalesce(F.col("s"), F.lit(0)).cast("string"), F.coalesce("x", F.lit(0)))
    return sums.select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.sha2(text, 256).alias("fingerprint"))


def _open_range(path: str):
    """A seekable file of any filesystem that Arrow knows, from the path as Spark writes it."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inner)


def _block_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path, size, start, length in zip(batch["path"], batch["size"], batch["start"], batch["length"], strict=True):
            digest, left = hashlib.sha256(), int(length)
            with _open_range(path) as source:
                source.seek(int(start))
                while left:
                    data = source.read(min(left, 4 << 20))
                    if not data:
                        raise OSError(f"{path} is shorter than its {size} listed bytes")
                    digest.update(data)
                    left -= len(data)
            found.append(digest.hexdigest())
        yield batch[["path", "size", "piece"]].assign(hash=found)


def block_hashes(files: DataFrame, block: int = SIGNATURE_BLOCK) -> DataFrame:
    """``(path, size, piece, hash)`` for files given as ``(path, size)``: the hash of every range of ``block`` bytes.

    Tasks read ranges, not files, a few MB at a time; an empty file is one empty range.
    """
    if block < 1:
        raise ValueError("a block needs at least one byte")
    count = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.lit(1)).cast("long")
    total_blocks = files.agg(F.sum(count)).first()[0] or 0
    pieces = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.col("piece") * F.lit(block).cast("long")
    ranges = pieces.select("*", start.alias("start"), F.least(F.col("size") - start, F.lit(block).cast("long")).alias("length"))
    # a stated number of parts: the rows are tiny, but each stands for a block
    spread = ranges.repartition(int(max(1, min(total_blocks, 20_000))), "path", "piece")
    return spread.mapInPandas(_block_hashes, "path string, size long, piece long, hash string")


def file_signatures(spark: SparkSession, path: str, block: int = SIGNATURE_BLOCK) -> DataFrame:
    """``(path, name, size, sha256, copies)``: files with the same content share a hash.

    Files may be of any size, as no task and no cell holds a whole one. ``sha256`` is the plain hash of a file of at
    most ``block`` bytes, and the hash of the blocks' hashes in hexadecimal, one after the other, of a larger one.
    Empty files have no signature: Spark lists no file without content.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashes = F.array_sort(F.collect_list(F.struct("piece", "hash")))
    ordered = block_hashes(listed.select("path", F.col("length").alias("size")), block).groupBy("path", "size").agg(hashes.alias("h"))
    joined = F.array_join(F.transform("h", lambda h: h["hash"]), "")
    content = F.when(F.size("h") == 1, joined).otherwise(F.sha2(joined, 256))
    signed = ordered.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size", content.alias("sha256"))
    copies = signed.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return signed.join(copies, "sha256").select("path", "name", "size", "sha256", "copies")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(dataset, rows)`` per table; parquet counts come from the file footers."""
    return union_all(
        [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n, df in tables.items()]
    )


def shape_guard(df: DataFrame, **limits: int) -> DataFrame:
    """``(rule, value, limit, ok)``; rules without a limit in the call always hold."""
    cols, levels = len(df.columns), distinct_counts(df, text_columns(df))
    share = [
        F.when(F.lit(n) >= HIGH_CARDINALITY_SHARE * F.greatest(F.count(F.lit(1)), F.lit(1)), F.count(F.lit(1))).otherwise(0)
        for n in levels.values()
    ]
    facts = df.agg(F.count(F.lit(1)).alias("rows"), total(share).cast("long").alias("risky"))
    values = {
        "rows": F.col("rows"),
        "columns": F.lit(cols).cast("long"),
        "cells": F.col("rows") * cols,
        "high_cardinality_cells": F.col("risky"),
    }
    rules = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), v.alias("value"), F.lit(limits.get(r)).cast("long").alias("limit"))
            for r, v in values.items()
        ]
    )
    ok = F.col("limit").isNull() | (F.col("value") <= F.col("limit"))
    return facts.select(F.inline(rules)).select("rule", "value", "limit", ok.alias("ok"))


# ---- catalog -------------------------------------------------------------------------------------


def save_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Store a table in the catalog and return it as stored."""
    df.write.format(fmt).mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def activate(df: DataFrame, name: str = "current_table") -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def list_tables_with_files(spark: SparkSession) -> DataFrame:
    """``(name, temporary, files, bytes, modified)`` for catalog tables; only file status is read."""
    out = []
    for table in spark.catalog.listTables():
        paths = [] if table.isTemporary else list(spark.table(table.name).inputFiles())
        facts = (None, None, None)
        if paths:
            files = spark.read.format("binaryFile").load(paths)
            facts = tuple(files.agg(F.count("path"), F.sum("length"), F.max("modificationTime")).first())
        out.append((table.name, table.isTemporary, *facts))
    return spark.createDataFrame(out, "name string, temporary boolean, files long, bytes long, modified timestamp")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


# ---- sinks ---------------------------------------------------------------------------------------


def _neutral_text(text: str) -> str:
    """The rule below for one header name."""
    import re

    if not text.strip():
        return text
    trigger = re.search(FORMULA_TRIGGER, text) and not re.search(NUMBER_TEXT, text)
    return f"'{text}" if trigger or text[0] in "\t\r" else text


def neutral(col: Column) -> Column:
    """Prefix ``'`` to text a spreadsheet would run as a formula; plain numbers and blanks stay."""
    starts = col.rlike(r"^[\t\r]")
    formula = col.rlike(FORMULA_TRIGGER) & ~col.rlike(NUMBER_TEXT)
    blank = ~col.rlike(r"\S")
    return F.when(~blank & (starts | formula), F.concat(F.lit("'"), col)).otherwise(col)


def sanitize_for_csv(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(*[(neutral(q(c)) if c in texts else q(c)).alias(_neutral_text(c)) for c in df.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", safe: bool = True) -> None:
    from plumbline.sources.names import serialize_nested

    flat = serialize_nested(df)
    out = sanitize_for_csv(flat) if safe else flat
    out.write.mode(mode).options(
        # blanks at the ends of a cell are part of it
        header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(df, path, sep="\t", mode=mode)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def source_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """``(dataset, rows, columns, missing_pct)`` per table."""
    frames = []
    for name, df in tables.items():
        facts = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(total([missing(df, c).cast("long") for c in df.columns])), F.lit(0)).alias("gaps"),
        )
        cells = F.col("rows") * len(df.columns)
        frames.append(
            facts.select(
                F.lit(name).alias("dataset"),
                "rows",
                F.lit(len(df.columns)).cast("long").alias("columns"),
                F.coalesce(F.try_divide(F.col("gaps") * 100.0, cells), F.lit(0.0)).alias("missing_pct"),
            )
        )
    return union_all(frames)
