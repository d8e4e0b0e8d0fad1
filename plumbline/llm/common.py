"""Helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path

#: the characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = " \t\n\x0b\x0c\r"
BLANK_PATTERN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than blanks, in order; empty for a text without words."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_PATTERN))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read again: outlives lost executors, and later reads prune columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, most: int = 4_000_000):
    """An Arrow batch cut into slices of a few MB of ``text``, so that its Python strings never exist all at once."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // most
    start = 0
    for end in [*(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the table does not have yet."""
    taken, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name
