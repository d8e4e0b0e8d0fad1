"""Finding the separator of text files, many files at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Separators tried when a comma gives one column, and those a text file may use.
ALTERNATIVES = (";", "\t", "|")
TEXT_SEPARATORS = (",", ";", "\t", "|")


def read_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """``(file, block, line_id, line)`` for every line; ids rise within a file block.

    With ``by_folder`` the files of a folder are parts of one text, and ``file`` is the folder's path.
    """
    file = F.col("_metadata.file_path")
    return spark.read.text(path).select(
        (F.regexp_replace(file, "/[^/]*$", "") if by_folder else file).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )


def _widths(lines: DataFrame, seps) -> DataFrame:
    """Per file and separator: fewest and most fields per non-blank line (quoted spans do not count)."""
    bare = F.regexp_replace("line", '"[^"]*"', "")
    tries = F.array(
        *[
            F.struct(
                F.lit(s).alias("sep"),
                F.lit(i).alias("priority"),
                (F.length("bare") - F.length(F.replace(F.col("bare"), F.lit(s), F.lit(""))) + 1).alias("fields"),
            )
            for i, s in enumerate(seps)
        ]
    )
    # as a column of its own the quoted spans are taken out once, not at every use
    used = lines.filter(F.trim("line") != "").select("file", bare.alias("bare")).select("file", F.inline(tries))
    return used.groupBy("file", "sep", "priority").agg(
        F.min("fields").alias("least"), F.max("fields").alias("most"), F.count(F.lit(1)).alias("lines")
    )


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """``(file, sep, columns)``: comma if it yields more than one column on some line, else the
    alternative with equal width of at least two on all lines; the widest wins, comma if none fits."""
    widths = _widths(lines, (",", *ALTERNATIVES))
    fits = (F.col("least") == F.col("most")) & (F.col("least") >= 2) & (F.col("sep") != ",")
    best = F.max_by(F.struct("sep", "most"), F.when(fits, F.struct(F.col("most"), -F.col("priority"))))
    grouped = widths.groupBy("file").agg(
        best.alias("best"), F.max(F.when(F.col("sep") == ",", F.col("most"))).alias("comma")
    )
    keep_comma = (F.col("comma") > 1) | F.col("best").isNull()
    return grouped.select(
        "file",
        F.when(keep_comma, F.lit(",")).otherwise(F.col("best.sep")).alias("sep"),
        F.when(keep_comma, F.col("comma")).otherwise(F.col("best.most")).alias("columns"),
    )


def classify_text_tables(lines: DataFrame) -> DataFrame:
    """``(file, is_table, sep, columns, lines, reason)``: which text files are really tables.

    A table has at least two lines, one separator used the same number of times on every line, two or
    more columns, and no column that is empty in every data line.
    """
    widths = _widths(lines, TEXT_SEPARATORS)
    fits = (F.col("least") == F.col("most")) & (F.col("least") >= 2)
    chosen = widths.groupBy("file").agg(
        F.max_by(F.struct("sep", "most"), F.when(fits, F.struct(F.col("most"), -F.col("priority")))).alias("best"),
        F.max("lines").alias("lines"),
    )
    chosen = chosen.select("file", "lines", F.col("best.sep").alias("sep"), F.col("best.most").alias("columns"))

    # a column whose filled cells are all in the header line is empty; per file that is a few numbers. The separators
    # go to the lines, a row a file (the driver lists the files anyway): lines would meet by file, each in one task
    separated = chosen.filter(F.col("sep").isNotNull()).select("file", "sep")
    joined = lines.filter(F.trim("line") != "").join(F.broadcast(separated), "file")
    header = joined.groupBy("file").agg(F.min_by("line", F.struct("block", "line_id")).alias("header"))
    bare = F.regexp_replace("line", '"[^"]*"', "x")
    cells = joined.select("file", F.posexplode(F.split(bare, F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")), -1)))
    filled = cells.groupBy("file", "pos").agg(F.count_if(F.trim("col") != "").alias("filled"))
    heads = header.join(chosen, "file").filter(F.col("sep").isNotNull())
    head_bare = F.regexp_replace("header", '"[^"]*"', "x")
    head_cells = heads.select(
        "file", F.posexplode(F.split(head_bare, F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")), -1))
    ).select("file", "pos", (F.trim("col") != "").cast("long").alias("in_header"))
    ghosts = (
        filled.join(head_cells, ["file", "pos"], "left")
        .groupBy("file")
        .agg(F.count_if(F.col("filled") - F.coalesce("in_header", F.lit(0)) <= 0).alias("empty_columns"))
    )
    out = chosen.join(ghosts, "file", "left")
    reason = (
        F.when(F.col("lines") < 2, "fewer than two lines")
        .when(F.col("sep").isNull(), "no separator used consistently")
        .when(F.col("empty_columns") > 0, "a column is empty throughout")
    )
    return out.select("file", reason.isNull().alias("is_table"), "sep", "columns", "lines", reason.alias("reason"))


