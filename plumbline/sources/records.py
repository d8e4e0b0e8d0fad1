"""Records of delimited text whose quoted cells hold line breaks, found block by block instead of file by file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import stored

_PLACE = ["file", "block"]


def _ends_open(line: Column, sep: str) -> Column:
    """Whether a line that starts outside quotes ends inside them. A quote opens a cell only at its start."""
    # doubled quotes never change this, closed cells are taken out, and no pattern repeats a group: lines may be long
    cell = rf'(\A|{re.escape(sep)})"'
    single = F.replace(line, F.lit('""'), F.lit(""))
    return F.regexp_replace(single, cell + '[^"]*+"', "$1x").rlike(cell)


def _numbered_lines(spark: SparkSession, path) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(*place, F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def first_places(spark: SparkSession, path) -> DataFrame:
    """``(file, start)``: where the first record of every file lies, which is its first line that is not blank."""
    filled = _numbered_lines(spark, path).filter(F.trim(F.regexp_replace("line", "\r$", "")) != "")
    return filled.groupBy("file").agg(F.min(F.struct("block", "line_id")).alias("start"))


def quoted_records(spark: SparkSession, path, sep: str) -> DataFrame:
    """``(file, block, line_id, record)`` for every record of UTF-8 text; a record has the place of its first line.

    A line maps "starts inside quotes" to "ends inside quotes". These maps are chained within each block of a file,
    a task each, and over the blocks from one row a block, so that every line knows how it starts. Lines that are
    records stay where they are; only pieces of broken records meet, a group a record. Blank records are left out, an
    empty file has no rows, and an unclosed quote takes in the rest of its file, as in any reader.
    """
    lines = _numbered_lines(spark, path)
    bare = F.regexp_replace("line", "\r$", "")
    # a line without quotes keeps the state
    quoted = F.contains("line", F.lit('"'))
    after_out = F.when(quoted, _ends_open(bare, sep).cast("int")).otherwise(0)
    after_in = F.when(quoted, _ends_open(F.concat(F.lit('"'), bare), sep).cast("int")).otherwise(1)
    lines = lines.withColumn("out", after_out).withColumn("in", after_in)

    # a line sets the state (both ends alike), keeps it or turns it; the state is the last one set and the turns since
    ordered = Window.partitionBy(*_PLACE).orderBy("line_id")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    turns = lines.withColumn("turns", F.sum(((F.col("out") == 1) & (F.col("in") == 0)).cast("int")).over(ordered))
    setting = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("state"), "turns"))
    known = turns.withColumn("set", F.last(setting, True).over(before))
    known = known.withColumn("turned", F.coalesce(F.lag("turns").over(ordered), F.lit(0)))
    # for either state that the block may start in: whether a line starts inside, and the last line that doesn't
    for starts in (0, 1):
        state = F.coalesce(F.col("set.state") + F.col("turned") - F.col("set.turns"), F.lit(starts) + F.col("turned")) % 2
        known = known.withColumn(f"inside_{starts}", state == 1)
    for starts in (0, 1):
        first = F.when(~F.col(f"inside_{starts}"), F.col("line_id"))
        known = known.withColumn(f"head_{starts}", F.last(first, True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # used four times below, each of which would scan, move and sort all lines again
    known = stored(known.drop("set", "turned"))

    blocks = known.groupBy(*_PLACE).agg(
        F.max_by(setting, F.when(setting.isNotNull(), F.col("line_id"))).alias("set"), F.max("turns").alias("turns")
    )
    # over blocks the same: how a block ends if it starts outside is a fixed state or a number of turns
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("sum", F.sum("turns").over(in_file))
    fixed = F.struct((F.col("set.state") + F.col("turns") - F.col("set.turns")).alias("state"), "sum")
    blocks = blocks.withColumn("prior", F.last(F.when(F.col("set").isNotNull(), fixed), True).over(earlier))
    sum_before = F.coalesce(F.lag("sum").over(in_file), F.lit(0))
    starts = F.coalesce(F.col("prior.state"), F.lit(0)) + sum_before - F.coalesce(F.col("prior.sum"), F.lit(0))
    blocks = blocks.select(*_PLACE, (starts % 2 == 1).alias("starts"))

    # a row a block, of which the driver lists as many: they go to the lines, which stay where they are
    known = known.join(F.broadcast(blocks), _PLACE)
    known = known.withColumn("inside", F.when(F.col("starts"), F.col("inside_1")).otherwise(F.col("inside_0")))
    known = known.withColumn("head", F.when(F.col("starts"), F.col("head_1")).otherwise(F.col("head_0")))
    first = F.when(~F.col("inside"), F.col("line_id"))
    whole = known.filter("not inside and out = 0").select(*_PLACE, "line_id", bare.alias("record"))

    # a piece without a head in its block belongs to the last head of an earlier block
    pieces = known.filter("inside or out = 1")
    heads = known.groupBy(*_PLACE).agg(F.max(first).alias("last"))
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), True).over(earlier)
    heads = heads.select(*_PLACE, owner.alias("owner"))
    own = F.when(F.col("head").isNotNull(), F.struct("block", F.col("head").alias("last"))).otherwise(F.col("owner"))
    pieces = pieces.join(F.broadcast(heads), _PLACE).select("file", own.alias("own"), F.struct("block", "line_id", "line").alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["line"]), "\n")
    broken = pieces.groupBy("file", "own").agg(F.regexp_replace(joined, "\r$", "").alias("record"))
    broken = broken.select("file", F.col("own.block").alias("block"), F.col("own.last").alias("line_id"), "record")
    return whole.unionByName(broken).filter(F.trim("record") != "")
