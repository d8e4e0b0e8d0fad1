"""Registration of queries with their DuckDB counterpart, and the small helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one data folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dirty_customer(self) -> DataFrame:
        """Customers with gaps (negative balances, one segment) and repeated rows (five nations)."""
        c = self.customer
        gaps = c.select(
            "c_custkey",
            "c_nationkey",
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
            F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        )
        return gaps.unionByName(gaps.filter("c_nationkey < 5"))


# the same table in SQL, as the body of a WITH clause
DIRTY = """gaps AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
 nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer),
dirty AS (SELECT * FROM gaps UNION ALL SELECT * FROM gaps WHERE c_nationkey < 5)"""


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded and whole numbers widened, so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql(body: str, d: str = "", i: str = "", digits: int = 4) -> str:
    """Wrap a SELECT: round the double columns ``d`` and widen the whole-number columns ``i``."""
    fixes = [f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in d.split()]
    fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    head, core = "", body.strip()
    if core.upper().startswith("WITH"):
        # the last top-level SELECT follows a line holding only ';;'
        head, core = core.split(";;")
        head = head.rstrip() + "\n"
    star = f"* REPLACE ({', '.join(fixes)})" if fixes else "*"
    return f"{head}SELECT {star} FROM ({core.strip()}) AS t"


def query(name: str, oracle: str | None = None, digits: int = 4):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL if there is one."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)), digits)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)
