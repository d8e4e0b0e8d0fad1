"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a Jaccard similarity near 0, but the chance that the document holds
the item's minimum under a hash is exactly the contained share. So each item is represented by its smallest
shingle hashes. Items are partitioned by size in powers of two, and all items of a partition use the sketch
length its largest size needs: with ``missing`` shingles allowed to be absent, ``missing + 1`` minima cannot
all be absent, so no contained item is lost. Documents probe the sketches with all their shingles, and the
pairs found are verified by the exact containment of the item's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bound, text_of, words_of


def shingles_of(text: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` words of the lower-cased text, in order; empty with fewer words."""

    def runs(h: Column) -> Column:
        return F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        )

    return bound(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)), runs)


def sketches(items: DataFrame, threshold: float, item_id: str, text: str, n: int) -> DataFrame:
    """One row per item with shingles: its distinct ``shingles``, size ``partition`` and ``minima``."""
    shaped = items.select(F.col(f"`{item_id}`").alias("item_id"), F.array_distinct(shingles_of(text_of(text), n)).alias("shingles"))
    shaped = shaped.filter(F.size("shingles") > 0).withColumn("partition", F.floor(F.log2(F.size("shingles"))))
    largest = shaped.groupBy("partition").agg(F.max(F.size("shingles")).alias("largest"))
    # ceil with a little slack, so that 0.8 * 10 does not become 9 by rounding
    length = (F.col("largest") - F.ceil(F.col("largest") * threshold - 1e-9) + 1).cast("int")
    hashed = F.array_sort(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, F.lit(17)).alias("order"), h.alias("h"))))
    return shaped.join(largest, "partition").select(
        "item_id", "partition", "shingles", F.transform(F.slice(hashed, F.lit(1), length), lambda x: x["h"]).alias("minima")
    )


def find_contained(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
) -> DataFrame:
    """Pairs with at least ``threshold`` of the item's distinct ``n``-word shingles in the document.

    Returns ``doc_id, item_id, n_shingles, n_shared, containment``, one row per pair of ids; where an id repeats,
    the largest containment. Items of fewer than ``n`` words have no shingles and are found nowhere; null texts
    are empty, null ids are an id like any other, and other columns are not looked at.
    """
    known = sketches(items, threshold, item_id, item_text, n)
    probe = known.select("item_id", F.explode("minima").alias("h"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    hits = rows.select("doc_id", F.explode(shingles_of(F.col("text"), n)).alias("h")).join(probe, "h")
    pairs = hits.select("doc_id", "item_id").distinct().select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    found = rows.join(pairs, rows["doc_id"].eqNullSafe(F.col("d"))).withColumn("own", shingles_of(F.col("text"), n))
    found = found.join(known, F.col("i").eqNullSafe(known["item_id"]))
    shared = F.size(F.array_intersect("shingles", "own")).cast("long")
    scored = found.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), shared.alias("n_shared"))
    scored = scored.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(
        F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9
    )
    best = F.max_by(F.struct("n_shingles", "n_shared", "containment"), F.struct("containment", "n_shared"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` whose id has no contained item, unchanged."""
    found = find_contained(docs, items, threshold, n, doc_id=doc_id, text=text, **names)
    bad = found.select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(bad, docs[f"`{doc_id}`"].eqNullSafe(F.col("__found")), "left_anti")
