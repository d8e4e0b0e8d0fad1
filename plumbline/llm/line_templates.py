"""Line dedup with a log-template tree of fixed depth.

A line goes to the leaf of its token count and its first tokens (tokens with digits are variable from the
start). In a leaf, each place has a dominant token if one holds most of the leaf's lines; the other places are
variable fields. Lines that agree with the leaf's template in most places belong to it, any other line stays a
template of its own. A template that recurs in many documents is dropped from all of them.

Copies of a whole document repeat its lines too. So a template must also recur in many documents that are not
copies of each other. A document is told by its own lines, those of no template that recurs, wherever they
stand; if these are less than half of it, it is taken for a copy and told by one of its recurring templates, so
that a family of near copies, which is left to the near-duplicate stage, counts about once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, bound, staged, text_of

#: leading tokens that make a leaf, next to the token count
DEPTH = 3
#: share of a leaf's weight that makes a token dominant, and share of places where a line must agree with a template
DOMINANT, AGREE = 0.5, 0.7
#: documents, as they come and without copies, in which a template recurs that is dropped
RECURRING = 10
#: share of a document that its own lines have at least if it isn't taken for a copy
OWN = 0.5

_FIELD = "<*>"


def _leaf(line: Column, depth: int) -> Column:
    """Hash of the token count and the first masked tokens; null for a line without tokens."""
    bare = F.btrim(line, F.lit(BLANKS))
    count = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    head = F.regexp_replace(F.substring_index(bare, " ", depth), "[^ ]*[0-9][^ ]*", _FIELD)
    return F.when(bare != "", F.xxhash64(count, head))


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """Adds ``__lines``: every line of the text with its leaf."""
    return docs.withColumn("__lines", _with_leaves(F.split(text_of(text), "\n"), depth))


def _with_leaves(lines: Column, depth: int) -> Column:
    return F.transform(lines, lambda x: F.struct(x.alias("line"), _leaf(x, depth).alias("leaf")))


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, recurring: int = RECURRING) -> DataFrame:
    """The masked lines to drop: ``leaf, masked, template, n_docs, n_contexts`` (one row per distinct masked line).

    ``n_contexts`` are the documents of the template after copies are collapsed.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    leaves = _lines(docs, "text", depth).select(F.explode(F.filter(F.transform("__lines", lambda x: x["leaf"]), lambda x: x.isNotNull())).alias("leaf"))
    # a template has no more lines than its leaf: most prose is out here, before any token is looked at
    alive = staged(leaves.groupBy("leaf").count().filter(F.col("count") >= recurring).select("leaf"), "leaves")

    def sized(lines: Column) -> Column:
        """Every line with the size of all lines and the combined leaves of all."""
        whole = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["line"]))
        every = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.coalesce(x["leaf"], F.lit(0).cast("long"))))
        return bound(
            F.struct(whole.alias("whole"), every.alias("every")),
            lambda d: F.transform(
                F.filter(lines, lambda x: x["leaf"].isNotNull()),
                lambda x: F.struct(x["line"].alias("line"), x["leaf"].alias("leaf"), d["whole"].alias("whole"), d["every"].alias("every")),
            ),
        )

    # a line counts once per text, so rows of equal id and text change nothing
    distinct = _with_leaves(F.array_distinct(F.split(text_of("text"), "\n")), depth)
    every = docs.select("doc_id", F.xxhash64(text_of("text")).alias("version"), F.explode(bound(distinct, sized)).alias("x")).select("doc_id", "version", "x.*")
    masked = F.regexp_replace(F.btrim("line", F.lit(BLANKS)), "[^ ]*[0-9][^ ]*", _FIELD)
    lines = every.join(alive, "leaf").select(
        "doc_id", "version", "whole", "every", "leaf", masked.alias("masked"), F.xxhash64("line").alias("line"), F.octet_length("line").alias("size")
    )
    lines = staged(lines.distinct(), "lines")

    weighed = lines.groupBy("leaf", "masked").agg(F.count_distinct("version").alias("weight"))
    tokens = weighed.select("leaf", "weight", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    votes = tokens.groupBy("leaf", "place", "token").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy("leaf", "place").agg(F.max(F.struct("weight", "token")).alias("best"), F.sum("weight").alias("all"))
    best = best.filter(F.col("best.weight") > DOMINANT * F.col("all")).select("leaf", F.struct("place", F.col("best.token").alias("token")).alias("field"))
    dominant = best.groupBy("leaf").agg(F.map_from_entries(F.collect_list("field")).alias("fields"))

    own = F.split("masked", " ")
    known = weighed.join(dominant, "leaf", "left")
    agree = bound(
        F.coalesce("fields", F.create_map().cast("map<int,string>")),
        lambda m: F.size(F.filter(F.transform(own, lambda t, k: t == F.element_at(m, k)), lambda x: x)),
    )
    part = agree >= AGREE * F.size(own)
    template = F.when(part, F.xxhash64("leaf", F.lit(_FIELD))).otherwise(F.xxhash64("leaf", F.lit(""), "masked"))
    known = staged(known.select("leaf", "masked", template.alias("template")), "known-templates")
    at = lines.join(known, ["leaf", "masked"])
    n_docs = at.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("n_docs"))
    found = staged(known.join(n_docs.filter(F.col("n_docs") >= recurring), "template"), "recurring-templates")

    seen = lines.join(found, ["leaf", "masked"]).select("template", "version", "whole", "every", "leaf", "line", "size").distinct()
    seen = staged(seen, "recurring-lines")
    told = seen.groupBy("version", "whole", "every").agg(
        F.sum("size").alias("size"), F.bit_xor("leaf").alias("leaves"), F.min(F.xxhash64("template")).alias("least")
    )
    own = F.col("whole") - F.col("size") >= OWN * F.col("whole")
    # taking the recurring leaves out of all leaves leaves the own ones
    told = told.select("version", F.when(own, F.xxhash64(F.lit("own"), F.col("every").bitwiseXOR(F.col("leaves")))).otherwise(F.col("least")).alias("context"))
    contexts = seen.select("template", "version").distinct().join(told, "version").select("template", "context").distinct()
    n_contexts = contexts.groupBy("template").agg(F.count("*").alias("n_contexts")).filter(F.col("n_contexts") >= recurring)
    return found.join(n_contexts, "template").select("leaf", "masked", "template", "n_docs", "n_contexts")


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, recurring: int = RECURRING) -> DataFrame:
    """The documents without the lines of recurring templates; adds ``n_lines`` and ``n_dropped``.

    Lines are separated by line feeds and compared without blanks at their ends; lines without tokens stay. A text
    that keeps all its lines is unchanged, a text that loses all becomes empty, and no row goes. Null texts stay
    null (no lines), rows of one id count as one document, a null id is an id like any other. Other columns stay,
    and columns named like the added ones are replaced.
    """
    bad = staged(recurring_lines(docs, doc_id, text, depth, recurring).select("leaf", "masked"), "templates")
    rows = _lines(docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text")), "__text", depth)
    version = F.xxhash64("__text")
    every = rows.select("__id", version.alias("__version"), F.posexplode("__lines").alias("place", "x")).select("__id", "__version", "place", "x.*")
    leaves = bad.select("leaf").distinct()
    masked = F.regexp_replace(F.btrim("line", F.lit(BLANKS)), "[^ ]*[0-9][^ ]*", _FIELD)
    gone = every.join(leaves, "leaf", "left_semi").withColumn("masked", masked).join(bad, ["leaf", "masked"], "left_semi")
    gone = gone.groupBy("__id", "__version").agg(F.collect_set("place").alias("__gone"))

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    one = docs.select(*kept).withColumn("__version", F.xxhash64(F.col(f"`{text}`")))
    same = one[f"`{doc_id}`"].eqNullSafe(gone["__id"]) & (one["__version"] == gone["__version"])
    joined = one.join(gone, same, "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    left = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains("__gone", k)), "\n")
    n_lines = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_gone = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    out = [
        (F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(left).alias(c) if c == text else F.col(f"`{c}`"))
        for c in docs.columns
        if c.lower() not in ("n_lines", "n_dropped")
    ]
    return joined.select(*out, n_lines.alias("n_lines"), n_gone.alias("n_dropped"))
