"""URL filter from path templates: per host, variable path parts become wildcards, similar branches merge.

Paths are counted by host and segments, with segments of a variable shape (numbers, hashes, long names with
digits) already replaced by a mark, so the counted table is small even where one host holds most pages. The
tree is then built level by level until no path has a further segment: below each node, children that are many
and rare, or whose labelled share of bad pages does not differ significantly from their parent's, merge into one
wildcard branch; of the others, siblings that are worse than the parent merge if they are alike, and those that are
better do so too. A template whose smoothed share of bad pages is too high is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.wide import spread_lookup
from plumbline.llm.common import ascii_lower, staged

#: a child of a node with more than this many children stays on its own only with more than its even share
CHILDREN = 20
#: normal deviations by which a child's share of bad pages must differ from its parent's to stay on its own
DEVIATIONS = 2.5
#: labelled pages a template is given of its host's share, and a host of the overall share
PRIOR = 5.0


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the start of a path, like ``example.net/en/``; it fits subdomains as well."""

    verdict: str
    text: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        top, slash, rest = rule.text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _shape(segment: Column) -> Column:
    """Segments of a variable shape become one mark; a file ending stays."""
    stem, ending = F.regexp_extract(segment, r"^(.*?)(\.[a-z]{2,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[a-z]{2,5})?$", 2)
    variable = stem.rlike(r"^[0-9]+$|^[0-9A-Fa-f-]{12,}$") | ((F.length(stem) > 12) & stem.rlike("[0-9]")) | (F.length(stem) > 40)
    return F.when(variable, F.concat(F.lit("<*>"), ending)).otherwise(segment)


def segments_of(path: Column) -> Column:
    """All segments of a path, shaped; empty ones don't count."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), _shape)


def _differs(bad: Column, labelled: Column, all_bad: Column, all_labelled: Column) -> Column:
    """Whether a branch's labelled pages are too often or too rarely bad for a sample of all these pages."""
    share = (all_bad + 1) / (all_labelled + 2)
    return F.abs(bad - share * labelled) > DEVIATIONS * F.sqrt(share * (1 - share) * labelled)


def _divided(tree: DataFrame, level: int) -> DataFrame:
    """The tree with one more segment in the templates of its open rows; a row per host and shaped path as before.

    A node without labelled pages, or with one path only, is closed: deeper segments cannot change its share.
    """
    node, counts = ["host", "template"], ("n", "labelled", "bad")
    tree = tree.withColumn("segment", F.when(F.col("open"), F.get("segments", F.lit(level))))
    child = tree.filter(F.col("segment").isNotNull()).groupBy(*node, "segment")
    child = child.agg(*[F.sum(c).alias(c) for c in counts], F.count("*").alias("paths"))
    parent = child.groupBy(*node).agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in (*counts, "paths")])
    rare = (F.col("children") > CHILDREN) & (F.col("n") * F.col("children") <= F.col("all_n"))
    own = _differs(F.col("bad"), F.col("labelled"), F.col("all_bad"), F.col("all_labelled"))
    known = child.join(parent, node).withColumns(
        {"marked": F.col("segment").startswith("<*"), "closed": (F.col("all_paths") == 1) | (F.col("all_labelled") == 0),
         "worse": F.col("bad") * F.col("all_labelled") > F.col("all_bad") * F.col("labelled")}
    ).withColumn("own", ~F.col("marked") & ~rare & own)
    # siblings that differ from their parent in the same direction, taken together
    kin = known.filter("own").groupBy(*node, "worse").agg(F.count("*").alias("kin"), *[F.sum(c).alias(f"kin_{c}") for c in counts])
    alike = (F.col("kin") > 1) & ~_differs(F.col("bad"), F.col("labelled"), F.col("kin_bad"), F.col("kin_labelled"))
    name = F.when(F.col("marked"), F.col("segment")).when(~F.col("own"), "*").when(alike, F.when(F.col("worse"), "(+)").otherwise("(-)")).otherwise(F.col("segment"))
    branch = known.join(kin, [*node, "worse"], "left").select(*node, "segment", name.alias("branch"), "closed", "all_paths")
    rest = F.when(F.col("all_paths") == 1, F.array_join(F.slice("segments", F.lit(level + 1), F.size("segments")), "/")).otherwise("<**>")
    longer = F.concat("template", F.lit("/"), F.when(F.col("closed"), rest).otherwise(F.col("branch")))
    return tree.join(branch, [*node, "segment"], "left").select(
        "host", "segments", *counts, F.coalesce(longer, "template").alias("template"),
        (F.coalesce(~F.col("closed"), F.lit(False)) & (F.size("segments") > level + 1)).alias("open"),
    )


def templates(examples: DataFrame) -> DataFrame:
    """The tree: ``host, segments, n, template, bad_share`` per host and shaped path, the share that of its template.

    ``examples`` holds ``host``, ``path`` and ``bad`` (1, 0, or null where unlabelled); nulls in host or path
    count as empty. Rows that repeat count as often as they come; of a tie nothing depends on an order. An empty
    table gives an empty tree.
    """
    shaped = examples.select(
        F.coalesce("host", F.lit("")).alias("host"), segments_of(F.coalesce("path", F.lit(""))).alias("segments"), F.col("bad").cast("double").alias("bad")
    )
    tree = shaped.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")
    )
    # small tables, written at every level: each level reads its own twice
    tree, level = staged(tree.withColumns({"template": F.lit(""), "open": F.size("segments") > 0}), "url-tree"), 0
    while tree.filter("open").limit(1).count():
        tree, level = staged(_divided(tree, level), "url-tree"), level + 1
    overall = examples.agg(F.avg(F.col("bad").cast("double"))).first()[0]  # one number
    hosts = tree.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    hosts = hosts.select("host", ((F.col("b") + PRIOR * (0.5 if overall is None else overall)) / (F.col("l") + PRIOR)).alias("host_share"))
    nodes = tree.groupBy("host", "template").agg(*[F.sum(c).alias(f"t_{c}") for c in ("labelled", "bad")])
    nodes = nodes.join(hosts, "host").withColumn("bad_share", (F.col("t_bad") + PRIOR * F.col("host_share")) / (F.col("t_labelled") + PRIOR))
    return tree.join(nodes.select("host", "template", "bad_share"), ["host", "template"]).select("host", "segments", "n", "template", "bad_share")


def judge_urls(pages: DataFrame, examples: DataFrame, rules: tuple[Rule, ...] = (), url: str = "url", limit: float = 0.5) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``template``, ``bad_share`` and ``verdict`` (allow or block) to every row.

    A fitting rule decides; else a template with ``bad_share > limit`` is blocked. ``examples`` should contain
    the pages themselves (labelled or not); a page whose host and shape it lacks is allowed. Null urls and urls
    without ``://`` have an empty host and path. Rows repeat as they come, other columns stay, and columns that
    already have one of the added names are replaced. A host and shape that many pages have is looked up in parts;
    the two are compared by a 64-bit hash.
    """
    added = ("host", "path", "rule", "template", "bad_share", "verdict")
    names = [c for c in pages.columns if c.lower() not in added]
    link = F.col(f"`{url}`")
    parts = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host_of(link).alias("host"), path_of(link).alias("path"), F.xxhash64(link).alias("salt"))
    parts = parts.withColumn("key", F.xxhash64("host", segments_of(F.col("path"))))
    tree = staged(templates(examples).select(F.xxhash64("host", "segments").alias("key"), "n", "template", "bad_share"), "url-templates")
    many = tree.agg(F.sum("n")).first()[0] or 0
    heavy = [r["key"] for r in tree.filter(F.col("n") > max(many // 200, 1000)).select("key").collect()]  # 200 rows at most
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") > limit, "block").otherwise("allow")
    found = spread_lookup(parts, "key", tree.drop("n"), heavy, F.col("salt"))
    judged = found.withColumns({"rule": text, "verdict": F.coalesce(verdict, method)})
    return judged.select("row.*", *added) if names else judged.select(*added)
