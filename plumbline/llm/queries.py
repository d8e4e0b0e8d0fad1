"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    decontaminate,
    filter_audit,
    jaccard_join,
    language_id,
    line_templates,
    ngram_model,
    packing,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
    url_templates,
    va_clusters,
)
from plumbline.llm.common import table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(quality_rules.measure(docs).drop("text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality",
    )


_WORDS = "'[^\\x20\\x09-\\x0D]+'"

DECONTAMINATION_SQL = f"""WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), {_WORDS}) AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw) AS t),
n AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), {_WORDS}) AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw) AS t)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= n_shingles * 0.8 - 1e-9"""

JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0) AS t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(a, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.a)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

SUBSTRING_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w) AS t),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM x) AS t WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM rep),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.p) AS kept, count(*) AS n FROM o LEFT JOIN gone ON gone.doc_id = o.doc_id AND gone.p = o.p WHERE gone.p IS NULL GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


@query("op3_decontamination", DECONTAMINATION_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: a page's url ends in the number of the document it shows, whose quality label marks the page
URL_RULES = (
    url_templates.Rule("block", "net/"),
    url_templates.Rule("allow", "example.net/en/"),
    url_templates.Rule("block", "example.com/de/"),
    url_templates.Rule("allow", "org/fr/"),
)


@query("op10_url_filters")
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    known = pages.select(
        url_templates.host_of(F.col("url")).alias("host"),
        url_templates.path_of(F.col("url")).alias("path"),
    ).withColumn("doc_id", F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long"))
    examples = known.join(labels, "doc_id", "left").select("host", "path", "bad")
    judged = url_templates.judge_urls(pages, examples, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(toxicity.with_labels(docs.filter(~held), labels.filter(~held)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_ngram_scores")
def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = ngram_model.held_out(F.col("doc_id"))
    model = ngram_model.train(docs.filter(~held))
    scored = ngram_model.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_substring_dedup", SUBSTRING_SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_jaccard_join", JACCARD_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.classes(docs, jaccard_join.Likeness(words=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: every step's outcomes by mask on a table of 600 steps, then summed by part
AUDIT_SQL = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
 + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS mask
 FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, good, toxic, mask, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
 WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, step, bit, list_sum(list_transform(bits[: step - 1], lambda x: 1 << x)) AS earlier FROM
 (SELECT filter_order, bits, unnest(range(1, 6)) AS step, unnest(bits) AS bit FROM (SELECT filter_order, list_transform(string_split(filter_order, ''), lambda x: ascii(x) - 65) AS bits FROM o) AS t) AS u),
r AS (SELECT part, filter_order, step, bit, n, good, toxic, mask, (mask >> bit) & 1 = 1 AS fails, (mask & coalesce(earlier, 0)::INT) = 0 AS alive FROM c, s),
t AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (alive AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (alive AND fails), 0) AS removed,
 coalesce(sum(n) FILTER (NOT alive AND fails), 0) AS redundant, coalesce(sum(n) FILTER (mask = 1 << bit), 0) AS unique_fails,
 coalesce(sum(n) FILTER (alive AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (alive AND fails AND toxic), 0) AS toxic_lost
 FROM r GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM t"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def _cluster_sql(rounds: int = 3) -> str:
    """Rounds of assigning and moving, one after the other."""
    out = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND list_count(list_filter(embedding, lambda x: isfinite(x))) = 64),
x AS (SELECT vec_id, v, unnest(v) AS x, unnest(range(64)) AS i FROM v),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 16) AS t)"""
    for r in range(rounds + 1):
        out += f""",
d{r} AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM
 (SELECT vec_id, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) AS t GROUP BY vec_id)"""
        if r < rounds:
            out += f""",
c{r + 1} AS (SELECT c{r}.k, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(m ORDER BY i) AS c FROM
 (SELECT k, i, floor(sum(x) / count(*))::BIGINT AS m FROM x JOIN d{r} USING (vec_id) GROUP BY k, i) AS t GROUP BY k) AS n ON n.k = c{r}.k)"""
    return out + f"""
SELECT vec_id, d{rounds}.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY d{rounds}.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d{rounds} JOIN c{rounds} ON c{rounds}.k = d{rounds}.k"""


@query("op13_centroid_clusters", _cluster_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    seeds = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    assigned, centroids = va_clusters.cluster(vectors, seeds, centroids=16, rounds=3, size=64, scale=64)
    return va_clusters.summed(assigned.drop("compared"), centroids)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = toxicity.held_out(F.col("doc_id"), 3, 1)
    judged = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs.filter(~held)))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")
