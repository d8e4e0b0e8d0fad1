import os
import re
import unicodedata

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import quality_rules
from plumbline.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import documents, edited, prose, words
from tests.llm.test_counts_and_packing import expected_pieces
from tests.llm.test_quality_and_lines import measured
from tests.llm.test_search_and_joins import components_of, contained

LINE = "All rights are reserved by us."


def corpus():
    texts = [prose(k, 130, 3000) + "\n" + LINE + "\n" + prose(500 + k, 20, 3000) for k in range(40)]
    texts += [prose(k, 70 + 3 * k, 3000) for k in range(100, 160)]
    texts += [edited(texts[50 + k // 6], k, k % 4) for k in range(60)]
    texts += [prose(300 + k, 90, 3000) + " " + prose(9000 + k % 3, 40, 3000) + " " + prose(400 + k, 50, 3000) for k in range(9)]
    texts += [" ".join(w + "***" for w in prose(k, 120, 3000).split()) for k in range(600, 612)]
    texts += ["\n".join([prose(k, 9)] * 12) for k in range(700, 706)] + ["short text", "", None]
    return texts


def votes(text):
    """The vote of every rule in order, and whether the base fails; written out without the rules' own texts."""
    text = text or ""
    n, chars, symbols, dup, repeat = measured(text)
    w, upper = words(text), sum(unicodedata.category(c) == "Lu" for c in text)
    marks, lines = len(re.findall("[!?]{2,}", text)), sum(bool(words(x)) for x in text.split("\n"))
    bad = {
        "length": n < 50,
        "symbols": symbols * 10 > n,
        "repetition": repeat * 5 > n * 2 or (lines > 3 and dup * 10 > lines * 3) or (50 <= n <= 2000 and len(set(w)) * 6 < n),
        "shouting": upper * 10 > chars * 3 or marks * 10 > n,
        "word_length": chars < 2 * n or chars > 14 * n,
    }
    good = {
        "length": n >= 100,
        "symbols": symbols * 50 <= n,
        "repetition": repeat * 5 <= n and dup * 10 <= lines,
        "shouting": upper * 10 <= chars and marks * 100 <= n,
        "word_length": 3 * n <= chars <= 10 * n,
    }
    own = [-1 if bad[r.name] else 1 if good[r.name] else 0 for r in quality_rules.RULES]
    return own, n < 50 or 100 * repeat > 50 * n


def plain_pipeline(texts, items):
    own = [votes(t) for t in texts]
    patterns = np.array([v for v, _ in own])
    share, on_good, on_bad = quality_rules.estimate(patterns, np.ones(len(texts)))
    odds = np.log(share / (1 - share)) + np.where(patterns > 0, np.log(on_good / (1 - on_bad)), 0).sum(axis=1)
    odds += np.where(patterns < 0, np.log((1 - on_good) / on_bad), 0).sum(axis=1)
    kept = {i: t for i, t in enumerate(texts) if odds[i] >= 0 and not own[i][1]}
    kept = {i: "\n".join(x for x in t.split("\n") if x != LINE) for i, t in kept.items()}
    ids = sorted(kept)
    groups = components_of([kept[i] for i in ids], 5, 80)
    kept = {i: kept[i] for k, i in enumerate(ids) if groups[k][1] == k}
    kept = {i: t for i, t in kept.items() if not any(n and shared >= 0.8 * n for n, shared in (contained(t, x) for x in items))}
    return {(i, p): x for i, t in kept.items() for p, x in enumerate(expected_pieces(t))}


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    texts, items = corpus(), [prose(9000 + k, 40, 3000) for k in range(3)]
    folder = str(tmp_path)
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        path = f"{folder}/{name}"
        after.write.parquet(path)
        assert 0 < spark.read.parquet(path).count() <= docs.count(), name
        docs = spark.read.parquet(path)
    rows = corpus_pipeline.run(spark, folder).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = plain_pipeline(texts, items)
    assert got == want and 60 < len({i for i, _ in got}) < 120
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_stages_take_an_empty_table(spark, tmp_path):
    from tests.llm.helpers import empty_documents

    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_documents(spark), str(tmp_path)).count() == 0


def test_queries_are_registered():
    known = entry.queries()
    assert {n for n in known if n.startswith("op")} == set(QUERIES) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    mine = QUERIES[name](spark, folder)
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(found.fetchall())
