import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, substring_dedup
from plumbline.llm.bitfilter import BitFilter, build
from tests.llm.helpers import ODD, UPPER, documents, edited, empty_documents, odd_documents, prose, words


def contained(text, item, n=5):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words((t or "").lower())] for i in range(len(w) - n + 1)}
    own = grams(item)
    return (len(own), len(own & grams(text)))


def test_contained_items_equal_brute_force(spark):
    items = [prose(5000 + k, 8 + 5 * k, 3000) for k in range(8)] + [None, "too short", items_with_repeats()]
    texts = [prose(k, 60, 3000) for k in range(20)]
    texts += [prose(k, 2000, 3000) + " " + edited(items[k % 8], k, k // 8).upper() + " " + prose(k + 1, 900, 3000) for k in range(40)]
    texts += [items[2]] * 30 + [items_with_repeats() + " and more"]
    found = decontaminate.find_contained(
        documents(spark, texts).selectExpr("*", "1 as item_id", "2 as h"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "3 as partition", "4 as doc_id"),
    ).collect()
    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            n, shared = contained(t, item)
            if n and shared >= 0.8 * n:
                want.add((i, j, n, shared))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found} == want
    assert len(found) == len(want) > 40


def items_with_repeats():
    return "round and round and round and round and round and round it goes"


def test_contaminated_rows_go_and_others_stay(spark):
    items = spark.createDataFrame([(1, prose(77, 40, 3000))], "item_id long, text string")
    docs = documents(spark, [prose(1, 99, 3000), "x " + prose(77, 40, 3000), None, ""])
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 2, 3}
    assert decontaminate.remove_contaminated(docs, items.filter("false")).count() == 4
    assert decontaminate.remove_contaminated(empty_documents(spark), items).count() == 0
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "item_id long, text string")
    assert decontaminate.find_contained(odd_documents(spark), odd).count() > 0


def sets_of(text, n):
    w = words((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components_of(texts, n, percent):
    own, root = [sets_of(t, n) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(texts)), 2):
        if own[a] and own[b]:
            shared = len(own[a] & own[b])
            if 100 * shared >= percent * (len(own[a]) + len(own[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(own[i]), find(i)) for i in range(len(texts))}


def families():
    texts = []
    for k in range(6):
        base = prose(100 + k, 60 + 40 * k, 900)
        texts += [edited(base, 10 * k + j, j % 5) for j in range(25)]
    # a family whose middle is missing: many members are linked through others only
    base = prose(999, 130, 900)
    texts += [edited(base, 7000 + j, 2 + j % 3) for j in range(120)]
    texts += [prose(k, 3 + k % 9, 5) for k in range(60)] + ["only two", "ONLY two", "", None, "same again", "same again"]
    return texts


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("frequent", [0, 5, 64])
def test_classes_equal_all_pairs(spark, monkeypatch, n, percent, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    texts = families()
    like = jaccard_join.Likeness(n, percent)
    rows = jaccard_join.classes(documents(spark, texts).selectExpr("*", "1 as node", "2 as n", "3 as sig"), like).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == components_of(texts, n, percent)
    assert len(rows) == len(texts)


def test_signatures_of_similar_sets_meet(monkeypatch):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 200, 1 << 12).astype(np.uint8)
    for percent in (80, 90):
        like = jaccard_join.Likeness(3, percent)
        for size in (2, 3, 5, 9, 10, 11, 40, 150, 400):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                gone = rng.integers(0, like.spare(len(a)) + 1)
                b = np.unique(np.r_[a[gone:], rng.integers(0, 2**63, rng.integers(0, 3 + size // 20), dtype=np.uint64)])
                shared = len(np.intersect1d(a, b))
                if like.linked(shared, len(a), len(b)) and not np.array_equal(a, b):
                    assert len(np.intersect1d(jaccard_join._signatures(a, cells, like), jaccard_join._signatures(b, cells, like)))


def test_one_of_a_group_stays(spark):
    base = prose(5, 200, 900)
    texts = [base, edited(base, 1, 1), base, prose(6, 150, 900), "", None, ""]
    docs = documents(spark, texts, 10)
    kept = jaccard_join.keep_one(docs.unionByName(docs.filter("doc_id in (10, 13)")))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [10, 13, 14, 15, 16]


def test_only_rows_that_may_go_are_moved(spark, capsys):
    texts = [prose(k, 60, 900) for k in range(300)]
    docs = documents(spark, [*texts, texts[7], texts[250], None], 10)
    kept = jaccard_join.keep_one(docs.unionByName(docs.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))))
    ids = [r["doc_id"] for r in kept.collect()]
    # the null id goes with its copy of document 12
    assert sorted(ids) == [*range(10, 310), 312]
    capsys.readouterr()
    kept.explain()
    plan = capsys.readouterr().out
    assert "Union" in plan and "LeftAnti" in plan and "held(" in plan


def test_join_of_odd_and_empty_tables(spark):
    rows = jaccard_join.classes(odd_documents(spark)).collect()
    assert len(rows) == 3 * len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert jaccard_join.classes(empty_documents(spark)).count() == 0
    assert jaccard_join.keep_one(empty_documents(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("id * 7919 % 1009 as leader", "(id + 1) * 7919 % 1009 as member")
    rows = jaccard_join.components(chain).collect()
    assert len(rows) == 201 and len({r["root"] for r in rows}) == 1


def cut(texts, window):
    first, out = {}, {}
    for i, text in enumerate(texts):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 25, 7])
def test_repeats_equal_brute_force(spark, window):
    shared = [prose(300 + k, 45 + 6 * k, 900) for k in range(6)]
    texts = [prose(k, 120, 900) + " " + shared[k % 6] + "\n" + shared[(k + 1) % 6] + " " + prose(k + 50, 30, 900) for k in range(24)]
    texts += [shared[5]] * 5 + ["a a a " * 60, "a a a " * 40, *ODD]
    docs = documents(spark, texts).selectExpr("*", "1 as n_words", "2 as place", "3 as version")
    rows = substring_dedup.remove_repeats(docs, window).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows}
    assert got == cut(texts, window)


def test_repeats_of_odd_and_empty_tables(spark):
    rows = substring_dedup.remove_repeats(odd_documents(spark)).collect()
    assert len(rows) == 3 * len(ODD) and all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)
    assert substring_dedup.remove_repeats(empty_documents(spark)).count() == 0


def test_levels_double():
    assert substring_dedup.levels_for(50) == [13, 25, 50]
    assert substring_dedup.levels_for(20) == [20]


def test_filter_built_in_blocks_equals_one_built_at_once(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) as key", "cast(id % 3 + 1 as int) as levels")
    empty = BitFilter.sized(40_000, 12, 1 << 21)
    from pyspark.sql import functions as F

    built = build(rows, "key", empty, F.col("levels"))
    keys = np.array([r["key"] for r in rows.collect()], dtype=np.int64).view(np.uint64)
    assert (built.levels(keys) >= np.arange(20_000) % 3 + 1).all()
    assert built.holds(keys ^ np.uint64(0x5555), 0).mean() < 0.02


def test_sifting_changes_nothing(spark):
    docs, like = documents(spark, families()), jaccard_join.Likeness(5, 80)
    plain, sifted = (sorted(map(tuple, jaccard_join.classes(docs, like, sift=s).select("doc_id", "component_id").collect())) for s in (False, True))
    assert plain == sifted and len(plain) > len({c for _, c in plain})
