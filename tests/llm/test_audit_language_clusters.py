import hashlib
import random
import unicodedata
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import filter_audit, language_id, va_clusters
from plumbline.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents, empty_documents, odd_documents, prose, words

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(rows, labels):
    """``rows``: id, text, part. One dictionary entry per part, order and step."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    counted, parts = {}, {p or "" for _, _, p in rows}
    removed = Counter()
    for p in parts:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                counted[p, order, step] = [0] * 6
    for i, t, p in rows:
        t = t or ""
        w = words(t)
        fails = "".join(
            n for n, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                any(c in "#$%&*|" for c in t), t in first and (i is None or i > first[t]),
            ), strict=True) if bad
        )
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                own, before = counted[p or "", order, k + 1], any(x in fails for x in order[:k])
                own[0] += f not in fails and not before
                own[2] += f in fails and before
                own[3] += fails == f
                if f in fails and not before:
                    own[1] += 1
                    own[4] += i in good
                    own[5] += i in toxic
                    removed[p or "", f] += 1
    return {(p, o, s, *v, removed[p, o[s - 1]]) for (p, o, s), v in counted.items()}


def audited(out):
    return set(map(tuple, out.select("part", "filter_order", "step", *filter_audit.OUTCOMES, "shapley").collect()))


def audit_rows():
    texts = [*ODD, *(prose(k, 150 + 20 * k, 60 + 40 * k) for k in range(12)), "AB cd" * 300, "# " + prose(3, 250), *[prose(5, 250)] * 6]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts * 2)]
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, len(rows), 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (900, 1, 1)]
    return rows, labels


def test_audit_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 1)
    rows, labels = audit_rows()
    rows += rows[:20] + [(None, t, p) for _, t, p in rows[:9]] + [(None, "only without an id", "fr")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    docs = docs.selectExpr("*", "1 as mask", "'x' as part", "2 as code", "'y' as digest")
    assert audited(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == plain_audit(rows, labels)


def test_audit_takes_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty_documents(spark), none).count() == 0
    out = filter_audit.audit(odd_documents(spark), none)
    assert out.count() == 600 and out.filter("good_lost + toxic_lost > 0").count() == 0
    n = odd_documents(spark).count()
    assert out.filter("kept + removed + redundant > 0 and step = 1").agg(F.min(F.col("kept") + F.col("removed"))).first()[0] == n


def test_fields_hold_large_counts(spark):
    rows = [("p", 0b00001 | 1 << 5, 1 << 40), ("p", 0b00011, 1 << 41), ("p", 0, 7), ("p", 0b11111, 3), ("p", 0b11111, -3)]
    out = filter_audit.tally(spark.createDataFrame(rows, "part string, code int, weight long"))
    row = out.filter("filter_order = 'BACDE' and step = 2").first()
    assert (row["kept"], row["removed"], row["redundant"], row["unique_fails"], row["good_lost"]) == (7, 1 << 40, 1 << 41, 1 << 40, 1 << 40)
    # half of B's rows go to B, where it comes before A
    assert row["shapley"] == 120 * (1 << 40) + 60 * (1 << 41)


def plain_clusters(rows, count=16, rounds=3):
    v = {}
    for i, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x):
            v.setdefault(i, []).append([int(np.floor(64 * float(np.float32(c)))) for c in x])
    flat = [(i, x) for i, own in v.items() for x in own]
    seeds = sorted(flat, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    centroids = [x for _, x in seeds]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in flat:
            groups.setdefault(near(x)[1], []).append(x)
        for k, own in groups.items():
            centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, near(x)[1], near(x)[0]) for i, x in flat]
    total = Counter()
    for _, k, d in found:
        total[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, k, d, total[k], sum(total.values()), digest[k]) for i, k, d in found)


def vectors(n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    return [(i, [float(c) for c in np.float32(middles[i % 9] + spread * rng.normal(size=64))]) for i in range(n)]


@pytest.mark.parametrize("sample", [4096, 5])
def test_clusters_equal_a_plain_version(spark, tmp_path, monkeypatch, sample):
    rows = vectors(300, 1) + [(500 + i, [0.25] * 64) for i in range(40)] + vectors(3, 1)
    rows += [(600, None), (601, []), (602, [0.5] * 63), (603, [None] + [0.5] * 63), (604, [float("nan")] * 64), (605, [float("inf")] + [0.0] * 63), (606, [900.0, *[-900.0] * 63])]
    monkeypatch.setattr(va_clusters.cluster, "__defaults__", (*va_clusters.cluster.__defaults__[:-1], sample))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as cluster").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op13_centroid_clusters"](spark, str(tmp_path))
    got = sorted(map(tuple, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()))
    assert got == plain_clusters(rows)


def test_cells_settle_most_vectors(spark):
    table = spark.createDataFrame(vectors(2000, 2), "vec_id long, embedding array<float>")
    rows, _ = va_clusters.cluster(table, F.col("vec_id"), centroids=9, rounds=3, size=64, scale=64)
    assert rows.filter("compared = 0").count() > 1400 and rows.agg(F.max("compared")).first()[0] <= 9


def test_bounds_hold_every_distance():
    rng = np.random.default_rng(3)
    v = rng.integers(-40, 40, size=(500, 7))
    cells = va_clusters.Cells.of(v[:200])
    packed, inside = cells.pack(v)
    codes = va_clusters.unpack(packed, 7)
    c = rng.integers(-60, 60, size=(5, 7))
    least, most = cells.bounds(c)
    low, high = (sum(t[j][codes[:, j]] for j in range(codes.shape[1])) for t in (least, most))
    true = ((v[:, None] - c) ** 2).sum(axis=2)
    assert inside[:200].all() and (low <= true)[inside].all() and (true <= high)[inside].all()


def test_clusters_of_few_and_no_vectors(spark, tmp_path):
    for k, rows in enumerate(([], [(1, [0.5] * 64)], [(1, [0.5] * 64), (None, [0.75] * 64), (1, [0.5] * 64)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        out = QUERIES["op13_centroid_clusters"](spark, f"{tmp_path}/{k}").collect()
        assert len(out) == len(rows) and all(r["distance"] == r["inertia"] == 0 for r in out)
    huge = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="a long does not hold"):
        va_clusters.cluster(huge, F.col("vec_id"), centroids=2, rounds=1, size=64, scale=64)[0].collect()


TONGUES = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "ijklmnop"}


def tongue(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(TONGUES[lang], k=rng.randrange(2, 8))) for _ in range(n)) + f" {seed} 12!"


def test_languages_are_told_apart(spark, tmp_path):
    rows = [(i, tongue(lang, i), lang) for i in range(240) for lang in [sorted(TONGUES)[i % 3]]]
    rows += [(900, None, "xx"), (901, "123 !?", "yy"), (902, "", "zz"), (903, "abc", None), (904, "ÄÖ 日本", "xx"), (None, "abab", "xx")]
    rows += [(905 + k, "abab", "yy") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as lang_pred", "1 as hash", "2 as features")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in QUERIES["op12_language_id"](spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    held = [r for r in rows[:240] if out[r[0]]["held_out"]]
    assert {r[0] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(out[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held) > 50
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[904]["lang_pred"] in TONGUES


def test_grams_and_frequencies_equal_a_plain_version(spark):
    texts = [*ODD, *(tongue("xx", k) for k in range(5))]

    def plain(text):
        low = "".join(c.lower()[0] if unicodedata.category(c).startswith("L") else " " for c in text or "")
        low = f" {' '.join(low.split())} "
        grams = [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)]
        return Counter(g for g in grams if g.strip() and g != " ") if low.strip() else Counter()

    seen = {}
    for t in texts:
        mine, want = Counter(language_id._grams(t or "").tolist()), plain(t)
        assert sum(mine.values()) == sum(want.values()) and sorted(mine.values())[-3:] == sorted(want.values())[-3:]
        for f in mine:
            seen[f] = seen.get(f, 0) + 1
    total, df = language_id.document_frequencies(documents(spark, texts).selectExpr("coalesce(text, '') as text"))
    assert total == sum(bool(plain(t)) for t in texts) and {int(f): int(df[f]) for f in np.flatnonzero(df)} == seen


def test_leader_is_sparse_and_temperature_is_honest():
    rng = np.random.default_rng(5)
    examples = [(int(y), np.array([int(y), *f]), np.array([1.0, 0.2, 0.2])) for y, f in zip(rng.integers(0, 2, 300), rng.integers(2, 400, (300, 2)), strict=True)]
    weights, bias = language_id.train(examples, 2, 400)
    assert weights[0, 0] > 0 > weights[1, 0] and (weights[2:] == 0).mean() > 0.3
    logits = rng.normal(size=(4000, 1)) * np.array([[1.0, -1.0]])
    y = (rng.random(4000) > 1 / (1 + np.exp(-2 * logits[:, 0]))).astype(int)
    assert language_id.temperature(logits * 5, y) == pytest.approx(5, rel=0.15)


def test_language_models_of_odd_tables(spark):
    assert language_id.fit(empty_documents(spark)).languages == ()
    none = language_id.predict(odd_documents(spark), language_id.fit(empty_documents(spark)))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    one = language_id.predict(odd_documents(spark), language_id.fit(odd_documents(spark)))
    assert {r["lang_pred"] for r in one.collect()} == {"und", "en"} and one.count() == odd_documents(spark).count()
