import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ngram_model, toxicity, url_templates
from tests.llm.helpers import ODD, UPPER, documents, empty_documents, odd_documents, prose, words


def base_scores(texts, train):
    own = [[*words((t or "").translate(UPPER)), None] for t in texts]
    counts = Counter(w for i in train for w in own[i])
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in enumerate(own)
    }


@pytest.mark.parametrize("frequent", [0, 20, 1 << 16])
def test_base_scores_equal_a_plain_version(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_model, "FREQUENT", frequent)
    texts = [*ODD, *(prose(k, 90, 300).upper() for k in range(60)), "never seen words"]
    docs = documents(spark, texts).selectExpr("*", "1 as key", "2 as version", "3 as n")
    held = ngram_model.held_out(docs["doc_id"])
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = ngram_model.score(docs, ngram_model.train(docs.filter(~held))).collect()
    want = base_scores(texts, train)
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and -math.inf < r["score"] < 0


def test_pairs_help_on_held_out_text(spark):
    rng = random.Random(4)
    follow = {w: rng.sample(range(200), 4) for w in range(200)}

    def chain(seed):
        own, w, out = random.Random(seed), seed % 200, []
        for _ in range(120):
            w = own.choice(follow[w])
            out.append(f"w{w}")
        return " ".join(out)

    docs = documents(spark, [chain(k) for k in range(300)])
    held = ngram_model.held_out(docs["doc_id"])
    rows = ngram_model.score(docs.filter(held), ngram_model.train(docs.filter(~held))).collect()
    assert sum(r["score"] for r in rows) > 0.6 * sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("kind", [ngram_model.WORDS, ngram_model.PAIRS])
def test_packed_counts_come_back(kind):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 200).astype(np.uint64))
    counts = np.array([1, 254, 255, 256, 70_000, 1 << 40] * 33 + [3, 255])
    assert (ngram_model._get_keys(kind, ngram_model._put_keys(kind, keys)) == keys).all()
    assert (ngram_model._get_counts(ngram_model._put_counts(counts), 200) == counts).all()


@pytest.mark.parametrize("blocks", [1, 40])
def test_every_pair_counts_however_rare_and_many(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_model, "BLOCKS", blocks)
    texts = [prose(k, 200, 5000) for k in range(50)]
    model = ngram_model.train(documents(spark, texts))
    apart = [" ".join(t.split(" ")[::-1]) for t in texts]
    rows = {r["doc_id"]: r["score"] for r in ngram_model.score(documents(spark, [*texts, *apart, *texts]), model).collect()}
    own = [[*words(t.translate(UPPER)), None] for t in [*texts, *apart]]
    single = Counter(w for t in own[:50] for w in t)
    pairs = Counter(p for t in own[:50] for p in zip(["<s>", *t], t))
    assert sum(pairs.values()) - len(pairs) < 0.05 * len(pairs)  # nearly all pairs are met once
    weight = max((sum(pairs.values()) - len(pairs)) / model.tokens, 0.01)

    def rough(n):
        low = ngram_model.RATIO ** math.floor(math.log(n, ngram_model.RATIO) + 1e-9) if n else 0
        return low * (1 + ngram_model.RATIO) / 2 + (0 < low <= 1) * (1 - ngram_model.RATIO) / 2

    for k, t in enumerate(own):
        want = 0.0
        for a, b in zip(["<s>", *t], t):
            context = 50 if a == "<s>" else rough(single[a])
            want += math.log10((1 - weight) * (rough(single[b]) + 1) / (model.tokens + model.distinct + 1) + weight * min(rough(pairs[a, b]) / max(context, 1), 1))
        assert rows[k] == pytest.approx(want, rel=0.03)  # filters say too much of a few
    assert all(rows[k] == pytest.approx(rows[100 + k]) for k in range(50))


def test_pairs_after_unknown_words_are_not_inflated():
    model = ngram_model.Model(None, 1000, 100, 10, 0.9)
    low = model.logs(np.array([0.2]), np.array([60.0]), np.array([0.0]))
    assert low[0] < math.log10(0.2)


def test_scores_of_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    model = ngram_model.train(docs)
    assert len(ngram_model.score(docs, model).collect()) == 3 * len(ODD)
    assert ngram_model.score(empty_documents(spark), model).count() == 0
    rows = ngram_model.score(docs, ngram_model.train(empty_documents(spark))).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def labelled(n, seed=0):
    bad, rng, out = ["grub", "blight", "rotter"], random.Random(seed), []
    for k in range(n):
        parts = [prose(seed * 10_000 + 50 * k + j, 12, 300) for j in range(6)]
        y = int(rng.random() < 0.3)
        if y:
            spot = rng.randrange(6)
            parts[spot] = parts[spot] + f", you {rng.choice(bad)}"
        out.append((k, ". ".join(parts) + ".", y))
    return out


def test_sentences_are_found_from_document_labels(spark):
    train = spark.createDataFrame(labelled(400), "doc_id long, text string, toxic int")
    model = toxicity.fit(train.selectExpr("*", "1 as y", "2 as word"))
    test = labelled(150, 1)
    docs = spark.createDataFrame(test, "doc_id long, text string, toxic int").selectExpr("*", "'x' as score")
    for r in toxicity.score(docs, model).collect():
        assert (r["score"] >= 0.5) == bool(r["toxic"])
        found = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
        assert len(found) == r["toxic"] and all(re.search("grub|blight|rotter", s) for s in found)


def test_toxicity_of_odd_tables_and_missing_labels(spark):
    model = toxicity.Model({"grub": 9.0}, -8.0)
    rows = toxicity.score(odd_documents(spark), model).collect()
    assert len(rows) == 3 * len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert toxicity.score(empty_documents(spark), model).count() == 0
    none = empty_documents(spark).selectExpr("*", "cast(null as int) as toxic")
    assert toxicity.fit(none).weights == {}
    odd = odd_documents(spark).selectExpr("*", "cast(if(doc_id % 2 = 0, 1, null) as int) as toxic")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, toxicity.fit(odd)).collect())


def test_gradient_descends():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    w, b = toxicity._train(y, np.full(200, 3), np.arange(200), np.arange(200), y, 2)
    assert w[1] > 3 > w[0] and b < 0


RULES = (
    url_templates.Rule("block", "net/"), url_templates.Rule("allow", "example.net/en/"),
    url_templates.Rule("block", "example.com/de/"), url_templates.Rule("allow", "org/fr/"),
)

URLS = {
    "http://a.example.net/de/1": ("a.example.net", "/de/1", "net/", "block"),
    "https://EXAMPLE.net/en/x?y=/de/": ("example.net", "/en/x", "example.net/en/", "allow"),
    "https://notexample.net/en/x": ("notexample.net", "/en/x", "net/", "block"),
    "https://www.example.com/de/7#t": ("www.example.com", "/de/7", "example.com/de/", "block"),
    "https://example.com/de": ("example.com", "/de", None, "allow"),
    "ftp://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://b.net?q=://c.org/fr/": ("b.net", "", None, "allow"),
    "//example.net/en/1": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://a\nb.net/x\ny#z": ("a\nb.net", "/x\ny", "net/", "block"),
}


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def examples(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, bad int")


def test_parts_and_rules(spark):
    urls = [*URLS, *URLS]
    rows = url_templates.judge_urls(pages(spark, urls).selectExpr("*", "1 as host", "2 as s0", "'v' as verdict"), examples(spark, []), RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows.collect()}
    assert got == {i: URLS[u] for i, u in enumerate(urls)}
    assert url_templates.judge_urls(pages(spark, []), examples(spark, []), RULES).count() == 0


def test_impure_templates_are_rejected(spark):
    known = [("h.io", f"/news/{k}", 0) for k in range(60)] + [("h.io", f"/casino/{k}.html", int(k % 10 > 0)) for k in range(60)]
    known += [("h.io", f"/tag{k}", None) for k in range(50)] + [("k.io", f"/casino/{k}.html", 0) for k in range(30)] + [(None, None, None)]
    urls = ["http://h.io/news/999", "http://h.io/casino/1234.html", "http://h.io/tag7", "http://k.io/casino/5.html", "http://new.io/casino/5.html"]
    rows = url_templates.judge_urls(pages(spark, urls), examples(spark, known)).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {0: "allow", 1: "block", 2: "allow", 3: "allow", 4: "allow"}
    by_page = {r["page_id"]: r["template"] for r in rows}
    assert by_page[0] == "/news/<*>" and by_page[1] == "/casino/<*>.html" and by_page[2] == "/*"


def shares(spark, known):
    return {(r["host"], "/".join(r["segments"])): (r["template"], r["bad_share"]) for r in url_templates.templates(examples(spark, known)).collect()}


def test_similar_branches_merge(spark):
    known = [("h.io", f"/{lang}/{k}", int(k % 5 == 0)) for lang in ("en", "de", "fr") for k in range(100)]
    known += [("h.io", f"/{name}/{k}", 1) for name in ("spam", "scam") for k in range(100)]
    tree = shares(spark, known)
    assert all(tree["h.io", f"{x}/<*>"][1] < 0.3 for x in ("en", "de", "fr"))
    # both are worse than their parent, and alike
    assert tree["h.io", "spam/<*>"] == tree["h.io", "scam/<*>"] and tree["h.io", "spam/<*>"][0] == "/(+)/<*>" and tree["h.io", "spam/<*>"][1] > 0.95


def test_deep_paths_are_told_apart(spark):
    known = [("h.io", f"/x/y/z/{kind}/more/{k}", int(kind == "bad")) for kind in ("bad", "good") for k in range(200)]
    urls = [f"http://h.io/x/y/z/{kind}/more/{k}" for kind in ("bad", "good") for k in range(3)] + ["http://h.io" + "/deep" * 12]
    rows = url_templates.judge_urls(pages(spark, urls), examples(spark, [*known, ("h.io", "/deep" * 12, None), ("h.io", "/deep" * 11, 0)])).collect()
    assert [r["verdict"] for r in sorted(rows, key=lambda r: r["page_id"])] == ["block"] * 3 + ["allow"] * 4


def plain_tree(known):
    """Host and shaped path to template, for paths of words and numbers only."""
    table = {}
    for host, path, bad in known:
        key = host or "", tuple("<*>" if x.isdigit() else x for x in (path or "").split("/") if x)
        n = table.setdefault(key, [0, 0, 0])
        n[0] += 1
        n[1] += bad is not None
        n[2] += bad or 0

    def differs(own, whole):
        share = (whole[2] + 1) / (whole[1] + 2)
        return abs(own[2] - share * own[1]) > url_templates.DEVIATIONS * math.sqrt(share * (1 - share) * own[1])

    total = lambda keys: [sum(table[k][i] for k in keys) for i in range(3)]
    out = {}

    def grow(keys, level, template):
        deeper = {}
        for k in keys:
            if len(k[1]) > level:
                deeper.setdefault(k[1][level], []).append(k)
            else:
                out[k] = template
        below = [k for own in deeper.values() for k in own]
        whole = total(below)
        if below and (len(below) == 1 or not whole[1]):
            for k in below:
                out[k] = template + "/" + ("/".join(k[1][level:]) if len(below) == 1 else "<**>")
            return
        sums = {s: total(own) for s, own in deeper.items()}
        alone = {
            s for s, own in sums.items()
            if not s.startswith("<*") and not (len(sums) > url_templates.CHILDREN and own[0] * len(sums) <= whole[0]) and differs(own, whole)
        }
        worse = {s: own[2] * whole[1] > whole[2] * own[1] for s, own in sums.items()}
        branches = {}
        for s, own in deeper.items():
            kin = [x for x in alone if worse[x] == worse[s]]
            name = s if s.startswith("<*") or s in alone else "*"
            if s in alone and len(kin) > 1 and not differs(sums[s], total([k for x in kin for k in deeper[x]])):
                name = "(+)" if worse[s] else "(-)"
            branches.setdefault(name, []).extend(own)
        for name, own in branches.items():
            grow(own, level + 1, f"{template}/{name}")

    for host in {k[0] for k in table}:
        grow([k for k in table if k[0] == host], 0, "")
    return out


def test_tree_equals_a_plain_version(spark):
    rng, known = random.Random(11), []
    for _ in range(3000):
        host, deep = rng.choice(["a.io", "b.io"]), rng.randrange(0, 6)
        path = [rng.choice(["en", "de", "shop", "spam", "blog", *(f"t{k}" for k in range(30) if level == 1)]) if rng.random() < 0.8 else str(rng.randrange(99)) for level in range(deep)]
        chance = 0.9 if "spam" in path[:3] else 0.6 if "shop" in path[:2] else 0.1
        known.append((host, "/" + "/".join(path), None if rng.random() < 0.4 else int(rng.random() < chance)))
    known += [(None, None, None), ("c.io", "/en/1", None), ("c.io", "/en/x/y", None)]
    tree = shares(spark, known)
    want = {(h, "/".join(p)): t for (h, p), t in plain_tree(known).items()}
    assert {k: t for k, (t, _) in tree.items()} == want and len(set(want.values())) > 30
