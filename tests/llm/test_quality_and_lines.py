import re
from collections import Counter

import numpy as np

from plumbline.llm import line_templates, quality_rules
from tests.llm.helpers import ODD, documents, edited, empty_documents, named, odd_documents, prose, words


def measured(text):
    text = text or ""
    w = words(text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered, lines, dup = Counter(runs), set(), set(), 0
    for i, r in enumerate(runs):
        if seen[r] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_equal_a_plain_version(spark):
    texts = [*ODD, "a b c a b c a b", "x x x x x", "l\nl\n\n \nl\nm # $", *(prose(k, 200, 12) for k in range(20))]
    rows = quality_rules.measure(documents(spark, texts).selectExpr("*", "'old' as n_words")).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def corpus():
    good = [prose(k, 150, 3000) for k in range(200)]
    junk = [" ".join(w + "***" for w in prose(k, 120, 3000).split()) for k in range(15)]
    junk += [" ".join(w.upper() + "!!" for w in prose(k, 120, 3000).split()) for k in range(15)]
    junk += ["\n".join([prose(k, 9)] * 12) for k in range(15)]
    return good, junk


def test_single_defects_are_rejected_and_clean_texts_kept(spark):
    good, junk = corpus()
    kept = {r["doc_id"] for r in quality_rules.filter_documents(documents(spark, good + junk)).collect()}
    assert kept == set(range(len(good)))


def test_posteriors_follow_the_votes():
    patterns = np.array([[1, 1, 1], [-1, 1, 1], [1, 0, 1], [0, 0, 0]])
    share, on_good, on_bad = quality_rules.estimate(patterns, np.array([900.0, 50, 40, 10]))
    assert 0.5 < share < 1 and (on_good >= 0.995).all() and (on_bad <= 0.35).all()


def test_filter_keeps_columns_and_takes_odd_tables(spark):
    docs = odd_documents(spark).selectExpr("*", "1 as n_words", "2 as kept")
    out = quality_rules.filter_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {r["text"] for r in out.collect()} <= set(ODD)
    assert quality_rules.filter_documents(empty_documents(spark)).count() == 0


def lines_corpus():
    texts = []
    for k in range(40):
        own = [prose(1000 + 10 * k + j, 15, 5000) for j in range(4)]
        if k < 30:
            own.insert(k % 4, f"Page {k} of 99 printed at {k}:00 by the press office")
        if k % 2:
            own.insert(k % 3, "All rights are reserved by us.")
        texts.append("\n".join(own))
    body = "\n".join(prose(j, 20, 5000) for j in range(5))
    return texts + [edited(body, 7, 0)] * 25 + ["\n".join(edited(x, k, 1) if k == j else x for j, x in enumerate(body.split("\n"))) for k in range(5)]


def test_recurring_templates_go_and_copied_texts_stay(spark):
    texts = lines_corpus()
    rows = {r["doc_id"]: r for r in line_templates.drop_lines(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = [x for x in text.split("\n") if not x.startswith(("Page ", "All rights"))]
        assert rows[i]["text"] == "\n".join(want)
        assert rows[i]["n_dropped"] == len(text.split("\n")) - len(want) and rows[i]["n_lines"] == len(text.split("\n"))


def test_fields_in_the_middle_become_wildcards(spark):
    rng = ["north", "south", "east", "west", "up", "down"]
    texts = [prose(k, 12, 5000) + f"\nread more about the {rng[k % 6]} side of the story here today\n" + prose(900 + k, 14, 5000) for k in range(30)]
    found = line_templates.recurring_lines(documents(spark, texts)).collect()
    assert len(found) == 6 and len({r["template"] for r in found}) == 1 and found[0]["n_docs"] == 30


def test_boilerplate_goes_between_blank_lines_in_footers_and_beside_copies(spark):
    foot = ["Follow our newsroom on every channel", "Copyright 2024 by the valley press", "Terms of use and privacy notice"]
    texts = ["\n\n".join([prose(1000 + k, 40, 5000), "Share this story with your friends", prose(2000 + k, 40, 5000)]) for k in range(15)]
    texts += ["\n".join([prose(3000 + k, 60, 5000), *foot]) for k in range(15)]
    beside = "Written for the evening paper of the town"
    texts += [prose(4000 + k, 40, 5000) + "\n" + beside for k in range(12)]
    texts += ["\n".join([beside, prose(5000, 40, 5000), prose(5001, 40, 5000)])] * 100
    gone = {"Share this story with your friends", beside, *foot}
    rows = {r["doc_id"]: r for r in line_templates.drop_lines(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["text"] == "\n".join(x for x in text.split("\n") if x not in gone)


def test_families_of_near_copies_keep_their_lines(spark):
    body = [prose(j, 20, 5000) for j in range(10)]
    texts = ["\n\n".join(f"new{named(k)} {x}" if j == k % 10 else x for j, x in enumerate(body)) for k in range(60)]
    rows = line_templates.drop_lines(documents(spark, texts)).collect()
    assert all(r["n_dropped"] == 0 for r in rows)


def test_lines_of_odd_and_empty_tables(spark):
    docs = odd_documents(spark).selectExpr("*", "'x' as n_dropped", "'y' as leaf", "'z' as masked")
    rows = line_templates.drop_lines(docs).collect()
    assert len(rows) == 3 * len(ODD) and all(r["n_dropped"] == 0 for r in rows)
    assert sorted(map(str, (r["text"] for r in rows))) == sorted(map(str, ODD * 3))
    assert line_templates.drop_lines(empty_documents(spark)).count() == 0
