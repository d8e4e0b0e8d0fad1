"""Small tables for the text operators, and plain versions of what they compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def prose(seed: int, n: int, size: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(named(rng.randrange(size)) for _ in range(n))


def named(n: int) -> str:
    """A word of letters for a number."""
    out = "w"
    while n:
        n, digit = divmod(n, 20)
        out += "abcdefghijklmnopqrst"[digit]
    return out


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    out = text.split(" ")
    for _ in range(edits):
        out[rng.randrange(len(out))] = "x" + named(rng.randrange(10**9))
    return " ".join(out)


#: texts that operators must take: null, empty, blank, one word, very long words and texts, odd characters
ODD = [
    None, "", " \n\t ", "one", "a b", "é  b　c", "x" * 5000, prose(1, 30_000), "same same same same " * 40,
    "<|endoftext|> <s> ▁ end", "tab\tand\x0bmore\x0cblank\r\nlines  two   three", "Ünï 😀 日本語 👩‍👩‍👧 ́", "\x00nul",
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start: int = 0):
    rows = [(start + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_documents(spark):
    """The odd texts, each twice under its own id and once under a null id."""
    docs = documents(spark, ODD)
    return docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
