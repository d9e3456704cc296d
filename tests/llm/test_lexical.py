"""Lexical search against scores by hand: many blocks, ties, copies, nulls, clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cityflux.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, row string, at int, tf int, n int"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def by_hand(docs, items, top=10):
    held = [(i, c, sum(c.values())) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n, total = len(held), sum(k for *_, k in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, size in held:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if nameless else d, -s) for r, (s, nameless, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **settings):
    given = spark.createDataFrame([(i, t, 1, "r", 1, 2, 3) for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(given, asked, **settings).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)] + ["Éclair", "naïve", "日本", "A1"]
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]
    docs += [(2000, None), (2001, ""), (2002, " .,;\t\x00"), (None, docs[9][1]), (5, docs[7][1]), (2003, "W1-w2_W3\x7fw4 " * 3000)]
    items = [(k, " ".join(rng.choice(words, rng.integers(1, 25)))) for k in range(30)]
    return docs, items + [(30, None), (31, "zzz"), (3, "w1 W1, éclair! Éclair"), (33, docs[7][1])]


def test_small_blocks(spark, corpus):
    assert run(spark, *corpus, block_docs=50) == by_hand(*corpus)


def test_items_in_parts(spark, corpus):
    assert run(spark, *corpus, items_at_once=7) == by_hand(*corpus)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_terms_of_bytes():
    import pyarrow as pa

    texts = ["Ab-c_D1 É\x00x", None, "", "日本語テ A", "..", "z" * 70_000]
    array = pa.array(["skipped", *texts]).slice(1)
    flat, first = lexical.terms(array)
    assert [flat.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:])] == [terms(t) for t in texts]


def test_pair_bounds_skip_lists():
    """A list that bounds rule out is looked up for the documents met so far only; independent maxima would read it."""


    n = 1000
    rare, common = np.array([3, 5], np.int32), np.arange(n, dtype=np.int32)
    held = {0: (rare, np.array([900, 880])), 1: (rare, np.array([800, 790])), 2: (common[::2], np.full(500, 90)), 3: (common[1::2], np.full(500, 90))}
    most = {(0, None): 900, (1, None): 800, (2, None): 90, (3, None): 90, (0, 1): 1700}
    docs, scores = lexical.answer([(0, 1), (2, 3)], held, most, 100, n, 10)
    # Together at most 90, as no document has both: below 100, so documents of the pair alone are never met.
    assert docs.tolist() == [3, 5] and scores.tolist() == [1790, 1760]
    docs, _ = lexical.answer([(0, 1), (2, 3)], held, {**most, (2, 3): 180}, 100, n, 10)
    assert docs.tolist() == [3, 5]
    docs, _ = lexical.answer([(0, 1), (2, 3)], held, most, 90, n, 10)
    assert len(docs) == n
