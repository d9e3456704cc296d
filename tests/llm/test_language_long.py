"""Rejection by the language stage of documents much longer than those it is calibrated on."""

import numpy as np
from test_edges_llm import frame

from cityflux.llm import language


def test_language_keeps_long_clean_documents(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("etaoinshrdlucmfwyp"))
    vocabulary = np.array(["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(3_000)])
    weight = 1 / np.arange(1, 3_001)

    def prose(words, topic):
        rare = rng.choice(vocabulary[500:], 40)
        common = rng.choice(vocabulary, words, p=weight / weight.sum())
        return " ".join(np.where(rng.random(words) < topic, rng.choice(rare, words), common))

    rows = [(i, prose(60, rng.uniform(0.1, 0.4)), "en", "a") for i in range(300)]
    clean = [(1_000 + i, prose(60_000, 0.4), "en", "a") for i in range(5)]
    noise = [(2_000, "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 60_000)), None, "a"), (2_001, "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 200)), None, "a")]
    docs = frame(spark, rows + clean + noise)
    kept = {r["doc_id"] for r in language.keep_identified(docs).collect()}
    assert {r[0] for r in clean} <= kept and not {2_000, 2_001} & kept
