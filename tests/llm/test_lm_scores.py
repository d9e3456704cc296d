"""Whole-document scores word by word: network, counts and bucket shares put together in a plain loop."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cityflux.llm import lm


def test_scores_word_by_word(spark, monkeypatch):
    # Few words are tokens, fewer still travel with the tasks: buckets and the joined tail take the rest.
    monkeypatch.setattr(lm, "VOCABULARY", 12)
    monkeypatch.setattr(lm, "HEAD", 25)
    kept, given = [], lm._train
    monkeypatch.setattr(lm, "_train", lambda encoded, scorer, passes: (given(encoded, scorer, passes), kept.append(scorer)))
    rng = np.random.default_rng(8)
    words = [f"W{k}x" for k in range(60)]
    share = 1 / np.arange(1, 61)
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 30), p=share / share.sum())) for i in range(80)}
    texts |= {80: None, 81: "", 82: "neverseen w0x\tw0x\n" * 20}
    rows = lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()

    scorer, split = kept[0], {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, own in split.items() if not held[i] for w in own)
    ends = sum(not h for h in held.values())
    token = {w: int(t) for w, t in zip(scorer.words.to_pylist(), scorer.token) if t >= 0 and w != lm.END}
    bucket = {w: zlib.crc32(w[-2:].encode()) % lm.BUCKETS for own in split.values() for w in own}
    sums, many = Counter(), Counter()
    for w, c in counts.items():
        if w not in token:
            sums[bucket[w]] += c
            many[bucket[w]] += 1
    assert len(token) == 11 and len(counts) > 40 and rows and len(rows) == len(texts)
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    for r in rows:
        own = split[r["doc_id"]]
        want, h, last = 0.0, np.zeros((1, scorer.network.hidden), np.float32), np.array([scorer.network.end])
        for w in [*own, None]:
            h, *_ = scorer.network.step(h, last)
            last = np.array([scorer.network.end if w is None else token.get(w, scorer.bucket_token[bucket[w]])])
            want += float(scorer.network.log_probability(h, last)[0]) / np.log(10)
            if w is not None and w not in token:
                want += np.log10(counts[w] + 1) - np.log10(sums[bucket[w]] + many[bucket[w]] + 1)
        assert r["score"] == pytest.approx(want, abs=1e-4 * (len(own) + 1))
        base = sum(np.log10((counts[w] + 1) / (total * 1.0 + distinct + 1)) for w in own) + np.log10((ends + 1) / (total + distinct + 1))
        assert r["n_tokens"] == len(own) + 1 and r["train_tokens"] == total and r["held_out"] == held[r["doc_id"]]
        assert r["n_known"] == sum(w in counts for w in own) + (ends > 0)
        assert abs(r["base_score"] - base) < 1e-6 * (len(own) + 1)


def test_classes_of_tokens_are_sorted_by_two_bytes():
    """op4: classes are looked up and sorted as two-byte numbers; probabilities are those of the plain formula."""
    rng = np.random.default_rng(4)
    network = lm.Network.start(rng.integers(1, 90, 40).astype(float), np.array([0, 3, 4, 20, 40]))
    targets = rng.integers(0, 40, 300)
    owner = network._owner(targets)
    assert owner.dtype == np.uint16 and (owner == np.searchsorted(network.bounds, targets, side="right") - 1).all()
    states = rng.normal(size=(300, network.hidden)).astype(np.float32)
    logits = states @ network.w["classes"] + network.w["class_bias"]
    words = states @ network.w["words"].T + network.w["word_bias"]
    for i, (t, k) in enumerate(zip(targets, owner)):
        own = words[i, network.bounds[k] : network.bounds[k + 1]]
        want = logits[i, k] - np.log(np.exp(logits[i]).sum()) + own[t - network.bounds[k]] - np.log(np.exp(own).sum())
        assert abs(network.log_probability(states, targets)[i] - want) < 1e-4
