"""Learning of the network: every token of the training texts is a target once a round."""

from collections import Counter

import numpy as np
import pytest

from cityflux.llm import lm


def test_fit_learns_from_every_token(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 6, n), 0) for n in (3, 900, 0, 40, 7, 2_000, 1, 60, 5)]
    seen, given = Counter(), lm.Network.gradients

    def watched(self, h, tokens, targets, fresh, real=None):
        seen.update(targets[np.ones(targets.shape, bool) if real is None else real].tolist())
        return given(self, h, tokens, targets, fresh, *([] if real is None else [real]))

    monkeypatch.setattr(lm.Network, "gradients", watched)
    net = lm.Network.start(np.array([5, 9, 3, 2, 1, 1]), np.array([0, 1, 3, 6]), hidden=4)
    net.fit(texts, streams=4, window=24)
    assert seen == Counter(np.concatenate(texts).tolist())


def test_targets_after_the_end_count_for_nothing():
    rng = np.random.default_rng(3)
    net = lm.Network.start(np.array([5, 9, 3, 2, 1, 1]), np.array([0, 1, 3, 6]), hidden=4)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    tokens, targets, fresh = rng.integers(0, 6, (7, 3)), rng.integers(0, 6, (7, 3)), np.zeros((7, 3), bool)
    real = np.arange(7)[:, None] < np.array([7, 4, 2])
    h = rng.normal(size=(3, 4))
    whole, _, mean = net.gradients(h, tokens, targets, fresh, real)
    parts = [net.gradients(h[[k]], tokens[:n, [k]], targets[:n, [k]], fresh[:n, [k]]) for k, n in enumerate((7, 4, 2))]
    assert mean * 13 == pytest.approx(sum(n * p[2] for n, p in zip((7, 4, 2), parts)))
    for name, v in whole.items():
        assert np.allclose(v * 13, sum(n * p[0][name] for n, p in zip((7, 4, 2), parts)))
