"""Vector codes: trees against all pairs, edge cases, other lengths."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cityflux.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v int, code string"


def nearest(points, entries):
    apart = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    return apart.argmin(1), apart.min(1)


def by_hand(rows, entries=256, rounds=4):
    """{vec_id: (code, error)} and the digest, comparing every part with every entry; rows are (vec_id, vector) in order."""
    v = np.array([np.floor(1024 * np.array(x, np.float32).astype(float)) for _, x in rows]).astype(np.int64)
    code, error, books = [""] * len(rows), np.zeros(len(rows), np.int64), []
    for part in np.split(v, 4, axis=1):
        book = part[:entries].copy()
        for _ in range(rounds):
            at, _ = nearest(part, book)
            for k in set(at.tolist()):
                book[k] = part[at == k].sum(0) // (at == k).sum()
        at, off = nearest(part, book)
        code, error = [c + f"{k:02x}" for c, k in zip(code, at)], error + off
        books.append(book)
    text = ",".join(str(x) for b in books for x in b.ravel().tolist())
    return sorted((r[0], c, int(e)) for r, c, e in zip(rows, code, error)), hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 40), st.integers(1, 5), st.integers(1, 60), st.integers(0, 2**31))
def test_trees_find_the_nearest(n, k, d, spread, seed):
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (k, d))
    points[n // 2 :] = points[0]
    at, sums, counts = codes.assign(points, entries)
    want, _ = nearest(points, entries)
    assert (at == want).all() and (counts == np.bincount(want, minlength=k)).all()
    own = np.zeros_like(entries)
    np.add.at(own, want, points)
    assert (sums == own).all()


def test_whole_nodes_are_assigned_by_their_sums():
    # Two far groups of points: no leaf is left uncertain, so a leaf size of the whole block makes no difference.
    points = np.concatenate((np.zeros((500, 3)), np.full((500, 3), 10_000))).astype(np.int64) + np.arange(1000)[:, None] % 7
    at, sums, counts = codes.assign(points, np.array([[9_000] * 3, [5] * 3]))
    assert (at == np.repeat([1, 0], 500)).all() and counts.tolist() == [500, 500] and (sums[1] == points[:500].sum(0)).all()


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    many = [(i, rng.normal(0, 0.2, 8).round(3).tolist()) for i in range(300)]
    many += [(i, many[0][1]) for i in range(300, 450)]
    bad = [(900, None), (901, [1.0] * 7 + [None]), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] * 8), (904, []), (905, [1.0] * 6)]
    rows = [(i, x, None if i % 3 else i % 2, 5, "x") for i, x in many + bad]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want, digest = by_hand(many)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label, error = {i: None if i % 3 else i % 2 for i, _ in many}, {i: e for i, _, e in want}
    for r in got:
        assert r["label_error"] == sum(e for i, e in error.items() if label[i] == label[r["vec_id"]])


def test_other_lengths_have_codebooks_of_their_own(spark):
    short, long = [(i, [i / 7] * 4) for i in range(9)], [(i, [i / 5, -i / 3] * 4) for i in range(20, 31)]
    got = codes.compress(spark.createDataFrame([(i, x, 0, 0, "") for i, x in short + long], SCHEMA)).collect()
    for rows in (short, long):
        want, digest = by_hand(rows)
        own = [r for r in got if r["codebooks_sha256"] == digest]
        assert sorted((r["vec_id"], r["code"], r["error"]) for r in own) == want


def test_repeated_and_missing_ids(spark):
    rows = [(1, [0.5] * 4), (1, [0.25] * 4), (1, [0.25] * 4), (None, [9.0] * 4)]
    got = codes.compress(spark.createDataFrame([(i, x, None, 0, "") for i, x in rows], SCHEMA), most_entries=2).collect()
    want, digest = by_hand([(1, [0.25] * 4), (1, [0.25] * 4), (1, [0.5] * 4), (2, [9.0] * 4)], entries=2)
    assert sorted((r["vec_id"] or 2, r["code"], r["error"]) for r in got) == want and got[0]["codebooks_sha256"] == digest


def test_empty_and_too_large(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ArithmeticError):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 0, 0, "")], SCHEMA))
