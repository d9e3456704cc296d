"""Trees grown on Spark: best splits by hand, trees inside trees, the plan for large nodes, boosting."""

import numpy as np
import pandas as pd
import pytest

from cityflux.operators import models, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"a": rng.integers(0, 12, n), "b": rng.normal(size=n), "c": rng.integers(0, 3, n)})
    pdf["y"] = 2.0 * pdf["a"] + np.where(pdf["b"] > 0.3, 9, 0) - pdf["c"] ** 2 + rng.normal(size=n)
    pdf["label"] = (pdf["y"] > pdf["y"].median()).astype(float) + (pdf["c"] == 2)
    pdf["fold"] = np.arange(n) % 3
    df = spark.createDataFrame(pdf).repartition(4)
    cuts = trees.find_cuts(df, NAMES)
    return pdf, cuts, trees.binned(df, NAMES, cuts, ["y", "label", "fold"])


def bins_of(rows):
    told = rows.toPandas()
    return np.stack([np.frombuffer(x, np.uint8) for x in told["_bins"]]), told


def same(a, b, places=9):
    assert a.node.tolist() == b.node.tolist() and a.feature.tolist() == b.feature.tolist()
    assert np.where(a.feature >= 0, a.cut, 0).tolist() == np.where(b.feature >= 0, b.cut, 0).tolist()
    assert a.rows.tolist() == b.rows.tolist() and np.allclose(a.value, b.value, atol=10.0**-places)


def test_cuts(table):
    pdf, cuts, _ = table
    assert cuts[0].tolist() == [k + 0.5 for k in range(11)] and cuts[2].tolist() == [0.5, 1.5]
    shares = [(pdf["b"] <= c).mean() for c in cuts[1]]
    assert len(shares) == trees.BINS - 1 and np.allclose(shares, np.arange(1, 32) / 32, atol=0.01)


def test_first_split_is_the_best(table):
    _, _, rows = table
    b, told = bins_of(rows)
    y = told["y"].to_numpy()
    forest = trees.fit_forest(rows, 3, trees.Growth(1), 1, "y", bootstrap=False)

    def loss(f, c):
        sides = [y[b[:, f] <= c], y[b[:, f] > c]]
        return sum(((s - s.mean()) ** 2).sum() for s in sides) if all(map(len, sides)) else np.inf

    want = min(((loss(f, c), f, c) for f in range(3) for c in range(31)))
    assert (forest.feature[0], forest.cut[0]) == want[1:]
    assert forest.value[1, 0] == pytest.approx(y[b[:, want[1]] <= want[2]].mean())
    assert forest.gain[0] == pytest.approx(((y - y.mean()) ** 2).sum() - want[0])


def test_smaller_forests_are_inside_a_larger_one(table):
    _, _, rows = table
    whole = trees.fit_forest(rows, 3, trees.Growth(9), 6, "y")
    for count, depth, split in ((6, 4, 2), (2, 9, 2), (4, 6, 30)):
        fitted = trees.fit_forest(rows, 3, trees.Growth(depth, split=split), count, "y")
        same(whole.cut_back(count, depth, split), fitted)


@pytest.mark.parametrize("classes", [0, 3])
def test_large_nodes_take_histogram_passes(table, classes):
    _, _, rows = table
    plan = trees.Growth(6, least=3, subset=2)
    label = "label" if classes else "y"
    one, many = (trees.fit_forest(rows, 3, plan, 3, label, classes=classes, local_rows=n) for n in (10_000, 60))
    same(one, many)
    assert one.rows.max() > 2 * 60


def test_errors_of_nested_forests(table):
    _, _, rows = table
    b, told = bins_of(rows)
    whole = trees.fit_forest(rows, 3, trees.Growth(8), 5, "y", without=1)
    points = [(n, d, s) for n in (2, 5) for d in (3, 8) for s in (2, 20)]
    found = trees.forest_errors(rows, 3, whole, "y", points, fold=1)
    own = told["fold"] == 1
    for n, d, s in points:
        small = whole.cut_back(n, d, s)
        guess = small.totals(b[own], d)[:, 0] / n
        assert found[n, d, s] == pytest.approx(((guess - told["y"][own]) ** 2).mean())
    assert found[5, 8, 2] < found[5, 3, 2]


def test_boosting_follows_residuals(table):
    _, _, rows = table
    b, told = bins_of(rows)
    forest, base = trees.boost(rows, 3, trees.Growth(3), 25, 0.3, "y")
    errors = trees.boosted_errors(rows, 3, forest, base, 0.3, "y", 3, [1, 5, 25])
    assert errors[25] < errors[5] < errors[1] < told["y"].var()
    # The third tree by hand: on the residuals of the first two.
    now = np.full(len(b), told["y"].mean())
    for t in (0, 1):
        now += 0.3 * forest.value[forest.reach(t, b, 3), 0]
    at = forest.reach(2, b, 3)
    for k in set(at.tolist()):
        assert forest.value[k, 0] == pytest.approx((told["y"] - now)[at == k].mean())


def test_boosted_classes_make_newton_steps(table):
    _, _, rows = table
    b, told = bins_of(rows)
    y = told["label"].to_numpy(int)
    forest, base = trees.boost(rows, 3, trees.Growth(2), 12, 0.1, "label", classes=3)
    assert np.allclose(base, np.log(np.bincount(y) / len(y)))
    now = np.tile(base, (len(b), 1))
    for t in range(3):
        r = (y == t) - trees.softmax(now)[:, t]
        at = forest.reach(t, b, 2)
        for k in set(at.tolist()):
            own = r[at == k]
            assert forest.value[k, 0] == pytest.approx(2 / 3 * own.sum() / (np.abs(own) * (1 - np.abs(own))).sum())
    loss = []
    for turn in range(12):
        for k in range(3):
            now[:, k] += 0.1 * forest.value[forest.reach(3 * turn + k, b, 2), 0]
        loss.append(-np.log(trees.softmax(now)[np.arange(len(y)), y]).mean())
    assert loss == sorted(loss, reverse=True)


def test_model_predicts_and_reloads(spark, table, tmp_path):
    pdf, cuts, rows = table
    df = spark.createDataFrame(pdf)
    b, told = bins_of(rows)
    forest, base = trees.boost(rows, 3, trees.Growth(2), 4, 0.1, "label", classes=3)
    model = trees.TreeModel(NAMES, cuts, forest, "softmax", base, {"stepSize": 0.1})
    model.save(spark, f"{tmp_path}/m")
    again = trees.TreeModel.load(spark, f"{tmp_path}/m")
    want = {round(y, 9): p for y, p in zip(told["y"], model.outputs(b).tolist())}
    for m in (model, again):
        for r in m.transform(df).collect():
            assert r["probability"] == pytest.approx(want[round(r["y"], 9)]) and sum(r["probability"]) == pytest.approx(1)
            assert r["prediction"] == int(np.argmax(r["probability"]))
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_bootstrap_draws():
    rows = np.arange(200_000)
    w = trees.draws(rows, 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w, trees.draws(rows, 4, 42))[0, 1]) < 0.01


def test_boosted_grid(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(300), "hour": rng.integers(0, 24, 300), "traffic_level": rng.integers(1, 6, 300)})
    pdf["aqi_value"] = (pdf["hour"] - 12.0) ** 2 + pdf["traffic_level"]
    pdf["timestamp"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["id"], unit="h")
    df = spark.createDataFrame(pdf)
    model, scores = models.grid_search(df, "aqi_value", "gradient_boosting", {"maxIter": [2, 12], "maxDepth": [3], "stepSize": [0.1, 0.3]}, folds=2)
    mse = {(r["settings"]["maxIter"], r["settings"]["stepSize"]): r["mse"] for r in scores.collect()}
    assert len(mse) == 4 and min(mse, key=mse.get) == ("12", "0.3") and model.settings == {"maxIter": 12, "maxDepth": 3, "stepSize": 0.3}


def test_no_rows(spark, table):
    _, _, rows = table
    none = trees.materialize(rows.limit(0), "none")
    forest = trees.fit_forest(none, 3, trees.Growth(3), 2, "y")
    assert len(forest.node) == 0


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_as_a_table_gives_what_it_gives_in_one_place(spark, table, tmp_path, classes):
    """Parts of the forest meet chunks of rows, below large nodes too; nested sizes, depths and least rows are all met."""
    pdf, cuts, rows = table
    b, told = bins_of(rows)
    label = "label" if classes else "y"
    own = told["fold"] == 1
    points = [(n, d, s) for n in (2, 5) for d in (1, 4, 9) for s in (2, 40, 300)]
    for local in (10_000, 60):
        grove = trees.plant(rows, 3, trees.Growth(9, subset=2), 5, label, without=1, classes=classes, local_rows=local)
        assert (local == 60) == (len(grove.top) > 0)
        whole = grove.collect()
        found = trees.forest_errors(rows, 3, grove, label, points, 1, classes)
        for n, d, s in points:
            total = whole.cut_back(n, d, s).totals(b[own], d)
            guess = total.argmax(1) if classes else total[:, 0] / n
            assert found[n, d, s] == pytest.approx(((guess - told[label][own]) ** 2).mean())
        model = trees.TreeModel(NAMES, cuts, grove, "shares" if classes else "mean", [0.0] * classes, {"numTrees": 5})
        model.save(spark, f"{tmp_path}/{classes}-{local}")
        out = trees.TreeModel(NAMES, cuts, whole, model.kind, [], model.settings).outputs(b)
        want = {round(y, 9): p for y, p in zip(told["y"], out)}
        for m in (model, trees.TreeModel.load(spark, f"{tmp_path}/{classes}-{local}")):
            got = m.transform(spark.createDataFrame(pdf)).collect()
            assert len(got) == len(pdf)
            for r in got:
                p = want[round(r["y"], 9)]
                assert r["prediction"] == (np.argmax(p) if classes else pytest.approx(p[0]))
                assert not classes or r["probability"] == pytest.approx(p.tolist())
        gain = [np.bincount(f.feature[f.feature >= 0], f.gain[f.feature >= 0], 3) for f in (whole.cut_back(5, 9, 2),)]
        assert model.featureImportances.toArray() == pytest.approx(gain[0] / gain[0].sum(), abs=0.1)


@pytest.mark.parametrize("classes", [0, 3])
def test_sorted_and_counted_splits_agree(classes):
    rng = np.random.default_rng(8)
    m, n, width, bins = 40, 900, 5, 16
    place = np.sort(rng.integers(0, m, n))
    b = rng.integers(0, bins, (width, n)).astype(np.uint8)
    w = rng.integers(1, 4, n).astype(float)
    g = rng.integers(0, classes, n) if classes else (rng.integers(0, 50, n) * w)[:, None]
    plan = trees.Growth(5, least=2, subset=3)
    ids = np.arange(m) + 64
    tried = trees._tried(ids, 0, width, plan)
    hist = trees._histogram(place, m, b, bins, w, g, classes)
    whole = hist[:, 0].sum(1)
    one = trees.best_splits(hist, plan, tried, whole)
    two = trees.sorted_splits(place, m, b, bins, w, g, classes, plan, tried, whole)
    assert np.allclose(one[2], two[2])
    split = one[2] > 0
    assert split.any() and (one[0][split] == two[0][split]).all() and (one[1][split] == two[1][split]).all()


@pytest.mark.parametrize("classes, subset", [(0, None), (0, 3), (3, None), (3, 3)])
def test_rows_counted_by_groups_of_features(monkeypatch, classes, subset):
    """levels counted by groups of features, the smaller child only, give the tree that counts of single features give."""
    rng = np.random.default_rng(3)
    n, width, bins = 6_000, 7, 16
    b = (rng.integers(0, bins, (n, width)) % np.array([16, 1, 2, 16, 5, 16, 9])).astype(np.uint8)
    w = rng.integers(1, 4, n).astype(float)
    y = rng.integers(0, classes, n) if classes else (b[:, 0] * 2.0 + (b[:, 3] > 7) * b[:, 5] + rng.normal(size=n))
    g = y if classes else (y * w)[:, None]
    place = rng.integers(0, 3, n)
    alone = trees._histogram(place, 3, np.ascontiguousarray(b.T), bins, w, g, classes)
    packs = trees._packed(b)
    assert len(packs) < 6 and np.allclose(np.delete(alone, 1, 1), np.delete(trees._packed_histogram(place, 3, packs, width, bins, w, g, classes), 1, 1))
    plan = trees.Growth(9, least=2, subset=subset)
    one = trees.subtree(b, w, g, w, bins, plan, 4, 1, classes)
    monkeypatch.setattr(trees, "PACK", 10**9)
    two = trees.subtree(b, w, g, w, bins, plan, 4, 1, classes)
    assert one[2] > 100 and one[:6] == two[:6] and np.allclose(np.frombuffer(one[7]), np.frombuffer(two[7]))


def test_boosted_rounds_send_outputs_and_bins_once(spark, table):
    """F8: rounds read blocks of rows, and each tree of a round has a task of its own behind one shuffle."""
    _, _, rows = table
    blocks = trees.blocked(rows, 3, ["label"])
    assert blocks.columns == ["_block", "_bins"] and 0 < blocks.count() < 50

    def targets(batch, b, tree):
        r = trees._column(batch, "label") - tree
        return np.ones(len(r)), r[:, None], np.ones(len(r))

    top, pieces = trees.grow(blocks, 3, 32, targets, trees.Growth(4), [6, 7, 8], 900, divisors=np.ones_like)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert not len(top) and plan.count("Exchange") == 1 and pieces.rdd.getNumPartitions() == 3
    want = trees.grow(rows, 3, 32, targets, trees.Growth(4), [6, 7, 8], 900, local_rows=100)
    same(trees.Grove(pieces, top, 3).collect(), trees.Grove(want[1], want[0], 3).collect())


@pytest.mark.parametrize("classes, subset", [(0, None), (0, 2), (3, None), (3, 2)])
@pytest.mark.parametrize("bootstrap", [True, False])
def test_trees_grown_on_the_jvm_are_those_of_numpy(table, classes, subset, bootstrap):
    """Forests grow in compiled loops, a task each for a few trees, and are the same forests."""
    _, _, rows = table
    plan, label = trees.Growth(9, least=2, split=5, subset=subset), "label" if classes else "y"
    fits = [trees.plant(rows, 3, plan, 40, label, without=2, bootstrap=bootstrap, classes=classes, local_rows=n) for n in (None, 10_000)]
    one, two = (f.collect() for f in fits)
    same(one, two)
    assert np.allclose(one.gain, two.gain, rtol=1e-5) and len(one.start) == 40
    assert np.allclose(fits[0].importances(3), fits[1].importances(3), rtol=1e-5)


def test_trees_of_the_jvm_have_tasks_of_their_own(table):
    _, _, rows = table
    grown = trees._in_loops(rows, 3, trees.Growth(3), 70, "y", 900, True, 0)
    assert grown.rdd.getNumPartitions() == 24 and sorted(r["tree"] for r in grown.collect()) == list(range(70))


def test_rows_that_the_heap_does_not_hold_stay_with_numpy(table, monkeypatch):
    _, _, rows = table
    plan = trees.Growth(4, subset=2)
    want = trees.fit_forest(rows, 3, plan, 3, "label", classes=3)
    monkeypatch.setattr(trees.loops, "heap", lambda spark: 1_000)
    assert trees._in_loops(rows, 3, plan, 3, "label", 900, True, 3) is None
    same(trees.fit_forest(rows, 3, plan, 3, "label", classes=3), want)


@pytest.mark.parametrize("classes", [0, 3])
def test_boosted_rounds_on_the_jvm_are_those_of_numpy(spark, table, classes):
    """rounds run over rows that tasks keep, by sums of histograms per level, and give the same trees."""
    _, _, rows = table
    plan, label = trees.Growth(4, least=2, split=5), "label" if classes else "y"
    one, base = trees.boost(rows, 3, plan, 6, 0.3, label, classes, without=1)
    two, same_base = trees.boost(rows, 3, plan, 6, 0.3, label, classes, without=1, local_rows=10_000)
    same(one, two)
    assert base == same_base and np.allclose(one.gain, two.gain, rtol=1e-5) and not spark.sparkContext._jsc.getPersistentRDDs()
