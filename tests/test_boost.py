"""Boosting in partial histograms against a plain loop over rows in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractlens.operators import boost, learn

NAMES = ("s2red_mean", "s2red_std", "wc_built")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=(n, 3))
    y = np.clip(np.round(2 + x[:, 0] + (x[:, 1] > 0) + rng.normal(0, 0.3, n)), 0, 4).astype(int)
    x[rng.random((n, 3)) < 0.2] = np.nan
    # missing itself tells something
    x[y == 4, 2] = np.nan
    city = np.array(["a", "b", "c", "d"])[rng.integers(0, 4, n)]
    return x, y, city


def table(spark, rows):
    x, y, city = rows
    made = [
        (f"t{i}", str(city[i]), int(y[i]), *[None if np.isnan(v) and i % 2 else float(v) for v in x[i]]) for i in range(len(y))
    ]
    return spark.createDataFrame(made, "cvegeo string, city string, ordinal int, s2red_mean double, s2red_std double, wc_built double").repartition(5)


def plain_fit(bins, y, outputs, rounds, depth, rate, min_rows, ridge):
    """The same trees, node by node."""
    share = np.maximum(np.bincount(y, minlength=5) / len(y), 1e-9)
    base = np.array([share @ np.arange(5)]) if outputs == 1 else np.log(share)
    margins = np.tile(base, (len(y), 1))
    trees = []
    for _ in range(rounds):
        if outputs == 1:
            g, h = margins - y[:, None], np.ones_like(margins)
        else:
            e = np.exp(margins - margins.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(5)), p * (1 - p)

        def grow(own, k, level):
            best = None
            if level < depth:
                for f in range(bins.shape[1]):
                    for cut in sorted(set(bins[own, f])):
                        for gap_left in (True, False):
                            b = bins[own, f]
                            if (b == 0).any():
                                left = np.where(b == 0, gap_left, b <= cut)
                            else:
                                left = b <= cut
                                if gap_left != (left.sum() >= (~left).sum()):
                                    continue
                            lo, hi = own[left], own[~left]
                            if min(len(lo), len(hi)) < min_rows:
                                continue
                            term = lambda r: g[r, k].sum() ** 2 / (h[r, k].sum() + ridge)
                            gain = term(lo) + term(hi) - term(own)
                            rank = (round(gain, 9), -f, -int(cut), gap_left)
                            if gain > 1e-9 and (best is None or rank > best[0]):
                                best = rank, f, cut, gap_left, lo, hi
            if best is None:
                value = 0.0 if level == 0 else -rate * g[own, k].sum() / (h[own, k].sum() + ridge)
                return value
            _, f, cut, gap_left, lo, hi = best
            return f, cut, gap_left, grow(lo, k, level + 1), grow(hi, k, level + 1)

        made = [grow(np.arange(len(y)), k, 0) for k in range(outputs)]
        trees.append(made)
        for k in range(outputs):
            margins[:, k] += [walk(made[k], b) for b in bins]
    return base, trees


def walk(tree, b):
    while isinstance(tree, tuple):
        f, cut, gap_left, low, high = tree
        tree = low if (gap_left if b[f] == 0 else b[f] <= cut) else high
    return tree


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_equals_a_plain_loop(spark, rows, kind, monkeypatch):
    monkeypatch.setattr(boost, "KEPT_ROUNDS", 2)
    x, y, city = rows
    t = table(spark, rows)
    edges = boost.bin_edges(t, NAMES, 16)
    cuts = [np.array(edges[f]) for f in sorted(NAMES)]
    order = [NAMES.index(f) for f in sorted(NAMES)]
    bins = boost._binned(x[:, order], cuts)
    tasks = [boost.Task("all", kind, NAMES, frozenset("abc")), boost.Task("one", kind, NAMES[:1], frozenset("bcd"))]
    got = boost.fit(t, "city", "ordinal", tasks, edges, rounds=5, depth=3, min_rows=9)
    for task, ensemble in zip(tasks, got):
        own = np.isin(city, list(task.train))
        used = [i for i, f in enumerate(sorted(NAMES)) if f in task.features]
        base, trees = plain_fit(bins[own][:, used], y[own], len(ensemble.base), 5, 3, boost.RATE, 9, 1.0)
        want = base + np.array([[sum(walk(r[k], b) for r in trees) for k in range(len(base))] for b in bins[:, used]])
        seen = ensemble.base + ensemble.margins(bins)
        assert np.allclose(seen, want, atol=1e-7)
    placed = boost.predict(t, "city", got, [frozenset("d"), frozenset("a")], edges).toPandas()
    assert (placed.groupby("task").city.unique().map(list).tolist()) == [["d"], ["a"]]
    assert set(placed.prediction) <= set(range(5))


def test_missing_goes_to_the_side_that_explains_it(spark):
    rows = [("a", 4, None)] * 40 + [("a", 0, float(i)) for i in range(60)] + [("b", 0, 1.0), ("b", 4, None), ("b", 4, float("nan"))]
    t = spark.createDataFrame(rows, "city string, ordinal int, v double")
    edges = boost.bin_edges(t, ["v"])
    model = boost.fit(t, "city", "ordinal", [boost.Task("x", "regressor", ("v",), frozenset("a"))], edges, rounds=30, min_rows=5)
    got = boost.predict(t, "city", model, [frozenset("b")], edges).select("ordinal", "prediction").collect()
    assert all(r.ordinal == r.prediction for r in got) and len(got) == 3


def test_grid_of_sets_models_and_cities(spark, rows):
    detail = learn.leave_one_city_out(table(spark, rows), ["intensity", "all"], rounds=4, min_rows=5).cache()
    got = detail.toPandas()
    assert len(got) == 2 * 2 * 4 + 2 * 4
    assert (got.n_train + got.n_test == 400).all()
    assert set(got[got.feature_set == "none"].model) == {"majority", "random"}
    summary = learn.fold_summary(detail).toPandas()
    assert summary.kappa.is_monotonic_decreasing and summary.iloc[0].kappa > 0.3
    assert summary[summary.model == "majority"].kappa.iloc[0] == pytest.approx(0, abs=1e-9)
    with pytest.raises(KeyError):
        learn.leave_one_city_out(table(spark, rows), ["heights"])


def test_partition_has_points_inside_intervals(spark, rows):
    t = table(spark, rows)
    partition = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test"), ("d", "test")], "city string, split string")
    got = learn.evaluate_partition(t, partition, "all", "classifier", rounds=4, resamples=60, min_rows=5).toPandas().set_index("metric")
    assert {"kappa", "accuracy", "f1_macro", "mae_ordinal", "spearman", "auroc_ge_1", "auroc_is_0", "auroc_macro"} <= set(got.index)
    inner = got[got.ci_low.notna()]
    assert (inner.ci_low <= inner.value + 1e-9).all() and (inner.value <= inner.ci_high + 1e-9).all()
    assert got.n_train.iloc[0] + got.n_measured.iloc[0] == 400 and got.cities_measured.iloc[0] == 2
    measured = t.where(F.col("city").isin("c", "d")).count()
    assert got.n_measured.iloc[0] == measured
    with pytest.raises(ValueError, match="share no cities"):
        learn.evaluate_partition(t, partition.where("split = 'test'"), "all", "regressor", rounds=1)


def test_small_sets_are_counted_and_agree_with_rows(spark, rows, monkeypatch):
    t = table(spark, rows)
    edges = boost.bin_edges(t, NAMES, 4)
    tasks = [boost.Task("two", kind, NAMES[:2], frozenset("abc")) for kind in ("regressor", "classifier")]
    sizes, settled = [], boost.settled
    monkeypatch.setattr(boost, "settled", lambda df: sizes.append(settled(df)) or sizes[-1])
    options = dict(rounds=3, min_rows=9)
    once = boost.fit(t, "city", "ordinal", tasks, edges, **options)
    five = t.select("city", "ordinal", *NAMES, F.explode(F.sequence(F.lit(1), F.lit(5))))
    boost.fit(five, "city", "ordinal", tasks, edges, **options)
    monkeypatch.setattr(boost, "COUNTED_FEATURES", 0)
    plain = boost.fit(t, "city", "ordinal", tasks, edges, **options)
    counts = [df.count() for df in sizes]
    assert counts[0] == counts[1] < counts[2] == 400
    bins = np.array([(a, b) for a in range(6) for b in range(6)], np.uint8)
    for a, b in zip(once, plain):
        assert np.allclose(a.margins(bins), b.margins(bins))
