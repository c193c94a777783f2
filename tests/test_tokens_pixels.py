import numpy as np
import pytest
from pyspark.sql import functions as F

from tractlens.operators import composite as K
from tractlens.operators import texture as X
from tractlens.operators import tokens as T


def lattice(spark, cells):
    return spark.createDataFrame([("b", 16 * r, 16 * c) for r, c in cells], "bag string, y0 long, x0 long")


def test_neighbours_skip_gaps_and_self(spark):
    t = lattice(spark, [(0, 0), (0, 1), (1, 1), (5, 5)])
    pairs = {(r.src_y // 16, r.src_x // 16, r.dst_y // 16, r.dst_x // 16) for r in T.neighbour_pairs(t, ["bag"]).collect()}
    assert len(pairs) == 6 and not any(p[:2] == (5, 5) for p in pairs)


def test_isolated_token_is_its_own_context(spark):
    t = lattice(spark, [(0, 0), (0, 1), (5, 5)]).withColumn("vec", F.array(F.col("x0").cast("double")))
    got = {r.x0: r.context[0] for r in T.neighbour_mean(t, ["bag"]).collect()}
    assert got == {0: 16.0, 16: 0.0, 80: 80.0}


def test_flush_window_lands_on_the_token_lattice(spark):
    boxes = spark.createDataFrame([("k", 250, 240)], "box string, h long, w long")
    ys = {r.y0 for r in T.window_lattice(boxes, 224, 224, flush=True).collect()}
    assert ys == {0, 16}
    with pytest.raises(ValueError):
        T.window_lattice(boxes, 224, 100)


def test_central_rule_keeps_the_last_of_equals(spark):
    t = spark.createDataFrame(
        [("k", 0, 0, 0, 0, 16, 16, [1.0]), ("k", 1, 3, 1, 1, 16, 16, [2.0])],
        "box string, win long, j long, trow long, tcol long, y0 long, x0 long, vec array<double>",
    )
    assert T.reduce_overlaps(t, 2).first().vec == [2.0]
    assert T.reduce_overlaps(t, 2, "hann").first().vec[0] == pytest.approx(1.5)


def test_orbit_is_chosen_by_coverage_not_by_count(spark):
    grids = spark.createDataFrame([(0, 2, 2)], "box long, h long, w long")
    scenes = spark.createDataFrame(
        [(0, i, "asc", 1) for i in range(4)] + [(0, 9, "desc", 2)], "box long, scene_id long, orbit_state string, orbit long"
    )
    seen = [(0, i, "vv", 0, 0, 1.0) for i in range(4)] + [(0, 9, "vv", r, c, 1.0) for r in (0, 1) for c in (0, 1)]
    pixels = spark.createDataFrame(seen, "box long, scene_id long, band string, r long, c long, value double")
    best = K.best_orbit(K.orbit_coverage(scenes, pixels, grids)).first()
    assert best.orbit_state == "desc" and best.coverage == 1.0


def test_a_scene_enters_with_both_polarisations_or_not_at_all(spark):
    grids = spark.createDataFrame([(0, 1, 1)], "box long, h long, w long")
    scenes = spark.createDataFrame(
        [(0, 1, "asc", 1), (0, 2, "asc", 1)], "box long, scene_id long, orbit_state string, orbit long"
    )
    pixels = spark.createDataFrame(
        [(0, 1, "vv", 0, 0, 1.0), (0, 1, "vh", 0, 0, 2.0), (0, 2, "vv", 0, 0, 9.0)],
        "box long, scene_id long, band string, r long, c long, value double",
    )
    got = {r.band: r.value for r in K.radar_composite(scenes, pixels, grids).collect()}
    assert got == {"vv": 1.0, "vh": 2.0}


def test_strict_guard_stops_the_job(spark):
    checks = spark.createDataFrame([("k", "depth", False)], "box string, check string, passed boolean")
    with pytest.raises(Exception, match="depth"):
        K.enforce(checks).collect()


def test_ragged_edge_keeps_native_values(spark):
    px = spark.createDataFrame([("k", "a", r, c, float(3 * r + c)) for r in range(3) for c in range(3)], "box string, band string, r long, c long, value double")
    grids = spark.createDataFrame([("k", 3, 3)], "box string, h long, w long")
    got = {(r.r, r.c): r.value for r in K.block_degrade(px, grids).collect()}
    assert got[(0, 0)] == got[(1, 1)] == 2.0 and got[(2, 2)] == 8.0


def patch(spark, array):
    rows = [("p", int(r), int(c), int(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, "poly string, r long, c long, level int")


def brute(array, d):
    k = round(d / 2**0.5)
    out = []
    for dr, dc in ((0, d), (k, k), (d, 0), (k, -k)):
        m = np.zeros((9, 9))
        for r in range(array.shape[0]):
            for c in range(array.shape[1]):
                rr, cc = r + dr, c + dc
                if 0 <= rr < array.shape[0] and 0 <= cc < array.shape[1] and array[r, c] and array[rr, cc]:
                    m[array[r, c], array[rr, cc]] += 1
        m = m + m.T
        p = m / m.sum() if m.sum() else m
        i, j = np.indices(m.shape)
        mu = (p * i).sum()
        var = (p * (i - mu) ** 2).sum()
        out.append(
            {
                "contrast": (p * (i - j) ** 2).sum(),
                "energy": np.sqrt((p**2).sum()),
                "homogeneity": (p / (1 + (i - j) ** 2)).sum(),
                "correlation": (p * (i - mu) * (j - mu)).sum() / var if var > 1e-12 else 1.0,
                "entropy": -(p[p > 0] * np.log2(p[p > 0])).sum(),
            }
        )
    means = {key: np.mean([o[key] for o in out]) for key in out[0]}
    means["anisotropy"] = np.std([o["contrast"] for o in out])
    return means


def test_texture_against_brute_force(spark):
    array = np.random.default_rng(0).integers(0, 9, (9, 7))
    got = {r.d: r for r in X.texture(patch(spark, array), ["poly"]).collect()}
    for d in (1, 2, 4):
        for key, want in brute(array, d).items():
            assert got[d][key] == pytest.approx(want, abs=1e-9), (d, key)


def test_constant_patch(spark):
    row = X.texture(patch(spark, np.full((8, 8), 3)), ["poly"], (1,)).first()
    assert (row.contrast, row.energy, row.correlation) == (0.0, 1.0, 1.0)
    assert row.entropy == pytest.approx(0.0)
