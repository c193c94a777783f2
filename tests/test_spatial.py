import numpy as np
import pytest
from pyspark.sql import functions as F

from tractlens.operators import spatial as P


def square(spark, items):
    rows = []
    for key, x, y, s in items:
        pts = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
        rows += [(key, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]
    return spark.createDataFrame(rows, "poly_id string, x1 double, y1 double, x2 double, y2 double")


def test_shared_edges_and_vertices_belong_to_one_polygon(spark):
    rings = P.polygon_rings(square(spark, [("a", 0.0, 0.0, 1.0), ("b", 1.0, 0.0, 1.0)]))
    points = spark.createDataFrame(
        [(0, 0.5, 0.5), (1, 1.0, 0.5), (2, 1.0, 0.0), (3, 5.0, 5.0)], "point_id long, x double, y double"
    )
    got = {r.point_id: r.poly_id for r in P.point_in_polygon(points, rings, ["point_id"], 0.7).collect()}
    assert got == {0: "a", 1: "b", 2: "b"}


def test_nearest_polygon_within_reach(spark):
    rings = P.polygon_rings(square(spark, [("a", 0.0, 0.0, 1.0), ("b", 3.0, 0.0, 1.0)]))
    points = spark.createDataFrame(
        [(0, 1.4, 0.5), (1, 2.0, 0.5), (2, 3.5, 0.5), (3, 1.3, 1.4)], "point_id long, x double, y double"
    )
    got = {r.point_id: (r.poly_id, round(r.distance, 6)) for r in P.nearest_polygon(points, rings, ["point_id"], 0.5).collect()}
    assert got == {0: ("a", 0.4), 2: ("b", 0.0), 3: ("a", 0.5)}


def test_nearest_site_against_brute_force(spark):
    rng = np.random.default_rng(1)
    sites = np.vstack([rng.normal(0, 0.3, (60, 2)), [[40.0, 40.0]]])
    points = np.vstack([rng.uniform(-50, 50, (80, 2)), sites[:3]])
    s = spark.createDataFrame([(i, float(i), *map(float, p)) for i, p in enumerate(sites)], "site_id long, value double, x double, y double")
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(points)], "k long, x double, y double")
    got = {r.k: r.distance for r in P.nearest_site(p, s, "k", 0.25, 128.0).collect()}
    want = np.hypot(*(points[:, None] - sites).transpose(2, 0, 1)).min(axis=1)
    assert np.allclose([got[i] for i in range(len(points))], want)


def test_area_rule_keeps_the_own_municipality(spark):
    rings = P.polygon_rings(square(spark, [("in", 1.0, 1.0, 1.0), ("half", 3.5, 1.0, 1.0), ("graze", 3.98, 2.0, 1.0), ("own", 3.99, 3.0, 1.0)]))
    got = {r.poly_id: r.share for r in P.municipalities_in_box(rings, (0, 0, 4, 4), own="own").collect()}
    assert set(got) == {"in", "half", "own"}
    assert got["in"] == pytest.approx(1.0) and got["half"] == pytest.approx(0.5)


def test_satellite_is_dropped_and_most_core_wins(spark):
    items = [("c1", 0.0, 0.0, 1.0), ("n1", 3.0, 0.0, 1.0), ("c2", 6.0, 0.0, 1.0), ("far", 60.0, 0.0, 1.0)]
    rings = P.polygon_rings(square(spark, items))
    got = {r.poly_id for r in P.urban_mass(rings, F.col("poly_id").startswith("c"), 1.0).collect()}
    assert got == {"c1", "n1", "c2"}


def test_components_of_a_long_chain(spark):
    n = 200
    order = np.random.default_rng(0).permutation(n)
    nodes = spark.createDataFrame([(int(i),) for i in range(n)], "poly_id long")
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)], "a long, b long")
    got = P.connected_components(nodes, pairs)
    assert got.select("component").distinct().collect() == [(0,)]


def test_close_pairs_of_outlines(spark):
    items = [("a", 0.0, 0.0, 1.0), ("b", 3.0, 0.0, 1.0), ("inner", 0.4, 0.4, 0.2), ("cross", 0.8, 0.9, 0.5), ("far", 9.0, 9.0, 1.0)]
    rings = P.polygon_rings(square(spark, items))

    def pairs(reach):
        return {(r.a, r.b) for r in P._close_pairs(rings, rings, reach).where("a < b").collect()}

    assert pairs(0.01) == {("a", "inner"), ("a", "cross")}
    assert pairs(2.0) == {("a", "inner"), ("a", "cross"), ("a", "b"), ("b", "cross"), ("cross", "inner")}
    assert pairs(1.99) == pairs(2.0) - {("a", "b")}


def star(corners, rng):
    """A jagged ring around a centre, with corners at random distances."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, corners))
    away = rng.uniform(2, 6, corners)
    return np.column_stack([away * np.cos(angle), away * np.sin(angle)])


def ring_rows(key, corners):
    return [(key, *map(float, a), *map(float, b)) for a, b in zip(corners, np.roll(corners, -1, axis=0))]


@pytest.mark.parametrize("cell", [0.31, 1.0, 7.0, 40.0])
def test_lattice_equals_the_crossing_rule(spark, cell):
    rng = np.random.default_rng(8)
    shapes = {"s": star(40, rng), "t": star(9, rng) * 0.5 + 3.0}
    # a grid of whole numbers puts corners, edges and points on cell borders
    shapes["u"] = np.array([(-4, -4), (4, -4), (4, -2), (-2, -2), (-2, 4), (-4, 4)], float)
    edges = spark.createDataFrame(
        [r for k, c in shapes.items() for r in ring_rows(k, c)], "poly_id string, x1 double, y1 double, x2 double, y2 double"
    )
    pts = np.vstack([rng.uniform(-7, 7, (300, 2)), np.stack(np.meshgrid(np.arange(-5, 6), np.arange(-5, 6)), -1).reshape(-1, 2)])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, x double, y double")
    got = {(r.k, r.poly_id) for r in P._meet(points, P.polygon_rings(edges), cell, ["poly_id"]).collect()}
    want = set()
    for name, c in shapes.items():
        (x1, y1), (x2, y2) = c.T, np.roll(c, -1, axis=0).T
        for i, (x, y) in enumerate(pts):
            spans = (y1 > y) != (y2 > y)
            at = (x2 - x1) * (y - y1) / np.where(spans, y2 - y1, 1.0) + x1
            if (spans & (x < at)).sum() % 2:
                want.add((i, name))
    assert got == want


def test_a_ring_of_a_hundred_thousand_edges(spark):
    n = 100_000
    k = F.col("id") * (2 * np.pi / n)
    step = 2 * np.pi / n
    edges = spark.range(n).select(
        F.lit("disc").alias("poly_id"), F.cos(k).alias("x1"), F.sin(k).alias("y1"), F.cos(k + step).alias("x2"), F.sin(k + step).alias("y2")
    )
    rng = np.random.default_rng(2)
    pts = rng.uniform(-1.2, 1.2, (2000, 2))
    pts = pts[np.abs(np.hypot(*pts.T) - 1) > 1e-6]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, x double, y double")
    found = {r.k for r in P.point_in_polygon(points, P.polygon_rings(edges), ["k"], 0.05).collect()}
    assert found == set(np.flatnonzero(np.hypot(*pts.T) < 1).tolist())
    lattice = P.edge_lattice(P.polygon_rings(edges), 0.05)
    assert lattice.agg(F.max(F.size("_near"))).first()[0] < n / 20


def test_dissolve_drops_shared_edges(spark):
    edges = square(spark, [("a", 0.0, 0.0, 1.0), ("b", 1.0, 0.0, 1.0)]).withColumn("m", F.lit("m"))
    assert P.dissolve(edges, "m").count() == 6


def _scattered(spark, seed):
    """Clusters, copies, a nest of squares with wide gaps, and loners at gaps around the reach."""
    rng = np.random.default_rng(seed)
    items = [(float(x), float(y), float(s)) for x, y, s in zip(*rng.uniform(0, 60, (2, 60)), rng.choice([0.5, 2.0, 7.0], 60))]
    items += items[:20] + [(100.0 + i, 100.0 + i, 60.0 - 2 * i) for i in (0, 6, 13, 21)]
    items += [(100.0 * k, -50.0, 1.0) for k in range(3)] + [(100.0 * k + 4.0, -50.0, 1.0) for k in range(3)]
    return P.polygon_rings(square(spark, [(f"{i:03d}", *t) for i, t in enumerate(items)]))


def test_masses_and_near_core_equal_all_pairs(spark, monkeypatch):
    # open cells are halved twice before edges are tested
    monkeypatch.setattr(P, "TESTS_PER_EDGE", 0)
    monkeypatch.setattr(P, "HALVINGS", 3)
    reach, rings = 3.0, _scattered(spark, 3).cache()
    pairs = {(r.a, r.b) for r in P._close_pairs(rings, rings, reach).collect()}
    names = sorted(r.poly_id for r in rings.select("poly_id").collect())
    want = {n: n for n in names}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if want[b] < want[a]:
                want[a], moved = want[b], True
    assert {r.poly_id: r.component for r in P.masses(rings, reach).collect()} == want
    for core in (["081", "084", *names[:60:29]],):
        near = {a for a, b in pairs if b in core} | set(core)
        assert {r.poly_id for r in P.near_core(rings, F.col("poly_id").isin(core), reach).collect()} == near


def test_a_crowded_place_is_not_expanded_into_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all pairs asked for")

    monkeypatch.setattr(P, "_close_pairs", refuse)
    k = F.col("id")
    line = spark.range(4000).select(k.alias("poly_id"), (k * 7919 % 1009 / 10.0).alias("x"))
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    sides = F.array(*[F.struct(*[F.lit(float(v)) for v in (*a, *b)]) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    edges = line.select("poly_id", "x", F.explode(sides).alias("e")).select(
        "poly_id", (F.col("x") + F.col("e.col1")).alias("x1"), F.col("e.col2").alias("y1"), (F.col("x") + F.col("e.col3")).alias("x2"), F.col("e.col4").alias("y2")
    )
    rings = P.polygon_rings(edges)
    assert P.urban_mass(rings, F.col("poly_id") % 5 == 0, 12.0).count() == 4000
