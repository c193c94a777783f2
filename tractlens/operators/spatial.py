"""Polygon predicates as bucketed equi-joins over edge tables.

A polygon layer is a table of directed edges; `polygon_rings` folds it to one row per polygon
with its edge array and bounding box. A spatial join lays the edges on a square lattice: a cell
holds the edges that pass through it and whether its centre is inside. Points meet the polygons by
cell, so Catalyst sees an equi-join and adaptive execution can split a crowded cell, and no edge is
carried to a cell that it does not touch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.operators.scale import settled, top_k
from tractlens.session import ensure_checkpoint_dir

BOX_SHARE_FLOOR = 0.05


def polygon_rings(edges: DataFrame, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """One row per polygon: edge array, bounding box."""
    return edges.groupBy(*keys).agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),  # vertices of one polygon
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
    )


def _between(low: Column, high: Column, value: Column) -> Column:
    """Whether a value lies between two others, half-open, so that a shared corner counts once."""
    return (low > value) != (high > value)


def _edge_distance(x: Column, y: Column, e) -> Column:
    """Distance from a point to an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    long = dx * dx + dy * dy
    t = F.when(long > 0, ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / long).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _cell(v: Column, cell: float) -> Column:
    return F.floor(v / cell)


def _edges_of(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    return polygons.select(*keys, F.explode("edges").alias("_e")).select(*keys, "_e.x1", "_e.y1", "_e.x2", "_e.y2")


def _touched(edges: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    """Edges repeated over the cells that they, grown by `reach`, may pass through."""
    slack = reach + 1e-9 * cell
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("_cy", F.explode(F.sequence(_cell(low - slack, cell), _cell(high + slack, cell))))
    slope = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))

    def at(height: Column) -> Column:
        return F.col("x1") + slope * (F.greatest(low, F.least(high, height)) - F.col("y1"))

    # the part of the edge inside the row of cells
    ends = at(F.col("_cy") * cell - slack), at((F.col("_cy") + 1) * cell + slack)
    left = F.coalesce(F.least(*ends), F.least("x1", "x2"))
    right = F.coalesce(F.greatest(*ends), F.greatest("x1", "x2"))
    return rows.withColumn("_cx", F.explode(F.sequence(_cell(left - slack, cell), _cell(right + slack, cell))))


def edge_lattice(polygons: DataFrame, cell: float, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Cells that a polygon reaches: keys, _cx, _cy, `_inside` (the cell's centre), `_near` (its edges).

    Only edges that pass through a cell are kept with it. The centres of a row of cells are decided
    by the edges that cross the row's middle line: between two crossings all centres are alike, so a
    cell without edges needs no test.
    """
    keys = list(keys)
    edges = _edges_of(polygons, keys)
    near = _touched(edges, cell).groupBy(*keys, "_cx", "_cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_near"))
    middle = (F.col("_cy") + 0.5) * cell
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossing = (
        edges.withColumn("_cy", F.explode(F.sequence(_cell(low, cell), _cell(high, cell))))
        .where(_between(F.col("y1"), F.col("y2"), middle))
        .withColumn("_at", (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
        # the last cell whose centre lies left of the crossing
        .groupBy(*keys, "_cy", (F.ceil(F.col("_at") / cell - 0.5) - 1).alias("_last"))
        .agg(F.count("*").alias("_n"))
    )
    # at most one row per cell of the row
    rightward = W.partitionBy(*keys, "_cy").orderBy(F.desc("_last"))
    runs = crossing.select(
        *keys,
        "_cy",
        "_last",
        F.sum("_n").over(rightward.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_crossed"),
        F.lead("_last").over(rightward).alias("_next"),
    ).where((F.col("_crossed") % 2 == 1) & (F.col("_next") < F.col("_last")))
    within = runs.select(
        *keys, F.explode(F.sequence(F.col("_next") + 1, F.col("_last"))).alias("_cx"), "_cy", F.lit(True).alias("_inside")
    )
    return near.join(within, [*keys, "_cx", "_cy"], "full").withColumn("_inside", F.coalesce("_inside", F.lit(False)))


def _held(x: Column, y: Column, cell: float) -> Column:
    """Whether a point lies in the polygon of its lattice row: the way to the centre changes sides at edges."""
    cx, cy = (F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell

    def crosses(e: Column) -> Column:
        at_x = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        at_y = (e["y2"] - e["y1"]) * (cx - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]
        along = F.when(_between(e["y1"], e["y2"], y), ((x < at_x) != (cx < at_x)).cast("int")).otherwise(0)
        up = F.when(_between(e["x1"], e["x2"], cx), ((y < at_y) != (cy < at_y)).cast("int")).otherwise(0)
        return along + up

    crossed = F.aggregate(F.coalesce("_near", F.array()), F.lit(0), lambda n, e: n + crosses(e))
    return F.col("_inside") != (crossed % 2 == 1)


def _meet(points: DataFrame, polygons: DataFrame, cell: float, keys: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Points with the polygons that hold them."""
    placed = points.withColumn("_cx", _cell(F.col("x"), cell)).withColumn("_cy", _cell(F.col("y"), cell))
    lattice = edge_lattice(polygons, cell, [*keys, *on])
    return placed.join(lattice, [*on, "_cx", "_cy"]).where(_held(F.col("x"), F.col("y"), cell)).drop("_cx", "_cy", "_near", "_inside")


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, key: Sequence[str], cell: float, on: Sequence[str] = ()
) -> DataFrame:
    """First polygon (by key) holding each point; points outside all are dropped."""
    hits = _meet(points, polygons, cell, ["poly_id"], on)
    return hits.groupBy(*key).agg(F.min("poly_id").alias("poly_id"))


def outside_count(points: DataFrame, located: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many points fell into no polygon."""
    return points.join(located, list(key), "left_anti").agg(F.count("*").alias("outside"))


def in_any_polygon(points: DataFrame, polygons: DataFrame, key: Sequence[str], cell: float) -> DataFrame:
    """Flag 1 for points inside at least one polygon."""
    hits = point_in_polygon(points, polygons, key, cell).select(*key, F.lit(1).alias("inside"))
    return points.join(hits, list(key), "left").withColumn("inside", F.coalesce("inside", F.lit(0)))


def nearest_polygon(
    points: DataFrame, polygons: DataFrame, key: Sequence[str], reach: float, cell: float | None = None
) -> DataFrame:
    """Nearest polygon within `reach` of each point, 0 inside; ties go to the first key."""
    size = cell or max(reach, 1e-9)
    x, y = F.col("x"), F.col("y")
    holding = _meet(points, polygons, size, ["poly_id"]).select(*key, "poly_id", F.lit(0.0).alias("distance"))
    placed = points.withColumn("_cx", _cell(x, size)).withColumn("_cy", _cell(y, size))
    around = _touched(_edges_of(polygons, ["poly_id"]), size, reach)
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    close = (
        placed.join(around, ["_cx", "_cy"])
        .select(*key, "poly_id", _edge_distance(x, y, edge).alias("distance"))
        .where(F.col("distance") <= reach)
    )
    return (
        holding.unionByName(close)
        .groupBy(*key)
        .agg(F.min(F.struct("distance", "poly_id")).alias("_m"))
        .select(*key, "_m.poly_id", "_m.distance")
    )


def nearest_site(points: DataFrame, sites: DataFrame, key: str, cell: float, extent: float) -> DataFrame:
    """Nearest site to every point with no bound on the distance, exactly.

    Occupied cells form a pyramid, each with the box of its sites. Every point walks down from
    the top: a cell whose box is farther than the farthest corner of another one cannot hold
    the nearest site and is dropped, the others are replaced by their quarters. Few cells are
    left at each level, and the sites themselves are met by cell at the bottom.
    """
    levels = max(1, math.ceil(math.log2(max(extent / cell, 2.0))))
    box = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    base = sites.select(
        _cell(F.col("x"), cell).alias("cx"),
        _cell(F.col("y"), cell).alias("cy"),
        *[F.col(a).alias(f"{a}{e}") for e in ("min", "max") for a in ("x", "y")],
    ).groupBy("cx", "cy").agg(*box)

    def occupied(k: int) -> DataFrame:
        up = 2**k
        return base.groupBy(F.floor(F.col("cx") / up).alias("cx"), F.floor(F.col("cy") / up).alias("cy")).agg(*box)

    # cells as wide as the extent: four at most
    top = occupied(levels).agg(F.collect_list(F.struct("cx", "cy")).alias("t"))
    x, y = F.col("x"), F.col("y")
    walk = points.select(key, "x", "y", F.explode(top.scalar()).alias("t")).select(
        key, "x", "y", F.col("t.cx").alias("px"), F.col("t.cy").alias("py")
    )
    out = lambda v, low, high: F.greatest(F.col(low) - v, v - F.col(high), F.lit(0.0))
    far = lambda v, low, high: F.greatest(F.abs(v - F.col(low)), F.abs(v - F.col(high)))
    nearest2 = out(x, "xmin", "xmax") * out(x, "xmin", "xmax") + out(y, "ymin", "ymax") * out(y, "ymin", "ymax")
    farthest2 = far(x, "xmin", "xmax") * far(x, "xmin", "xmax") + far(y, "ymin", "ymax") * far(y, "ymin", "ymax")
    mine = W.partitionBy(key)
    for k in range(levels - 1, -1, -1):
        quarters = occupied(k).withColumn("px", F.floor(F.col("cx") / 2)).withColumn("py", F.floor(F.col("cy") / 2))
        # a level holds no more cells than fit into the extent
        small = (2 ** (levels - k) + 1) ** 2 <= 100_000
        walk = (
            walk.join(F.broadcast(quarters) if small else quarters, ["px", "py"])
            .withColumn("_near", nearest2)
            .withColumn("_bound", F.min(farthest2).over(mine))
            .where(F.col("_near") <= F.col("_bound") * (1 + 1e-9))
            .select(key, "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"))
        )
    there = sites.select(
        "site_id",
        "value",
        F.col("x").alias("sx"),
        F.col("y").alias("sy"),
        _cell(F.col("x"), cell).alias("px"),
        _cell(F.col("y"), cell).alias("py"),
    )
    dx, dy = x - F.col("sx"), y - F.col("sy")
    return (
        walk.join(there, ["px", "py"])
        .groupBy(key)
        .agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("site_id"), F.col("value"))).alias("_m"))
        .select(key, "_m.site_id", "_m.value", F.sqrt("_m.d2").alias("distance"))
    )


def pixels_in_polygons(pixels: DataFrame, grids: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Polygon holding each pixel centre; the table every polygon statistic starts from."""
    gt = lambda i: F.col("gt")[i]
    col, row = F.col("c") + 0.5, F.col("r") + 0.5
    placed = pixels.join(grids.select("box", "gt"), "box").select(
        *pixels.columns,
        (gt(0) * col + gt(1) * row + gt(2)).alias("x"),
        (gt(3) * col + gt(4) * row + gt(5)).alias("y"),
    )
    hits = _meet(placed, polygons, cell, ["poly_id", "xmin", "xmax"])
    # adjacent polygons do not overlap, so a pixel meets one polygon; the half-open rule decides on edges
    return hits.select(*pixels.columns, "poly_id", "x", "y", ((F.col("xmin") + F.col("xmax")) / 2.0).alias("mid_x"))


# ---- areas --------------------------------------------------------------------------------


def area_and_centroid(edges: DataFrame, keys: Sequence[str] = ("poly_id",)) -> DataFrame:
    """Shoelace area and area centroid; several polygons of a key add up.

    The rings of a key must all run the same way round; rings of opposite orientation are holes.
    """
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(*keys).agg(
        F.sum(cross).alias("a2"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
    )
    return sums.select(
        *keys,
        (F.abs("a2") / 2.0).alias("area"),
        (F.col("mx") / (F.col("a2") * 3.0)).alias("cx"),
        (F.col("my") / (F.col("a2") * 3.0)).alias("cy"),
    )


def clipped_area(edges: Column, xmin, ymin, xmax, ymax) -> Column:
    """Area of a polygon inside a rectangle, exactly, as one sum over its edges.

    The height of the clipped polygon above `ymin` at some x is the signed sum of its edges'
    clamped heights, so its area is the signed sum of the integrals of clamped lines.
    """
    x0, y0, x1, y1 = (F.lit(float(v)) for v in (xmin, ymin, xmax, ymax))

    def clamp(v, low, high):
        return F.greatest(low, F.least(high, v))

    def upto(t: Column) -> Column:
        """Integral of the clamped height from far below up to t."""
        full = y1 - y0
        mid = clamp(t, y0, y1) - y0
        return mid * mid / 2.0 + full * F.greatest(t - y1, F.lit(0.0))

    def one(e: Column) -> Column:
        a, b = clamp(e["x1"], x0, x1), clamp(e["x2"], x0, x1)
        slope = F.when(e["x2"] != e["x1"], (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])).otherwise(0.0)
        ya, yb = e["y1"] + slope * (a - e["x1"]), e["y1"] + slope * (b - e["x1"])
        mean = F.when(F.abs(yb - ya) < 1e-12, clamp(ya, y0, y1) - y0).otherwise((upto(yb) - upto(ya)) / (yb - ya))
        return (b - a) * mean

    return F.abs(F.aggregate(F.transform(edges, one), F.lit(0.0), lambda s, v: s + v))


def municipalities_in_box(rings: DataFrame, bbox: tuple, floor: float = BOX_SHARE_FLOOR, own: str | None = None) -> DataFrame:
    """Polygons with enough of their area in the box; the box's own municipality always stays."""
    xmin, ymin, xmax, ymax = bbox
    touching = rings.where(
        (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
    )
    area = F.abs(
        F.aggregate(
            F.transform("edges", lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]), F.lit(0.0), lambda s, v: s + v
        )
    ) / 2.0
    share = clipped_area(F.col("edges"), *bbox) / area
    keep = F.col("share") >= floor
    if own is not None:
        keep = keep | (F.col("poly_id") == own)
    return touching.withColumn("share", share).where(keep).select("poly_id", "share")


def dissolve(edges: DataFrame, key: str) -> DataFrame:
    """Outline of each group of tracts: edges shared by two of its tracts vanish."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return (
        edges.select(key, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .groupBy(key, "a", "b")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") % 2 == 1)
        .select(key, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    )


# ---- urban mass ---------------------------------------------------------------------------


def _segment_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of two edges, 0 where they cross."""

    def side(p: dict[str, Column], x: Column, y: Column) -> Column:
        return (p["x2"] - p["x1"]) * (y - p["y1"]) - (p["y2"] - p["y1"]) * (x - p["x1"])

    one = side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) < 0
    two = side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) < 0
    # edges that do not cross are nearest at an end of one of them
    ends = [_edge_distance(p[f"x{i}"], p[f"y{i}"], q) for p, q in ((a, b), (b, a)) for i in (1, 2)]
    return F.when(one & two, F.lit(0.0)).otherwise(F.least(*ends))


def _close_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) of polygons no farther apart than `reach`, all of them: where polygons crowd they
    grow with the square, so masses and cores do without.

    Edges meet by cell, one side grown by `reach`, and a pair of polygons is kept once by its least
    distance. A polygon that lies inside another without a near edge is found by one of its corners.
    """
    cell = max(2.0 * reach, 1e-9)
    names = ("x1", "y1", "x2", "y2")

    def side(df: DataFrame, name: str, grown: float) -> DataFrame:
        return _touched(_edges_of(df, ["poly_id"]), cell, grown).select(
            "_cx", "_cy", F.col("poly_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in names]
        )

    one, two = ({c: F.col(f"{n}_{c}") for c in names} for n in ("a", "b"))
    beside = (
        side(left, "a", reach)
        .join(side(right, "b", 0.0), ["_cx", "_cy"])
        .where(F.col("a") != F.col("b"))
        .select("a", "b", _segment_distance(one, two).alias("_d"))
        .groupBy("a", "b")
        .agg(F.min("_d").alias("_d"))
        .where(F.col("_d") <= reach)
        .select("a", "b")
    )

    def held(inner: DataFrame, outer: DataFrame, small: str, large: str) -> DataFrame:
        corner = F.col("edges")[0]
        points = inner.select(F.col("poly_id").alias(small), corner["x1"].alias("x"), corner["y1"].alias("y"))
        box = (F.col("xmax") - F.col("xmin") + F.col("ymax") - F.col("ymin")) / 2.0
        # cells about as large as a polygon
        wide = max(outer.agg(F.percentile_approx(box, 0.5)).first()[0] or cell, cell)
        hits = _meet(points, outer, wide, ["poly_id"]).select(small, F.col("poly_id").alias(large))
        return hits.where(F.col(small) != F.col(large)).select("a", "b")

    return beside.unionByName(held(left, right, "a", "b")).unionByName(held(right, left, "b", "a")).distinct()


# cells of a third of the reach: whatever shares a cell, or lies in two that touch, is within reach
PARTS = 3
SLACK = 1e-6
"""Share of a cell by which a pair of cells must be nearer, or farther, than the reach to need no test."""
TESTS_PER_EDGE = 16
HALVINGS = 12


def _steps(parts: int) -> list[tuple[int, int]]:
    """Steps to the cells that may hold something within `parts` cell sides."""
    span = range(-parts - 1, parts + 2)
    return [(i, j) for i in span for j in span if _gap(i, j) <= parts + SLACK]


def _gap(i: int, j: int) -> float:
    return math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0))


def _cells_of(edges: DataFrame, cell: float, key: str = "poly_id") -> DataFrame:
    return _touched(edges, cell).select(key, "_cx", "_cy").distinct()


def _around(cells: DataFrame, steps: Sequence[tuple[int, int]], at: Sequence[str], to: Sequence[str]) -> DataFrame:
    """Rows with a cell in `at`, repeated for each step, with the cell it leads to in `to`."""
    ways = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in steps])
    moved = {t: F.col(c) + F.col("_w")[w] for c, t, w in zip(at, to, "ij", strict=True)}
    return cells.withColumn("_w", F.explode(ways)).withColumns(moved).drop("_w")


def _within_reach(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) of groups of edges, a <> b, with two edges no farther apart than `reach`, each once.

    `left(a, x1, y1, x2, y2)` and `right(b, ...)` meet as pairs of occupied cells. Pairs of cells that lie
    within reach as a whole need no test, those out of reach are dropped, and what is open is halved until
    the edges left to be tested are few beside all edges. So a crowded place is not expanded into its pairs.
    """
    names = ["x1", "y1", "x2", "y2"]
    left, right = settled(left.select("a", *names).distinct()), settled(right.select("b", *names).distinct())
    cell = max(reach / PARTS, 1e-9)
    budget = TESTS_PER_EDGE * (left.count() + right.count())
    found, pairs = [], None
    lcell, rcell = ["_lx", "_ly"], ["_rx", "_ry"]

    def placed(edges: DataFrame, key: str, at: list[str]) -> DataFrame:
        return _touched(edges, cell).select(key, F.col("_cx").alias(at[0]), F.col("_cy").alias(at[1]), *names)

    for level in range(HALVINGS):
        ledges, redges = placed(left, "a", lcell), placed(right, "b", rcell)
        lcells = ledges.groupBy("a", *lcell).agg(F.count("*").alias("_ln"))
        rcells = redges.groupBy("b", *rcell).agg(F.count("*").alias("_rn"))
        if pairs is None:
            near = _around(lcells, _steps(PARTS), lcell, rcell).join(rcells, rcell)
        else:
            up = [F.expr(f"floor({c} / 2)").alias(f"{c}0") for c in (*lcell, *rcell)]
            near = (
                pairs.select("a", "b", *[F.col(c).alias(f"{c}0") for c in (*lcell, *rcell)])
                .join(lcells.select("*", *up[:2]), ["a", "_lx0", "_ly0"])
                .join(rcells.select("*", *up[2:]), ["b", "_rx0", "_ry0"])
            )
        ahead, aside = F.abs(F.col("_lx") - F.col("_rx")), F.abs(F.col("_ly") - F.col("_ry"))
        nearest = F.hypot(F.greatest(ahead - 1, F.lit(0)), F.greatest(aside - 1, F.lit(0))) * cell
        farthest = F.hypot(ahead + 1, aside + 1) * cell
        near = settled(
            near.where((F.col("a") != F.col("b")) & (nearest <= reach + SLACK * cell)).select(
                "a", "b", *lcell, *rcell, (F.col("_ln") * F.col("_rn")).alias("_tests"), (farthest <= reach - SLACK * cell).alias("_sure")
            )
        )
        sure = settled(near.where("_sure").select("a", "b").distinct())
        found.append(sure)
        pairs = settled(near.where("NOT _sure").join(sure, ["a", "b"], "left_anti"))
        if (pairs.agg(F.sum("_tests")).first()[0] or 0) <= budget or level == HALVINGS - 1:
            break
        left = settled(left.join(pairs.select("a").distinct(), "a", "left_semi"))
        right = settled(right.join(pairs.select("b").distinct(), "b", "left_semi"))
        cell /= 2
    one, two = ({c: F.col(f"{n}_{c}") for c in names} for n in "ab")
    tested = (
        pairs.join(ledges.select("a", *lcell, *[F.col(c).alias(f"a_{c}") for c in names]), ["a", *lcell])
        .join(redges.select("b", *rcell, *[F.col(c).alias(f"b_{c}") for c in names]), ["b", *rcell])
        .where(_segment_distance(one, two) <= reach)
        .select("a", "b")
    )
    for sure in found:
        tested = tested.unionByName(sure)
    return settled(tested.distinct())


def _corners(polygons: DataFrame) -> DataFrame:
    """One corner of each polygon: poly_id, x, y."""
    corner = F.col("edges")[0]
    return polygons.select("poly_id", corner["x1"].alias("x"), corner["y1"].alias("y"))


def _thinned(corners: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """One corner a cell, under the least key there, and the keys that it stands for (poly_id, stands)."""
    placed = corners.withColumn("_cx", _cell(F.col("x"), cell)).withColumn("_cy", _cell(F.col("y"), cell))
    first = placed.groupBy("_cx", "_cy").agg(F.min(F.struct("poly_id", "x", "y")).alias("_m"))
    stood = placed.select("poly_id", "_cx", "_cy").join(first, ["_cx", "_cy"]).select("poly_id", F.col("_m.poly_id").alias("stands"))
    return first.select(F.col("_m.poly_id").alias("corner"), "_m.x", "_m.y"), stood


def _holders(corners: DataFrame, outer: DataFrame, floor: float) -> DataFrame:
    """Polygons that hold a corner: corner, poly_id."""
    box = (F.col("xmax") - F.col("xmin") + F.col("ymax") - F.col("ymin")) / 2.0
    # cells about as large as a polygon
    wide = max(outer.agg(F.percentile_approx(box, 0.5)).first()[0] or floor, floor)
    return _meet(corners, outer, wide, ["poly_id"]).select("corner", "poly_id")


def near_core(rings: DataFrame, core: Column, reach: float) -> DataFrame:
    """Polygons of the core and those within `reach` of it.

    Most are told by the cells that the core occupies; the rest meet it by edges. A polygon without an
    edge near the core's may still lie in one of its polygons or hold one. Then no outline passes between
    corners that share a cell, so one corner a cell is enough.
    """
    cell = max(reach / PARTS, 1e-9)
    rings = settled(rings)
    heart, rest = rings.where(core), rings.where(~core)
    at = ["_cx", "_cy"]
    taken = _cells_of(_edges_of(heart, ["poly_id"]), cell).select("_cx", "_cy").distinct()
    beside = settled(_around(taken, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], at, at).distinct())
    close = _cells_of(_edges_of(rest, ["poly_id"]), cell).join(beside, ["_cx", "_cy"], "left_semi").select("poly_id").distinct()
    close = settled(close)
    rest = settled(rest.join(close, "poly_id", "left_anti"))

    def sides(polygons: DataFrame, name: str, key: Column) -> DataFrame:
        return _edges_of(polygons, ["poly_id"]).select(key.alias(name), "x1", "y1", "x2", "y2")

    # the core is one group, whose name no polygon has
    one, none = F.struct(F.lit(0).alias("core"), F.col("poly_id")), F.lit(None).cast(rings.schema["poly_id"].dataType)
    met = _within_reach(sides(rest, "a", one), sides(heart, "b", F.struct(F.lit(1).alias("core"), none.alias("poly_id"))), reach)
    met = met.select("a.poly_id")
    rest = settled(rest.join(met, "poly_id", "left_anti"))
    inner, stood = _thinned(_corners(rest), cell)
    lying = stood.join(_holders(inner, heart, cell).select(F.col("corner").alias("stands")).distinct(), "stands", "left_semi").select("poly_id")
    holding = _holders(_thinned(_corners(heart), cell)[0], rest, cell).select("poly_id")
    close = close.unionByName(met).unionByName(lying).unionByName(holding).distinct()
    return heart.unionByName(rings.where(~core).join(close, "poly_id", "left_semi"))


def connected_components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node name of each component, by parent hooking with shortcuts.

    A node and its parent both take the smallest grandparent heard over an edge, and every
    node skips to its own grandparent, so the number of rounds grows with the logarithm of a
    component. Each round is written to the checkpoint folder: the plan stays short and a
    lost executor costs one round.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    once = pairs.select("a", "b").checkpoint()
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = nodes.select(F.col("poly_id").alias("a"), F.col("poly_id").alias("up")).checkpoint()
    for _ in range(max_rounds):
        grand = state.join(state.select(F.col("a").alias("up"), F.col("up").alias("top")), "up")
        heard = (
            both.join(grand.select(F.col("a").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("heard"))
        )
        offers = grand.join(heard, "a", "left").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.least("up", "top", "heard").alias("up")),
                    F.struct(F.col("up").alias("a"), F.least("up", "top", "heard").alias("up")),
                )
            ).alias("o")
        )
        fresh = offers.groupBy(F.col("o.a").alias("a")).agg(F.min("o.up").alias("up"))
        moved = fresh.join(state.withColumnRenamed("up", "_old"), "a").checkpoint()
        state = moved.select("a", "up")
        if moved.where("up <> _old").isEmpty():
            return state.select(F.col("a").alias("poly_id"), F.col("up").alias("component"))
    raise RuntimeError("components did not settle")


def masses(rings: DataFrame, reach: float) -> DataFrame:
    """Smallest key of the polygons joined with each one by gaps of at most `reach`: poly_id, component.

    No pair of polygons is written out. Whatever shares a cell, or lies in two that touch, is one mass;
    masses then meet by edges across wider gaps, and at last by one corner each: a mass whose edges all
    keep off an outline lies inside it as a whole or not at all.
    """
    cell = max(reach / PARTS, 1e-9)
    rings = settled(rings.select("poly_id", "edges", "xmin", "ymin", "xmax", "ymax"))
    edges = _edges_of(rings, ["poly_id"])
    at = ["_cx", "_cy"]
    touched = settled(_cells_of(edges, cell))
    cells = settled(touched.groupBy("_cx", "_cy").agg(F.min("poly_id").alias("root")))
    # a polygon joins the first polygons of its cells
    homes = settled(
        touched.join(cells, ["_cx", "_cy"]).groupBy("poly_id").agg(F.min("root").alias("hub"), F.collect_set("root").alias("roots"))
    )
    spread = homes.where(F.size("roots") > 1).select(F.col("hub").alias("a"), F.explode("roots").alias("b"))
    forward = _around(cells.withColumnRenamed("root", "a"), [(1, -1), (1, 0), (1, 1), (0, 1)], at, at)
    beside = forward.join(cells.withColumnRenamed("root", "b"), ["_cx", "_cy"]).select("a", "b")
    links = spread.unionByName(beside).where("a <> b").distinct()
    roots = cells.select(F.col("root").alias("poly_id")).distinct()
    parts = connected_components(roots, links).withColumnRenamed("poly_id", "hub")
    state = settled(homes.select("poly_id", "hub").join(parts, "hub").select("poly_id", "component"))
    if state.select("component").distinct().count() < 2:
        return state
    outline = edges.join(state, "poly_id").select("component", "x1", "y1", "x2", "y2")
    across = _within_reach(outline.withColumnRenamed("component", "a"), outline.withColumnRenamed("component", "b"), reach)
    state = _merged(state, across)
    corners = _corners(rings.join(state.select(F.col("component").alias("poly_id")).distinct(), "poly_id", "left_semi"))
    held = _holders(corners.withColumnRenamed("poly_id", "corner"), rings, cell).join(state, "poly_id")
    return _merged(state, held.select(F.col("corner").alias("a"), F.col("component").alias("b")).where("a <> b").distinct())


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """Components joined by further links between them."""
    nodes = state.select(F.col("component").alias("poly_id")).distinct()
    wider = connected_components(nodes, links).select(F.col("poly_id").alias("component"), F.col("component").alias("wider"))
    return settled(state.join(wider, "component").select("poly_id", F.col("wider").alias("component")))


def urban_mass(rings: DataFrame, is_core: Column, bridge: float) -> DataFrame:
    """The component with most core polygons; each polygon is dilated by `bridge`, so gaps up to
    twice that join. Ties go to the first component."""
    parts = masses(rings, 2.0 * bridge)
    marked = rings.withColumn("_core", is_core.cast("long")).select("poly_id", "_core").join(parts, "poly_id")
    counts = marked.groupBy("component").agg(F.sum("_core").alias("core"))
    best = counts.agg(F.min_by("component", F.struct((-F.col("core")).alias("c"), F.col("component")))).scalar()
    return marked.where(F.col("component") == best).select("poly_id", "component")


# ---- truth and assembly -------------------------------------------------------------------


def stratum_truth(points: DataFrame, blocks: DataFrame, key: Sequence[str], reach: float, cell: float) -> DataFrame:
    """Minus the stratum (1..6) of the nearest block within reach; stratum 0 carries no order."""
    ranked = blocks.where(F.col("stratum").between(1, 6))
    near = nearest_polygon(points, ranked.drop("stratum"), key, reach, cell)
    return near.join(ranked.select("poly_id", "stratum"), "poly_id").select(
        *key, (-F.col("stratum").cast("double")).alias("truth"), F.col("poly_id").alias("unit")
    )


def income_truth(points: DataFrame, tracts: DataFrame, key: Sequence[str], cell: float) -> DataFrame:
    """Minus log income of the tract that holds the point, and the tract key."""
    located = point_in_polygon(points, tracts.drop("income"), key, cell)
    return located.join(tracts.select("poly_id", "income"), "poly_id").select(
        *key, (-F.log(F.when(F.col("income") > 0, F.col("income")))).alias("truth"), F.col("poly_id").alias("unit")
    )


def transfer_bags(
    tokens: DataFrame,
    municipalities: DataFrame,
    labels: DataFrame,
    truth: DataFrame,
    key: Sequence[str],
    cell: float,
    built_floor: float = 0.10,
) -> DataFrame:
    """Built tokens with their municipality, its label, and the local truth where there is one."""
    built = tokens.where(F.col("built") >= built_floor)
    located = point_in_polygon(built, municipalities, key, cell).withColumnRenamed("poly_id", "municipality")
    return (
        built.join(located, list(key))
        .join(labels, "municipality", "left")
        .join(truth, list(key), "left")
    )


def seat_zones(zones: DataFrame, min_area: float) -> DataFrame:
    """Largest urban zone of each municipality, above an area floor."""
    seats = zones.where(F.col("zone_class") == "1")
    largest = top_k(seats, ["municipality"], [F.col("area").desc(), F.col("zone_id").asc()], 1).drop("place")
    return largest.where(F.col("area") >= min_area)


def seat_tracts(tracts: DataFrame) -> DataFrame:
    """Urban tracts of the district named like its municipality; all urban tracts where none is."""
    urban = tracts.where(F.col("situation") == "Urbana").withColumn(
        "_seat", (F.col("district") == F.col("name")).cast("int")
    )
    has = urban.groupBy("municipality").agg(F.max("_seat").alias("_any"))
    return urban.join(has, "municipality").where(F.col("_seat") == F.col("_any")).drop("_seat", "_any")
