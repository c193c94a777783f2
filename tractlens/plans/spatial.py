"""Queries on polygons: containment, nearness, areas, urban mass, transfer bags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import spatial as P
from tractlens.operators import zonal as Z
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query

CELL = 5.0
_CROSS = "((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"
_HIT = f"""SELECT point_id, x, y, poly_id FROM points, edges GROUP BY 1, 2, 3, 4 HAVING sum(CASE WHEN {_CROSS} THEN 1 ELSE 0 END) % 2 = 1"""


def rings(d: Data):
    return P.polygon_rings(d.polygon_edges())


@query(
    "c4_point_in_polygon",
    cte("edges", "points", hit=_HIT) + "SELECT point_id, min(poly_id) AS poly_id FROM hit GROUP BY 1",
)
def _(d: Data):
    return P.point_in_polygon(d.points(), rings(d), ["point_id"], CELL)


@query(
    "c4_points_outside",
    cte("edges", "points", hit=_HIT) + "SELECT count(*) AS outside FROM points WHERE point_id NOT IN (SELECT point_id FROM hit)",
)
def _(d: Data):
    located = P.point_in_polygon(d.points(), rings(d), ["point_id"], CELL)
    return P.outside_count(d.points(), located, ["point_id"])


@query(
    "c5_in_any_polygon",
    cte("edges", "points", hit=_HIT)
    + "SELECT point_id, x, y, value, CASE WHEN point_id IN (SELECT point_id FROM hit) THEN 1 ELSE 0 END AS inside FROM points",
    "x y value",
)
def _(d: Data):
    return P.in_any_polygon(d.points(), rings(d), ["point_id"], CELL)


_T = "greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_DIST = f"""SELECT point_id, poly_id, CASE WHEN sum(CASE WHEN {_CROSS} THEN 1 ELSE 0 END) % 2 = 1 THEN 0.0 ELSE
 min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) END AS distance
 FROM (SELECT *, {_T} AS t FROM points, edges) GROUP BY 1, 2"""
_NEAR = """SELECT point_id, poly_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, poly_id) AS rn
 FROM dist WHERE distance <= 0.75) WHERE rn = 1"""


@query("c6_nearest_polygon", cte("edges", "points", dist=_DIST) + _NEAR, "distance")
def _(d: Data):
    return P.nearest_polygon(d.points(), rings(d), ["point_id"], 0.75, CELL)


_SITES = """SELECT s_suppkey AS site_id, s_acctbal AS value, (s_suppkey * 53 % 89)::DOUBLE / 20.0 + 1 AS x, (s_suppkey * 31 % 83)::DOUBLE / 20.0 + 2 AS y FROM supplier"""


def sites(d: Data):
    k = F.col("s_suppkey")
    return d.table("supplier").select(
        k.alias("site_id"),
        F.col("s_acctbal").alias("value"),
        (k * 53 % 89 / 20.0 + 1).alias("x"),
        (k * 31 % 83 / 20.0 + 2).alias("y"),
    )


@query(
    "c7_nearest_site",
    cte("points", s=_SITES)
    + """SELECT point_id, site_id, value, distance FROM (SELECT p.point_id, s.site_id, s.value, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS distance,
 row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.site_id) AS rn FROM points p, s) WHERE rn = 1""",
    "distance value",
)
def _(d: Data):
    return P.nearest_site(d.points(), sites(d), "point_id", 0.25, 32.0)


# pixels of the dense layer on the board of polygons, 0.4 ground units per pixel
_PP = f"""SELECT box, r, c, value, poly_id FROM (SELECT *, 0.4 * (c + 0.5) + 0.013 AS x, 25.513 - 0.4 * (r + 0.5) AS y FROM layer), edges
 GROUP BY box, r, c, value, poly_id, x, y HAVING sum(CASE WHEN {_CROSS} THEN 1 ELSE 0 END) % 2 = 1"""


def grids(d: Data):
    gt = F.array(*[F.lit(v) for v in (0.4, 0.0, 0.013, 0.0, -0.4, 25.513)])
    return d.spark.range(4).select(F.col("id").alias("box"), gt.alias("gt"))


def assigned(d: Data):
    return P.pixels_in_polygons(d.layer(), grids(d), rings(d), CELL)


@query("c8_pixels_in_polygons", cte("edges", "layer", pp=_PP) + "SELECT box, r, c, value, poly_id FROM pp")
def _(d: Data):
    return assigned(d).select("box", "r", "c", "value", "poly_id")


@query(
    "d10_polygon_class_fractions",
    cte("edges", "layer", pp=_PP)
    + """SELECT box, poly_id, count(*) AS wc_n_px, avg(CASE WHEN v = 10 THEN 1.0 ELSE 0 END) AS wc_tree, avg(CASE WHEN v = 50 THEN 1.0 ELSE 0 END) AS wc_built
 FROM (SELECT *, floor(value) % 12 * 10 AS v FROM pp) WHERE v <> 0 GROUP BY 1, 2""",
    "wc_tree wc_built",
)
def _(d: Data):
    classes = assigned(d).withColumn("value", F.floor("value") % 12 * 10)
    return Z.class_fractions(classes, ["box", "poly_id"], {10: "tree", 50: "built"})


# a coarse layer of 3.7 ground units per cell: half of the small squares hold no centre
_CO = """SELECT CAST(floor(y / 3.7) AS BIGINT) AS r, CAST(floor(x / 3.7) AS BIGINT) AS c, avg(value) AS value FROM points GROUP BY 1, 2"""
_SQ = """SELECT c_custkey AS poly_id, (c_custkey * 29 % 2399)::DOUBLE / 100.0 + 0.0013 AS px, (c_custkey * 17 % 2411)::DOUBLE / 100.0 + 0.0013 AS py, 2.6::DOUBLE AS side FROM customer"""


def squares(d: Data):
    k = F.col("c_custkey")
    return d.table("customer").select(
        k.alias("poly_id"),
        (k * 29 % 2399 / 100.0 + 0.0013).alias("px"),
        (k * 17 % 2411 / 100.0 + 0.0013).alias("py"),
        F.lit(2.6).alias("side"),
    )


def square_edges(sq):
    """Four directed edges of each square."""
    x, y, s = F.col("px"), F.col("py"), F.col("side")
    corners = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    return sq.select(
        *[c for c in sq.columns if c not in ("px", "py", "side")],
        F.explode(
            F.array(
                *[
                    F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
                    for a, b in zip(corners, corners[1:] + corners[:1], strict=True)
                ]
            )
        ).alias("e"),
    ).select(*[c for c in sq.columns if c not in ("px", "py", "side")], "e.*")


@query(
    "d12_zonal_mean",
    cte("points", co=_CO, sq=_SQ)
    + """SELECT poly_id, coalesce(avg(CASE WHEN i.value IS NOT NULL THEN i.value END), any_value(f.value)) AS wealth, count(i.value) AS wealth_n_px
 FROM sq LEFT JOIN co i ON i.c * 3.7 + 1.85 >= px AND i.c * 3.7 + 1.85 < px + side AND i.r * 3.7 + 1.85 > py AND i.r * 3.7 + 1.85 <= py + side
 LEFT JOIN co f ON f.c = CAST(floor((px + 1.3) / 3.7) AS BIGINT) AND f.r = CAST(floor((py + 1.3) / 3.7) AS BIGINT) GROUP BY 1""",
    "wealth",
)
def _(d: Data):
    coarse = (
        d.points()
        .groupBy(F.floor(F.col("y") / 3.7).alias("r"), F.floor(F.col("x") / 3.7).alias("c"))
        .agg(F.avg("value").alias("value"))
        .withColumn("box", F.floor(F.col("c") / 1_000_000))
    )
    gt = F.array(*[F.lit(v) for v in (3.7, 0.0, 0.0, 0.0, 3.7, 0.0)])
    grid = d.spark.range(1).select(F.col("id").alias("box"), gt.alias("gt"))
    sq = squares(d)
    hit = P.pixels_in_polygons(coarse, grid, P.polygon_rings(square_edges(sq)), 3.7)
    inner = sq.select(
        "poly_id",
        F.floor((F.col("py") + 1.3) / 3.7).alias("pr"),
        F.floor((F.col("px") + 1.3) / 3.7).alias("pc"),
    )
    return Z.zonal_mean(hit, inner, coarse, "wealth")


@query(
    "d31_area_and_centroid",
    cte("edges")
    + """SELECT poly_id, abs(a) / 2 AS area, mx / (3 * a) AS cx, my / (3 * a) AS cy FROM (SELECT poly_id, sum(x1 * y2 - x2 * y1) AS a,
 sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM edges GROUP BY 1)""",
    "area cx cy",
)
def _(d: Data):
    return P.area_and_centroid(d.polygon_edges())


@query(
    "d31_square_centroids",
    cte(sq=_SQ) + "SELECT poly_id, side * side AS area, px + side / 2 AS cx, py + side / 2 AS cy FROM sq",
    "area cx cy",
)
def _(d: Data):
    return P.area_and_centroid(square_edges(squares(d)))


@query(
    "c12_municipalities_in_box",
    cte(
        sq=_SQ,
        sh="SELECT poly_id, greatest(0, least(px + side, 12.0) - greatest(px, 3.0)) * greatest(0, least(py + side, 11.0) - greatest(py, 4.0)) / (side * side) AS share FROM sq WHERE px <= 12 AND px + side >= 3 AND py <= 11 AND py + side >= 4",
    )
    + "SELECT poly_id, share FROM sh WHERE share >= 0.05 OR poly_id = 7",
    "share",
)
def _(d: Data):
    return P.municipalities_in_box(P.polygon_rings(square_edges(squares(d))), (3.0, 4.0, 12.0, 11.0), 0.05, 7)


_LAT = """SELECT municipality, x0 / 16 AS px, y0 / 16 AS py FROM tokens"""


@query(
    "c13_dissolve",
    cte(
        "tokens",
        e="""SELECT municipality, px AS ax, py AS ay, px + 1 AS qx, py AS qy FROM (SELECT municipality, (x0 // 16)::DOUBLE AS px, (y0 // 16)::DOUBLE AS py FROM tokens)
             UNION ALL SELECT municipality, px + 1, py, px + 1, py + 1 FROM (SELECT municipality, (x0 // 16)::DOUBLE AS px, (y0 // 16)::DOUBLE AS py FROM tokens)
             UNION ALL SELECT municipality, px, py + 1, px + 1, py + 1 FROM (SELECT municipality, (x0 // 16)::DOUBLE AS px, (y0 // 16)::DOUBLE AS py FROM tokens)
             UNION ALL SELECT municipality, px, py, px, py + 1 FROM (SELECT municipality, (x0 // 16)::DOUBLE AS px, (y0 // 16)::DOUBLE AS py FROM tokens)""",
    )
    + "SELECT municipality, ax AS x1, ay AS y1, qx AS x2, qy AS y2 FROM e GROUP BY ALL HAVING count(*) % 2 = 1",
)
def _(d: Data):
    sq = d.tokens().select(
        "municipality",
        F.expr("x0 div 16").cast("double").alias("px"),
        F.expr("y0 div 16").cast("double").alias("py"),
        F.lit(1.0).alias("side"),
    )
    return P.dissolve(square_edges(sq), "municipality")


# tracts as small squares scattered along a line, so gaps decide the masses
def _line(d: Data):
    k = F.col("c_custkey")
    return d.table("customer").select(
        k.alias("poly_id"),
        (F.col("c_nationkey") % 5 == 0).alias("core"),
        (k * 7919 % 100003 / 10.0).alias("px"),
        F.lit(0.0).alias("py"),
        F.lit(1.0).alias("side"),
    )


_LINE = "SELECT c_custkey AS poly_id, c_nationkey % 5 = 0 AS core, (c_custkey * 7919 % 100003)::DOUBLE / 10.0 AS px FROM customer"


@query(
    "c11_urban_mass",
    f"""WITH l AS ({_LINE}), o AS (SELECT *, lag(px) OVER (ORDER BY px) AS before FROM l),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR px - before - 1 > 24 THEN 1 ELSE 0 END) OVER (ORDER BY px) AS grp FROM o),
 k AS (SELECT grp, min(poly_id) AS component, sum(CASE WHEN core THEN 1 ELSE 0 END) AS cores FROM g GROUP BY 1),
 b AS (SELECT grp, component FROM k ORDER BY cores DESC, component LIMIT 1)
 SELECT poly_id, component FROM g JOIN b USING (grp)""",
)
def _(d: Data):
    line = _line(d)
    ring = P.polygon_rings(square_edges(line), ["poly_id"]).join(line.select("poly_id", "core"), "poly_id")
    return P.urban_mass(ring, F.col("core"), 12.0)


@query(
    "c11_near_core",
    f"""WITH l AS ({_LINE}) SELECT poly_id FROM l WHERE core OR EXISTS (SELECT 1 FROM l k WHERE k.core AND abs(k.px - l.px) - 1 <= 6)""",
)
def _(d: Data):
    line = _line(d)
    ring = P.polygon_rings(square_edges(line), ["poly_id"]).join(line.select("poly_id", "core"), "poly_id")
    return P.near_core(ring, F.col("core"), 6.0).select("poly_id")


_STRATA = "SELECT poly_id, CAST(substr(poly_id, 3, 3) AS INTEGER) % 8 AS stratum FROM (SELECT DISTINCT poly_id FROM edges)"


@query(
    "c17_stratum_truth",
    cte(
        "edges",
        "points",
        st=_STRATA,
        dist=f"SELECT * FROM ({_DIST}) WHERE poly_id IN (SELECT poly_id FROM st WHERE stratum BETWEEN 1 AND 6)",
        nr=_NEAR,
    )
    + "SELECT point_id, -CAST(stratum AS DOUBLE) AS truth, poly_id AS unit FROM nr JOIN st USING (poly_id)",
)
def _(d: Data):
    blocks = rings(d).withColumn("stratum", F.substring("poly_id", 3, 3).cast("int") % 8)
    return P.stratum_truth(d.points(), blocks, ["point_id"], 0.75, CELL)


_INC = "SELECT municipality AS poly_id, avg(c_acctbal) AS income FROM customer JOIN places ON c_nationkey = nationkey GROUP BY 1"


def _income(d: Data):
    inc = d.table("customer").join(
        F.broadcast(d.places()), F.col("c_nationkey") == F.col("nationkey")
    ).groupBy(F.col("municipality").alias("poly_id")).agg(F.avg("c_acctbal").alias("income"))
    return rings(d).join(inc, "poly_id", "left")


@query(
    "c17_income_truth",
    cte("edges", "points", hit=_HIT, inc=_INC, loc="SELECT point_id, min(poly_id) AS poly_id FROM hit GROUP BY 1")
    + "SELECT point_id, -ln(income) AS truth, poly_id AS unit FROM loc JOIN inc USING (poly_id)",
    "truth",
)
def _(d: Data):
    return P.income_truth(d.points(), _income(d), ["point_id"], CELL)


@query(
    "c18_transfer_bags",
    cte(
        "edges",
        "points",
        hit=_HIT,
        inc=_INC,
        loc="SELECT point_id, min(poly_id) AS municipality FROM hit GROUP BY 1",
        lab="SELECT municipality, avg(n_regionkey) AS label FROM places JOIN nation ON nationkey = n_nationkey WHERE n_regionkey > 0 GROUP BY 1",
        tr="SELECT point_id, -ln(income) AS truth, municipality AS unit FROM loc JOIN inc ON municipality = poly_id JOIN points USING (point_id) WHERE x > 8.0",
    )
    + """SELECT point_id, municipality, label, truth, unit FROM points JOIN loc USING (point_id) LEFT JOIN lab USING (municipality) LEFT JOIN tr USING (point_id)
 WHERE greatest(value, 0) / 10000.0 >= 0.1""",
    "label truth",
)
def _(d: Data):
    tokens = d.points().withColumn("built", F.greatest("value", F.lit(0.0)) / 10000.0)
    labels = (
        d.places()
        .join(d.table("nation").where("n_regionkey > 0"), F.col("nationkey") == F.col("n_nationkey"))
        .groupBy("municipality")
        .agg(F.avg("n_regionkey").alias("label"))
    )
    truth = P.income_truth(d.points().where("x > 8.0"), _income(d), ["point_id"], CELL)
    return P.transfer_bags(tokens, rings(d), labels, truth, ["point_id"], CELL).select(
        "point_id", "municipality", "label", "truth", "unit"
    )


@query(
    "b17_seat_zones",
    """SELECT municipality, zone_id, area FROM (SELECT p_brand AS municipality, p_partkey AS zone_id, p_retailprice AS area,
 row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part WHERE p_size % 3 = 1) WHERE rn = 1 AND area >= 950""",
)
def _(d: Data):
    zones = d.table("part").select(
        F.col("p_brand").alias("municipality"),
        F.col("p_partkey").alias("zone_id"),
        F.col("p_retailprice").alias("area"),
        (F.col("p_size") % 3).cast("string").alias("zone_class"),
    )
    return P.seat_zones(zones, 950.0).select("municipality", "zone_id", "area")


@query(
    "b17_seat_tracts",
    """WITH t AS (SELECT c_custkey AS sector, 'm' || CAST(c_nationkey AS VARCHAR) AS municipality, 'm' || CAST(c_custkey % 40 AS VARCHAR) AS district FROM customer WHERE c_mktsegment <> 'BUILDING')
 SELECT sector, municipality, district FROM t WHERE district = municipality OR municipality NOT IN (SELECT municipality FROM t WHERE district = municipality)""",
)
def _(d: Data):
    t = d.table("customer").select(
        F.col("c_custkey").alias("sector"),
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("municipality"),
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("name"),
        F.concat(F.lit("m"), (F.col("c_custkey") % 40).cast("string")).alias("district"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Rural").otherwise("Urbana").alias("situation"),
    )
    return P.seat_tracts(t).select("sector", "municipality", "district")
