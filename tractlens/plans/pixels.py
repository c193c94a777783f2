"""Queries on scenes, composites, mosaics and pixel statistics over tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.functions import expr as X
from tractlens.operators import composite as K
from tractlens.operators import scale
from tractlens.operators import zonal as Z
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query

# scenes of the pixel table: one per box and line number
_SC = """SELECT l_suppkey % 4 AS box, l_linenumber AS scene_id, 'T' || CAST(l_linenumber % 2 AS VARCHAR) AS tile,
 'EPSG:' || CAST(32614 + l_linenumber % 3 AS VARCHAR) AS zone, CASE WHEN l_linenumber % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state,
 l_linenumber % 3 AS orbit, round(avg(l_discount) * 1000, 6) AS cloud FROM lineitem GROUP BY 1, 2"""
_GR = "SELECT DISTINCT box, 16 AS h, 16 AS w FROM pixels"


def scenes(d: Data):
    return (
        d.table("lineitem")
        .groupBy((F.col("l_suppkey") % 4).alias("box"), F.col("l_linenumber").alias("scene_id"))
        .agg(F.round(F.avg("l_discount") * 1000, 6).alias("cloud"))
        .select(
            "box",
            "scene_id",
            F.concat(F.lit("T"), (F.col("scene_id") % 2).cast("string")).alias("tile"),
            F.concat(F.lit("EPSG:"), (F.col("scene_id") % 3 + 32614).cast("string")).alias("zone"),
            F.when(F.col("scene_id") % 2 == 0, "ascending").otherwise("descending").alias("orbit_state"),
            (F.col("scene_id") % 3).alias("orbit"),
            "cloud",
        )
    )


def grids(d: Data):
    return d.pixels().select("box").distinct().withColumn("h", F.lit(16)).withColumn("w", F.lit(16))


_TILE = dict(
    sc=_SC,
    gr=_GR,
    pr="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box, tile ORDER BY cloud, scene_id) AS rn FROM sc) WHERE rn <= 2",
    cov="""SELECT box, tile, max(k) AS coverage FROM (SELECT box, tile, scene_id, count(DISTINCT CASE WHEN scl > 0 THEN r * 1000 + c END) / 256.0::DOUBLE AS k
           FROM pr JOIN pixels USING (box, scene_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    useful="SELECT sc.* FROM sc JOIN cov USING (box, tile) WHERE coverage >= 0.02",
    sel="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box, tile ORDER BY cloud, scene_id) AS rn FROM useful) WHERE rn <= 36",
    used="""SELECT box, scene_id FROM sel JOIN pixels USING (box, scene_id) GROUP BY 1, 2
            HAVING count(DISTINCT CASE WHEN scl IN (4, 5, 6, 7) THEN r * 1000 + c END) / 256.0::DOUBLE >= 0.05""",
    comp="""SELECT box, band, r, c, median(CASE WHEN scl IN (4, 5, 6, 7) THEN value END) AS value,
            count(CASE WHEN scl IN (4, 5, 6, 7) THEN value END) AS depth FROM pixels JOIN used USING (box, scene_id) GROUP BY 1, 2, 3, 4""",
)


@query("d1_optical_composite", cte("pixels", **_TILE) + "SELECT * FROM comp", "value", 4)
def _(d: Data):
    return K.optical_composite(scenes(d), d.pixels(), grids(d))


_DEPTH = """SELECT box, CAST(floor(median(depth)) AS BIGINT) AS median_depth, CAST(floor(quantile_cont(depth, 0.05)) AS BIGINT) AS minimum_depth
 FROM comp WHERE band = 'A' GROUP BY 1"""


@query(
    "d1_composite_meta",
    cte("pixels", **_TILE, dep=_DEPTH)
    + """SELECT box, scenes_selected, tiles, scenes_used, median_depth, minimum_depth FROM
 (SELECT box, count(*) AS scenes_selected, count(DISTINCT tile) AS tiles FROM sel GROUP BY 1) JOIN
 (SELECT box, count(*) AS scenes_used FROM used GROUP BY 1) USING (box) JOIN dep USING (box)""",
)
def _(d: Data):
    return K.composite_meta(scenes(d), d.pixels(), grids(d), "A")


@query("d3_useful_tiles", cte("pixels", **_TILE) + "SELECT box, tile, scene_id, cloud FROM useful", "cloud")
def _(d: Data):
    return K.useful_tiles(scenes(d), K.optical_coverage(d.pixels(), grids(d))).select("box", "tile", "scene_id", "cloud")


_ORB = dict(
    sc=_SC,
    px="""SELECT box, scene_id, CASE band WHEN 'A' THEN 'vv' WHEN 'N' THEN 'vh' ELSE 'other' END AS band, r, c,
          CASE WHEN scl % 4 <> 1 THEN value END AS value FROM pixels""",
    pr="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box, orbit_state, orbit ORDER BY scene_id) AS rn FROM sc) WHERE rn <= 4",
    see="SELECT box, scene_id, count(DISTINCT CASE WHEN value IS NOT NULL THEN r * 1000 + c END) / 256.0::DOUBLE AS share FROM px WHERE band = 'vv' GROUP BY 1, 2",
    oc="""SELECT box, orbit_state, orbit, n AS scenes, coalesce(cv, 0) AS coverage FROM (SELECT box, orbit_state, orbit, count(*) AS n FROM sc GROUP BY 1, 2, 3)
          JOIN (SELECT box, orbit_state, orbit, avg(share) AS cv FROM pr LEFT JOIN see USING (box, scene_id) GROUP BY 1, 2, 3) USING (box, orbit_state, orbit)""",
    best="""SELECT box, orbit_state, orbit, scenes, coverage FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY round_even(coverage, 2) DESC, scenes DESC, orbit_state, orbit) AS rn FROM oc) WHERE rn = 1""",
)


def _radar(d: Data):
    band = F.when(F.col("band") == "A", "vv").when(F.col("band") == "N", "vh").otherwise("other")
    return d.pixels().select(
        "box", "scene_id", band.alias("band"), "r", "c", F.when(F.col("scl") % 4 != 1, F.col("value")).alias("value")
    )


@query("d3_orbit_coverage", cte("pixels", **_ORB) + "SELECT * FROM oc", "coverage")
def _(d: Data):
    return K.orbit_coverage(scenes(d), _radar(d), grids(d))


@query("d3_best_orbit", cte("pixels", **_ORB) + "SELECT * FROM best", "coverage")
def _(d: Data):
    return K.best_orbit(K.orbit_coverage(scenes(d), _radar(d), grids(d)))


@query(
    "d3_dominant_orbit",
    f"""WITH sc AS ({_SC}), n AS (SELECT box, orbit_state, orbit, count(*) AS scenes FROM sc GROUP BY 1, 2, 3)
 SELECT box, orbit_state, orbit, scenes FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY scenes DESC, orbit_state, orbit) AS rn FROM n) WHERE rn = 1""",
)
def _(d: Data):
    return K.dominant_orbit(scenes(d))


_ZONE = dict(
    sc=_SC,
    pr="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box, zone, tile ORDER BY cloud, scene_id) AS rn FROM sc) WHERE rn <= 2",
    zc="""SELECT box, zone, n AS scenes, coalesce(cv, 0) AS coverage FROM (SELECT box, zone, count(*) AS n FROM sc GROUP BY 1, 2) LEFT JOIN
          (SELECT box, zone, count(DISTINCT r * 1000 + c) / 256.0::DOUBLE AS cv FROM pr JOIN pixels USING (box, scene_id) WHERE scl > 0 GROUP BY 1, 2) USING (box, zone)""",
)


@query(
    "d3_best_zone",
    cte("pixels", **_ZONE)
    + """SELECT box, zone, scenes, coverage FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY round_even(coverage, 2) DESC, scenes DESC, zone) AS rn FROM zc) WHERE rn = 1""",
    "coverage",
)
def _(d: Data):
    return K.best_zone(K.zone_coverage(scenes(d), d.pixels(), grids(d)))


@query(
    "d3_zone_codes",
    """SELECT code, count(*) AS n FROM (SELECT 'EPSG:' || CAST(32600 + user_id % 7 AS VARCHAR) AS code FROM events) GROUP BY 1""",
)
def _(d: Data):
    epsg = F.when(F.col("event_type") == "click", F.col("user_id") % 7 + 32600)
    code = F.concat(F.when(F.col("event_type") == "view", "").otherwise("EPSG:"), (F.col("user_id") % 7 + 32600).cast("string"))
    return d.table("events").groupBy(K.zone_code(epsg, code).alias("code")).agg(F.count("*").alias("n"))


@query(
    "d2_radar_composite",
    cte(
        "pixels",
        **_ORB,
        mine="SELECT sc.* FROM sc JOIN best USING (box, orbit_state, orbit)",
        ch="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY scene_id) AS rn FROM mine) WHERE rn <= 24",
        bo="SELECT px.* FROM px JOIN ch USING (box, scene_id) WHERE band IN ('vv', 'vh')",
        wh="SELECT box, scene_id FROM bo GROUP BY 1, 2 HAVING count(DISTINCT band) = 2",
    )
    + "SELECT box, band, r, c, median(value) AS value, count(value) AS depth FROM bo JOIN wh USING (box, scene_id) GROUP BY 1, 2, 3, 4",
    "value",
    4,
)
def _(d: Data):
    return K.radar_composite(scenes(d), _radar(d), grids(d))


@query(
    "d4_composite_checks",
    cte(
        "pixels",
        **_TILE,
        b="""SELECT box, min(seen / 256.0::DOUBLE) AS observed, max(bad / greatest(seen, 1)::DOUBLE) AS improper FROM
             (SELECT box, band, count(value) AS seen, sum(CASE WHEN value <= 0 THEN 1 ELSE 0 END) AS bad FROM comp GROUP BY 1, 2) GROUP BY 1""",
        f="SELECT box, avg(CASE WHEN cloud > 50.1 THEN 1.0 ELSE 0 END) AS failed FROM sc GROUP BY 1",
        dep=_DEPTH,
        w="SELECT * FROM b JOIN f USING (box) JOIN dep USING (box)",
    )
    + """SELECT box, 'failed reads' AS "check", failed::DOUBLE AS value, 0.3::DOUBLE AS "limit", failed <= 0.3 AS passed FROM w
 UNION ALL SELECT box, 'observed fraction', observed, 0.8, observed >= 0.8 FROM w
 UNION ALL SELECT box, 'non-positive share', improper, 0.0, improper <= 0 FROM w
 UNION ALL SELECT box, 'typical depth', median_depth::DOUBLE, 2.0, median_depth >= 2 FROM w""",
    "value",
)
def _(d: Data):
    comp = K.optical_composite(scenes(d), d.pixels(), grids(d))
    reads = scenes(d).select("box", (F.col("cloud") > 50.1).alias("failed"))
    return K.composite_checks(comp, grids(d), reads, depth_band="A", min_depth=2)


_CL = "SELECT *, value / 5.0::DOUBLE AS cloud FROM events"


@query(
    "d5_cloud_summary",
    f"""WITH s AS ({_CL}), l AS (SELECT event_type AS tile, list(cloud ORDER BY cloud) AS v FROM s GROUP BY 1)
 SELECT event_type AS tile, count(*) AS scenes, round_even(min(cloud), 1) AS minimum, round_even(max(cloud), 1) AS maximum,
 round_even(any_value(v)[count(*) // 2 + 1], 1) AS median, round_even(100.0::DOUBLE * avg(CASE WHEN cloud > 50 THEN 1 ELSE 0 END), 0) AS pct_over_50,
 round_even(100.0::DOUBLE * avg(CASE WHEN cloud > 80 THEN 1 ELSE 0 END), 0) AS pct_over_80 FROM s JOIN l ON event_type = tile GROUP BY 1""",
    "minimum maximum median pct_over_50 pct_over_80",
    1,
)
def _(d: Data):
    return K.cloud_summary(d.scenes(), ["tile"])


@query(
    "f10_clearest_per_tile",
    f"WITH s AS ({_CL}) SELECT event_type AS tile, event_id AS scene_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cloud, event_id) AS rn FROM s) WHERE rn <= 20",
)
def _(d: Data):
    return K.clearest(d.scenes(), ["tile"], 20).select("tile", "scene_id", "place")


@query(
    "a4_scene_search",
    cte("scenes")
    + """SELECT scene_id, tile FROM scenes WHERE xmin <= 8 AND xmax >= 5 AND ymin <= 9.5 AND ymax >= 6.5
 AND acquired >= TIMESTAMP '2024-01-05' AND acquired < TIMESTAMP '2024-01-21'""",
)
def _(d: Data):
    found = K.search(d.scenes(), "optical", (5.0, 6.5, 8.0, 9.5), "2024-01-05", "2024-01-20")
    return found.select("scene_id", "tile")


# ---- pixel expressions --------------------------------------------------------------------

_FLAT = "SELECT box, band, r, c, avg(value) / 9973.0 AS value FROM pixels GROUP BY 1, 2, 3, 4"


def _flat(d: Data):
    return d.pixels().groupBy("box", "band", "r", "c").agg((F.avg("value") / 9973.0).alias("value"))


def _bands(d: Data):
    def one(b):
        return F.max(F.when(F.col("band") == b, F.col("value")))

    return _flat(d).groupBy("box", "r", "c").agg(
        one("A").alias("B04"), one("N").alias("B08"), one("R").alias("B11")
    )


_WIDE = """SELECT box, r, c, max(CASE WHEN band = 'A' THEN value END) AS B04, max(CASE WHEN band = 'N' THEN value END) AS B08,
 max(CASE WHEN band = 'R' THEN value END) AS B11 FROM fl GROUP BY 1, 2, 3"""


@query(
    "b1_spectral_indices",
    cte("pixels", fl=_FLAT, wd=_WIDE)
    + """SELECT box, r, c, CASE WHEN abs(B08 + B04) > 1e-6 THEN (B08 - B04) / (B08 + B04) END AS ndvi,
 CASE WHEN abs(B11 + B08) > 1e-6 THEN (B11 - B08) / (B11 + B08) END AS ndbi FROM wd""",
    "ndvi ndbi",
)
def _(d: Data):
    b = _bands(d)
    return b.select(
        "box",
        "r",
        "c",
        X.normalised_difference(F.col("B08"), F.col("B04")).alias("ndvi"),
        X.normalised_difference(F.col("B11"), F.col("B08")).alias("ndbi"),
    )


@query(
    "b2_decibels",
    cte("pixels", fl=_FLAT, wd=_WIDE)
    + """SELECT box, r, c, CASE WHEN B04 - 4 > 0 THEN 10 * log10(B04 - 4) END AS vv, CASE WHEN B08 - 4 > 0 THEN 10 * log10(B08 - 4) END AS vh,
 CASE WHEN B04 - 4 > 0 THEN 10 * log10(B04 - 4) END - CASE WHEN B08 - 4 > 0 THEN 10 * log10(B08 - 4) END AS ratio FROM wd""",
    "vv vh ratio",
)
def _(d: Data):
    b = _bands(d).select("box", "r", "c", X.to_db(F.col("B04") - 4).alias("vv"), X.to_db(F.col("B08") - 4).alias("vh"))
    return b.withColumn("ratio", F.col("vv") - F.col("vh"))


@query(
    "b3_class_mask",
    cte("pixels")
    + "SELECT box, scene_id, band, r, c, CASE WHEN scl IN (4, 5, 6, 7) THEN value END AS value FROM pixels",
)
def _(d: Data):
    return d.pixels().select("box", "scene_id", "band", "r", "c", X.masked(F.col("value"), F.col("scl")).alias("value"))


_RANGE = "SELECT box, band, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM fl GROUP BY 1, 2"


def ranges(d: Data, policy: str):
    """Quantisation range per box and band under a scale policy."""
    from tractlens.operators.texture import channel_ranges

    fixed = {"A": (1.0, 8.0), "N": (0.5, 9.0)}
    native = {"A": (1.0, 8.0)}
    return channel_ranges(_flat(d), policy, fixed, native)


@query("b5_robust_range", cte("pixels", fl=_FLAT) + _RANGE, "low high")
def _(d: Data):
    return ranges(d, "percentiles")


@query(
    "b5_range_policies",
    cte("pixels", fl=_FLAT, rg=_RANGE)
    + """SELECT 'native' AS policy, box, band, CASE band WHEN 'A' THEN 1.0 ELSE low END AS low, CASE band WHEN 'A' THEN 8.0 ELSE high END AS high FROM rg
 UNION ALL SELECT 'fixed', box, band, CASE band WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE low END, CASE band WHEN 'A' THEN 8.0 WHEN 'N' THEN 9.0 ELSE high END FROM rg
 UNION ALL SELECT 'percentiles', box, band, low, high FROM rg""",
    "low high",
)
def _(d: Data):
    parts = [ranges(d, p).withColumn("policy", F.lit(p)) for p in ("native", "fixed", "percentiles")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "b4_quantise",
    cte("pixels", fl=_FLAT, rg=_RANGE)
    + """SELECT box, band, r, c, CAST(CASE WHEN value IS NULL THEN 0 ELSE 1 + round_even(greatest(0.0, least(1.0, (value - low) / (high - low))) * 7, 0) END AS INTEGER) AS level
 FROM fl JOIN rg USING (box, band)""",
)
def _(d: Data):
    j = _flat(d).join(ranges(d, "percentiles"), ["box", "band"])
    return j.select("box", "band", "r", "c", X.quantise(F.col("value"), F.col("low"), F.col("high")).alias("level"))


@query(
    "b6_display_stretch",
    cte(
        "pixels",
        fl=_FLAT,
        rg="SELECT box, band, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM fl WHERE value <> 0 GROUP BY 1, 2",
    )
    + """SELECT box, band, r, c, CAST(floor(greatest(0.0, least(255.0, (value - low) / (CASE WHEN high <= low THEN low + 1e-6 ELSE high END - low) * 255))) AS INTEGER) AS shade
 FROM fl JOIN rg USING (box, band)""",
)
def _(d: Data):
    fl = _flat(d)
    rg = scale.exact_percentiles(fl.where("value <> 0"), ["box", "band"], "value", {"low": 0.02, "high": 0.98})
    return fl.join(rg, ["box", "band"], "left").select(
        "box", "band", "r", "c", X.stretch(F.col("value"), F.col("low"), F.col("high")).alias("shade")
    )


@query(
    "b6_legend_percentiles",
    cte("pixels", fl=_FLAT)
    + "SELECT box, band, round_even(quantile_cont(value, 0.05), 1) AS low, round_even(quantile_cont(value, 0.95), 1) AS high FROM fl GROUP BY 1, 2",
    "low high",
    1,
)
def _(d: Data):
    e = scale.exact_percentiles(_flat(d), ["box", "band"], "value", {"low": 0.05, "high": 0.95})
    return e.select("box", "band", F.bround("low", 1).alias("low"), F.bround("high", 1).alias("high"))


@query(
    "b7_normalised_channels",
    cte(
        "pixels",
        fl="SELECT box, band, r, c, avg(CASE WHEN scl <> 3 THEN value END) / 9973.0 AS value FROM pixels GROUP BY 1, 2, 3, 4",
        own="SELECT box, band, min(value) AS mn, max(value) AS mx FROM fl GROUP BY 1, 2",
    )
    + """SELECT box, band, r, c, coalesce(greatest(0.0, least(1.0, (value - CASE band WHEN 'A' THEN 1.0 ELSE mn END) /
 greatest(CASE band WHEN 'A' THEN 8.0 ELSE mx END - CASE band WHEN 'A' THEN 1.0 ELSE mn END, 1e-9))), 0.5) AS value FROM fl JOIN own USING (box, band)""",
    "value",
)
def _(d: Data):
    fl = (
        d.pixels()
        .groupBy("box", "band", "r", "c")
        .agg((F.avg(F.when(F.col("scl") != 3, F.col("value"))) / 9973.0).alias("value"))
    )
    own = fl.groupBy("box", "band").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    known = F.col("band") == "A"
    low = F.when(known, F.lit(1.0)).otherwise(F.col("mn"))
    high = F.when(known, F.lit(8.0)).otherwise(F.col("mx"))
    return fl.join(own, ["box", "band"]).select(
        "box", "band", "r", "c", X.normalise_channel(F.col("value"), low, high).alias("value")
    )


@query(
    "b12_block_degrade",
    cte("pixels", fl=_FLAT)
    + """SELECT box, band, r, c, CASE WHEN r < 14 AND c < 14 THEN avg(CASE WHEN r < 14 AND c < 14 THEN value END) OVER (PARTITION BY box, band, r < 14 AND c < 14, r // 2, c // 2)
 ELSE value END AS value FROM fl""",
    "value",
)
def _(d: Data):
    g = grids(d).select("box", F.lit(15).alias("h"), F.lit(15).alias("w"))
    return K.block_degrade(_flat(d), g)


@query(
    "b14_product_scaling",
    """SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN ln(1 + greatest(p_retailprice - 950, 0)) ELSE p_retailprice - 950 END AS value,
 -p_retailprice AS deprivation FROM part""",
    "value deprivation",
)
def _(d: Data):
    from tractlens.operators.compare import DEPRIVATION_SIGN

    heavy = F.col("p_brand").isin("Brand#1", "Brand#2")
    raw = F.col("p_retailprice") - 950
    return d.table("part").select(
        "p_partkey",
        F.when(heavy, F.log1p(F.greatest(raw, F.lit(0.0)))).otherwise(raw).alias("value"),
        (F.col("p_retailprice") * DEPRIVATION_SIGN["nightlights"]).alias("deprivation"),
    )


# ---- mosaics and tokens -------------------------------------------------------------------


@query(
    "d11_first_valid_mosaic",
    cte("pixels", t="SELECT box, r, c, scene_id, CAST(min(scl) AS BIGINT) AS value FROM pixels GROUP BY 1, 2, 3, 4")
    + "SELECT box, r, c, arg_min(value, scene_id) AS value FROM t WHERE value <> 0 GROUP BY 1, 2, 3",
)
def _(d: Data):
    t = d.pixels().groupBy("box", "r", "c", "scene_id").agg(F.min("scl").alias("value"))
    return K.first_valid_mosaic(t, "scene_id", F.col("value") != 0)


_LC = "SELECT box, r, c, CAST(floor(value) AS BIGINT) % 12 * 10 AS value FROM layer"
_CODES = {10: "tree", 20: "shrub", 30: "grass", 40: "crop", 50: "built", 60: "bare", 70: "snow", 80: "water", 90: "wetland", 95: "mangrove", 100: "moss"}
_FR = ", ".join(f"avg(CASE WHEN value = {k} THEN 1.0 ELSE 0 END) AS wc_{n}" for k, n in _CODES.items())


def cover(d: Data):
    return d.layer().select("box", "r", "c", (F.floor("value") % 12 * 10).alias("value"))


@query(
    "d10_token_class_fractions",
    cte("layer", lc=_LC)
    + f"SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0, count(*) AS wc_n_px, {_FR} FROM lc WHERE value <> 0 GROUP BY 1, 2, 3",
    " ".join(f"wc_{n}" for n in _CODES.values()),
)
def _(d: Data):
    from tractlens.operators.zonal import class_fractions, token_of

    placed = cover(d).select("box", "value", *token_of())
    return class_fractions(placed, ["box", "y0", "x0"])


@query(
    "d10_built_share",
    cte("layer", lc=_LC, tk="SELECT DISTINCT box, r // 8 * 8 * 2 AS y0, c // 16 * 16 AS x0 FROM lc")
    + """SELECT box, y0, x0, coalesce(b, 0) AS built FROM tk LEFT JOIN (SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0,
 avg(CASE WHEN value = 50 THEN 1.0 ELSE 0 END) AS b FROM lc WHERE value <> 0 GROUP BY 1, 2, 3) USING (box, y0, x0)""",
    "built",
)
def _(d: Data):
    lc = cover(d)
    tk = lc.select("box", F.expr("r div 8 * 8 * 2").alias("y0"), F.expr("c div 16 * 16").alias("x0")).distinct()
    return Z.built_share(lc, tk)


@query(
    "d10_classified_share",
    cte("layer", lc=_LC)
    + """SELECT box, sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) / 4096.0::DOUBLE AS classified,
 sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) / 4096.0 >= 0.9 AS usable FROM lc GROUP BY 1""",
    "classified",
)
def _(d: Data):
    lc = cover(d)
    g = lc.select("box").distinct().withColumn("h", F.lit(64)).withColumn("w", F.lit(64))
    return Z.classified_share(lc, g, 0.9)


@query(
    "d13_token_layer_means",
    cte(
        "layer",
        ly="SELECT box, r, c, 'built_surface' AS layer, value - 3 AS value FROM layer UNION ALL SELECT box, r, c, 'nightlights', value FROM layer WHERE r < 32",
        tk="SELECT DISTINCT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0 FROM layer",
    )
    + """SELECT box, y0, x0, coalesce(a, 0) AS built_surface, coalesce(b, 0) AS nightlights FROM tk LEFT JOIN
 (SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0, avg(CASE WHEN layer = 'built_surface' THEN ln(1 + greatest(value, 0)) END) AS a,
  avg(CASE WHEN layer = 'nightlights' THEN value END) AS b FROM ly GROUP BY 1, 2, 3) USING (box, y0, x0)""",
    "built_surface nightlights",
)
def _(d: Data):
    base = d.layer()
    ly = base.select("box", "r", "c", F.lit("built_surface").alias("layer"), (F.col("value") - 3).alias("value")).unionByName(
        base.where("r < 32").withColumn("layer", F.lit("nightlights"))
    )
    tk = base.select("box", *Z.token_of()).distinct()
    return Z.token_layer_means(ly, tk, ["built_surface", "nightlights"])


@query(
    "d14_first_order_features",
    cte("layer")
    + """SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.1) AS p10,
 quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM layer GROUP BY 1, 2, 3""",
    "mean std p10 p50 p90 iqr",
)
def _(d: Data):
    return Z.first_order(d.layer().select("box", "value", *Z.token_of()), ["box", "y0", "x0"])


@query(
    "d32_painted_tokens",
    cte(
        "layer",
        t="SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0, avg(value) AS score FROM layer WHERE r < 40 GROUP BY 1, 2, 3",
    )
    + "SELECT l.box, r, c, score FROM layer l LEFT JOIN t ON l.box = t.box AND r // 16 * 16 = y0 AND c // 16 * 16 = x0",
    "score",
)
def _(d: Data):
    base = d.layer()
    t = base.where("r < 40").groupBy("box", *Z.token_of()).agg(F.avg("value").alias("score"))
    return Z.paint_tokens(base, t)


@query(
    "d28_grade_distribution",
    cte("tract_scores")
    + """SELECT city, ordinal, count(*) AS n, min(score) AS low, max(score) AS high, quantile_cont(score, 0.25) AS q1, median(score) AS median,
 quantile_cont(score, 0.75) AS q3 FROM tract_scores GROUP BY 1, 2""",
    "low high q1 median q3",
    7,
)
def _(d: Data):
    return Z.grade_distribution(d.tract_scores())
