"""Queries on texture, reliability and feature diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import spatial as P
from tractlens.operators import texture as X
from tractlens.operators import zonal as Z
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query
from tractlens.plans.spatial import _CROSS, assigned, grids, rings

MIN = 60
# grey levels 1..8 of the dense layer; one value in eight is missing
_PX = f"""SELECT box, poly_id, r, c, x, value, CAST(floor(value) AS INTEGER) % 9 AS level, mid FROM (SELECT *, 0.4 * (c + 0.5) + 0.013 AS x, 25.513 - 0.4 * (r + 0.5) AS y FROM layer), edges
 JOIN (SELECT poly_id, (min(least(x1, x2)) + max(greatest(x1, x2))) / 2 AS mid FROM edges GROUP BY 1) USING (poly_id)
 GROUP BY box, r, c, value, poly_id, x, y, mid HAVING sum(CASE WHEN {_CROSS} THEN 1 ELSE 0 END) % 2 = 1"""
_OFF = """SELECT * FROM (VALUES (1, 0, 0, 1), (1, 45, 1, 1), (1, 90, 1, 0), (1, 135, 1, -1), (2, 0, 0, 2), (2, 45, 1, 1), (2, 90, 2, 0), (2, 135, 1, -1),
 (4, 0, 0, 4), (4, 45, 3, 3), (4, 90, 4, 0), (4, 135, 3, -3)) AS o(d, angle, dr, dc)"""


def _glcm(keys: str, source: str) -> dict:
    """Texture by self-join over the twelve offsets."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return dict(
        off=_OFF,
        big=f"SELECT * FROM ({source}) QUALIFY count(*) OVER (PARTITION BY {keys}) >= {MIN}",
        pr=f"SELECT {ak}, d, angle, a.level AS i, b.level AS j FROM big a, off JOIN big b ON {on} AND b.r = a.r + dr AND b.c = a.c + dc",
        sy=f"SELECT {keys}, d, angle, i, j FROM pr UNION ALL SELECT {keys}, d, angle, j, i FROM pr",
        ct=f"SELECT {keys}, d, angle, i, j, count(*)::DOUBLE AS n FROM sy GROUP BY ALL",
        nm=f"SELECT *, n / sum(n) OVER (PARTITION BY {keys}, d, angle) AS p FROM ct",
        mu=f"SELECT *, sum(p * i) OVER (PARTITION BY {keys}, d, angle) AS m FROM nm",
        an=f"""SELECT {keys}, d, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity,
          sqrt(sum(p * p)) AS energy, CASE WHEN sum(p * (i - m) * (i - m)) < 1e-12 THEN 1 ELSE sum(p * (i - m) * (j - m)) / sum(p * (i - m) * (i - m)) END AS correlation,
          -sum(p * log2(p)) AS entropy FROM mu GROUP BY {keys}, d, angle""",
        tx=f"""SELECT {keys}, d, sum(contrast) / 4 AS contrast, sum(dissimilarity) / 4 AS dissimilarity, sum(homogeneity) / 4 AS homogeneity, sum(energy) / 4 AS energy,
          (sum(correlation) + 4 - count(*)) / 4 AS correlation, sum(entropy) / 4 AS entropy,
          sqrt(greatest(sum(contrast * contrast) / 4 - pow(sum(contrast) / 4, 2), 0)) AS anisotropy FROM an GROUP BY {keys}, d""",
    )


_SEEN = "SELECT * FROM px WHERE level > 0"
_TX = "contrast dissimilarity homogeneity energy correlation entropy anisotropy"


def grey(d: Data):
    return assigned(d).withColumn("level", F.floor("value").cast("int") % 9)


@query("d15_cooccurrence_texture", cte("edges", "layer", px=_PX, **_glcm("box, poly_id", _SEEN)) + "SELECT * FROM tx", _TX)
def _(d: Data):
    g = grey(d).where("level > 0")
    from tractlens.operators.scale import with_stats

    big = with_stats(g, ["box", "poly_id"], F.count("*").alias("n")).where(F.col("n") >= MIN)
    return X.texture(big, ["box", "poly_id"])


_UNP = " UNION ALL ".join(f"SELECT {{k}}, '{f}_d' || CAST(d AS VARCHAR) AS feature, {f} AS value FROM tx" for f in X.FAMILIES)
_FO = {
    "mean": "avg(value)",
    "std": "stddev_pop(value)",
    "p10": "quantile_cont(value, 0.1)",
    "p50": "quantile_cont(value, 0.5)",
    "p90": "quantile_cont(value, 0.9)",
    "iqr": "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)",
}
_FOU = " UNION ALL ".join(f"SELECT {{k}}, '{n}' AS feature, {e} AS value FROM big GROUP BY {{k}}" for n, e in _FO.items())


def _features(keys: str) -> str:
    return f"{_UNP.format(k=keys)} UNION ALL {_FOU.format(k=keys)} UNION ALL SELECT {keys}, 'n_px', count(*)::DOUBLE FROM px WHERE level > 0 GROUP BY {keys}"


@query(
    "c20_polygon_features",
    cte("edges", "layer", px=_PX, **_glcm("box, poly_id", _SEEN)) + _features("box, poly_id"),
    "value",
)
def _(d: Data):
    return X.polygon_features(grey(d), ["box", "poly_id"], MIN)


@query(
    "c20_feature_table",
    cte("edges", "layer", "tracts", px=_PX, **_glcm("box, poly_id", _SEEN), ft=_features("box, poly_id"))
    + """SELECT box, poly_id, a.s2red_contrast_d1, a.s2red_energy_d4, a.s2red_p50, a.s2red_n_px, wc_built, tracts, area FROM
 (SELECT box, poly_id, max(CASE WHEN feature = 'contrast_d1' THEN value END) AS s2red_contrast_d1, max(CASE WHEN feature = 'energy_d4' THEN value END) AS s2red_energy_d4,
  max(CASE WHEN feature = 'p50' THEN value END) AS s2red_p50, max(CASE WHEN feature = 'n_px' THEN value END) AS s2red_n_px FROM ft GROUP BY 1, 2) a
 LEFT JOIN (SELECT box, poly_id, avg(CASE WHEN floor(value) % 12 = 5 THEN 1.0 ELSE 0 END) AS wc_built FROM px WHERE floor(value) % 12 <> 0 GROUP BY 1, 2) USING (box, poly_id)
 LEFT JOIN (SELECT municipality AS poly_id, count(*) AS tracts FROM tracts GROUP BY 1) USING (poly_id)
 LEFT JOIN (SELECT poly_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY 1) USING (poly_id)""",
    "s2red_contrast_d1 s2red_energy_d4 s2red_p50 s2red_n_px wc_built area",
)
def _(d: Data):
    keys = ["box", "poly_id"]
    px = grey(d)
    f = X.polygon_features(px, keys, MIN).withColumn("channel", F.lit("s2red"))
    wide = X.feature_table(f, keys, ["s2red"])
    cover = Z.class_fractions(px.withColumn("value", F.floor("value") % 12 * 10), keys, {50: "built"})
    labels = d.tracts().groupBy(F.col("municipality").alias("poly_id")).agg(F.count("*").alias("tracts"))
    areas = P.area_and_centroid(d.polygon_edges()).select("poly_id", "area")
    return X.assemble_features(wide, cover, labels, areas, keys).select(
        "box", "poly_id", "s2red_contrast_d1", "s2red_energy_d4", "s2red_p50", "s2red_n_px", "wc_built", "tracts", "area"
    )


_HALF = "SELECT *, CAST(x >= mid AS INTEGER) AS half FROM px WHERE level > 0"
MIN_HALF = 20


def _halves(keys: str) -> dict:
    parts = _glcm(keys, _HALF)
    parts["big"] = parts["big"].replace(f">= {MIN}", f">= {MIN_HALF}")
    return parts


_REL = """SELECT box, feature, count(*) AS n, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS r FROM
 (SELECT box, poly_id, feature, max(CASE WHEN half = 0 THEN value END) AS a, max(CASE WHEN half = 1 THEN value END) AS b FROM ft GROUP BY 1, 2, 3)
 WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2"""
_HF = f"{_UNP.format(k='box, poly_id, half')} UNION ALL {_FOU.format(k='box, poly_id, half')}"


def _reliability(d: Data):
    return X.split_half_reliability(grey(d), ["box", "poly_id"], ["box"], MIN_HALF)


@query(
    "d16_split_half_reliability",
    cte("edges", "layer", px=_PX, **_halves("box, poly_id, half"), ft=_HF) + _REL,
    "r",
    5,
)
def _(d: Data):
    return _reliability(d)


@query(
    "d16_reliability_summary",
    cte("edges", "layer", px=_PX, **_halves("box, poly_id, half"), ft=_HF, rel=_REL)
    + "SELECT feature, min(r) AS r_min, count(*) AS cities, median(r) AS r_median FROM rel GROUP BY 1",
    "r_min r_median",
    5,
)
def _(d: Data):
    return X.reliability_summary(_reliability(d))


_SZ = """SELECT feature, count(*) AS n, CASE WHEN count(*) >= 3 AND min(value) < max(value) AND min(s) < max(s) THEN corr(value, s) END AS r_n_px FROM
 (SELECT f.feature, f.value, {s} AS s FROM ft f JOIN (SELECT box, poly_id, value AS px FROM ft WHERE feature = 'n_px') USING (box, poly_id) WHERE f.feature <> 'n_px')
 WHERE value IS NOT NULL GROUP BY 1"""


@query(
    "d17_size_correlation",
    cte("edges", "layer", px=_PX, **_glcm("box, poly_id", _SEEN), ft=_features("box, poly_id")) + _SZ.format(s="px"),
    "r_n_px",
    5,
)
def _(d: Data):
    return X.size_correlation(X.polygon_features(grey(d), ["box", "poly_id"], MIN), ["box", "poly_id"])


@query(
    "d17_feature_selection",
    cte(
        "edges",
        "layer",
        px=_PX,
        **_glcm("box, poly_id", _SEEN),
        ft=_features("box, poly_id"),
        sz=_SZ.format(s="log10(greatest(px, 1))"),
        rl="SELECT feature, abs(r_n_px) + CASE WHEN feature LIKE '%_d1' THEN 0.5 ELSE 0.3 END AS r_median FROM sz",
    )
    + """SELECT feature, r_median AS r_halves, r_n_px, coalesce(r_median >= 0.6, false) AND coalesce(abs(r_n_px) <= 0.3, false) AS kept,
 CASE WHEN NOT coalesce(r_median >= 0.6, false) THEN 'does not reproduce' WHEN NOT coalesce(abs(r_n_px) <= 0.3, false) THEN 'tied to size' ELSE 'kept' END AS reason
 FROM sz JOIN rl USING (feature)""",
    "r_halves r_n_px",
    5,
)
def _(d: Data):
    sizes = X.size_correlation(
        X.polygon_features(grey(d), ["box", "poly_id"], MIN), ["box", "poly_id"], log=True
    )
    rel = sizes.select(
        "feature",
        (F.abs("r_n_px") + F.when(F.col("feature").endswith("_d1"), 0.5).otherwise(0.3)).alias("r_median"),
    )
    return X.select_features(sizes, rel)


_LONG = """SELECT 'red_mean' AS feature, city, ordinal, score AS value FROM tract_scores UNION ALL SELECT 'red_std', city, ordinal, population FROM tract_scores
 UNION ALL SELECT 'red_contrast_d1', city, ordinal, score * (ordinal + 1) FROM tract_scores UNION ALL SELECT 'flat_mean', city, ordinal, 1.0 FROM tract_scores"""


def _ev(factor: str, name: str) -> str:
    return f"""SELECT feature, CASE WHEN count(*) >= 2 AND min(value) < max(value) THEN sum((m - g) * (m - g)) / sum((value - g) * (value - g)) END AS {name} FROM
 (SELECT *, avg(value) OVER (PARTITION BY feature, {factor}) AS m, avg(value) OVER (PARTITION BY feature) AS g FROM lg) GROUP BY 1"""


_DIAG = f"""SELECT feature, per_city, per_grade, CASE WHEN per_grade > 0 THEN per_city / per_grade END AS ratio FROM ({_ev("city", "per_city")}) JOIN ({_ev("ordinal", "per_grade")}) USING (feature)"""


def _diag(d: Data):
    t = d.tract_scores()
    values = {
        "red_mean": F.col("score"),
        "red_std": F.col("population"),
        "red_contrast_d1": F.col("score") * (F.col("ordinal") + 1),
        "flat_mean": F.lit(1.0),
    }
    long = t.select(
        "city",
        "ordinal",
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in values.items()])).alias("f"),
    ).select("city", "ordinal", "f.*")
    return X.transfer_diagnostics(long, "city", "ordinal")


@query("d18_transfer_diagnostics", cte("tract_scores", lg=_LONG) + _DIAG, "per_city per_grade ratio")
def _(d: Data):
    return _diag(d)


@query(
    "d18_ratio_quartiles",
    cte("tract_scores", lg=_LONG, dg=_DIAG)
    + """SELECT CASE WHEN feature LIKE '%_d1' THEN 'texture' ELSE 'intensity' END AS feature_set, quantile_cont(ratio, 0.25) AS q1, median(ratio) AS median,
 quantile_cont(ratio, 0.75) AS q3 FROM dg GROUP BY 1""",
    "q1 median q3",
)
def _(d: Data):
    return X.ratio_quartiles(_diag(d), F.when(F.col("feature").endswith("_d1"), "texture").otherwise("intensity"))
