"""Queries on keys, shares, boxes, grids and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.functions import expr as X
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query

_ACC = f"lower(translate(name, '{X.ACCENTED}', '{X.PLAIN}'))"


@query(
    "b8_slug_keys",
    f"""WITH n AS (SELECT doc_id, text AS name FROM documents), s AS (SELECT doc_id, regexp_replace({_ACC}, '[^a-z0-9]', '', 'g') AS slug FROM n)
 SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN slug || CAST(doc_id AS VARCHAR) ELSE slug END AS key FROM s""",
)
def _(d: Data):
    from tractlens.operators.scale import with_stats

    named = d.table("documents").select("doc_id", X.slug(F.col("text")).alias("slug"))
    counted = with_stats(named, ["slug"], F.count("*").alias("n"))
    return counted.select(
        "doc_id", F.when(F.col("n") > 1, F.concat("slug", F.col("doc_id").cast("string"))).otherwise(F.col("slug")).alias("key")
    )


_PT = "SELECT c_nationkey AS key, (c_custkey * 37 % 2503)::DOUBLE / 2000.0 - 99 AS x, (c_custkey * 91 % 2507)::DOUBLE / 2000.0 + 19 AS y FROM customer"
_BOX = f"""SELECT key, xmin - dx AS xmin, ymin - dy AS ymin, xmax + dx AS xmax, ymax + dy AS ymax FROM (SELECT *, 200.0 / 111320.0 AS dy,
 200.0 / 111320.0 / greatest(cos(radians((ymin + ymax) / 2)), 1e-6) AS dx FROM (SELECT key, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM ({_PT}) GROUP BY 1))"""
_SHAPE = """CAST(floor((ymax - ymin) * 111320.0 / 10) AS BIGINT) AS h, CAST(floor((xmax - xmin) * 111320.0 * cos(radians((ymin + ymax) / 2)) / 10) AS BIGINT) AS w"""


def _boxes(d: Data):
    k = F.col("c_custkey")
    pts = d.table("customer").select(
        F.col("c_nationkey").alias("key"),
        (k * 37 % 2503 / 2000.0 - 99).alias("x"),
        (k * 91 % 2507 / 2000.0 + 19).alias("y"),
    )
    return X.boxes_of(pts, "key", 200.0)


@query("b9_boxes_with_margin", f"SELECT *, {_SHAPE} FROM ({_BOX})", "xmin ymin xmax ymax")
def _(d: Data):
    return X.with_shape(X.checked_box(_boxes(d)))


@query(
    "b9_boxes_grown",
    f"""SELECT key, xmin, ymin - greatest(13000 - h, 0) * 10.0 / 111320.0 AS ymin, xmax + greatest(13000 - w, 0) * 10.0 / 111320.0 / greatest(cos(radians((ymin + ymax) / 2)), 1e-6) AS xmax, ymax
 FROM (SELECT *, {_SHAPE} FROM ({_BOX}))""",
    "xmin ymin xmax ymax",
)
def _(d: Data):
    return X.at_least(_boxes(d), 13000)


@query(
    "b9_too_wide",
    f"SELECT key, greatest((xmax - xmin) * 111.32 * cos(radians((ymin + ymax) / 2)), (ymax - ymin) * 111.32) > 137 AS wide FROM ({_BOX})",
)
def _(d: Data):
    return _boxes(d).select("key", X.too_wide(137.0).alias("wide"))


_GRID = """SELECT s_suppkey AS box, 400000.0 + s_suppkey * 7 AS xmin, 1900000.0 + s_acctbal AS ymin, 400000.0 + s_suppkey * 9 + 3000.5 AS xmax, 1900000.0 + s_acctbal + 2500.25 AS ymax FROM supplier"""


def _proj(d: Data):
    k = F.col("s_suppkey")
    return d.table("supplier").select(
        k.alias("box"),
        (k * 7 + 400000.0).alias("xmin"),
        (F.col("s_acctbal") + 1900000.0).alias("ymin"),
        (k * 9 + 403000.5).alias("xmax"),
        (F.col("s_acctbal") + 1902500.25).alias("ymax"),
    )


@query(
    "b10_grid_and_centres",
    f"""WITH g AS (SELECT *, greatest(1, CAST(ceil((xmax - xmin) / 10) AS BIGINT)) AS w, greatest(1, CAST(ceil((ymax - ymin) / 10) AS BIGINT)) AS h FROM ({_GRID}))
 SELECT box, w, h, y0, x0, (xmax - xmin) / w * (x0 + 8.0) + xmin AS x, -(ymax - ymin) / h * (y0 + 8.0) + ymax AS y
 FROM g, (SELECT o_orderkey // 16 * 16 AS y0, o_orderkey % 16 * 16 AS x0, o_custkey AS k FROM orders) t WHERE t.k = box""",
    "x y",
    4,
)
def _(d: Data):
    g = X.grid_of_box(_proj(d))
    t = d.table("orders").select(
        F.col("o_custkey").alias("box"),
        F.expr("o_orderkey div 16 * 16").alias("y0"),
        F.expr("o_orderkey % 16 * 16").alias("x0"),
    )
    x, y = X.ground(F.col("gt"), F.col("y0") + 8.0, F.col("x0") + 8.0)
    return t.join(g, "box").select("box", "w", "h", "y0", "x0", x.alias("x"), y.alias("y"))


_WB = """SELECT (c_custkey * 7919 % 3000000)::DOUBLE * 10 - 15000000 AS x0, (c_custkey * 104729 % 1500000)::DOUBLE * 10 - 7000000 AS y0, c_acctbal * 100 + 200000 AS s FROM customer"""


@query(
    "b11_raster_tiles",
    f"""SELECT DISTINCT row, col FROM (SELECT *, unnest(range(CAST(floor((x0 + 18041000.0) / 1000000) + 1 AS BIGINT), CAST(floor((x0 + s + 18041000.0) / 1000000) + 2 AS BIGINT))) AS col FROM
 (SELECT *, unnest(range(CAST(floor((9000000.0 - (y0 + s)) / 1000000) + 1 AS BIGINT), CAST(floor((9000000.0 - y0) / 1000000) + 2 AS BIGINT))) AS row FROM ({_WB})))""",
)
def _(d: Data):
    k = F.col("c_custkey")
    x, y = k * 7919 % 3000000 * 10.0 - 15000000, k * 104729 % 1500000 * 10.0 - 7000000
    s = F.col("c_acctbal") * 100 + 200000
    return X.raster_tiles(
        d.table("customer").select(x.alias("xmin"), y.alias("ymin"), (x + s).alias("xmax"), (y + s).alias("ymax"))
    )


_CUM = "SELECT cvegeo, [1 / (1 + exp(k - score / 125000.0)) FOR k IN [0, 1, 2, 3]] AS s FROM tract_scores"


def _shares(d: Data):
    s = F.transform(
        F.array(*[F.lit(float(k)) for k in range(4)]), lambda k: 1 / (1 + F.exp(k - F.col("score") / 125000.0))
    )
    return d.tract_scores().select("cvegeo", s.alias("s"))


@query(
    "b15_share_conversions",
    cte("tract_scores", q=_CUM)
    + """SELECT cvegeo, 1 - s[1] AS c0, s[1] - s[2] AS c1, s[4] AS c4, s[3] AS back3, s[1] + s[2] + s[3] + s[4] AS expected FROM q""",
    "c0 c1 c4 back3 expected",
)
def _(d: Data):
    t = _shares(d).withColumn("c", X.class_shares(F.col("s")))
    return t.select(
        "cvegeo",
        F.col("c")[0].alias("c0"),
        F.col("c")[1].alias("c1"),
        F.col("c")[4].alias("c4"),
        X.cumulative_shares(F.col("c"))[2].alias("back3"),
        X.expected_grade(F.col("s")).alias("expected"),
    )


@query(
    "b16_partner_names",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 's1' ELSE 's2' END || '_' || lower(l_linestatus) AS sensor FROM lineitem)
 SELECT sensor, CASE WHEN sensor LIKE 's1%' THEN 's2' ELSE 's1' END || substr(sensor, 3) AS partner,
 'data/scores_' || sensor || '_v2.parquet' AS path, count(*) AS n FROM s GROUP BY ALL""",
)
def _(d: Data):
    s = d.table("lineitem").select(
        F.concat(F.when(F.col("l_returnflag") == "A", "s1").otherwise("s2"), F.lit("_"), F.lower("l_linestatus")).alias("sensor")
    )
    return s.groupBy("sensor").agg(F.count("*").alias("n")).select(
        "sensor",
        X.fusion_partner(F.col("sensor")).alias("partner"),
        X.suffixed(F.concat(F.lit("data/scores_"), "sensor", F.lit(".parquet")), "v2").alias("path"),
        "n",
    )


@query(
    "b18_decoded_bags",
    cte("tract_scores", q=_CUM, v="SELECT vec_id, embedding AS e FROM embeddings")
    + """SELECT 'classes' AS objective, CAST(vec_id AS VARCHAR) AS bag, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS prediction FROM v
 UNION ALL SELECT 'cumulative', cvegeo, CAST(len(list_filter(s, lambda x : x >= 0.5)) AS INTEGER) FROM q""",
)
def _(d: Data):
    logits = d.table("embeddings").select(
        F.lit("classes").alias("objective"),
        F.col("vec_id").cast("string").alias("bag"),
        X.decode_classes(F.col("embedding")).alias("prediction"),
    )
    shares = _shares(d).select(
        F.lit("cumulative").alias("objective"),
        F.col("cvegeo").alias("bag"),
        X.decode_cumulative(F.col("s")).alias("prediction"),
    )
    return logits.unionByName(shares)
