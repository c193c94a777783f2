"""Queries on windows, tokens, neighbourhoods and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import tokens as T
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query


def boxes(d: Data):
    """One box per supplier; its extent follows the lines it ships."""
    return (
        d.table("lineitem")
        .groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("box"))
        .agg(
            (F.count("*") + 100).alias("h"),
            (F.sum(F.col("l_linenumber").cast("long")) % 700 + 150).alias("w"),
        )
    )


_BOXES = """SELECT 's' || CAST(l_suppkey AS VARCHAR) AS box, count(*) + 100 AS h, CAST(sum(l_linenumber) % 700 + 150 AS BIGINT) AS w FROM lineitem GROUP BY 1"""


def starts_sql(extent: str, size: int, stride: int, flush: bool) -> str:
    regular = f"[i * {stride} FOR i IN range(({extent} - {size}) // {stride} + 1)]"
    if not flush:
        return regular
    return f"""CASE WHEN ({extent} - {size}) // {stride} * {stride} + {size} < {extent}
 THEN list_sort(list_distinct(list_append({regular}, ({extent} - {size}) // 16 * 16))) ELSE {regular} END"""


def windows_sql(size: int, stride: int, flush: bool) -> str:
    return f"""SELECT box, (row * nc + col)::BIGINT AS win, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, ys[row + 1] AS y0, xs[col + 1] AS x0, {size} AS size
 FROM (SELECT *, unnest(range(len(xs))) AS col FROM (SELECT *, unnest(range(len(ys))) AS row, len(xs) AS nc FROM
  (SELECT box, {starts_sql("h", size, stride, flush)} AS ys, {starts_sql("w", size, stride, flush)} AS xs FROM boxes WHERE h >= {size} AND w >= {size})))"""


def tokens_sql(windows: str) -> str:
    return f"""SELECT box, win, j, j // (size // 16) AS trow, j % (size // 16) AS tcol, y0 + j // (size // 16) * 16 AS y0, x0 + j % (size // 16) * 16 AS x0
 FROM (SELECT *, unnest(range(CAST((size // 16) * (size // 16) AS BIGINT))) AS j FROM ({windows}))"""


@query("d21_window_lattice", cte(boxes=_BOXES) + windows_sql(224, 112, True))
def _(d: Data):
    return T.window_lattice(boxes(d), 224, 112, flush=True)


@query("d21_window_lattice_plain", cte(boxes=_BOXES) + windows_sql(224, 224, False))
def _(d: Data):
    return T.window_lattice(boxes(d))


@query(
    "d21_token_addresses",
    cte(boxes=_BOXES, win=windows_sql(224, 224, True)) + tokens_sql("SELECT * FROM win"),
)
def _(d: Data):
    return T.window_tokens(T.window_lattice(boxes(d), flush=True))


@query(
    "d21_window_metadata",
    cte(boxes=_BOXES, win=windows_sql(224, 224, True))
    + """SELECT box, win, 10.0 * (x0 + 112) + 500000.0 + len(box) AS x, -10.0 * (y0 + 112) + 2000000.0 AS y, 18262.0::DOUBLE AS day,
 2.24::DOUBLE * 2.24 AS area_km2 FROM win""",
    "x y area_km2 day",
    4,
)
def _(d: Data):
    b = boxes(d)
    grids = b.select(
        "box",
        F.array(
            F.lit(10.0), F.lit(0.0), F.lit(500000.0) + F.length("box"), F.lit(0.0), F.lit(-10.0), F.lit(2000000.0)
        ).alias("gt"),
    )
    return T.window_metadata(T.window_lattice(b, flush=True), grids, 18262.0)


# pixels on a lattice of 64 x 64 per box: windows of 32 px with tokens of 16 px
_PX = """SELECT 's' || CAST(l_suppkey % 4 AS VARCHAR) AS box, l_returnflag AS band, l_orderkey % 64 AS r, l_partkey % 64 AS c,
 max(CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 12 <> 0 THEN l_extendedprice END) AS value FROM lineitem GROUP BY 1, 2, 3, 4"""
_OBS = "SELECT box, r, c FROM px WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT band) = 3"
_PT = "SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0, count(*) AS seen FROM obs GROUP BY 1, 2, 3"
_B4 = "SELECT DISTINCT box, 64 AS h, 64 AS w FROM px"


def _px(d: Data):
    good = F.when(F.floor("l_quantity") % 12 != 0, F.col("l_extendedprice"))
    return (
        d.table("lineitem")
        .groupBy(
            F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("box"),
            F.col("l_returnflag").alias("band"),
            (F.col("l_orderkey") % 64).alias("r"),
            (F.col("l_partkey") % 64).alias("c"),
        )
        .agg(F.max(good).alias("value"))
    )


def _b4(px):
    return px.select("box").distinct().withColumn("h", F.lit(64)).withColumn("w", F.lit(64))


_WINS = windows_sql(32, 16, False)


@query(
    "d20_valid_windows",
    cte(px=_PX, obs=_OBS, pt=_PT, boxes=_B4, win=_WINS, tk=tokens_sql("SELECT * FROM win"))
    + """SELECT win.* FROM win JOIN (SELECT box, win, sum(seen) AS seen FROM tk JOIN pt USING (box, y0, x0) GROUP BY 1, 2) USING (box, win)
 WHERE seen >= 32 * 32 * 0.3::DOUBLE""",
)
def _(d: Data):
    px = _px(d)
    return T.valid_windows(T.window_lattice(_b4(px), 32, 16), T.observed_pixels(px, 3), minimum=0.3)


@query(
    "d20_valid_tokens",
    cte(px=_PX, obs=_OBS, pt=_PT, boxes=_B4, win=_WINS, tk=tokens_sql("SELECT * FROM win"))
    + """SELECT box, y0, x0, win, j, trow, tcol FROM (SELECT tk.*, row_number() OVER (PARTITION BY box, y0, x0 ORDER BY win, j) AS rn
 FROM tk JOIN pt USING (box, y0, x0) WHERE seen >= 16 * 16 * 0.3::DOUBLE) WHERE rn = 1""",
)
def _(d: Data):
    px = _px(d)
    return T.valid_tokens(T.window_lattice(_b4(px), 32, 16), T.observed_pixels(px, 3), minimum=0.3)


@query(
    "c9_chebyshev_neighbours",
    cte("tokens")
    + """SELECT a.municipality, a.y0 AS src_y, a.x0 AS src_x, b.y0 AS dst_y, b.x0 AS dst_x FROM tokens a JOIN tokens b
 ON a.municipality = b.municipality AND abs(a.y0 - b.y0) <= 32 AND abs(a.x0 - b.x0) <= 32 AND (a.y0 <> b.y0 OR a.x0 <> b.x0)""",
)
def _(d: Data):
    return T.neighbour_pairs(d.tokens(), ["municipality"], 2)


_VCTX = """SELECT a.bag, a.y0, a.x0, a.vec_id, f.k, avg(b.vec[f.k]::DOUBLE) AS m FROM vectors a JOIN vectors b
 ON a.bag = b.bag AND abs(a.y0 - b.y0) <= 16 AND abs(a.x0 - b.x0) <= 16 AND a.vec_id <> b.vec_id, (SELECT unnest(range(1, 65)) AS k) f GROUP BY 1, 2, 3, 4, 5"""


@query(
    "g6_neighbour_mean",
    cte("vectors", ctx=_VCTX)
    + """SELECT v.bag, v.y0, v.x0, CAST(k - 1 AS INTEGER) AS feature, coalesce(m, v.vec[k]::DOUBLE) AS context
 FROM (SELECT *, unnest(range(1, 65)) AS k FROM vectors) v LEFT JOIN (SELECT vec_id, k, m FROM ctx) USING (vec_id, k)""",
    "context",
)
def _(d: Data):
    return T.neighbour_mean(d.vectors(), ["bag"]).select(
        "bag", "y0", "x0", F.posexplode("context").alias("feature", "context")
    )


_HANN = "greatest(pow(sin(3.141592653589793 * ({} + 0.5) / 2), 2), 0.05)"
_ENC = """SELECT box, win, j, trow, tcol, y0, x0, [v FOR v IN [(win * 7 + j * 3 + y0 + x0) % 101 + 0.25, (win * 5 + j) % 17 + 0.5]] AS vec"""


def _encoded(d: Data):
    px = _px(d)
    t = T.window_tokens(T.window_lattice(_b4(px), 32, 16)).join(
        px.groupBy("box", F.expr("r div 16 * 16").alias("y0"), F.expr("c div 16 * 16").alias("x0")).agg(F.avg("value").alias("m")),
        ["box", "y0", "x0"],
    )
    return t.withColumn("vec", F.array(F.col("m") / (F.col("win") + 1), F.col("m") * (F.col("j") + 1)))


_ENCODED = """SELECT tk.*, [m / (win + 1), m * (j + 1)] AS vec FROM tk JOIN
 (SELECT box, r // 16 * 16 AS y0, c // 16 * 16 AS x0, avg(value) AS m FROM px GROUP BY 1, 2, 3) USING (box, y0, x0)"""


@query(
    "d22_overlap_central",
    cte(px=_PX, boxes=_B4, win=windows_sql(48, 16, False), tk=tokens_sql("SELECT * FROM win"), enc=_ENCODED)
    + f"""SELECT box, y0, x0, vec[1] AS v1, vec[2] AS v2 FROM (SELECT *, row_number() OVER (PARTITION BY box, y0, x0 ORDER BY
 round({_HANN.format("trow").replace("/ 2)", "/ 3)")} * {_HANN.format("tcol").replace("/ 2)", "/ 3)")}, 12) DESC, win DESC, j DESC) AS rn FROM enc) WHERE rn = 1""",
    "v1 v2",
    3,
)
def _(d: Data):
    out = T.reduce_overlaps(_wide(d), 3)
    return out.select("box", "y0", "x0", F.col("vec")[0].alias("v1"), F.col("vec")[1].alias("v2"))


def _wide(d: Data):
    px = _px(d)
    means = px.groupBy("box", F.expr("r div 16 * 16").alias("y0"), F.expr("c div 16 * 16").alias("x0")).agg(
        F.avg("value").alias("m")
    )
    t = T.window_tokens(T.window_lattice(_b4(px), 48, 16)).join(means, ["box", "y0", "x0"])
    return t.withColumn("vec", F.array(F.col("m") / (F.col("win") + 1), F.col("m") * (F.col("j") + 1)))


@query(
    "d22_overlap_hann",
    cte(px=_PX, boxes=_B4, win=windows_sql(48, 16, False), tk=tokens_sql("SELECT * FROM win"), enc=_ENCODED)
    + f"""SELECT box, y0, x0, sum(vec[1] * w) / sum(w) AS v1, sum(vec[2] * w) / sum(w) AS v2 FROM (SELECT *,
 {_HANN.format("trow").replace("/ 2)", "/ 3)")} * {_HANN.format("tcol").replace("/ 2)", "/ 3)")} AS w FROM enc) GROUP BY 1, 2, 3""",
    "v1 v2",
    3,
)
def _(d: Data):
    out = T.reduce_overlaps(_wide(d), 3, "hann")
    return out.select("box", "y0", "x0", F.col("vec")[0].alias("v1"), F.col("vec")[1].alias("v2"))


_ATTN = """SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY bag) AS a FROM (SELECT bag, vec_id, vec, vec[1]::DOUBLE * 5 AS z FROM vectors)"""


@query(
    "d24_attention_pool",
    cte("vectors", att=_ATTN)
    + """SELECT bag, CAST(k - 1 AS INTEGER) AS feature, n, pooled, entropy FROM
 (SELECT bag, k, sum(a * vec[k]::DOUBLE) AS pooled FROM att, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2) JOIN
 (SELECT bag, count(*) AS n, -sum(a * ln(a)) / ln(count(*)) AS entropy FROM att GROUP BY 1) USING (bag)""",
    "pooled entropy",
)
def _(d: Data):
    v = d.vectors().withColumn("z", F.col("vec")[0].cast("double") * 5)
    return T.attention_pool(v, ["bag"], "z").select(
        "bag", "n", "entropy", F.posexplode("pooled").alias("feature", "pooled")
    )


@query(
    "d24_pseudo_labels",
    cte(
        "tokens",
        p="""SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY score DESC, orderkey) AS i, count(*) OVER (PARTITION BY municipality) AS n FROM tokens""",
    )
    + """SELECT municipality, orderkey, CASE WHEN i <= least(8, n // 2) THEN 1 ELSE 0 END AS pseudo FROM p
 WHERE i <= least(8, n // 2) OR i > n - least(8, n // 2)""",
)
def _(d: Data):
    return T.pseudo_labels(d.tokens(), ["municipality"], "score", "orderkey").select(
        "municipality", "orderkey", "pseudo"
    )


_PART = "SELECT bag, y0, x0, [vec[1], vec[2]] AS vec FROM vectors"


@query(
    "c3_position_join",
    cte("vectors", o="SELECT o_orderkey // 32 * 16 AS y0, o_orderkey % 32 * 16 AS x0, [o_totalprice] AS w FROM orders")
    + """SELECT bag, y0, x0, CAST(generate_subscripts(v, 1) AS INTEGER) AS entry, unnest(v) AS value
 FROM (SELECT bag, y0, x0, list_concat(vec::DOUBLE[], w::DOUBLE[]) AS v FROM vectors JOIN o USING (y0, x0))""",
    "value",
)
def _(d: Data):
    other = d.table("orders").select(
        F.expr("o_orderkey div 32 * 16").alias("y0"),
        F.expr("o_orderkey % 32 * 16").alias("x0"),
        F.array("o_totalprice").alias("vec"),
    )
    base = d.vectors().withColumn("vec", F.col("vec").cast("array<double>"))
    out = T.join_by_position(base, other, ["y0", "x0"])
    entries = out.select("bag", "y0", "x0", F.posexplode("vec").alias("entry", "value"))
    return entries.withColumn("entry", F.col("entry") + 1)


@query(
    "c3_unmatched_positions",
    """SELECT count(*) AS dropped FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)""",
)
def _(d: Data):
    def spot(key):
        return [F.expr(f"{key} div 128 * 16").alias("y0"), F.expr(f"{key} % 128 * 16").alias("x0")]

    return T.unmatched_positions(
        d.table("orders").select(*spot("o_orderkey")),
        d.table("lineitem").where("l_quantity > 25").select(*spot("l_orderkey")),
        ["y0", "x0"],
    )


@query(
    "d29_vector_scaler",
    cte("vectors", s="SELECT *, row_number() OVER (PARTITION BY bag ORDER BY md5('0|' || CAST(vec_id AS VARCHAR)), vec_id) AS i FROM vectors")
    + """SELECT CAST(k - 1 AS INTEGER) AS feature, avg(vec[k]::DOUBLE) AS centre, stddev_pop(vec[k]::DOUBLE) AS spread
 FROM (SELECT * FROM s WHERE i <= 200), (SELECT unnest(range(1, 65)) AS k) GROUP BY 1""",
    "centre spread",
)
def _(d: Data):
    return T.vector_scaler(d.vectors(), ["bag"], "vec_id")


@query(
    "d27_municipality_points",
    cte("tokens")
    + """SELECT municipality, avg(x0 / 1000.0) AS lon, avg(y0 / 1000.0) AS lat, count(*) AS tokens, avg(score / 9973.0) AS score,
 arg_min(CASE WHEN orderkey % 2 = 0 THEN 'val' ELSE 'test' END, orderkey) AS split FROM tokens GROUP BY 1 HAVING count(*) >= 600""",
    "lon lat score",
)
def _(d: Data):
    t = d.tokens().select(
        "municipality",
        "y0",
        "x0",
        (F.col("x0") / 1000.0).alias("lon"),
        (F.col("y0") / 1000.0).alias("lat"),
        (F.col("score") / 9973.0).alias("score"),
        F.when(F.col("orderkey") % 2 == 0, "val").otherwise("test").alias("split"),
    )
    return T.municipality_points(t, 600)


@query(
    "d27_grade_of_study_units",
    cte("tokens")
    + """SELECT municipality, arg_min(ordinal, (city, orderkey)) AS ordinal FROM tokens GROUP BY 1""",
)
def _(d: Data):
    return d.tokens().groupBy("municipality").agg(F.min_by("ordinal", F.struct("city", "orderkey")).alias("ordinal"))
