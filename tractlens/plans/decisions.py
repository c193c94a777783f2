"""Queries on targeting, selective use, conformal intervals, borders and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import compare as C
from tractlens.operators import decide as D
from tractlens.operators import ranks as R
from tractlens.operators.tokens import rook_pairs
from tractlens.plans.data import Data, cte
from tractlens.plans.ranks import _SEEDS, auc_sql, draws_sql, rho_sql
from tractlens.plans.registry import query

TIES = D.TIE_DRAWS
# means of 200 draws of money in hundredths fall on a grid that lies between the steps of fewer digits
MONEY_DIGITS = 7
_BUD = "(SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS budget)"


def reached_sql(source: str, keys: str, order: str, name: str, draws: int = 0) -> str:
    """Budgeted funding written as a running sum; `draws` repeats it over random ties."""
    head = f"{keys}, " if keys else ""
    base = f"SELECT * FROM ({source})"
    part = keys
    if draws:
        base = f"SELECT * FROM ({source}), (SELECT unnest(range({draws})) AS draw)"
        part = f"{keys}, draw" if keys else "draw"
    pw = f"PARTITION BY {part}" if part else ""
    mean = f" / {float(draws)}" if draws else ""
    return f"""SELECT {head}budget, sum(CASE WHEN ordinal >= 3 THEN population ELSE 0 END *
  greatest(0, least(1, (whole * budget - before) / population))){mean} AS {name}
 FROM (SELECT *, sum(population) OVER ({pw}) AS whole, coalesce(sum(population) OVER ({pw} ORDER BY {order}
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({base}) AS b) AS w, {_BUD} AS bud GROUP BY {head}budget"""


_AGG = "SELECT *, avg(ordinal) OVER (PARTITION BY municipality) AS agg FROM tract_scores"
_RND = "md5('0|' || CAST(draw AS VARCHAR) || '|' || cvegeo)"
_TARGET = dict(
    a=_AGG,
    o=reached_sql("SELECT * FROM a", "city", "ordinal DESC, cvegeo", "oracle"),
    m=reached_sql("SELECT * FROM a", "city", "score DESC, cvegeo", "map"),
    g=reached_sql("SELECT * FROM a", "city", f"agg DESC, {_RND}", "aggregate", TIES),
    cells="""SELECT city, budget, oracle, map, aggregate, CASE WHEN oracle > aggregate THEN (map - aggregate) / (oracle - aggregate) END AS gap_closed
             FROM o JOIN m USING (city, budget) JOIN g USING (city, budget)""",
)
_FLOATS = "oracle map aggregate gap_closed"


def _cells(d: Data):
    return D.targeting(d.tract_scores(), tie_draws=TIES)


# a ratio over a small gap is not known to seven digits
_COARSE = "SELECT * REPLACE (round(gap_closed, 3) AS gap_closed) FROM cells"


def _coarse(cells):
    return cells.withColumn("gap_closed", F.round("gap_closed", 3))


@query("e20_targeting_cells", cte("tract_scores", **_TARGET) + _COARSE, _FLOATS, MONEY_DIGITS)
def _(d: Data):
    return _coarse(_cells(d))


_POOL = "SELECT budget, aggregate, map, oracle, (map - aggregate) / (oracle - aggregate) AS gap_closed FROM (SELECT budget, sum(aggregate) AS aggregate, sum(map) AS map, sum(oracle) AS oracle FROM {} GROUP BY 1)"


@query("e21_targeting_pooled", cte("tract_scores", **_TARGET) + _POOL.format("cells"), _FLOATS, MONEY_DIGITS)
def _(d: Data):
    return D.pooled_gap(_cells(d))


@query(
    "e21_gap_summary",
    cte("tract_scores", **_TARGET)
    + """SELECT budget, CAST(sum(CASE WHEN map < aggregate THEN 1 ELSE 0 END) AS BIGINT) AS losing, count(*) AS cells,
 median(gap_closed) AS median_gap FROM cells GROUP BY 1""",
    "median_gap",
)
def _(d: Data):
    return D.gap_summary(_cells(d))


@query(
    "e21_several_municipalities",
    cte(
        "tract_scores",
        **_TARGET,
        sub="SELECT * FROM cells WHERE city IN (SELECT city FROM tokens GROUP BY 1 HAVING count(DISTINCT municipality) > 1)",
    )
    + _POOL.format("sub"),
    _FLOATS,
    MONEY_DIGITS,
)
def _(d: Data):
    return D.pooled_gap(D.in_several_municipalities(_cells(d), d.tokens()))


_MUNI = dict(
    good="""SELECT city, municipality, count(DISTINCT cvegeo) AS tracts FROM tract_scores GROUP BY 1, 2
            HAVING count(DISTINCT cvegeo) >= 5 AND count(DISTINCT ordinal) > 1""",
    a="SELECT tract_scores.* FROM tract_scores JOIN good USING (city, municipality)",
    o=reached_sql("SELECT * FROM a", "city, municipality", "ordinal DESC, cvegeo", "oracle"),
    m=reached_sql("SELECT * FROM a", "city, municipality", "score DESC, cvegeo", "map"),
    g=reached_sql("SELECT * FROM a", "city, municipality", _RND, "aggregate", TIES),
    cells="""SELECT city, municipality, budget, oracle, map, aggregate, tracts,
     CASE WHEN oracle > aggregate THEN (map - aggregate) / (oracle - aggregate) END AS gap_closed
     FROM o JOIN m USING (city, municipality, budget) JOIN g USING (city, municipality, budget) JOIN good USING (city, municipality)""",
)


@query("e22_targeting_by_municipality", cte("tract_scores", **_MUNI) + _COARSE, _FLOATS, MONEY_DIGITS)
def _(d: Data):
    return _coarse(D.targeting_by_municipality(d.tract_scores(), tie_draws=TIES))


@query(
    "e22_proportional_budget",
    cte("tract_scores", **_MUNI)
    + """SELECT budget, proportional_aggregate, proportional_map, proportional_census,
 (proportional_map - proportional_aggregate) / (proportional_census - proportional_aggregate) AS gap_closed_proportional
 FROM (SELECT budget, sum(aggregate) AS proportional_aggregate, sum(map) AS proportional_map, sum(oracle) AS proportional_census FROM cells GROUP BY 1)""",
    "proportional_aggregate proportional_map proportional_census gap_closed_proportional",
    MONEY_DIGITS,
)
def _(d: Data):
    return D.proportional_budget(D.targeting_by_municipality(d.tract_scores(), tie_draws=TIES))


@query(
    "e22_targeting_national",
    cte(
        "tract_scores",
        a=_AGG,
        c=reached_sql("SELECT * FROM a", "", "ordinal DESC, cvegeo", "census"),
        m=reached_sql("SELECT * FROM a", "", "score DESC, cvegeo", "map"),
        b=reached_sql("SELECT * FROM a", "", "agg DESC, score DESC, cvegeo", "aggregate_then_map"),
        g=reached_sql("SELECT * FROM a", "", f"agg DESC, {_RND}", "aggregate", TIES),
    )
    + """SELECT budget, aggregate, aggregate_then_map, map, census, (aggregate_then_map - aggregate) / (census - aggregate) AS gap_closed_aggregate_then_map,
 (map - aggregate) / (census - aggregate) AS gap_closed_map FROM c JOIN m USING (budget) JOIN b USING (budget) JOIN g USING (budget)""",
    "aggregate aggregate_then_map map census gap_closed_aggregate_then_map gap_closed_map",
    MONEY_DIGITS,
)
def _(d: Data):
    return D.targeting_national(d.tract_scores(), tie_draws=TIES)


# ---- certainty ----------------------------------------------------------------------------

_FRAME = dict(
    st=_SEEDS,
    frame="SELECT st.*, ordinal, population FROM st JOIN (SELECT cvegeo, ordinal, population FROM tracts) USING (cvegeo)",
)


def _frame(d: Data):
    return R.tract_seed_table(d.token_scores()).join(
        d.tracts().select("cvegeo", "ordinal", "population"), "cvegeo"
    )


# the rising fit at a point: of all stretches that end at or behind it the least mean, of all starts the largest
_ISO = dict(
    pt="""SELECT score, row_number() OVER (ORDER BY score) AS i, y, w, sum(y) OVER o AS yy, sum(w) OVER o AS ww
          FROM (SELECT score, sum(ordinal)::DOUBLE AS y, count(*)::DOUBLE AS w FROM frame GROUP BY 1) WINDOW o AS (ORDER BY score)""",
    stretch="""SELECT l.i AS l, u.i AS u, min((u.yy - l.yy + l.y) / (u.ww - l.ww + l.w)) OVER
               (PARTITION BY l.i ORDER BY u.i DESC ROWS UNBOUNDED PRECEDING) AS low FROM pt l JOIN pt u ON l.i <= u.i""",
    iso="SELECT score, p AS predicted FROM pt JOIN (SELECT u AS i, max(low) AS p FROM stretch GROUP BY 1) USING (i)",
    pf="SELECT frame.*, predicted FROM frame JOIN iso USING (score)",
)


@query(
    "e12_isotonic_prediction",
    cte("token_scores", **_FRAME, **_ISO) + "SELECT cvegeo, score, ordinal, predicted FROM pf",
    "score predicted",
)
def _(d: Data):
    frame = _frame(d)
    return D.predict_isotonic(D.fit_isotonic(frame), frame).select("cvegeo", "score", "ordinal", "predicted")


_KNOWS = dict(
    er="""SELECT *, abs(predicted - ordinal) AS error FROM pf WHERE spread IS NOT NULL AND municipality IN
          (SELECT municipality FROM frame GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT ordinal) > 1)""",
    kr=rho_sql("SELECT * FROM er", "error", "spread", "city, municipality"),
    dr=draws_sql("SELECT city FROM kr", "city", 2000),
    km="""SELECT replicate, sum(s * times) / sum(k * times) AS mean FROM dr JOIN
          (SELECT city, sum(rho) AS s, count(*) AS k FROM kr WHERE rho IS NOT NULL GROUP BY 1) USING (city) GROUP BY 1""",
)


@query(
    "e13_spread_knows_error",
    cte("token_scores", **_FRAME, **_ISO, **_KNOWS)
    + """SELECT count(rho) AS municipalities, avg(rho) AS rho_spread_error, (SELECT quantile_cont(mean, 0.025) FROM km) AS ci_low,
 (SELECT quantile_cont(mean, 0.975) FROM km) AS ci_high FROM kr""",
    "rho_spread_error ci_low ci_high",
)
def _(d: Data):
    frame = _frame(d)
    return D.spread_knows_error(D.predict_isotonic(D.fit_isotonic(frame), frame), 2000)


@query(
    "e13_spread_error_by_municipality",
    cte(
        "token_scores",
        **_FRAME,
        e="""SELECT *, abs(score / 3.0 - ordinal) AS error FROM frame WHERE spread IS NOT NULL AND municipality IN
             (SELECT municipality FROM frame GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT ordinal) > 1)""",
    )
    + rho_sql("SELECT * FROM e", "error", "spread", "city, municipality"),
    "rho",
)
def _(d: Data):
    return D.spread_error_correlation(_frame(d).withColumn("predicted", F.col("score") / 3.0))


_SEL = dict(
    u="SELECT * FROM frame WHERE municipality IN (SELECT municipality FROM frame GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT ordinal) > 1)",
    pl="""SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY spread NULLS LAST, cvegeo) AS i,
          count(*) OVER (PARTITION BY municipality) AS k FROM u""",
    kept="SELECT * FROM pl, (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE]) AS discarded) WHERE i <= round_even(k * (1.0::DOUBLE - discarded), 0)",
    steady="""SELECT municipality FROM (SELECT municipality, discarded FROM kept GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT ordinal) > 1)
              GROUP BY 1 HAVING count(*) = 6""",
    rh=rho_sql("SELECT * FROM kept WHERE municipality IN (SELECT municipality FROM steady)", "score", "ordinal", "discarded, city, municipality"),
    dr=draws_sql("SELECT city FROM rh", "city", 2000),
    mm="""SELECT discarded, replicate, sum(s * times) / sum(c * times) AS mean FROM dr JOIN
          (SELECT discarded, city, sum(rho) AS s, count(*) AS c FROM rh GROUP BY 1, 2) USING (city) GROUP BY 1, 2""",
)


@query(
    "e14_selective_curve",
    cte("token_scores", **_FRAME, **_SEL)
    + """SELECT discarded, municipalities, rho_within, ci_low, ci_high FROM
 (SELECT discarded, count(*) AS municipalities, avg(rho) AS rho_within FROM rh GROUP BY 1) JOIN
 (SELECT discarded, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM mm GROUP BY 1) USING (discarded)""",
    "discarded rho_within ci_low ci_high",
)
def _(d: Data):
    return D.selective_curve(_frame(d), resamples=2000)


_CONF = dict(
    res="SELECT *, abs(score / 3.0 - ordinal) AS residual FROM frame",
    cal="SELECT * FROM res WHERE city IN ('r0', 'r1', 'r2')",
    ev="SELECT * FROM res WHERE city NOT IN ('r0', 'r1', 'r2')",
    so="""SELECT list(residual ORDER BY residual) AS l, least(1.0::DOUBLE, ceil((count(*) + 1) * 0.9::DOUBLE) / count(*)) * (count(*) - 1) AS spot FROM cal""",
    w="""SELECT 'marginal' AS rule, l[CAST(floor(spot) AS BIGINT) + 1] + (l[CAST(ceil(spot) AS BIGINT) + 1] - l[CAST(floor(spot) AS BIGINT) + 1]) * (spot - floor(spot)) AS half_width FROM so
         UNION ALL SELECT 'clustered', quantile_cont(q, 0.9) FROM (SELECT city, quantile_cont(residual, 0.9) AS q FROM cal GROUP BY 1)""",
    pc="""SELECT rule, city, half_width, count(*) AS tracts, CAST(sum(CASE WHEN residual <= half_width THEN 1 ELSE 0 END) AS BIGINT) AS covered
          FROM ev, w GROUP BY 1, 2, 3""",
)


def _residuals(d: Data):
    r = _frame(d).withColumn("residual", F.abs(F.col("score") / 3.0 - F.col("ordinal")))
    cal = F.col("city").isin("r0", "r1", "r2")
    return r.where(cal), r.where(~cal)


@query("e15_conformal_by_city", cte("token_scores", **_FRAME, **_CONF) + "SELECT * FROM pc", "half_width")
def _(d: Data):
    return D.conformal_by_city(*_residuals(d))


@query(
    "e15_conformal",
    cte("token_scores", **_FRAME, **_CONF, sh="SELECT *, covered::DOUBLE / tracts AS share FROM pc")
    + """SELECT rule, max(half_width) AS half_width, sum(covered)::DOUBLE / sum(tracts) AS coverage, min(share) AS worst_city_coverage,
 arg_min(city, (share, city)) AS worst_city, max(share) AS best_city_coverage,
 CAST(sum(CASE WHEN share < 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS cities_below_nominal, count(*) AS cities FROM sh GROUP BY 1""",
    "half_width coverage worst_city_coverage best_city_coverage",
)
def _(d: Data):
    return D.conformal(*_residuals(d))


_AUDIT = f"""SELECT *, row_number() OVER (ORDER BY rho_within, city) AS place FROM
 (SELECT city, count(*) AS municipalities, avg(rho) AS rho_within FROM ({rho_sql("SELECT * FROM frame", "score", "ordinal", "city, municipality", 20)}) GROUP BY 1)
 JOIN (SELECT city, count(*) AS tracts, count(DISTINCT ordinal) AS grades_present, avg(CASE WHEN ordinal >= 3 THEN 1.0 ELSE 0 END) AS share_high,
       median(spread) AS median_spread FROM frame GROUP BY 1) USING (city)"""


@query("e16_city_audit", cte("token_scores", **_FRAME) + _AUDIT, "rho_within share_high median_spread")
def _(d: Data):
    return D.city_audit(_frame(d))


@query(
    "e16_best_and_median_city",
    cte("token_scores", **_FRAME, au=_AUDIT)
    + """SELECT CASE WHEN place = (SELECT count(*) FROM au) THEN 'best' ELSE 'median' END AS role, city, rho_within FROM au
 WHERE place IN ((SELECT count(*) FROM au), (SELECT count(*) // 2 + 1 FROM au))""",
    "rho_within",
)
def _(d: Data):
    return D.best_and_median_city(D.city_audit(_frame(d)))


_VIEW = dict(
    gr="SELECT *, greatest(0, least(4, round_even(predicted, 0)))::INT AS grade FROM pf",
    cell="SELECT ordinal AS t, grade AS p, count(*)::DOUBLE AS o FROM gr GROUP BY 1, 2",
    chance="""SELECT sum((a.t - b.p) * (a.t - b.p) * a.n * b.n) / (SELECT sum(o) FROM cell) AS e
              FROM (SELECT t, sum(o) AS n FROM cell GROUP BY 1) a, (SELECT p, sum(o) AS n FROM cell GROUP BY 1) b""",
    f1="""SELECT avg(2 * hit / m) AS f1 FROM (SELECT k, sum(CASE WHEN t = k AND p = k THEN o ELSE 0 END) AS hit,
          sum(CASE WHEN t = k THEN o ELSE 0 END) + sum(CASE WHEN p = k THEN o ELSE 0 END) AS m
          FROM cell, (SELECT unnest(range(5)) AS k) GROUP BY 1) WHERE m > 0""",
)
_VIEW_AREAS = "\n UNION ALL ".join(
    f"SELECT 'auroc_ge_{k}' AS metric, auroc AS value FROM ({auc_sql('SELECT * FROM gr', 'score', f'ordinal >= {k}')})"
    for k in (1, 2, 3, 4)
)


@query(
    "e17_classification_view",
    cte("token_scores", **_FRAME, **_ISO, **_VIEW)
    + f"""SELECT 'kappa' AS metric, 1 - sum((t - p) * (t - p) * o) / (SELECT e FROM chance) AS value FROM cell
 UNION ALL SELECT 'accuracy', avg(CASE WHEN ordinal = grade THEN 1.0 ELSE 0.0 END) FROM gr
 UNION ALL SELECT 'f1_macro', f1 FROM f1
 UNION ALL SELECT 'mae_ordinal', avg(abs(ordinal - grade)) FROM gr
 UNION ALL {_VIEW_AREAS}""",
    "value",
)
def _(d: Data):
    frame = _frame(d)
    return D.classification_view(frame, frame)


@query(
    "e18_maup_curve",
    cte(
        "token_scores",
        pt="""SELECT city, municipality, cvegeo, avg(score) AS score, count(*) // (SELECT count(DISTINCT seed) FROM token_scores) AS tokens
              FROM token_scores GROUP BY 1, 2, 3""",
        tb="SELECT pt.*, ordinal, population FROM pt JOIN (SELECT cvegeo, ordinal, population FROM tracts) USING (cvegeo)",
        bins="SELECT * FROM (VALUES (0, 1, 3), (1, 4, 9), (2, 10, 19), (3, 20, 49), (4, 50, NULL)) AS v(bin, tokens_low, tokens_high)",
        ch="SELECT * FROM tb JOIN bins ON tokens >= tokens_low AND (tokens_high IS NULL OR tokens <= tokens_high)",
        rh=rho_sql("SELECT * FROM ch", "score", "ordinal", "bin, municipality", 10),
    )
    + """SELECT tokens_low, tokens_high, coalesce(k, 0) AS tracts, mp AS median_population, coalesce(m, 0) AS municipalities, sw AS spearman_within
 FROM bins LEFT JOIN (SELECT bin, count(*) AS k, median(population) AS mp FROM ch GROUP BY 1) USING (bin)
 LEFT JOIN (SELECT bin, count(*) AS m, avg(rho) AS sw FROM rh GROUP BY 1) USING (bin)""",
    "median_population spearman_within",
)
def _(d: Data):
    return D.maup_curve(d.token_scores(), d.tracts())


_PAIRS = """SELECT a.city, abs(a.score - b.score) AS jump, a.municipality = b.municipality AS same_municipality,
 a.cvegeo = b.cvegeo AS same_tract, a.ordinal = b.ordinal AS same_grade
 FROM tokens a JOIN tokens b ON a.city = b.city AND ((b.y0 = a.y0 AND b.x0 = a.x0 + 16) OR (b.y0 = a.y0 + 16 AND b.x0 = a.x0))"""


@query("c10_rook_pairs", cte("tokens") + _PAIRS, "jump", 4)
def _(d: Data):
    return rook_pairs(d.tokens(), ["city"])


def _excess(name: str, rule: str) -> str:
    return f"""SELECT '{name}' AS crossing, (SELECT avg(jump) FROM p WHERE {rule}) - (SELECT avg(jump) FROM p WHERE same_tract) AS excess,
 quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high FROM
 (SELECT replicate, sum(c * times) / sum(times) - sum(r * times) / sum(CASE WHEN r IS NOT NULL THEN times END) AS delta
  FROM (SELECT city, avg(jump) AS c FROM p WHERE {rule} GROUP BY 1) JOIN ({draws_sql(f"SELECT city FROM p WHERE {rule}", "city", 2000)}) USING (city)
  LEFT JOIN (SELECT city, avg(jump) AS r FROM p WHERE same_tract GROUP BY 1) USING (city) GROUP BY 1)"""


@query(
    "e19_border_excess",
    cte("tokens", p=_PAIRS)
    + _excess("municipal", "NOT same_municipality AND same_grade")
    + " UNION ALL "
    + _excess("tract", "NOT same_tract AND same_municipality AND same_grade"),
    "excess ci_low ci_high",
    4,
)
def _(d: Data):
    return D.border_excess(rook_pairs(d.tokens(), ["city"]), 2000)


# ---- comparisons --------------------------------------------------------------------------


def _within_sql(prefix: str, tokens: str) -> dict:
    return {
        f"{prefix}k": tokens,
        f"{prefix}t": rho_sql(f"SELECT * FROM {prefix}k", "score", "ordinal", "city, municipality", 20),
        f"{prefix}a": rho_sql(
            f"SELECT city, municipality, cvegeo, avg(score) AS score, any_value(ordinal) AS ordinal FROM {prefix}k GROUP BY 1, 2, 3",
            "score",
            "ordinal",
            "city, municipality",
            5,
        ),
        f"{prefix}w": f"SELECT t.city, t.municipality, t.rho AS token, a.rho AS tract FROM {prefix}t t LEFT JOIN {prefix}a a USING (city, municipality)",
    }


_TM = "SELECT city, municipality, cvegeo, y0, x0, avg(score) AS score, any_value(ordinal) AS ordinal FROM token_scores GROUP BY 1, 2, 3, 4, 5"


@query("c19_within", cte("token_scores", **_within_sql("o", _TM)) + "SELECT * FROM ow", "token tract")
def _(d: Data):
    return R.within(d.token_scores().drop("ordinal"), d.tracts())


@query(
    "c19_paired_comparison",
    cte(
        "token_scores",
        **_within_sql("b", "SELECT * FROM tokens"),
        **_within_sql("o", _TM),
        pr="""SELECT city, municipality, 'token' AS unit, b.token AS base, o.token AS other FROM bw b JOIN ow o USING (city, municipality)
              UNION ALL SELECT city, municipality, 'tract', b.tract, o.tract FROM bw b JOIN ow o USING (city, municipality)""",
        dr=draws_sql("SELECT city FROM pr", "city", 2000),
        mm="""SELECT unit, replicate, sum(s * times) / sum(c * times) AS mean FROM dr JOIN
              (SELECT unit, city, sum(other - base) AS s, count(*) AS c FROM pr GROUP BY 1, 2) USING (city) GROUP BY 1, 2""",
    )
    + """SELECT unit, municipalities, base_within, other_within, difference, ci_low, ci_high, wins FROM
 (SELECT unit, count(*) AS municipalities, avg(base) AS base_within, avg(other) AS other_within, avg(other - base) AS difference,
  CAST(sum(CASE WHEN other > base THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM pr GROUP BY 1) JOIN
 (SELECT unit, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM mm GROUP BY 1) USING (unit)""",
    "base_within other_within difference ci_low ci_high",
)
def _(d: Data):
    return C.paired_comparison(_two_systems(d), "base", "other", 2000)


def _two_systems(d: Data, tracts: bool = True):
    columns = ["city", "municipality", "cvegeo", "y0", "x0", "score"]
    both = d.tokens().select(F.lit("base").alias("system"), *columns).unionByName(
        d.token_scores().select(F.lit("other").alias("system"), *columns)
    )
    return R.within(both, d.tracts(), ["system"], tracts)


@query(
    "e16_two_systems",
    cte("token_scores", **_within_sql("b", "SELECT * FROM tokens"), **_within_sql("o", _TM))
    + """SELECT city, base, other, other - base AS difference FROM (SELECT city, avg(token) AS base FROM bw GROUP BY 1)
 JOIN (SELECT city, avg(token) AS other FROM ow GROUP BY 1) USING (city) WHERE base IS NOT NULL AND other IS NOT NULL""",
    "base other difference",
)
def _(d: Data):
    return D.cities_of_two_systems(_two_systems(d, tracts=False), "base", "other")


_PROD = dict(
    fr="SELECT city, municipality, cvegeo, score, ordinal, -population AS proxy FROM tract_scores WHERE population > 1",
    us=rho_sql("SELECT * FROM fr", "score", "ordinal", "city, municipality", 20),
    th=rho_sql("SELECT * FROM fr", "proxy", "ordinal", "city, municipality", 20),
    lg="""SELECT city, 'ours' AS what, u.rho AS v FROM us u JOIN th USING (city, municipality) UNION ALL
          SELECT city, 'proxy', t.rho FROM us JOIN th t USING (city, municipality) UNION ALL
          SELECT city, 'difference', u.rho - t.rho FROM us u JOIN th t USING (city, municipality)""",
    dr=draws_sql("SELECT city FROM lg", "city", 2000),
    mm="""SELECT what, replicate, sum(s * times) / sum(c * times) AS mean FROM dr JOIN
          (SELECT what, city, sum(v) AS s, count(*) AS c FROM lg GROUP BY 1, 2) USING (city) GROUP BY 1, 2""",
    en="SELECT what, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM mm GROUP BY 1",
)
_W = ", ".join(
    f"(SELECT avg(v) FROM lg WHERE what = '{w}') AS {w}_within, (SELECT lo FROM en WHERE what = '{w}') AS {w}_ci_low, (SELECT hi FROM en WHERE what = '{w}') AS {w}_ci_high"
    for w in ("ours", "proxy", "difference")
)


@query(
    "e24_product_comparison",
    cte("tract_scores", **_PROD)
    + f"""SELECT {_W}, (SELECT count(*) FROM lg WHERE what = 'difference') AS municipalities,
 (SELECT count(*) FROM lg WHERE what = 'difference' AND v > 0) AS wins, (SELECT count(*) FROM fr) AS tracts,
 CAST(0 AS BIGINT) AS interior_fallback,
 ({auc_sql("SELECT * FROM fr", "score", "ordinal >= 4")}) AS ours_auc_high, ({auc_sql("SELECT * FROM fr", "proxy", "ordinal >= 4")}) AS proxy_auc_high""",
    " ".join(f"{w}_{s}" for w in ("ours", "proxy", "difference") for s in ("within", "ci_low", "ci_high"))
    + " ours_auc_high proxy_auc_high",
)
def _(d: Data):
    t = d.tract_scores().where("population > 1").withColumn("proxy", -F.col("population"))
    return C.product_comparison(t, "proxy", resamples=2000)


@query(
    "e23_index_replication",
    cte(
        "tract_scores",
        f="SELECT *, -population AS i FROM tract_scores",
        pb=rho_sql("SELECT * FROM f", "score", "i", "city, municipality", 20),
        dr=draws_sql("SELECT city FROM pb", "city", 2000),
        mm="""SELECT replicate, sum(s * times) / sum(c * times) AS mean FROM dr JOIN
              (SELECT city, sum(rho) AS s, count(*) AS c FROM pb GROUP BY 1) USING (city) GROUP BY 1""",
        po=rho_sql("SELECT * FROM f", "score", "i"),
    )
    + f"""SELECT (SELECT avg(rho) FROM pb) AS spearman_within, (quantile_cont(mean, 0.975) - quantile_cont(mean, 0.025)) / 2 AS half_width,
 (SELECT count(*) FROM pb) AS municipalities, (SELECT rho FROM po) AS spearman_pooled,
 ({auc_sql("SELECT * FROM f", "i", "ordinal >= 3")}) AS auroc_high, (SELECT count(*) FROM f) AS tracts FROM mm""",
    "spearman_within half_width spearman_pooled auroc_high",
)
def _(d: Data):
    return C.index_replication(d.tract_scores(), "population", resamples=2000)


_RUNS = """SELECT 'c' || CAST(l_partkey % 40 AS VARCHAR) AS config, l_tax + l_discount AS bag_mae, l_quantity / 50.0 AS within, l_extendedprice / 9973.0 AS auroc FROM lineitem"""


def _runs(d: Data):
    return d.table("lineitem").select(
        F.concat(F.lit("c"), (F.col("l_partkey") % 40).cast("string")).alias("config"),
        (F.col("l_tax") + F.col("l_discount")).alias("bag_mae"),
        (F.col("l_quantity") / 50.0).alias("within"),
        (F.col("l_extendedprice") / 9973.0).alias("auroc"),
    )


_MEANS = "SELECT config, round(avg(bag_mae), 9) AS bag_mae, round(avg(within), 9) AS within, round(avg(auroc), 9) AS auroc FROM r GROUP BY 1"


@query(
    "e25_selection_blindness",
    f"WITH r AS ({_RUNS}), m AS ({_MEANS}), a AS ({rho_sql('SELECT * FROM m', 'bag_mae', 'within')}), b AS ({rho_sql('SELECT * FROM m', 'bag_mae', 'auroc')}) "
    + """SELECT (SELECT rho FROM a) AS rank_corr_within, (SELECT rho FROM b) AS rank_corr_auroc,
 (SELECT arg_min(config, (bag_mae, config)) FROM m) AS best_by_error, (SELECT count(*) FROM m) AS configs""",
    "rank_corr_within rank_corr_auroc",
    5,
)
def _(d: Data):
    return C.selection_blindness(_runs(d), "bag_mae", ["within", "auroc"])


_MS = """SELECT 'k' || CAST(l_suppkey % 3 AS VARCHAR) AS country, l_returnflag AS method, l_linenumber AS seed, avg(l_quantity) / 7.0 AS within,
 min(l_tax) AS ci_low, max(l_tax) AS ci_high, count(*) AS bags FROM lineitem GROUP BY 1, 2, 3"""


@query(
    "e26_method_summary",
    f"""SELECT country, method, list(round(within, 4) ORDER BY seed) AS within_seeds, avg(within) AS within, avg(ci_low) AS within_ci_low,
 avg(ci_high) AS within_ci_high, arg_min(bags, seed) AS bags FROM ({_MS}) GROUP BY 1, 2""",
    "within within_ci_low within_ci_high",
)
def _(d: Data):
    runs = (
        d.table("lineitem")
        .groupBy(
            F.concat(F.lit("k"), (F.col("l_suppkey") % 3).cast("string")).alias("country"),
            F.col("l_returnflag").alias("method"),
            F.col("l_linenumber").alias("seed"),
        )
        .agg(
            (F.avg("l_quantity") / 7.0).alias("within"),
            F.min("l_tax").alias("ci_low"),
            F.max("l_tax").alias("ci_high"),
            F.count("*").alias("bags"),
        )
    )
    return C.method_summary(runs)


@query(
    "e27_drift_guard",
    """WITH c AS (SELECT 'price.' || l_returnflag || '.' || CAST(l_linenumber AS VARCHAR) AS path, avg(l_quantity) AS value FROM lineitem GROUP BY 1),
 p AS (SELECT 'price.' || l_returnflag || '.' || CAST(l_linenumber AS VARCHAR) AS path, avg(l_quantity) AS value FROM lineitem
       WHERE l_linestatus = 'F' OR l_linenumber < 4 GROUP BY 1)
 SELECT path, c.value AS computed, p.value AS published, CASE WHEN c.value IS NULL THEN 'missing' WHEN p.value IS NULL THEN 'unpublished' ELSE 'drift' END AS reason
 FROM c FULL JOIN p USING (path) WHERE c.value IS NULL OR p.value IS NULL OR abs(c.value - p.value) > 1e-3""",
    "computed published",
)
def _(d: Data):
    path = F.concat(F.lit("price."), F.col("l_returnflag"), F.lit("."), F.col("l_linenumber").cast("string"))
    li = d.table("lineitem")

    def values(df):
        return df.groupBy(path.alias("path")).agg(F.avg("l_quantity").alias("value"))

    return C.drift(values(li), values(li.where("l_linestatus = 'F' OR l_linenumber < 4")))
