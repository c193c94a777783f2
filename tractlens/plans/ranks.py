"""Queries on rank statistics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import ranks as R
from tractlens.operators import resample as B
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query


def rho_sql(source: str, x: str, y: str, keys: str = "", min_rows: int = 2, extra: str = "") -> str:
    """Spearman per group in SQL: average ranks, then the correlation."""
    part = f"PARTITION BY {keys}" if keys else ""
    pre = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    head = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}count(*) AS n, corr(rx, ry) AS rho {extra} FROM (SELECT *,
 rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({pre}{x}) - 1) / 2.0 AS rx,
 rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({pre}{y}) - 1) / 2.0 AS ry
 FROM ({source}) AS src) AS ranked {tail} HAVING count(*) >= {min_rows} AND count(DISTINCT {y}) > 1"""


def auc_sql(source: str, score: str, positive: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    pre = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    head = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}CASE WHEN sum(hit) > 0 AND sum(hit) < count(*) THEN
 (sum(CASE WHEN hit = 1 THEN r END) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit)::DOUBLE * (count(*) - sum(hit))) END AS auroc
 FROM (SELECT *, CASE WHEN {positive} THEN 1 ELSE 0 END AS hit,
  rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({pre}{score}) - 1) / 2.0 AS r FROM ({source}) AS src) AS ranked {tail}"""


@query("e1_spearman_pooled", cte("tract_scores") + rho_sql("SELECT * FROM tract_scores", "score", "ordinal"), "rho")
def _(d: Data):
    return R.spearman(d.tract_scores(), "score", "ordinal")


@query(
    "e1_spearman_within",
    cte("tokens") + rho_sql("SELECT * FROM tokens", "score", "ordinal", "city, municipality", 20),
    "rho",
)
def _(d: Data):
    return R.spearman(d.tokens(), "score", "ordinal", ["city", "municipality"], min_rows=20)


@query(
    "e2_auroc_binary",
    auc_sql("SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)", "n_chars", "quality = 1"),
    "auroc",
)
def _(d: Data):
    t = d.table("labels").join(d.table("documents").select("doc_id", "n_chars"), "doc_id")
    return R.auroc(t, "n_chars", F.col("quality") == 1)


_SCALED = "SELECT city, municipality, ordinal, score / 125000.0 AS s FROM tract_scores"


@query(
    "e2_auroc_cumulative",
    cte("tract_scores", k=f"SELECT * FROM ({_SCALED}), (SELECT unnest([1, 2, 3, 4]) AS threshold)")
    + auc_sql("SELECT * FROM k", "s", "ordinal >= threshold", "threshold"),
    "auroc",
)
def _(d: Data):
    t = d.tract_scores().withColumn("s", F.col("score") / 125000.0)
    return R.auroc_cumulative(t, "s", "ordinal")


@query(
    "e2_auroc_one_vs_rest",
    cte("tract_scores", k=f"SELECT *, -abs(s - class) AS mark FROM ({_SCALED}), (SELECT unnest([0, 1, 2, 3, 4]) AS class)")
    + auc_sql("SELECT * FROM k", "mark", "ordinal = class", "class"),
    "auroc",
)
def _(d: Data):
    t = d.tract_scores().withColumn("s", F.col("score") / 125000.0)
    return R.auroc_one_vs_rest(t, "s", "ordinal")


@query(
    "e2_auroc_per_probability",
    cte("tract_scores", k="SELECT *, 1 / (1 + exp(k - score / 125000.0)) AS p FROM tract_scores, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS k)")
    + auc_sql("SELECT * FROM k", "p", "ordinal >= k + 1", "k"),
    "auroc",
)
def _(d: Data):
    p = F.array(*[1 / (1 + F.exp(F.lit(float(k)) - F.col("score") / 125000.0)) for k in range(4)])
    return R.auroc_per_class(d.tract_scores().withColumn("p", p), "p", "ordinal", cumulative=True)


@query(
    "e2_auroc_top_quartile",
    cte("tract_scores")
    + auc_sql(
        "SELECT *, quantile_cont(population, 0.75) OVER (PARTITION BY city) AS cut FROM tract_scores",
        "score",
        "population >= cut",
        "city",
    ),
    "auroc",
)
def _(d: Data):
    return R.auroc_top_quartile(d.tract_scores(), "score", "population", ["city"])


_PRED = "SELECT *, CAST(least(greatest(round_even(score / 125000.0, 0), 0), 4) AS INTEGER) AS pred FROM tract_scores"


def _predicted(d: Data):
    return d.tract_scores().withColumn(
        "pred", F.least(F.greatest(F.bround(F.col("score") / 125000.0), F.lit(0)), F.lit(4)).cast("int")
    )


@query(
    "e3_ordinal_metrics",
    cte(
        "tract_scores",
        pr=_PRED,
        cell="SELECT city, ordinal AS t, pred AS p, count(*)::DOUBLE AS o FROM pr GROUP BY 1, 2, 3",
        tm="SELECT city, t, sum(o) AS a FROM cell GROUP BY 1, 2",
        pm="SELECT city, p, sum(o) AS b FROM cell GROUP BY 1, 2",
        tot="SELECT city, sum(o) AS n, sum((t - p) * (t - p) * o) AS seen FROM cell GROUP BY 1",
        chance="""SELECT tm.city, sum((t - p) * (t - p) * a * b) AS e FROM tm JOIN pm ON tm.city = pm.city GROUP BY 1""",
        f1="""SELECT city, avg(2 * hit / m) AS f1 FROM (SELECT city, k, sum(CASE WHEN t = k AND p = k THEN o ELSE 0 END) AS hit,
              sum(CASE WHEN t = k THEN o ELSE 0 END) + sum(CASE WHEN p = k THEN o ELSE 0 END) AS m
              FROM cell, (SELECT unnest(range(5)) AS k) GROUP BY 1, 2) WHERE m > 0 GROUP BY 1""",
    )
    + """SELECT tot.city, CAST(n AS BIGINT) AS n, 1 - seen / (e / n) AS kappa, acc AS accuracy, f1 AS f1_macro, mae AS mae_ordinal
 FROM tot JOIN chance USING (city) JOIN f1 USING (city)
 JOIN (SELECT city, avg(CASE WHEN ordinal = pred THEN 1.0 ELSE 0 END) AS acc, avg(abs(ordinal - pred)) AS mae FROM pr GROUP BY 1) USING (city)""",
    "kappa accuracy f1_macro mae_ordinal",
)
def _(d: Data):
    return R.ordinal_metrics(_predicted(d), "ordinal", "pred", ["city"])


_SHARES = "[1 / (1 + exp(k - score / 125000.0)) FOR k IN [0, 1, 2, 3]]"


def _with_shares(d: Data):
    shares = F.transform(
        F.array(*[F.lit(float(k)) for k in range(4)]),
        lambda k: 1 / (1 + F.exp(k - F.col("score") / 125000.0)),
    )
    return d.tokens().withColumn("shares", shares)


_LAB = ", ".join(f"avg(CASE WHEN ordinal >= {k} THEN 1.0 ELSE 0.0 END) AS l{k}" for k in (1, 2, 3, 4))
_PRE = ", ".join(f"avg(1 / (1 + exp({k - 1} - score / 125000.0))) AS q{k}" for k in (1, 2, 3, 4))
_TOK = "SELECT *, " + " + ".join(f"1 / (1 + exp({k} - score / 125000.0))" for k in range(4)) + " AS s FROM tokens"


@query(
    "e4_map_evaluation",
    cte(
        "tokens",
        t=_TOK,
        mae=f"""SELECT avg((abs(l1 - q1) + abs(l2 - q2) + abs(l3 - q3) + abs(l4 - q4)) / 4) AS bag_mae
          FROM (SELECT municipality, {_PRE} FROM tokens GROUP BY 1) JOIN (SELECT municipality, {_LAB} FROM tracts GROUP BY 1) USING (municipality)""",
        au=auc_sql("SELECT s, ordinal FROM t", "s", "ordinal >= 3"),
        po=rho_sql("SELECT s, ordinal FROM t", "s", "ordinal"),
        wi=rho_sql("SELECT municipality, s, ordinal FROM t", "s", "ordinal", "municipality", 20),
        tr=rho_sql(
            "SELECT municipality, cvegeo, avg(s) AS s, any_value(ordinal) AS ordinal FROM t GROUP BY 1, 2",
            "s",
            "ordinal",
            "municipality",
            5,
        ),
    )
    + """SELECT bag_mae, (SELECT auroc FROM au) AS auroc_high, (SELECT rho FROM po) AS spearman_pooled,
 (SELECT avg(rho) FROM wi) AS spearman_within, (SELECT avg(rho) FROM tr) AS spearman_within_tract,
 (SELECT count(*) FROM wi) AS bags_scored, (SELECT count(*) FROM tr) AS bags_scored_tract,
 (SELECT count(*) FROM t) AS instances FROM mae""",
    "bag_mae auroc_high spearman_pooled spearman_within spearman_within_tract",
)
def _(d: Data):
    labelled = d.tracts().groupBy("municipality").agg(
        F.array(*[F.avg((F.col("ordinal") >= k).cast("double")) for k in (1, 2, 3, 4)]).alias("shares")
    )
    return R.evaluate_map(_with_shares(d), labelled)


@query(
    "e4_per_bag",
    cte("tokens") + rho_sql("SELECT * FROM tokens", "score", "ordinal", "municipality", 20),
    "rho",
)
def _(d: Data):
    return R.spearman(d.tokens(), "score", "ordinal", ["municipality"], min_rows=20)


@query(
    "d25_tract_means",
    cte("token_scores")
    + """SELECT city, municipality, cvegeo, avg(score) AS score FROM (SELECT city, municipality, cvegeo, y0, x0, avg(score) AS score
 FROM token_scores GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3""",
    "score",
)
def _(d: Data):
    return R.tract_means(R.token_means(d.token_scores()))


_SEEDS = """SELECT city, municipality, cvegeo, avg(s) AS score, stddev_samp(s) AS spread, count(*) AS seeds FROM
 (SELECT seed, city, municipality, cvegeo, avg(score) AS s FROM token_scores GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


@query("d25_tract_seed_table", cte("token_scores") + _SEEDS, "score spread")
def _(d: Data):
    return R.tract_seed_table(d.token_scores())


_ATT = """SELECT municipality, cvegeo, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS a
 FROM (SELECT *, score / 100000.0 AS z FROM tokens) WINDOW w AS (PARTITION BY municipality)"""


def _attention(d: Data):
    from tractlens.operators.tokens import bag_softmax

    return bag_softmax(d.tokens().withColumn("z", F.col("score") / 100000.0), ["municipality"], "z", "attention")


@query(
    "d23_attention_mass",
    cte("tokens", att=_ATT) + "SELECT municipality, cvegeo, sum(a) AS attention FROM att GROUP BY 1, 2",
    "attention",
    9,
)
def _(d: Data):
    return R.attention_mass(_attention(d))


_HEAT = dict(
    att=_ATT,
    mass="SELECT municipality, cvegeo, sum(a) AS attention FROM att GROUP BY 1, 2",
    known="""SELECT m.*, ordinal, attention / sum(attention) OVER (PARTITION BY m.municipality) AS share,
      count(*) OVER (PARTITION BY m.municipality) AS k FROM mass m JOIN (SELECT cvegeo, ordinal FROM tracts) USING (cvegeo)""",
)


@query(
    "e11_attention_detail",
    cte("tokens", **_HEAT)
    + "SELECT municipality, n AS tracts, rho AS spearman FROM ("
    + rho_sql("SELECT * FROM known WHERE k >= 3", "attention", "ordinal", "municipality")
    + ")",
    "spearman",
)
def _(d: Data):
    return R.score_heatmap(R.attention_mass(_attention(d)), d.tracts())[0]


@query(
    "e11_attention_summary",
    cte(
        "tokens",
        **_HEAT,
        u="SELECT * FROM known WHERE k >= 3",
        det=rho_sql("SELECT * FROM known WHERE k >= 3", "attention", "ordinal", "municipality"),
        po=rho_sql("SELECT * FROM u", "round(share, 12)", "ordinal"),
        au=auc_sql("SELECT * FROM u", "round(share, 12)", "ordinal >= 3"),
    )
    + """SELECT (SELECT avg(rho) FROM det) AS spearman_mean, (SELECT rho FROM po) AS spearman_pooled,
 (SELECT auroc FROM au) AS auroc_high, (SELECT count(*) FROM det) AS bags_scored, (SELECT count(*) FROM u) AS tracts_scored""",
    "spearman_mean spearman_pooled auroc_high",
    5,
)
def _(d: Data):
    return R.score_heatmap(R.attention_mass(_attention(d)), d.tracts())[1]


# ---- resampling ---------------------------------------------------------------------------


def draws_sql(clusters: str, cluster: str, resamples: int, seed: int = 0) -> str:
    """Drawn clusters with multiplicity, as the SQL twin of the hash draws."""
    return f"""SELECT replicate, l.{cluster}, count(*) AS times FROM
 (SELECT r.replicate, ('0x' || substr(md5('{seed}|' || CAST(r.replicate AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % k AS pick
  FROM (SELECT row_number() OVER (ORDER BY {cluster}) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT {cluster} FROM ({clusters}))),
       (SELECT unnest(range({resamples})) AS replicate) r) p
 JOIN (SELECT {cluster}, row_number() OVER (ORDER BY {cluster}) - 1 AS i FROM (SELECT DISTINCT {cluster} FROM ({clusters}))) l ON l.i = pick
 GROUP BY 1, 2"""


_WITHIN = rho_sql("SELECT * FROM tokens", "score", "ordinal", "city, municipality", 20)


def _city_rho(d: Data):
    return R.spearman(d.tokens(), "score", "ordinal", ["city", "municipality"], min_rows=20)


@query(
    "e5_clustered_bootstrap",
    cte(
        "tokens",
        w=_WITHIN,
        dr=draws_sql("SELECT city FROM w", "city", 2000),
        m="""SELECT replicate, sum(s * times) / sum(k * times) AS mean FROM dr JOIN
             (SELECT city, sum(rho) AS s, count(*) AS k FROM w GROUP BY 1) USING (city) GROUP BY 1""",
        e="SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m",
    )
    + """SELECT (SELECT avg(rho) FROM w) AS mean, (SELECT count(*) FROM w) AS members, lo AS ci_low, hi AS ci_high,
 (hi - lo) / 2 AS half_width FROM e""",
    "mean ci_low ci_high half_width",
)
def _(d: Data):
    return B.clustered_mean(_city_rho(d), "city", "rho")


_SYS = """SELECT 'price' AS system, city, municipality, rho FROM (%s) UNION ALL SELECT 'wealth', city, municipality, rho FROM (%s)""" % (
    _WITHIN,
    rho_sql("SELECT city, municipality, ordinal, population FROM tracts", "population", "ordinal", "city, municipality", 20),
)


@query(
    "e6_shared_draw_bootstrap",
    cte(
        "tokens",
        s=_SYS,
        dr=draws_sql("SELECT city FROM s", "city", 2000, 1),
        m="""SELECT system, replicate, sum(s * times) / sum(k * times) AS mean FROM dr JOIN
             (SELECT system, city, sum(rho) AS s, count(*) AS k FROM s GROUP BY 1, 2) USING (city) GROUP BY 1, 2""",
        e="SELECT system, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY 1",
    )
    + """SELECT system, p.mean, members, lo AS ci_low, hi AS ci_high, (hi - lo) / 2 AS half_width FROM e JOIN
 (SELECT system, avg(rho) AS mean, count(*) AS members FROM s GROUP BY 1) p USING (system)""",
    "mean ci_low ci_high half_width",
)
def _(d: Data):
    wealth = R.spearman(d.tracts(), "population", "ordinal", ["city", "municipality"], min_rows=20)
    both = _city_rho(d).withColumn("system", F.lit("price")).unionByName(
        wealth.withColumn("system", F.lit("wealth"))
    )
    return B.clustered_mean(both, "city", "rho", ["system"], resamples=2000, seed=1)


_RATIO = """SELECT city, municipality, avg(score) AS a, max(score) AS b FROM tokens GROUP BY 1, 2"""


@query(
    "e7_ratio_bootstrap",
    cte(
        "tokens",
        v=_RATIO,
        dr=draws_sql("SELECT city FROM v", "city", 2000),
        m="""SELECT replicate, sum(a * times) / sum(b * times) AS r FROM dr JOIN
             (SELECT city, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1) USING (city) GROUP BY 1""",
    )
    + """SELECT (SELECT avg(a) / avg(b) FROM v) AS fraction, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high,
 (SELECT count(*) FROM v) AS members FROM m""",
    "fraction ci_low ci_high",
)
def _(d: Data):
    v = d.tokens().groupBy("city", "municipality").agg(F.avg("score").alias("a"), F.max("score").alias("b"))
    return B.clustered_ratio(v, "city", "a", "b", resamples=2000)


_E8 = dict(
    v="SELECT city, ordinal, pred, score / 125000.0 AS s FROM pr",
    dr=draws_sql("SELECT city FROM v", "city", 400),
    rw="SELECT replicate, ordinal, pred, s FROM dr JOIN v USING (city), (SELECT unnest(range(1, 6)) AS copy) WHERE copy <= times",
    kap="""SELECT replicate, 1 - sum((ordinal - pred) * (ordinal - pred)) / (sum(ordinal * ordinal) + sum(pred * pred)
           - 2.0 * sum(ordinal) * sum(pred) / count(*)) AS value FROM rw GROUP BY 1""",
    sp=rho_sql("SELECT * FROM rw", "ordinal", "pred", "replicate"),
    ge=auc_sql("SELECT * FROM rw, (SELECT unnest([1, 2, 3, 4]) AS t)", "s", "ordinal >= t", "replicate, t"),
    iss=auc_sql("SELECT *, -abs(s - c) AS m FROM rw, (SELECT unnest([0, 1, 2, 3, 4]) AS c)", "m", "ordinal = c", "replicate, c"),
    al="""SELECT 'kappa' AS metric, value FROM kap UNION ALL SELECT 'spearman', rho FROM sp
          UNION ALL SELECT 'auroc_ge_' || CAST(t AS VARCHAR), auroc FROM ge UNION ALL SELECT 'auroc_is_' || CAST(c AS VARCHAR), auroc FROM iss
          UNION ALL SELECT 'auroc_cumulative_mean', avg(auroc) FROM ge GROUP BY replicate
          UNION ALL SELECT 'auroc_macro', avg(auroc) FROM iss GROUP BY replicate""",
)


@query(
    "e8_metric_bootstrap",
    cte("tract_scores", pr=_PRED, **_E8)
    + """SELECT metric, quantile_cont(value, 0.025) AS value_low, quantile_cont(value, 0.975) AS value_high FROM al
 WHERE value IS NOT NULL GROUP BY 1""",
    "value_low value_high",
)
def _(d: Data):
    t = _predicted(d).withColumn("s", F.col("score") / 125000.0)
    out = B.metric_bootstrap(t, "city", "ordinal", "pred", "s")
    return out.select("metric", F.col("ci_low").alias("value_low"), F.col("ci_high").alias("value_high"))


@query(
    "e9_row_bootstrap",
    cte(
        "tokens",
        v="SELECT municipality, avg(score) - 250000 AS delta FROM tokens GROUP BY 1",
        dr=draws_sql("SELECT municipality FROM v", "municipality", 10000, 5),
        m="SELECT replicate, sum(delta * times) / sum(times) AS mean FROM dr JOIN v USING (municipality) GROUP BY 1",
    )
    + """SELECT (SELECT avg(delta) FROM v) AS mean, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high,
 avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction FROM m""",
    "mean ci_low ci_high positive_fraction",
    5,
)
def _(d: Data):
    v = d.tokens().groupBy("municipality").agg((F.avg("score") - 250000).alias("delta"))
    return B.row_bootstrap(v, "municipality", "delta", seed=5)


@query(
    "e10_sign_test",
    cte(
        "tokens",
        v="SELECT city, municipality, avg(score) - 252000 AS delta FROM tokens GROUP BY 1, 2",
        c="""SELECT city, count(*) AS n, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_favour FROM v WHERE delta <> 0 GROUP BY 1""",
    )
    + """SELECT city, n, in_favour, least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0)))
 FROM (SELECT unnest(range(greatest(in_favour, n - in_favour), n + 1)) AS k))) AS p FROM c""",
    "p",
)
def _(d: Data):
    v = d.tokens().groupBy("city", "municipality").agg((F.avg("score") - 252000).alias("delta"))
    return B.sign_test(v, "delta", ["city"])
