"""Queries on training, scoring and encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tractlens.functions.hashing import hash_number
from tractlens.operators import learn as G
from tractlens.operators.heads import TRAIN, VALIDATE
from tractlens.operators import splits as S
from tractlens.operators import tokens as T
from tractlens.plans.data import Data, cte
from tractlens.plans.ranks import rho_sql
from tractlens.plans.registry import query
from tractlens.plans.tokens import _B4, _PX, _VCTX, _b4, _px, tokens_sql, windows_sql

SEEDS = (1, 2, 3)


def _bagged(d: Data):
    """Instances with a bag of 25 neighbours in the table and a grade, and the bags' shares."""
    inst = d.table("embeddings").select(
        F.concat(F.lit("b"), F.expr("vec_id div 25").cast("string")).alias("bag"),
        F.col("embedding").alias("vec"),
        (F.col("label") % 5).cast("int").alias("ordinal"),
        "vec_id",
    )
    labels = inst.groupBy("bag").agg(
        F.array(*[F.avg((F.col("ordinal") >= k).cast("double")) for k in (1, 2, 3, 4)]).alias("shares")
    )
    return inst, labels


def _split(bag: str = "bag"):
    """Of ten bags six train, two stop the training and two are measured."""
    turn = F.pmod(hash_number(7, F.col(bag)), F.lit(10))
    return F.when(turn < 6, "train").when(turn < 8, "stop").otherwise("measure")


def _roles(labels, runs: int):
    role = F.when(_split() == "train", TRAIN).when(_split() == "stop", VALIDATE).otherwise(0)
    return labels.select("bag", F.array_repeat(role, runs).alias("roles"))


@query("g3_label_proportion_head")
def _(d: Data):
    inst, labels = _bagged(d)
    runs = [G.Run(seed=s, tags={"seed": s}) for s in SEEDS]
    return G.study(inst, labels, _roles(labels, len(runs)), runs, inst.where(_split() == "measure"))


_ROUND = dict(
    i="SELECT 'b' || CAST(vec_id // 25 AS VARCHAR) AS bag, vec_id, label % 5 AS ordinal, embedding FROM embeddings",
    q="SELECT bag, count(*) AS n, k, avg(CASE WHEN ordinal >= k THEN 1.0 ELSE 0.0 END) AS q FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY bag, k",
    x="SELECT bag, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM i",
)


def _round_sql(folds: str, rate: float = 0.5) -> dict[str, str]:
    """One step from zero weights, unrolled: all outputs are a half, so a bag's error is half less its label."""
    return _ROUND | dict(
        f=folds,
        h="SELECT DISTINCT fold AS held FROM f",
        tr="SELECT h.held, f.bag FROM h JOIN f ON f.fold <> h.held",
        sc="SELECT held, j, avg(x) AS c, stddev_samp(x) AS s FROM tr JOIN x USING (bag) GROUP BY 1, 2",
        bm="SELECT bag, j, avg(x) AS m FROM x GROUP BY 1, 2",
        nb="SELECT held, count(*) AS b FROM tr GROUP BY 1",
        w=f"""SELECT held, k, j, -{rate} * sum((0.5 - q) * 0.25 * (m - c) / s) / any_value(b) AS w FROM tr JOIN q USING (bag)
              JOIN bm USING (bag) JOIN sc USING (held, j) JOIN nb USING (held) GROUP BY 1, 2, 3""",
        bi=f"SELECT held, k, -{rate} * avg((0.5 - q) * 0.25) AS bias FROM tr JOIN q USING (bag) GROUP BY 1, 2",
        z="""SELECT vec_id, w.held, k, sum(w * (x - c) / s) AS z FROM x JOIN f USING (bag) JOIN sc ON sc.held = f.fold AND sc.j = x.j
             JOIN w ON w.held = f.fold AND w.j = x.j GROUP BY 1, 2, 3""",
        sr="SELECT vec_id, sum(1 / (1 + exp(-(z + bias)))) AS score FROM z JOIN bi USING (held, k) GROUP BY 1",
    )


@query(
    "g9_first_round",
    cte("vectors", **_round_sql("SELECT bag, (row_number() OVER (ORDER BY md5('0|' || bag)) - 1) % 5 AS fold FROM (SELECT DISTINCT bag FROM i)"))
    + "SELECT vec_id, ordinal, score FROM i JOIN sr USING (vec_id)",
    "score",
)
def _(d: Data):
    inst, labels = _bagged(d)
    return G.cross_validated_scores(inst, labels, seeds=(0,), rounds=1).select("vec_id", "ordinal", "score")


@query(
    "g3_first_round",
    cte("vectors", **_round_sql("SELECT bag, 0 AS fold FROM (SELECT DISTINCT bag FROM i)") | dict(tr="SELECT 0 AS held, bag FROM f"))
    + "SELECT vec_id, ordinal, score FROM i JOIN sr USING (vec_id)",
    "score",
)
def _(d: Data):
    inst, labels = _bagged(d)
    head = G.fit_proportions(inst, labels, rounds=1)
    return G.score_tokens(inst, {"s0": head}).select("vec_id", "ordinal", "score")


@query("g4_head_variants")
def _(d: Data):
    inst, labels = _bagged(d)
    runs = [G.Run(kind=k, seed=s, tags={"kind": k, "seed": s}) for k in G.HEADS for s in SEEDS]
    detail = G.study(inst, labels, _roles(labels, len(runs)), runs, inst.where(_split() == "measure"))
    return G.over_seeds(detail, ["kind"])


@query("g4_weighted_bag_mean")
def _(d: Data):
    inst, labels = _bagged(d)
    inst = inst.withColumn("people", F.col("vec_id") % 7 + 1)
    runs = [G.Run(tags={"weight": "people"})]
    return G.study(inst, labels, _roles(labels, 1), runs, inst.where(_split() == "measure"), "people")


def _fixed_heads(width: int = 64) -> dict[str, G.Head]:
    """Heads given by a rule, for the scoring twin."""
    j = np.arange(width, dtype=float)
    out = {}
    for s in range(3):
        w = np.stack([np.sin(j + s + k) / 4.0 for k in range(4)], axis=1)
        out[f"s{s}"] = G.Head("independent", w, np.array([0.5, 0.2, -0.1, -0.4]), np.zeros(width), np.ones(width))
    return out


def _score_sql(source: str, width: int) -> str:
    seeds = ", ".join(
        " + ".join(
            f"1 / (1 + exp(-(list_dot_product(v, [sin(j + {s} + {k}) / 4.0 FOR j IN range({width})]) + {b})))"
            for k, b in enumerate((0.5, 0.2, -0.1, -0.4))
        )
        + f" AS score_s{s}"
        for s in range(3)
    )
    return f"SELECT *, (score_s0 + score_s1 + score_s2) / 3 AS score FROM (SELECT vec_id, {seeds} FROM ({source}))"


_SF = "score score_s0 score_s1 score_s2"


@query("g5_scored_tokens", _score_sql("SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings", 64), _SF)
def _(d: Data):
    t = d.table("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return G.score_tokens(t, _fixed_heads()).drop("vec")


@query(
    "g5_scored_with_context",
    cte(
        "vectors",
        ctx=_VCTX,
        cx="SELECT vec_id, list(m ORDER BY k) AS c FROM ctx GROUP BY 1",
    )
    + _score_sql(
        "SELECT v.vec_id, list_concat([x::DOUBLE FOR x IN v.vec], coalesce(cx.c, [x::DOUBLE FOR x IN v.vec])) AS v FROM vectors v LEFT JOIN cx USING (vec_id)",
        128,
    ),
    _SF,
)
def _(d: Data):
    wide = T.neighbour_mean(d.vectors(), ["bag"]).select(
        "vec_id", F.concat(F.col("vec").cast("array<double>"), "context").alias("vec")
    )
    return G.score_tokens(wide, _fixed_heads(128)).drop("vec")


@query("g7_supervised_ceiling")
def _(d: Data):
    inst, _labels = _bagged(d)
    held = _split() == "measure"
    return G.map_quality(G.supervised_ceiling(inst.where(~held), inst.where(held)))


@query("g8_supply_curve")
def _(d: Data):
    """Nested lists of training bags by size and seed, measured on the same held bags."""
    inst, labels = _bagged(d)
    pool = labels.where(_split() == "train").select(
        F.col("bag").alias("municipality"), F.bround(F.col("shares")[1] * 4).cast("int").alias("ordinal")
    )
    orders = labels.select("bag")
    for seed in SEEDS:
        place = S.nested_sample(pool, seed).select(F.col("municipality").alias("bag"), F.col("place").alias(f"p{seed}"))
        orders = orders.join(place, "bag", "left")
    plan = [(size, seed) for size in (4, 8, None) for seed in SEEDS]
    chosen = [
        F.when(F.col(f"p{seed}").isNotNull() & (F.lit(size is None) | (F.col(f"p{seed}") <= F.lit(size))), TRAIN)
        .when(_split() == "stop", VALIDATE)
        .otherwise(0)
        for size, seed in plan
    ]
    runs = [G.Run(seed=seed, tags={"bags": size or -1, "seed": seed}) for size, seed in plan]
    roles = orders.select("bag", F.array(*chosen).alias("roles"))
    return G.over_seeds(G.study(inst, labels, roles, runs, inst.where(_split() == "measure")), ["bags"])


@query("g8_granularity_curve")
def _(d: Data):
    """The same bags labelled by themselves, by their group of four and by the whole."""
    inst, labels = _bagged(d)
    wide = inst.withColumn("state", F.expr("vec_id div 100"))
    share = F.array(*[F.avg((F.col("ordinal") >= k).cast("double")) for k in (1, 2, 3, 4)])
    state = wide.groupBy("state").agg(share.alias("state_shares"))
    of_bag = wide.groupBy("bag").agg(F.min("state").alias("state")).join(state, "state").select("bag", "state_shares")
    national = inst.agg(share.alias("s")).scalar()
    levels = ("municipality", "state", "national")
    sets = labels.join(of_bag, "bag").select("bag", F.concat("shares", "state_shares", national).alias("shares"))
    runs = [G.Run(seed=s, labels=i, tags={"level": n, "seed": s}) for i, n in enumerate(levels) for s in SEEDS]
    detail = G.study(inst, sets, _roles(labels, len(runs)), runs, inst.where(_split() == "measure"))
    return G.over_seeds(detail, ["level"])


@query("g9_cross_validated_scores")
def _(d: Data):
    """Five folds, three seeds and two lengths of the training lists."""
    inst, labels = _bagged(d)
    return G.transfer_quality(G.cross_validated_scores(inst, labels, seeds=SEEDS, sizes=(8, None)))


@query("g9_spatial_cell_folds")
def _(d: Data):
    cell = S.spatial_cell(F.lit("k"), F.expr("vec_id div 32 * 16"), F.expr("vec_id % 32 * 16"), 160)
    inst, _labels = _bagged(d)
    inst = inst.withColumn("bag", cell)
    labels = inst.groupBy("bag").agg(
        F.array(*[F.avg((F.col("ordinal") >= k).cast("double")) for k in (1, 2, 3, 4)]).alias("shares")
    )
    return G.transfer_quality(G.cross_validated_scores(inst, labels, seeds=SEEDS))


def _feature_table(d: Data):
    """A tract in five has no texture."""
    untextured = F.floor("population") % 5 == 0
    return d.tract_scores().select(
        "cvegeo",
        "city",
        "ordinal",
        (F.col("score") / 125000.0).alias("s2red_mean"),
        (F.col("population") / 5000.0).alias("s2red_std"),
        (F.col("population") % 7 / 7.0).alias("wc_built"),
        F.when(~untextured, F.col("score") % 11 / 11.0).alias("s2red_contrast_d1"),
    )


@query("g1_leave_one_city_out")
def _(d: Data):
    return G.fold_summary(G.leave_one_city_out(_feature_table(d)))


_BLIND = dict(
    t="SELECT city, ordinal, cvegeo FROM tract_scores",
    cells="SELECT city, k, sum(CASE WHEN ordinal = k THEN 1 ELSE 0 END) AS n FROM t, (SELECT unnest(range(5)) AS k) GROUP BY 1, 2",
    others="SELECT a.city, a.k, sum(b.n) - a.n AS o FROM cells a JOIN cells b USING (k) GROUP BY a.city, a.k, a.n",
    run="SELECT city, k, o, sum(o) OVER (PARTITION BY city ORDER BY k) AS edge, sum(o) OVER (PARTITION BY city) AS size FROM others",
    major="SELECT city, arg_max(k, o * 10 - k) AS top FROM run GROUP BY 1",
    u="SELECT *, ('0x' || substr(md5('0|' || cvegeo), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t",
    drawn="SELECT u.city, ordinal, cvegeo, least(4, count(CASE WHEN u.u * size >= edge THEN 1 END)) AS prediction FROM u JOIN run USING (city) GROUP BY 1, 2, 3",
    pr="SELECT 'majority' AS model, city, ordinal, top AS prediction FROM t JOIN major USING (city) UNION ALL SELECT 'random', city, ordinal, prediction FROM drawn",
    m="SELECT model, city, count(*) AS n, avg(CASE WHEN ordinal = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, avg(abs(ordinal - prediction)) AS mae_ordinal FROM pr GROUP BY 1, 2",
)


@query(
    "g1_blind_models",
    cte("tract_scores", **_BLIND)
    + f"""SELECT m.model, m.city, m.n, m.accuracy, m.mae_ordinal, r.rho AS spearman FROM m LEFT JOIN
 ({rho_sql("SELECT * FROM pr", "ordinal", "prediction", "model, city")}) r ON r.model = m.model AND r.city = m.city""",
    "accuracy mae_ordinal spearman",
)
def _(d: Data):
    folds = G.fold_metrics(G.blind_predictions(_feature_table(d)), ["model", "city"])
    return folds.select("model", "city", "n", "accuracy", "mae_ordinal", "spearman")


@query("g2_partition_evaluation")
def _(d: Data):
    table = _feature_table(d)
    partition = table.select("city").distinct().withColumn(
        "split", F.when(F.col("city").isin("r0", "r1"), "test").otherwise("train")
    )
    return G.evaluate_partition(table, partition, "all", "classifier")


@query(
    "g10_encoded_windows",
    cte(
        px=_PX,
        boxes=_B4,
        win=windows_sql(32, 32, False),
        tk=tokens_sql("SELECT * FROM win"),
        cells="SELECT box, band, r // 16 * 16 AS y0, c // 16 * 16 AS x0, avg(value / 9973.0) AS m, stddev_pop(value / 9973.0) AS s FROM px GROUP BY 1, 2, 3, 4",
    )
    + """SELECT box, win, j, y0, x0, max(CASE WHEN band = 'A' THEN m END) AS mean_a, max(CASE WHEN band = 'R' THEN m END) AS mean_r,
 max(CASE WHEN band = 'A' THEN s END) AS std_a, max(CASE WHEN band = 'R' THEN s END) AS std_r FROM tk JOIN cells USING (box, y0, x0) GROUP BY ALL""",
    "mean_a mean_r std_a std_r",
)
def _(d: Data):
    px = _px(d).withColumn("value", F.col("value") / 9973.0)
    out = G.encode_windows(px, T.window_lattice(_b4(px), 32, 32), ["A", "N", "R"])
    v = F.col("vec")
    return out.select(
        "box", "win", "j", "y0", "x0", v[0].alias("mean_a"), v[2].alias("mean_r"), v[3].alias("std_a"), v[5].alias("std_r")
    )
