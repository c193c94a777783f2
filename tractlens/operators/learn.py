"""Learning from bag labels, baselines by city, scoring at scale, and the encoder slot."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tractlens.functions.hashing import hash_number, hash_order
from tractlens.operators import boost
from tractlens.operators.heads import HEADS, TRAIN, VALIDATE, Head, Run, fit_many
from tractlens.operators.labels import HIGH, inverse_frequency
from tractlens.operators.ranks import MIN_TOKENS, auroc_of_ranks, ordinal_metrics, rank_correlation, ranked_cells, spearman
from tractlens.operators.resample import RESAMPLES, clustered_mean, metric_bootstrap
from tractlens.operators.scale import numbered, settled
from tractlens.operators.splits import cities_of, standardise_by_group
from tractlens.operators.tokens import window_tokens
from tractlens.operators.zonal import CLASSES

GRADES = 5
MEASURES = ("kappa", "accuracy", "f1_macro", "spearman", "mae_ordinal")
DENSITY = ("mean", "std", "p10", "p50", "p90", "iqr")
TEXTURES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "entropy", "anisotropy")
# fixed values: which measured quantity belongs to which set of features
SET_OF_FEATURE = (
    dict.fromkeys(CLASSES.values(), "cover")
    | dict.fromkeys(DENSITY, "intensity")
    | {f"{t}_d{d}": "texture" for t in TEXTURES for d in (1, 2, 4)}
)


# ---- label-proportion head ----------------------------------------------------------------


def fit_proportions(
    instances: DataFrame,
    labels: DataFrame,
    *,
    validation: DataFrame | None = None,
    weight: str | None = None,
    **options,
) -> Head:
    """One head trained against bag shares; stops early on the error of the bags in `validation`.

    `instances(bag, vec)`, `labels(bag, shares)` with the four cumulative shares, `validation(bag)`;
    `options` are those of `Run`.
    """
    role = F.lit(TRAIN)
    bags = labels.select("bag")
    if validation is not None:
        held = validation.select("bag").distinct().withColumn("_v", F.lit(VALIDATE))
        bags, role = bags.join(held, "bag", "left"), F.coalesce("_v", F.lit(TRAIN))
    return fit_many(instances, labels, bags.select("bag", F.array(role).alias("roles")), [Run(**options)], weight)[0]


def score_tokens(tokens: DataFrame, heads: dict[str, Head], vec: str = "vec") -> DataFrame:
    """Expected grade of each token per head and their mean; heads travel with the task."""
    names = list(heads)
    values = list(heads.values())

    @F.pandas_udf(ArrayType(DoubleType()))
    def scores(v: pd.Series) -> pd.Series:
        x = np.stack(v).astype("float64")
        return pd.Series(list(np.column_stack([h.cumulative(x).sum(axis=1) for h in values])))

    scored = tokens.withColumn("_s", scores(F.col(vec).cast("array<double>")))
    return scored.select(
        *tokens.columns,
        (F.aggregate("_s", F.lit(0.0), lambda a, s: a + s) / len(names)).alias("score"),
        *[F.col("_s")[i].alias(f"score_{n}") for i, n in enumerate(names)],
    )


def map_quality(scored: DataFrame, group: str = "bag", by: Sequence[str] = ()) -> DataFrame:
    """Pooled and within-bag quality of scored instances with known ordinal.

    `by` names further columns, such as the run a score comes from; everything is ranked in one walk.
    """
    by = list(by)
    known = scored.where("ordinal IS NOT NULL").select(*by, F.col(group).cast("string").alias("_bag"), "score", "ordinal")
    sides = F.array(F.struct(F.lit("bag").alias("_unit"), F.col("_bag").alias("_name")), F.struct(F.lit("all").alias("_unit"), F.lit("").alias("_name")))
    long = known.select(*by, "score", "ordinal", F.explode(sides).alias("_u")).select(*by, "score", "ordinal", "_u.*")
    keys = [*by, "_unit", "_name"]
    cells = settled(ranked_cells(long, "score", "ordinal", keys))
    rhos = rank_correlation(cells, keys)
    bag = (F.col("_unit") == "bag") & (F.col("n") >= MIN_TOKENS)
    inside = rhos.groupBy(*by).agg(
        F.max(F.when(F.col("_unit") == "all", F.col("rho"))).alias("pooled"),
        F.avg(F.when(bag, F.col("rho"))).alias("within"),
        F.count_if(bag).alias("bags_scored"),
    )
    whole = cells.where("_unit = 'all'").groupBy(*by).agg(
        auroc_of_ranks(F.col("_y") >= HIGH).alias("auroc_high"), F.sum("_c").alias("instances")
    )
    joined = whole.join(inside, by, "left") if by else whole.crossJoin(inside)  # one row each
    return joined.select(*by, "auroc_high", "pooled", "within", "bags_scored", "instances")


def within_bags(scored: DataFrame, by: Sequence[str] = (), group: str = "bag") -> DataFrame:
    """Rank correlation inside each bag that is large enough."""
    return spearman(scored, "score", "ordinal", [*by, group], min_rows=MIN_TOKENS)


def study(
    instances: DataFrame, labels: DataFrame, roles: DataFrame, runs: Sequence[Run], measured: DataFrame, weight: str | None = None
) -> DataFrame:
    """Trains all runs together and measures their maps: a row per run with its tags.

    Serves the supply curve, the granularity curve, the hyper-parameter sweep and the head ablation.
    """
    heads = fit_many(instances, labels, roles, runs, weight)
    scored = score_tokens(measured, {f"r{i}": h for i, h in enumerate(heads)})
    marks = F.array(*[F.struct(F.lit(i).alias("run"), F.col(f"score_r{i}").alias("score")) for i in range(len(runs))])
    long = scored.select("bag", "ordinal", F.explode(marks).alias("m")).select("bag", "ordinal", "m.*")
    names = list(runs[0].tags)
    tags = F.array(*[F.struct(*[F.lit(r.tags[n]).alias(n) for n in names]) for r in runs])
    return map_quality(long, by=["run"]).withColumn("t", tags[F.col("run")]).select("t.*", "auroc_high", "pooled", "within", "bags_scored", "instances")


def over_seeds(detail: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and deviation over the seeds of each configuration."""
    measures = ("auroc_high", "pooled", "within")
    return detail.groupBy(*keys).agg(
        F.count("*").alias("seeds"),
        *[F.avg(m).alias(m) for m in measures],
        *[F.stddev_samp(m).alias(f"{m}_sd") for m in measures],
    )


def seeded_folds(bags: DataFrame, count: int, seeds: Sequence[int]) -> DataFrame:
    """Order and fold of each bag under every seed: bag, seed, place (from 0), fold."""
    each = bags.select("bag").distinct().select("bag", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    dealt = numbered(each, ["seed"], [hash_order(F.col("seed"), F.col("bag")).asc()], "_i")
    place = F.col("_i") - 1
    return dealt.select("bag", "seed", place.alias("place"), F.pmod(place, F.lit(count)).cast("int").alias("fold"))


def cross_validated_scores(
    instances: DataFrame,
    labels: DataFrame,
    *,
    folds: int = 5,
    seeds: Sequence[int] = (1, 2, 3),
    sizes: Sequence[int | None] = (None,),
    **options,
) -> DataFrame:
    """Score of each instance from heads of the other folds, averaged over seeds: a row per size.

    A size keeps the first training bags of a fold in the seed's order, so the lists of a seed are
    nested. All folds, seeds and sizes are trained together.
    """
    dealt = settled(seeded_folds(labels, folds, seeds))
    plan = [(s, seed, fold) for s in range(len(sizes)) for seed in seeds for fold in range(folds)]
    runs = [Run(seed=seed, **options) for _, seed, _ in plan]
    per_bag = dealt.groupBy("bag").agg(
        *[F.max(F.when(F.col("seed") == seed, F.col(c))).alias(f"{c}_{seed}") for seed in seeds for c in ("place", "fold")]
    )
    roles = []
    for s, seed, fold in plan:
        place = F.col(f"place_{seed}")
        # bags of the held fold stand at every count-th place
        earlier = F.floor((place + folds - 1 - fold) / folds)
        used = F.col(f"fold_{seed}") != fold
        if sizes[s] is not None:
            used = used & (place - earlier < sizes[s])
        roles.append(F.when(used, TRAIN).otherwise(0))
    heads = fit_many(instances, labels, per_bag.select("bag", F.array(*roles).alias("roles")), runs)
    own = per_bag.select(F.col("bag"), F.array(*[F.col(f"fold_{seed}") for seed in seeds]).alias("_folds"))
    scored = score_tokens(instances, {f"r{i}": h for i, h in enumerate(heads)})
    every = F.array(*[F.col(f"score_r{i}") for i in range(len(runs))])
    means = F.array(
        *[
            F.struct(
                F.lit(size).cast("int").alias("size"),
                (
                    sum(
                        (every[F.lit((s * len(seeds) + k) * folds) + F.col("_folds")[k]] for k in range(len(seeds))),
                        F.lit(0.0),
                    )
                    / float(len(seeds))
                ).alias("score"),
            )
            for s, size in enumerate(sizes)
        ]
    )
    return scored.join(own, "bag").select(*instances.columns, F.explode(means).alias("m")).select(*instances.columns, "m.size", "m.score")


def transfer_quality(scored: DataFrame, by: Sequence[str] = ("size",), resamples: int = RESAMPLES) -> DataFrame:
    """Quality of cross-validated scores, with the interval of the mean within bags over drawn bags."""
    by = list(by)
    known = settled(scored.select(*[F.coalesce(F.col(b), F.lit(-1)).alias(b) for b in by], "bag", "ordinal", "score"))
    ends = clustered_mean(within_bags(known, by), "bag", "rho", by, resamples=resamples).select(*by, "ci_low", "ci_high")
    return map_quality(known, by=by).join(ends, by, "left")


# ---- supervised ceiling and baselines -----------------------------------------------------


def supervised_ceiling(train: DataFrame, measured: DataFrame, rounds: int = 50) -> DataFrame:
    """Expected grade from a class-weighted multinomial model on instance labels."""
    weights = inverse_frequency(train.select("ordinal")).select("ordinal", "weight")
    vec = array_to_vector(F.col("vec").cast("array<double>"))
    ready = train.join(F.broadcast(weights), "ordinal").withColumn("features", vec)
    model = LogisticRegression(
        labelCol="ordinal", weightCol="weight", family="multinomial", maxIter=rounds, regParam=1e-3
    ).fit(ready)
    p = model.transform(measured.withColumn("features", vec)).withColumn("_p", vector_to_array("probability"))
    grade = F.aggregate(
        F.transform("_p", lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v
    )
    return p.withColumn("score", grade).select(*measured.columns, "score")


def columns_of_set(columns: Sequence[str], name: str) -> list[str]:
    """Feature columns of one set: the part behind a column's channel prefix is looked up."""
    if name != "all" and name not in SET_OF_FEATURE.values():
        raise KeyError(name)
    found = []
    for column in columns:
        channel, _, feature = column.partition("_")
        kind = SET_OF_FEATURE.get(feature) if channel else None
        if kind and name in ("all", kind):
            found.append(column)
    return sorted(found)


def blind_predictions(table: DataFrame, key: str = "cvegeo", group: str = "city", seed: int = 0) -> DataFrame:
    """What two models that see no feature say of each group, from the other groups' grades.

    `majority` gives their most frequent grade, `random` draws by their shares with a hash of the key.
    Rows: model, group, ordinal, prediction.
    """
    known = table.where(F.col("ordinal").isNotNull())
    # one row per group and grade
    cells = known.groupBy(group).agg(*[F.count_if(F.col("ordinal") == k).alias(f"n{k}") for k in range(GRADES)])
    totals = cells.agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in range(GRADES)])
    others = cells.crossJoin(totals).select(group, *[(F.col(f"t{k}") - F.col(f"n{k}")).alias(f"o{k}") for k in range(GRADES)])
    counts = [F.col(f"o{k}") for k in range(GRADES)]
    size = sum(counts[1:], counts[0])
    top = F.greatest(*counts)
    majority = F.coalesce(*[F.when(counts[k] == top, k) for k in range(GRADES)])
    u = hash_number(seed, F.col(key)) / float(2**32) * size
    drawn, edge = F.lit(0), F.lit(0)
    for k in range(GRADES - 1):
        edge = edge + counts[k]
        drawn = drawn + (u >= edge).cast("int")
    both = F.array(
        F.struct(F.lit("majority").alias("model"), majority.alias("prediction")),
        F.struct(F.lit("random").alias("model"), drawn.alias("prediction")),
    )
    # groups without others have nothing to learn from
    return known.join(others.where(size > 0), group).select(group, "ordinal", F.explode(both).alias("m")).select(
        "m.model", group, "ordinal", "m.prediction"
    )


def fold_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordinal metrics and rank correlation of every fold."""
    rho = spearman(predictions, "ordinal", "prediction", keys).select(*keys, F.col("rho").alias("spearman"))
    return ordinal_metrics(predictions, "ordinal", "prediction", keys).join(rho, list(keys), "left")


def leave_one_city_out(
    table: DataFrame,
    sets: Sequence[str] = ("cover", "intensity", "texture", "all"),
    kinds: Sequence[str] = ("classifier", "regressor"),
    *,
    blind: bool = True,
    standardise: bool = False,
    key: str = "cvegeo",
    **options,
) -> DataFrame:
    """Metrics of every feature set, model and held-out city, one row each.

    The boosted models of all sets, kinds and cities grow in the same passes; missing features stay
    missing. `options` go to `boost.fit`.
    """
    known = table.where(F.col("ordinal").isNotNull())
    chosen = {name: tuple(columns_of_set(table.columns, name)) for name in sets}
    features = sorted({c for columns in chosen.values() for c in columns})
    base = settled(standardise_by_group(known, features) if standardise else known)
    # a model per city is asked for, so cities are few
    cities = sorted(r["city"] for r in base.select("city").distinct().collect() if r["city"] is not None)
    tasks, held = [], []
    for name, kind, city in itertools.product(sets, kinds, cities if len(cities) > 1 else []):
        tasks.append(boost.Task(name, kind, chosen[name], frozenset(cities) - {city}))
        held.append(frozenset({city}))
    edges = boost.bin_edges(base, features)
    ensembles = boost.fit(base, "city", "ordinal", tasks, edges, **options)
    names = F.array(*[F.struct(F.lit(t.feature_set).alias("feature_set"), F.lit(t.kind).alias("model"), F.lit(len(t.features)).alias("n_features")) for t in tasks])
    predictions = boost.predict(base.select("city", "ordinal", *features), "city", ensembles, held, edges).select(
        names[F.col("task")].alias("t"), "city", "ordinal", "prediction"
    ).select("t.*", "city", "ordinal", "prediction")
    if blind:
        unseen = blind_predictions(base, key).select(
            F.lit("none").alias("feature_set"), "model", F.lit(0).alias("n_features"), "city", "ordinal", "prediction"
        )
        predictions = predictions.unionByName(unseen)
    keys = ["feature_set", "model", "n_features", "test_city"]
    folds = fold_metrics(settled(predictions.withColumnRenamed("city", "test_city")), keys)
    whole = base.agg(F.count("*")).scalar()
    return folds.select(*keys[:2], "test_city", "n_features", (whole - F.col("n")).alias("n_train"), F.col("n").alias("n_test"), *MEASURES)


def fold_summary(detail: DataFrame) -> DataFrame:
    """Means over the folds, to three decimals, best kappa first."""
    means = {m: F.bround(F.avg(m), 3) for m in MEASURES}
    return detail.groupBy("feature_set", "model").agg(*[v.alias(m) for m, v in means.items()]).orderBy(F.desc("kappa"), "feature_set", "model")


def evaluate_partition(
    table: DataFrame,
    partition: DataFrame,
    name: str,
    kind: str,
    measure_on: str = "test",
    *,
    resamples: int = 400,
    **options,
) -> DataFrame:
    """Trains on the training cities, measures on `val` or `test` ones.

    One row per metric: its value, and for those that a resample of cities can be measured on, the
    interval; beside it the numbers of rows and cities.
    """
    if measure_on not in ("val", "test"):
        raise KeyError(f"cannot measure on {measure_on!r}")
    columns = columns_of_set(table.columns, name)
    split = {s: frozenset(r["city"] for r in cities_of(partition, s).collect()) for s in ("train", measure_on)}
    base = settled(table.where(F.col("ordinal").isNotNull() & F.col("city").isin(*split["train"], *split[measure_on])))
    task = boost.Task(name, kind, tuple(columns), split["train"])
    edges = boost.bin_edges(base.where(F.col("city").isin(*split["train"])), columns)
    ensembles = boost.fit(base, "city", "ordinal", [task], edges, **options)
    measured = settled(boost.predict(base, "city", ensembles, [split[measure_on]], edges))
    sizes = [base.where(F.col("city").isin(*split[s])).count() for s in ("train", measure_on)]
    if not all(sizes):
        raise ValueError(f"{sizes[0]} training rows and {sizes[1]} of {measure_on}: the partition and the table share no cities")
    ends = metric_bootstrap(
        measured, "city", "ordinal", "prediction", "score", probabilities="probabilities", resamples=resamples
    )
    points = ordinal_metrics(measured, "ordinal", "prediction")
    bare = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "f1_macro", "mae_ordinal")])
    none = F.lit(None).cast("double")
    extra = points.select(F.explode(bare).alias("m")).select("m.*", none.alias("ci_low"), none.alias("ci_high"))
    return ends.unionByName(extra).select(
        "*",
        F.lit(sizes[0]).alias("n_train"),
        F.lit(sizes[1]).alias("n_measured"),
        F.lit(len(split[measure_on])).alias("cities_measured"),
    )


# ---- encoder slot -------------------------------------------------------------------------


def band_statistics(patch: np.ndarray, token: int) -> np.ndarray:
    """Default encoder: mean and deviation of every band in each token, gaps left out."""
    bands, side, _ = patch.shape
    n = side // token
    cells = patch.reshape(bands, n, token, n, token).transpose(1, 3, 0, 2, 4).reshape(n * n, bands, -1)
    seen = np.isfinite(cells)
    count = np.maximum(seen.sum(axis=2), 1)
    mean = np.where(seen, cells, 0.0).sum(axis=2) / count
    dev = np.sqrt((np.where(seen, cells - mean[:, :, None], 0.0) ** 2).sum(axis=2) / count)
    return np.concatenate([mean, dev], axis=1)


def encode_windows(
    pixels: DataFrame, windows: DataFrame, bands: Sequence[str], encoder=band_statistics, token: int = 16
) -> DataFrame:
    """One vector per token of each window from a user function `(bands, side, side) -> tokens`.

    A group is one window, so its size is fixed; pixels reach it through their token cell.
    """
    order = {b: i for i, b in enumerate(bands)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side, y0, x0 = int(pdf["size"].iloc[0]), int(pdf["wy"].iloc[0]), int(pdf["wx"].iloc[0])
        patch = np.full((len(order), side, side), np.nan)
        patch[pdf["band"].map(order), pdf["r"] - y0, pdf["c"] - x0] = pdf["value"]
        out = encoder(patch, token)
        n = side // token
        j = np.arange(n * n)
        return pd.DataFrame(
            {
                "box": pdf["box"].iloc[0],
                "win": pdf["win"].iloc[0],
                "j": j,
                "y0": y0 + j // n * token,
                "x0": x0 + j % n * token,
                "vec": list(out),
            }
        )

    cells = window_tokens(windows, token).select("box", "win", "y0", "x0")
    placed = pixels.where(F.col("band").isin(*bands)).select(
        "box",
        "band",
        "r",
        "c",
        "value",
        F.expr(f"r div {token} * {token}").alias("y0"),
        F.expr(f"c div {token} * {token}").alias("x0"),
    )
    corners = windows.select("box", "win", "size", F.col("y0").alias("wy"), F.col("x0").alias("wx"))
    fed = placed.join(cells, ["box", "y0", "x0"]).join(corners, ["box", "win"])
    box_type = dict(pixels.dtypes)["box"]
    return fed.groupBy("box", "win").applyInPandas(
        run, f"box {box_type}, win bigint, j bigint, y0 bigint, x0 bigint, vec array<double>"
    )
