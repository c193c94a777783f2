"""Rank correlation, areas under the curve and ordinal metrics, pooled or per group.

Everything works on counts of distinct values, so ties are merged before the shuffle, and
goes through the skew-safe running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.operators.labels import HIGH
from tractlens.operators.scale import mid_ranks, running_totals, settled

MIN_TOKENS = 20
MIN_TRACTS = 5


def spearman(
    df: DataFrame,
    x: str,
    y: str,
    group: Sequence[str] = (),
    *,
    min_rows: int = 2,
    weight: str | None = None,
    min_x_levels: int = 1,
) -> DataFrame:
    """Spearman correlation with average ties: group columns, `n`, `rho`.

    Groups below `min_rows` or with a single value of `y` are left out; a constant `x` gives null.
    """
    group = list(group)
    return rank_correlation(ranked_cells(df, x, y, group, weight), group, min_rows, min_x_levels)


def ranked_cells(df: DataFrame, x: str, y: str, group: Sequence[str], weight: str | None = None) -> DataFrame:
    """Counts `_c` of distinct (`_x`, `_y`) with the average-tie ranks `_r_x`, `_r_y` of both sides.

    Both sides are ranked in one walk.
    """
    group = list(group)
    size = F.lit(1) if weight is None else F.col(weight)
    cells = settled(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*group, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.sum(size).cast("long").alias("_c"))
    )
    sides = F.explode(F.array(*[F.struct(F.lit(v).alias("_side"), F.col(v).cast("double").alias("_v")) for v in ("_x", "_y")]))
    counts = (
        cells.select(*group, "_c", sides.alias("_s"))
        .groupBy(*group, F.col("_s._side").alias("_side"), F.col("_s._v").alias("_v"))
        .agg(F.sum("_c").alias("_k"))
    )
    ranks = mid_ranks(counts, [*group, "_side"], "_v", "_k", "_r").drop("_k")
    ranked = cells
    for v in ("_x", "_y"):
        side = ranks.where(F.col("_side") == v).select(*group, F.col("_v").alias(f"_v{v}"), F.col("_r").alias(f"_r{v}"))
        ranked = ranked.withColumn(f"_v{v}", F.col(v).cast("double")).join(side, [*group, f"_v{v}"])
    return ranked


def auroc_of_ranks(positive: Column) -> Column:
    """Area under the curve of `_x` in ranked cells, as an aggregate; null where a class is empty."""
    c = F.col("_c").cast("double")
    hits, rest = F.sum(F.when(positive, c).otherwise(0.0)), F.sum(F.when(positive, 0.0).otherwise(c))
    ranks = F.sum(F.when(positive, c * F.col("_r_x")).otherwise(0.0))
    return F.when((hits > 0) & (rest > 0), (ranks - hits * (hits + 1) / 2.0) / (hits * rest))


def rank_correlation(ranked: DataFrame, group: Sequence[str], min_rows: int = 2, min_x_levels: int = 1) -> DataFrame:
    """Correlation of the ranks of `ranked_cells`, per group."""
    c, rx, ry = F.col("_c").cast("double"), F.col("_r_x"), F.col("_r_y")
    sums = ranked.groupBy(*group).agg(
        F.sum("_c").alias("n"),
        F.sum(c * rx * ry).alias("_xy"),
        F.sum(c * rx * rx).alias("_xx"),
        F.sum(c * ry * ry).alias("_yy"),
        F.min("_x").alias("_x0"),
        F.max("_x").alias("_x1"),
        F.min("_y").alias("_y0"),
        F.max("_y").alias("_y1"),
    )
    n = F.col("n").cast("double")
    mean2 = n * ((n + 1) / 2.0) * ((n + 1) / 2.0)
    spread = F.sqrt(F.greatest((F.col("_xx") - mean2) * (F.col("_yy") - mean2), F.lit(0.0)))
    rho = F.when(
        (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1")), F.try_divide(F.col("_xy") - mean2, spread)
    )
    kept = (F.col("n") >= min_rows) & (F.col("_y0") < F.col("_y1"))
    if min_x_levels > 1:
        kept = kept & (F.col("_x0") < F.col("_x1"))
    return sums.where(kept).select(*group, "n", rho.alias("rho"))


def auroc(
    df: DataFrame,
    score: str,
    positive: Column,
    group: Sequence[str] = (),
    *,
    weight: str | None = None,
    name: str = "auroc",
) -> DataFrame:
    """Area under the curve with half credit for ties; null where a class is empty."""
    size = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    hit = F.when(positive, size).otherwise(0.0)
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(*group, F.col(score).alias("_s"))
        .agg(F.sum(hit).alias("_p"), F.sum(size - hit).alias("_q"))
    )
    walked = running_totals(counts, group, [F.col("_s").asc()], {"_below": F.col("_q")})
    won = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") / 2.0))
    pairs = F.sum("_p") * F.sum("_q")
    return walked.groupBy(*group).agg(F.when(pairs > 0, won / pairs).alias(name))


def auroc_cumulative(
    df: DataFrame, score: str, truth: str, group: Sequence[str] = (), thresholds=(1, 2, 3, 4),
    weight: str | None = None,
) -> DataFrame:
    """One row per threshold "truth at least k" that has both classes, from one walk."""
    size = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    low = {k: F.when(F.col(truth) < k, size).otherwise(0.0) for k in thresholds}
    counts = df.groupBy(*group, F.col(score).alias("_s")).agg(
        F.sum(size).alias("_n"), *[F.sum(c).alias(f"_q{k}") for k, c in low.items()]
    )
    walked = running_totals(
        counts, group, [F.col("_s").asc()], {f"_b{k}": F.col(f"_q{k}") for k in thresholds}
    )
    sums = []
    for k in thresholds:
        q, p = F.col(f"_q{k}"), F.col("_n") - F.col(f"_q{k}")
        sums.append(
            F.struct(
                F.lit(k).alias("threshold"),
                F.sum(p * (F.col(f"_b{k}") - q / 2.0)).alias("won"),
                (F.sum(p) * F.sum(q)).alias("pairs"),
            )
        )
    wide = walked.groupBy(*group).agg(F.array(*sums).alias("_all"))
    return (
        wide.select(*group, F.explode("_all").alias("_t"))
        .where("_t.pairs > 0")
        .select(*group, F.col("_t.threshold").alias("threshold"), (F.col("_t.won") / F.col("_t.pairs")).alias("auroc"))
    )


def auroc_one_vs_rest(
    df: DataFrame, score: str, truth: str, group: Sequence[str] = (), classes: int = 5,
    weight: str | None = None,
) -> DataFrame:
    """Each class against the rest; the evidence of a scalar score for class k is -|s - k|."""
    carry = [] if weight is None else [weight]
    marks = F.array(
        *[
            F.struct(F.lit(k).alias("k"), (-F.abs(F.col(score) - F.lit(float(k)))).alias("mark"))
            for k in range(classes)
        ]
    )
    long = df.select(*group, truth, *carry, F.explode(marks).alias("_m")).select(
        *group, truth, *carry, F.col("_m.k").alias("class"), F.col("_m.mark").alias("mark")
    )
    return auroc(long, "mark", F.col(truth) == F.col("class"), [*group, "class"], weight=weight).where(
        F.col("auroc").isNotNull()
    )


def auroc_per_class(df: DataFrame, probabilities: str, truth: str, *, cumulative: bool = False) -> DataFrame:
    """Area under the curve of each entry of a probability array against its own target."""
    long = df.select(truth, F.posexplode(probabilities).alias("k", "p"))
    target = F.col(truth) >= F.col("k") + 1 if cumulative else F.col(truth) == F.col("k")
    return auroc(long, "p", target, ["k"]).where(F.col("auroc").isNotNull())


def auroc_top_quartile(df: DataFrame, score: str, truth: str, group: Sequence[str] = ()) -> DataFrame:
    """Area under the curve for rows at or above the third quartile of the truth."""
    from tractlens.operators.scale import exact_percentiles

    if group:
        cut = exact_percentiles(df, group, truth, {"_cut": 0.75})
        marked = df.join(cut, list(group))
    else:
        marked = df.withColumn("_cut", exact_percentiles(df, [], truth, {"_cut": 0.75}).scalar())
    return auroc(marked, score, F.col(truth) >= F.col("_cut"), group)


def ordinal_sums(truth: str, prediction: str, classes: int = 5, weight: Column | None = None) -> list[Column]:
    """Additive sums from which kappa, accuracy, macro F1 and ordinal error follow."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    t, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    out = [
        F.sum(w).alias("_n"),
        F.sum(w * t).alias("_t"),
        F.sum(w * p).alias("_p"),
        F.sum(w * t * t).alias("_tt"),
        F.sum(w * p * p).alias("_pp"),
        F.sum(w * (t - p) * (t - p)).alias("_dd"),
        F.sum(w * F.abs(t - p)).alias("_ad"),
        F.sum(F.when(t == p, w).otherwise(0.0)).alias("_hit"),
    ]
    for k in range(classes):
        out += [
            F.sum(F.when((t == k) & (p == k), w).otherwise(0.0)).alias(f"_h{k}"),
            F.sum(F.when(t == k, w).otherwise(0.0) + F.when(p == k, w).otherwise(0.0)).alias(f"_m{k}"),
        ]
    return out


def kappa_of_sums() -> Column:
    n = F.col("_n")
    chance = F.col("_tt") + F.col("_pp") - 2.0 * F.col("_t") * F.col("_p") / n
    return 1.0 - F.try_divide(F.col("_dd"), chance)


def metrics_of_sums(group: Sequence[str], classes: int = 5) -> list[Column]:
    n = F.col("_n")
    f1 = [F.when(F.col(f"_m{k}") > 0, 2.0 * F.col(f"_h{k}") / F.col(f"_m{k}")) for k in range(classes)]
    total = sum((F.coalesce(f, F.lit(0.0)) for f in f1), F.lit(0.0))
    present = sum((f.isNotNull().cast("double") for f in f1), F.lit(0.0))
    return [
        *[F.col(g) for g in group],
        n.cast("long").alias("n"),
        kappa_of_sums().alias("kappa"),
        (F.col("_hit") / n).alias("accuracy"),
        F.try_divide(total, present).alias("f1_macro"),
        (F.col("_ad") / n).alias("mae_ordinal"),
    ]


def ordinal_metrics(
    df: DataFrame, truth: str, prediction: str, group: Sequence[str] = (), classes: int = 5
) -> DataFrame:
    """Quadratic kappa, accuracy, macro F1 and mean ordinal error in one aggregate.

    The expected disagreement under independence has a closed form in the moments, so no
    table of marginals is crossed with another.
    """
    return df.groupBy(*group).agg(*ordinal_sums(truth, prediction, classes)).select(
        *metrics_of_sums(group, classes)
    )


# ---- maps ---------------------------------------------------------------------------------


def token_means(scores: DataFrame) -> DataFrame:
    """Mean over seeds of each token's score."""
    return scores.groupBy("city", "municipality", "cvegeo", "y0", "x0").agg(F.avg("score").alias("score"))


def tract_means(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("city", "municipality", "cvegeo").agg(F.avg("score").alias("score"))


def tract_seed_table(scores: DataFrame) -> DataFrame:
    """Per tract: mean, spread and number of the per-seed tract means."""
    return (
        scores.groupBy("seed", "city", "municipality", "cvegeo")
        .agg(F.avg("score").alias("s"))
        .groupBy("city", "municipality", "cvegeo")
        .agg(F.avg("s").alias("score"), F.stddev_samp("s").alias("spread"), F.count("*").alias("seeds"))
    )


def within(scores: DataFrame, grades: DataFrame, by: Sequence[str] = (), tracts: bool = True) -> DataFrame:
    """Per municipality: rank correlation of token and of tract scores with the grade.

    `by` names further columns of `scores`, such as the map a score comes from; all are ranked in
    the same walk. Without `tracts` only tokens are ranked, from one pass over them, and the
    correlation of tracts is left out.
    """
    keys = [*by, "city", "municipality"]
    means = scores.groupBy(*keys, "cvegeo", "y0", "x0").agg(F.avg("score").alias("score"))
    tokens = means.join(grades.select("cvegeo", "ordinal"), "cvegeo").where("ordinal IS NOT NULL")
    if not tracts:
        rhos = spearman(tokens, "score", "ordinal", keys)
        return rhos.where(F.col("n") >= MIN_TOKENS).select(*keys, F.col("rho").alias("token"))
    tokens = settled(tokens)
    by_tract = tokens.groupBy(*keys, "cvegeo").agg(F.avg("score").alias("score"), F.max("ordinal").alias("ordinal"))
    columns = [*keys, "score", "ordinal"]
    both = tokens.select(F.lit("token").alias("unit"), *columns).unionByName(
        by_tract.select(F.lit("tract").alias("unit"), *columns)
    )
    rhos = spearman(both, "score", "ordinal", ["unit", *keys])
    token = (F.col("unit") == "token") & (F.col("n") >= MIN_TOKENS)
    tract = (F.col("unit") == "tract") & (F.col("n") >= MIN_TRACTS)
    return (
        rhos.groupBy(*keys)
        .agg(
            F.max(F.when(token, F.col("rho"))).alias("token"),
            F.max(F.when(tract, F.col("rho"))).alias("tract"),
            F.max(token).alias("_measured"),
        )
        .where("_measured")
        .drop("_measured")
    )


def evaluate_map(tokens: DataFrame, bag_shares: DataFrame) -> DataFrame:
    """One row: bag error, pooled and within-bag rank quality, counts.

    `tokens` carries municipality, cvegeo, ordinal (null = unknown) and `shares`, the four
    predicted cumulative shares; `bag_shares` the labelled shares of each municipality.
    """
    predicted = tokens.select("municipality", F.posexplode("shares").alias("k", "p")).groupBy(
        "municipality", "k"
    ).agg(F.avg("p").alias("predicted"))
    labelled = bag_shares.select("municipality", F.posexplode("shares").alias("k", "labelled"))
    mae = predicted.join(labelled, ["municipality", "k"]).agg(
        F.avg(F.abs(F.col("predicted") - F.col("labelled"))).alias("bag_mae")
    )
    scored = tokens.where("ordinal IS NOT NULL").select(
        "municipality",
        "cvegeo",
        "ordinal",
        F.aggregate("shares", F.lit(0.0), lambda a, p: a + p).alias("score"),
    )
    tracts = scored.groupBy("municipality", "cvegeo").agg(
        F.avg("score").alias("score"), F.max("ordinal").alias("ordinal")
    )
    # tokens by bag, tracts by bag and all tokens are ranked in one walk
    columns = ["municipality", "score", "ordinal"]
    long = (
        scored.select(F.lit("bag").alias("unit"), *columns)
        .unionByName(tracts.select(F.lit("tract").alias("unit"), *columns))
        .unionByName(scored.select(F.lit("all").alias("unit"), F.lit("").alias("municipality"), "score", "ordinal"))
    )
    keys = ["unit", "municipality"]
    cells = settled(ranked_cells(long, "score", "ordinal", keys))
    rhos = rank_correlation(cells, keys)
    is_bag = (F.col("unit") == "bag") & (F.col("n") >= MIN_TOKENS)
    is_tract = (F.col("unit") == "tract") & (F.col("n") >= MIN_TRACTS)
    per_bag = rhos.groupBy("municipality").agg(
        F.max(F.when(is_bag, F.col("rho"))).alias("bag"),
        F.max(is_bag).alias("bag_scored"),
        F.max(F.when(is_tract, F.col("rho"))).alias("tract"),
        # a bag enters the tract figure only if it entered the token figure
        (F.max(is_bag) & F.max(is_tract)).alias("tract_scored"),
        F.max(F.when(F.col("unit") == "all", F.col("rho"))).alias("pooled"),
    )
    summary = per_bag.agg(
        F.max("pooled").alias("spearman_pooled"),
        F.avg("bag").alias("spearman_within"),
        F.avg(F.when(F.col("tract_scored"), F.col("tract"))).alias("spearman_within_tract"),
        F.count_if("bag_scored").alias("bags_scored"),
        F.count_if("tract_scored").alias("bags_scored_tract"),
    )
    whole = cells.where("unit = 'all'").agg(
        auroc_of_ranks(F.col("_y") >= HIGH).alias("auroc_high"), F.coalesce(F.sum("_c"), F.lit(0)).alias("instances")
    )
    # three tables of one row
    return mae.crossJoin(whole).crossJoin(summary).select(
        "bag_mae",
        "auroc_high",
        "spearman_pooled",
        "spearman_within",
        "spearman_within_tract",
        "bags_scored",
        "bags_scored_tract",
        "instances",
    )


def attention_mass(tokens: DataFrame, weight: str = "attention") -> DataFrame:
    """Attention summed per tract of a bag."""
    return tokens.groupBy("municipality", "cvegeo").agg(F.sum(weight).alias("attention"))


def score_heatmap(mass: DataFrame, grades: DataFrame, min_tracts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Attention against grades: per-bag detail, and one summary row.

    Pooling normalises the attention of the graded tracts of each bag to one.
    """
    known = mass.join(grades.select("cvegeo", "ordinal"), "cvegeo")
    sizes = known.groupBy("municipality").agg(
        F.count("*").alias("tracts"), F.sum("attention").alias("whole")
    )
    usable = known.join(sizes.where(F.col("tracts") >= min_tracts), "municipality").withColumn(
        "share", F.col("attention") / F.col("whole")
    )
    detail = spearman(usable, "attention", "ordinal", ["municipality"]).select(
        "municipality", F.col("n").alias("tracts"), F.col("rho").alias("spearman")
    )
    summary = usable.agg(F.count("*").alias("tracts_scored")).select(
        detail.agg(F.avg("spearman")).scalar().alias("spearman_mean"),
        spearman(usable, "share", "ordinal").select("rho").scalar().alias("spearman_pooled"),
        auroc(usable, "share", F.col("ordinal") >= HIGH).scalar().alias("auroc_high"),
        detail.agg(F.count("*")).scalar().alias("bags_scored"),
        "tracts_scored",
    )
    return detail, summary
