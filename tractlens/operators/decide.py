"""Decisions from a map: targeting, selective use, conformal intervals, audits, borders, MAUP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.functions.hashing import hash_order
from tractlens.operators import isotonic
from tractlens.operators.labels import HIGH
from tractlens.operators.ranks import auroc_cumulative, ordinal_metrics, spearman
from tractlens.operators.resample import RESAMPLES, clustered_mean, draws
from tractlens.operators.scale import (
    exact_percentiles,
    numbered_of,
    running_totals,
    settled,
    with_stats,
)

MIN_TRACTS = 20
DISCARD_STEPS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
COVERAGE = 0.90
BUDGETS = (0.05, 0.10, 0.20, 0.30)
TIE_DRAWS = 200
CLASS_ROWS = 4096
"""Rows of a tie class that one task puts in order; larger ones are narrowed down first."""
MAUP_BINS = ((1, 3), (4, 9), (10, 19), (20, 49), (50, None))


# ---- isotonic grade map -------------------------------------------------------------------


def fit_isotonic(calibration: DataFrame, score: str = "score", truth: str = "ordinal") -> DataFrame:
    """Monotone map from score to grade: the blocks of an isotonic fit."""
    return isotonic.fit(calibration, score, truth)


def predict_isotonic(blocks: DataFrame, table: DataFrame, score: str = "score", name: str = "predicted") -> DataFrame:
    """Interpolates between the fitted blocks and holds the ends outside them."""
    return isotonic.predict(blocks, table, score, name)


def usable(frame: DataFrame, min_rows: int = MIN_TRACTS) -> DataFrame:
    """Rows of municipalities with enough tracts and more than one grade."""
    good = frame.groupBy("municipality").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")
    ).where((F.col("n") >= min_rows) & (F.col("a") < F.col("b")))
    return frame.join(good.select("municipality"), "municipality", "left_semi")


def spread_error_correlation(frame: DataFrame) -> DataFrame:
    """Per municipality: rank correlation of seed spread with the absolute error of `predicted`."""
    marked = usable(frame).withColumn("error", F.abs(F.col("predicted") - F.col("ordinal")))
    return spearman(
        marked.where(F.col("spread").isNotNull()),
        "error",
        "spread",
        ["city", "municipality"],
    )


def spread_knows_error(frame: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    rhos = spread_error_correlation(frame)
    return clustered_mean(rhos, "city", "rho", resamples=resamples).select(
        F.col("members").alias("municipalities"),
        F.col("mean").alias("rho_spread_error"),
        "ci_low",
        "ci_high",
    )


def selective_curve(
    frame: DataFrame,
    steps: Sequence[float] = DISCARD_STEPS,
    min_rows: int = MIN_TRACTS,
    resamples: int = RESAMPLES,
) -> DataFrame:
    """Map quality as the least certain tracts of each municipality are set aside.

    The panel is fixed to the municipalities that stay measurable at every step.
    """
    placed = numbered_of(
        usable(frame, min_rows),
        ["municipality"],
        [F.col("spread").asc_nulls_last(), F.col("cvegeo").asc()],
        "_i",
        "_n",
    )
    fractions = F.array(*[F.lit(float(s)) for s in steps])
    kept = placed.withColumn("discarded", F.explode(fractions)).where(
        F.col("_i") <= F.bround(F.col("_n") * (1.0 - F.col("discarded")))
    )
    steady = (
        kept.groupBy("municipality", "discarded")
        .agg(F.count("*").alias("k"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
        .where((F.col("k") >= min_rows) & (F.col("a") < F.col("b")))
        .groupBy("municipality")
        .agg(F.count("*").alias("held"))
        .where(F.col("held") == len(steps))
    )
    panel = kept.join(steady, "municipality", "left_semi")
    rhos = settled(spearman(panel, "score", "ordinal", ["discarded", "city", "municipality"]))
    drawn = draws(rhos, "city", resamples)
    return clustered_mean(rhos, "city", "rho", ["discarded"], drawn=drawn).select(
        "discarded",
        F.col("members").alias("municipalities"),
        F.col("mean").alias("rho_within"),
        "ci_low",
        "ci_high",
    )


# ---- conformal ----------------------------------------------------------------------------


def conformal_widths(calibration: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Half widths: finite-sample quantile of all residuals, and quantile over city quantiles."""
    level = F.least(F.lit(1.0), F.ceil((F.col("_n") + 1) * F.lit(coverage)) / F.col("_n"))
    marginal = exact_percentiles(calibration, [], "residual", {"half_width": level})
    cities = exact_percentiles(calibration, ["city"], "residual", {"q": coverage})
    clustered = exact_percentiles(cities, [], "q", {"half_width": coverage})
    return settled(
        marginal.select(F.lit("marginal").alias("rule"), "half_width").unionByName(
            clustered.select(F.lit("clustered").alias("rule"), "half_width")
        )
    )


def conformal_by_city(calibration: DataFrame, evaluation: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Covered share per city and rule."""
    widths = conformal_widths(calibration, coverage).agg(
        F.max(F.when(F.col("rule") == "marginal", F.col("half_width"))).alias("m"),
        F.max(F.when(F.col("rule") == "clustered", F.col("half_width"))).alias("c"),
    )
    rules = F.array(
        F.struct(F.lit("marginal").alias("rule"), widths.select("m").scalar().alias("w")),
        F.struct(F.lit("clustered").alias("rule"), widths.select("c").scalar().alias("w")),
    )
    # per city only counts remain before the two rules are laid side by side
    per_city = evaluation.groupBy("city").agg(
        F.count("*").alias("tracts"),
        *[
            F.sum((F.col("residual") <= widths.select(n).scalar()).cast("long")).alias(f"in_{n}")
            for n in ("m", "c")
        ],
    )
    return per_city.withColumn("r", F.explode(rules)).select(
        F.col("r.rule").alias("rule"),
        "city",
        F.col("r.w").alias("half_width"),
        "tracts",
        F.when(F.col("r.rule") == "marginal", F.col("in_m")).otherwise(F.col("in_c")).alias("covered"),
    )


def conformal(calibration: DataFrame, evaluation: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    per_city = conformal_by_city(calibration, evaluation, coverage).withColumn(
        "share", F.col("covered") / F.col("tracts").cast("double")
    )
    return per_city.groupBy("rule").agg(
        F.max("half_width").alias("half_width"),
        (F.sum("covered") / F.sum("tracts").cast("double")).alias("coverage"),
        F.min("share").alias("worst_city_coverage"),
        F.min_by("city", F.struct("share", "city")).alias("worst_city"),
        F.max("share").alias("best_city_coverage"),
        F.sum((F.col("share") < coverage).cast("long")).alias("cities_below_nominal"),
        F.count("*").alias("cities"),
    )


def city_audit(frame: DataFrame, min_rows: int = MIN_TRACTS) -> DataFrame:
    """Every city with its map quality, worst first by `place`."""
    rhos = (
        spearman(frame, "score", "ordinal", ["city", "municipality"], min_rows=min_rows)
        .groupBy("city")
        .agg(F.count("*").alias("municipalities"), F.avg("rho").alias("rho_within"))
    )
    facts = frame.groupBy("city").agg(
        F.count("*").alias("tracts"),
        F.countDistinct("ordinal").alias("grades_present"),
        F.avg((F.col("ordinal") >= HIGH).cast("double")).alias("share_high"),
    )
    middle = exact_percentiles(frame, ["city"], "spread", {"median_spread": 0.5})
    joined = rhos.join(facts, "city").join(middle, "city", "left")
    return running_totals(
        joined, [], [F.col("rho_within").asc(), F.col("city").asc()], {"place": F.lit(1).cast("long")}
    )


def cities_of_two_systems(within: DataFrame, base: str, other: str) -> DataFrame:
    """Mean quality inside the municipalities of each city that both systems measure, side by side."""
    mean = {n: F.avg(F.when(F.col("system") == s, F.col("token"))) for n, s in (("base", base), ("other", other))}
    both = within.groupBy("city").agg(*[c.alias(n) for n, c in mean.items()]).where("base IS NOT NULL AND other IS NOT NULL")
    return both.withColumn("difference", F.col("other") - F.col("base"))


def best_and_median_city(audit: DataFrame) -> DataFrame:
    """The best city and the middle one of the ordered list."""
    audit = settled(audit)
    size = audit.agg(F.count("*")).scalar()
    role = F.when(F.col("place") == size, "best").when(F.col("place") == F.floor(size / 2) + 1, "median")
    return audit.withColumn("role", role).where(F.col("role").isNotNull()).select("role", "city", "rho_within")


def classification_view(frame: DataFrame, calibration: DataFrame) -> DataFrame:
    """Ordinal metrics and threshold areas of the isotonic grade."""
    # the fit, the prediction and every metric read them, so each is made once
    same, frame = calibration is frame, settled(frame)
    predicted = predict_isotonic(fit_isotonic(frame if same else calibration), frame).withColumn(
        "grade", F.least(F.greatest(F.bround("predicted"), F.lit(0.0)), F.lit(4.0)).cast("int")
    )
    predicted = settled(predicted)
    areas = auroc_cumulative(predicted, "score", "ordinal").select(
        F.concat(F.lit("auroc_ge_"), F.col("threshold").cast("string")).alias("metric"), F.col("auroc").alias("value")
    )
    metrics = ordinal_metrics(predicted, "ordinal", "grade")
    named = ("kappa", "accuracy", "f1_macro", "mae_ordinal")
    long = metrics.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in named])).alias("m")
    ).select("m.metric", "m.value")
    return long.unionByName(areas)


# ---- unit size and borders ----------------------------------------------------------------


def maup_curve(scores: DataFrame, truth: DataFrame, bins=MAUP_BINS, min_tracts: int = 10) -> DataFrame:
    """Within-municipality correlation by how many tokens a tract holds."""
    per_seed = settled(
        scores.groupBy("seed", "city", "municipality", "cvegeo").agg(F.sum("score").alias("s"), F.count("*").alias("rows"))
    )
    seeds = per_seed.agg(F.countDistinct("seed")).scalar()
    per_tract = per_seed.groupBy("city", "municipality", "cvegeo").agg(
        (F.sum("s") / F.sum("rows")).alias("score"), F.sum("rows").alias("rows")
    )
    table = (
        per_tract.withColumn("tokens", F.floor(F.col("rows") / seeds))
        .join(truth.select("cvegeo", "ordinal", "population"), "cvegeo")
        .where("ordinal IS NOT NULL")
    )
    bin_of = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bins):
        inside = F.col("tokens") >= low if high is None else F.col("tokens").between(low, high)
        bin_of = F.when(inside, F.lit(i)).otherwise(bin_of)
    binned = settled(table.withColumn("bin", bin_of).where(F.col("bin").isNotNull()))
    rhos = spearman(binned, "score", "ordinal", ["bin", "municipality"], min_rows=min_tracts)
    lows = F.array(*[F.lit(b[0]) for b in bins])
    highs = F.array(*[F.lit(b[1]).cast("int") for b in bins])  # the last bin is open
    every = scores.sparkSession.range(len(bins)).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(binned.groupBy("bin").agg(F.count("*").alias("tracts")), "bin", "left")
        .join(exact_percentiles(binned, ["bin"], "population", {"median_population": 0.5}), "bin", "left")
        .join(
            rhos.groupBy("bin").agg(F.count("*").alias("municipalities"), F.avg("rho").alias("spearman_within")),
            "bin",
            "left",
        )
        .select(
            F.element_at(lows, F.col("bin") + 1).alias("tokens_low"),
            F.element_at(highs, F.col("bin") + 1).alias("tokens_high"),
            F.coalesce("tracts", F.lit(0)).cast("long").alias("tracts"),
            "median_population",
            F.coalesce("municipalities", F.lit(0)).cast("long").alias("municipalities"),
            "spearman_within",
        )
    )


def border_excess(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Mean jump across a border of equal grade minus the mean jump inside one tract.

    The point estimate pools the pairs; the interval resamples the per-city means.
    """
    same_m, same_t, same_g = F.col("same_municipality"), F.col("same_tract"), F.col("same_grade")
    rules = {
        "municipal": ~same_m & same_g,
        "tract": ~same_t & same_m & same_g,
    }
    out = None
    sums = pairs.groupBy("city").agg(
        F.avg(F.when(same_t, F.col("jump"))).alias("ref"),
        F.sum(F.when(same_t, F.col("jump"))).alias("ref_s"),
        F.count(F.when(same_t, 1)).alias("ref_n"),
        *[F.avg(F.when(c, F.col("jump"))).alias(f"{n}") for n, c in rules.items()],
        *[F.sum(F.when(c, F.col("jump"))).alias(f"{n}_s") for n, c in rules.items()],
        *[F.count(F.when(c, 1)).alias(f"{n}_n") for n, c in rules.items()],
    )
    sums = settled(sums)
    for name in rules:
        crossed = sums.where(F.col(name).isNotNull())
        drawn = draws(crossed, "city", resamples, seed)
        t = F.col("times")
        weighted = lambda c: F.sum(F.col(c) * t) / F.sum(F.when(F.col(c).isNotNull(), t))
        deltas = (
            drawn.join(crossed, "city")
            .groupBy("replicate")
            .agg((weighted(name) - weighted("ref")).alias("delta"))
        )
        ends = deltas.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
        row = sums.agg(
            (
                F.sum(f"{name}_s") / F.sum(f"{name}_n") - F.sum("ref_s") / F.sum("ref_n")
            ).alias("excess")
        ).select(
            F.lit(name).alias("crossing"),
            "excess",
            ends.select(F.col("e")[0]).scalar().alias("ci_low"),
            ends.select(F.col("e")[1]).scalar().alias("ci_high"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# ---- targeting ----------------------------------------------------------------------------


def _funded(room: Column, before: Column) -> Column:
    """Share of a tract's people funded: the marginal tract is funded in part."""
    share = (room - before) / F.when(F.col("population") > 0, F.col("population"))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0))


def reached(
    tracts: DataFrame, group: Sequence[str], orders: dict[str, Sequence[str]], budgets: Sequence[float] = BUDGETS
) -> DataFrame:
    """Deprived people reached by funding the top of each ordering: a row per group and budget.

    `orders` names one or two columns, largest first, for every result column; ties go by key. All
    orderings are walked at once.
    """
    group = list(group)
    laid = F.array(
        *[
            F.struct(
                F.lit(name).alias("_order"),
                F.col(columns[0]).cast("double").alias("_o1"),
                (F.col(columns[1]).cast("double") if len(columns) > 1 else F.lit(0.0)).alias("_o2"),
            )
            for name, columns in orders.items()
        ]
    )
    long = tracts.select(*group, "cvegeo", "ordinal", "population", F.explode(laid).alias("_l")).select(
        *group, "cvegeo", "ordinal", "population", "_l.*"
    )
    walked = running_totals(
        long,
        ["_order", *group],
        [F.col("_o1").desc(), F.col("_o2").desc(), F.col("cvegeo").asc()],
        {"_cum": F.col("population")},
        {"_all": F.col("population")},
    )
    before = F.col("_cum") - F.col("population")
    per_budget = [
        F.struct(F.lit(float(b)).alias("budget"), F.sum(_deprived() * _funded(F.col("_all") * b, before)).alias("reached"))
        for b in budgets
    ]
    wide = walked.groupBy(*group, "_order").agg(F.array(*per_budget).alias("_b")).select(*group, "_order", F.explode("_b").alias("_b"))
    return wide.groupBy(*group, F.col("_b.budget").alias("budget")).agg(
        *[F.max(F.when(F.col("_order") == name, F.col("_b.reached"))).alias(name) for name in orders]
    )


def _deprived() -> Column:
    return F.when(F.col("ordinal") >= HIGH, F.col("population")).otherwise(0.0)


def reached_with_random_ties(
    tracts: DataFrame,
    group: Sequence[str],
    tie: str,
    name: str,
    budgets: Sequence[float] = BUDGETS,
    tie_draws: int = TIE_DRAWS,
    seed: int = 0,
    class_rows: int = CLASS_ROWS,
) -> DataFrame:
    """The same for an ordering with large ties, averaged over random orders inside them.

    Tie classes wholly inside or outside a budget do not depend on the draw. Only a class that a
    budget ends in is drawn, once for all budgets that end in it. A row's place in a draw is a hash;
    where a class holds more than `class_rows` rows, histograms of the hash, two digits at a time,
    narrow down where each budget ends, and only rows with that beginning are put in order.
    """
    group = list(group)
    classes = tracts.groupBy(*group, tie).agg(
        F.sum("population").alias("_pop"), F.sum(_deprived()).alias("_dep"), F.count("*").alias("_rows")
    )
    walked = running_totals(
        classes, group, [F.col(tie).desc()], {"_cum": F.col("_pop")}, {"_all": F.col("_pop")}
    )
    laid = settled(
        walked.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).withColumn(
            "_room", F.col("_all") * F.col("budget") - (F.col("_cum") - F.col("_pop"))
        )
    )
    whole = laid.groupBy(*group, "budget").agg(
        F.sum(F.when(F.col("_room") >= F.col("_pop"), F.col("_dep")).otherwise(0.0)).alias("_whole")
    )
    edge = laid.where((F.col("_room") > 0) & (F.col("_room") < F.col("_pop")))
    largest = edge.agg(F.max("_rows")).first()[0] or 0
    draw = F.explode(F.sequence(F.lit(0), F.lit(tie_draws - 1))).alias("_draw")
    here = [*group, tie, "_draw"]
    # a small stored table lies in a few tasks, and every row of it becomes `tie_draws` rows; adaptive
    # execution keeps a number of partitions that is asked for
    parts = int(tracts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = (
        tracts.select(*group, tie, "cvegeo", "population", _deprived().alias("_dep"))
        .join(edge.select(*group, tie).distinct(), [*group, tie])
        .repartition(parts, "cvegeo")
        .select("*", draw)
        .withColumn("_key", hash_order(seed, F.col("_draw"), F.col("cvegeo")))
    )
    open_cuts = edge.select(*group, tie, "budget", "_room", F.lit("").alias("_prefix"), draw)
    parts = []
    digits = 0
    while largest > class_rows:
        digits, largest = digits + 2, largest / 256
        cuts = settled(open_cuts)
        begun = drawn.withColumn("_prefix", F.substring("_key", 1, digits - 2))
        if digits > 2:  # before the first two digits every draw is open
            begun = begun.join(cuts.select(*here, "_prefix").distinct(), [*here, "_prefix"], "left_semi")
        bins = (
            begun.groupBy(*here, "_prefix", F.substring("_key", 1, digits).alias("_next"))
            .agg(F.sum("population").alias("_p"), F.sum("_dep").alias("_d"))
        )
        # at most 256 bins below a prefix
        below = W.partitionBy(*here, "_prefix").orderBy("_next").rowsBetween(W.unboundedPreceding, W.currentRow)
        met = settled(
            bins.withColumn("_before", F.sum("_p").over(below) - F.col("_p")).join(cuts, [*here, "_prefix"])
        )
        inside = F.col("_before") + F.col("_p") <= F.col("_room")
        parts.append(met.where(inside).select(*group, "budget", F.col("_d").alias("_part")))
        open_cuts = met.where(~inside & (F.col("_before") < F.col("_room"))).select(
            *group, tie, "budget", (F.col("_room") - F.col("_before")).alias("_room"), F.col("_next").alias("_prefix"), "_draw"
        )
    cuts = settled(open_cuts) if digits else open_cuts
    last = drawn.withColumn("_prefix", F.substring("_key", 1, digits))
    if digits:
        last = last.join(cuts.select(*here, "_prefix").distinct(), [*here, "_prefix"], "left_semi")
    # about `class_rows` rows at most
    inside = W.partitionBy(*here, "_prefix").orderBy("_key", "cvegeo").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = last.withColumn("_before", F.sum("population").over(inside) - F.col("population"))
    parts.append(
        ordered.join(cuts, [*here, "_prefix"]).select(
            *group, "budget", (F.col("_dep") * _funded(F.col("_room"), F.col("_before"))).alias("_part")
        )
    )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    drawn_mean = every.groupBy(*group, "budget").agg((F.sum("_part") / F.lit(float(tie_draws))).alias("_part"))
    return whole.join(drawn_mean, [*group, "budget"], "left").select(
        *group, "budget", (F.col("_whole") + F.coalesce("_part", F.lit(0.0))).alias(name)
    )


def _gap(table: DataFrame, top: str = "map", name: str = "gap_closed") -> DataFrame:
    gap = F.col("oracle") - F.col("aggregate")
    return table.withColumn(name, F.when(gap > 0, (F.col(top) - F.col("aggregate")) / gap))


def targeting(
    tracts: DataFrame,
    group: Sequence[str] = ("city",),
    budgets: Sequence[float] = BUDGETS,
    tie_draws: int = TIE_DRAWS,
) -> DataFrame:
    """Census, map and aggregate allocators per group and budget, with the gap closed."""
    keys = [*group, "budget"]
    table = settled(with_stats(tracts, ["municipality"], F.avg("ordinal").alias("aggregate_score")))
    known = reached(table, group, {"oracle": ["ordinal"], "map": ["score"]}, budgets)
    aggregate = reached_with_random_ties(table, group, "aggregate_score", "aggregate", budgets, tie_draws)
    return _gap(known.join(aggregate, keys))


def pooled_gap(cells: DataFrame) -> DataFrame:
    """People are summed before the ratio is taken."""
    pooled = cells.groupBy("budget").agg(*[F.sum(c).alias(c) for c in ("aggregate", "map", "oracle")])
    return pooled.withColumn(
        "gap_closed", F.try_divide(F.col("map") - F.col("aggregate"), F.col("oracle") - F.col("aggregate"))
    )


def gap_summary(cells: DataFrame) -> DataFrame:
    """Median of the per-group ratios and the cells where the map loses."""
    cells = settled(cells)
    losing = cells.groupBy("budget").agg(
        F.sum((F.col("map") < F.col("aggregate")).cast("long")).alias("losing"), F.count("*").alias("cells")
    )
    return losing.join(
        exact_percentiles(cells, ["budget"], "gap_closed", {"median_gap": 0.5}), "budget", "left"
    )


def in_several_municipalities(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """Cells of the cities that hold more than one municipality."""
    several = scores.groupBy("city").agg(F.countDistinct("municipality").alias("m")).where("m > 1")
    return cells.join(several, "city", "left_semi")


def targeting_by_municipality(
    tracts: DataFrame, budgets: Sequence[float] = BUDGETS, tie_draws: int = TIE_DRAWS, min_tracts: int = 5
) -> DataFrame:
    """Inside one municipality the aggregate says nothing, so its order is random throughout."""
    keys = ["city", "municipality"]
    good = tracts.groupBy(*keys).agg(
        F.countDistinct("cvegeo").alias("tracts"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")
    ).where((F.col("tracts") >= min_tracts) & (F.col("a") < F.col("b")))
    table = settled(tracts.join(good.select(*keys, "tracts"), keys).withColumn("_flat", F.lit(0)))
    known = reached(table, keys, {"oracle": ["ordinal"], "map": ["score"]}, budgets)
    aggregate = reached_with_random_ties(table, keys, "_flat", "aggregate", budgets, tie_draws)
    joined = known.join(aggregate, [*keys, "budget"])
    return _gap(joined.join(table.groupBy(*keys).agg(F.max("tracts").alias("tracts")), keys))


def targeting_national(
    tracts: DataFrame, budgets: Sequence[float] = BUDGETS, tie_draws: int = TIE_DRAWS
) -> DataFrame:
    """One national budget spent by four orderings."""
    table = settled(with_stats(tracts, ["municipality"], F.avg("ordinal").alias("aggregate_score")))
    orders = {"aggregate_then_map": ["aggregate_score", "score"], "map": ["score"], "census": ["ordinal"]}
    aggregate = reached_with_random_ties(table, [], "aggregate_score", "aggregate", budgets, tie_draws)
    joined = aggregate.join(reached(table, [], orders, budgets), "budget")
    gap = F.col("census") - F.col("aggregate")
    return joined.select(
        "*",
        F.try_divide(F.col("aggregate_then_map") - F.col("aggregate"), gap).alias("gap_closed_aggregate_then_map"),
        F.try_divide(F.col("map") - F.col("aggregate"), gap).alias("gap_closed_map"),
    )


def proportional_budget(per_municipality: DataFrame) -> DataFrame:
    """A budget per municipality in proportion to its people, spent inside it."""
    pooled = pooled_gap(per_municipality)
    return pooled.select(
        "budget",
        F.col("aggregate").alias("proportional_aggregate"),
        F.col("map").alias("proportional_map"),
        F.col("oracle").alias("proportional_census"),
        F.col("gap_closed").alias("gap_closed_proportional"),
    )
