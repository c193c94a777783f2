"""Paired comparisons of maps with each other and with outside products; drift of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.operators.labels import HIGH
from tractlens.operators.ranks import auroc, spearman
from tractlens.operators.resample import RESAMPLES, clustered_mean, draws
from tractlens.operators.scale import settled

# fixed values: sign that turns a product into a deprivation score
DEPRIVATION_SIGN = {"built_surface": -1, "built_height": -1, "population": -1, "nightlights": -1}


def paired_comparison(within: DataFrame, base: str, other: str, resamples: int = RESAMPLES) -> DataFrame:
    """Difference of two systems of a `within` table on shared municipalities, per unit."""
    keys = ["city", "municipality"]
    picked = {f"{u}_{role}": F.max(F.when(F.col("system") == name, F.col(u))) for u in ("token", "tract") for role, name in (("base", base), ("other", other))}
    merged = within.where(F.col("system").isin(base, other)).groupBy(*keys).agg(*[c.alias(n) for n, c in picked.items()])
    pairs = merged.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(u).alias("unit"),
                        F.col(f"{u}_base").alias("base"),
                        F.col(f"{u}_other").alias("other"),
                    )
                    for u in ("token", "tract")
                ]
            )
        ).alias("p"),
    ).select(*keys, "p.*").where("base IS NOT NULL AND other IS NOT NULL")
    pairs = settled(pairs.withColumn("delta", F.col("other") - F.col("base")))
    # the draws are shared by both units, over all cities of the merged table
    ends = clustered_mean(pairs, "city", "delta", ["unit"], drawn=draws(pairs, "city", resamples))
    facts = pairs.groupBy("unit").agg(
        F.avg("base").alias("base_within"),
        F.avg("other").alias("other_within"),
        F.sum((F.col("delta") > 0).cast("long")).alias("wins"),
    )
    return ends.join(facts, "unit").select(
        "unit",
        F.col("members").alias("municipalities"),
        "base_within",
        "other_within",
        F.col("mean").alias("difference"),
        "ci_low",
        "ci_high",
        "wins",
    )


def product_comparison(
    table: DataFrame,
    proxy: str,
    *,
    min_tracts: int = 20,
    high: int = 4,
    fallback_count: str | None = None,
    resamples: int = RESAMPLES,
) -> DataFrame:
    """Map and product against the grade on the identical tracts, as one row."""
    fallback = F.lit(0) if fallback_count is None else (F.col(fallback_count) == 0).cast("long")
    keys = ["city", "municipality"]
    sides = F.array(
        F.struct(F.lit("ours").alias("side"), F.col("score").cast("double").alias("value")),
        F.struct(F.lit("theirs").alias("side"), F.col(proxy).cast("double").alias("value")),
    )
    frame = settled(
        table.where(F.col(proxy).isNotNull()).select(*keys, "ordinal", fallback.alias("fallback"), F.explode(sides).alias("s"))
    ).select(*keys, "ordinal", "fallback", "s.*")
    rhos = spearman(frame, "value", "ordinal", ["side", *keys], min_rows=min_tracts)
    both = settled(
        rhos.groupBy(*keys)
        .agg(*[F.max(F.when(F.col("side") == side, F.col("rho"))).alias(side) for side in ("ours", "theirs")])
        # a product with one value in a municipality says nothing there
        .where(F.col("theirs").isNotNull())
    )
    long = both.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("ours").alias("what"), F.col("ours").alias("v")),
                F.struct(F.lit("proxy").alias("what"), F.col("theirs").alias("v")),
                F.struct(F.lit("difference").alias("what"), (F.col("ours") - F.col("theirs")).alias("v")),
            )
        ).alias("p"),
    ).select(*keys, "p.what", "p.v")
    ends = clustered_mean(long, "city", "v", ["what"], drawn=draws(long, "city", resamples))

    def pick(what: str, column: str):
        return F.max(F.when(F.col("what") == what, F.col(column)))

    wide = ends.agg(
        *[
            pick(w, c).alias(f"{w}_{n}")
            for w in ("ours", "proxy", "difference")
            for c, n in (("mean", "within"), ("ci_low", "ci_low"), ("ci_high", "ci_high"))
        ],
        pick("difference", "members").alias("municipalities"),
    )
    above = F.col("ordinal") >= high
    ours = frame.where("side = 'ours'")
    facts = ours.agg(F.count("*").alias("tracts"), F.sum("fallback").cast("long").alias("interior_fallback"))
    areas = settled(auroc(frame, "value", above, ["side"]))
    return wide.select(
        "*",
        long.where("what = 'difference'").agg(F.sum((F.col("v") > 0).cast("long"))).scalar().alias("wins"),
        facts.select("tracts").scalar().alias("tracts"),
        facts.select("interior_fallback").scalar().alias("interior_fallback"),
        areas.where("side = 'ours'").select("auroc").scalar().alias("ours_auc_high"),
        areas.where("side = 'theirs'").select("auroc").scalar().alias("proxy_auc_high"),
    )


def index_replication(
    tracts: DataFrame, index: str, *, min_tracts: int = 20, resamples: int = RESAMPLES
) -> DataFrame:
    """The map against an outside index where higher means better off."""
    flipped = tracts.withColumn("_i", -F.col(index))
    per_bag = spearman(flipped, "score", "_i", ["city", "municipality"], min_rows=min_tracts)
    ends = clustered_mean(per_bag, "city", "rho", resamples=resamples)
    return ends.select(
        F.col("mean").alias("spearman_within"),
        "half_width",
        F.col("members").alias("municipalities"),
        spearman(flipped, "score", "_i").select("rho").scalar().alias("spearman_pooled"),
        auroc(flipped, "_i", F.col("ordinal") >= HIGH).scalar().alias("auroc_high"),
        flipped.agg(F.count("*")).scalar().alias("tracts"),
    )


def selection_blindness(runs: DataFrame, error: str, quality: Sequence[str]) -> DataFrame:
    """Across configurations: does low bag error go with a good map; what would it pick."""
    means = runs.groupBy("config").agg(F.avg(error).alias(error), *[F.avg(q).alias(q) for q in quality])
    picked = means.agg(F.min_by("config", F.struct(F.col(error), F.col("config"))).alias("best_by_error"), F.count("*").alias("configs"))
    return picked.select(
        *[
            spearman(means, error, q).select("rho").scalar().alias(f"rank_corr_{q}")
            for q in quality
        ],
        "best_by_error",
        "configs",
    )


def method_summary(runs: DataFrame) -> DataFrame:
    """Per country and method: seed list in order, means, interval means, first counts."""
    # a list holds one value per seed
    return runs.groupBy("country", "method").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seed", "within"))), lambda s: F.round(s["within"], 4)
        ).alias("within_seeds"),
        F.avg("within").alias("within"),
        F.avg("ci_low").alias("within_ci_low"),
        F.avg("ci_high").alias("within_ci_high"),
        F.min_by("bags", "seed").alias("bags"),
    )


def panel_summary(runs: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per panel, as the figure exports carry them."""
    return runs.groupBy(*group).agg(
        F.count("*").alias("runs"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
    )


def drift(computed: DataFrame, published: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Paths whose value moved, or that only one side holds."""
    both = computed.select("path", F.col("value").alias("computed")).join(
        published.select("path", F.col("value").alias("published")), "path", "full_outer"
    )
    reason = (
        F.when(F.col("computed").isNull(), "missing")
        .when(F.col("published").isNull(), "unpublished")
        .when(F.abs(F.col("computed") - F.col("published")) > tolerance, "drift")
    )
    return both.withColumn("reason", reason).where(F.col("reason").isNotNull())
