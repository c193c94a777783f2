"""Co-occurrence texture, split-half reliability and feature diagnostics per polygon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.operators.scale import exact_percentiles, settled, with_stats
from tractlens.operators.zonal import first_order

DISTANCES = (1, 2, 4)
MIN_PIXELS = 640
RELIABILITY_THRESHOLD = 0.60
SIZE_THRESHOLD = 0.30
FAMILIES = (
    "contrast",
    "dissimilarity",
    "homogeneity",
    "energy",
    "correlation",
    "entropy",
    "anisotropy",
)
FIRST_ORDER = ("mean", "std", "p10", "p50", "p90", "iqr")


def channel_ranges(pixels: DataFrame, policy: str, fixed: dict, native: dict) -> DataFrame:
    """Range per box and band: fixed edges where the policy has them, else measured 2..98 %."""
    known = {"native": native, "fixed": fixed, "percentiles": {}}[policy]
    measured = exact_percentiles(pixels, ["box", "band"], "value", {"low": 0.02, "high": 0.98})
    low, high = F.col("low"), F.col("high")
    for band, (a, b) in known.items():
        low = F.when(F.col("band") == band, F.lit(float(a))).otherwise(low)
        high = F.when(F.col("band") == band, F.lit(float(b))).otherwise(high)
    return measured.select("box", "band", low.alias("low"), high.alias("high"))


# ---- co-occurrence ------------------------------------------------------------------------


def _diagonal(distance: int) -> int:
    """Steps along a diagonal: the distance over the square root of two, rounded to pixels."""
    return round(distance * 0.5**0.5)


def pair_counts(pixels: DataFrame, group: Sequence[str], distances=DISTANCES) -> DataFrame:
    """Symmetric co-occurrence counts per group, distance and angle (0, 45, 90, 135).

    `pixels` carries r, c and a level; level 0 is missing and pairs with nothing. The partner
    along each orientation lies on the same row, column or diagonal, so four sorts of the
    pixels by line serve all distances, instead of one self-join per offset.
    """
    seen = pixels.where(F.col("level") > 0).select(*group, "r", "c", "level")
    lines = {
        0: (F.col("r"), "c", lambda d: d),
        45: (F.col("r") - F.col("c"), "r", _diagonal),
        90: (F.col("c"), "r", lambda d: d),
        135: (F.col("r") + F.col("c"), "r", _diagonal),
    }
    for angle, (line, along, step) in lines.items():
        seen = seen.withColumn("_line", line)
        for d in distances:
            k = step(d)
            w = W.partitionBy(*group, "_line").orderBy(along).rangeBetween(k, k)
            seen = seen.withColumn(f"_j_{d}_{angle}", F.max("level").over(w))
    partners = F.array(
        *[
            F.struct(F.lit(d).alias("d"), F.lit(a).alias("angle"), F.col(f"_j_{d}_{a}").alias("j"))
            for d in distances
            for a in lines
        ]
    )
    counted = (
        seen.select(*group, F.col("level").alias("i"), F.explode(partners).alias("p"))
        .where("p.j IS NOT NULL")
        .groupBy(*group, F.col("p.d").alias("d"), F.col("p.angle").alias("angle"), "i", F.col("p.j").alias("j"))
        .agg(F.count("*").alias("n"))
    )
    both = counted.select(
        *group,
        "d",
        "angle",
        F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"),
        "n",
    )
    return both.groupBy(*group, "d", "angle", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(
        F.sum("n").cast("double").alias("n")
    )


def texture(pixels: DataFrame, group: Sequence[str], distances=DISTANCES) -> DataFrame:
    """Texture properties per group and distance, averaged over the four angles.

    An angle without a pair counts as an empty matrix: zero everywhere, correlation one.
    """
    keys = [*group, "d", "angle"]
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n")
    diff = i - j
    sums = pair_counts(pixels, group, distances).groupBy(*keys).agg(
        F.sum("n").alias("t"),
        F.sum(n * diff * diff).alias("contrast"),
        F.sum(n * F.abs(diff)).alias("dissimilarity"),
        F.sum(n / (1.0 + diff * diff)).alias("homogeneity"),
        F.sum(n * n).alias("square"),
        F.sum(n * i).alias("si"),
        F.sum(n * i * i).alias("sii"),
        F.sum(n * i * j).alias("sij"),
        F.sum(n * F.log2(n)).alias("nlog"),
    )
    t = F.col("t")
    mean = F.col("si") / t
    var = F.col("sii") / t - mean * mean
    cov = F.col("sij") / t - mean * mean
    per_angle = sums.select(
        *keys,
        (F.col("contrast") / t).alias("contrast"),
        (F.col("dissimilarity") / t).alias("dissimilarity"),
        (F.col("homogeneity") / t).alias("homogeneity"),
        (F.sqrt("square") / t).alias("energy"),
        # the matrix is symmetric, so both deviations are the same
        F.when(var < 1e-12, F.lit(1.0)).otherwise(cov / var).alias("correlation"),
        (F.log2(t) - F.col("nlog") / t).alias("entropy"),
    )
    four = F.lit(4.0)
    means = per_angle.groupBy(*group, "d").agg(
        *[(F.sum(p) / four).alias(p) for p in ("contrast", "dissimilarity", "homogeneity", "energy", "entropy")],
        ((F.sum("correlation") + (four - F.count("*"))) / four).alias("correlation"),
        (F.sum(F.col("contrast") * F.col("contrast")) / four).alias("_cc"),
    )
    return means.withColumn(
        "anisotropy", F.sqrt(F.greatest(F.col("_cc") - F.col("contrast") * F.col("contrast"), F.lit(0.0)))
    ).drop("_cc")


def polygon_features(
    pixels: DataFrame, group: Sequence[str], min_pixels: int = MIN_PIXELS, distances=DISTANCES
) -> DataFrame:
    """Long table (group, feature, value) of texture and first-order features, and `n_px`.

    Groups below `min_pixels` keep their pixel count and have no further feature.
    """
    seen = pixels.where(F.col("level") > 0)
    sized = with_stats(seen, group, F.count("*").alias("_n"))
    big = sized.where(F.col("_n") >= min_pixels).drop("_n")
    tex = texture(big, group, distances)
    long = tex.select(
        *group,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(f"{f}_d"), F.col("d").cast("string")).alias("feature"),
                        F.col(f).alias("value"),
                    )
                    for f in FAMILIES
                ]
            )
        ).alias("f"),
    ).select(*group, "f.*")
    one = first_order(big, group)
    plain = one.select(
        *group,
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FIRST_ORDER])).alias("f"),
    ).select(*group, "f.*")
    counts = seen.groupBy(*group).agg(F.count("*").cast("double").alias("value")).select(
        *group, F.lit("n_px").alias("feature"), "value"
    )
    return long.unionByName(plain).unionByName(counts)


def feature_names(channels: Sequence[str], distances=DISTANCES) -> list[str]:
    names = [f"{f}_d{d}" for f in FAMILIES for d in distances] + list(FIRST_ORDER) + ["n_px"]
    return [f"{c}_{n}" for c in channels for n in names]


def feature_table(features: DataFrame, group: Sequence[str], channels: Sequence[str], distances=DISTANCES) -> DataFrame:
    """Wide table, one row per polygon, columns channel_statistic; the names are known, so the
    pivot needs no pass to find them."""
    named = features.withColumn("_name", F.concat_ws("_", "channel", "feature"))
    return named.groupBy(*group).pivot("_name", feature_names(channels, distances)).agg(F.first("value"))


def assemble_features(
    wide: DataFrame, cover: DataFrame, labels: DataFrame, areas: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Features with cover, labels and area of the same polygons."""
    return wide.join(cover, list(key), "left").join(labels, "poly_id", "left").join(areas, "poly_id", "left")


# ---- diagnostics --------------------------------------------------------------------------


def split_half_reliability(pixels: DataFrame, group: Sequence[str], by: Sequence[str], min_pixels: int = MIN_PIXELS, distances=DISTANCES) -> DataFrame:
    """Correlation over polygons of each feature between the two halves of the polygon.

    `pixels` carries x and mid_x; `by` are the columns a city is known by.
    """
    halves = pixels.withColumn("half", (F.col("x") >= F.col("mid_x")).cast("int"))
    f = polygon_features(halves, [*group, "half"], min_pixels, distances).where("feature <> 'n_px'")
    pairs = f.groupBy(*group, "feature").agg(
        F.max(F.when(F.col("half") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("half") == 1, F.col("value"))).alias("b"),
    )
    return correlation(pairs, [*by, "feature"], "a", "b", "r")


def correlation(pairs: DataFrame, group: Sequence[str], a: str, b: str, name: str) -> DataFrame:
    """Pearson over rows with both values; null below three rows or without variation."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.when(
            (F.count("*") >= 3) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)),
            F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)),
        ).alias(name),
    )


def reliability_summary(per_city: DataFrame) -> DataFrame:
    """Median and worst correlation of each feature over the cities."""
    facts = per_city.groupBy("feature").agg(F.min("r").alias("r_min"), F.count("*").alias("cities"))
    return facts.join(exact_percentiles(per_city, ["feature"], "r", {"r_median": 0.5}), "feature", "left")


def size_correlation(features: DataFrame, group: Sequence[str], *, log: bool = False) -> DataFrame:
    """Correlation of each feature with the polygon's pixel count."""
    features = settled(features)
    size = features.where("feature = 'n_px'").select(*group, F.col("value").alias("_px"))
    px = F.log10(F.greatest("_px", F.lit(1.0))) if log else F.col("_px")
    rows = features.where("feature <> 'n_px'").join(size, list(group)).withColumn("_s", px)
    return correlation(rows, ["feature"], "value", "_s", "r_n_px")


def select_features(
    sizes: DataFrame, reliability: DataFrame, reliable: float = RELIABILITY_THRESHOLD, tied: float = SIZE_THRESHOLD
) -> DataFrame:
    """Keeps features that reproduce and are not tied to size, with the reason."""
    both = sizes.select("feature", "r_n_px").join(
        reliability.select("feature", F.col("r_median").alias("r_halves")), "feature", "left"
    )
    good = F.coalesce(F.col("r_halves") >= reliable, F.lit(False))
    free = F.coalesce(F.abs("r_n_px") <= tied, F.lit(False))
    reason = F.when(~good, "does not reproduce").when(~free, "tied to size").otherwise("kept")
    return both.select("feature", "r_halves", "r_n_px", (good & free).alias("kept"), reason.alias("reason"))


def explained_variance(long: DataFrame, factor: str, name: str) -> DataFrame:
    """Between-group over total variance of each feature, from group sums alone."""
    clean = long.where(F.col("value").isNotNull() & F.col(factor).isNotNull())
    groups = clean.groupBy("feature", factor).agg(
        F.count("*").cast("double").alias("n"),
        F.avg("value").alias("m"),
        F.var_pop("value").alias("v"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    whole = with_stats(groups, ["feature"], (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_whole"))
    gap = F.col("m") - F.col("_whole")
    between, inside = F.sum(F.col("n") * gap * gap), F.sum(F.col("n") * F.col("v"))
    usable = (F.sum("n") >= 2) & (F.min("lo") < F.max("hi"))
    return whole.groupBy("feature").agg(F.when(usable, between / (between + inside)).alias(name))


def transfer_diagnostics(long: DataFrame, group: str = "city", target: str = "grade") -> DataFrame:
    """How much of each feature the city explains against the grade."""
    out = explained_variance(long, group, "per_city").join(explained_variance(long, target, "per_grade"), "feature")
    return out.withColumn("ratio", F.when(F.col("per_grade") > 0, F.col("per_city") / F.col("per_grade")))


def ratio_quartiles(diagnostics: DataFrame, set_of: Column) -> DataFrame:
    """Quartiles of the ratio per feature set."""
    return exact_percentiles(
        diagnostics.withColumn("feature_set", set_of), ["feature_set"], "ratio", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
