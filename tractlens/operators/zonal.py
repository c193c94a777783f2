"""Statistics of pixels over tokens and polygons.

Polygon statistics start from one `pixel -> polygon` table (see `spatial.pixels_in_polygons`)
and are plain grouped aggregates with map-side combining.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.operators.scale import exact_percentiles

TOKEN_PX = 16
MIN_CLASSIFIED = 0.5
BUILT = 50
# fixed values: cover classes and the heavy-tailed products
CLASSES = {
    10: "tree",
    20: "shrub",
    30: "grass",
    40: "crop",
    50: "built",
    60: "bare",
    70: "snow",
    80: "water",
    90: "wetland",
    95: "mangrove",
    100: "moss",
}
LOG_SCALED = ("built_surface", "population")


def token_of(r: str = "r", c: str = "c", token: int = TOKEN_PX) -> list[Column]:
    return [F.expr(f"{r} div {token} * {token}").alias("y0"), F.expr(f"{c} div {token} * {token}").alias("x0")]


def class_fractions(classes: DataFrame, group: Sequence[str], codes: dict[int, str] = CLASSES, prefix: str = "wc") -> DataFrame:
    """Share of each class among the classified pixels (code 0 is no data)."""
    return (
        classes.where(F.col("value") != 0)
        .groupBy(*group)
        .agg(
            F.count("*").alias(f"{prefix}_n_px"),
            *[F.avg((F.col("value") == k).cast("double")).alias(f"{prefix}_{n}") for k, n in codes.items()],
        )
    )


def built_share(classes: DataFrame, tokens: DataFrame, built: int = BUILT) -> DataFrame:
    """Built share under each token; 0 where nothing is classified."""
    share = (
        classes.where(F.col("value") != 0)
        .groupBy("box", *token_of())
        .agg(F.avg((F.col("value") == built).cast("double")).alias("built"))
    )
    return tokens.join(share, ["box", "y0", "x0"], "left").withColumn("built", F.coalesce("built", F.lit(0.0)))


def classified_share(classes: DataFrame, grids: DataFrame, minimum: float = MIN_CLASSIFIED) -> DataFrame:
    """Share of the grid that is classified, and whether the mosaic may be used."""
    seen = classes.where(F.col("value") != 0).groupBy("box").agg(F.count("*").alias("_k"))
    return grids.join(seen, "box", "left").select(
        "box",
        (F.coalesce("_k", F.lit(0)) / (F.col("h") * F.col("w")).cast("double")).alias("classified"),
    ).withColumn("usable", F.col("classified") >= minimum)


def token_layer_means(layers: DataFrame, tokens: DataFrame, names: Sequence[str], log_scaled=LOG_SCALED) -> DataFrame:
    """Mean of each product inside each token; heavy tails enter as log(1 + x); empty is 0."""
    v = F.when(F.col("layer").isin(*log_scaled), F.log1p(F.greatest("value", F.lit(0.0)))).otherwise(F.col("value"))
    means = layers.withColumn("_v", v).groupBy("box", *token_of()).agg(
        *[F.avg(F.when(F.col("layer") == n, F.col("_v"))).alias(n) for n in names]
    )
    joined = tokens.join(means, ["box", "y0", "x0"], "left")
    return joined.select(*tokens.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def first_order(df: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, population deviation and exact percentiles."""
    moments = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    ends = exact_percentiles(
        df, group, value, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    )
    return moments.join(ends, list(group)).select(
        *group, "mean", "std", "p10", "p50", "p90", (F.col("p75") - F.col("p25")).alias("iqr")
    )


def zonal_mean(assigned: DataFrame, polygons: DataFrame, pixels: DataFrame, column: str) -> DataFrame:
    """Mean and pixel count per polygon; a polygon without a pixel centre reads its interior point.

    `assigned(poly_id, r, c, value)`; `polygons(poly_id, pr, pc)` carries the cell of an
    interior point; `pixels(r, c, value)` is the layer itself. Where polygons and pixels both have
    a `box`, the point is looked up in its own tile; the smallest value decides where tiles overlap.
    """
    tile = ["box"] if "box" in polygons.columns and "box" in pixels.columns else []
    sums = (
        assigned.where(F.col("value").isNotNull())
        .groupBy("poly_id")
        .agg(F.sum("value").alias("_s"), F.count("*").alias("_k"))
    )
    base = polygons.join(sums, "poly_id", "left")
    missing = base.where(F.col("_k").isNull()).select(*tile, "poly_id", "pr", "pc")
    fallback = missing.join(
        pixels.select(*tile, F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("value").alias("_point")),
        [*tile, "pr", "pc"],
    ).groupBy("poly_id").agg(F.min("_point").alias("_point"))
    return base.join(fallback, "poly_id", "left").select(
        "poly_id",
        F.coalesce(F.col("_s") / F.col("_k"), F.col("_point")).alias(column),
        F.coalesce("_k", F.lit(0)).cast("long").alias(f"{column}_n_px"),
    )


def paint_tokens(pixels: DataFrame, tokens: DataFrame, value: str = "score") -> DataFrame:
    """The token value on every pixel of its footprint; gaps stay null."""
    placed = pixels.select("box", "r", "c", *token_of())
    return placed.join(tokens.select("box", "y0", "x0", value), ["box", "y0", "x0"], "left").select(
        "box", "r", "c", value
    )


def grade_distribution(frame: DataFrame, group: Sequence[str] = ("city", "ordinal"), value: str = "score") -> DataFrame:
    """Box statistics of the score by true grade."""
    ends = exact_percentiles(frame, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return frame.groupBy(*group).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    ).join(ends, list(group))
