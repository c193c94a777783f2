"""From scenes and pixels to annual composites: choice of scenes, medians, guards, mosaics.

Tables: `scenes(box, scene_id, tile, zone, orbit_state, orbit, cloud)`, `pixels(box, scene_id,
band, r, c, scl, value)` with null for an unobserved value, `grids(box, h, w)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.functions.expr import masked
from tractlens.operators.scale import exact_percentiles, nth_value, settled, top_k

# fixed values: limits of a composite
MAX_SCENES = 36
MIN_SCENE_COVERAGE = 0.05
TILE_COVERAGE = 0.02
FAILURE_FRACTION = 0.3
VALID_FRACTION = 0.80
MIN_DEPTH = 8


# ---- catalogue ----------------------------------------------------------------------------


def search(scenes: DataFrame, collection: str, bbox: tuple, start: str, end: str) -> DataFrame:
    """Scenes of a collection that touch a box within a period, both days included."""
    xmin, ymin, xmax, ymax = bbox
    return scenes.where(
        (F.col("collection") == collection)
        & (F.col("bbox.xmin") <= xmax)
        & (F.col("bbox.xmax") >= xmin)
        & (F.col("bbox.ymin") <= ymax)
        & (F.col("bbox.ymax") >= ymin)
        & (F.col("acquired") >= F.lit(start).cast("timestamp"))
        & (F.col("acquired") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    )


def cloud_summary(scenes: DataFrame, group: list[str]) -> DataFrame:
    """Count, range, upper median and cloudy shares."""
    facts = scenes.groupBy(*group).agg(
        F.count("*").alias("scenes"),
        F.bround(F.min("cloud"), 1).alias("minimum"),
        F.bround(F.max("cloud"), 1).alias("maximum"),
        F.bround(100.0 * F.avg((F.col("cloud") > 50).cast("double"))).alias("pct_over_50"),
        F.bround(100.0 * F.avg((F.col("cloud") > 80).cast("double"))).alias("pct_over_80"),
    )
    middle = nth_value(scenes, group, "cloud", F.floor(F.col("_n") / 2), "median")
    return facts.join(middle, group).withColumn("median", F.bround("median", 1))


def clearest(scenes: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k clearest scenes per group, `place` 1 first."""
    return top_k(scenes, group, [F.col("cloud").asc(), F.col("scene_id").asc()], k)


def _cells(grids: DataFrame) -> DataFrame:
    return grids.select("box", (F.col("h") * F.col("w")).cast("double").alias("cells"))


def scene_coverage(pixels: DataFrame, grids: DataFrame, by: str = "scene_id", **seen: Column) -> DataFrame:
    """Shares of a box's cells that a scene sees, one per named condition; scenes without pixels are absent.

    `by` names what stands for a scene.

    A task keeps the cells it met as bits of the cell's number, so what is shuffled does not grow with
    bands or repeated pixels.
    """
    number = F.col("r") * F.col("w") + F.col("c")
    per = (
        pixels.join(grids.select("box", "w"), "box")
        .select("box", by, number.alias("_n"), *[s.alias(f"_s_{n}") for n, s in seen.items()])
        .groupBy("box", by, F.bitmap_bucket_number("_n").alias("_part"))
        # a null position sets no bit
        .agg(*[F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.when(F.col(f"_s_{n}"), F.col("_n"))))).alias(n) for n in seen])
        .groupBy("box", by)
        .agg(*[F.sum(n).alias(n) for n in seen])
    )
    return per.join(_cells(grids), "box").select("box", by, *[(F.col(n) / F.col("cells")).alias(n) for n in seen])


def optical_coverage(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """What every scene sees of its box, and what of it is usable, from one scan."""
    return settled(
        scene_coverage(pixels, grids, seen=F.col("scl") > 0, usable=masked(F.lit(1), F.col("scl")).isNotNull())
    )


def useful_tiles(
    scenes: DataFrame, coverage: DataFrame, samples: int = 2, minimum: float = TILE_COVERAGE
) -> DataFrame:
    """Scenes of the tiles that reach the box, judged by each tile's clearest scenes.

    `coverage(box, scene_id, seen)` as `optical_coverage` gives it.
    """
    probes = clearest(scenes, ["box", "tile"], samples).select("box", "tile", "scene_id")
    reach = (
        probes.join(coverage, ["box", "scene_id"])
        .groupBy("box", "tile")
        .agg(F.max("seen").alias("coverage"))
        .where(F.col("coverage") >= minimum)
    )
    return scenes.join(reach.select("box", "tile"), ["box", "tile"], "left_semi")


# ---- composites ---------------------------------------------------------------------------


def selected_scenes(scenes: DataFrame, coverage: DataFrame, max_scenes: int = MAX_SCENES, samples: int = 2) -> DataFrame:
    return settled(clearest(useful_tiles(scenes, coverage, samples), ["box", "tile"], max_scenes).drop("place"))


def used_scenes(selected: DataFrame, coverage: DataFrame, minimum: float = MIN_SCENE_COVERAGE) -> DataFrame:
    """Selected scenes whose usable share of the box is large enough."""
    good = coverage.where(F.col("usable") >= minimum).select("box", "scene_id")
    return good.join(selected.select("box", "scene_id"), ["box", "scene_id"], "left_semi")


def median_composite(pixels: DataFrame, used: DataFrame, value: Column) -> DataFrame:
    """Per-pixel median and observation count; a pixel holds one value per scene at most."""
    return (
        pixels.join(used, ["box", "scene_id"], "left_semi")
        .withColumn("_v", value)
        .groupBy("box", "band", "r", "c")
        .agg(F.median("_v").alias("value"), F.count("_v").alias("depth"))
    )


def optical_composite(
    scenes: DataFrame, pixels: DataFrame, grids: DataFrame, max_scenes: int = MAX_SCENES, samples: int = 2
) -> DataFrame:
    coverage = optical_coverage(pixels, grids)
    used = settled(used_scenes(selected_scenes(scenes, coverage, max_scenes, samples), coverage))
    return median_composite(pixels, used, masked(F.col("value"), F.col("scl")))


def depth_stats(composite: DataFrame, band: str) -> DataFrame:
    """Observations behind the typical and the poorly seen pixel of one band, truncated."""
    ends = exact_percentiles(composite.where(F.col("band") == band), ["box"], "depth", {"m": 0.5, "p": 0.05})
    return ends.select(
        "box", F.floor("m").alias("median_depth"), F.floor("p").alias("minimum_depth")
    )


def composite_meta(
    scenes: DataFrame, pixels: DataFrame, grids: DataFrame, band: str, max_scenes: int = MAX_SCENES, samples: int = 2
) -> DataFrame:
    coverage = optical_coverage(pixels, grids)
    selected = selected_scenes(scenes, coverage, max_scenes, samples)
    used = settled(used_scenes(selected, coverage))
    composite = median_composite(pixels, used, masked(F.col("value"), F.col("scl")))
    return (
        selected.groupBy("box")
        .agg(F.count("*").alias("scenes_selected"), F.countDistinct("tile").alias("tiles"))
        .join(used.groupBy("box").agg(F.count("*").alias("scenes_used")), "box")
        .join(depth_stats(composite, band), "box")
    )


# ---- radar --------------------------------------------------------------------------------


def orbit_coverage(
    scenes: DataFrame, pixels: DataFrame, grids: DataFrame, probe_band: str = "vv", samples: int = 4
) -> DataFrame:
    """Mean observed share per orbit over its first scenes; failed probes leave the mean."""
    orbits = ["box", "orbit_state", "orbit"]
    probes = top_k(scenes, orbits, [F.col("scene_id").asc()], samples).select(*orbits, "scene_id")
    band = pixels.where(F.col("band") == probe_band).join(
        probes.select("box", "scene_id"), ["box", "scene_id"], "left_semi"
    )
    seen = scene_coverage(band, grids, share=F.col("value").isNotNull())
    means = probes.join(seen, ["box", "scene_id"], "left").groupBy(*orbits).agg(
        F.coalesce(F.avg("share"), F.lit(0.0)).alias("coverage")
    )
    counts = scenes.groupBy(*orbits).agg(F.count("*").alias("scenes"))
    return counts.join(means, orbits)


def best_orbit(coverage: DataFrame) -> DataFrame:
    """Most coverage to two decimals, then most scenes, then the first name."""
    place = F.struct(
        (-F.bround("coverage", 2)).alias("c"), (-F.col("scenes")).alias("n"), F.col("orbit_state"), F.col("orbit")
    )
    kept = F.struct("orbit_state", "orbit", "scenes", "coverage")
    return coverage.groupBy("box").agg(F.min_by(kept, place).alias("o")).select("box", "o.*")


def dominant_orbit(scenes: DataFrame) -> DataFrame:
    counts = scenes.groupBy("box", "orbit_state", "orbit").agg(F.count("*").alias("scenes"))
    place = F.struct((-F.col("scenes")).alias("n"), F.col("orbit_state"), F.col("orbit"))
    return counts.groupBy("box").agg(F.min_by(F.struct("orbit_state", "orbit", "scenes"), place).alias("o")).select("box", "o.*")


def zone_code(props_epsg: Column, props_code: Column) -> Column:
    """Reference system a scene declares, always with its authority."""
    code = F.coalesce(props_epsg.cast("string"), props_code)
    return F.when(F.upper(code).startswith("EPSG:"), code).otherwise(F.concat(F.lit("EPSG:"), code))


def zone_coverage(scenes: DataFrame, pixels: DataFrame, grids: DataFrame, samples: int = 2) -> DataFrame:
    """Share of the box that the clearest scenes of a zone's tiles see together."""
    probes = clearest(scenes, ["box", "zone", "tile"], samples).select("box", "zone", "scene_id")
    shares = scene_coverage(pixels.join(probes, ["box", "scene_id"]), grids, "zone", coverage=F.col("scl") > 0)
    counts = scenes.groupBy("box", "zone").agg(F.count("*").alias("scenes"))
    return counts.join(shares, ["box", "zone"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def best_zone(coverage: DataFrame) -> DataFrame:
    place = F.struct((-F.bround("coverage", 2)).alias("c"), (-F.col("scenes")).alias("n"), F.col("zone"))
    return coverage.groupBy("box").agg(
        F.min_by(F.struct("zone", "scenes", "coverage"), place).alias("z")
    ).select("box", "z.*")


def radar_composite(
    scenes: DataFrame, pixels: DataFrame, grids: DataFrame, bands=("vv", "vh"), max_scenes: int = 24, samples: int = 4
) -> DataFrame:
    """Median in linear power from the best orbit; a scene enters with both bands or not at all."""
    orbit = best_orbit(orbit_coverage(scenes, pixels, grids, bands[0], samples))
    mine = scenes.join(orbit.select("box", "orbit_state", "orbit"), ["box", "orbit_state", "orbit"], "left_semi")
    chosen = top_k(mine, ["box"], [F.col("scene_id").asc()], max_scenes).select("box", "scene_id")
    both = pixels.where(F.col("band").isin(*bands)).join(chosen, ["box", "scene_id"], "left_semi")
    whole = both.groupBy("box", "scene_id").agg(F.countDistinct("band").alias("b")).where(F.col("b") == len(bands))
    return median_composite(both, settled(whole.select("box", "scene_id")), F.col("value"))


# ---- guards -------------------------------------------------------------------------------


def composite_checks(
    composite: DataFrame,
    grids: DataFrame,
    reads: DataFrame,
    *,
    depth_band: str,
    valid: float = VALID_FRACTION,
    failures: float = FAILURE_FRACTION,
    min_depth: int = MIN_DEPTH,
) -> DataFrame:
    """One row per box and check: value, limit, passed.

    `reads(box, failed)` has one row per attempted scene.
    """
    bands = (
        composite.groupBy("box", "band")
        .agg(
            F.count("value").alias("seen"),
            F.sum((F.col("value") <= 0).cast("long")).alias("improper"),
        )
        .join(_cells(grids), "box")
        .groupBy("box")
        .agg(
            F.min(F.col("seen") / F.col("cells")).alias("observed"),
            F.max(F.coalesce("improper", F.lit(0)) / F.greatest("seen", F.lit(1))).alias("improper"),
        )
    )
    read = reads.groupBy("box").agg(F.avg(F.col("failed").cast("double")).alias("failed"))
    wide = bands.join(read, "box").join(depth_stats(composite, depth_band), "box")

    def line(name: str, value: Column, limit: float, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), passed.alias("passed")
        )

    rows = F.array(
        line("failed reads", F.col("failed"), failures, F.col("failed") <= failures),
        line("observed fraction", F.col("observed"), valid, F.col("observed") >= valid),
        line("non-positive share", F.col("improper"), 0.0, F.col("improper") <= 0),
        line("typical depth", F.col("median_depth"), min_depth, F.col("median_depth") >= min_depth),
    )
    return wide.select("box", F.explode(rows).alias("k")).select("box", "k.*")


def enforce(checks: DataFrame) -> DataFrame:
    """Strict mode: a failed check stops the job with its name."""
    text = F.concat(F.col("box").cast("string"), F.lit(": "), F.col("check"))
    return checks.withColumn(
        "passed", F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    )


# ---- mosaics and degrading ----------------------------------------------------------------


def first_valid_mosaic(tiles: DataFrame, order: str, valid: Column) -> DataFrame:
    """Overlapping tiles laid over one another: the earlier tile wins where it has data."""
    return tiles.where(valid).groupBy("box", "r", "c").agg(F.min_by("value", order).alias("value"))


def block_degrade(pixels: DataFrame, grids: DataFrame, factor: int = 2) -> DataFrame:
    """Block means laid back on the native lattice; the ragged edge keeps its values.

    The block is aggregated and exploded over its own cells, so no window and no join is needed.
    """
    sized = pixels.join(grids.select("box", "h", "w"), "box")
    inside = (F.col("r") < F.col("h") - F.col("h") % factor) & (F.col("c") < F.col("w") - F.col("w") % factor)
    cell = F.struct("r", "c")
    blocks = (
        sized.where(inside)
        .groupBy("box", "band", F.expr(f"r div {factor}").alias("_br"), F.expr(f"c div {factor}").alias("_bc"))
        .agg(F.avg("value").alias("value"), F.collect_list(cell).alias("_cells"))  # factor^2 cells
        .select("box", "band", F.explode("_cells").alias("_c"), "value")
        .select("box", "band", "_c.r", "_c.c", "value")
    )
    return blocks.unionByName(sized.where(~inside).select("box", "band", "r", "c", "value"))
