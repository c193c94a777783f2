"""Column expressions: indices, decibels, quantisation, keys, shares, boxes and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: usable scene classes, ranges per channel, metres per degree, tile index origin
VALID_CLASSES = (4, 5, 6, 7)
FIXED_RANGES_RADAR = {"s1vv": (-25.0, 5.0), "s1vh": (-30.0, 0.0), "s1ratio": (0.0, 15.0)}
FIXED_RANGES_OPTICAL = {
    "s2red": (0.0, 4000.0),
    "s2nir": (0.0, 5000.0),
    "s2ndvi": (-0.5, 1.0),
    "s2ndbi": (-0.6, 0.6),
}
METRES_PER_DEGREE = 111320.0
TILE_SIZE_M = 1_000_000
TILE_ORIGIN_X = -18_041_000.0
TILE_ORIGIN_Y = 9_000_000.0
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
LEVELS = 8


def safe_divide(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) > 1e-6, top / bottom)


def normalised_difference(a: Column, b: Column) -> Column:
    return safe_divide(a - b, a + b)


def to_db(power: Column) -> Column:
    return F.when(power > 0, F.log10(power) * 10.0)


def masked(value: Column, scene_class: Column) -> Column:
    """The value where the scene class is usable, else null."""
    return F.when(scene_class.isin(*VALID_CLASSES), value)


def unit_range(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def quantise(value: Column, low: Column, high: Column, levels: int = LEVELS) -> Column:
    """Levels 1..n over the range, clipped at its ends; 0 for a missing value."""
    checked = F.when(low < high, high).otherwise(
        F.raise_error(F.lit("degenerate quantisation range")).cast("double")
    )
    level = F.bround(unit_range(value, low, checked) * (levels - 1)) + 1
    return F.when(value.isNull(), F.lit(0)).otherwise(level).cast("int")


def normalise_channel(value: Column, low: Column, high: Column) -> Column:
    """Onto [0, 1]; a hole becomes the middle."""
    scaled = (value - low) / F.greatest(high - low, F.lit(1e-9))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(0.5))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Display value 0..255 between two percentiles; missing bands and holes are 0."""
    top = F.when(high <= low, low + 1e-6).otherwise(high)
    scaled = (value - low) / (top - low) * 255.0
    return F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))), F.lit(0)).cast("int")


def slug(name: Column) -> Column:
    """Short ASCII key of a name."""
    return F.regexp_replace(F.lower(F.translate(name, ACCENTED, PLAIN)), "[^a-z0-9]", "")


def fusion_partner(sensor: Column) -> Column:
    """The other modality of a sensor name, suffix kept."""
    tail = F.substring(sensor, 3, 1_000_000)
    return (
        F.when(sensor.startswith("s1"), F.concat(F.lit("s2"), tail))
        .when(sensor.startswith("s2"), F.concat(F.lit("s1"), tail))
        .otherwise(F.raise_error(F.concat(F.lit("no fusion partner for "), sensor)).cast("string"))
    )


def suffixed(path: Column, tag: str) -> Column:
    """A path with a tag before its extension."""
    return path if not tag else F.regexp_replace(path, r"(\.[^./]*)$", f"_{tag}$1")


def class_shares(cumulative: Column) -> Column:
    """Five class shares from four shares at grade k or above."""
    left = F.concat(F.array(F.lit(1.0)), cumulative)
    right = F.concat(cumulative, F.array(F.lit(0.0)))
    return F.zip_with(left, right, lambda a, b: a - b)


def cumulative_shares(classes: Column) -> Column:
    """Shares at grade k or above, k = 1..n-1, from class shares."""
    return F.transform(
        F.sequence(F.lit(2), F.size(classes)),
        lambda k: F.aggregate(F.slice(classes, k, F.size(classes)), F.lit(0.0), lambda a, x: a + x),
    )


def expected_grade(cumulative: Column) -> Column:
    return F.aggregate(cumulative, F.lit(0.0), lambda a, x: a + x)


def decode_classes(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def decode_cumulative(shares: Column) -> Column:
    return F.size(F.filter(shares, lambda s: s >= 0.5))


# ---- boxes and grids ----------------------------------------------------------------------


def _middle_cos(low: str = "ymin", high: str = "ymax") -> Column:
    return F.greatest(F.cos(F.radians((F.col(low) + F.col(high)) / 2.0)), F.lit(1e-6))


def boxes_of(points: DataFrame, key: str, margin_m: float = 0.0) -> DataFrame:
    """Box around the x, y of each key, grown by a margin in metres."""
    box = points.groupBy(key).agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")
    )
    dy = margin_m / METRES_PER_DEGREE
    dx = F.lit(dy) / _middle_cos()
    return box.select(
        key,
        (F.col("xmin") - dx).alias("xmin"),
        (F.col("ymin") - dy).alias("ymin"),
        (F.col("xmax") + dx).alias("xmax"),
        (F.col("ymax") + dy).alias("ymax"),
    )


def with_shape(boxes: DataFrame, resolution_m: float = 10.0) -> DataFrame:
    """Approximate height and width in pixels."""
    cos = F.cos(F.radians((F.col("ymin") + F.col("ymax")) / 2.0))
    return boxes.withColumn(
        "h", F.floor((F.col("ymax") - F.col("ymin")) * METRES_PER_DEGREE / resolution_m)
    ).withColumn("w", F.floor((F.col("xmax") - F.col("xmin")) * METRES_PER_DEGREE * cos / resolution_m))


def at_least(boxes: DataFrame, side_px: int, resolution_m: float = 10.0) -> DataFrame:
    """Grows a box east and south until no side is below `side_px`."""
    shaped = with_shape(boxes, resolution_m).withColumn("_cos", _middle_cos())
    step = resolution_m / METRES_PER_DEGREE
    wide = F.greatest(F.lit(side_px) - F.col("w"), F.lit(0)) * step / F.col("_cos")
    tall = F.greatest(F.lit(side_px) - F.col("h"), F.lit(0)) * step
    return (
        shaped.withColumn("xmax", F.col("xmax") + wide)
        .withColumn("ymin", F.col("ymin") - tall)
        .drop("h", "w", "_cos")
    )


def too_wide(limit_km: float = 120.0) -> Column:
    width = (F.col("xmax") - F.col("xmin")) * 111.32 * F.cos(F.radians((F.col("ymin") + F.col("ymax")) / 2.0))
    return F.greatest(width, (F.col("ymax") - F.col("ymin")) * 111.32) > limit_km


def checked_box(boxes: DataFrame) -> DataFrame:
    """Fails on a degenerate or out-of-range geographic box."""
    fine = (
        (F.col("xmin") < F.col("xmax"))
        & (F.col("ymin") < F.col("ymax"))
        & F.col("xmin").between(-180, 180)
        & F.col("xmax").between(-180, 180)
        & F.col("ymin").between(-90, 90)
        & F.col("ymax").between(-90, 90)
    )
    return boxes.withColumn(
        "xmin", F.when(fine, F.col("xmin")).otherwise(F.raise_error(F.lit("bad box")).cast("double"))
    )


def grid_of_box(boxes: DataFrame, resolution_m: float = 10.0) -> DataFrame:
    """Cells covering a projected box and the affine transform (a, b, c, d, e, f)."""
    w = F.greatest(F.lit(1), F.ceil((F.col("xmax") - F.col("xmin")) / resolution_m))
    h = F.greatest(F.lit(1), F.ceil((F.col("ymax") - F.col("ymin")) / resolution_m))
    sized = boxes.withColumn("w", w).withColumn("h", h)
    return sized.withColumn(
        "gt",
        F.array(
            (F.col("xmax") - F.col("xmin")) / F.col("w"),
            F.lit(0.0),
            F.col("xmin"),
            F.lit(0.0),
            -(F.col("ymax") - F.col("ymin")) / F.col("h"),
            F.col("ymax"),
        ),
    )


def ground(gt: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Ground coordinates of a pixel position."""
    return gt[0] * col + gt[1] * row + gt[2], gt[3] * col + gt[4] * row + gt[5]


def raster_tiles(boxes: DataFrame) -> DataFrame:
    """Tiles of the global one-thousand-kilometre grid that cover projected boxes."""
    col = lambda x: F.floor((F.col(x) - TILE_ORIGIN_X) / TILE_SIZE_M) + 1
    row = lambda y: F.floor((F.lit(TILE_ORIGIN_Y) - F.col(y)) / TILE_SIZE_M) + 1
    return (
        boxes.select(F.explode(F.sequence(row("ymax"), row("ymin"))).alias("row"), "xmin", "xmax")
        .select("row", F.explode(F.sequence(col("xmin"), col("xmax"))).alias("col"))
        .distinct()
    )
