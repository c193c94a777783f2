"""Windows, tokens, neighbourhoods, overlap rules, pooling and vector features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.functions.hashing import hash_order
from tractlens.operators.scale import numbered_of, top_k, with_stats

WINDOW_PX = 224
TOKEN_PX = 16
MIN_VALID = 0.9


# ---- lattice ------------------------------------------------------------------------------


def _starts(extent: Column, size: int, stride: int, flush: bool) -> Column:
    last = F.floor((extent - size) / stride)
    regular = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * stride)
    if not flush:
        return regular
    edge = F.floor((extent - size) / TOKEN_PX) * TOKEN_PX
    extra = F.when(last * stride + size < extent, F.array(edge)).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_union(regular, extra))


def window_lattice(
    boxes: DataFrame, size: int = WINDOW_PX, stride: int | None = None, *, flush: bool = False
) -> DataFrame:
    """Whole windows over each box of `h` x `w` pixels: box, win, row, col, y0, x0, size."""
    stride = size if stride is None else stride
    whole_tokens = stride % TOKEN_PX == 0
    if not (whole_tokens and 0 < stride <= size):
        raise ValueError(f"windows of {size} pixels cannot step by {stride}: a step is whole tokens and no more than a window")
    fitting = boxes.where((F.col("h") >= size) & (F.col("w") >= size))
    return (
        fitting.select(
            "box",
            F.size(_starts(F.col("w"), size, stride, flush)).alias("_nc"),
            F.posexplode(_starts(F.col("h"), size, stride, flush)).alias("row", "y0"),
            F.col("w").alias("_w"),
        )
        .select(
            "box",
            "row",
            "y0",
            "_nc",
            F.posexplode(_starts(F.col("_w"), size, stride, flush)).alias("col", "x0"),
        )
        .select(
            "box",
            (F.col("row").cast("long") * F.col("_nc") + F.col("col")).alias("win"),
            "row",
            "col",
            "y0",
            "x0",
            F.lit(size).alias("size"),
        )
    )


def window_tokens(windows: DataFrame, token: int = TOKEN_PX) -> DataFrame:
    """Every token of every window: index in the window and address on the lattice."""
    side = F.expr(f"size div {token}")
    cells = F.sequence(F.lit(0).cast("long"), side * side - 1)
    return windows.select("box", "win", side.alias("_side"), "y0", "x0", F.explode(cells).alias("j")).select(
        "box",
        "win",
        "j",
        F.expr("j div _side").alias("trow"),
        F.expr("j % _side").alias("tcol"),
        (F.col("y0") + F.expr("j div _side") * token).alias("y0"),
        (F.col("x0") + F.expr("j % _side") * token).alias("x0"),
    )


def window_metadata(windows: DataFrame, grids: DataFrame, day: float) -> DataFrame:
    """Ground centre, day and footprint of each window from the box's affine transform.

    `gt` holds (a, b, c, d, e, f): x = a*col + b*row + c, y = d*col + e*row + f.
    """
    row, col = F.col("y0") + F.col("size") / 2.0, F.col("x0") + F.col("size") / 2.0
    gt = lambda i: F.col("gt")[i]
    side = F.col("size") * F.abs(gt(0)) / 1000.0
    return windows.join(grids.select("box", "gt"), "box").select(
        "box",
        "win",
        (gt(0) * col + gt(1) * row + gt(2)).alias("x"),
        (gt(3) * col + gt(4) * row + gt(5)).alias("y"),
        F.lit(float(day)).alias("day"),
        (side * side).alias("area_km2"),
    )


# ---- validity -----------------------------------------------------------------------------


def observed_pixels(pixels: DataFrame, bands: int) -> DataFrame:
    """Pixels that hold a value in every band."""
    return (
        pixels.where(F.col("value").isNotNull())
        .groupBy("box", "r", "c")
        .agg(F.countDistinct("band").alias("_b"))
        .where(F.col("_b") == bands)
        .select("box", "r", "c")
    )


def observed_per_token(observed: DataFrame, token: int = TOKEN_PX) -> DataFrame:
    """Observed pixels counted once per token cell; windows are sums of whole cells."""
    return observed.groupBy(
        "box",
        F.expr(f"r div {token} * {token}").alias("y0"),
        F.expr(f"c div {token} * {token}").alias("x0"),
    ).agg(F.count("*").alias("seen"))


def valid_windows(windows: DataFrame, observed: DataFrame, token: int = TOKEN_PX, minimum: float = MIN_VALID) -> DataFrame:
    """Windows observed in at least `minimum` of their pixels."""
    share = (
        window_tokens(windows, token)
        .join(observed_per_token(observed, token), ["box", "y0", "x0"])
        .groupBy("box", "win")
        .agg(F.sum("seen").alias("seen"))
    )
    need = F.col("size") * F.col("size") * minimum
    return windows.join(share, ["box", "win"]).where(F.col("seen") >= need).drop("seen")


def valid_tokens(windows: DataFrame, observed: DataFrame, token: int = TOKEN_PX, minimum: float = MIN_VALID) -> DataFrame:
    """Valid tokens; a position shared by overlapping windows enters once, from the first."""
    cells = window_tokens(windows, token).join(
        observed_per_token(observed, token).where(F.col("seen") >= token * token * minimum),
        ["box", "y0", "x0"],
    )
    first = F.struct("win", "j", "trow", "tcol")
    return cells.groupBy("box", "y0", "x0").agg(F.min(first).alias("_f")).select(
        "box", "y0", "x0", "_f.win", "_f.j", "_f.trow", "_f.tcol"
    )


# ---- neighbourhoods -----------------------------------------------------------------------


def _shifted(tokens: DataFrame, group: Sequence[str], offsets: list[tuple[int, int]], carry: dict[str, Column]):
    steps = F.array(*[F.struct(F.lit(a * TOKEN_PX).alias("dy"), F.lit(b * TOKEN_PX).alias("dx")) for a, b in offsets])
    return tokens.select(
        *group, F.col("y0").alias("src_y"), F.col("x0").alias("src_x"), *[c.alias(n) for n, c in carry.items()],
        F.explode(steps).alias("_o"),
    ).select(
        *group, "src_y", "src_x", *carry, (F.col("src_y") + F.col("_o.dy")).alias("y0"), (F.col("src_x") + F.col("_o.dx")).alias("x0")
    )


def neighbour_pairs(tokens: DataFrame, group: Sequence[str], radius: int = 1) -> DataFrame:
    """Pairs of tokens within a Chebyshev radius, without the token itself.

    Each token asks for its (2r+1)^2 - 1 cells by key, so the join is an equi-join on
    (group, y, x) and never lists the pairs of a group.
    """
    span = range(-radius, radius + 1)
    offsets = [(a, b) for a in span for b in span if (a, b) != (0, 0)]
    asked = _shifted(tokens, group, offsets, {})
    there = tokens.select(*group, "y0", "x0")
    return asked.join(there, [*group, "y0", "x0"]).select(
        *group, "src_y", "src_x", F.col("y0").alias("dst_y"), F.col("x0").alias("dst_x")
    )


def rook_pairs(tokens: DataFrame, group: Sequence[str]) -> DataFrame:
    """Right and down neighbours with what the two sides share."""
    mine = {f"_{c}": F.col(c) for c in ("score", "municipality", "cvegeo", "ordinal")}
    asked = _shifted(tokens, group, [(0, 1), (1, 0)], mine)
    there = tokens.select(*group, "y0", "x0", "score", "municipality", "cvegeo", "ordinal")
    return asked.join(there, [*group, "y0", "x0"]).select(
        *group,
        F.abs(F.col("_score") - F.col("score")).alias("jump"),
        (F.col("_municipality") == F.col("municipality")).alias("same_municipality"),
        (F.col("_cvegeo") == F.col("cvegeo")).alias("same_tract"),
        (F.col("_ordinal") == F.col("ordinal")).alias("same_grade"),
    )


def mean_vector(df: DataFrame, group: Sequence[str], vec: str, name: str, weight: str | None = None) -> DataFrame:
    """Mean of array columns, summed element-wise inside the partial aggregation."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, F.col(weight))
    return df.groupBy(*group).agg(vector_to_array(mean).alias(name))


def neighbour_mean(tokens: DataFrame, group: Sequence[str], vec: str = "vec", radius: int = 1) -> DataFrame:
    """Adds `context`: the mean vector of the neighbours, or the own vector where there is none."""
    pairs = neighbour_pairs(tokens, group, radius)
    there = tokens.select(*group, F.col("y0").alias("dst_y"), F.col("x0").alias("dst_x"), F.col(vec).alias("_v"))
    means = mean_vector(
        pairs.join(there, [*group, "dst_y", "dst_x"]), [*group, "src_y", "src_x"], "_v", "_context"
    ).select(*group, F.col("src_y").alias("y0"), F.col("src_x").alias("x0"), "_context")
    return tokens.join(means, [*group, "y0", "x0"], "left").withColumn(
        "context", F.coalesce("_context", F.col(vec).cast("array<double>"))
    ).drop("_context")


# ---- overlap and pooling ------------------------------------------------------------------


def edge_weight(position: Column, side: int, floor: float = 0.05) -> Column:
    """Hann weight of a token row or column inside a window of `side` tokens."""
    return F.greatest(F.pow(F.sin(F.lit(3.141592653589793) * (position + 0.5) / side), 2), F.lit(floor))


def reduce_overlaps(tokens: DataFrame, side: int, rule: str = "central", vec: str = "vec") -> DataFrame:
    """One vector per position from the windows that cover it.

    `central` keeps the encoding of the window where the token lies most centrally, the last
    one on equal weight; `hann` takes the weighted mean.
    """
    weighed = tokens.withColumn("_w", edge_weight(F.col("trow"), side) * edge_weight(F.col("tcol"), side))
    if rule == "hann":
        return mean_vector(weighed, ["box", "y0", "x0"], vec, vec, "_w")
    place = F.struct(F.round("_w", 12).alias("w"), F.col("win"), F.col("j"))
    return weighed.groupBy("box", "y0", "x0").agg(F.max_by(vec, place).alias(vec))


def bag_softmax(df: DataFrame, group: Sequence[str], score: str, name: str) -> DataFrame:
    """Softmax of a score inside each bag, shifted by the bag's maximum."""
    top = with_stats(df, group, F.max(score).alias("_top")).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    whole = with_stats(top, group, F.sum("_e").alias("_z"))
    return whole.withColumn(name, F.col("_e") / F.col("_z")).drop("_top", "_e", "_z")


def attention_pool(df: DataFrame, group: Sequence[str], score: str, vec: str = "vec") -> DataFrame:
    """Attention-weighted mean vector and normalised entropy of each bag."""
    a = bag_softmax(df, group, score, "_a")
    pooled = mean_vector(a, group, vec, "pooled", "_a")
    spread = a.groupBy(*group).agg(
        F.count("*").alias("n"), (-F.sum(F.col("_a") * F.log(F.greatest("_a", F.lit(1e-12))))).alias("_h")
    )
    return pooled.join(spread, list(group)).select(
        *group, "n", "pooled", F.when(F.col("n") > 1, F.col("_h") / F.log(F.col("n").cast("double"))).alias("entropy")
    )


def pseudo_labels(df: DataFrame, group: Sequence[str], score: str, key: str, k: int = 8) -> DataFrame:
    """The k most and k least attended instances of a bag, k at most half of it."""
    placed = numbered_of(df, group, [F.col(score).desc(), F.col(key).asc()], "_i", "_n")
    half = F.least(F.lit(k).cast("long"), F.floor(F.col("_n") / 2))
    label = F.when(F.col("_i") <= half, 1).when(F.col("_i") > F.col("_n") - half, 0)
    return placed.withColumn("pseudo", label).where(F.col("pseudo").isNotNull()).drop("_i", "_n")


# ---- vectors ------------------------------------------------------------------------------


def join_by_position(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("city", "y0", "x0"), vec: str = "vec") -> DataFrame:
    """Vectors of two sources on the same position, concatenated base first."""
    return base.join(other.select(*keys, F.col(vec).alias("_v")), list(keys)).withColumn(
        vec, F.concat(vec, "_v")
    ).drop("_v")


def unmatched_positions(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("city", "y0", "x0")) -> DataFrame:
    """Rows of the base without a partner: dropped and counted."""
    return base.join(other.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("dropped"))


def vector_scaler(df: DataFrame, group: Sequence[str], key: str, vec: str = "vec", per_bag: int = 200, seed: int = 0) -> DataFrame:
    """Mean and population deviation of each feature over a sample of every bag."""
    order = [hash_order(seed, F.col(key)).asc(), F.col(key).asc()]
    sample = top_k(df, group, order, per_bag)
    return (
        sample.select(F.posexplode(vec).alias("feature", "v"))
        .groupBy("feature")
        .agg(F.avg("v").alias("centre"), F.stddev_pop("v").alias("spread"))
    )


def municipality_points(scores: DataFrame, min_tokens: int = 20) -> DataFrame:
    """Mean position and score of each municipality with enough tokens, and its first split."""
    return (
        scores.groupBy("municipality")
        .agg(
            F.avg("lon").alias("lon"),
            F.avg("lat").alias("lat"),
            F.count("*").alias("tokens"),
            F.avg("score").alias("score"),
            F.min_by("split", F.struct("y0", "x0")).alias("split"),
        )
        .where(F.col("tokens") >= min_tokens)
    )
