"""Ordered statistics that do not put a whole group into one task.

Ranks, running sums and exact percentiles inside a group are usually written as one window
per group. A group may hold a third of all rows, so every such statistic of this package goes
through `running_totals`, which takes one way for every size: rows are range-partitioned by (group,
order) into slices, each slice is summed on its own, and groups that cross a slice border add what
their earlier slices hold. Ranks and percentiles work on value counts, so ties are already merged
before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.session import scratch_folder

def settled(df: DataFrame) -> DataFrame:
    """A reduced result that several later steps read, written down once in the shared folder.

    Later steps then cost no second pass over the facts, survive lost executors, and see the
    true size of the table when they decide how to join it.
    """
    folder = scratch_folder(df.sparkSession, "settled")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    running: dict[str, Column],
    whole: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds inclusive running sums along `order`, and whole-group sums, per group.

    `order` must be free of ties inside a group and the group columns free of nulls. The session's
    shuffle partitions bound the number of slices; adaptive execution merges small ones.
    """
    group, whole = list(group), whole or {}
    parts = {f"_r_{n}": c for n, c in running.items()} | {f"_w_{n}": c for n, c in whole.items()}
    # range bounds come from a sample, so slices are written down before they are read twice
    staged = settled(
        df.select("*", *[c.alias(n) for n, c in parts.items()])
        .repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    slice_part = W.partitionBy(*group, "_slice")
    inside = slice_part.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = staged.select(
        *df.columns,
        "_slice",
        *[F.sum(f"_r_{n}").over(inside).alias(f"_l_{n}") for n in running],
        *[F.sum(f"_w_{n}").over(slice_part).alias(f"_s_{n}") for n in whole],
    )
    per_slice = staged.groupBy(*group, "_slice").agg(*[F.sum(n).alias(n) for n in parts])
    # one row per group and slice
    group_part = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = group_part.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    crossing = per_slice.select(
        *group,
        "_slice",
        F.count("*").over(group_part).alias("_held"),
        *[F.sum(f"_r_{n}").over(before).alias(f"_o_{n}") for n in running],
        *[F.sum(f"_w_{n}").over(group_part).alias(f"_t_{n}") for n in whole],
    ).where(F.col("_held") > 1)
    # a crossing group holds a slice border, so there are at most two rows a slice
    return local.join(F.broadcast(crossing), [*group, "_slice"], "left").select(
        *df.columns,
        *[
            (F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.col(f"_l_{n}") * 0)).alias(n)
            for n in running
        ],
        *[F.coalesce(f"_t_{n}", f"_s_{n}").alias(n) for n in whole],
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """`row_number` per group for any group size."""
    return running_totals(df, group, order, {name: F.lit(1).cast("long")})


def numbered_of(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    count: str = "n",
) -> DataFrame:
    """`row_number` beside the number of rows of the group."""
    one = F.lit(1).cast("long")
    return running_totals(df, group, order, {name: one}, {count: one})


def with_stats(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Joins group aggregates back to the rows.

    A window over the group would bring all its rows into one task; the aggregate is combined
    before its shuffle and the join back is split by adaptive execution where a key is hot.
    """
    return df.join(df.groupBy(*keys).agg(*aggregates), list(keys))


def mid_ranks(counts: DataFrame, group: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Average-tie rank of each distinct value from its count."""
    ranked = running_totals(counts, group, [F.col(value).asc()], {name: F.col(weight)})
    return ranked.withColumn(name, F.col(name) - (F.col(weight) - 1) / 2.0)


def exact_percentiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    levels: dict[str, float | Column],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per group, exact for groups of any size.

    A level may be a column over `_n`, the number of values of the group.
    """
    size = F.lit(1) if weight is None else F.col(weight)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.sum(size).cast("long").alias("_c"))
    )
    ranked = running_totals(
        counts, group, [F.col(value).asc()], {"_cum": F.col("_c")}, {"_n": F.col("_c")}
    )
    spots = ranked
    for name, level in levels.items():
        at = (level if isinstance(level, Column) else F.lit(float(level))) * (F.col("_n") - 1)
        spots = spots.withColumn(f"_at_{name}", at)

    def holds(index: Column) -> Column:
        return (F.col("_cum") - F.col("_c") <= index) & (index < F.col("_cum"))

    picks = []
    for name in levels:
        at = F.col(f"_at_{name}")
        picks += [
            F.max(F.when(holds(F.floor(at)), F.col(value).cast("double"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(F.ceil(at)), F.col(value).cast("double"))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
    picked = spots.groupBy(*group).agg(*picks)
    return picked.select(
        *group,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")
            ).alias(n)
            for n in levels
        ],
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows per group; Spark cuts to k inside each partition before the shuffle."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k)


def nth_value(df: DataFrame, group: Sequence[str], value: str, index: Column, name: str) -> DataFrame:
    """The value at a zero-based place of the sorted group; `index` may use `_n`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, group, [F.col(value).asc()], {"_cum": F.col("_c")}, {"_n": F.col("_c")})
    here = (F.col("_cum") - F.col("_c") <= index) & (index < F.col("_cum"))
    return ranked.groupBy(*group).agg(F.max(F.when(here, F.col(value))).alias(name))
