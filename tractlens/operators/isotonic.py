"""Isotonic regression whose points never meet in one place.

Three facts make it a job of reductions:

- Blocks that pool inside a stretch of scores are pooled in the whole as well, so every range slice
  pools its own points first and sends on blocks.
- The points whose fitted value is at least `t` are those behind the place where the running sum of
  `weight * (value - t)` is least. That place follows from one number per slice, so a grid of
  thresholds cuts the blocks into segments whose fits are independent of each other.
- A segment holds about as many blocks as any other, since the thresholds are quantiles of the block
  means; each is pooled in a task of its own.

The fit is a table of blocks. A score finds its block by a running count of block starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.operators.scale import running_totals, settled

BLOCK = "lo double, hi double, total double, weight double"


def pooled(blocks: np.ndarray) -> np.ndarray:
    """Pools neighbours (rows lo, hi, total, weight in order) until their means rise strictly."""
    kept: list[list[float]] = []
    for lo, hi, total, weight in blocks.tolist():
        # the mean before is not below this one
        while kept and kept[-1][2] * weight >= total * kept[-1][3]:
            lo, _, more, heavy = kept.pop()
            total, weight = total + more, weight + heavy
        kept.append([lo, hi, total, weight])
    return np.array(kept, float).reshape(len(kept), 4)


def _table(blocks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks[:, i]) for i in range(4)], ["lo", "hi", "total", "weight"])


def _matrix(batch) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(n)) for n in ("lo", "hi", "total", "weight")]).reshape(-1, 4)


def _pool_in_slices(points: DataFrame) -> DataFrame:
    """Blocks of each range slice, with the slice's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4))
        for batch in batches:
            held = pooled(np.vstack([held, _matrix(batch)]))
        yield _table(held)

    ranged = points.repartitionByRange("lo").sortWithinPartitions("lo")
    return ranged.mapInArrow(run, BLOCK).withColumn("slice", F.spark_partition_id())


def _cuts(blocks: DataFrame, segments: int) -> list[float]:
    """Scores at which the fit passes thresholds; at most `segments` of them."""
    levels = [i / segments for i in range(1, segments)]
    found = blocks.agg(F.percentile_approx(F.col("total") / F.col("weight"), levels).alias("t")).first()["t"]
    thresholds = sorted(set(found or []))
    if not thresholds:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.array(thresholds)
        total, least, at = np.zeros(len(t)), np.full(len(t), np.inf), np.full(len(t), np.nan)
        for batch in batches:
            m = _matrix(batch)
            if not len(m):
                continue
            run_on = total + np.cumsum(m[:, 2:3] - m[:, 3:4] * t, axis=0)
            place = run_on.argmin(axis=0)
            low = run_on[place, np.arange(len(t))]
            at = np.where(low < least, m[place, 1], at)
            least, total = np.minimum(least, low), run_on[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(t)), pa.int32()), pa.array(total), pa.array(least), pa.array(at)],
            ["threshold", "total", "least", "at"],
        )

    # a slice is at most one range partition of points
    sums = (
        blocks.repartition(F.col("slice"))
        .sortWithinPartitions("slice", "lo")
        .groupBy("slice")
        .applyInArrow(
            lambda key, group: pa.Table.from_batches(list(run(iter(group.combine_chunks().to_batches())))).append_column(
                "slice", pa.array([key[0].as_py()] * len(thresholds), pa.int32())
            ),
            "threshold int, total double, least double, at double, slice int",
        )
    )
    # one row per slice and threshold
    before = W.partitionBy("threshold").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    least = F.coalesce(F.sum("total").over(before), F.lit(0.0)) + F.col("least")
    lowest = sums.select("threshold", "at", least.alias("least")).groupBy("threshold").agg(
        F.min("least").alias("least"), F.min_by("at", F.struct("least", "at")).alias("at")
    )
    # where the sum never falls below zero all points are at the threshold or above
    return sorted({r["at"] for r in lowest.where("least < 0").collect()})


def fit(points: DataFrame, score: str, value: str, segments: int | None = None) -> DataFrame:
    """Blocks of the rising fit: number (from 1), lo, hi, fitted, weight and the next block's lo and fitted.

    Rows without a score or value are left out. `segments` defaults to the session's shuffle
    partitions.
    """
    spark = points.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = (
        points.where(F.col(score).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(score).cast("double").alias("lo"))
        .agg(F.sum(F.col(value).cast("double")).alias("total"), F.count("*").cast("double").alias("weight"))
        .select("lo", F.col("lo").alias("hi"), "total", "weight")
    )
    blocks = settled(_pool_in_slices(distinct))
    cuts = _cuts(blocks, segments)
    segment = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("lo"))) if cuts else F.lit(0)

    def pool(group: pa.Table) -> pa.Table:
        m = _matrix(group)
        return pa.Table.from_batches([_table(pooled(m[np.argsort(m[:, 0])]))])

    final = blocks.select(segment.alias("segment"), "lo", "hi", "total", "weight").groupBy("segment").applyInArrow(pool, BLOCK)
    # neighbours meet in running counts, since no one task holds all blocks
    ordered = settled(running_totals(final, [], [F.col("lo").asc()], {"number": F.lit(1).cast("long")}))
    fitted = (F.col("total") / F.col("weight")).alias("fitted")
    after = ordered.select((F.col("number") - 1).alias("number"), F.col("lo").alias("next_lo"), fitted.alias("next_fitted"))
    return ordered.select("number", "lo", "hi", fitted, "weight").join(after, "number", "left")


def predict(blocks: DataFrame, table: DataFrame, score: str, name: str) -> DataFrame:
    """The fit at each row's score: on a line between blocks, held at both ends, null without a score."""
    s = F.col(score).cast("double").alias("_s")
    asked = table.where(F.col(score).isNotNull()).select(s).distinct()
    marks = asked.select("_s", F.lit(0).cast("long").alias("_start")).unionByName(
        blocks.select(F.col("lo").alias("_s"), F.lit(1).cast("long").alias("_start"))
    )
    counted = running_totals(marks, [], [F.col("_s").asc(), F.col("_start").desc()], {"number": F.col("_start")})
    placed = counted.where(F.col("_start") == 0).select("_s", F.greatest("number", F.lit(1)).alias("number"))
    slope = F.try_divide(F.col("next_fitted") - F.col("fitted"), F.col("next_lo") - F.col("hi"))
    beyond = F.greatest(F.col("_s") - F.col("hi"), F.lit(0.0))
    values = placed.join(blocks, "number").select(
        "_s", (F.col("fitted") + F.coalesce(slope * beyond, F.lit(0.0))).alias(name)
    )
    return table.withColumn("_s", s).join(values, "_s", "left").drop("_s")
