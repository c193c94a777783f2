"""Bootstraps by whole clusters, and the exact sign test.

Only per-cluster sums enter a resample, never the rows: the work of B replicates over K
clusters is B x K small rows however many rows a cluster has. Draws come from a hash of
(seed, replicate, slot), so every system of a comparison sees the same draws and a lost
task redraws the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractlens.functions.hashing import hash_index
from tractlens.operators.ranks import kappa_of_sums, ordinal_sums, spearman
from tractlens.operators.scale import numbered_of, settled

RESAMPLES = 2000
LOW, HIGH_END = 0.025, 0.975


def draws(clusters: DataFrame, cluster: str, resamples: int = RESAMPLES, seed: int = 0, counted: bool = True) -> DataFrame:
    """Drawn clusters with their multiplicity: replicate, cluster, times.

    Where they are only summed up once, `counted` = False leaves every draw a row, which saves their shuffle.
    """
    listed = numbered_of(
        clusters.select(cluster).distinct(), [], [F.col(cluster).asc()], "_i", "_k"
    ).withColumn("_i", F.col("_i") - 1)
    # few rows, but each is drawn for every replicate: a fixed number of tasks shares them
    slices = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rolled = listed.repartition(slices, "_i").select(
        F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"), "_i", "_k"
    ).select("replicate", hash_index(F.col("_k"), seed, F.col("replicate"), F.col("_i")).alias("_i"))
    if counted:
        rolled = rolled.groupBy("replicate", "_i").agg(F.count("*").alias("times"))
    else:
        rolled = rolled.withColumn("times", F.lit(1).cast("long"))
    return rolled.join(listed.drop("_k"), "_i").select("replicate", cluster, "times")


def _ends(replicates: DataFrame, group: Sequence[str], value: str, prefix: str = "ci") -> DataFrame:
    # at most `resamples` values per group
    return replicates.groupBy(*group).agg(
        F.percentile(value, F.array(F.lit(LOW), F.lit(HIGH_END))).alias("_e")
    ).select(*group, F.col("_e")[0].alias(f"{prefix}_low"), F.col("_e")[1].alias(f"{prefix}_high"))


def cluster_sums(values: DataFrame, cluster: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """All that a resample of means needs: sum and count per cluster."""
    return (
        values.where(F.col(value).isNotNull())
        .groupBy(*group, cluster)
        .agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    )


def replicate_means(sums: DataFrame, cluster: str, drawn: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean of the pooled members of the drawn clusters, per replicate."""
    t = F.col("times")
    return (
        drawn.join(sums, cluster)
        .groupBy(*group, "replicate")
        .agg((F.sum(F.col("_s") * t) / F.sum(F.col("_n") * t)).alias("mean"))
    )


def clustered_mean(
    values: DataFrame,
    cluster: str,
    value: str,
    group: Sequence[str] = (),
    *,
    resamples: int = RESAMPLES,
    seed: int = 0,
    drawn: DataFrame | None = None,
) -> DataFrame:
    """Mean with the percentile interval of a cluster bootstrap, per group on shared draws."""
    sums = settled(cluster_sums(values, cluster, value, group))
    drawn = draws(sums, cluster, resamples, seed, counted=False) if drawn is None else drawn
    ends = _ends(replicate_means(sums, cluster, drawn, group), group, "mean")
    point = sums.groupBy(*group).agg(
        (F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("members")
    )
    if group:
        joined = point.join(ends, list(group))
    else:
        joined = point.select("*", ends.select("ci_low").scalar().alias("ci_low"), ends.select("ci_high").scalar().alias("ci_high"))
    return joined.withColumn("half_width", (F.col("ci_high") - F.col("ci_low")) / 2.0)


def clustered_ratio(
    values: DataFrame, cluster: str, top: str, bottom: str, *, resamples: int = RESAMPLES, seed: int = 0
) -> DataFrame:
    """Ratio of two means with a cluster bootstrap."""
    both = values.where(F.col(top).isNotNull() & F.col(bottom).isNotNull())
    sums = settled(
        both.groupBy(cluster).agg(F.sum(top).alias("_a"), F.sum(bottom).alias("_b"), F.count("*").alias("_n"))
    )
    drawn = draws(sums, cluster, resamples, seed, counted=False)
    ratios = (
        drawn.join(sums, cluster)
        .groupBy("replicate")
        .agg(F.try_divide(F.sum(F.col("_a") * F.col("times")), F.sum(F.col("_b") * F.col("times"))).alias("ratio"))
    )
    ends = _ends(ratios, [], "ratio")
    return sums.agg(F.try_divide(F.sum("_a"), F.sum("_b")).alias("fraction"), F.sum("_n").alias("members")).select(
        "fraction",
        ends.select("ci_low").scalar().alias("ci_low"),
        ends.select("ci_high").scalar().alias("ci_high"),
        "members",
    )


def row_bootstrap(values: DataFrame, key: str, value: str, *, resamples: int = 10000, seed: int = 0) -> DataFrame:
    """Each row is its own cluster; also the share of replicates above zero."""
    sums = settled(cluster_sums(values, key, value))
    drawn = draws(sums, key, resamples, seed)
    means = replicate_means(sums, key, drawn)
    spread = means.agg(
        F.percentile("mean", F.array(F.lit(LOW), F.lit(HIGH_END))).alias("_e"),
        F.avg((F.col("mean") > 0).cast("double")).alias("_f"),
    )
    return sums.agg((F.sum("_s") / F.sum("_n")).alias("mean")).select(
        "mean",
        spread.select(F.col("_e")[0]).scalar().alias("ci_low"),
        spread.select(F.col("_e")[1]).scalar().alias("ci_high"),
        spread.select("_f").scalar().alias("positive_fraction"),
    )


def _times(slots: int, resamples: int, seed: int) -> np.ndarray:
    """Multiplicity of each cluster (by number) in each replicate, as `draws` gives it, and 1 in a last column."""
    out = np.zeros((slots, resamples + 1))
    out[:, resamples] = 1.0
    for replicate in range(resamples):
        for slot in range(slots):
            digest = hashlib.md5(f"{seed}|{replicate}|{slot}".encode()).hexdigest()
            out[int(digest[:8], 16) % slots, replicate] += 1
    return out


def replicate_areas(marks: DataFrame, slots: int, resamples: int, seed: int = 0) -> DataFrame:
    """Area under the curve of each series in every replicate: series, replicate, auroc.

    `marks(series, mark, slot, pos, neg)` counts rows of a cluster (by number) with a mark. Each
    range slice of (series, mark) multiplies its counts by the draw matrix in blocks and sends on
    three sums per replicate, so neither rows nor distinct marks meet the replicates anywhere else.
    Replicate number `resamples` takes every cluster once: the point value. The matrix holds
    clusters times replicates; clusters are cities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = None
        held: dict[str, list[np.ndarray]] = {}
        last: tuple[str, float] | None = None
        tie = np.zeros((2, resamples + 1))

        def close() -> None:
            if last is not None:
                sums = held.setdefault(last[0], [np.zeros(resamples + 1) for _ in range(3)])
                sums[2] += tie[0] * (sums[1] + tie[1] / 2.0)
                sums[0] += tie[0]
                sums[1] += tie[1]

        for batch in batches:
            if times is None:
                times = _times(slots, resamples, seed)
            series, mark = batch.column("series").to_pylist(), batch.column("mark").to_numpy()
            slot, pos, neg = (batch.column(c).to_numpy() for c in ("slot", "pos", "neg"))
            for start in range(0, len(series), 2048):
                part = slice(start, start + 2048)
                names, values, drawn = series[part], mark[part], times[slot[part]]
                p, q = drawn * pos[part, None], drawn * neg[part, None]
                new = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1] or values[i] != values[i - 1]]
                p, q = np.add.reduceat(p, new), np.add.reduceat(q, new)
                for row, i in enumerate(new):
                    if (names[i], values[i]) != last:
                        close()
                        last, tie = (names[i], values[i]), np.zeros((2, resamples + 1))
                    tie = tie + np.stack([p[row], q[row]])
        close()
        for name, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name])] + [pa.array([s], pa.list_(pa.float64())) for s in sums], ["series", "p", "q", "won"]
            )

    ranged = marks.repartitionByRange("series", "mark").sortWithinPartitions("series", "mark")
    slices = settled(
        ranged.select("series", F.col("mark").cast("double").alias("mark"), "slot", "pos", "neg")
        .mapInArrow(run, "series string, p array<double>, q array<double>, won array<double>")
        .withColumn("slice", F.spark_partition_id())
    )
    # a row per slice, series and replicate
    long = slices.select("series", "slice", F.posexplode(F.arrays_zip("p", "q", "won")).alias("replicate", "v")).select(
        "series", "slice", "replicate", "v.*"
    )
    before = W.partitionBy("series", "replicate").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    won = F.col("won") + F.col("p") * F.coalesce(F.sum("q").over(before), F.lit(0.0))
    pairs = F.sum("p") * F.sum("q")
    return (
        long.select("series", "replicate", "p", "q", won.alias("won"))
        .groupBy("series", "replicate")
        .agg(F.when(pairs > 0, F.sum("won") / pairs).alias("auroc"))
        .where("auroc IS NOT NULL")
    )


def metric_bootstrap(
    table: DataFrame,
    cluster: str,
    truth: str,
    prediction: str,
    score: str,
    *,
    probabilities: str | None = None,
    resamples: int = 400,
    seed: int = 0,
    classes: int = 5,
) -> DataFrame:
    """Kappa, rank correlation and every area under the curve with intervals by whole clusters.

    Returns metric, value, ci_low and ci_high. Kappa and rank correlation follow from the counts of
    (truth, prediction) of each cluster. The evidence for class k against the rest is its entry of
    `probabilities` where there are any, else the closeness of the score to k.
    """
    measures = [cluster, truth, prediction, score] + ([probabilities] if probabilities else [])
    table = settled(table.select(*measures))
    listed = settled(
        numbered_of(table.select(cluster).distinct(), [], [F.col(cluster).asc()], "_i", "_k").select(
            cluster, (F.col("_i") - 1).cast("int").alias("slot")
        )
    )
    slots = listed.count()
    point = listed.select(F.lit(resamples).alias("replicate"), cluster, F.lit(1).cast("long").alias("times"))
    drawn = settled(draws(listed, cluster, resamples, seed).unionByName(point))
    hard = table.groupBy(cluster, truth, prediction).agg(F.count("*").alias("_c"))
    weighted = settled(
        drawn.join(hard, cluster)
        .groupBy("replicate", truth, prediction)
        .agg(F.sum(F.col("_c") * F.col("times")).alias("_w"))
    )
    # replicates that drew one grade only say nothing
    two = weighted.groupBy("replicate").agg(F.min(truth).alias("a"), F.max(truth).alias("b")).where("a < b").select("replicate")
    sums = weighted.groupBy("replicate").agg(*ordinal_sums(truth, prediction, classes, F.col("_w")))
    kappa = sums.select("replicate", F.lit("kappa").alias("metric"), kappa_of_sums().alias("value"))
    rho = spearman(weighted, truth, prediction, ["replicate"], weight="_w").select(
        "replicate", F.lit("spearman").alias("metric"), F.col("rho").alias("value")
    )
    t, s = F.col(truth), F.col(score).cast("double")
    series = [
        F.struct(F.lit(f"auroc_ge_{k}").alias("series"), s.alias("mark"), (t >= k).alias("hit")) for k in range(1, classes)
    ]
    for k in range(classes):
        mark = F.col(probabilities)[k] if probabilities else -F.abs(s - F.lit(float(k)))
        if probabilities:
            mark = F.coalesce(mark, -F.abs(s - F.lit(float(k))))
        series.append(F.struct(F.lit(f"auroc_is_{k}").alias("series"), mark.alias("mark"), (t == k).alias("hit")))
    marks = (
        table.join(listed, cluster)
        .select("slot", F.explode(F.array(*series)).alias("m"))
        .groupBy("m.series", "m.mark", "slot")
        .agg(F.count_if("m.hit").alias("pos"), F.count_if(~F.col("m.hit")).alias("neg"))
    )
    areas = settled(replicate_areas(marks, slots, resamples, seed)).select(
        "replicate", F.col("series").alias("metric"), F.col("auroc").alias("value")
    )
    every = kappa.unionByName(rho).unionByName(areas)
    for name, like in (("auroc_cumulative_mean", "auroc_ge_%"), ("auroc_macro", "auroc_is_%")):
        mean = areas.where(F.col("metric").like(like)).groupBy("replicate").agg(F.avg("value").alias("value"))
        every = every.unionByName(mean.select("replicate", F.lit(name).alias("metric"), "value"))
    every = settled(every.where("value IS NOT NULL").join(two, "replicate", "left_semi"))
    ends = _ends(every.where(F.col("replicate") < resamples), ["metric"], "value")
    return every.where(F.col("replicate") == resamples).select("metric", "value").join(ends, "metric", "left")


def sign_test(differences: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact two-sided sign test without the zeros: n, in_favour, p.

    The binomial tail is summed in logarithms, each term from the one before it.
    """
    counted = differences.where(F.col(value) != 0).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum((F.col(value) > 0).cast("long")).alias("in_favour")
    )
    n = F.col("n").cast("double")
    extreme = F.greatest(F.col("in_favour"), F.col("n") - F.col("in_favour"))

    def step(acc: Column, j: Column) -> Column:
        term, total = acc["term"], acc["total"]
        top = F.greatest(term, total)
        return F.struct(
            (term + F.log((n - j) / (j + 1.0))).alias("term"),
            (top + F.log(F.exp(term - top) + F.exp(total - top))).alias("total"),
        )

    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(-1e300).alias("total"))
    # the last step would take the log of zero when the tail runs to k = 0, which it never does
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("n") - extreme), start, step, lambda a: a["total"])
    return counted.withColumn(
        "p", F.when(F.col("n") > 0, F.least(F.lit(1.0), 2.0 * F.exp(tail)))
    ).select(*group, "n", F.coalesce("in_favour", F.lit(0)).cast("long").alias("in_favour"), "p")
