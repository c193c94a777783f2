"""Labels: grades, municipal aggregates, city selection, bag building and catalogue sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.operators.scale import (
    exact_percentiles,
    numbered,
    with_stats,
)

# fixed values: the five grades in order, and their spelling in the source workbook
GRADES = ("Very low", "Low", "Medium", "High", "Very high")
SOURCE_GRADES = {
    "Muy bajo": "Very low",
    "Bajo": "Low",
    "Medio": "Medium",
    "Alto": "High",
    "Muy alto": "Very high",
}
HIGH = 3
THRESHOLDS = (1, 2, 3, 4)


def grade_of(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GRADES)), ordinal.cast("int") + 1)


def municipality_of(cvegeo: Column) -> Column:
    return F.substring(cvegeo, 1, 5)


def _rounded_grade(mean: Column) -> Column:
    return F.least(F.greatest(F.bround(mean), F.lit(0.0)), F.lit(4.0)).cast("int")


def municipal_labels(tracts: DataFrame) -> DataFrame:
    """Population-weighted label of each municipality; unweighted where nobody lives.

    Both the weighted and the plain sums are kept in one pass, so the choice between them
    needs no second look at the tracts.
    """
    clean = tracts.where(F.col("ordinal").isNotNull()).select(
        municipality_of(F.col("cvegeo")).alias("municipality"),
        F.col("ordinal").cast("double").alias("g"),
        F.coalesce(F.col("population").cast("double"), F.lit(0.0)).alias("w"),
    )
    over = [(F.col("g") >= k).cast("double") for k in THRESHOLDS]
    sums = clean.groupBy("municipality").agg(
        F.sum("w").alias("w"),
        F.count("*").alias("tracts"),
        F.sum(F.col("w") * F.col("g")).alias("wg"),
        F.sum("g").alias("sg"),
        *[F.sum(F.col("w") * o).alias(f"w{k}") for k, o in zip(THRESHOLDS, over, strict=True)],
        *[F.sum(o).alias(f"s{k}") for k, o in zip(THRESHOLDS, over, strict=True)],
    )
    lived = F.col("w") > 0
    mean = F.when(lived, F.col("wg") / F.col("w")).otherwise(F.col("sg") / F.col("tracts"))
    return (
        sums.withColumn("ordinal_continuous", mean)
        .withColumn("ordinal", _rounded_grade(F.col("ordinal_continuous")))
        .select(
            "municipality",
            "ordinal",
            "ordinal_continuous",
            *[
                F.when(lived, F.col(f"w{k}") / F.col("w"))
                .otherwise(F.col(f"s{k}") / F.col("tracts"))
                .alias(f"p{k}")
                for k in THRESHOLDS
            ],
            F.when(lived, F.col("w")).otherwise(F.col("tracts").cast("double")).alias("population"),
            "tracts",
            grade_of(F.col("ordinal")).alias("grade"),
        )
    )


def shares_by_level(tracts: DataFrame) -> DataFrame:
    """Shares of people at grade k or above by municipality, state and nation, as one rollup."""
    base = tracts.select(
        F.substring("cvegeo", 1, 2).alias("state"),
        municipality_of(F.col("cvegeo")).alias("municipality"),
        F.col("ordinal"),
        F.col("population"),
    )
    return (
        base.rollup("state", "municipality")
        .agg(
            F.grouping_id().alias("gid"),
            *[
                F.try_divide(
                    F.sum(F.when(F.col("ordinal") >= k, F.col("population")).otherwise(0.0)),
                    F.sum("population"),
                ).alias(f"p{k}")
                for k in THRESHOLDS
            ],
        )
        .select(
            F.when(F.col("gid") == 0, "municipality")
            .when(F.col("gid") == 1, "state")
            .otherwise("national")
            .alias("level"),
            F.coalesce("municipality", "state", F.lit("all")).alias("unit"),
            *[f"p{k}" for k in THRESHOLDS],
        )
    )


def relabel(bags: DataFrame, tracts: DataFrame, level: str) -> DataFrame:
    """Gives every bag the shares of the coarser unit it lies in."""
    shares = [f"p{k}" for k in THRESHOLDS]
    if level == "municipality":
        return bags
    unit = {
        "state": F.substring("municipality", 1, 2),
        "national": F.lit("all"),
    }[level]
    coarse = shares_by_level(tracts).where(F.col("level") == level).drop("level")
    return (
        bags.drop(*shares)
        .withColumn("unit", unit)
        .join(coarse, "unit")
        .drop("unit")
    )


def grade_summary(tracts: DataFrame) -> DataFrame:
    """Tracts, population and share per grade; absent grades count zero."""
    spark = tracts.sparkSession
    grades = spark.range(len(GRADES)).select(F.col("id").cast("int").alias("ordinal"))
    counts = tracts.groupBy("ordinal").agg(
        F.count("*").alias("tracts"), F.sum("population").alias("population")
    )
    total = tracts.where(F.col("ordinal").isNotNull()).agg(F.count("*")).scalar()
    return grades.join(counts, "ordinal", "left").select(
        grade_of(F.col("ordinal")).alias("grade"),
        F.coalesce("tracts", F.lit(0)).cast("long").alias("tracts"),
        F.floor(F.coalesce("population", F.lit(0.0))).alias("population"),
        F.bround(100.0 * F.coalesce("tracts", F.lit(0)) / F.greatest(total, F.lit(1)), 1).alias("pct_tracts"),
    )


def cities_by_size(
    tracts: DataFrame,
    min_tracts: int = 150,
    *,
    stratify: bool = False,
    min_deprived: int = 50,
    deprived_share: float = 0.25,
) -> DataFrame:
    """Municipalities big enough, or smaller ones with concentrated deprivation."""
    counts = tracts.groupBy("municipality").agg(
        F.count("*").alias("tracts"),
        F.sum((F.col("ordinal") >= HIGH).cast("long")).alias("high"),
    )
    keep = F.col("tracts") >= min_tracts
    if stratify:
        keep = keep | (
            (F.col("tracts") >= min_deprived)
            & (F.col("high").cast("double") / F.col("tracts") >= deprived_share)
        )
    return counts.where(keep).withColumn("high_share", F.col("high").cast("double") / F.col("tracts"))


def build_bags(
    instances: DataFrame, labels: DataFrame, min_instances: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Bag rows with their instance counts, and the instances of the bags that remain."""
    counts = instances.groupBy("city", "municipality").agg(F.count("*").alias("instances"))
    bags = labels.join(
        counts.where(F.col("instances") >= min_instances), "municipality"
    )
    return instances.join(bags.select("city", "municipality"), ["city", "municipality"], "left_semi"), bags


def population_weights(tokens: DataFrame, population: DataFrame) -> DataFrame:
    """Weight of a token: people of its tract over the tract's tokens, mean one in the bag.

    A tract without people takes the median weight of the bag's other tracts.
    """
    per_tract = (
        tokens.groupBy("municipality", "cvegeo")
        .agg(F.count("*").alias("tokens"))
        .join(population.select("cvegeo", "population"), "cvegeo", "left")
        .withColumn("raw", F.when(F.col("population") > 0, F.col("population") / F.col("tokens")))
    )
    fallback = exact_percentiles(per_tract, ["municipality"], "raw", {"middle": 0.5})
    filled = per_tract.join(fallback, "municipality", "left").withColumn(
        "raw", F.coalesce("raw", "middle", F.lit(1.0))
    )
    filled = with_stats(
        filled,
        ["municipality"],
        (F.sum(F.col("raw") * F.col("tokens")) / F.sum("tokens")).alias("mean_raw"),
    )
    weights = filled.select("cvegeo", (F.col("raw") / F.col("mean_raw")).alias("weight"))
    return tokens.join(weights, "cvegeo")


def inverse_frequency(bags: DataFrame, classes: int = 5) -> DataFrame:
    """Class weights n / (k * count); an absent class weighs nothing."""
    total = bags.agg(F.count("*")).scalar()
    grades = bags.sparkSession.range(classes).select(F.col("id").cast("int").alias("ordinal"))
    counts = bags.groupBy("ordinal").agg(F.count("*").alias("bags"))
    return grades.join(counts, "ordinal", "left").select(
        "ordinal",
        F.coalesce("bags", F.lit(0)).cast("long").alias("bags"),
        F.coalesce(total.cast("double") / (F.lit(float(classes)) * F.col("bags")), F.lit(0.0)).alias("weight"),
    )


def join_labels(polygons: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the tract key."""
    return polygons.join(labels, "cvegeo")


def label_audit(polygons: DataFrame, labels: DataFrame) -> DataFrame:
    """How many polygons found a label, over how many municipalities."""
    marked = polygons.select("cvegeo").join(
        labels.select("cvegeo", F.lit(1).alias("hit")), "cvegeo", "left"
    )
    hit = F.col("hit") == 1
    return marked.agg(
        F.count("*").alias("polygons"),
        F.count("hit").alias("matched"),
        F.countDistinct(F.when(hit, municipality_of(F.col("cvegeo")))).alias("municipalities"),
        (F.count("*") - F.count("hit")).alias("dropped"),
    )


def fuse(optical: DataFrame, radar: DataFrame, key: str = "cvegeo") -> DataFrame:
    """Optical rows with the radar columns of the same key; context columns are taken once."""
    image = [c for c in radar.columns if c.startswith("s1")]
    return optical.join(radar.select(key, *image), key)


def fuse_unmatched(optical: DataFrame, radar: DataFrame, key: str = "cvegeo") -> DataFrame:
    """Keys present in only one modality."""
    left = optical.select(key).distinct().withColumn("o", F.lit(1))
    right = radar.select(key).distinct().withColumn("r", F.lit(1))
    return left.join(right, key, "full_outer").agg(
        F.sum(F.when(F.col("o").isNull() | F.col("r").isNull(), 1).otherwise(0)).alias("unmatched")
    )


def extra_municipalities(wide: DataFrame, base: DataFrame, bags: DataFrame) -> DataFrame:
    """Members of the wide set that are neither a seat of the base nor inside one of its bags."""
    return wide.join(base.select("municipality"), "municipality", "left_anti").join(
        bags.select("municipality"), "municipality", "left_anti"
    )


def merge_catalogues(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base rows keep their keys; a newcomer with a taken key gets its municipality appended."""
    taken = base.select("key").distinct().withColumn("taken", F.lit(1))
    first = numbered(extra, ["key"], [F.col("tracts").desc(), F.col("municipality")], "_place")
    renamed = (
        first.join(taken, "key", "left")
        .withColumn(
            "key",
            F.when(F.col("taken").isNotNull() | (F.col("_place") > 1), F.concat("key", "municipality"))
            .otherwise(F.col("key")),
        )
        .drop("taken", "_place")
    )
    return base.withColumn("source", F.lit("base")).unionByName(
        renamed.select(*base.columns).withColumn("source", F.lit("extra"))
    )


def exclude_leaks(training: DataFrame, *held: DataFrame) -> DataFrame:
    """Training bags whose municipality occurs in no held-out bag."""
    for other in held:
        training = training.join(other.select("municipality"), "municipality", "left_anti")
    return training


def disjoint(training: DataFrame, *held: DataFrame, column: str = "municipality") -> DataFrame:
    """The training bags as they are; raises where one stands on held-out ground."""
    for other in held:
        # a few names tell enough
        shared = training.select(column).distinct().join(other.select(column), column, "left_semi").orderBy(column).limit(10).collect()
        if shared:
            raise ValueError("trains on held-out ground: " + ", ".join(str(r[0]) for r in shared))
    return training


def winner_boxes(tokens: DataFrame) -> DataFrame:
    """Rows of the box that holds most tokens of a municipality; ties go to the first key."""
    counts = tokens.groupBy("municipality", "key").agg(F.count("*").alias("n"))
    winner = counts.groupBy("municipality").agg(
        F.min_by("key", F.struct((-F.col("n")).alias("n"), F.col("key"))).alias("key")
    )
    return tokens.join(winner, ["municipality", "key"], "left_semi")


def scaled_share(bags: DataFrame, income: str = "income", name: str = "share") -> DataFrame:
    """Minus log income scaled to [0, 1] over the bags."""
    low = bags.agg(F.min(-F.log(income))).scalar()
    high = bags.agg(F.max(-F.log(income))).scalar()
    return bags.withColumn(
        name, (-F.log(income) - low) / F.greatest(high - low, F.lit(1e-9))
    )
