"""Composites, vectors and score tables on disk; resume, staleness and progress."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.session import scratch_folder  # noqa: F401  (callers write beside the stores)


# ---- composites and vectors ---------------------------------------------------------------


def composite_faults(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Why a composite may not be saved: empty, bands of different extent, off its grid."""
    bands = pixels.groupBy("box", "sensor", "band").agg(
        (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")
    )
    shapes = bands.groupBy("box", "sensor").agg(
        F.countDistinct("h", "w").alias("shapes"), F.max("h").alias("bh"), F.max("w").alias("bw")
    )
    joined = grids.join(shapes, ["box", "sensor"], "left")
    reason = (
        F.when(F.col("shapes").isNull(), "no bands")
        .when(F.col("shapes") > 1, "mixed shapes")
        .when((F.col("bh") != F.col("h")) | (F.col("bw") != F.col("w")), "off grid")
    )
    return joined.select("box", "sensor", reason.alias("reason")).where(F.col("reason").isNotNull())


class RefusedWrite(ValueError):
    """What was to be saved is faulty; the store still holds what it held."""


def publish(staged: DataFrame, folder: str, faults, partition_by: Sequence[str] = (), tags: dict[str, str] | None = None) -> int:
    """Writes a version beside the others, checks what was written, and only then names it in the manifest.

    `faults` maps the version as read back to a table of faults, empty where all is well. A reader
    takes the newest version of the manifest, so it never meets a half-written or faulty one; a
    refused version stays unnamed. Versions of two writers at once get the same number, and the one
    whose folder sorts last counts.
    """
    spark = staged.sparkSession
    name = uuid.uuid4().hex
    writer = staged.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/versions/{name}")
    back = spark.read.schema(staged.schema).parquet(f"{folder}/versions/{name}")
    # a few faults are enough to name them
    found = [", ".join(map(str, r)) for r in faults(back).limit(20).collect()]
    if found:
        raise RefusedWrite(f"not saved to {folder}: " + "; ".join(found))
    number = max((r["number"] for r in _versions(spark, folder)), default=0) + 1
    row = [(number, name, dict(tags or {}))]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return number


_MANIFEST = "number long, name string, tags map<string, string>"


def _versions(spark: SparkSession, folder: str) -> list:
    """The manifest: a row per version."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/manifest").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def newest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the newest version, with the given types."""
    versions = _versions(spark, folder)
    if not versions:
        raise FileNotFoundError(f"nothing was saved to {folder}")
    last = max(versions, key=lambda r: (r["number"], r["name"]))
    return spark.read.schema(schema).parquet(f"{folder}/versions/{last['name']}")


def tags_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """What was written down with the newest version, such as the scenes it was made from."""
    return max(_versions(spark, folder), key=lambda r: (r["number"], r["name"]))["tags"]


def save_composite(pixels: DataFrame, grids: DataFrame, folder: str, tags: dict[str, str] | None = None) -> int:
    """Pixels by box and sensor, sorted so that row and column ranges prune inside a file.

    Refused where a grid has no bands, bands differ in extent or do not fill their grid, or pixels
    belong to no grid.
    """
    laid = pixels.repartition("box", "sensor", F.expr("r div 1024")).sortWithinPartitions("box", "sensor", "band", "r", "c")

    def faults(back: DataFrame) -> DataFrame:
        keys = ["box", "sensor"]
        strangers = back.select(*keys).distinct().join(grids, keys, "left_anti").withColumn("reason", F.lit("no grid"))
        return composite_faults(back, grids).unionByName(strangers)

    return publish(laid, folder, faults, ["box", "sensor"], tags)


def load_composite(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Explicit types: partition folders must not turn keys into numbers."""
    return newest(spark, folder, schema)


def vector_faults(vectors: DataFrame, instances: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Why vectors may not stand for instances: fault and number of rows."""
    widths = vectors.agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b"), F.count("*").alias("n"))
    spoilt = F.col(vec).isNull() | F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")))
    repeated = vectors.groupBy(*keys).count().where("count > 1")
    parts = [
        widths.where("a <> b").select(F.lit("vectors of different length").alias("fault"), F.col("n").alias("rows")),
        widths.where("n = 0").select(F.lit("no vectors").alias("fault"), F.col("n").alias("rows")),
        vectors.where(spoilt).agg(F.count("*").alias("rows")).where("rows > 0").select(F.lit("gaps in vectors").alias("fault"), "rows"),
        repeated.agg(F.count("*").alias("rows")).where("rows > 0").select(F.lit("repeated keys").alias("fault"), "rows"),
        misaligned(instances, vectors, keys).select(F.col("side").alias("fault"), "rows"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def save_vectors(vectors: DataFrame, instances: DataFrame, keys: Sequence[str], folder: str, by: str = "bag") -> int:
    """Vectors by bag; refused where they do not stand for the instances one to one."""
    return publish(vectors, folder, lambda back: vector_faults(back, instances, keys), [by])


def load_vectors(spark: SparkSession, folder: str, schema: str, instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest vectors; raises where the instances have moved on since they were saved."""
    vectors = newest(spark, folder, schema)
    found = [f"{r['side']}: {r['rows']} rows" for r in misaligned(instances, vectors, keys).collect()]
    if found:
        raise ValueError(f"vectors of {folder} and instances do not match: " + "; ".join(found))
    return vectors


def misaligned(instances: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Instances without a vector and vectors without an instance."""
    a = instances.select(*keys).withColumn("_a", F.lit(1))
    b = vectors.select(*keys).withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "no vector").when(F.col("_a").isNull(), "no instance")
    return (
        a.join(b, list(keys), "full_outer")
        .withColumn("side", side)
        .where(F.col("side").isNotNull())
        .groupBy("side")
        .agg(F.count("*").alias("rows"))
    )


def collect_bags(bags: DataFrame, instances: DataFrame) -> DataFrame:
    """Bag rows of the cities that have instances."""
    return bags.join(instances.select("city").distinct(), "city", "left_semi")


def grids_agree(grids: DataFrame, one: str = "s1", other: str = "s2") -> DataFrame:
    """Do the two sensors of a box share shape and reference system."""
    a = grids.where(F.col("sensor") == one).select("box", "h", "w", "crs")
    b = grids.where(F.col("sensor") == other).select(
        "box", F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("crs").alias("_crs")
    )
    same = (
        F.col("h").eqNullSafe(F.col("_h")) & F.col("w").eqNullSafe(F.col("_w")) & F.col("crs").eqNullSafe(F.col("_crs"))
    )
    return a.join(b, "box").select("box", same.alias("agree"))


# ---- incremental work ---------------------------------------------------------------------


def pending(keys: DataFrame, done: DataFrame, key: str, expected: int = 1) -> DataFrame:
    """Keys without complete output: absent, or with fewer than `expected` parts."""
    full = done.groupBy(key).agg(F.countDistinct("part").alias("_p")).where(F.col("_p") >= expected)
    return keys.join(full, key, "left_anti")


def drop_derived(derived: DataFrame, redo: DataFrame, key: str) -> DataFrame:
    """Derived rows that survive: those of keys about to be rebuilt go."""
    return derived.join(redo.select(key), key, "left_anti")


def overwrite_partitions(df: DataFrame, folder: str, *columns: str) -> None:
    """Replaces only the partitions the frame holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(folder)


def staleness(stored: DataFrame, current: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Reason per key why a stored composite or its vectors cannot be reused, or 'fresh'."""
    joined = current.join(
        stored.select("box", *[F.col(c).alias(f"_{c}") for c in stored.columns if c != "box"]), "box", "left"
    )
    moved = F.lit(False)
    for c in ("xmin", "ymin", "xmax", "ymax"):
        moved = moved | (F.abs(F.col(c) - F.col(f"_{c}")) > tolerance)
    # a comparison with a null is neither true nor false, so what is missing is named, not called fresh
    reason = (
        F.when(F.col("_xmin").isNull(), "absent")
        .when(F.coalesce(moved, F.lit(True)), "covers another box")
        .when(~F.array_sort("bands").eqNullSafe(F.array_sort("_bands")), "other bands")
        .when(F.col("_token_y").isNull() | F.col("_token_x").isNull(), "no tokens")
        .when((F.col("_token_y") + 16 > F.col("h")) | (F.col("_token_x") + 16 > F.col("w")), "tokens beyond raster")
        .when(F.col("_vector_rows").isNull(), "no vectors")
        .when(~F.col("_vector_rows").eqNullSafe(F.col("_instance_rows")), "rows differ")
        .otherwise("fresh")
    )
    return joined.select("box", reason.alias("state"))


def progress(keys: DataFrame, outputs: DataFrame, failed: DataFrame, parts: int = 2) -> DataFrame:
    """complete, failed, partial or pending per key; a failure outranks a lone part."""
    found = outputs.groupBy("key").agg(F.countDistinct("part").alias("_n"))
    bad = failed.select("key").distinct().withColumn("_f", F.lit(1))
    state = (
        F.when(F.col("_n") >= parts, "complete")
        .when(F.col("_f").isNotNull(), "failed")
        .when(F.col("_n") > 0, "partial")
        .otherwise("pending")
    )
    return keys.join(found, "key", "left").join(bad, "key", "left").select("key", state.alias("state"))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per log file, column `value`; a log is what one process wrote."""
    return spark.read.text(folder, wholetext=True)


def failures_since_relaunch(logs: DataFrame, mark: str = "RELAUNCHED") -> DataFrame:
    """Keys on FAIL lines after the last relaunch mark of each log."""
    recent = F.substring_index("value", mark, -1)
    return (
        logs.select(F.explode(F.split(recent, "\n")).alias("line"))
        .where(F.col("line").startswith("FAIL "))
        .select(F.regexp_extract("line", r"^FAIL (\S+)", 1).alias("key"))
    )


# ---- migration ----------------------------------------------------------------------------


def migrate(table: DataFrame, renames: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """Renames the columns that are present and recodes values; others stay as they are."""
    out = table.withColumnsRenamed(renames)
    for column, codes in values.items():
        if column in out.columns:
            out = out.withColumn(column, _recoded(F.col(column), codes))
    return out


def _recoded(value: Column, codes: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def migration_changes(table: DataFrame, renames: dict[str, str], values: dict[str, dict[str, str]]) -> DataFrame:
    """How many columns and values a migration would touch; nothing is rewritten on zero."""
    named = sum(c in table.columns for c in renames)
    moved = table.withColumnsRenamed(renames)
    counts = [
        F.sum(F.col(c).isin(*codes).cast("long")).alias(f"{c}_recoded") for c, codes in values.items() if c in moved.columns
    ]
    return moved.agg(F.lit(named).alias("columns_renamed"), *counts)
