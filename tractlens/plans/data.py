"""The engine's input tables, derived from the driver's tables, once in Spark and once in SQL.

`Data` gives DataFrames; `cte(...)` gives the same tables as a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: market segments in alphabetical order stand for the five grades 0..4
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TOKEN_PX = 16
GRID_COLS = 128


def _pad(name: str, width: int) -> Column:
    return F.lpad(F.col(name).cast("string"), width, "0")


class Data:
    """Tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def places(self) -> DataFrame:
        """Nation as municipality, region as city."""
        return self.table("nation").select(
            F.col("n_nationkey").alias("nationkey"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("city"),
            F.concat(_pad("n_regionkey", 2), _pad("n_nationkey", 3)).alias("municipality"),
        )

    def tracts(self) -> DataFrame:
        """cvegeo, city, municipality, ordinal, population, custkey."""
        customer = self.table("customer")
        return customer.join(F.broadcast(self.places()), customer.c_nationkey == F.col("nationkey")).select(
            F.concat(F.col("municipality"), _pad("c_custkey", 8)).alias("cvegeo"),
            "city",
            "municipality",
            (F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1)
            .cast("int")
            .alias("ordinal"),
            (F.greatest(F.col("c_acctbal"), F.lit(0.0)) + 1.0).alias("population"),
            F.col("c_custkey").alias("custkey"),
        )

    def tokens(self) -> DataFrame:
        """One token per order: key of its tract, lattice position, score."""
        orders = self.table("orders")
        return orders.join(
            self.tracts().select("custkey", "cvegeo", "city", "municipality", "ordinal"),
            orders.o_custkey == F.col("custkey"),
        ).select(
            "city",
            "municipality",
            "cvegeo",
            "ordinal",
            F.expr(f"o_orderkey div {GRID_COLS} * {TOKEN_PX}").alias("y0"),
            F.expr(f"o_orderkey % {GRID_COLS} * {TOKEN_PX}").alias("x0"),
            F.col("o_totalprice").alias("score"),
            F.col("o_orderkey").alias("orderkey"),
        )

    def token_scores(self) -> DataFrame:
        """The score table: one row per token and seed."""
        per_seed = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("orderkey"), (F.col("l_linenumber") % 3).alias("seed"))
            .agg((F.avg("l_extendedprice") / 9973.0).alias("score"))
        )
        return self.tokens().drop("score").join(per_seed, "orderkey").drop("orderkey")

    def tract_scores(self) -> DataFrame:
        """Mean token score per tract with the tract's truth."""
        return (
            self.tokens()
            .groupBy("city", "municipality", "cvegeo")
            .agg(F.avg("score").alias("score"))
            .join(self.tracts().select("cvegeo", "population", "ordinal"), "cvegeo")
        )

    def scenes(self) -> DataFrame:
        """Catalogue of acquisitions: tile, time, cloud, box."""
        lon = (F.col("user_id") % 20).cast("double")
        lat = (F.col("event_id") % 15).cast("double")
        return self.table("events").select(
            F.col("event_id").alias("scene_id"),
            F.lit("optical").alias("collection"),
            F.col("event_type").alias("tile"),
            F.col("ts").cast("timestamp").alias("acquired"),
            (F.col("value") / 5.0).alias("cloud"),
            F.struct(
                lon.alias("xmin"), lat.alias("ymin"), (lon + 3.0).alias("xmax"), (lat + 2.0).alias("ymax")
            ).alias("bbox"),
        )

    def pixels(self) -> DataFrame:
        """Long pixel table: box, scene, band, r, c, class, value."""
        return (
            self.table("lineitem")
            .groupBy(
                (F.col("l_suppkey") % 4).alias("box"),
                F.col("l_linenumber").alias("scene_id"),
                F.col("l_returnflag").alias("band"),
                (F.col("l_orderkey") % 16).alias("r"),
                (F.col("l_partkey") % 16).alias("c"),
            )
            .agg(
                F.max(F.floor("l_quantity") % 12).alias("scl"),
                F.max("l_extendedprice").alias("value"),
            )
        )

    def layer(self) -> DataFrame:
        """One dense grey layer of 64 x 64 cells per box."""
        return (
            self.table("lineitem")
            .groupBy(
                (F.col("l_suppkey") % 4).alias("box"),
                (F.col("l_orderkey") % 64).alias("r"),
                (F.col("l_partkey") % 64).alias("c"),
            )
            .agg(F.min("l_quantity").alias("value"))
        )

    def polygon_edges(self) -> DataFrame:
        """An L-shape per nation in a 4 x 4 cell, offset on a 5 x 5 board."""
        # fixed values: corners of the L in order
        corners = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
        edges = F.array(
            *[
                F.struct(
                    F.lit(i).alias("ring_pos"),
                    F.lit(float(a[0])).alias("x1"),
                    F.lit(float(a[1])).alias("y1"),
                    F.lit(float(b[0])).alias("x2"),
                    F.lit(float(b[1])).alias("y2"),
                )
                for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))
            ]
        )
        ox = (F.col("nationkey") % 5 * 5).cast("double")
        oy = (F.expr("nationkey div 5") * 5).cast("double")
        return (
            self.places()
            .select("nationkey", "city", "municipality", F.explode(edges).alias("e"))
            .select(
                F.col("municipality").alias("poly_id"),
                "city",
                "e.ring_pos",
                (F.col("e.x1") + ox).alias("x1"),
                (F.col("e.y1") + oy).alias("y1"),
                (F.col("e.x2") + ox).alias("x2"),
                (F.col("e.y2") + oy).alias("y2"),
            )
        )

    def points(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("point_id"),
            ((F.col("c_custkey") * 37 % 2503) / 100.0 + 0.003).alias("x"),
            ((F.col("c_custkey") * 91 % 2507) / 100.0 + 0.007).alias("y"),
            F.col("c_acctbal").alias("value"),
        )

    def vectors(self) -> DataFrame:
        """Bag, lattice position and float vector of each instance."""
        return self.table("embeddings").select(
            F.concat(F.lit("b"), F.col("label").cast("string")).alias("bag"),
            F.expr("vec_id div 32 * 16").alias("y0"),
            F.expr("vec_id % 32 * 16").alias("x0"),
            F.col("embedding").alias("vec"),
            "vec_id",
        )

    def cities(self) -> DataFrame:
        """City catalogue for the splits: one city per supplier."""
        return (
            self.table("lineitem")
            .groupBy(F.concat(F.lit("s"), _pad("l_suppkey", 6)).alias("city"))
            .agg(
                F.count("*").alias("n_tracts"),
                (F.sum((F.col("l_quantity") >= 40).cast("long")) / F.count("*")).alias("high_share"),
            )
        )


_CTES = {
    "places": """
 SELECT n_nationkey AS nationkey, 'r' || CAST(n_regionkey AS VARCHAR) AS city,
        lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS municipality
 FROM nation""",
    "tracts": """
 SELECT municipality || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cvegeo, city, municipality,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
             WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS ordinal,
        greatest(c_acctbal, 0) + 1 AS population, c_custkey AS custkey
 FROM customer JOIN places ON c_nationkey = nationkey""",
    "tokens": """
 SELECT city, municipality, cvegeo, ordinal, o_orderkey // 128 * 16 AS y0, o_orderkey % 128 * 16 AS x0,
        o_totalprice AS score, o_orderkey AS orderkey
 FROM orders JOIN tracts ON o_custkey = custkey""",
    "token_scores": """
 SELECT city, municipality, cvegeo, ordinal, y0, x0, seed, s.score
 FROM tokens JOIN (SELECT l_orderkey AS orderkey, l_linenumber % 3 AS seed, avg(l_extendedprice) / 9973.0 AS score
                   FROM lineitem GROUP BY 1, 2) s USING (orderkey)""",
    "tract_scores": """
 SELECT s.cvegeo, s.city, s.municipality, s.score, t.population, t.ordinal
 FROM (SELECT city, municipality, cvegeo, avg(score) AS score FROM tokens GROUP BY 1, 2, 3) s
 JOIN tracts t ON s.cvegeo = t.cvegeo""",
    "scenes": """
 SELECT event_id AS scene_id, 'optical' AS collection, event_type AS tile, ts AS acquired, value / 5.0 AS cloud,
        CAST(user_id % 20 AS DOUBLE) AS xmin, CAST(event_id % 15 AS DOUBLE) AS ymin,
        user_id % 20 + 3.0 AS xmax, event_id % 15 + 2.0 AS ymax
 FROM events""",
    "pixels": """
 SELECT l_suppkey % 4 AS box, l_linenumber AS scene_id, l_returnflag AS band, l_orderkey % 16 AS r,
        l_partkey % 16 AS c, CAST(max(floor(l_quantity) % 12) AS BIGINT) AS scl, max(l_extendedprice) AS value
 FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "layer": """
 SELECT l_suppkey % 4 AS box, l_orderkey % 64 AS r, l_partkey % 64 AS c, min(l_quantity) AS value
 FROM lineitem GROUP BY 1, 2, 3""",
    "edges": """
 SELECT municipality AS poly_id, city, ring_pos, x1 + ox AS x1, y1 + oy AS y1, x2 + ox AS x2, y2 + oy AS y2
 FROM (SELECT municipality, city, CAST(nationkey % 5 * 5 AS DOUBLE) AS ox, CAST(nationkey // 5 * 5 AS DOUBLE) AS oy FROM places),
      (VALUES (0, 0, 0, 4, 0), (1, 4, 0, 4, 2), (2, 4, 2, 2, 2), (3, 2, 2, 2, 4), (4, 2, 4, 0, 4), (5, 0, 4, 0, 0))
      AS ring(ring_pos, x1, y1, x2, y2)""",
    "points": """
 SELECT c_custkey AS point_id, CAST(c_custkey * 37 % 2503 AS DOUBLE) / 100.0 + 0.003 AS x,
        CAST(c_custkey * 91 % 2507 AS DOUBLE) / 100.0 + 0.007 AS y, c_acctbal AS value
 FROM customer""",
    "vectors": """
 SELECT 'b' || CAST(label AS VARCHAR) AS bag, vec_id // 32 * 16 AS y0, vec_id % 32 * 16 AS x0,
        embedding AS vec, vec_id
 FROM embeddings""",
    "cities": """
 SELECT 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS city, count(*) AS n_tracts,
        sum(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS high_share
 FROM lineitem GROUP BY 1""",
}

_NEEDS = {
    "tracts": ["places"],
    "tokens": ["places", "tracts"],
    "token_scores": ["places", "tracts", "tokens"],
    "tract_scores": ["places", "tracts", "tokens"],
    "edges": ["places"],
}


def cte(*names: str, **extra: str) -> str:
    """A WITH clause holding the named tables, what they need, and further named selects."""
    order: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({_CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
