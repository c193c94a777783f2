"""Queries on reading, writing, resuming and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import compare as C
from tractlens.operators import splits as S
from tractlens.plans.data import Data, cte
from tractlens.plans.labels import _ASSIGN, _BEFORE, _STRATA
from tractlens.plans.registry import query
from tractlens.sources import census as N
from tractlens.sources import reports as R
from tractlens.sources import store as O

_G = list(N.SOURCE_GRADES)


def _census_file(d: Data) -> str:
    """The tract table as the office publishes it: title rows, padded Spanish grades, bad numbers."""
    k = F.col("custkey")
    t = d.tracts()
    spanish = F.element_at(F.array(*map(F.lit, _G)), F.col("ordinal") + 1)
    cells = {
        "state_key": F.substring("cvegeo", 1, 2),
        "municipality_key": F.col("municipality"),
        "cvegeo": F.col("cvegeo"),
        "population": F.when(k % 11 == 0, "n.d.").otherwise(F.col("population").cast("string")),
        "grade": F.when(k % 13 != 0, F.concat(F.lit(" "), spanish, F.lit(" "))),
    }
    rows = t.select(*[cells.get(c, F.lit("1.5")).cast("string").alias(c) for c in N.COLUMNS])
    head = d.spark.range(6).select(*[F.lit(f"title {c}" if c == "grade" else None).cast("string").alias(c) for c in N.COLUMNS])
    folder = O.scratch_folder(d.spark, "census_csv")
    head.unionByName(rows).write.mode("overwrite").csv(folder)
    return folder


@query(
    "a1_read_tracts",
    cte("tracts")
    + """SELECT cvegeo, CASE WHEN custkey % 11 <> 0 THEN population END AS population, 1.5::DOUBLE AS sin_agua,
 CASE ordinal WHEN 0 THEN 'Very low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Very high' END AS grade, CAST(ordinal AS INTEGER) AS ordinal
 FROM tracts WHERE custkey % 13 <> 0""",
    "population sin_agua",
)
def _(d: Data):
    t = N.read_tracts(d.spark, _census_file(d))
    return t.select("cvegeo", "population", "sin_agua", "grade", F.col("ordinal").cast("int").alias("ordinal"))


_LAYER = """SELECT poly_id, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM edges GROUP BY 1"""


@query(
    "a2_polygon_layer",
    cte(sq="SELECT c_custkey, c_name, (c_custkey * 29 % 2399)::DOUBLE / 100.0 AS x, (c_custkey * 17 % 2411)::DOUBLE / 100.0 AS y FROM customer")
    + "SELECT c_custkey AS municipality, c_name AS name FROM sq WHERE x <= 12 AND x + 2.6 >= 3 AND y <= 11 AND y + 2.6 >= 4",
)
def _(d: Data):
    k = F.col("c_custkey")
    x, y = k * 29 % 2399 / 100.0, k * 17 % 2411 / 100.0
    layer = d.table("customer").select(
        k.alias("mpio_code"),
        F.col("c_name").alias("mpio_name"),
        x.alias("xmin"),
        y.alias("ymin"),
        (x + 2.6).alias("xmax"),
        (y + 2.6).alias("ymax"),
    )
    names = {"mpio_code": "municipality", "mpio_name": "name", "sector": "sector"}
    return N.polygon_layer(layer, names, (3.0, 4.0, 12.0, 11.0)).select("municipality", "name")


@query(
    "a3_municipal_poverty",
    """SELECT CAST(s_suppkey AS VARCHAR) AS municipality, s_name AS name, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal / 100.0 END AS poor_share FROM supplier""",
    "poor_share",
)
def _(d: Data):
    k = F.col("s_suppkey")
    text = F.when(k % 9 == 0, "-").when(k % 2 == 0, F.translate(F.col("s_acctbal").cast("string"), ".", ",")).otherwise(
        F.col("s_acctbal").cast("string")
    )
    raw = d.table("supplier").select(
        F.concat(F.lit(" "), k.cast("string")).alias("municipality"), F.col("s_name").alias("name"), text.alias("rate")
    )
    folder = O.scratch_folder(d.spark, "poverty_csv")
    raw.write.mode("overwrite").csv(folder, sep=";", encoding="ISO-8859-1", header=True)
    return N.municipal_poverty(N.read_semicolon(d.spark, folder, ["municipality", "name", "rate"]))


@query(
    "a3_municipal_income",
    """SELECT CAST(c_nationkey AS VARCHAR) AS municipality, 'n' || CAST(c_nationkey AS VARCHAR) AS name,
 CASE WHEN c_nationkey % 7 <> 0 THEN round(avg(c_acctbal), 2) END AS mean_income, max(c_acctbal) AS median_income, count(*)::DOUBLE AS heads
 FROM customer GROUP BY 1, 2, c_nationkey""",
    "mean_income median_income heads",
)
def _(d: Data):
    k = F.col("c_nationkey")

    def told(value):
        """As the office writes it: a comma for the point."""
        return F.translate(value.cast("string"), ".", ",")

    raw = d.table("customer").groupBy(k).agg(
        F.round(F.avg("c_acctbal"), 2).alias("m"), F.max("c_acctbal").alias("top"), F.count("*").alias("n")
    )
    raw = raw.select(
        F.concat(k.cast("string"), F.lit(" ")).alias("municipality"),
        F.concat(F.lit("n"), k.cast("string")).alias("name"),
        F.when(k % 7 == 0, "n/d").otherwise(told(F.col("m"))).alias("mean_income"),
        told(F.col("top")).alias("median_income"),
        F.col("n").cast("string").alias("heads"),
    )
    folder = O.scratch_folder(d.spark, "income_csv")
    raw.write.mode("overwrite").csv(folder, sep=";", encoding="ISO-8859-1", header=True)
    columns = ["municipality", "name", "mean_income", "median_income", "heads"]
    return N.municipal_income(N.read_semicolon(d.spark, folder, columns))


_FL = "SELECT box, band, r, c, avg(value) / 9973.0 AS value FROM pixels GROUP BY 1, 2, 3, 4"


@query(
    "a5_composite_round_trip",
    cte("pixels", fl=_FL) + "SELECT CAST(box AS VARCHAR) AS box, 's2' AS sensor, band, r, c, value FROM fl",
    "value",
)
def _(d: Data):
    px = (
        d.pixels()
        .groupBy(F.col("box").cast("string").alias("box"), "band", "r", "c")
        .agg((F.avg("value") / 9973.0).alias("value"))
        .withColumn("sensor", F.lit("s2"))
    )
    folder = O.scratch_folder(d.spark, "composites")
    grids = px.select("box", "sensor").distinct().select("box", "sensor", F.lit(16).alias("h"), F.lit(16).alias("w"))
    O.save_composite(px, grids, folder)
    back = O.load_composite(
        d.spark, folder, "band string, r bigint, c bigint, value double, box string, sensor string"
    )
    return back.select("box", "sensor", "band", "r", "c", "value")


@query(
    "a5_composite_faults",
    """WITH b AS (SELECT l_suppkey AS box, l_returnflag AS band, max(l_linenumber) + 1 AS h, max(l_linenumber) + 1 AS w FROM lineitem GROUP BY 1, 2),
 s AS (SELECT box, count(DISTINCT h) AS shapes, max(h) AS bh FROM b GROUP BY 1)
 SELECT s_suppkey AS box, 's2' AS sensor, CASE WHEN shapes IS NULL THEN 'no bands' WHEN shapes > 1 THEN 'mixed shapes' ELSE 'off grid' END AS reason
 FROM supplier LEFT JOIN s ON s_suppkey = box WHERE shapes IS NULL OR shapes > 1 OR bh <> CASE WHEN s_suppkey % 10 = 0 THEN 9 ELSE 8 END""",
)
def _(d: Data):
    px = d.table("lineitem").select(
        F.col("l_suppkey").alias("box"),
        F.lit("s2").alias("sensor"),
        F.col("l_returnflag").alias("band"),
        F.col("l_linenumber").alias("r"),
        F.col("l_linenumber").alias("c"),
    )
    side = F.when(F.col("s_suppkey") % 10 == 0, 9).otherwise(8)
    grids = d.table("supplier").select(
        F.col("s_suppkey").alias("box"), F.lit("s2").alias("sensor"), side.alias("h"), F.lit(8).alias("w")
    )
    grids = grids.withColumn("w", F.col("h"))
    return O.composite_faults(px, grids)


@query(
    "a6_collected_bags",
    """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS city, s_name AS municipality FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_tax = 0)""",
)
def _(d: Data):
    bags = d.table("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("city"), F.col("s_name").alias("municipality")
    )
    inst = d.table("lineitem").where("l_quantity = 50 AND l_tax = 0").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("city")
    )
    return O.collect_bags(bags, inst)


@query(
    "a7_vector_alignment",
    """SELECT side, count(*) AS rows FROM (SELECT CASE WHEN v.k IS NULL THEN 'no vector' ELSE 'no instance' END AS side
 FROM (SELECT o_orderkey AS k FROM orders) i FULL JOIN (SELECT DISTINCT l_orderkey + 7 AS k FROM lineitem) v ON i.k = v.k WHERE v.k IS NULL OR i.k IS NULL) GROUP BY 1""",
)
def _(d: Data):
    i = d.table("orders").select(F.col("o_orderkey").alias("k"))
    v = d.table("lineitem").select((F.col("l_orderkey") + 7).alias("k")).distinct()
    return O.misaligned(i, v, ["k"])


@query(
    "a7_vector_round_trip",
    "SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS entry, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "value",
)
def _(d: Data):
    folder = O.scratch_folder(d.spark, "vectors")
    instances = d.table("embeddings").select("vec_id")
    O.save_vectors(d.vectors(), instances, ["vec_id"], folder)
    schema = "y0 bigint, x0 bigint, vec array<float>, vec_id bigint, bag string"
    back = O.load_vectors(d.spark, folder, schema, instances, ["vec_id"])
    entries = back.select("vec_id", F.posexplode("vec").alias("entry", "value"))
    return entries.select("vec_id", (F.col("entry") + 1).alias("entry"), F.col("value").cast("double").alias("value"))


@query(
    "a8_panel_export",
    """SELECT l_returnflag AS panel, l_linenumber AS step, count(*) AS runs, avg(l_quantity / 7.0) AS within_mean, avg(l_extendedprice / 9973.0) AS auroc_mean,
 stddev_samp(l_quantity / 7.0) AS within_std, stddev_samp(l_extendedprice / 9973.0) AS auroc_std FROM lineitem GROUP BY 1, 2""",
    "within_mean auroc_mean within_std auroc_std",
)
def _(d: Data):
    runs = d.table("lineitem").select(
        F.col("l_returnflag").alias("panel"),
        F.col("l_linenumber").alias("step"),
        (F.col("l_quantity") / 7.0).alias("within"),
        (F.col("l_extendedprice") / 9973.0).alias("auroc"),
    )
    panel = C.panel_summary(runs, ["panel", "step"], ["within", "auroc"])
    target = R.write_panel(panel, O.scratch_folder(d.spark, "panels"), "curve", "large")
    return d.spark.read.schema(panel.schema).csv(target, header=True)


@query(
    "a9_result_document",
    "SELECT 'flag_' || l_returnflag || '.line_' || CAST(l_linenumber AS VARCHAR) AS path, avg(l_quantity) AS value FROM lineitem GROUP BY 1",
    "value",
)
def _(d: Data):
    path = F.concat(F.lit("flag_"), "l_returnflag", F.lit(".line_"), F.col("l_linenumber").cast("string"))
    values = d.table("lineitem").groupBy(path.alias("path")).agg(F.avg("l_quantity").alias("value"))
    folder = O.scratch_folder(d.spark, "results_json")
    R.write_results(values, folder)
    return R.read_results(d.spark, folder)


@query("a10_file_manifest")
def _(d: Data):
    return R.manifest(d.spark, f"{d.sf_dir}/*.parquet")


@query(
    "a10_split_listing",
    cte("cities", strat=_STRATA, bef=_BEFORE, part=_ASSIGN)
    + "SELECT split, city, row_number() OVER (PARTITION BY split ORDER BY city) AS place FROM part",
)
def _(d: Data):
    return R.split_listing(S.assign(d.cities()))


_CODES = {"F": "final", "O": "open"}
_NAMES = {"o_orderkey": "cvegeo", "o_orderstatus": "state", "gone": "never"}


@query(
    "a11_migrated_table",
    "SELECT o_orderkey AS cvegeo, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS state, o_totalprice FROM orders",
)
def _(d: Data):
    t = d.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return O.migrate(t, _NAMES, {"state": _CODES})


@query(
    "a11_migration_changes",
    "SELECT 2 AS columns_renamed, CAST(sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS BIGINT) AS state_recoded FROM orders",
)
def _(d: Data):
    return O.migration_changes(d.table("orders"), _NAMES, {"state": _CODES})


_DONE = "SELECT l_suppkey AS key, l_linenumber AS part FROM lineitem WHERE l_quantity >= 50"


def _done(d: Data):
    return d.table("lineitem").where("l_quantity >= 50").select(
        F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("part")
    )


@query(
    "a12_pending_keys",
    f"SELECT s_suppkey AS key FROM supplier WHERE s_suppkey NOT IN (SELECT key FROM ({_DONE}) GROUP BY 1 HAVING count(DISTINCT part) >= 6)",
)
def _(d: Data):
    return O.pending(d.table("supplier").select(F.col("s_suppkey").alias("key")), _done(d), "key", 6)


@query(
    "a12_derived_kept",
    f"""WITH redo AS (SELECT s_suppkey AS key FROM supplier WHERE s_suppkey NOT IN (SELECT key FROM ({_DONE}) GROUP BY 1 HAVING count(DISTINCT part) >= 6))
 SELECT l_suppkey AS key, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT key FROM redo) GROUP BY 1""",
)
def _(d: Data):
    redo = O.pending(d.table("supplier").select(F.col("s_suppkey").alias("key")), _done(d), "key", 6)
    derived = d.table("lineitem").select(F.col("l_suppkey").alias("key"))
    return O.drop_derived(derived, redo, "key").groupBy("key").agg(F.count("*").alias("n"))


@query(
    "a12_partition_overwrite",
    """SELECT l_linenumber AS part, count(*) AS n, sum(CASE WHEN l_linenumber <= 3 THEN l_quantity + 1 ELSE l_quantity END) AS q FROM lineitem GROUP BY 1""",
    "q",
)
def _(d: Data):
    folder = O.scratch_folder(d.spark, "resumed")
    t = d.table("lineitem").select(F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("q"))
    t.write.mode("overwrite").partitionBy("part").parquet(folder)
    O.overwrite_partitions(t.where("part <= 3").withColumn("q", F.col("q") + 1), folder, "part")
    back = d.spark.read.schema("q double, part int").parquet(folder)
    return back.groupBy("part").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@query(
    "a13_staleness",
    """WITH st AS (SELECT l_suppkey AS box, max(l_linenumber) AS ln, list_sort(list_distinct(list(l_returnflag))) AS bands, count(*) AS n,
  count(CASE WHEN l_tax < 0.08 OR l_suppkey % 3 > 0 THEN 1 END) AS v, max(l_quantity) AS ty FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1)
 SELECT s_suppkey AS box, CASE WHEN st.box IS NULL THEN 'absent' WHEN s_suppkey % 5 = 0 THEN 'covers another box' WHEN bands <> CASE WHEN s_suppkey % 11 = 0 THEN ['A', 'N'] ELSE ['A', 'N', 'R'] END THEN 'other bands'
 WHEN ty + 16 > CASE WHEN s_suppkey % 13 = 0 THEN 60 ELSE 66 END THEN 'tokens beyond raster' WHEN v <> n THEN 'rows differ' ELSE 'fresh' END AS state
 FROM supplier LEFT JOIN st ON s_suppkey = st.box""",
)
def _(d: Data):
    k = F.col("l_suppkey")
    stored = (
        d.table("lineitem")
        .where(k % 7 != 0)
        .groupBy(k.alias("box"))
        .agg(
            F.array_sort(F.collect_set("l_returnflag")).alias("bands"),
            F.max("l_quantity").alias("token_y"),
            F.lit(0).alias("token_x"),
            F.count("*").alias("instance_rows"),
            F.count(F.when((F.col("l_tax") < 0.08) | (k % 3 > 0), 1)).alias("vector_rows"),
        )
        .select(
            "*",
            *[(F.col("box") * (i + 1) + F.when(F.col("box") % 5 == 0, 0.5).otherwise(1e-8)).alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))],
        )
    )
    b = F.col("s_suppkey")
    current = d.table("supplier").select(
        b.alias("box"),
        *[(b * (i + 1.0)).alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))],
        F.when(b % 11 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("bands"),
        F.when(b % 13 == 0, 60).otherwise(66).alias("h"),
        F.lit(99).alias("w"),
    )
    return O.staleness(stored, current)


@query(
    "a14_progress",
    """WITH o AS (SELECT l_suppkey AS key, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_quantity >= 49 AND l_tax >= 0.06 AND l_returnflag <> 'R' GROUP BY 1),
 f AS (SELECT DISTINCT o_orderkey % 1000 AS key FROM orders WHERE o_orderstatus = 'P')
 SELECT s_suppkey AS key, CASE WHEN n >= 2 THEN 'complete' WHEN f.key IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'partial' ELSE 'pending' END AS state
 FROM supplier LEFT JOIN o ON s_suppkey = o.key LEFT JOIN f ON s_suppkey = f.key""",
)
def _(d: Data):
    keys = d.table("supplier").select(F.col("s_suppkey").alias("key"))
    outputs = d.table("lineitem").where("l_quantity >= 49 AND l_tax >= 0.06 AND l_returnflag <> 'R'").select(
        F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("part")
    )
    failed = d.table("orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 1000).alias("key"))
    return O.progress(keys, outputs, failed)


@query(
    "a14_failures_since_relaunch",
    """SELECT 'c' || CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1 GROUP BY 1""",
)
def _(d: Data):
    # a log holds the lines of a hundred customers; lines before the relaunch mark must not count
    line = F.concat(F.lit("FAIL c"), F.col("o_custkey").cast("string"), F.lit(" timeout"))
    lines = d.table("orders").where("o_orderstatus = 'F'").select(
        F.expr("o_custkey div 100").alias("log"), (F.col("o_orderkey") % 2).alias("late"), line.alias("line")
    )
    logs = lines.groupBy("log").agg(
        F.concat(
            F.array_join(F.collect_list(F.when(F.col("late") == 0, F.col("line"))), "\n"),
            F.lit("\nRELAUNCHED\n"),
            F.array_join(F.collect_list(F.when(F.col("late") == 1, F.col("line"))), "\n"),
        ).alias("value")
    )
    return O.failures_since_relaunch(logs).groupBy("key").agg(F.count("*").alias("n"))


@query(
    "a15_grids_agree",
    """SELECT a.k AS box, a.h = b.h AND a.q = b.q AS agree FROM (SELECT l_partkey AS k, count(*) AS h, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a
 JOIN (SELECT l_partkey AS k, count(*) AS h, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON a.k = b.k""",
)
def _(d: Data):
    grids = (
        d.table("lineitem")
        .where("l_returnflag IN ('A', 'N')")
        .groupBy(F.col("l_partkey").alias("box"), F.when(F.col("l_returnflag") == "A", "s1").otherwise("s2").alias("sensor"))
        .agg(F.count("*").alias("h"), F.max("l_quantity").alias("w"), F.lit("EPSG:32614").alias("crs"))
    )
    return O.grids_agree(grids)


_RES = """SELECT l_returnflag AS split, 'm' || CAST(l_linenumber AS VARCHAR) AS metric, 'sys' || CAST(l_suppkey % 3 AS VARCHAR) AS system, avg(l_quantity) / 50.07 AS value,
 avg(l_tax) AS low, avg(l_discount) + 1 AS high FROM lineitem WHERE NOT (l_suppkey % 3 = 2 AND l_linenumber > 4) GROUP BY 1, 2, 3"""
_CELLS = ", ".join(
    f"coalesce(max(CASE WHEN system = 'sys{i}' THEN printf('%.3f [%.3f, %.3f]', value, low, high) END), '--') AS sys{i}" for i in range(3)
)


@query(
    "a16_report_table",
    f"WITH r AS ({_RES}) SELECT split, 'Metric ' || substr(metric, 2) AS label, {_CELLS} FROM r GROUP BY split, metric",
)
def _(d: Data):
    li = d.table("lineitem").where("NOT (l_suppkey % 3 = 2 AND l_linenumber > 4)")
    results = li.groupBy(
        F.col("l_returnflag").alias("split"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"),
        F.concat(F.lit("sys"), (F.col("l_suppkey") % 3).cast("string")).alias("system"),
    ).agg((F.avg("l_quantity") / 50.07).alias("value"), F.avg("l_tax").alias("low"), (F.avg("l_discount") + 1).alias("high"))
    names = d.spark.range(1, 8).select(
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("metric"),
        F.concat(F.lit("Metric "), F.col("id").cast("string")).alias("label"),
    )
    return R.report_table(results, names, ["sys0", "sys1", "sys2"])
