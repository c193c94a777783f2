"""Queries on labels, bags, catalogues and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractlens.operators import labels as L
from tractlens.operators import splits as S
from tractlens.plans.data import Data, cte
from tractlens.plans.registry import query

_GRADE_CASE = (
    "CASE ordinal WHEN 0 THEN 'Very low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' "
    "WHEN 3 THEN 'High' WHEN 4 THEN 'Very high' END"
)
_P = ", ".join(f"sum(CASE WHEN ordinal >= {k} THEN w ELSE 0 END) / sum(w) AS p{k}" for k in (1, 2, 3, 4))
LABELS_SQL = f"""
SELECT municipality, ordinal, ordinal_continuous, p1, p2, p3, p4, population, tracts, {_GRADE_CASE} AS grade
FROM (SELECT municipality,
             CAST(least(greatest(round_even(sum(w * ordinal) / sum(w), 0), 0), 4) AS INTEGER) AS ordinal,
             sum(w * ordinal) / sum(w) AS ordinal_continuous, {_P},
             sum(w) AS population, count(*) AS tracts
      FROM (SELECT municipality, ordinal,
                   CASE WHEN sum(population) OVER (PARTITION BY municipality) > 0 THEN population ELSE 1 END AS w
            FROM tracts)
      GROUP BY municipality)"""


@query("d8_municipal_labels", cte("tracts") + LABELS_SQL, "ordinal_continuous p1 p2 p3 p4 population", 5)
def _(d: Data):
    return L.municipal_labels(d.tracts())


_SHARES = ", ".join(
    f"sum(CASE WHEN ordinal >= {k} THEN population ELSE 0 END) / sum(population) AS p{k}" for k in (1, 2, 3, 4)
)


@query(
    "d9_shares_by_level",
    cte("tracts")
    + f"""SELECT 'municipality' AS level, municipality AS unit, {_SHARES} FROM tracts GROUP BY municipality
 UNION ALL SELECT 'state', substr(cvegeo, 1, 2), {_SHARES} FROM tracts GROUP BY substr(cvegeo, 1, 2)
 UNION ALL SELECT 'national', 'all', {_SHARES} FROM tracts""",
    "p1 p2 p3 p4",
)
def _(d: Data):
    return L.shares_by_level(d.tracts())


@query(
    "d9_relabel_state",
    cte("tracts", bags=LABELS_SQL, st=f"SELECT substr(cvegeo, 1, 2) AS unit, {_SHARES} FROM tracts GROUP BY 1")
    + "SELECT municipality, ordinal, st.p1, st.p2, st.p3, st.p4 FROM bags JOIN st ON substr(municipality, 1, 2) = unit",
    "p1 p2 p3 p4",
)
def _(d: Data):
    t = d.tracts()
    return L.relabel(L.municipal_labels(t), t, "state").select(
        "municipality", "ordinal", "p1", "p2", "p3", "p4"
    )


@query(
    "d6_grade_summary",
    cte("tracts", g="SELECT ordinal, count(*) AS n, sum(population) AS pop FROM tracts GROUP BY 1")
    + f"""SELECT {_GRADE_CASE.replace("ordinal", "k")} AS grade, coalesce(n, 0) AS tracts,
 CAST(floor(coalesce(pop, 0)) AS BIGINT) AS population,
 round_even(100.0 * coalesce(n, 0)::DOUBLE / greatest((SELECT count(*) FROM tracts), 1), 1) AS pct_tracts
 FROM (SELECT unnest(range(5)) AS k) LEFT JOIN g ON ordinal = k""",
    "pct_tracts",
    1,
)
def _(d: Data):
    return L.grade_summary(d.tracts())


@query(
    "d7_city_selection",
    cte("tracts")
    + """SELECT municipality, count(*) AS tracts, CAST(sum(CASE WHEN ordinal >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS high,
 sum(CASE WHEN ordinal >= 3 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS high_share FROM tracts GROUP BY 1
 HAVING count(*) >= 62 OR (count(*) >= 50 AND sum(CASE WHEN ordinal >= 3 THEN 1 ELSE 0 END)::DOUBLE / count(*) >= 0.4)""",
    "high_share",
)
def _(d: Data):
    return L.cities_by_size(d.tracts(), 62, stratify=True, min_deprived=50, deprived_share=0.4)


@query(
    "d19_bags",
    cte("tokens", lab=LABELS_SQL)
    + """SELECT city, municipality, ordinal, ordinal_continuous, instances FROM lab JOIN
 (SELECT city, municipality, count(*) AS instances FROM tokens GROUP BY 1, 2 HAVING count(*) >= 600) USING (municipality)""",
    "ordinal_continuous",
)
def _(d: Data):
    _, bags = L.build_bags(d.tokens(), L.municipal_labels(d.tracts()), 600)
    return bags.select("city", "municipality", "ordinal", "ordinal_continuous", "instances")


@query(
    "d19_instances_kept",
    cte("tokens")
    + """SELECT city, municipality, cvegeo, y0, x0 FROM tokens WHERE municipality IN
 (SELECT municipality FROM tokens GROUP BY 1 HAVING count(*) >= 600)""",
)
def _(d: Data):
    kept, _bags = L.build_bags(d.tokens(), L.municipal_labels(d.tracts()), 600)
    return kept.select("city", "municipality", "cvegeo", "y0", "x0")


_PW = """
 SELECT municipality, cvegeo, y0, x0, raw / avg(raw) OVER (PARTITION BY municipality) AS weight
 FROM (SELECT k.municipality, k.cvegeo, k.y0, k.x0, coalesce(p.raw, m.middle, 1.0) AS raw
       FROM tokens k JOIN per p USING (cvegeo) JOIN med m ON k.municipality = m.municipality)"""
_PER = """SELECT municipality, cvegeo, CASE WHEN population > 1 THEN (population - 1) / count(*) END AS raw
 FROM tokens JOIN (SELECT cvegeo, population FROM tracts) USING (cvegeo) GROUP BY municipality, cvegeo, population"""
_MED = "SELECT municipality, median(raw) AS middle FROM per GROUP BY 1"


@query("d26_population_weights", cte("tokens", per=_PER, med=_MED) + _PW, "weight")
def _(d: Data):
    people = d.tracts().withColumn("population", F.col("population") - 1)
    return L.population_weights(d.tokens(), people).select("municipality", "cvegeo", "y0", "x0", "weight")


@query(
    "d26_weighted_bag_share",
    cte("tokens", per=_PER, med=_MED, pw=_PW)
    + """SELECT municipality, sum(weight * CASE WHEN ordinal >= 3 THEN 1 ELSE 0 END) / sum(weight) AS share
 FROM pw JOIN (SELECT cvegeo, ordinal FROM tracts) USING (cvegeo) GROUP BY 1""",
    "share",
)
def _(d: Data):
    people = d.tracts().withColumn("population", F.col("population") - 1)
    weighted = L.population_weights(d.tokens(), people)
    high = (F.col("ordinal") >= 3).cast("double")
    return weighted.groupBy("municipality").agg(
        (F.sum(F.col("weight") * high) / F.sum("weight")).alias("share")
    )


@query(
    "d30_class_weights",
    cte("tracts", bags=LABELS_SQL, n="SELECT ordinal, count(*) AS bags FROM bags GROUP BY 1")
    + """SELECT CAST(k AS INTEGER) AS ordinal, coalesce(bags, 0) AS bags,
 coalesce((SELECT sum(bags) FROM n)::DOUBLE / (5.0 * bags), 0) AS weight
 FROM (SELECT unnest(range(5)) AS k) LEFT JOIN n ON ordinal = k""",
    "weight",
)
def _(d: Data):
    return L.inverse_frequency(L.municipal_labels(d.tracts()))


@query(
    "c1_label_join",
    cte("tracts")
    + "SELECT cvegeo, municipality, o_totalprice FROM tracts JOIN orders ON custkey = o_custkey",
)
def _(d: Data):
    o = d.table("orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice")
    polygons = o.join(d.tracts().select("custkey", "cvegeo"), "custkey").select("cvegeo", "o_totalprice")
    return L.join_labels(polygons, d.tracts().select("cvegeo", "municipality"))


@query(
    "c1_label_audit",
    cte("tracts", hit="SELECT DISTINCT cvegeo FROM tracts JOIN orders ON custkey = o_custkey")
    + """SELECT count(*) AS polygons, count(hit.cvegeo) AS matched,
 count(DISTINCT substr(hit.cvegeo, 1, 5)) AS municipalities, count(*) - count(hit.cvegeo) AS dropped
 FROM tracts LEFT JOIN hit USING (cvegeo)""",
)
def _(d: Data):
    return L.label_audit(d.tracts(), d.tokens().select("cvegeo").distinct())


_OPT = """SELECT cvegeo, any_value(city) AS city, avg(score) AS s2red_mean FROM tokens GROUP BY 1"""
_RAD = """SELECT cvegeo, avg(score) AS s1vv_mean, max(score) AS s1vh_max FROM token_scores GROUP BY 1"""
_RAD_PART = _RAD.replace("GROUP", "WHERE seed = 2 GROUP")


def _modalities(d: Data, radar_tokens=None):
    optical = d.tokens().groupBy("cvegeo").agg(F.first("city").alias("city"), F.avg("score").alias("s2red_mean"))
    radar = (
        (radar_tokens or d.token_scores())
        .groupBy("cvegeo")
        .agg(
            F.first("city").alias("city"),
            F.avg("score").alias("s1vv_mean"),
            F.max("score").alias("s1vh_max"),
        )
    )
    return optical, radar


@query(
    "c2_fuse",
    cte("token_scores", o=_OPT, r=_RAD) + "SELECT * FROM o JOIN r USING (cvegeo)",
    "s2red_mean s1vv_mean s1vh_max",
    7,
)
def _(d: Data):
    return L.fuse(*_modalities(d))


@query(
    "c2_fuse_unmatched",
    cte("token_scores", o=_OPT, r=_RAD_PART)
    + """SELECT CAST(sum(CASE WHEN o.cvegeo IS NULL OR r.cvegeo IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched
 FROM o FULL JOIN r ON o.cvegeo = r.cvegeo""",
)
def _(d: Data):
    # one seed only, so that some tracts have no radar
    return L.fuse_unmatched(*_modalities(d, d.token_scores().where("seed = 2")))


_CAT = "SELECT municipality, count(*) AS tracts FROM tracts GROUP BY 1"


@query(
    "c14_extra_municipalities",
    cte(
        "tokens",
        cat=_CAT,
        bags="SELECT municipality FROM tokens GROUP BY 1 HAVING count(*) >= 650",
    )
    + """SELECT municipality, tracts FROM cat WHERE municipality NOT IN (SELECT municipality FROM cat WHERE tracts >= 62)
 AND municipality NOT IN (SELECT municipality FROM bags)""",
)
def _(d: Data):
    wide = L.cities_by_size(d.tracts(), 1).select("municipality", "tracts")
    bags = d.tokens().groupBy("municipality").count().where("count >= 650")
    return L.extra_municipalities(wide, wide.where("tracts >= 62"), bags)


@query(
    "c14_merged_catalogue",
    cte(
        "tracts",
        cat=f"SELECT *, 'city' || CAST(CAST(municipality AS INTEGER) % 4 AS VARCHAR) AS key FROM ({_CAT})",
        base="SELECT * FROM cat WHERE tracts >= 62",
        extra="""SELECT *, row_number() OVER (PARTITION BY key ORDER BY tracts DESC, municipality) AS place
                 FROM cat WHERE tracts < 62""",
    )
    + """SELECT key, municipality, tracts, 'base' AS source FROM base UNION ALL
 SELECT CASE WHEN place > 1 OR key IN (SELECT key FROM base) THEN key || municipality ELSE key END, municipality, tracts, 'extra' FROM extra""",
)
def _(d: Data):
    cat = (
        L.cities_by_size(d.tracts(), 1)
        .select("municipality", "tracts")
        .withColumn("key", F.concat(F.lit("city"), (F.col("municipality").cast("int") % 4).cast("string")))
        .select("key", "municipality", "tracts")
    )
    return L.merge_catalogues(cat.where("tracts >= 62"), cat.where("tracts < 62"))


_FOLDBAGS = """SELECT city, municipality, count(*) AS n, CAST(CAST(substr(municipality, 3, 3) AS INTEGER) AS INTEGER) AS k
 FROM tokens GROUP BY 1, 2"""


@query(
    "c15_leak_exclusion",
    cte("tokens", b=_FOLDBAGS)
    + """SELECT municipality, city, n FROM b WHERE city <> 'r0' AND
 municipality NOT IN (SELECT municipality FROM b WHERE city = 'r0') AND municipality NOT IN (SELECT municipality FROM b WHERE n > 640)""",
)
def _(d: Data):
    b = d.tokens().groupBy("city", "municipality").agg(F.count("*").alias("n"))
    held = b.where("city = 'r0'"), b.where("n > 640")
    return L.disjoint(L.exclude_leaks(b.where("city <> 'r0'"), *held), *held)


@query(
    "c16_winner_box",
    cte(
        "tokens",
        k="SELECT *, 'k' || CAST(orderkey % 3 AS VARCHAR) AS key FROM tokens",
        w="""SELECT municipality, key FROM (SELECT municipality, key, row_number() OVER (PARTITION BY municipality
             ORDER BY count(*) DESC, key) AS rn FROM k GROUP BY 1, 2) WHERE rn = 1""",
    )
    + "SELECT municipality, key, y0, x0 FROM k JOIN w USING (municipality, key)",
)
def _(d: Data):
    boxed = d.tokens().withColumn("key", F.concat(F.lit("k"), (F.col("orderkey") % 3).cast("string")))
    return L.winner_boxes(boxed).select("municipality", "key", "y0", "x0")


@query(
    "b13_scaled_share",
    cte("tracts", b="SELECT municipality, avg(population) AS income FROM tracts GROUP BY 1")
    + """SELECT municipality, income, (-ln(income) - (SELECT min(-ln(income)) FROM b)) /
 greatest((SELECT max(-ln(income)) - min(-ln(income)) FROM b), 1e-9) AS share FROM b""",
    "income share",
)
def _(d: Data):
    return L.scaled_share(d.tracts().groupBy("municipality").agg(F.avg("population").alias("income")))


# ---- splits -------------------------------------------------------------------------------

_BIN = "greatest(CAST(ceil((rn{x} - 1) * 3.0 / greatest(n - 1, 1)) AS INTEGER) - 1, 0)"
_STRATA = f"""SELECT city, n_tracts, high_share,
 CAST({_BIN.format(x="a")} AS VARCHAR) || '-' || CAST({_BIN.format(x="b")} AS VARCHAR) AS stratum
 FROM (SELECT *, row_number() OVER (ORDER BY n_tracts, city) AS rna, row_number() OVER (ORDER BY high_share, city) AS rnb,
              count(*) OVER () AS n FROM cities)"""
_BEFORE = """SELECT stratum, sum(s) OVER (ORDER BY stratum) - s AS before FROM (SELECT stratum, count(*) AS s FROM strat GROUP BY 1)"""
_ASSIGN = """SELECT city, CASE WHEN k = 0 THEN 'test' WHEN k = 1 THEN 'val' ELSE 'train' END AS split,
 n_tracts, high_share AS stratum_value, stratum
 FROM (SELECT d.*, (d.i - 1 + before) % 10 AS k FROM
  (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('20200101|' || city)) AS i FROM strat) d JOIN bef USING (stratum))"""


@query("f1_rank_bins", cte("cities") + _STRATA, "high_share")
def _(d: Data):
    return S.strata(d.cities())


@query("f2_partition", cte("cities", strat=_STRATA, bef=_BEFORE) + _ASSIGN, "stratum_value")
def _(d: Data):
    return S.assign(d.cities())


@query(
    "f3_cities_of_split",
    cte("cities", strat=_STRATA, bef=_BEFORE, part=_ASSIGN) + "SELECT city FROM part WHERE split = 'val'",
)
def _(d: Data):
    return S.cities_of(S.assign(d.cities()), "val")


@query(
    "f3_design_role",
    """WITH r AS (SELECT o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'beyond' END AS role,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 5 END AS place FROM orders)
 SELECT key, arg_max(role, place) AS role FROM r GROUP BY key""",
)
def _(d: Data):
    role = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("beyond")
    return S.design_role(d.table("orders").select(F.col("o_custkey").alias("key"), role.alias("role")))


_INST = """SELECT DISTINCT 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS city,
 'p' || CAST(l_partkey AS VARCHAR) AS cvegeo, 'm' || CAST(l_partkey // 10 AS VARCHAR) AS municipality FROM lineitem"""


def _supply(d: Data):
    return d.table("lineitem").select(
        F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("city"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("cvegeo"),
        F.concat(F.lit("m"), F.expr("l_partkey div 10").cast("string")).alias("municipality"),
    )


@query(
    "f4_leak_report",
    cte(
        "cities",
        strat=_STRATA,
        bef=_BEFORE,
        part=f"SELECT * FROM ({_ASSIGN}) WHERE n_tracts >= 580",
        inst=_INST,
        m="SELECT inst.*, split FROM inst LEFT JOIN part USING (city)",
    )
    + """SELECT 'repeated city' AS "check", count(*) AS violations FROM (SELECT city FROM part GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'unassigned instance', count(*) FROM m WHERE split IS NULL
 UNION ALL SELECT 'tract in two splits', count(*) FROM (SELECT cvegeo FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'municipality in two splits', count(*) FROM (SELECT municipality FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
)
def _(d: Data):
    return S.leak_report(S.assign(d.cities()).where("n_tracts >= 580"), _supply(d).distinct())


_LINES = """SELECT 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS city,
 'p' || CAST(l_partkey AS VARCHAR) AS cvegeo, 'm' || CAST(l_partkey // 10 AS VARCHAR) AS municipality FROM lineitem"""
_SEATS = """SELECT 'm' || CAST(s_suppkey AS VARCHAR) AS municipality, 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS city FROM supplier"""
_OWNER = """SELECT municipality, city FROM (SELECT c.municipality, c.city, row_number() OVER (PARTITION BY c.municipality
 ORDER BY CASE WHEN s.city IS NOT NULL THEN 0 ELSE 1 END, n DESC, c.city) AS rn
 FROM (SELECT municipality, city, count(*) AS n FROM lines GROUP BY 1, 2) c
 LEFT JOIN seats s ON c.municipality = s.municipality AND c.city = s.city) WHERE rn = 1"""


def _seats(d: Data):
    return d.table("supplier").select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("municipality"),
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("city"),
    )


@query("f5_municipality_owner", "WITH lines AS (" + _LINES + "), seats AS (" + _SEATS + ") " + _OWNER)
def _(d: Data):
    return S.municipality_owner(_supply(d), _seats(d))


@query(
    "f5_deduplicate",
    f"""WITH lines AS ({_LINES}), seats AS ({_SEATS}), own AS ({_OWNER})
 SELECT l.municipality, l.city, l.cvegeo FROM lines l JOIN own o ON l.municipality = o.municipality AND l.city = o.city""",
)
def _(d: Data):
    return S.deduplicate(_supply(d), _seats(d)).select("municipality", "city", "cvegeo")


@query(
    "f5_still_repeated",
    f"""WITH lines AS ({_LINES}), seats AS ({_SEATS}), own AS ({_OWNER})
 SELECT count(*) AS repeated FROM (SELECT cvegeo FROM lines l JOIN own o ON l.municipality = o.municipality AND l.city = o.city
 GROUP BY 1 HAVING count(*) > 1)""",
)
def _(d: Data):
    return S.still_repeated(S.deduplicate(_supply(d), _seats(d)))


@query(
    "f6_zscore_by_city",
    cte("tract_scores")
    + """SELECT cvegeo, city, CASE WHEN sd_s > 0 THEN (score - m_s) / sd_s ELSE 0 END AS score,
 CASE WHEN population IS NULL THEN NULL WHEN sd_p > 0 THEN (population - m_p) / sd_p ELSE 0 END AS population, flat
 FROM (SELECT cvegeo, city, score, nullif(population, 1) AS population, 0.0::DOUBLE AS flat,
   avg(score) OVER w AS m_s, stddev_samp(score) OVER w AS sd_s,
   avg(nullif(population, 1)) OVER w AS m_p, stddev_samp(nullif(population, 1)) OVER w AS sd_p
   FROM tract_scores WINDOW w AS (PARTITION BY city))""",
    "score population flat",
)
def _(d: Data):
    t = d.tract_scores().select(
        "cvegeo",
        "city",
        "score",
        F.when(F.col("population") != 1.0, F.col("population")).alias("population"),
        F.lit(7.5).alias("flat"),
    )
    return S.standardise_by_group(t, ["score", "population", "flat"])


@query(
    "f7_stratified_folds",
    cte("cities", strat=_STRATA, bef=_BEFORE)
    + """SELECT city, stratum, CAST((i - 1 + before) % 5 AS INTEGER) AS fold FROM
 (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0|' || city)) AS i FROM strat) JOIN bef USING (stratum)""",
)
def _(d: Data):
    return S.stratified_folds(S.strata(d.cities()))


@query(
    "f7_plain_folds",
    cte("cities")
    + "SELECT city, CAST((row_number() OVER (ORDER BY md5('3|' || city)) - 1) % 5 AS INTEGER) AS fold FROM cities",
)
def _(d: Data):
    return S.plain_folds(d.cities(), "city", 5, 3)


@query(
    "f7_spatial_cells",
    cte("tokens")
    + """SELECT city || ':' || CAST(y0 // 320 AS VARCHAR) || ':' || CAST(x0 // 320 AS VARCHAR) AS cell, count(*) AS tokens
 FROM tokens GROUP BY 1""",
)
def _(d: Data):
    t = d.tokens().withColumn("cell", S.spatial_cell(F.col("city"), F.col("y0"), F.col("x0")))
    return t.groupBy("cell").agg(F.count("*").alias("tokens"))


@query(
    "f8_inner_cities",
    cte("cities", strat=_STRATA)
    + """SELECT city, stratum FROM (SELECT city, stratum, row_number() OVER (ORDER BY stratum, md5('1|' || city)) AS i,
  count(*) OVER () AS n FROM strat)
 WHERE i - 1 IN (SELECT CAST(round_even(k * ((SELECT count(*) FROM strat) - 1) / 11.0, 0) AS BIGINT) FROM (SELECT unnest(range(12)) AS k))""",
)
def _(d: Data):
    return S.inner_cities(S.strata(d.cities()), 12, 1)


@query(
    "f9_nested_sample",
    cte(
        "tracts",
        b="SELECT cvegeo AS municipality, ordinal FROM tracts",
        s="""SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY md5('2|' || municipality)) AS step,
             count(*) OVER (PARTITION BY ordinal) AS size FROM b""",
    )
    + "SELECT municipality, ordinal, row_number() OVER (ORDER BY step, size DESC, ordinal) AS place FROM s",
)
def _(d: Data):
    return S.nested_sample(d.tracts().select(F.col("cvegeo").alias("municipality"), "ordinal"), 2)


@query(
    "f12_set_operations",
    cte("tracts", a="SELECT DISTINCT custkey FROM tracts WHERE ordinal >= 3", b="SELECT DISTINCT o_custkey AS custkey FROM orders")
    + """SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b)
 UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
 UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
 UNION ALL SELECT 'concat', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def _(d: Data):
    a = d.tracts().where("ordinal >= 3").select("custkey").distinct()
    b = d.table("orders").select(F.col("o_custkey").alias("custkey")).distinct()
    parts = {
        "union": a.union(b).distinct(),
        "intersect": a.intersect(b),
        "difference": b.subtract(a),
        "concat": a.unionByName(b),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "f11_shards",
    cte("cities")
    + "SELECT city, CAST((row_number() OVER (ORDER BY city) - 1) % 3 AS INTEGER) AS shard FROM cities",
)
def _(d: Data):
    return S.shards(d.cities(), "city", 3)
