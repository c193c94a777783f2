import pytest
from pyspark.sql import functions as F

from tractlens.operators import labels as L
from tractlens.operators import splits as S

TRACTS = "cvegeo string, ordinal int, population double"


def test_population_weights_the_label(spark):
    t = spark.createDataFrame([("01001aaaaaaaa", 0, 900.0), ("01001bbbbbbbb", 4, 100.0)], TRACTS)
    row = L.municipal_labels(t).first()
    assert row.ordinal_continuous == pytest.approx(0.4)
    assert (row.ordinal, row.grade, row.tracts) == (0, "Very low", 2)
    assert row.p1 == row.p4 == pytest.approx(0.1)


def test_nobody_living_means_equal_weights(spark):
    t = spark.createDataFrame([("01001aaaaaaaa", 1, 0.0), ("01001bbbbbbbb", 4, None)], TRACTS)
    row = L.municipal_labels(t).first()
    assert row.ordinal_continuous == pytest.approx(2.5)
    assert row.ordinal == 2  # half to even
    assert row.population == 2.0


def test_absent_grades_count_zero(spark):
    t = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 5.0)], TRACTS)
    out = {r.grade: r for r in L.grade_summary(t).collect()}
    assert len(out) == 5 and out["High"].tracts == 0 and out["Low"].pct_tracts == 100.0


def test_cities_are_dealt_eight_one_one(spark):
    cities = spark.range(138).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("city"),
        (150 + F.col("id") * 37 % 1050).alias("n_tracts"),
        (F.col("id") * 13 % 50 / 100.0).alias("high_share"),
    )
    got = {r["split"]: r["count"] for r in S.assign(cities).groupBy("split").count().collect()}
    assert sum(got.values()) == 138 and got["train"] in (110, 111, 112) and abs(got["val"] - got["test"]) <= 1


def test_leaks_are_counted(spark):
    part = spark.createDataFrame([("a", "train"), ("b", "test")], "city string, split string")
    inst = spark.createDataFrame(
        [("a", "m1", "t1"), ("b", "m1", "t2"), ("z", "m2", "t3")], "city string, municipality string, cvegeo string"
    )
    got = {r.check: r.violations for r in S.leak_report(part, inst).collect()}
    assert got == {
        "repeated city": 0,
        "unassigned instance": 1,
        "tract in two splits": 0,
        "municipality in two splits": 1,
    }


def test_the_seat_owns_its_municipality(spark):
    t = spark.createDataFrame(
        [("m1", "big", "t1"), ("m1", "big", "t2"), ("m1", "seat", "t1"), ("m2", "y", "t3"), ("m2", "x", "t3")],
        "municipality string, city string, cvegeo string",
    )
    seats = spark.createDataFrame([("m1", "seat"), ("m2", "absent")], "municipality string, city string")
    own = {r.municipality: r.city for r in S.municipality_owner(t, seats).collect()}
    assert own == {"m1": "seat", "m2": "x"}
    kept = S.deduplicate(t, seats)
    assert kept.count() == 2 and S.still_repeated(kept).first().repeated == 0


def test_constant_feature_becomes_zero_and_null_stays(spark):
    t = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", None, 5.0)], "city string, x double, k double")
    rows = S.standardise_by_group(t, ["x", "k"]).collect()
    assert {r.k for r in rows} == {0.0}
    assert sum(r.x is None for r in rows) == 1


def test_nested_sample_prefix_is_balanced(spark):
    bags = spark.range(40).select(
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("municipality"), (F.col("id") % 4).cast("int").alias("ordinal")
    )
    first = S.nested_sample(bags, 1).where("place <= 8").groupBy("ordinal").count().collect()
    assert {r["count"] for r in first} == {2}


def test_training_on_held_out_ground_stops(spark):
    bags = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "municipality string, n int")
    held = bags.where("n = 2")
    clean = L.exclude_leaks(bags, held)
    assert L.disjoint(clean, held).count() == 2
    with pytest.raises(ValueError, match="held-out ground: b"):
        L.disjoint(bags, held)
