"""The split path must give what the plain window gives, with one group holding most rows."""

import itertools
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tractlens.operators import decide, ranks, scale


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 600
    return pd.DataFrame(
        {
            "city": np.where(np.arange(n) % 3 < 2, "big", [f"c{i % 5}" for i in range(n)]),
            "cvegeo": [f"t{i:05d}" for i in range(n)],
            "score": np.round(rng.normal(size=n), 1),
            "ordinal": rng.integers(0, 5, n),
            "population": rng.integers(1, 900, n).astype(float),
        }
    ).assign(municipality=lambda d: d.city + (d.index % 2).astype(str))


@contextmanager
def many_slices(spark, count=7):
    """Small slices stay apart, so that most groups cross a border."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(count))
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


@pytest.fixture(params=["one slice", "many slices"])
def path(request, spark):
    if request.param == "one slice":
        yield
    else:
        with many_slices(spark):
            yield


def test_running_totals_follow_the_order(spark, rows, path):
    out = scale.running_totals(
        spark.createDataFrame(rows),
        ["city"],
        [F.col("score").asc(), F.col("cvegeo").asc()],
        {"cum": F.col("population")},
        {"total": F.col("population")},
    ).toPandas()
    ordered = rows.sort_values(["city", "score", "cvegeo"])
    want = ordered.assign(cum=ordered.groupby("city").population.cumsum()).set_index("cvegeo").cum
    got = out.set_index("cvegeo").cum
    assert np.allclose(got.sort_index(), want.sort_index())
    assert np.allclose(out.total, out.city.map(rows.groupby("city").population.sum()))


def test_spearman_with_ties(spark, rows, path):
    out = ranks.spearman(spark.createDataFrame(rows), "score", "ordinal", ["city"]).toPandas()
    for row in out.itertuples():
        group = rows[rows.city == row.city]
        want = np.corrcoef(group.score.rank(), group.ordinal.rank())[0, 1]
        assert row.rho == pytest.approx(want, abs=1e-9)
    assert set(out.city) == set(rows.city)


def test_auroc_counts_pairs(spark, rows, path):
    out = ranks.auroc(spark.createDataFrame(rows), "score", F.col("ordinal") >= 3, ["city"]).toPandas()
    for row in out.itertuples():
        group = rows[rows.city == row.city]
        pos, neg = group.score[group.ordinal >= 3].to_numpy(), group.score[group.ordinal < 3].to_numpy()
        wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
        assert row.auroc == pytest.approx(wins, abs=1e-9)


def test_exact_percentiles(spark, rows, path):
    out = scale.exact_percentiles(
        spark.createDataFrame(rows), ["city"], "score", {"a": 0.1, "b": 0.5, "c": 0.97}
    ).toPandas()
    for row in out.itertuples():
        want = np.percentile(rows.score[rows.city == row.city], [10, 50, 97])
        assert np.allclose([row.a, row.b, row.c], want)


def test_targeting_is_bounded_by_the_census_order(spark, rows, path):
    cells = decide.targeting(spark.createDataFrame(rows), ["city"], tie_draws=9).toPandas()
    assert (cells["map"] <= cells.oracle + 1e-6).all()
    assert (cells["aggregate"] <= cells.oracle + 1e-6).all()
    assert len(cells) == rows.city.nunique() * 4


def test_slices_agree_on_targeting(spark, rows):
    df = spark.createDataFrame(rows)
    keys = ["city", "budget"]
    plain = decide.targeting(df, ["city"], tie_draws=5).toPandas().set_index(keys).sort_index()
    with many_slices(spark):
        split = decide.targeting(df, ["city"], tie_draws=5).toPandas().set_index(keys).sort_index()
    for column in ("oracle", "map", "aggregate"):
        assert np.allclose(plain[column], split[column])


@pytest.mark.parametrize("class_rows", [4096, 40, 1])
def test_random_ties_match_the_full_simulation(spark, rows, class_rows):
    import hashlib

    group = rows[rows.city == "big"].assign(tie=lambda d: d.ordinal // 3)
    got = decide.reached_with_random_ties(
        spark.createDataFrame(group), ["city"], "tie", "reached", [0.2, 0.25], tie_draws=4, class_rows=class_rows
    ).toPandas().sort_values("budget")
    total = [0.0, 0.0]
    for draw, k in itertools.product(range(4), range(2)):
        key = [hashlib.md5(f"0|{draw}|{c}".encode()).hexdigest() for c in group.cvegeo]
        order = group.assign(key=key).sort_values(["tie", "key"], ascending=[False, True])
        before = order.population.cumsum() - order.population
        share = ((order.population.sum() * (0.2, 0.25)[k] - before) / order.population).clip(0, 1)
        total[k] += (order.population * share * (order.ordinal >= 3)).sum()
    assert got.reached.tolist() == pytest.approx([t / 4 for t in total])



def test_random_ties_are_drawn_in_as_many_tasks_as_the_session_asks_for(spark, rows):
    one_task = spark.createDataFrame(rows[rows.city == "big"].assign(tie=0)).coalesce(1)
    got = decide.reached_with_random_ties(one_task, ["city"], "tie", "reached", [0.2], tie_draws=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # of every branch, what feeds the rows of the draws
    below = plan.split("Generate explode(sequence")[1:] or plan.split("explode(")[1:]
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    assert any("hashpartitioning(cvegeo" in part and f", {asked}), REPARTITION_BY_NUM" in part for part in below)


def test_one_group_of_a_million_rows_is_split(spark, monkeypatch):
    written = []

    def seen(df):
        written.append(settled(df))
        return written[-1]

    settled = scale.settled
    monkeypatch.setattr(scale, "settled", seen)
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1_000_003).alias("v"))
    with many_slices(spark, 16):
        out = scale.running_totals(rows, ["g"], [F.col("v").asc()], {"place": F.lit(1)}, {"n": F.lit(1)})
        placed = out.select("place", "v", "n").toPandas().sort_values("v")
    assert (placed.place == np.arange(1, len(placed) + 1)).all() and (placed.n == 1_000_000).all()
    sizes = written[0].groupBy("_slice").count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 200_000


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tractlens.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(cluster)


def test_tokens_alone_are_correlated_as_beside_tracts(spark):
    from tractlens.operators import ranks

    rows = [(s, "c", f"m{i % 3}", f"t{i % 18}", i, i % 5, (i * 37 % 101) / 7.0) for s in ("a", "b") for i in range(150)]
    scores = spark.createDataFrame(rows, "system string, city string, municipality string, cvegeo string, y0 int, x0 int, score double")
    grades = spark.createDataFrame([(f"t{i}", i % 5) for i in range(17)], "cvegeo string, ordinal int")
    both = ranks.within(scores, grades, ["system"])
    alone = ranks.within(scores, grades, ["system"], tracts=False)
    keys = ["system", "city", "municipality"]
    assert alone.columns == [*keys, "token"]
    want = {(r.system, r.municipality): round(r.token, 12) for r in both.collect()}
    assert want and {(r.system, r.municipality): round(r.token, 12) for r in alone.collect()} == want
