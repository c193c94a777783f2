import numpy as np
import pytest
from pyspark.sql import functions as F

from tractlens.operators import decide, heads, isotonic, learn, resample
from tractlens.sources import census, reports, store


def bags(spark, n_bags=12, per=40, seed=0):
    rng = np.random.default_rng(seed)
    rows, shares = [], []
    for b in range(n_bags):
        grade = rng.binomial(4, (b + 0.5) / n_bags, per)
        shares.append((f"b{b}", [float((grade >= k).mean()) for k in (1, 2, 3, 4)]))
        rows += [(f"b{b}", int(g), [float(g + rng.normal(0, 0.4)), float(rng.normal())]) for g in grade]
    inst = spark.createDataFrame(rows, "bag string, ordinal int, vec array<double>")
    return inst, spark.createDataFrame(shares, "bag string, shares array<double>")


def plain_training(inst, labels, train, run):
    """The same rounds with all rows in memory."""
    own = inst[inst.bag.isin(train)]
    x, bag = np.stack(own.vec), own.bag.to_numpy()
    centre, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
    head = run.start(centre, spread)
    for _ in range(run.rounds):
        grad, bias = np.zeros_like(head.weights), np.zeros_like(head.bias)
        for b in train:
            xs = x[bag == b]
            u = head.units(xs)
            e = heads.loss_slope(run.kind, u.mean(axis=0), heads.targets(run.kind, np.array(labels[b]))) / len(xs)
            slope = u * (e - (e * u).sum(axis=1, keepdims=True)) if run.kind == "softmax" else e * u * (1 - u)
            grad += ((xs - centre) / spread).T @ slope / len(train)
            bias += slope.sum(axis=0) / len(train)
        if run.kind == "shared":
            grad = np.repeat(grad.sum(axis=1, keepdims=True), run.size, axis=1)
        head = heads.Head(run.kind, head.weights - run.rate * (grad + run.decay * head.weights), head.bias - run.rate * bias, centre, spread)
    return head


def test_many_heads_in_one_job_equal_plain_training(spark):
    inst, labels = bags(spark, 8, 30)
    names = [f"b{i}" for i in range(8)]
    runs = [heads.Run(kind, rounds=4, seed=seed) for kind in heads.HEADS for seed in (0, 2)]
    lists = [names[i % 3 :] for i in range(len(runs))]
    roles = spark.createDataFrame([(b, [int(b in own) for own in lists]) for b in names], "bag string, roles array<int>")
    got = heads.fit_many(inst.repartition(5), labels, roles, runs)
    rows, shares = inst.toPandas(), {r.bag: r.shares for r in labels.collect()}
    for run, own, head in zip(runs, lists, got):
        want = plain_training(rows, shares, own, run)
        assert np.allclose(head.weights, want.weights) and np.allclose(head.bias, want.bias)


def test_bag_labels_alone_order_unseen_instances(spark):
    inst, labels = bags(spark, 16)
    held = labels.where("bag in ('b3', 'b7', 'b11')")
    stop = labels.where("bag in ('b2', 'b9', 'b14')").select("bag")
    head = learn.fit_proportions(inst, labels.join(held, "bag", "left_anti"), validation=stop, rounds=12, rate=1.0)
    blind = learn.Run().start(head.centre, head.spread)
    assert heads.bag_error(inst, held, head) < heads.bag_error(inst, held, blind)
    quality = learn.map_quality(learn.score_tokens(inst.join(held, "bag", "left_semi"), {"s0": head})).first()
    assert quality.auroc_high > 0.85 and quality.bags_scored == 3


def test_training_stops_when_held_bags_get_worse(spark):
    inst, labels = bags(spark, 6, 20)
    # labels of the stopping bags are turned round, so every step makes them worse
    odd = F.col("bag").isin("b0", "b1")
    turned = labels.withColumn("shares", F.when(odd, F.array(*[F.lit(v) for v in (0.9, 0.9, 0.9, 0.9)])).otherwise(F.array(*[F.lit(v) for v in (0.1, 0.1, 0.1, 0.1)])))
    head = learn.fit_proportions(inst, turned, validation=turned.where(odd).select("bag"), rounds=30, patience=2, rate=2.0)
    assert not head.weights.any()


def test_folds_are_nested_and_never_see_their_own_bags(spark, monkeypatch):
    inst, labels = bags(spark, 11, 20)
    seen = []

    def noted(instances, labels, roles, runs, weight=None):
        seen.extend(r.roles for r in roles.collect())
        return [r.start(np.zeros(2), np.ones(2)) for r in runs]

    monkeypatch.setattr(learn, "fit_many", noted)
    scored = learn.cross_validated_scores(inst, labels, folds=3, seeds=(1, 2), sizes=(4, None))
    assert scored.count() == 2 * 11 * 20
    roles = np.array(seen)
    assert roles.shape == (11, 12)
    short, full = roles[:, :6], roles[:, 6:]
    assert (short.sum(axis=0) == 4).all() and (short <= full).all()
    for s in (0, 3):
        # each bag is held out once per seed
        assert (full[:, s : s + 3].sum(axis=1) == 2).all()


def test_softmax_shares_are_ordered(spark):
    rng = np.random.default_rng(0)
    head = learn.Head("softmax", rng.normal(size=(3, 5)), np.zeros(5), np.zeros(3), np.ones(3))
    s = head.cumulative(rng.normal(size=(20, 3)))
    assert s.shape == (20, 4) and (np.diff(s, axis=1) <= 1e-12).all()


def plain_isotonic(points):
    """Largest over starts of the least over ends of the mean between them."""
    points = sorted(points)
    y, w = (np.array([p[k] for p in points], float) for k in (1, 2))
    n = len(points)
    low = [[min(y[a : u + 1].sum() / w[a : u + 1].sum() for u in range(i, n)) for i in range(n)] for a in range(n)]
    return [max(low[a][i] for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("case", ["noise", "rising", "falling", "steps"])
def test_isotonic_in_slices_and_segments_equals_max_min_of_means(spark, case):
    rng = np.random.default_rng(1)
    n = 60
    trend = {"noise": np.zeros(n), "rising": np.arange(n), "falling": -np.arange(n), "steps": np.arange(n) // 15 * 3}[case]
    rows = [(float(i % n), float(trend[i % n] + (case != "rising") * rng.integers(-3, 4))) for i in range(150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    blocks = isotonic.fit(spark.createDataFrame(rows, "s double, y double").repartition(5), "s", "y", segments=7)
    found = isotonic.predict(blocks, spark.createDataFrame([(float(i),) for i in range(n)], "s double"), "s", "p")
    got = {r.s: r.p for r in found.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    points = {}
    for s, y in rows:
        a, b = points.get(s, (0.0, 0))
        points[s] = a + y, b + 1
    want = plain_isotonic([(s, *v) for s, v in points.items()])
    assert [got[s] for s in sorted(points)] == pytest.approx(want)


def test_isotonic_of_gaps_ends_and_nothing(spark):
    t = spark.createDataFrame([(1.0, 0.0), (3.0, 4.0), (None, 9.0), (5.0, None)], "s double, y double")
    probe = spark.createDataFrame([(0.0,), (2.0,), (2.0,), (7.0,), (None,)], "s double")
    rows = isotonic.predict(isotonic.fit(t, "s", "y"), probe, "s", "p").collect()
    assert sorted((str(r.s), r.p) for r in rows) == [("0.0", 0.0), ("2.0", 2.0), ("2.0", 2.0), ("7.0", 4.0), ("None", None)]
    assert isotonic.predict(isotonic.fit(t.limit(0), "s", "y"), probe, "s", "p").where("p is null").count() == 5


def test_isotonic_is_monotone_and_clipped(spark):
    t = spark.createDataFrame([(1.0, 0), (2.0, 2), (3.0, 1), (4.0, 4)], "score double, ordinal int")
    model = decide.fit_isotonic(t)
    probe = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (9.0,)], "score double")
    got = [r.predicted for r in decide.predict_isotonic(model, probe).orderBy("score").collect()]
    assert got == pytest.approx([0.0, 1.5, 1.5, 4.0])


def test_clustering_widens_the_interval(spark):
    rows = [(f"c{i % 5}", f"m{i}", float(i % 5)) for i in range(40)]
    t = spark.createDataFrame(rows, "city string, municipality string, rho double")
    wide = resample.clustered_mean(t, "city", "rho", resamples=300).first()
    narrow = resample.clustered_mean(t, "municipality", "rho", resamples=300).first()
    assert wide["mean"] == pytest.approx(2.0) and wide.half_width > narrow.half_width
    again = resample.clustered_mean(t, "city", "rho", resamples=300).first()
    assert again == wide


def test_sign_test_is_exact(spark):
    t = spark.createDataFrame([(1.0,)] * 5 + [(0.0,)], "d double")
    row = resample.sign_test(t, "d").first()
    assert (row.n, row.in_favour) == (5, 5) and row.p == pytest.approx(0.0625)


def test_unknown_grade_stops_the_read(spark, tmp_path):
    def line(key, grade):
        return ",".join(["01", "S", "001", "M", "1", "L", "f", key, "12", "x", *["1.5"] * 17, grade])

    good = tmp_path / "good.csv"
    good.write_text("title\n\n" + line("0100100010001", " Muy alto ") + "\n" + line("0100100010002", "") + "\n")
    row = census.read_tracts(spark, str(good)).collect()
    assert len(row) == 1 and row[0].ordinal == 4 and row[0].dwellings is None and row[0].population == 12.0
    bad = tmp_path / "bad.csv"
    bad.write_text(line("0100100010001", "Enorme") + "\n")
    with pytest.raises(Exception, match="unexpected grade"):
        census.read_tracts(spark, str(bad)).collect()


def test_only_lines_after_the_relaunch_count(spark, tmp_path):
    (tmp_path / "process_1.log").write_text("FAIL old x\nRELAUNCHED\nOK a\nFAIL new y\n")
    (tmp_path / "process_2.log").write_text("FAIL lone z\n")
    got = {r.key for r in store.failures_since_relaunch(store.read_logs(spark, str(tmp_path))).collect()}
    assert got == {"new", "lone"}


def test_nested_results_flatten_to_paths(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": {"b": {"c": 1.5}, "d": 2}, "name": "x"}')
    got = {r.path: r.value for r in reports.read_results(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"a.b.c": 1.5, "a.d": 2.0}


def test_results_of_four_levels_come_back(spark, tmp_path):
    rows = [(f"run{k}", f"a.b{i % 3}.c{i % 5}.d{i}", float(i + k) / 7) for k in range(20) for i in range(40)] + [("run0", "top", 1.0)]
    values = spark.createDataFrame(rows, "run string, path string, value double")
    reports.write_results(values, str(tmp_path / "out"), ["run"])
    back = reports.read_results(spark, str(tmp_path / "out"), ["run"], lines=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    clash = spark.createDataFrame([("a", 1.0), ("a.b", 2.0)], "path string, value double")
    with pytest.raises(Exception, match="two results at one path"):
        reports.nested_results(clash).collect()


def test_a_faulty_composite_is_refused_and_the_old_one_stays(spark, tmp_path):
    folder = str(tmp_path / "store")
    grids = spark.createDataFrame([("x", "s2", 4, 4)], "box string, sensor string, h int, w int")
    schema = "box string, sensor string, band string, r int, c int, value double"

    def pixels(rows=4, value=1.0, bands="AB", box="x"):
        return spark.createDataFrame(
            [(box, "s2", b, r, c, value) for b in bands for r in range(rows) for c in range(4)], schema
        )

    def held():
        return {r.value for r in store.load_composite(spark, folder, schema).collect()}

    with pytest.raises(FileNotFoundError):
        held()
    store.save_composite(pixels(), grids, folder, {"scenes": "12"})
    mixed = pixels(bands="A").unionByName(pixels(rows=3, bands="B"))
    for bad, reason in ((pixels(rows=3), "off grid"), (mixed, "mixed shapes"), (pixels().limit(0), "no bands"), (pixels().unionByName(pixels(box="y")), "no grid")):
        with pytest.raises(store.RefusedWrite, match=reason):
            store.save_composite(bad, grids, folder)
        assert held() == {1.0}
    assert store.tags_of(spark, folder) == {"scenes": "12"}
    assert store.save_composite(pixels(value=2.0), grids, folder) == 2 and held() == {2.0}


def test_vectors_must_stand_for_their_instances(spark, tmp_path):
    folder = str(tmp_path / "vectors")
    instances = spark.createDataFrame([(i,) for i in range(6)], "k long")
    schema = "k long, vec array<float>, bag string"

    def vectors(keys=range(6), width=3, last=3):
        return spark.createDataFrame([(i, [0.5] * (last if i == 5 else width), f"b{i % 2}") for i in keys], schema)

    store.save_vectors(vectors(), instances, ["k"], folder)
    assert store.load_vectors(spark, folder, schema, instances, ["k"]).count() == 6
    for bad, reason in (
        (vectors(range(5)), "no vector"),
        (vectors(range(7)), "no instance"),
        (vectors(last=2), "different length"),
        (vectors([0, 1, 2, 3, 4, 5, 5]), "repeated keys"),
        (vectors([]), "no vectors"),
    ):
        with pytest.raises(store.RefusedWrite, match=reason):
            store.save_vectors(bad, instances, ["k"], folder)
    with pytest.raises(ValueError, match="no vector: 1 rows"):
        store.load_vectors(spark, folder, schema, instances.unionByName(spark.createDataFrame([(9,)], "k long")), ["k"])


def test_sums_of_bags_are_worked_on_a_few_at_a_time(spark):
    ids = spark.range(300).select(F.col("id").cast("string").alias("bag"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("total"))
    marks = ids.select("bag", F.array(F.lit(0.5)).alias("shares"), F.array(F.lit(1)).alias("roles"))

    def work(totals, shares, roles):
        assert totals.shape[1:] == (2,) and 0 < len(totals) == len(shares) == len(roles) <= 64
        return totals.sum(axis=0)

    assert heads._over_bags(ids.coalesce(1), marks, 2, work).tolist() == [300 * 299 / 2, 300.0]


def test_whole_bags_leave_no_sums_and_pieces_agree(spark, monkeypatch):
    inst, labels = bags(spark, 8, 30)
    rows, marks = heads._prepared(inst.repartition(5), labels, F.array(F.lit(1)), None)

    def first(x, w, starts, shares, own):
        return np.array([x[:, 0].sum(), len(starts)])

    def never(x, w, starts):
        raise AssertionError("a whole bag left its sums")

    want = inst.select(F.sum(F.col("vec")[0].cast("double"))).first()[0]
    assert np.allclose(heads._each_bag(rows.coalesce(1), marks, 2, first, never, never), [want, 8])
    runs = [heads.Run(kind, rounds=3) for kind in heads.HEADS]
    roles = labels.select("bag", F.array(*[F.when(F.col("bag") == f"b{i}", heads.VALIDATE).otherwise(heads.TRAIN) for i in range(3)]).alias("roles"))
    whole = heads.fit_many(inst, labels, roles, runs)
    monkeypatch.setattr(heads, "HELD_ROWS", 0)
    monkeypatch.setattr(heads, "BAGS_AT_ONCE", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        pieces = heads.fit_many(inst, labels, roles, runs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(whole, pieces):
        assert np.allclose(a.weights, b.weights) and np.allclose(a.bias, b.bias)


def test_draws_left_as_rows_sum_to_the_counted_ones(spark):
    from tractlens.operators.resample import draws

    clusters = spark.createDataFrame([(f"c{i}",) for i in range(9)], "bag string")
    one = draws(clusters, "bag", 12, counted=False).groupBy("replicate", "bag").agg(F.sum("times").alias("times"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, draws(clusters, "bag", 12).collect()))


def test_long_files_are_digested_piece_by_piece(spark, tmp_path, monkeypatch):
    import hashlib

    noise = np.random.default_rng(3).bytes(200_000)
    files = {
        "noise": noise,
        "closed": noise[:90_000] + b"\n",
        "marked": b"\xef\xbb\xbf" + noise[:90_001],
        "marked closed": b"\xef\xbb\xbf" + noise[:70_000] + b"\r\n",
        "ends": b"\r\n\n" * 30_000,
        "one line": b"a" * 130_000,
        "short": b"abc",
        "packed.gz": noise[:80_000],
    }
    for name, content in files.items():
        (tmp_path / f"{name}.bin").write_bytes(content) if name != "packed.gz" else (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(reports, "PIECE", 50_000)
    monkeypatch.setattr(reports, "_ROW_BYTES", 3_000)
    largest = []
    chain = reports._chain
    monkeypatch.setattr(reports, "_chain", lambda states, left: largest.append(len(states)) or chain(states, left))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "25000")
    try:
        got = {r.file: (r.length, r.sha256) for r in reports.manifest(spark, f"{tmp_path}/*").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {n if n == "packed.gz" else f"{n}.bin": (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    assert got == want
    # the longest file goes through four tasks, one after the other
    assert len(largest) == 4


def test_classification_view_makes_its_frame_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(f"t{i}", (i * 37 % 101) / 25.0, i % 5) for i in range(200)]
    frame = spark.createDataFrame(rows, "cvegeo string, score double, ordinal int")
    frame = frame.mapInArrow(counted, frame.schema)
    assert decide.classification_view(frame, frame).count() == 8
    assert made.value == 200
