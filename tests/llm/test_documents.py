"""Classifier, resharding, near-duplicates, line dedup, extraction and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tractlens.llm import caps, components, gam, htmltext, linededup, minhash, resharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- operator 4


def test_additive_model_learns_bins_and_pairs():
    random = np.random.default_rng(1)
    x = random.uniform(size=(4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.3) & ((x[:, 1] > 0.5) == (x[:, 2] > 0.5))).astype(float)
    model = gam.fit_gam(x[:3000], y[:3000])
    right = (model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)
    assert right.mean() > 0.93
    assert (1, 2) in model.pairs


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = gam.op4_additive_model(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.predicted == held.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_classifier_without_labels_or_texts(spark, stored, empty):
    docs = stored([row(1, None), row(2, ""), row(None, "a text"), row(2, "x " * 50_000)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = gam.fitted(docs, labels)
    assert all(r.score > 0.9999 for r in gam.scored(docs, model).collect())
    assert gam.scored(empty, model).count() == 0
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert gam.scored(docs, gam.fitted(docs, labels)).count() == 4


# ---- operator 5


def test_flow_moves_the_fewest_bytes():
    flow = resharding.minimum_cost_flow({0: 50, 1: 10, 2: 0, 3: 40}, {0: 25, 1: 25, 2: 25, 3: 25}, lambda s, t: int(s != t))
    assert flow[0, 0] == 25 and flow[1, 1] == 10 and flow[3, 3] == 25
    assert sum(a for (s, t), a in flow.items() if s != t) == 40
    for t in range(4):
        assert sum(a for (_, x), a in flow.items() if x == t) == 25


def test_flow_prefers_cheap_routes():
    cost = {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 9}
    flow = resharding.minimum_cost_flow({0: 3, 1: 3}, {0: 3, 1: 3}, lambda s, t: cost[s, t])
    assert flow == {(0, 1): 3, (1, 0): 3}


def test_resharding_levels_sizes_and_numbers_slots(spark, stored, empty, tmp_path):
    random = np.random.default_rng(5)
    rows = [row(i, "ü" * int(random.integers(0, 400)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    rows += [row(None, None), row(7, "same"), row(7, "same")]
    docs = stored(rows, SCHEMA)
    old = (resharding.F.pmod(resharding.F.xxhash64("source"), resharding.F.lit(6))).cast("int")
    placed = resharding.resharded(resharding.sized(docs).withColumn("old_shard", old), shards=8)
    got = placed.toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
    assert (got["size"] == got.text.map(lambda t: len((t or "").encode()) + 16)).all()
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32((t or "").encode()))).all()
    # no more bytes move than the flow asks for, but for one block a shard
    moved = got[got.old_shard != got.shard]["size"].sum()
    supply = got.groupby("old_shard")["size"].sum()
    least = sum(max(0, s - sizes.mean()) if k < 8 else s for k, s in supply.items())
    assert moved <= least + 8 * 2 * got["size"].max()
    affected = resharding.rewrite_affected(placed, str(tmp_path / "new"))
    again = spark.read.parquet(str(tmp_path / "new")).count()
    assert again == got.shard.isin(affected).sum()
    assert resharding.resharded(resharding.sized(empty).withColumn("old_shard", old)).count() == 0


# ---- operator 6


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts():
    random = np.random.default_rng(8)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = list(random.choice(words, 150))
        for copies in range(14):
            one = list(base)
            for k in random.integers(0, 150, int(random.integers(0, 7))):
                one[k] = str(random.choice(words))
            texts.append(" ".join(one).upper() if copies % 3 else "  ".join(one))
    return [*texts, "one two three", "One TWO\nthree", "four words are here", "", None, "a", "x y z w v"]


def test_minhash_equals_brute_force(stored, monkeypatch, empty):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = near_texts()
    docs = stored([row(1000 - i, t) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {1000 - i: plain_set(t) for i, t in enumerate(texts)}
    pairs = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = plain_components(pairs, sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert minhash.near_duplicates(empty).count() == 0


def test_block_pairs_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 3)
    random = np.random.default_rng(3)
    rows = []
    for bucket, low, high in ((1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 1, 1), (3, 0, 2)):
        for _ in range(9):
            bands = [bucket, *random.integers(5, 8, 3).tolist()]
            random.shuffle(bands)
            bands = bands if bands[0] == bucket else [bands[bands.index(bucket)], *[b for b in bands if b != bucket]]
            bands = (bands + [9, 9, 9])[:4]
            mark = bytes(random.integers(0, 2, 64, np.uint8))
            rows.append((bucket, low, high, int(random.choice([low, high])), int(random.integers(1 << 40)), int(random.integers(4)), mark, bands))
    rows.sort(key=lambda r: r[:5])
    names = ["bucket", "low", "high", "own", "id", "component", "signature", "bands"]
    table = pa.table(dict(zip(names, map(list, zip(*rows)))))
    table = table.append_column("small", pa.nulls(len(rows), pa.binary()))
    starts = minhash._starts(table, names[:3])
    assert len(starts) == 5
    got = minhash._block_pairs(table, starts, False, 75).to_pylist()
    want = Counter()
    for x in rows:
        for y in rows:
            meet = x[:3] == y[:3] and (x[4] < y[4] if x[1] == x[2] else x[3] < y[3])
            marks = [np.frombuffer(r[6], np.uint8) for r in (x, y)]
            shared = [k for k in range(4) if x[7][k] == y[7][k]] or [0]
            leads = shared[0] == x[7].index(x[0])
            if meet and x[5] != y[5] and leads and minhash.estimated(*marks) >= minhash.lowest_estimate(0.75):
                want[min(x[4], y[4]), max(x[4], y[4])] += 1
    assert Counter((r["a"], r["b"]) for r in got) == want and want


def test_small_sets_turn_down_no_pair_at_the_threshold(monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 60)
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 62, 50).astype(np.uint64)
    # the first ten agree in their low bits, so several members look alike
    base[:10] = (base[:10] & ~np.uint64(0xFFFF)) | np.uint64(7)
    sets = []
    for _ in range(60):
        own = base[random.random(50) < random.choice([0.6, 0.9, 1.0])]
        new = random.integers(0, 1 << 62, int(random.integers(0, 16))).astype(np.uint64)
        sets.append(np.unique(np.concatenate((own, new))))
    small = [minhash.small_set(s) for s in sets]
    assert any(x is None for x in small) and any(small)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    got = minhash.may_reach(small, left, right, 75)
    exact = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in zip(left, right)])
    known = np.array([small[a] is not None and small[b] is not None for a, b in zip(left, right)])
    assert got[exact].all() and got[~known].all()
    # nearly nothing else passes
    assert (got & known & ~exact).sum() < 0.1 * (known & ~exact).sum()
    assert minhash.may_reach(small, left[:0], right[:0], 75).size == 0


def test_estimates_are_close_and_corrected():
    random = np.random.default_rng(2)
    shared = random.integers(0, 1 << 62, 3000).astype(np.uint64)
    for part in (0.0, 0.4, 0.8, 1.0):
        k = int(2000 * 2 * part / (1 + part))
        a, b = shared[:2000], np.concatenate((shared[2000 - k : 2000], random.integers(0, 1 << 62, 2000 - k).astype(np.uint64)))
        marks = [np.frombuffer(minhash.signature(minhash.minima(s)), np.uint8) for s in (a, b)]
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs(float(minhash.estimated(*marks)) - true) < 0.16


def test_minhash_stage_keeps_rows_without_id_and_one_of_a_repeated_row(stored, spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = stored([row(5, text), row(5, text), row(9, text + " more"), row(None, text), row(None, text), row(7, "other")], SCHEMA)
    left = Counter(r.doc_id for r in minhash.stage(spark, docs, "").collect())
    assert left == {5: 1, None: 2, 7: 1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# ---- operator 7


def test_cap_filters_equal_brute_force(spark, stored):
    random = np.random.default_rng(4)
    vectors, labels = [], []
    for group in range(20):
        centre = random.standard_normal(32)
        for _ in range(12):
            vectors.append((centre + 0.14 * random.standard_normal(32)).astype(np.float32).tolist())
            labels.append(group % 2)
    odd = [([0.0] * 32, 1), (None, 1), ([float("nan")] + [1.0] * 31, 1), ([None] + [1.0] * 31, 0), (vectors[0], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0), (vectors[3], labels[3]), (vectors[3], labels[3]), ([float("inf")] * 32, 1)]
    rows = [(i, v, k) for i, (v, k) in enumerate([*zip(vectors, labels), *odd])] + [(None, vectors[0], labels[0])]
    table = stored(rows, "vec_id long, embedding array<float>, label int", "embeddings")
    got = {r.vec_id: r for r in caps.near_vectors(table).collect()}

    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = {i: (unit(v), k) for i, v, k in rows if i is not None}
    pairs = [
        (a, b)
        for a, (u, k) in units.items()
        for b, (v, m) in units.items()
        if a < b and u is not None and v is not None and k is not None and k == m and len(u) == len(v) and u @ v >= 0.98
    ]
    degree = Counter(x for p in pairs for x in p)
    want = plain_components(pairs, units)
    assert len(pairs) > 200
    for i in units:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i)
    assert got[None].n_links == 0 and got[None].kept
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert caps.near_vectors(none).count() == 0


def test_list_decoding_finds_the_best_directions():
    random = np.random.default_rng(6)
    x = random.standard_normal((50, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, books = caps.product_code(20, 0)
    turned = x @ rotation
    whole = (turned[:, :10] @ books[0].T)[:, :, None] + (turned[:, 10:] @ books[1].T)[:, None, :]
    best = np.argsort(-whole.reshape(50, -1), axis=1)[:, : caps.LIST]
    assert (np.sort(best, axis=1) == np.sort(caps.decoded(x, (rotation, books)), axis=1)).all()


# ---- operator 8


PAGES = {
    "<p>One<p>Two <b>bold</b><br>line": "One\n\nTwo bold\nline",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>": "- a\n- b\n  3. x\n  4. y",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>": "Name      | N\nlong name | 1",
    "<div>a</div><div style='color:red; display: none'>b</div><span hidden>c</span>d": "a\nd",
    "<script>var t='</p>';</script><style>x</style><title>t</title>seen<!-- no -->": "seen",
    "<pre>a\n  b</pre>": "a\n  b",
    "a &amp; b &lt;c&gt; &copy;": "a & b <c> ©",
    "<p>unclosed <i>tags <div>and</b> more": "unclosed tags\n\nand more",
    "<blockquote>said</blockquote>after": "> said\n\nafter",
    "": "",
    "<table><tr><td>一二<td>x<tr><td>abc<td>y</table>": "一二 | x\nabc  | y",
    "text < 3 and <": "text < 3 and <",
}


def test_extraction_of_small_pages():
    for page, text in PAGES.items():
        assert htmltext.visible_text(page) == text, page


def test_formulas_labels_and_row_spans():
    pages = {
        "let <math><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac><semantics><mi>y</mi><annotation>TeX</annotation></semantics></math> be": "let x=1 2y be",
        "<p>a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><g>stray<path d='M0'/><text>Oslo</text><text><tspan>Rome</tspan></text></g></svg>b": "a Oslo Rome b",
        "<svg><foreignObject><p>inside</p></foreignObject></svg>after": "inside\n\nafter",
        "<svg><g><p>left the image": "left the image",
        "<pattern>shown</pattern>": "shown",
        "<svg><text display=none>x</text></svg>y": "y",
        "<table><tr><th rowspan=2>k<td>one<td>1<tr><td>two<td>2<tr><th>l<td>three<td>3</table>": "k | one   | 1\n  | two   | 2\nl | three | 3",
        "<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>": "a | b |  | c\nd |   |  | e",
        "<table><thead><tr><td rowspan=0>h<td>i<tr><td>j</thead><tbody><tr><td>k<td>l</table>": "h | i\n  | j\nk | l",
    }
    for page, text in pages.items():
        assert htmltext.visible_text(page) == text, page


def test_extraction_takes_anything(spark, stored):
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    rows = [(1, "u", deep), (2, "u", None), (None, "u", "<p>y"), (2, "u", "<a title=\"never closed>" * 50), (3, None, "<td>cell</table></ul>")]
    got = [(r.page_id, r.text) for r in htmltext.extracted(stored(rows, "page_id long, url string, html string", "pages")).collect()]
    assert (1, "x") in got and (2, None) in got and (None, "y") in got and (3, "cell") in got and len(got) == 5


# ---- operator 9


def plain_line_dedup(rows, words):
    """Deletes every line in a run of at least `words` words that also stands earlier."""
    order = sorted({(i is None, i if i is not None else 0, t or "") for i, t in rows}, key=lambda r: r)
    import hashlib

    order = sorted(order, key=lambda r: (r[0], r[1], hashlib.md5(r[2].encode()).digest()))
    first, spans = {}, []
    for late, i, text in order:
        lines = text.split("\n")
        spots = [k for k, line in enumerate(lines) if line.split()]
        for a in range(len(spots)):
            for b in range(a + 1, len(spots) + 1):
                run = tuple(lines[k].encode().strip() for k in spots[a:b])
                if sum(len(x.split()) for x in run) >= words:
                    spans.append(((late, i, text), run, spots[a], spots[b - 1]))
                    first.setdefault(run, ((late, i, text), spots[a], spots[b - 1]))
    gone = defaultdict(set)
    for doc, run, a, b in spans:
        where, start, stop = first[run]
        if not (where == doc and a <= stop):
            gone[doc] |= set(range(a, b + 1))
    return {
        d: "\n".join(x for k, x in enumerate(d[2].split("\n")) if k not in gone[d] or not x.encode().split()) for d in order
    }


def test_line_dedup_equals_brute_force(stored, empty):
    random = np.random.default_rng(9)
    pool = [" ".join(f"w{random.integers(50)}" for _ in range(random.integers(1, 9))) for _ in range(25)]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(random.choice([*pool, "", " ", f"unique {i}"], random.integers(1, 14)))))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (4, rows[5][1]), (50, None), (51, "")]
    docs = stored([row(i, t) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text or "") for r in linededup.without_repeats(docs, words=8).collect())
    plain = plain_line_dedup(rows, 8)
    want = Counter((i, plain[i is None, i if i is not None else 0, t or ""]) for i, t in rows)
    assert got == want
    assert sum(n for (i, t), n in got.items()) == len(rows)
    assert linededup.without_repeats(empty).count() == 0


# ---- pipeline


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        counts.append(after.count())
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    texts = [r.text for r in docs.collect()]
    sets = [plain_set(t) for t in texts]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert 100 * len(a & b) < 75 * len(a | b)


def test_pipeline_on_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0, name
