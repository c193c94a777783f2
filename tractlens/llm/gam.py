"""Operator 4: quality classifier, a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees are boosted in cycles, one feature at a time,
and summed into one table of log-odds per feature; the pairs that still explain most of the error
get a table of their own. A document's score is the logistic of the table entries of its bins.

The model is fitted on labelled rows only, at most `SAMPLE` of them in the order of a hash of their
id (a stated bound, so fitting fits in one process); features and scores cover all documents.
Texts that are null count as empty and get the score of an empty text. Rows with a null id are
scored, never learned from. Repeated labels of an id count once, by their mean. Without labels of
both kinds the score is the mean label (1 where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractlens.llm.common import held_out, table

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 12
ROUNDS = 120
RATE = 0.15
THRESHOLD = 0.3

FEATURES = (
    "words word_length upper symbols shouts digits stops commas pipes lines repeated_lines distinct "
    "repeated_triples symbol_ends longest letters foreign short links at_signs quotes brackets title"
).split()

_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _HIGH = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[list(b"#*$%&|<>")] = _SYMBOL
_CLASS[128:] = _HIGH


def features_of(text: str | None) -> list[float]:
    """The feature values of one whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = max(len(words), 1)
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_CLASS[codes], minlength=7)
    counts = np.bincount(codes, minlength=256)
    letters = kinds[_UPPER] + kinds[_LOWER] + kinds[_HIGH]
    visible = max(len(raw) - kinds[_SPACE], 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if len(words) >= 3:
        number: dict[bytes, int] = {}
        seq = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        triples = (seq[:-2] << 42) ^ (seq[1:-1] << 21) ^ seq[2:]
        repeated = 1 - len(np.unique(triples)) / len(triples)
        distinct = len(number) / n
    else:
        repeated, distinct = 0.0, len(set(words)) / n
    ends = sum(1 for w in words if w[-1] in b"#*$%&|<>!")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()),
        kinds[_UPPER] / max(kinds[_UPPER] + kinds[_LOWER], 1),
        kinds[_SYMBOL] / n,
        counts[33] / n,
        kinds[_DIGIT] / visible,
        (counts[46] + counts[63]) / n,
        counts[44] / n,
        counts[124] / n,
        len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        distinct,
        repeated,
        ends / n,
        float(np.log1p(lengths.max())),
        letters / visible,
        kinds[_HIGH] / visible,
        float((lengths <= 3).sum()) / n,
        (raw.count(b"http") + raw.count(b"www.")) / n,
        counts[64] / n,
        (counts[34] + counts[39]) / n,
        (counts[40] + counts[41] + counts[91] + counts[93] + counts[123] + counts[125]) / n,
        sum(1 for w in words if 65 <= w[0] <= 90) / n,
    ]


@dataclass
class Gam:
    """Lookup tables on bins; `edges[f]` separates the bins of feature f."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, steps in enumerate(self.tables):
            total += steps[np.searchsorted(self.edges[f], x[:, f], side="right")]
        places = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for (f, g), steps in zip(self.pairs, self.pair_tables):
            total += steps[places[f], places[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    distinct = np.unique(values)
    upper = distinct[np.searchsorted(distinct, cuts, side="right").clip(0, len(distinct) - 1)]
    # between two neighbouring values, so that rounding never moves a row to another bin
    return np.unique(np.where(upper > cuts, (cuts + upper) / 2, np.inf))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of ordered bins: its gain and the first bin on the right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where((hl > 0) & (hr > 0), gain, 0.0)
    best = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[best]) if len(gain) else 0.0), best + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Leaf values per bin of a tree with at most `leaves` leaves."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        options = [(*_split(g[a:b], h[a:b], ridge), a, b) for a, b in parts if b - a > 1]
        if not options or max(options)[0] <= 1e-9:
            break
        _, cut, a, b = max(options)
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    steps = np.zeros(len(g))
    for a, b in parts:
        steps[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return steps


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One cut of the first feature, then one cut of the second on each side: gain and values."""
    best, values = 0.0, np.zeros_like(g)
    root = g.sum() ** 2 / (h.sum() + ridge)
    for cut in range(1, g.shape[0]):
        steps, gain = np.zeros_like(g), -root
        for side in (slice(0, cut), slice(cut, None)):
            gs, hs = g[side].sum(0), h[side].sum(0)
            _, at = _split(gs, hs, ridge)
            for a in (slice(0, at), slice(at, None)):
                total, weight = gs[a].sum(), hs[a].sum()
                gain += total**2 / (weight + ridge)
                steps[side, a] = -total / (weight + ridge)
        if gain > best:
            best, values = gain, steps
    return best, values


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, ridge: float = 2.0) -> Gam:
    """Cyclic boosting of single-feature trees, then of the strongest pairs."""
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = [np.zeros(0)] * width
        return Gam(none, none, float(np.log(share / (1 - share))), [np.zeros(1)] * width, [], [])
    share = y.mean()
    edges = [_edges(x[:, f], BINS) for f in range(width)]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    fine = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    rough = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Gam(edges, coarse, float(np.log(share / (1 - share))), tables, [], [])
    logit = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            step = rate * _tree(np.bincount(fine[f], g, size), np.bincount(fine[f], h, size), ridge)
            tables[f] += step
            logit += step[fine[f]]

    def grid(f: int, k: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        return np.bincount(rough[f] * shape[1] + rough[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(
        ((_pair_tree(grid(f, k, g), grid(f, k, h), ridge)[0], f, k) for f in range(width) for k in range(f + 1, width)),
        key=lambda t: (-t[0], t[1], t[2]),
    )
    model.pairs = [(f, k) for gain, f, k in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)) for f, k in model.pairs]
    for _ in range(rounds // 4):
        for steps, (f, k) in zip(model.pair_tables, model.pairs):
            g, h = slopes()
            step = rate * _pair_tree(grid(f, k, g), grid(f, k, h), ridge)[1]
            steps += step
            logit += step[rough[f], rough[k]]
    return model


def _feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Learns from labelled rows that are not held out.

    At most `sample` labelled ids are chosen before documents are read, so the side that is
    broadcast is bounded and no text is shuffled.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(0, 5))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _feature_matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(list(rows), pa.list_(pa.float64()))],
                ["doc_id", "label", "x"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")
    # repeated rows of an id are one example
    got = joined.mapInArrow(run, f"doc_id {id_type}, label double, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_gam(x, got["label"].to_numpy(float))


def scored(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """All columns of `docs` and the score of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gam = shared.value
        for batch in batches:
            scores = gam.score(_feature_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(columns))], pa.array(scores)], [*columns, name]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op4_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    result = scored(docs, model).drop("text")
    return result.select(
        "doc_id",
        held_out(0, 5).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents below the threshold go."""
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, "_quality").where(F.col("_quality") >= THRESHOLD).drop("_quality")


QUERIES = {"op4_additive_model": op4_additive_model}
SQL: dict[str, str] = {}
