"""Histogram boosting over binned features, with missing values as a bin of their own.

All models of a comparison (cities left out, feature sets, kinds) grow together: one pass over the
rows yields the gradient histograms of every open node of every model, Spark adds them up, and the
best cut of each node is found in the node's summed histogram. Only histograms are shuffled; their size
depends on models, nodes, features and bins, never on rows. The driver holds the trees.

Rows are only known by their bins. Models of one or two features need no rows at all: their group, target
and bins are counted first, and the passes go over these counts, whose number does not grow with the rows.

A missing value, null or NaN, is bin 0. For each cut both sides are tried for it; where a node saw none
it follows the larger side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.operators.scale import settled

BINS = 64
DEPTH = 3
ROUNDS = 20
RATE = 0.1
MIN_ROWS = 20
CLASSES = 5
COUNTED_FEATURES = 2
"""Feature sets up to this size are trained on counts of their bins, larger ones on rows."""
KEPT_ROUNDS = 10
"""Rounds whose trees are walked again by each pass before the sums are written down."""


@dataclass(frozen=True)
class Task:
    """One model: its feature set, its kind, and the groups whose rows train it."""

    feature_set: str
    kind: str
    features: tuple[str, ...]
    train: frozenset

    def __post_init__(self):
        if self.kind not in ("regressor", "classifier"):
            raise KeyError(f"unknown model {self.kind!r}")
        if not self.features:
            raise ValueError(f"no columns in the set {self.feature_set!r}")


@dataclass
class Tree:
    """A full binary tree in heap order; a node without a cut passes its rows to the left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner, leaves = 2**depth - 1, 2**depth
        return cls(np.full(inner, -1), np.zeros(inner, int), np.zeros(inner, bool), np.zeros(leaves))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after `levels` cuts, counted from the first node of that level.

        Every node says for each bin whether it goes right, so a row is looked up, never compared. Quickest
        where the bins of a feature lie side by side in memory.
        """
        at = np.zeros(len(bins), np.uint8 if levels < 8 else np.int64)
        for level in range(levels):
            right = np.zeros(len(bins), bool)
            for node in range(2**level):
                k = node + 2**level - 1
                if self.feature[k] < 0:
                    continue
                side = np.arange(256) > self.cut[k]
                side[0] = not self.missing_left[k]
                goes = side[bins[:, self.feature[k]]]
                right |= goes & (at == node) if level else goes
            at = 2 * at + right
        return at


@dataclass
class Ensemble:
    """The trees of one task: for every round one tree per output."""

    task: Task
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        depth = int(np.log2(len(self.rounds[0][0].value))) if self.rounds else 0
        total = np.zeros((len(bins), len(self.base)))
        bins = np.asfortranarray(bins)
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                total[:, k] += tree.value[tree.nodes(bins, depth)]
        return total

    def slopes(self, y: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss by each output."""
        if self.task.kind == "regressor":
            return margins - y[:, None], np.ones_like(margins)
        p = self.shares(margins)
        return p - (y[:, None] == np.arange(len(self.base))), p * (1 - p)

    def shares(self, margins: np.ndarray) -> np.ndarray:
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def bin_edges(table: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Cuts between bins: quantiles of each feature over all rows, from one mergeable sketch."""
    levels = [i / (bins - 1) for i in range(1, bins - 1)]
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    row = table.agg(*[F.percentile_approx(k, levels, 10_000).alias(f"q{i}") for i, k in enumerate(known)]).first()
    return {f: sorted(set(row[f"q{i}"] or [])) for i, f in enumerate(features)}


def _binned(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of a feature matrix: 0 missing, else 1 and the number of cuts below the value."""
    out = np.zeros(matrix.shape, np.uint8)
    for f, cuts in enumerate(edges):
        out[:, f] = np.where(np.isnan(matrix[:, f]), 0, 1 + np.searchsorted(cuts, matrix[:, f], side="left"))
    return out


def _feature_matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(f)).cast(pa.float64()) for f in features]
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).reshape(batch.num_rows, len(features))


_CUT = "task int, output int, node int, feature int, bin int, gap_left boolean, g_left double, h_left double, g_right double, h_right double"


def best_cut(cells: np.ndarray, min_rows: int, ridge: float) -> tuple | None:
    """The best cut of one node from its histogram (features, bins, sums of g, h and rows).

    Returns feature, bin, whether gaps go left, and g and h of both sides. Equal gains, to nine
    digits, go to the earlier feature and bin.
    """
    gaps, whole = cells[:, :1], cells.sum(axis=1, keepdims=True)
    low = np.cumsum(cells, axis=1) - gaps
    left = np.stack([low, low + gaps])
    right = whole - left

    def term(side: np.ndarray) -> np.ndarray:
        return side[..., 0] ** 2 / np.maximum(side[..., 1] + ridge, 1e-300)

    gain = term(left) + term(right) - term(whole)
    # where the node saw no gap, gaps follow the larger side
    larger = left[..., 2] >= right[..., 2]
    allowed = (gaps[..., 2] > 0) | (np.array([False, True])[:, None, None] == larger)
    allowed &= (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (gain > 1e-9)
    # bins without rows repeat the cut before them
    allowed &= cells[..., 2] > 0
    if not allowed.any():
        return None
    rounded = np.where(allowed, np.round(gain, 9), -np.inf)
    side, f, b = np.nonzero(rounded == rounded.max())
    first = np.lexsort((-side, b, f))[0]
    at = side[first], f[first], b[first]
    return int(at[1]), int(at[2]), bool(at[0]), *map(float, (*left[at][:2], *right[at][:2]))


def best_cuts(histograms: DataFrame, width: int, min_rows: int, ridge: float) -> DataFrame:
    """The best cut of every node that has one, from rows (node, feature, bin, g, h, n)."""
    cell = ["task", "output", "node", "feature", "bin"]

    def choose(key: tuple, group: pa.Table) -> pa.Table:
        output, node, f, b = (group.column(c).to_numpy() for c in cell[1:])
        sums = np.column_stack([group.column(c).to_numpy() for c in ("g", "h", "n")])
        rows = []
        for k, n in sorted(set(zip(output.tolist(), node.tolist()))):
            own = (output == k) & (node == n)
            cells = np.zeros((width, BINS + 2, 3))
            cells[f[own], b[own]] = sums[own]
            best = best_cut(cells, min_rows, ridge)
            if best is not None:
                rows.append([key[0].as_py(), k, n, *best])
        columns = list(zip(*rows)) or [()] * 10
        kinds = [pa.int32()] * 5 + [pa.bool_()] + [pa.float64()] * 4
        names = [c.split()[0] for c in _CUT.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    # one shuffle; a group holds the histograms of one model's open nodes
    summed = histograms.repartition("task").groupBy(*cell).agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    return summed.groupBy("task").applyInArrow(choose, _CUT)


def fit(
    table: DataFrame,
    group: str,
    target: str,
    tasks: Sequence[Task],
    edges: dict[str, list[float]],
    *,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    rate: float = RATE,
    min_rows: int = MIN_ROWS,
    ridge: float = 1.0,
) -> list[Ensemble]:
    """Grows one ensemble per task; rows without a target train nothing."""
    features = sorted({f for t in tasks for f in t.features})
    cuts = [np.array(edges[f]) for f in features]
    known = table.where(F.col(target).isNotNull())
    # groups times classes
    counts = known.groupBy(group, F.col(target).cast("int").alias("y")).count().collect()
    groups = {g: i for i, g in enumerate(sorted({r[0] for r in counts if r[0] is not None}))}
    trains = np.array([[g in t.train for g in groups] for t in tasks], bool).reshape(len(tasks), len(groups))
    ensembles = []
    for t, task in enumerate(tasks):
        per_class = np.zeros(CLASSES)
        for r in counts:
            if r[0] is not None and trains[t, groups[r[0]]]:
                per_class[r["y"]] += r["count"]
        share = np.maximum(per_class / max(per_class.sum(), 1), 1e-9)
        base = np.array([share @ np.arange(CLASSES)]) if task.kind == "regressor" else np.log(share)
        ensembles.append(Ensemble(task, base))
    widths = [len(e.base) for e in ensembles]
    sets = sorted({t.features for t in tasks})
    columns = [np.array([features.index(f) for f in own]) for own in sets]
    # the tasks of a set, and where the outputs of each begin among the set's
    members = [[t for t, task in enumerate(tasks) if task.features == own] for own in sets]
    starts = [np.cumsum([0, *[widths[t] for t in own]]) for own in members]

    def prepare(chosen: list[int], counted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = np.array([groups.get(g, -1) for g in batch.column("_g").to_pylist()], np.int64)
                used = np.flatnonzero(code >= 0)
                bins = _binned(_feature_matrix(batch, features), cuts)[used]
                code, y = code[used], batch.column("_y").cast(pa.float64()).to_numpy()[used]
                for s in chosen if len(used) else []:
                    own, n, kept = np.ascontiguousarray(bins[:, columns[s]]), np.ones(len(used), np.int64), slice(None)
                    if counted:
                        whole = np.column_stack([code, y, own])
                        kept, n = np.unique(whole, axis=0, return_index=True, return_counts=True)[1:]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), s), pa.int32()),
                            pa.array(code[kept], pa.int32()),
                            pa.array(y[kept]),
                            pa.array([b.tobytes() for b in own[kept]], pa.binary()),
                            pa.array(n),
                            pa.nulls(len(n), pa.binary()),
                        ],
                        ["set", "code", "y", "bins", "n", "margins"],
                    )

        return run

    def unpack(batch: pa.RecordBatch) -> Iterator[tuple]:
        """The rows of each set: its number, their places, groups, targets, bins, counts and margins."""
        number = batch.column("set").to_numpy()
        for s in np.unique(number).tolist():
            at = np.flatnonzero(number == s)
            own = batch if len(at) == len(number) else batch.take(pa.array(at))
            bins = np.frombuffer(b"".join(own.column("bins").to_pylist()), np.uint8).reshape(len(at), len(sets[s]))
            if own.column("margins").null_count:
                margins = np.tile(np.concatenate([ensembles[t].base for t in members[s]]), (len(at), 1))
            else:
                margins = np.frombuffer(b"".join(own.column("margins").to_pylist())).reshape(len(at), starts[s][-1])
            n = own.column("n").to_numpy().astype(float)
            yield s, at, own.column("code").to_numpy(), own.column("y").to_numpy(), bins, n, margins

    schema = "set int, code int, y double, bins binary, n long, margins binary"
    named = known.select(F.col(group).alias("_g"), F.col(target).alias("_y"), *features)
    few = [s for s, own in enumerate(sets) if len(own) <= COUNTED_FEATURES]
    many = [s for s, own in enumerate(sets) if len(own) > COUNTED_FEATURES]
    rows = named.mapInArrow(prepare(many, False), schema)
    if few:
        same = ["set", "code", "y", "bins"]
        counted = named.mapInArrow(prepare(few, True), schema).groupBy(*same).agg(F.sum("n").alias("n"), F.first("margins").alias("margins"))
        rows = rows.unionByName(counted) if many else counted
    rows = settled(rows)
    written = 0
    for number in range(rounds):
        growing = [[Tree.empty(depth) for _ in range(w)] for w in widths]
        sums: dict[tuple[int, int, int], tuple[float, float]] = {}
        for level in range(depth):
            shape = (2**level, len(features), BINS + 2)

            def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    for s, _, code, y, bins, n, margins in unpack(batch):
                        for i, t in enumerate(members[s]):
                            own = np.flatnonzero(trains[t, code])
                            if not len(own):
                                continue
                            b, count = np.asfortranarray(bins[own]), n[own]
                            # trees look at the columns of their own set
                            now = margins[own, starts[s][i] : starts[s][i + 1]] + ensembles[t].margins(b, written)
                            g, h = ensembles[t].slopes(y[own], now)
                            for k in range(widths[t]):
                                total = held.setdefault((t, k), np.zeros((*shape, 3)))
                                node = growing[t][k].nodes(b, level).astype(np.int64) * shape[2]
                                size = shape[0] * shape[2]
                                weights = g[:, k] * count, h[:, k] * count, count
                                for j, f in enumerate(columns[s]):
                                    at = node + b[:, j]
                                    for c, w in enumerate(weights):
                                        total[:, f, :, c] += np.bincount(at, w, size).reshape(shape[0], shape[2])
                for (t, k), total in held.items():
                    node, f, b = np.nonzero(total[..., 2])
                    cells = total[node, f, b]
                    whole = [np.full(len(node), v) for v in (t, k)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(v, pa.int32()) for v in (*whole, node, f, b)], *[pa.array(cells[:, c]) for c in range(3)]],
                        ["task", "output", "node", "feature", "bin", "g", "h", "n"],
                    )

            found = rows.mapInArrow(
                histograms, "task int, output int, node int, feature int, bin int, g double, h double, n double"
            )
            # one row per open node
            for r in best_cuts(found, len(features), min_rows, ridge).collect():
                tree, node = growing[r.task][r.output], r.node + 2**level - 1
                place = tasks[r.task].features.index(features[r.feature])
                tree.feature[node], tree.cut[node], tree.missing_left[node] = place, r.bin, r.gap_left
                for side, g, h in ((0, r.g_left, r.h_left), (1, r.g_right, r.h_right)):
                    sums[r.task, r.output, 2 * node + 1 + side] = g, h
        for (t, k, node), (g, h) in sums.items():
            tree = growing[t][k]
            while node < len(tree.feature):
                # the last cut above a leaf gives its value
                if tree.feature[node] >= 0:
                    break
                node = 2 * node + 1
            else:
                tree.value[node - len(tree.feature)] = -rate * g / (h + ridge)
        for ensemble, trees in zip(ensembles, growing):
            ensemble.rounds.append(trees)
        if (number + 1) % KEPT_ROUNDS == 0 and number + 1 < rounds:

            def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    last = np.empty(batch.num_rows, object)
                    for s, at, _, _, bins, _, margins in unpack(batch):
                        now = margins + np.hstack([ensembles[t].margins(bins, written) for t in members[s]])
                        last[at] = [m.tobytes() for m in now]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(last, pa.binary())], batch.schema.names)

            rows = settled(rows.mapInArrow(advance, schema))
            written = number + 1
    return ensembles


def predict(
    table: DataFrame, group: str, ensembles: Sequence[Ensemble], measured: Sequence[frozenset], edges: dict[str, list[float]]
) -> DataFrame:
    """Rows of `table` once for every model that is measured on their group.

    Adds `task` (the number of the model), `prediction` (a class), `score` (its order) and, for
    classifiers, `probabilities`.
    """
    features = sorted({f for e in ensembles for f in e.task.features})
    cuts = [np.array(edges[f]) for f in features]
    places = [[features.index(f) for f in e.task.features] for e in ensembles]
    columns = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(_feature_matrix(batch, features), cuts)
            names = batch.column(batch.schema.get_field_index(group)).to_pylist()
            for t, (ensemble, groups) in enumerate(zip(ensembles, measured)):
                own = np.flatnonzero([n in groups for n in names])
                if not len(own):
                    continue
                margins = ensemble.base + ensemble.margins(bins[np.ix_(own, places[t])])
                if ensemble.task.kind == "regressor":
                    score, shares = margins[:, 0], pa.nulls(len(own), pa.list_(pa.float64()))
                    hard = np.clip(np.round(score), 0, CLASSES - 1)
                else:
                    p = ensemble.shares(margins)
                    score, shares = p @ np.arange(CLASSES), pa.array(list(p), pa.list_(pa.float64()))
                    hard = p.argmax(axis=1)
                taken = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(np.full(len(own), t), pa.int32()), pa.array(hard, pa.int32()), pa.array(score), shares],
                    [*columns, "task", "prediction", "score", "probabilities"],
                )

    added = "task int, prediction int, score double, probabilities array<double>"
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, f"{whole}, {added}")
