"""Label-proportion heads, many at once.

A head scores every instance of a bag; the mean of the scores is held against the bag's label. All
heads of a study (folds, sizes, seeds, kinds) are trained together: a round is one pass over the
instances, which are written down once with the rows of a bag side by side. A pass multiplies a batch
of vectors by the weights of all heads as one matrix. A bag whose rows are all met at once is finished
where it stands: its error is known and its rows add straight to the gradient of the task. Only a bag
that is cut by a border, or too large to be held, leaves its sums, from which the gradient follows once
they have met in a shuffle; so a bag that holds a third of all instances is only a few sums per batch.
The bags' error on validation bags comes out of the same pass and stops a head early. The driver holds
weights only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractlens.operators.scale import settled

THRESHOLDS = 4
HEADS = ("independent", "shared", "softmax")
TRAIN, VALIDATE = 1, 2
NEAR = 1e-6
BAGS_AT_ONCE = 64
HELD_ROWS = 4096
"""Rows of an unfinished bag that wait for the next batch; larger bags leave sums."""


@dataclass(frozen=True)
class Head:
    """Weights (features x units), biases and the input scaler."""

    kind: str
    weights: np.ndarray
    bias: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def units(self, x: np.ndarray) -> np.ndarray:
        """Per-instance outputs whose bag mean is compared with the label."""
        return squashed(self.kind, (x - self.centre) / self.spread @ self.weights + self.bias)

    def cumulative(self, x: np.ndarray) -> np.ndarray:
        """Shares at grade k or above, k = 1..4."""
        u = self.units(x)
        return u[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] if self.kind == "softmax" else u

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases for vectors that are not scaled."""
        w = self.weights / self.spread[:, None]
        return w, self.bias - self.centre @ w


def squashed(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


@dataclass(frozen=True)
class Run:
    """One head to train; `seed` 0 starts from zero weights, another from small hashed ones.

    `labels` is the number of its label set, where bags carry several.
    """

    kind: str = "independent"
    rounds: int = 30
    rate: float = 0.5
    decay: float = 1e-4
    seed: int = 0
    patience: int = 5
    labels: int = 0
    tags: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.kind not in HEADS:
            raise ValueError(f"unknown head {self.kind!r}")

    @property
    def size(self) -> int:
        return THRESHOLDS + 1 if self.kind == "softmax" else THRESHOLDS

    def start(self, centre: np.ndarray, spread: np.ndarray) -> Head:
        weights = np.zeros((len(centre), self.size))
        if self.seed:
            for i in range(len(centre)):
                draws = hashlib.sha256(f"{self.seed}|{i}".encode()).digest()[: self.size]
                weights[i] = (np.frombuffer(draws, np.uint8) - 127.5) / 127.5 * 0.01
            if self.kind == "shared":
                weights[:] = weights[:, :1]
        bias = np.linspace(1.0, -1.0, self.size) if self.kind == "shared" else np.zeros(self.size)
        return Head(self.kind, weights, bias, centre, spread)


def targets(kind: str, shares: np.ndarray) -> np.ndarray:
    """Label shares, of one bag or one bag a row, in the units of the head."""
    if kind != "softmax":
        return shares
    edge = np.zeros((*shares.shape[:-1], 1))
    return np.concatenate([edge + 1.0, shares], axis=-1) - np.concatenate([shares, edge], axis=-1)


def loss_slope(kind: str, means: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Derivative of the bag loss by each mean: cross-entropy of shares."""
    m = np.clip(means, NEAR, 1 - NEAR)
    return -q / m if kind == "softmax" else (m - q) / (m * (1 - m)) / THRESHOLDS


def _factors(kind: str, u: np.ndarray) -> np.ndarray:
    """Per-instance factors whose sums with the vectors give the gradient."""
    if kind != "softmax":
        return u * (1 - u)
    return np.hstack([u, (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)])


def _gradient(kind: str, errors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Gradient (units x features + 1), added up over bags, from the errors and sums of each."""
    bags, k = errors.shape
    if kind != "softmax":
        return np.einsum("bk,bkd->kd", errors, sums)
    mixed = sums[:, k:].reshape(bags, k, k, -1)
    return np.einsum("bk,bkd->kd", errors, sums[:, :k]) - np.einsum("bj,bkjd->kd", errors, mixed)


def _vectors(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _lists(matrix: np.ndarray) -> pa.Array:
    """One list per row, without a Python number per entry."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def _summed(df: DataFrame, column: str) -> np.ndarray | None:
    """Sum of the vectors of all rows: a few rows, one per partition."""
    total = df.agg(vector_to_array(Summarizer.sum(array_to_vector(column))).alias("t")).first()["t"]
    return None if total is None else np.array(total)


def _prepared(instances: DataFrame, labels: DataFrame, roles: Column, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows (bag, vec, w, n, shares, roles) with a bag side by side, and the labels (bag, shares, roles).

    `n` is the number of the bag's rows. Instances without a label are left out.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    bag = F.col("bag").cast("string").alias("bag")
    marks = settled(
        labels.select(bag, F.col("shares").cast("array<double>").alias("shares"), roles.cast("array<tinyint>").alias("roles"))
    )
    plain = instances.select(bag, F.col("vec").cast("array<double>").alias("vec"), w.alias("w"))
    known = plain.groupBy("bag").agg(F.count("*").alias("n")).join(marks, "bag")
    rows = plain.join(known, "bag").repartitionByRange("bag", F.xxhash64("vec")).sortWithinPartitions("bag")
    return settled(rows), marks


def _each_bag(rows: DataFrame, marks: DataFrame, size: int, finish, sums, work) -> np.ndarray:
    """Sum over all bags of a vector of `size`.

    `finish(x, w, starts, shares, roles)` gets whole bags, with the first row of each, and returns the sum of
    their vectors. Bags in pieces go through `sums(x, w, starts)`, a row of sums per piece, and
    `work(totals, shares, roles)` on what they add up to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = np.zeros(size), None

        def taken(batch: pa.RecordBatch, more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            codes = batch.column("bag").dictionary_encode()
            number = codes.indices.to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            lengths = np.diff(np.append(starts, len(number)))
            n = batch.column("n").to_numpy()[starts]
            waiting = None
            if more and lengths[-1] < n[-1] <= HELD_ROWS:
                waiting = batch.slice(starts[-1])
                batch, starts, lengths, n = batch.slice(0, starts[-1]), starts[:-1], lengths[:-1], n[:-1]
            if not len(starts):
                return
            x, w, met = _vectors(batch.column("vec")), batch.column("w").to_numpy(), lengths == n
            if met.any():
                own, first = np.repeat(met, lengths), pa.array(starts[met])
                shares, roles = (_vectors(batch.column(c).take(first)) for c in ("shares", "roles"))
                held[:] += finish(x[own], w[own], np.cumsum(lengths[met]) - lengths[met], shares, roles)
            if not met.all():
                own, pieces = np.repeat(~met, lengths), lengths[~met]
                px, pw, ends = x[own], w[own], np.cumsum(pieces)
                names = codes.dictionary.take(pa.array(number[starts[~met]]))
                # a few at a time: their sums are much wider than their vectors
                for k in range(0, len(pieces), BAGS_AT_ONCE):
                    begins = (ends - pieces)[k : k + BAGS_AT_ONCE]
                    stop = ends[min(k + BAGS_AT_ONCE, len(ends)) - 1]
                    totals = sums(px[begins[0] : stop], pw[begins[0] : stop], begins - begins[0])
                    yield pa.RecordBatch.from_arrays([names.slice(k, BAGS_AT_ONCE), _lists(totals)], ["bag", "total"])

        for batch in batches:
            if batch.num_rows:
                yield from taken(batch if waiting is None else pa.concat_batches([waiting, batch]), True)
        if waiting is not None:
            yield from taken(waiting, False)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), _lists(held[None])], ["bag", "total"])

    part = rows.mapInArrow(run, "bag string, total array<double>")
    totals = part.groupBy("bag").agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
    return _over_bags(totals, marks, size, work)


def _over_bags(totals: DataFrame, marks: DataFrame, size: int, work) -> np.ndarray:
    """Sum over all bags of `work(totals, shares, roles)`, a vector of `size`; it gets a few bags at a time, one a row.

    A row without a bag holds such a vector already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size)
        for batch in batches:
            done = batch.filter(batch.column("shares").is_null())
            if done.num_rows:
                held += _vectors(done.column("total")).sum(axis=0)
            batch = batch.filter(batch.column("shares").is_valid())
            for first in range(0, batch.num_rows, BAGS_AT_ONCE):
                part = batch.slice(first, BAGS_AT_ONCE)
                held += work(*(_vectors(part.column(c)) for c in ("total", "shares", "roles")))
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.float64()))], ["t"])

    joined = totals.join(marks, "bag", "left").where(F.col("bag").isNull() | F.col("shares").isNotNull())
    found = _summed(joined.select("total", "shares", "roles").mapInArrow(run, "t array<double>"), "t")
    return np.zeros(size) if found is None else found


def fit_many(
    instances: DataFrame, labels: DataFrame, roles: DataFrame, runs: Sequence[Run], weight: str | None = None
) -> list[Head]:
    """Trains one head per run.

    `instances(bag, vec)`, `labels(bag, shares)` with the four cumulative shares (of each label set in
    turn), and `roles(bag, roles)` with one entry per run: TRAIN, VALIDATE or 0. A run with validation bags keeps
    its best head and stops after `patience` rounds without a better one.
    """
    both = labels.select("bag", "shares").join(roles.select("bag", "roles"), "bag")
    rows, marks = _prepared(instances, both, F.col("roles"), weight)
    first = rows.select(F.size("vec").alias("d")).first()
    d, n = first["d"] if first else 0, len(runs)
    counts = {
        role: _summed(marks.select(F.transform("roles", lambda r: (r == role).cast("double")).alias("t")), "t")
        for role in (TRAIN, VALIDATE)
    }
    trained, validated = (np.zeros(n) if c is None else c for c in counts.values())

    def moments(x: np.ndarray, _w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.hstack([np.ones((len(x), 1)), x, x * x]), starts)

    def scaler(totals: np.ndarray, _shares: np.ndarray, own: np.ndarray) -> np.ndarray:
        return ((own == TRAIN).astype(float).T @ totals).ravel()

    def scaled(x: np.ndarray, w: np.ndarray, starts: np.ndarray, shares: np.ndarray, own: np.ndarray) -> np.ndarray:
        return scaler(moments(x, w, starts), shares, own)

    scale = _each_bag(rows, marks, n * (2 * d + 1), scaled, moments, scaler).reshape(n, 2 * d + 1)
    heads = []
    for run, sums in zip(runs, scale):
        size = max(sums[0], 1.0)
        centre = sums[1 : d + 1] / size
        variance = np.maximum(sums[d + 1 :] - size * centre**2, 0.0) / max(size - 1, 1.0)
        heads.append(run.start(centre, np.maximum(np.sqrt(variance), 1e-6)))

    best, best_error, waited = list(heads), np.full(n, np.inf), np.zeros(n, int)
    for step in range(max((r.rounds for r in runs), default=0) + 1):
        live = [i for i, r in enumerate(runs) if step < r.rounds and waited[i] < r.patience]
        # a head after its last round is still measured
        asked = [i for i, r in enumerate(runs) if i in live or (step == r.rounds and validated[i] and waited[i] < r.patience)]
        if not asked:
            break
        kinds = [runs[i].kind for i in asked]
        sizes = [runs[i].size for i in asked]
        cuts = np.cumsum([0, *sizes])
        plain = [heads[i].plain() for i in asked]
        matrix, bias = np.hstack([p[0] for p in plain]), np.concatenate([p[1] for p in plain])
        widths = [s * (1 if k != "softmax" else 1 + s) for k, s in zip(kinds, sizes)]
        places = np.cumsum([0, *widths])
        out = np.cumsum([0, *[s * (d + 1) for s in sizes]])

        def sums(x: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
            z, wide = x @ matrix + bias, np.hstack([x, np.ones((len(x), 1))])
            u = [squashed(kind, z[:, cuts[j] : cuts[j + 1]]) for j, kind in enumerate(kinds)]
            means = np.add.reduceat(np.hstack([np.ones((len(x), 1)), *u]) * w[:, None], starts)
            factors = np.hstack([_factors(kind, own) for kind, own in zip(kinds, u)]) * w[:, None]
            ends = np.append(starts[1:], len(x))
            return np.hstack([means, np.stack([(factors[a:b].T @ wide[a:b]).ravel() for a, b in zip(starts, ends)])])

        def work(totals: np.ndarray, shares: np.ndarray, own: np.ndarray) -> np.ndarray:
            result, mass = np.zeros(out[-1] + len(asked)), totals[:, :1]
            products = totals[:, 1 + cuts[-1] :].reshape(len(totals), places[-1], d + 1)
            for j, (i, kind) in enumerate(zip(asked, kinds)):
                means = totals[:, 1 + cuts[j] : 1 + cuts[j + 1]] / mass
                q = targets(kind, shares[:, THRESHOLDS * runs[i].labels :][:, :THRESHOLDS])
                train, held = own[:, i] == TRAIN, own[:, i] == VALIDATE
                if train.any():
                    errors = loss_slope(kind, means[train], q[train]) / mass[train]
                    result[out[j] : out[j + 1]] = _gradient(kind, errors, products[train, places[j] : places[j + 1]]).ravel()
                if held.any():
                    result[out[-1] + j] = np.abs(means - q)[held].mean(axis=1).sum()
            return result

        def finish(x: np.ndarray, w: np.ndarray, starts: np.ndarray, shares: np.ndarray, own: np.ndarray) -> np.ndarray:
            z, wide = x @ matrix + bias, np.hstack([x, np.ones((len(x), 1))])
            mass = np.add.reduceat(w, starts)[:, None]
            lengths, held_errors, slopes = np.diff(np.append(starts, len(x))), np.zeros(len(asked)), np.zeros_like(z)
            for j, (i, kind) in enumerate(zip(asked, kinds)):
                u = squashed(kind, z[:, cuts[j] : cuts[j + 1]])
                means = np.add.reduceat(u * w[:, None], starts) / mass
                q = targets(kind, shares[:, THRESHOLDS * runs[i].labels :][:, :THRESHOLDS])
                errors = np.where(own[:, [i]] == TRAIN, loss_slope(kind, means, q) / mass, 0.0)
                e = np.repeat(errors, lengths, axis=0)
                inner = u * (e - (e * u).sum(axis=1, keepdims=True)) if kind == "softmax" else u * (1 - u) * e
                slopes[:, cuts[j] : cuts[j + 1]] = inner * w[:, None]
                held_errors[j] = np.abs(means - q)[own[:, i] == VALIDATE].mean(axis=1).sum()
            return np.concatenate([(slopes.T @ wide).ravel(), held_errors])

        found = _each_bag(rows, marks, out[-1] + len(asked), finish, sums, work)
        for j, i in enumerate(asked):
            run, head = runs[i], heads[i]
            if validated[i]:
                error = found[out[-1] + j] / validated[i]
                better = error < best_error[i]
                waited[i] = 0 if better else waited[i] + 1
                if better:
                    best[i], best_error[i] = head, error
            if i not in live or waited[i] >= run.patience:
                continue
            raw = found[out[j] : out[j + 1]].reshape(sizes[j], d + 1) / max(trained[i], 1.0)
            slope = ((raw[:, :-1] - raw[:, -1:] * head.centre) / head.spread).T
            if run.kind == "shared":
                slope = np.repeat(slope.sum(axis=1, keepdims=True), run.size, axis=1)
            slope = slope + run.decay * head.weights
            heads[i] = Head(run.kind, head.weights - run.rate * slope, head.bias - run.rate * raw[:, -1], head.centre, head.spread)
            if not validated[i]:
                best[i] = heads[i]
    return best


def bag_error(instances: DataFrame, labels: DataFrame, head: Head, weight: str | None = None) -> float:
    """Mean absolute error of the bag shares."""
    rows, marks = _prepared(instances, labels, F.array(F.lit(0)), weight)

    def sums(x: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.hstack([np.ones((len(x), 1)), head.units(x)]) * w[:, None], starts)

    def work(totals: np.ndarray, shares: np.ndarray, _own: np.ndarray) -> np.ndarray:
        errors = np.abs(totals[:, 1:] / totals[:, :1] - targets(head.kind, shares)).mean(axis=1)
        return np.array([errors.sum(), len(errors)])

    def finish(x: np.ndarray, w: np.ndarray, starts: np.ndarray, shares: np.ndarray, own: np.ndarray) -> np.ndarray:
        return work(sums(x, w, starts), shares, own)

    error, bags = _each_bag(rows, marks, 2, finish, sums, work)
    return float(error / max(bags, 1.0))
