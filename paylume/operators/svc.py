"""Linear support vector classifiers, one class against the rest, for all classes, strengths and folds at once.

The objective is that of ``pyspark.ml``'s ``LinearSVC``: weighted mean hinge loss over columns scaled to weighted mean 0 and
deviation 1 (a scaler before it changes nothing in that), plus half the strength times the squared coefficients. It is
minimised from 0 as there, by L-BFGS steps within which no coefficient changes its sign (memory 10, tolerance 1e-6); the optimum
is the same, the points on the way are not, as the lengths of steps can differ. ``OneVsRest`` and ``CrossValidator`` take a job
for each point of each classifier; here the points that all classifiers ask for next are judged in one job. Rows are packed to
blocks, dealt evenly to as many parts as there are cores and held in memory. A part gives one sum of losses and gradients, so
that what the driver gets in a pass depends on classifiers, columns and cores, not on rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts whose sums go to the driver as they are; of more, some are brought together before.
PARTS = 32
#: Points of a line search, past steps that are remembered, and function values over which it must go down.
SEARCH, MEMORY, VALUES = 20, 10, 20


class Stuck(Exception):
    """No direction, or no step along it."""


@dataclass(frozen=True)
class Scale:
    """Of the training rows of a fold: number of classes, sum of weights, mean, and one over the deviation (0 for a constant)."""

    classes: int
    weight: float
    mean: np.ndarray
    inverse: np.ndarray


@dataclass(frozen=True)
class Model:
    """Coefficients (classes, columns) and intercepts for unscaled columns."""

    coefficients: np.ndarray
    intercepts: np.ndarray

    def classes(self, x: np.ndarray) -> np.ndarray:
        """The class with the largest margin, the first of equal ones."""
        return (x @ self.coefficients.T + self.intercepts).argmax(axis=1)


def descent(grad: np.ndarray, past: deque) -> np.ndarray:
    """Against the gradient by the inverse curvature of past (step, change of gradient), last first."""
    out, kept = grad.copy(), []
    for s, g in past:
        rho = s @ g
        if not rho > 0:
            raise Stuck
        kept.append((s, g, rho, (s @ out) / rho))
        out -= kept[-1][3] * g
    if kept:
        out *= kept[0][2] / (past[0][1] @ past[0][1])
    for s, g, rho, a in reversed(kept):
        out += (a - (g @ out) / rho) * s
    return np.where(-out * grad < 0, -out, 0.0)


def minimise(width: int, iterations: int, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points, is sent their value and gradient, and returns the last point."""
    x = np.zeros(width)
    value, grad = yield x
    start, step, past, values, failed = value, 0, deque(maxlen=MEMORY), deque([np.inf], maxlen=VALUES), False
    while True:
        still = len(values) > 1 and abs(value - max(values)) <= tolerance * start
        if step >= iterations or still or np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            return x
        try:
            way = descent(grad, past)
            side, slope = np.where(x != 0, np.sign(x), np.sign(-grad)), grad @ way
            # no coefficient changes its sign within a step
            at = lambda a: np.where(np.sign(x + way * a) == side, x + way * a, 0.0)  # noqa: B023, E731
            length, shrink = (1.0, 0.5) if step else (0.5 / np.linalg.norm(grad), 0.1)
            new, n, before = at(length), 0, None
            new_value, new_grad = yield new
            while True:
                now = new_grad @ way
                if new_value > value + length * slope * 1e-4:
                    factor = shrink
                elif now < 0.9 * slope:
                    factor = 2.1
                elif now > -0.9 * slope:
                    factor = shrink
                else:
                    break
                if not 1e-10 <= length * factor <= 1e10:
                    raise Stuck
                before, length, n = (new, new_value, new_grad), length * factor, n + 1
                new = at(length)
                new_value, new_grad = yield new
                if n == SEARCH:
                    new, new_value, new_grad = before
                    break
        except Stuck:
            if failed:
                return x
            failed = True
            past.clear()
            continue
        failed, step = False, step + 1
        past.appendleft((new - x, new_grad - grad))
        values.append(new_value)
        x, value, grad = new, new_value, new_grad


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds, labels, weights and columns of a batch as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("a")
        flat = x.flatten().to_numpy(zero_copy_only=False)
        width = len(flat) // batch.num_rows
        if (np.diff(x.offsets.to_numpy()) != width).any() or not np.isfinite(flat).all():
            raise ValueError("vectors must have one length and finite values")
        parts = [batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("fold", np.int32), ("label", np.int32), ("weight", np.float64))] + [flat]
        yield pa.RecordBatch.from_arrays([*(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([width], pa.int32())], names=["fold", "label", "weight", "a", "width"])


def _block(row) -> tuple[np.ndarray, ...]:
    fold, label, weight = (np.frombuffer(bytes(row[c]), t) for c, t in (("fold", np.int32), ("label", np.int32), ("weight", np.float64)))
    return fold, label, weight, np.frombuffer(bytes(row["a"]), np.float64).reshape(-1, row["width"])


def _merged(a: dict, b: dict) -> dict:
    """Both sides' figures by fold: largest label, sums of weights and of their squares, mean, squares about it."""
    out = dict(a)
    for fold, (top, w, ww, mean, m2) in b.items():
        if fold in out:
            top_, w_, ww_, mean_, m2_ = out[fold]
            d = mean - mean_
            out[fold] = max(top, top_), w + w_, ww + ww_, mean_ + d * (w / (w + w_)), m2 + m2_ + d * d * (w * w_ / (w + w_))
        else:
            out[fold] = top, w, ww, mean, m2
    return out


def _figures(blocks) -> Iterator[dict]:
    out: dict = {}
    for fold, label, weight, x in blocks:
        for f in np.unique(fold).tolist():
            at = fold == f
            w, rows = weight[at], x[at]
            # from the first row on, so that a constant column has no deviation at all
            d = rows - rows[0]
            shift = w @ d / w.sum()
            out = _merged(out, {f: (int(label[at].max()), w.sum(), w @ w, rows[0] + shift, w @ (d - shift) ** 2)})
    yield out


def scale_of(figures: dict, left_out: int) -> Scale | None:
    """Of all folds but one; None if they have no rows."""
    total: dict = {}
    for fold in sorted(figures):
        if fold != left_out:
            total = _merged(total, {0: figures[fold]})
    if not total:
        return None
    top, w, ww, mean, m2 = total[0]
    free = w - ww / w
    deviation = np.sqrt(m2 / free) if free > 0 else np.zeros_like(m2)
    return Scale(top + 1, w, mean, np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0))


def _sums(asked: dict[int, tuple[np.ndarray, np.ndarray]], scales: dict[int, Scale]):
    """``asked``: by fold left out, the class and the point (coefficients, intercept) of each classifier."""

    def run(blocks) -> Iterator[list[np.ndarray]]:
        out = [np.zeros((len(points), points.shape[1] + 1)) for _, points in asked.values()]
        for fold, label, weight, x in blocks:
            for total, (left_out, (classes, points)) in zip(out, asked.items(), strict=True):
                at, scale = fold != left_out, scales[left_out]
                z, w = (x[at] - scale.mean) * scale.inverse, weight[at, None]
                y = np.where(label[at, None] == classes, 1.0, -1.0)
                gap = 1.0 - y * (z @ points[:, :-1].T + points[:, -1])
                short = gap > 0
                pull = np.where(short, -y * w, 0.0)
                total[:, 0] += (np.where(short, gap, 0.0) * w).sum(axis=0)
                total[:, 1:-1] += pull.T @ z
                total[:, -1] += pull.sum(axis=0)
        yield out

    return run


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def together(runs: dict, judge: Callable[[dict], dict]) -> dict:
    """What each minimiser returns, all their points judged at once."""
    points, found = {k: next(run) for k, run in runs.items()}, {}
    while points:
        said, points = judge(points), {}
        for k, answer in said.items():
            try:
                points[k] = runs[k].send(answer)
            except StopIteration as end:
                found[k] = end.value
    return found


def fit(rows: DataFrame, regs: list[float], folds: list[int], iterations: int = 50, key: str = "vec_id") -> dict[tuple[float, int], Model]:
    """Models by strength and fold left out, from ``x`` (vector), ``label`` (0, 1, ..), ``weight`` and ``fold``; a fold that is
    no row's leaves none out. Without rows left, there is no model."""
    sc = rows.sparkSession.sparkContext
    depth = 1 if sc.defaultParallelism <= PARTS else 2
    dealt = rows.select(key, F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "weight", vector_to_array("x").alias("a")).repartition(sc.defaultParallelism, key)
    blocks = dealt.mapInArrow(_packed, "fold binary, label binary, weight binary, a binary, width int").rdd.map(_block).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # a plan without rows has no parts
        figures = blocks.mapPartitions(_figures).treeReduce(_merged, depth) if blocks.getNumPartitions() else {}
        scales = {f: s for f in folds if (s := scale_of(figures, f)) is not None}

        def judge(points: dict) -> dict:
            asked = {f: [k for k in points if k[1] == f] for f in scales}
            asked = {f: ks for f, ks in asked.items() if ks}
            send = {f: (np.array([k[2] for k in ks]), np.stack([points[k] for k in ks])) for f, ks in asked.items()}
            sums = blocks.mapPartitions(_sums(send, {f: scales[f] for f in send})).treeReduce(_added, depth)
            out = {}
            for (f, ks), total in zip(asked.items(), sums, strict=True):
                for k, row in zip(ks, total / scales[f].weight, strict=True):
                    w = np.r_[points[k][:-1], 0.0]
                    out[k] = float(row[0] + k[0] / 2 * (w @ w)), row[1:] + k[0] * w
            return out

        found = together({(reg, f, c): minimise(len(s.mean) + 1, iterations) for reg in regs for f, s in scales.items() for c in range(s.classes)}, judge)
    finally:
        blocks.unpersist()
    models = {}
    for reg in regs:
        for f, s in scales.items():
            w = np.stack([found[reg, f, c] for c in range(s.classes)])
            raw = w[:, :-1] * s.inverse
            models[reg, f] = Model(raw, w[:, -1] - raw @ s.mean)
    return models


def predict(rows: DataFrame, models: dict[tuple[float, int], Model], key: str = "vec_id") -> DataFrame:
    """``key, reg, fold, y_true, y_pred`` of each row by the models that its own fold was left out of; ``fold`` as in ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("a").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold = batch.column("fold").to_numpy()
            for (reg, left_out), model in models.items():
                at = np.flatnonzero(fold == left_out)
                if len(at):
                    own = batch.select([key, "y_true"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(at), reg)), pa.array(np.full(len(at), left_out, np.int32)), own.column(1), pa.array(model.classes(x[at]).astype(np.int32))], names=[key, "reg", "fold", "y_true", "y_pred"])

    sent = rows.select(key, F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("y_true"), vector_to_array("x").alias("a"))
    return sent.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, reg double, fold int, y_true int, y_pred int")
