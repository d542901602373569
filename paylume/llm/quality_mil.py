"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (its surface statistics through a
learned tanh layer); gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages, and a logistic
unit scores the weighted representation. All weights are learned together from document labels by full-batch Adam on at
most ``most`` labelled documents of each label, by hash of their id and weighted back to all labelled rows.

Null and empty texts are one empty passage. Very long texts are handled whole. Without labels every score is the share
of label 1 (0 with none). Repeated rows get equal scores. Labels, language and source are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import NOT_SPACE, Texts, sub_batches
from .toxicity import remainder, training_rows

#: Words of a passage.
PASSAGE = 64
HIDDEN, GATE, STEPS = 16, 8, 400
STATISTICS = 14


def _bytes(test) -> np.ndarray:
    return np.array([bool(test(chr(b)) and b < 128) for b in range(256)])


UPPER = _bytes(str.isupper)
DIGIT = _bytes(str.isdigit)
SYMBOL = _bytes(lambda c: c in "#*$%&|<>")
SHOUT = _bytes(lambda c: c in "!?")
STOP = _bytes(lambda c: c in ".,;:")
VOWEL = _bytes(lambda c: c in "aeiouAEIOU")
HIGH = np.arange(256) >= 128


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of every passage, and where each text's passages begin."""
    starts, ends, of = texts.words(NOT_SPACE)
    n_words = np.diff(of)
    many = np.maximum(-(-n_words // PASSAGE), 1)
    doc = np.repeat(np.arange(len(many)), many)
    at = np.r_[0, np.cumsum(many)]
    first = of[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc]) * PASSAGE
    last = np.minimum(first + PASSAGE, of[1:][doc])
    n = (last - first).astype(float)
    safe = np.maximum(n, 1)

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values, dtype=np.int64)]
        return (total[last] - total[first]).astype(float)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(table[texts.data], dtype=np.int64)]
        return summed(total[ends] - total[starts])

    length = summed(ends - starts)
    chars = np.maximum(length, 1)
    hashes = texts.hashes(starts, ends)
    passage = np.repeat(np.arange(len(n)), (last - first))
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])] if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, passage))
    h, p = hashes[order], passage[order]
    distinct = np.bincount(p[np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]] if len(h) else p, minlength=len(n)).astype(float)
    lines = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        breaks = np.r_[0, np.cumsum(texts.data == 10)]
        lines[1:] = np.minimum(breaks[starts[1:]] - breaks[ends[:-1]], 1)
    letters = np.maximum(chars - of_bytes(SYMBOL) - of_bytes(SHOUT) - of_bytes(STOP) - of_bytes(DIGIT), 1)
    columns = [
        np.log1p(n) / np.log1p(PASSAGE), np.log1p(n_words[doc]) / 8, length / safe / 10, of_bytes(UPPER) / letters, of_bytes(DIGIT) / chars * 5,
        of_bytes(SYMBOL) / safe, of_bytes(SHOUT) / safe, of_bytes(STOP) / safe * 3, of_bytes(HIGH) / chars * 3, of_bytes(VOWEL) / chars,
        distinct / safe, summed(again) / safe, summed(lines) / safe * 5, (n == 0).astype(float),
    ]
    return np.minimum(np.stack(columns, axis=1), 5.0), at


class GatedAttention:
    """The network: parameters, forward pass and gradients over bags given by their offsets."""

    def __init__(self, inputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": draw(inputs, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict:
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
        a = np.exp(s - np.maximum.reduceat(s, at[:-1])[bag])
        a /= np.add.reduceat(a, at[:-1])[bag]
        m = np.add.reduceat(a[:, None] * h, at[:-1])
        return {"z": z, "h": h, "t": t, "g": g, "bag": bag, "a": a, "m": m, "y": 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["b"], -30, 30)))}

    def gradients(self, f: dict, at: np.ndarray, error: np.ndarray) -> dict:
        p = self.p
        dm = error[:, None] * p["c"]
        each = dm[f["bag"]]
        da = (each * f["h"]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, at[:-1])[f["bag"]])
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * each + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["z"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["m"].T @ error, "b": np.array([error.sum()])}

    def fit(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = weight / weight.sum()
        for i in range(1, steps + 1):
            f = self.forward(x, at)
            for k, g in self.gradients(f, at, weight * (f["y"] - label)).items():
                g = g + decay * self.p[k]
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                self.p[k] -= rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.999**i)) + 1e-8)


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        x, at = passages(Texts(batch.column(2)))
        lists = pa.ListArray.from_arrays(pa.array((at * STATISTICS).astype(np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labelled: DataFrame, most: int = 3000) -> GatedAttention:
    """``labelled``: doc_id, label (0 or 1)."""
    known = labelled.where("label IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("doc_id", "label", "text").mapInArrow(_passage_rows, "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    model = GatedAttention(STATISTICS)
    label = np.array([r["label"] for r in rows], float)
    if not len(rows) or label.min() == label.max():
        model.p["b"][:] = -30 if not label.sum() else 30
        model.p["c"][:] = 0
        return model
    bags = [np.array(r["x"]).reshape(-1, STATISTICS) for r in rows]
    share = np.array([totals[c] / max((label == c).sum(), 1) for c in (0, 1)])
    model.fit(np.concatenate(bags), np.r_[0, np.cumsum([len(b) for b in bags])], label, share[label.astype(int)])
    return model


def _score_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: GatedAttention = sent.value
        for batch in sub_batches(batches, "text"):
            x, at = passages(Texts(batch.column(1)))
            f = model.forward(x, at)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f["a"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f["y"]), lists], names=["doc_id", "score", "attention"])

    return run


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """``doc_id, score, attention`` (weights of the passages) of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_rows(sent), "doc_id long, score double, attention array<double>")


def op8_quality_attention(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 5, 0))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
