"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Examples are a sample of labelled documents, at most ``most`` of each label, by hash of their id. The vocabulary holds
all words of the examples. Document frequencies are counted over all documents. A text's vector is over the words of
the vocabulary: a word that no example has changes no order of the examples, and is not counted in the vector's length.
The lists of rare words are read whole. The words of many examples have a table by example and each block's largest
weight; of these words, only examples are read whose upper bound, from the block or from the vectors' lengths, reaches
the nearest ``k``, so the result is that of a full scan. Votes weigh by similarity. A second vote is that of the nearest
examples over the words whose presence goes with the label by a chi-square test, corrected for the number of words
tried. Both shares of toxic votes are calibrated together on the examples themselves, each without itself, weighted
back to the label frequencies of all labelled rows.

Null and empty texts, and texts without a word of the vocabulary, get the calibrated score of examples without one.
Ties in similarity go to the example with the smaller id. Without labels of both kinds every score is the share of
toxic labels (0 with none). Very long texts are handled whole. Other columns, labels included, are not read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release, trim
from .textkit import ALNUM, Texts, sub_batches

U64 = np.uint64
#: Examples in a block of the index.
BLOCK = 32
#: A word of more than this share of the examples has a column in the table, up to so many words.
COMMON_SHARE, MOST_COMMON = 1 / 4, 512
#: Words of the second vote at most, and the chance of a false one among all words tried.
MOST_WORDS, FALSE_CHANCE = 20_000, 0.01
#: Documents of examples that must hold a word of the second vote.
LEAST_DOCUMENTS = 4


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def word_counts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: text number, word hash, count; sorted."""
    starts, ends, of = texts.words(ALNUM)
    hashes = texts.hashes(starts, ends, lower=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(of))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[first], hashes[first], np.diff(np.r_[first, len(doc)])


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        doc, hashes, count = word_counts(Texts(batch.column(2)))
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(pa.array(at), pa.array(count.astype(np.int32)))], names=["doc_id", "label", "words", "counts"])


def all_words(rows: list, labels: np.ndarray) -> np.ndarray:
    """Hashes of the words of the examples, sorted; none without labels of both kinds."""
    if not rows or labels.min() == labels.max():
        return np.zeros(0, U64)
    return np.unique(np.concatenate([np.array(r["words"], np.int64) for r in rows]).view(U64))


def choose_words(rows: list, labels: np.ndarray) -> np.ndarray:
    """Hashes of the words that go with the label, sorted."""
    words = np.concatenate([np.array(r["words"], np.int64) for r in rows]).view(U64) if rows else np.zeros(0, U64)
    if not len(words) or labels.min() == labels.max():
        return np.zeros(0, U64)
    label = np.repeat(labels, [len(r["words"]) for r in rows])
    known, at = np.unique(words, return_inverse=True)
    with_word = np.bincount(at).astype(float)
    toxic = np.bincount(at, weights=label)
    n, t = float(len(rows)), float(labels.sum())
    spread = with_word * (n - with_word) * t * (n - t)
    chi2 = np.where(spread > 0, n * (toxic * n - with_word * t) ** 2 / np.maximum(spread, 1), 0)
    # the normal tail beyond z is under exp(-z*z/2): a safe bound for one degree of freedom
    limit = 2 * np.log(2 * max(len(known), 1) / FALSE_CHANCE)
    good = np.flatnonzero((chi2 > limit) & (with_word >= LEAST_DOCUMENTS))
    good = good[np.argsort(-chi2[good], kind="stable")][:MOST_WORDS]
    return np.sort(known[good])


def _frequency_rows(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        counts, n = np.zeros(len(words), np.int64), 0
        for batch in sub_batches(batches, "text"):
            texts = Texts(batch.column(0))
            n += len(texts)
            if len(words):
                starts, ends, of = texts.words(ALNUM)
                doc = np.repeat(np.arange(len(texts)), np.diff(of))
                at, good = look_up(words, texts.hashes(starts, ends, lower=True))
                pairs = np.unique(doc[good] * len(words) + at[good])
                counts += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words))), pa.array(np.r_[n, counts])], names=["word", "n"])

    return run


def look_up(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
    return at, (words[at] == hashes) if len(words) else np.zeros(len(hashes), bool)


class BlockMaxIndex:
    """Inverted lists of unit TF-IDF vectors in blocks with their largest weights; exact nearest examples."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, docs: list[int], labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.words, self.idf, self.k = words, idf, k
        # similar examples share blocks: by heaviest word
        order = sorted(range(len(docs)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, docs[i]))
        self.docs, self.labels = np.array([docs[i] for i in order], np.int64), labels[order]
        self.blocks = -(-len(order) // BLOCK)
        word = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int32)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        example = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        by = np.lexsort((example, word))
        self.example, self.weight = example[by], weight[by]
        self.at = np.searchsorted(word[by], np.arange(len(words) + 1)).astype(np.int32)
        # words of many examples: a table of weights, and the largest one of each block
        many = np.diff(self.at)
        common = np.flatnonzero(many > len(order) * COMMON_SHARE)
        common = common[np.argsort(-many[common], kind="stable")][:MOST_COMMON]
        self.column = np.full(len(words), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.table = np.zeros((len(order), len(common)))
        inside = self.column[word] >= 0 if len(word) else np.zeros(0, bool)
        self.table[example[inside], self.column[word[inside]]] = weight[inside]
        self.length = np.sqrt((self.table * self.table).sum(axis=1))
        self.most = np.zeros((len(common), self.blocks))
        np.maximum.at(self.most, (self.column[word[inside]], example[inside] // BLOCK), weight[inside])
        self.focus: BlockMaxIndex | None = None
        self.calibration = (0.0, 0.0, 0.0, 0.0)
        self.empty_score = 0.0
        self.memo: dict[bytes, tuple] = {}

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.idf[words]
        norm = np.sqrt((weight * weight).sum())
        return words, weight / norm if norm > 0 else weight

    def nearest(self, words: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples with the largest cosines above 0, and these."""
        column = self.column[words]
        rare, common = column < 0, column >= 0
        first = self.at[words[rare]]
        many = self.at[words[rare] + 1] - first
        end = np.cumsum(many)
        entry = np.repeat(first - (end - many), many) + np.arange(end[-1] if len(end) else 0)
        part = np.bincount(self.example[entry], weights=np.repeat(weights[rare], many) * self.weight[entry], minlength=len(self.docs))
        column, x = column[common], weights[common]
        by_block = np.repeat(x @ self.most[column], BLOCK)[: len(self.docs)]
        bound = part + np.minimum(by_block, np.sqrt(x @ x) * self.length)
        if without is not None:
            bound[without] = 0
        exact = lambda ids: part[ids] + self.table[np.ix_(ids, column)] @ x
        some = 4 * self.k
        if some < len(bound):
            likely = np.argpartition(-bound, some)[:some]
            least = np.partition(exact(likely), -self.k)[-self.k]
            ids = np.flatnonzero((bound >= least - 1e-9) & (bound > 0))
        else:
            ids = np.flatnonzero(bound > 0)
        got = exact(ids)
        ids, got = ids[got > 0], got[got > 0]
        keep = np.lexsort((self.docs[ids], -np.round(got, 12)))[: self.k]
        return ids[keep], got[keep]

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """Share of toxic votes, weighted by nearness (squared cosine), with one vote by the mean label."""
        w = score * score
        return float((w @ self.labels[best] + 0.5) / (w.sum() + 1))

    def features(self, words: tuple, chosen: tuple, without: int | None = None, without_chosen: int | None = None) -> tuple[list[float], np.ndarray, np.ndarray]:
        """What the calibration takes: the log odds of both votes, and whether the text has no word of the second."""
        best, near = self.nearest(*words, without=without)
        odds = [self.vote(best, near)]
        odds.append(self.focus.vote(*self.focus.nearest(*chosen, without=without_chosen)) if len(chosen[0]) else 0.5)
        return [1.0, *(float(np.log(v / (1 - v))) for v in odds), float(len(chosen[0]) == 0)], best, near

    def calibrate(self, weights: np.ndarray) -> None:
        """Logistic curve over votes of the examples, each without itself; ``weights`` by example."""
        x, rows, empty = [], [], []
        there = {d: i for i, d in enumerate(zip(self.focus.docs.tolist(), self.focus.labels.tolist(), strict=True))}
        for i in range(len(self.docs)):
            words = self.words_of[i]
            if not len(words[0]):
                empty.append(i)
                continue
            j = there[int(self.docs[i]), float(self.labels[i])]
            x.append(self.features(words, self.focus.words_of[j], i, j)[0])
            rows.append(i)
        rate = lambda ids: float((weights[ids] @ self.labels[ids] + 0.5) / (weights[ids].sum() + 1)) if len(ids) else 0.0
        self.empty_score = rate(np.array(empty, int)) if empty else rate(np.arange(len(self.docs)))
        if not x:
            return
        x, start = np.array(x), np.array([0.0, 1.0, 1.0, 0.0])
        y, w, beta = self.labels[rows], weights[rows], start
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta = beta + np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.eye(4) * 1e-2, x.T @ (w * (y - p)) - 1e-2 * (beta - start))
        self.calibration = (float(beta[0]), float(max(beta[1], 0.0)), float(max(beta[2], 0.0)), float(beta[3]))

    def score(self, words: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        if not len(words):
            return self.empty_score, []
        key = words.tobytes() + counts.tobytes()
        if (got := self.memo.get(key)) is None:
            at, good = look_up(self.focus.words, self.words[words])
            x, best, near = self.features(self.vector(words, counts), self.focus.vector(at[good], counts[good]))
            score = 1 / (1 + np.exp(-(np.array(x) @ self.calibration)))
            got = float(score), [{"doc_id": int(d), "toxic": int(t), "similarity": float(s)} for d, t, s in zip(self.docs[best[:3]], self.labels[best[:3]], near[:3], strict=True)]
            if len(self.memo) > 5_000:
                self.memo.clear()
            self.memo[key] = got
        return got


def build(words: np.ndarray, idf: np.ndarray, rows: list, labels: np.ndarray, k: int) -> BlockMaxIndex:
    """The index of the examples over these words; ``words_of`` has their vectors in its order."""
    vectors = []
    for r in rows:
        at, good = look_up(words, np.array(r["words"], np.int64).view(U64))
        w, c = at[good].astype(np.int32), np.array(r["counts"], float)[good]
        weight = (1 + np.log(c)) * idf[w]
        norm = np.sqrt((weight * weight).sum())
        vectors.append((w, weight / norm if norm > 0 else weight))
    index = BlockMaxIndex(words, idf, [r["doc_id"] for r in rows], labels, vectors, k)
    of = {(r["doc_id"], float(r["label"])): v for r, v in zip(rows, vectors, strict=True)}
    index.words_of = [of[d, y] for d, y in zip(index.docs.tolist(), index.labels.tolist(), strict=True)]
    return index


def fit(docs: DataFrame, labelled: DataFrame, most: int = 2000, k: int = 15) -> BlockMaxIndex:
    """``labelled``: doc_id, label (0 or 1). Only these rows' labels are used."""
    spark = docs.sparkSession
    known = labelled.where("label IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("doc_id", "label", "text")
    rows = examples.mapInArrow(_example_rows, "doc_id long, label int, words array<long>, counts array<int>").toArrow().combine_chunks()
    # as arrays: lists of Python numbers take several times the memory
    lists = {c: np.split(pc.list_flatten(rows[c]).to_numpy(), np.cumsum(pc.list_value_length(rows[c]).to_numpy())[:-1]) if rows.num_rows else [] for c in ("words", "counts")}
    rows = [{"doc_id": d, "label": y, "words": w, "counts": c} for d, y, w, c in zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), lists["words"], lists["counts"], strict=True)]
    rows = sorted({(r["doc_id"], r["label"]): r for r in rows}.values(), key=lambda r: (r["doc_id"], r["label"]))
    labels = np.array([r["label"] for r in rows], float)
    words = all_words(rows, labels)
    chosen = choose_words(rows, labels)
    trim()
    sent = spark.sparkContext.broadcast(words)
    counted = texts.select("text").mapInArrow(_frequency_rows(sent), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words) + 1)
    df[counted["word"].to_numpy() + 1] = counted["n"].to_numpy()
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1e-6
    index = build(words, idf, rows, labels, k)
    index.focus = build(chosen, idf[np.searchsorted(words, chosen)], rows, labels, k)
    share = {c: totals.get(c, 0) / max((labels == c).sum(), 1) for c in (0, 1)}
    index.calibrate(np.array([share[int(c)] for c in index.labels]))
    del index.words_of, index.focus.words_of, rows, lists, counted, df
    sent.unpersist()
    release(spark)
    return index


def _score_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: BlockMaxIndex = sent.value
        for batch in sub_batches(batches, "text"):
            texts = Texts(batch.column(1))
            starts, ends, of = texts.words(ALNUM)
            doc = np.repeat(np.arange(len(texts)), np.diff(of))
            at, good = look_up(index.words, texts.hashes(starts, ends, lower=True))
            width = max(len(index.words), 1)
            pairs, count = np.unique(doc[good] * width + at[good], return_counts=True)
            cut = np.searchsorted(pairs, np.arange(len(texts) + 1) * width)
            got = [index.score(pairs[a:b] % width, count[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            evidence = pa.array([e for _, e in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), evidence], names=["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """``doc_id, score, evidence`` (the nearest examples) of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_rows(sent), "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,similarity:double>>")


def training_rows(labels: DataFrame, target: str, by: int, held_out: int) -> DataFrame:
    return labels.where(remainder("doc_id", by) != held_out).select("doc_id", F.col(target).alias("label"))


def op6_toxicity_neighbours(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fit(docs, training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 3, 1))
    scored = score(docs, index)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
