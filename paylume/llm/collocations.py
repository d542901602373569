"""Phrase collocations by SON partitioning.

Everything is by language. The text table is dealt to ``shards`` by partitions. A phrase of 2 to ``longest`` words with
``support`` occurrences has at least ``support / shards`` of them, rounded up, in some shard, the local support:

1. Words are counted exactly. A word below the support is in no phrase.
2. Each shard is mined completely at the local support: its pairs first, then longer phrases all of whose pairs may be
   frequent. Tasks combine what they count, and Spark adds it up by shard, so that a shard is never in one place. Phrases
   are told by 64-bit hashes here, whose collisions only add candidates.
3. The locally frequent phrases are united. Where a shard doesn't report a phrase it has at most the local support less
   one of it, so that a phrase whose reports and these bounds stay below the support is no candidate.
4. All candidates are counted globally and exactly, by their words.

Which words, pairs and candidates may count is handed to the tasks as a Bloom filter of ``1 << BITS`` bits, the same size for
any input; what passes it wrongly is sorted out by the counts that follow.

A phrase's score is the least, over its cuts into two parts, of its count relative to its parts' counts. Phrases that mostly
occur inside a longer one are dropped. All arithmetic is of whole numbers.

Null texts count as empty, a null language as ``und``. Ids and other columns are not read; repeated rows count as often as
they occur. Very long texts are handled whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textkit import LOWER, U64, Texts, _byte_set, mix, sub_batches, word_hashes

#: Bits of the filters, as a power of two: 16 MB.
BITS = 27
#: Bytes of text that a task counts at once.
BLOCK = 1 << 21
#: Bytes that part words, and those of them that also end a piece.
INSIDE = _byte_set((0x20, 0x20), (0x09, 0x0D), *((b, b) for b in b".,;:!?"))
ENDS = ~_byte_set((0x0A, 0x0D), *((b, b) for b in b".,;:!?"))


class Filter:
    """Bloom filter over 64-bit hashes; each sets two bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(hashes: DataFrame) -> Filter:
        """Of column ``h``: at most ``1 << BITS - 6`` words of bits reach the driver."""
        mask = (1 << BITS) - 1
        bits = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 37).bitwiseAND(mask))).alias("bit"))
        words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("word")).toArrow()
        out = np.zeros(1 << BITS - 6, np.int64)
        out[words.column("at").to_numpy()] = words.column("word").to_numpy()
        return Filter(out.view(U64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        good = np.ones(len(hashes), bool)
        for shift in (0, 37):
            bit = hashes >> U64(shift) & U64((1 << BITS) - 1)
            good &= self.words[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1) > 0
        return good


class Block:
    """Words of a sub-batch, lower-cased, with their text's language and the piece they stand in."""

    def __init__(self, batch: pa.RecordBatch):
        texts = Texts(batch.column("text"))
        self.data = LOWER[texts.data]
        low = Texts.__new__(Texts)
        low.data, low.at = self.data, texts.at
        self.starts, self.ends, of = low.words(INSIDE)
        doc = np.repeat(np.arange(len(texts)), np.diff(of))
        piece = np.cumsum(ENDS[self.data], dtype=np.int32)
        # a new text is a new piece
        self.piece = (piece[self.starts] if len(piece) else np.zeros(0, np.int64)) + doc
        lang = batch.column("lang").dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy()[doc]
        names = Texts(self.langs)
        self.lang_hash = word_hashes(names.data, names.at[:-1], names.at[1:], 1)

    def words(self) -> pa.BinaryArray:
        sizes = self.ends - self.starts
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        raw = self.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(raw)])

    def hashes(self) -> np.ndarray:
        """Of each word with its language."""
        return mix(word_hashes(self.data, self.starts, self.ends) ^ self.lang_hash[self.lang]) if len(self.starts) else np.zeros(0, U64)

    def phrases(self, k: int) -> np.ndarray:
        """First words of the phrases of ``k`` words."""
        return np.flatnonzero(self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :]) if len(self.piece) >= k else np.zeros(0, np.int64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its first words and of its last word."""
    return mix(a * U64(0x9E3779B97F4A7C15) + mix(b + U64(0x632BE59BD9B4E019)))


def pairs(block: Block, frequent: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, first words of the pairs of words that may be frequent, and the pairs' hashes."""
    words = block.hashes()
    good = frequent.has(words)
    at = block.phrases(2)
    at = at[good[at] & good[at + 1]]
    return words, at, joined(words[at], words[at + 1])


def longer(block: Block, words: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``k`` words, and their hashes, from those of ``k - 1`` words: both that one overlaps must be there."""
    there = np.zeros(len(words) + 1, bool)
    there[at] = True
    some = there[at + 1] & (block.piece[np.minimum(at + k - 1, len(words) - 1)] == block.piece[at])
    return at[some], joined(hashes[some], words[at[some] + k - 1])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text", BLOCK):
        block = Block(batch)
        table = pa.table({"lang": pa.array(block.lang), "phrase": block.words()}).group_by(["lang", "phrase"]).aggregate([([], "count_all")]).combine_chunks()
        for part in table.to_batches():
            yield pa.RecordBatch.from_arrays([block.langs.take(part.column("lang")), part.column("phrase").cast(pa.large_string()).cast(pa.string()), part.column("count_all")], names=["lang", "phrase", "n"])


def _mined(frequent, two, lengths: list[int], shards: int):
    """Counts of hashed phrases of these lengths by shard; ``two`` are the pairs that longer ones may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for batch in sub_batches(batches, "text", BLOCK):
            block = Block(batch)
            words, at, hashes = pairs(block, frequent.value)
            found = [hashes] if 2 in lengths else []
            if max(lengths) > 2:
                good = two.value.has(hashes)
                at, hashes = at[good], hashes[good]
                for k in range(3, max(lengths) + 1):
                    at, hashes = longer(block, words, at, hashes, k)
                    found.append(hashes)
            unique, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), shard, np.int32)), pa.array(unique.view(np.int64)), pa.array(count)], names=["shard", "h", "n"])

    return run


def _phrase_rows(frequent, candidates, longest: int):
    """Exact counts of the candidates in each block, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BLOCK):
            block = Block(batch)
            words, at, hashes = pairs(block, frequent.value)
            coded = block.words().dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            # numbers of phrases: a phrase's first words and last word as a pair of numbers, numbered anew
            number = code * len(block.langs) + block.lang
            inner = number.copy()
            for k in range(2, longest + 1):
                if k > 2:
                    at, hashes = longer(block, words, at, hashes, k)
                good = candidates.value.has(hashes)
                # what a longer candidate begins with is one itself
                at, hashes = at[good], hashes[good]
                if not len(at):
                    break
                _, first, back, count = np.unique(inner[at] * np.int64(len(coded.dictionary)) + code[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                inner = np.full(len(words), -1, np.int64)
                inner[at] = back
                begin = at[first]
                text = pc.binary_join_element_wise(*(coded.dictionary.take(pa.array(code[begin + i])) for i in range(k)), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([block.langs.take(pa.array(block.lang[begin])), text.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(len(begin), k, np.int32)), pa.array(count)], names=["lang", "phrase", "k", "n"])

    return run


def united(mined: DataFrame, support: int, shards: int) -> DataFrame:
    """Hashes ``h`` that are frequent in some shard and may be frequent in all."""
    least = -(-support // shards)
    local = mined.groupBy("shard", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return local.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("m")).where(F.col("n") + (shards - F.col("m")) * (least - 1) >= support).select("h")


def counted(docs: DataFrame, support: int = 30, longest: int = 4, shards: int = 8) -> tuple[DataFrame, DataFrame]:
    """Occurrences of all words as ``lang, phrase, n``, and of the frequent phrases as ``lang, phrase, k, n``."""
    if shards < 1 or support < 1 or longest < 2:
        raise ValueError("shards and support are at least 1, phrases have two words or more")
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = written(rows.mapInArrow(_word_rows, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    frequent = share(Filter.of(hashed(words.where(F.col("n") >= support))))
    mine = lambda two, lengths: written(united(rows.mapInArrow(_mined(frequent, two, lengths, shards), "shard int, h long, n long"), support, shards))
    two = mine(None, [2])
    found = two
    if longest > 2:
        found = two.unionByName(mine(share(Filter.of(two)), list(range(3, longest + 1))))
    candidates = share(Filter.of(found))
    phrases = rows.mapInArrow(_phrase_rows(frequent, candidates, longest), "lang string, phrase string, k int, n long").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    return words, written(phrases)


def hashed(words: DataFrame) -> DataFrame:
    """Hashes of words with their language, as tasks hash them in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = Texts(batch.column("lang")), Texts(batch.column("phrase"))
            h = mix(word_hashes(word.data, word.at[:-1], word.at[1:]) ^ word_hashes(lang.data, lang.at[:-1], lang.at[1:], 1))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h long")


def scored(words: DataFrame, phrases: DataFrame, support: int = 30, inside_percent: int = 80) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the frequent phrases that no longer one takes in with ``inside_percent`` of
    their occurrences."""
    size = words.groupBy("lang").agg(F.sum("n").alias("n"))
    part = lambda a, m: F.array_join(F.slice("w", a, m), " ")
    split = phrases.withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", F.col("n").alias("a"), "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    # parts of a frequent phrase are frequent
    counts = words.where(F.col("n") >= support).unionByName(phrases.select("lang", "phrase", "n"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(2000000 AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    spans = split.where("k > 2").select("lang", "n", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    spans = spans.select("lang", "n", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i")).select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "n")
    inside = spans.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(19, 0)) * longer < CAST({inside_percent} AS DECIMAL(19, 0)) * a"))
    return kept.join(size, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, support: int = 30, longest: int = 4, shards: int = 8, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase."""
    found = scored(*counted(docs, support, longest, shards), support)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PART = "array_to_string(w[{0}:{1}], ' ')"
OP13_SQL = rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM (SELECT lang, k, {_PART.format("i", "i + k - 1")} AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) t(k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, cut, {_PART.format("1", "cut")} AS p, {_PART.format("cut + 1", "k")} AS q FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
best AS (SELECT lang, phrase, a, l, r, score FROM (SELECT cuts.*, x.c AS l, y.c AS r, CAST(2000000::HUGEINT * a // (x.c + y.c) AS BIGINT) AS score, row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 2000000::HUGEINT * a // (x.c + y.c), cut) AS o FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q) WHERE o = 1),
spans AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, {_PART.format("i", "i + m - 1")} AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN spans USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN sizes USING (lang)) WHERE rank <= 2000
"""
