"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. The items' word sequences
build one suffix automaton per block of about ``BLOCK_WORDS`` words, which bounds what is built and sent at once. A task
takes each batch of its documents through the automata of all blocks, so that the documents are read once and stay rows:
it finds the words, looks them up in a block's vocabulary, and feeds the automaton each run of known words that is long
enough for a match; unknown words reset it, so skipping the rest loses nothing. The automaton tracks the longest match
that ends at each word. Workers hold the automata of all items: the items are a test set, not a corpus.

Null and empty texts have no words and no hits. Items without words never match; repeated items all count. Rows with a null
or repeated id are matched like any other. Documents may be very long. Only the named columns of either table are read, so that others may clash. Empty tables are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, LOWER, Texts, sub_batches

#: Words of benchmark items in one automaton.
BLOCK_WORDS = 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int,first_byte:int,end_byte:int>>"


class SuffixAutomaton:
    """Of several word sequences. States know the items that hold their strings, for strings of a window's length."""

    def __init__(self, items: dict[str, list[bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.items = [-1], [0], [set()]
        #: Items of fewer words than a window, by the state of their whole sequence.
        self.whole: dict[int, set[str]] = {}
        shorter = []
        for item, words in items.items():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for word in ids:
                last = self._extend(last, word)
                self.items[last].add(item)
            if 0 < len(ids) < window:
                shorter.append((item, ids))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            # states shorter than a window are never asked for their items
            if self.link[state] > 0 and self.length[self.link[state]] >= window:
                self.items[self.link[state]] |= self.items[state]
        self.shortest = min([window, *(len(ids) for _, ids in shorter)])
        for item, ids in shorter:
            state = 0
            for word in ids:
                state = self.next[state][word]
            self.whole.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        self.found: dict[int, tuple[int, frozenset[str]]] = {}

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.items.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier item has this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def ending(self, state: int, length: int) -> tuple[int, frozenset[str]]:
        """How many words back the longest window reaches that ends here, and the items with a window that ends here."""
        reach, items = 0, set()
        while state > 0:
            if self.whole and state in self.whole:
                for n, names in self.whole[state].items():
                    if n <= length:
                        reach, items = max(reach, n), items | names
            shortest = self.length[self.link[state]] + 1
            if shortest <= self.window <= length:
                reach, items = self.window, items | {x for x in self.items[state]}
            state = self.link[state]
            length = self.length[state]
        return reach, frozenset(items)


def words_of(texts: Texts, i: int, spans: tuple) -> list[bytes]:
    starts, ends, of = spans
    raw = LOWER[texts.data].tobytes()
    return [raw[a:b] for a, b in zip(starts[of[i] : of[i + 1]].tolist(), ends[of[i] : of[i + 1]].tolist(), strict=True)]


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[dict[str, list[bytes]]]:
    """The items' words, in blocks of bounded size; an item never spans two blocks. Blocks are dealt by a hash of the
    id, so each is gathered alone."""
    rows = items.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + int(total) // (BLOCK_WORDS * 6)
    for b in range(blocks):
        block: dict[str, list[bytes]] = {}
        for i, (k, t) in enumerate(rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toLocalIterator()):
            texts = Texts(pa.array([t], pa.large_string()))
            block[k if k not in block else f"{k}\0{i}"] = words_of(texts, 0, texts.words(ALNUM))
        yield block


class Scanner:
    """One automaton and the hashes of its words, kept by a worker."""

    def __init__(self, auto: SuffixAutomaton):
        keys = Texts(pa.array([w.decode() for w in sorted(auto.vocabulary)], pa.large_string()))
        self.auto = auto
        self.codes = np.sort(keys.hashes(keys.at[:-1], keys.at[1:])) if len(keys) else np.zeros(1, np.uint64)

    def scan(self, texts: Texts, raw: bytes, spans: tuple, hashes: np.ndarray, found: dict[int, tuple[list, set]]) -> None:
        """Adds, by number of the text, stretches of hit words and the items that hit them to ``found``."""
        auto, (starts, ends, of) = self.auto, spans
        if not len(starts):
            return
        seen = self.codes[np.minimum(np.searchsorted(self.codes, hashes), len(self.codes) - 1)] == hashes
        doc_of = np.repeat(np.arange(len(texts)), np.diff(of))
        # runs of known words within a document, of the shortest window's length at least
        first = np.r_[0, np.flatnonzero((seen[1:] != seen[:-1]) | (doc_of[1:] != doc_of[:-1])) + 1]
        last = np.r_[first[1:], len(seen)]
        keep = seen[first] & (last - first >= auto.shortest)
        for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True):
            state = length = 0
            for w in range(a, b):
                word = auto.vocabulary.get(raw[starts[w] : ends[w]])
                state, length = auto.step(state, length, word) if word is not None else (0, 0)
                if length < auto.shortest:
                    continue
                reach, names = auto.ending(state, length)
                if reach:
                    hits, got = found.setdefault(int(doc_of[w]), ([], set()))
                    got |= names
                    hits.append((w + 1 - reach, w + 1))


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(automata: list):
    """A task's function: matches of its documents with all automata, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(a.value) for a in automata]
        for batch in sub_batches(batches, "text"):
            texts = Texts(batch.column(1))
            starts, ends, of = texts.words(ALNUM)
            hashes, raw = texts.hashes(starts, ends, lower=True), LOWER[texts.data].tobytes()
            found: dict[int, tuple[list, set]] = {}
            for scanner in scanners:
                scanner.scan(texts, raw, (starts, ends, of), hashes, found)
            n_words = np.diff(of)
            n_hit, items, spans = np.zeros(len(texts), np.int64), [[] for _ in n_words], [[] for _ in n_words]
            for d, (hits, got) in found.items():
                hits = merged(hits)
                items[d] = sorted({x.split("\0")[0] for x in got})
                n_hit[d] = sum(b - a for a, b in hits)
                spans[d] = [{"start": int(a - of[d]), "end": int(b - of[d]), "first_byte": int(starts[a] - texts.at[d]), "end_byte": int(ends[b - 1] - texts.at[d])} for a, b in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_byte", pa.int32()), ("end_byte", pa.int32())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return run


def matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of the documents, null and repeated ids included: number of words, words inside any occurrence of a window,
    items with occurring windows, and the spans of hit words (word and byte offsets). A window is ``window`` consecutive
    words of an item; an item with fewer is one window. The documents are read once, whatever the number of blocks."""
    share = docs.sparkSession.sparkContext.broadcast
    automata = [share(SuffixAutomaton(block, window)) for block in item_blocks(items, "item_id", "text")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(automata), SCHEMA)


def remove(docs: DataFrame, found: DataFrame, min_span: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without their contaminated spans. Spans of ``min_span`` words or more are cut out of the text; a
    document with a share of hit words over ``max_coverage`` is dropped whole. Others pass unchanged, all columns kept.
    ``found`` comes from :func:`matches` on the same documents; document ids are unique, and documents with a null id pass
    unchanged."""
    hits = found.where("n_hit > 0").select("doc_id", F.struct("n_words", "n_hit", "spans").alias("hit"))
    # the document's columns stand in one column, so that none of them can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    raw = F.encode("doc.text", "UTF-8")
    spans = F.filter("hit.spans", lambda s: s["end"] - s["start"] >= min_span)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["first_byte"]), F.array(F.octet_length("doc.text")))
    kept = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
    joined = rows.join(hits, "doc_id", "left").where(F.col("hit").isNull() | (F.col("hit.n_hit") <= max_coverage * F.col("hit.n_words")))
    text = F.when(F.col("hit").isNull() | (F.size(spans) == 0), F.col("doc.text")).otherwise(F.array_join(kept, " "))
    return joined.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in all of ``documents``."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.n, g.i, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
counted AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""
