"""Substring removal with prefix-partitioned suffix trees over words.

A suffix that can repeat starts at a window of ``length`` words. Its prefix, of variable length, runs from the window's
first word to the end of the window's anchor (see :mod:`.repeats`). Suffixes are dealt by these prefixes to groups that
fit in memory; prefixes with more contexts than that are lengthened to the whole window. Within a group the suffixes
are sorted word by word. The words that neighbours share from their starts are the depths of the inner nodes of the
group's suffix tree, and a run of neighbours that share at least ``length`` words is all that hangs below a topmost
deep node, a repeat. Each such node keeps the least document id below it, and a document loses the repeats that stand
in an earlier one.

Null and empty texts have no words. Texts with fewer words than a window are kept whole. Equal texts keep the one with
the least id. Very long texts are handled whole. Ids are taken as unique; documents with a null id are kept whole and
match nothing. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .textkit import NOT_SPACE, Texts, mix

U64 = np.uint64


def sorted_suffixes(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of word numbers) by group, then word by word, and how many words each shares with the
    one before it; -1 where a group begins."""
    order = np.lexsort((*words.T[::-1], group))
    shared = np.zeros(len(order), np.int64)
    equal = np.r_[False, group[order][1:] == group[order][:-1]]
    shared[~equal] = -1
    for column in words.T:
        column = column[order]
        equal[1:] &= column[1:] == column[:-1]
        shared += equal
    return order, shared


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of the topmost tree node of at least that depth above each sorted suffix; one of its own for a leaf."""
    return np.cumsum(shared < depth) - 1


def trees(kind: repeats.Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in repeats.chunks(batches):
            texts = Texts(table.column("context"))
            of = texts.words(NOT_SPACE)[2]
            # contexts hold words joined by one space, so that words are numbered by their bytes
            words = pc.list_flatten(pc.split_pattern(table.column("context"), b" ")).combine_chunks().dictionary_encode().indices.to_numpy()
            h, anchor, first_doc = (table.column(c).to_numpy() for c in ("h", "anchor", "first_doc"))
            many = np.diff(of) - kind.length + 1
            context = np.repeat(np.arange(len(many)), many)
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            earliest = first_doc[context]
            # a context without another of its anchor has no branch below it
            same = np.r_[False, h[1:] == h[:-1]]
            some = np.flatnonzero((same | np.r_[same[1:], False])[context])
            if len(some):
                prefix = mix(h.view(U64)[context[some]] + (anchor[context[some]] - offset[some]).astype(U64))
                suffixes = words[(of[context[some]] + offset[some])[:, None] + np.arange(kind.length)].astype(np.int32)
                order, shared = sorted_suffixes(prefix, suffixes)
                node = deep_nodes(shared, kind.length)
                least = np.minimum.reduceat(earliest[some[order]], np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
                earliest[some[order]] = least[node]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(earliest))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(table.column("c").to_numpy()), lists, pa.nulls(len(many), pa.binary())], names=["h", "c", "first_docs", "mask"])

    return run


def remove_repeats(docs: DataFrame, length: int = 13, texts: bool = True) -> DataFrame:
    """Per document what is left after dropping each word in a window whose words also stand in a document with a
    smaller id: n_tokens, n_removed, n_spans, kept_sha256, ``kept`` (words joined by a space) and ``spans`` of words."""
    kind = repeats.Kind(length, max(1, length // 3), True, True)
    return repeats.find(docs, kind, trees(kind), lambda contexts: contexts.repartition("h"), texts)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return found.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT doc_id, i FROM wins JOIN firsts USING (win) WHERE first_doc < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
