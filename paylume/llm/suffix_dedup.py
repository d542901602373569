"""Removal of repeated byte strings with a range-partitioned suffix array.

A string of ``length`` bytes that can repeat holds an anchor (see :mod:`.repeats`); the suffixes that begin at anchors
stand in for the others. They are range-partitioned by their leading bytes, with splitters that Spark samples. Equal
leading bytes are never split, unless their strings differ within a core that all strings of a group share, so that
no tie crosses a boundary. A bucket sorts its suffixes by multikey quicksort: by their first eight bytes, then only
those that tie by their next eight, and so on, which also gives the bytes that neighbours share. What stands before an
anchor is sorted likewise, read backwards. Two contexts have a string in common that begins ``o`` bytes before the
anchor if their suffixes share ``length - o`` bytes and their backward readings ``o``; both are read off the sorted
neighbours.

Null and empty texts have no bytes. Texts shorter than a string are kept whole. Very long texts are handled whole; both
copies of a string count, also within one document. Ids are taken as unique; documents with a null id are kept whole
and match nothing. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .textkit import Texts

U64 = np.uint64
#: Bytes compared at once.
KEY = 8


def multikey_sort(data: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte strings ``data[start:start + size]`` by group and content, and the bytes that each shares with
    the one before it: -1 where a group begins. Strings go on with zeros after their end."""
    padded = np.r_[data, np.zeros(KEY, np.uint8)]
    lead = np.zeros(len(data) + 1, U64)
    for i in range(KEY):
        lead = lead << U64(8) | padded[i : len(data) + 1 + i]
    order = np.argsort(group, kind="stable")
    tied = np.r_[False, group[order][1:] == group[order][:-1]]
    shared = np.where(tied, 0, -1)
    depth, deepest = 0, int(size.max(initial=0))
    while depth < deepest:
        at = np.flatnonzero(tied | np.r_[tied[1:], False])
        if not len(at):
            break
        rows, run = order[at], np.cumsum(~tied)[at]
        left = np.clip(size[rows] - depth, 0, KEY)
        past = (8 * (KEY - left)).astype(U64)
        key = np.where(left > 0, lead[np.minimum(start[rows] + depth, len(data))] >> past << past, U64(0))
        by = np.lexsort((key, run))
        order[at], key = rows[by], key[by]
        differ = np.r_[U64(0), key[1:] ^ key[:-1]]
        shared[at] += np.where(tied[at], sum((differ < U64(1) << U64(64 - 8 * b)).astype(np.int64) for b in range(1, KEY)) + (differ == 0), 0)
        tied[at] &= differ == 0
        depth += KEY
    return order, np.where(tied, deepest + KEY, shared)


def repeated_strings(data: np.ndarray, group: np.ndarray, begin: np.ndarray, anchor: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """For distinct contexts ``data[begin:end]`` with an anchor: for each of their strings, first string first, whether
    another context of the group has it at the same distance from its anchor."""
    n = len(begin)
    after, before = multikey_sort(data, group, anchor, end - anchor), multikey_sort(data[::-1], group, len(data) - anchor, anchor - begin)
    rank = [np.empty(n, np.int64) for _ in range(2)]
    for r, (order, _) in zip(rank, (after, before), strict=True):
        r[order] = np.arange(n)
    many = end - begin - length + 1
    first = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), bool)
    back = anchor - begin
    for o in range(int((back - many + 1).min()), int(back.max()) + 1):
        some = np.flatnonzero((o <= back) & (o > back - many))
        pair = np.cumsum(after[1] < length - o)[rank[0][some]] * np.int64(n + 1) + np.cumsum(before[1] < o)[rank[1][some]]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = some[count[which] > 1]
        out[first[hit] + back[hit] - o] = True
    return out


def buckets(kind: repeats.Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in repeats.chunks(batches):
            texts = Texts(table.column("context"))
            h, anchor, n = (table.column(c).to_numpy() for c in ("h", "anchor", "n"))
            many = np.diff(texts.at) - kind.length + 1
            same = np.r_[False, h[1:] == h[:-1]]
            masks: list = [np.packbits(np.ones(k, bool)).tobytes() if r else None for k, r in zip(many.tolist(), (n > 1).tolist(), strict=True)]
            # a context without another of its anchor has nothing to be compared with
            some = np.flatnonzero(same | np.r_[same[1:], False])
            if len(some):
                flag = repeated_strings(texts.data, np.cumsum(~same)[some], texts.at[some], texts.at[some] + anchor[some], texts.at[some + 1], kind.length)
                for c, bits in zip(some.tolist(), np.split(flag, np.cumsum(many[some])[:-1]), strict=True):
                    if masks[c] is None and bits.any():
                        masks[c] = np.packbits(bits).tobytes()
            keep = np.array([x is not None for x in masks], bool)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(table.column("c").to_numpy()[keep]), pa.nulls(int(keep.sum()), pa.list_(pa.int64())), pa.array([x for x in masks if x is not None], pa.binary())], names=["h", "c", "first_docs", "mask"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, texts: bool = True) -> DataFrame:
    """Per document what is left after dropping each byte of a string of ``length`` bytes that also starts anywhere
    else: n_tokens, n_removed, n_spans, kept_sha256, ``kept`` and ``spans`` of bytes."""
    gram = max(1, min(16, length // 2))
    kind = repeats.Kind(length, gram, False, False, 4 if length >= 8 * gram else 1)

    def dealt(contexts: DataFrame) -> DataFrame:
        return contexts.withColumn("lead", F.expr(f"substring(context, anchor + 1, {gram})")).repartitionByRange("lead", "h")

    return repeats.find(docs, kind, buckets(kind), dealt, texts)


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return found.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
