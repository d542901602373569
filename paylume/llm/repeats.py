"""Common ground of the two exact repeat finders: content-chosen anchors stand in for all suffixes.

A window is ``length`` consecutive tokens of one document. Its anchor is the gram of ``gram`` tokens in it with the
least hash (leftmost on ties), so equal windows have their anchors at equal places, and one anchor serves a run of
neighbouring windows: about ``2 / (length - gram + 2)`` anchors per token instead of one suffix per token. Steps:

1. count anchors over all documents (map-side combined) and write those that occur twice or more;
2. bring the kept anchors back to their documents, but not to further copies of a whole text, which are decided at once;
3. cut out each kept anchor's context, the tokens of its run of windows, with the places where it stands; this table is
   written, and equal contexts are folded into one before anything compares contexts;
4. distinct contexts are dealt by anchor to groups that fit in memory, and the named method decides exactly which of
   their windows repeat. An anchor with more than ``GROUP`` distinct contexts doesn't fit: its windows are told apart by
   all their tokens instead of the anchor's, and such a group holds equal windows only, so that a count or a least id,
   combined map-side, is all there is to decide;
5. the verdicts go back to the places and each document drops the covered tokens.

No step gathers an unbounded key: only counts, and per document lists bounded by its own length. Joins are left to
AQE, which splits hot keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written
from .textkit import NOT_SPACE, Texts, byte_grams, mix, prefix_sums, range_hash, sub_batches, word_hashes

U64 = np.uint64
#: Bytes of contexts that a task holds, to fold equal ones, before it passes them on.
HELD_BYTES = 1 << 24
#: Distinct contexts of one anchor that are resolved in memory.
GROUP = 8192
#: Bytes of contexts that are resolved at once, but whole anchors.
CHUNK_BYTES = 1 << 21
#: Parts over which copies of one text are dealt.
SALT = 16


@dataclass(frozen=True)
class Kind:
    """What is compared. ``words``: white-space words, else bytes. ``earlier``: only repeats of a document with a
    smaller id count, else any other place."""

    length: int
    gram: int
    words: bool
    earlier: bool
    #: Runs are split by the anchor's place in the window into so many parts; all windows of a part share a core of
    #: tokens around the anchor, whose hash takes the place of the gram's. More parts, longer cores, fewer false repeats.
    parts: int = 1


class Tokens:
    """Tokens of a sub-batch of texts: their number ``n`` and ``of``, where each document's tokens begin."""

    def __init__(self, texts: Texts, kind: Kind):
        self.texts = texts
        self._sums: dict[int, np.ndarray] = {}
        if kind.words:
            self.starts, self.ends, self.of = texts.words(NOT_SPACE)
            self.value = texts.hashes(self.starts, self.ends)
            self.n = len(self.value)
        else:
            self.of, self.n = texts.at, len(texts.data)

    def grams(self, gram: int) -> np.ndarray:
        """Hash of the ``gram`` tokens at each place where so many are left."""
        if not hasattr(self, "starts"):
            return byte_grams(self.texts.data, gram)
        at = np.arange(self.n - gram + 1)
        return self.hashes(at, at + gram)

    def hashes(self, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the tokens first to last."""
        if not hasattr(self, "starts"):
            return word_hashes(self.texts.data, first, last, which)
        if which not in self._sums:
            self._sums[which] = prefix_sums(self.value, which)
        return range_hash(self._sums[which], first, last, which)

    def bytes_of(self, first: int, last: int) -> bytes:
        """Tokens first to last, words joined by one space."""
        raw = self.texts.data
        if not hasattr(self, "starts"):
            return raw[first:last].tobytes()
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


def anchors(tokens: Tokens, kind: Kind) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document number, first window, number of windows, anchor place, anchor hash."""
    of = tokens.of
    if tokens.n < kind.length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    grams = tokens.grams(kind.gram)
    at = np.arange(len(grams))
    place = (least((grams >> U64(32) << U64(32)) | at.astype(U64), kind.length - kind.gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(of)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[: len(place)] == doc[kind.length - 1 :]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    many = np.diff(np.r_[first, len(place)])
    keep = inside[first]
    first, many = first[keep], many[keep]
    at = place[first]
    if kind.parts == 1:
        return doc[first], first, many, at, grams[at]
    size = -(-(kind.length - kind.gram + 1) // kind.parts)
    low, high = (at - first - many + 1) // size, (at - first) // size
    each = high - low + 1
    part = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first, many, at = (np.repeat(x, each) for x in (first, many, at))
    start = np.maximum(first, at - (part + 1) * size + 1)
    end = np.minimum(first + many, at - part * size + 1)
    cores = tokens.hashes(at - part * size, at - (part + 1) * size + 1 + kind.length)
    return doc[start], start, end - start, at, mix(cores + part.astype(U64))


def _anchor_rows(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            tokens = Tokens(Texts(batch.column(1)), kind)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, _, _, _, hashes = anchors(tokens, kind)
            if not len(doc):
                continue
            order = np.lexsort((hashes, doc))
            doc, hashes = doc[order], hashes[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
            count = np.diff(np.r_[first, len(doc)])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(ids[doc[first]]), pa.array(count.astype(np.int32))], names=["h", "doc_id", "n"])

    return run


def runs_of(batch: pa.RecordBatch, kind: Kind):
    """Runs of a sub-batch whose anchors are listed in ``keep``."""
    tokens = Tokens(Texts(batch.column("text")), kind)
    doc, first, many, place, hashes = anchors(tokens, kind)
    keep = batch.column("keep")
    own = np.repeat(np.arange(len(keep)), np.diff(keep.offsets.to_numpy()))
    kept = keep.flatten().to_numpy(zero_copy_only=False).view(U64)
    of = lambda h, d: mix(h + (d.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    good = np.isin(of(hashes, doc), of(kept, own))
    return tokens, *(x[good] for x in (doc, first, many, place, hashes))


_CONTEXTS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("context", pa.binary()), ("anchor", pa.int32()), ("places", pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int32())])))])
CONTEXTS = "h long, c long, context binary, anchor int, places array<struct<doc_id:long,first:int>>"


def _context_rows(kind: Kind):
    """Contexts and their places; equal ones within the task make one row."""

    def out(held: dict) -> pa.RecordBatch:
        h, c = zip(*held, strict=True) if held else ((), ())
        context, anchor, docs, first = zip(*held.values(), strict=True) if held else ((), (), (), ())
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum([len(x) for x in docs])].astype(np.int32)), pa.StructArray.from_arrays([pa.array([y for x in docs for y in x], pa.int64()), pa.array([y for x in first for y in x], pa.int32())], names=["doc_id", "first"])
        )
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(context, pa.binary()), pa.array(anchor, pa.int32()), lists], schema=_CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        size = 0
        for batch in sub_batches(batches, "text"):
            tokens, doc, first, many, place, hashes = runs_of(batch, kind)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            last = first + many + kind.length - 1
            codes = tokens.hashes(first, last, 1).view(np.int64)
            for h, c, a, b, p, i, f in zip(hashes.view(np.int64).tolist(), codes.tolist(), first.tolist(), last.tolist(), place.tolist(), ids.tolist(), (first - tokens.of[doc]).tolist(), strict=True):
                if (x := held.get((h, c))) is None:
                    held[h, c] = x = (tokens.bytes_of(a, b), p - a, [], [])
                    size += len(x[0])
                x[2].append(i)
                x[3].append(f)
                size += 16
            if size > HELD_BYTES:
                yield out(held)
                held, size = {}, 0
        yield out(held)

    return run


def _window_rows(kind: Kind):
    """Single windows of contexts, by two hashes of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens(Texts(batch.column("context")), kind)
            many = np.diff(tokens.of) - kind.length + 1
            row = np.repeat(np.arange(len(many)), many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = tokens.of[row] + k
            a, b = (tokens.hashes(start, start + kind.length, which).view(np.int64) for which in (0, 1))
            h, c, first_doc, n = (batch.column(x).to_numpy(zero_copy_only=False)[row] for x in ("h", "c", "first_doc", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, h, c, k.astype(np.int32), first_doc, n)], names=["a", "b", "h", "c", "k", "first_doc", "n"])

    return run


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted context rows, some at a time, anchors whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
        new = held and held[-1].column(0)[-1].as_py() != h[-1]
        if size > CHUNK_BYTES and (cut or new):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, size = [batch.slice(cut)], batch.slice(cut).nbytes
        else:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _final_rows(kind: Kind, texts: bool):
    """What each document keeps, from ``marks`` of repeated windows and ``copy``, whether its whole text is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            tokens = Tokens(Texts(batch.column("text")), kind)
            out: list[list] = [[], [], [], [], []]
            for i, (marks, copy) in enumerate(zip(batch.column("marks").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                low, n = int(tokens.of[i]), int(tokens.of[i + 1] - tokens.of[i])
                gone = np.zeros(n, bool)
                if copy and n >= kind.length:
                    gone[:] = True
                elif marks:
                    change = np.zeros(n + 1, np.int32)
                    starts = np.concatenate([m["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["mask"], np.uint8))) for m in marks])
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + kind.length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.r_[False, gone, False].astype(np.int8))
                spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                kept, at = [], 0
                for a, b in [*spans, (n, n)]:
                    if a > at:
                        kept.append(tokens.bytes_of(low + at, low + a))
                    at = b
                body = (b" " if kind.words else b"").join(kept)
                for column, value in zip(out, (int(gone.sum()), len(spans), hashlib.sha256(body).hexdigest(), body if texts else None, [{"start": a, "end": b} for a, b in spans] if texts else None), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(tokens.of)), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return run


def copies(rows: DataFrame) -> DataFrame:
    """``doc_id, first`` of all documents whose whole text another one has too; ``first`` is the least id with it."""
    coded = rows.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.sha2(F.col("text"), 256).alias("code"), F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"))
    several = coded.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("code", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return written(coded.join(several, ["code", "salt"]).select("doc_id", "first"))


def packed(flags: F.Column, kind: Kind) -> F.Column:
    """An array of flags, a run's first window first, as bits of a binary value."""
    octets = -(-(kind.length - kind.gram + 1) // 8)
    bits = F.rpad(F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), ""), octets * 8, "0")
    return F.unhex(F.concat(*(F.lpad(F.conv(F.substring(bits, i * 8 + 1, 8), 2, 16), 2, "0") for i in range(octets))))


def find(docs: DataFrame, kind: Kind, resolve: Callable, dealt: Callable[[DataFrame], DataFrame], texts: bool = True) -> DataFrame:
    """Per document: n_tokens, n_removed, n_spans, kept_sha256 and, if ``texts``, ``kept`` (binary) and ``spans``.
    ``resolve``: a task's function over distinct contexts sorted by anchor that gives (h, c, mask or earliest
    documents); ``dealt`` deals contexts to buckets, anchors whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = rows.where("doc_id IS NOT NULL")
    same = copies(rows)
    found = own.mapInArrow(_anchor_rows(kind), "h long, doc_id long, n int")
    repeated = "min(doc_id) < max(doc_id)" if kind.earlier else "sum(n) > 1"
    kept = written(found.groupBy("h").agg(F.expr(repeated).alias("again")).where("again").select("h"))
    release(spark)
    keep = found.select("h", "doc_id").join(kept, "h").groupBy("doc_id").agg(F.collect_list("h").alias("keep"))
    keep = keep.join(same.where("doc_id <> first").select("doc_id"), "doc_id", "left_anti")
    contexts = written(own.join(keep, "doc_id").select("doc_id", "text", "keep").mapInArrow(_context_rows(kind), CONTEXTS))
    del found, kept, keep
    release(spark)
    folded = contexts.select("h", "c", "context", "anchor", F.array_min(F.col("places.doc_id")).alias("first_doc"), F.size("places").alias("n"))
    whole = written(folded.groupBy("h", "c", "context", "anchor").agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n")))
    del folded
    release(spark)
    sizes = whole.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1")
    groups = whole.join(sizes, "h")
    form = "h long, c long, first_docs array<long>, mask binary"
    verdict = dealt(groups.where(F.col("m") <= GROUP)).sortWithinPartitions("h").select("h", "c", "context", "anchor", "first_doc", "n").mapInArrow(resolve, form)
    windows = groups.where(F.col("m") > GROUP).select("h", "c", "context", "first_doc", "n").mapInArrow(_window_rows(kind), "a long, b long, h long, c long, k int, first_doc long, n long")
    least = windows.groupBy("a", "b").agg(F.min("first_doc").alias("least"), F.sum("n").alias("total"))
    told = windows.select("a", "b", "h", "c", "k").join(least, ["a", "b"]).groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("k", "least", "total"))).alias("w"))
    if kind.earlier:
        told = told.select("h", "c", F.col("w.least").alias("first_docs"), F.lit(None).cast("binary").alias("mask"))
    else:
        again = F.transform("w.total", lambda x: x > 1)
        told = told.where(F.exists(again, lambda x: x)).select("h", "c", F.lit(None).cast("array<long>").alias("first_docs"), packed(again, kind).alias("mask"))
    verdict = written(verdict.unionByName(told))
    del groups, windows, least, told, whole
    release(spark)
    marks = contexts.select("h", "c", F.explode("places").alias("place")).select("h", "c", "place.*").join(verdict, ["h", "c"])
    if kind.earlier:
        marks = marks.where(F.array_min("first_docs") < F.col("doc_id")).withColumn("mask", packed(F.transform("first_docs", lambda x: x < F.col("doc_id")), kind))
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    gone = same.select("doc_id", (F.col("doc_id") > F.col("first")).alias("copy")) if kind.earlier else same.select("doc_id", F.lit(True).alias("copy"))
    told = marks.join(gone, "doc_id", "full")
    done = rows.join(told, "doc_id", "left").select("doc_id", "text", "marks", "copy")
    done = done.mapInArrow(_final_rows(kind, texts), "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")
    return done if texts else done.drop("kept", "spans")
