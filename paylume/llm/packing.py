"""Harmonic packing of tokenised documents into fixed-size sequences.

A document gives whole sequences first. What remains of it, ``r`` tokens, is of class ``k`` where it is over
``size / (k + 1)`` and at most ``size / k`` tokens, and a bin of class ``k`` takes exactly ``k`` such remainders, uncut:
the number of documents in a bin is fixed, and it is over ``k / (k + 1)`` full. The gap that is left is filled from the
last class, the remainders of at most ``size / last_class`` tokens, which are cut where a gap ends. If there are too few
of these, so that ``last_class`` bins wait, the next remainder of any class is cut to fill them. Each task packs its own
rows: it holds one open bin of a class and the waiting ones, nothing is shuffled, and sequence ids are built from the
partition number. At the end of a task the open bins are merged into full sequences; what then remains is cut at powers
of two, which need no padding.

Null texts count as empty; an empty text still yields its end token. Repeated rows are packed as often as they occur.
Columns other than the id and the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import token_ids

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Bits of a sequence id that count within a partition.
LOCAL_BITS = 40


def split(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
    """The first ``n`` tokens of a piece, and the rest if there is any."""
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total) if len(ids) > 4 * n else None


class Bins:
    """Open bins of one task by class, and those that wait for a filling, with their room."""

    def __init__(self, size: int, last_class: int, base: int):
        self.size, self.last_class, self.next = size, last_class, base
        self.open: dict[int, list] = {}
        self.waiting: deque[list] = deque()

    def close(self, pieces: list) -> list:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1
        return out

    def add(self, doc: int, ids: bytes) -> list:
        piece, out = (doc, 0, ids, len(ids) // 4), []
        while piece and len(piece[2]) >= 4 * self.size:
            head, piece = split(piece, self.size)
            out += self.close([head])
        if piece and (len(piece[2]) // 4 * self.last_class <= self.size or len(self.waiting) >= self.last_class):
            filled, piece = self.fill(piece)
            out += filled
        return out + self.place(piece) if piece else out

    def fill(self, piece: tuple | None) -> tuple[list, tuple | None]:
        """Cuts a piece into the waiting bins; what closes, and the rest."""
        out = []
        while piece and self.waiting:
            pieces, room = self.waiting.popleft()
            head, piece = split(piece, room)
            room -= len(head[2]) // 4
            if room:
                self.waiting.appendleft([[*pieces, head], room])
            else:
                out += self.close([*pieces, head])
        return out, piece

    def place(self, piece: tuple) -> list:
        n = len(piece[2]) // 4
        k = self.size // n
        if k >= self.last_class:
            self.waiting.append([[piece], self.size - n])
            return []
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) < k:
            return []
        room = self.size - sum(len(p[2]) // 4 for p in self.open.pop(k))
        if not room:
            return self.close(own)
        self.waiting.append([own, room])
        return []

    def finish(self) -> list:
        """Merges what is open into full sequences, then into power-of-two ones."""
        left = deque(p for pieces in (*(x for x, _ in self.waiting), *(self.open[k] for k in sorted(self.open))) for p in pieces)
        tokens, out = sum(len(p[2]) // 4 for p in left), []
        for n in [self.size] * (tokens // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if tokens % self.size >> b & 1]:
            taken = []
            while n:
                head, rest = split(left.popleft(), n)
                taken.append(head)
                n -= len(head[2]) // 4
                if rest:
                    left.appendleft(rest)
            out += self.close(taken)
        return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, last_class: int = 64) -> DataFrame:
    """Pieces of all documents with their place: one row per piece, ``ids`` as little-endian 32-bit bytes."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer_path)
        bins = Bins(size, last_class, TaskContext.get().partitionId() << LOCAL_BITS)
        end = np.array([end_id], "<u4").tobytes()
        rows = []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                rows += bins.add(doc.as_py(), encoder.text(text.as_py() or "") + end)
                if len(rows) >= 4000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows + bins.finish())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def op5_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all of ``documents`` and reports each piece with a checksum of its ids."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
