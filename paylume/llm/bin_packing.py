"""Best-fit packing of whole documents with Martello-Toth dominance reduction.

A document of at most ``size`` tokens is one piece; a longer one is cut into pieces of ``size`` tokens, of which the first
may be shorter. Pieces of equal length are interchangeable, so that an instance of any number of documents is a count for
each length, at most ``size`` numbers, which the driver solves:

1. Reduction. A set F of pieces that fit in one sequence with piece ``j`` dominates another feasible set with ``j`` if the
   latter's pieces can be dealt to F's so that each deal is no longer than its piece. A set that dominates all others is
   fixed for good, as often as there are such pieces: ``j`` alone, where nothing fits with it; ``j`` and the longest piece
   that fits, where no other pieces that fit together with ``j`` sum up to more (a perfect fit, for one); ``j``, the
   longest that fits and the longest that fits with both, where at most two fit. The rest is a smaller instance, which is
   tried again.
2. Best fit, longest pieces first, of what remains; sequences with equal contents are kept as one pattern with its number.

The solution says for each length which ranks among its pieces go where. Ranks are numbers within a task and a length, to
which the counts of the tasks before are added, so that no length is gathered in one place: what is written is one
narrow row a piece, what is shuffled are counts and these rows, and what the tasks get from the driver is bounded by
``size`` alone (at most 4 * ``size`` patterns of fewer than sqrt(2 * ``size``) lengths).

Null texts count as empty; an empty text still has its end token. Documents with a null or repeated id are packed as often
as they occur. Very long texts are encoded whole and cut. Columns other than the id and the text are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokens import token_ids

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("rank", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"
Pattern = tuple[int, list[tuple[int, int]]]


class Instance:
    """How many pieces there are of each length, and what has been fixed."""

    def __init__(self, count: dict[int, int], size: int):
        if any(not 0 < s <= size for s in count):
            raise ValueError("a piece is longer than a sequence or empty")
        self.size, self.left = size, {s: n for s, n in count.items() if n}
        self.fixed: list[Pattern] = []

    def fix(self, *pieces: int) -> None:
        """Fixes a set of lengths as often as they are there."""
        need = {s: pieces.count(s) for s in pieces}
        times = min(self.left[s] // k for s, k in need.items())
        for s, k in need.items():
            self.left[s] -= k * times
            if not self.left[s]:
                del self.left[s]
        self.fixed.append((times, sorted(need.items(), reverse=True)))

    def others(self, *pieces: int) -> dict[int, int]:
        """Counts without one of each of these pieces."""
        rest = dict(self.left)
        for s in pieces:
            rest[s] -= 1
        return {s: n for s, n in rest.items() if n > 0}

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """A set with a piece of length ``j`` that dominates all feasible ones, if one of at most three is found."""
        room, rest = self.size - j, self.others(j)
        fit = sorted(s for s in rest if s <= room)
        if not fit:
            return (j,)
        k = fit[-1]
        if k == room or heaviest(rest, room) == k:
            return j, k
        smallest = [s for s in fit for _ in range(min(rest[s], 3))][:3]
        if len(smallest) == 3 and sum(smallest) <= room:
            return None
        both = [s for s in self.others(j, k) if s <= room - k]
        third = max(both, default=0)
        for x in fit:
            y = max((s for s in fit if s <= min(x, room - x) and (s < x or rest[s] > 1)), default=0)
            if y > third and x + y > k:
                return None
        return (j, k, third) if third else (j, k)

    def reduce(self) -> None:
        """Fixes dominating sets until there is none."""
        found = True
        while found:
            found = False
            for j in sorted(self.left, reverse=True):
                while j in self.left and (best := self.dominating(j)):
                    self.fix(*best)
                    found = True

    def best_fit(self) -> list[Pattern]:
        """Packs what is left, longest first, each piece where the least room remains; equal sequences are one pattern."""
        open_: dict[int, list[Pattern]] = {}
        closed: list[Pattern] = []

        def put(times: int, content: list[tuple[int, int]], room: int) -> None:
            if times:
                (open_.setdefault(room, []) if room else closed).append((times, content))

        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            for room in sorted(r for r in open_ if r >= s):
                each = room // s
                for times, content in open_.pop(room):
                    full = min(times, n // each)
                    put(full, [*content, (s, each)], room - each * s)
                    n -= full * each
                    some = n if full < times else 0
                    if some:
                        put(1, [*content, (s, some)], room - some * s)
                        n = 0
                    put(times - full - (some > 0), content, room)
            each = self.size // s
            put(n // each, [(s, each)], self.size - each * s)
            put(int(n % each > 0), [(s, n % each)], self.size - n % each * s)
        self.left = {}
        return closed + [p for room in sorted(open_) for p in open_[room]]


def heaviest(count: dict[int, int], room: int) -> int:
    """The largest sum of pieces within the room, by a set of sums held as bits."""
    reach, mask = 1, (1 << room + 1) - 1
    for s, n in count.items():
        n, step = min(n, room // s), 1
        while n > 0:
            step = min(step, n)
            reach |= reach << s * step & mask
            n -= step
            step *= 2
    return reach.bit_length() - 1


def solve(count: dict[int, int], size: int) -> list[Pattern]:
    """Patterns, each with its number, that hold all pieces."""
    instance = Instance(count, size)
    instance.reduce()
    return instance.fixed + instance.best_fit()


def runs(patterns: list[Pattern], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks of the runs, and for each run its first sequence, pieces a sequence and their offset."""
    out: dict[int, list[list[int]]] = {}
    next_rank, sequence = [0] * (size + 1), 0
    for times, content in patterns:
        offset = 0
        for s, each in content:
            out.setdefault(s, []).append([next_rank[s], sequence, each, offset])
            next_rank[s] += times * each
            offset += s * each
        sequence += times
    return {s: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for s, rows in out.items()}


def _piece_rows(path: str, size: int, end_id: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = token_ids(path), TaskContext.get().partitionId()
        end, seen, rows = np.array([end_id], "<u4").tobytes(), [0] * (size + 1), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.text(text.as_py() or "") + end
                total = len(raw) // 4
                first = total % size or size
                for piece, start in enumerate([0, *range(first, total, size)]):
                    length = size if piece else first
                    part_ids = raw[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part_ids), part_ids if ids else None, part, seen[length]))
                    seen[length] += 1
            if len(rows) >= 8192:
                yield _batch(rows, _PIECES)
                rows = []
        yield _batch(rows, _PIECES)

    return run


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _placed(where: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, length[order][1:] != length[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            for some in np.split(order, cuts[1:]) if len(order) else []:
                s = int(length[some[0]])
                first, begin, each, at = where[s]
                run_ = np.searchsorted(first, rank[some], "right") - 1
                within = rank[some] - first[run_]
                sequence[some] = begin[run_] + within // each[run_]
                offset[some] = at[run_] + within % each[run_] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if ``ids``, its ``ids`` as
    little-endian 32-bit bytes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = rows.mapInArrow(_piece_rows(tokenizer_path, size, end_id, ids), PIECES)
    pieces = written(pieces if ids else pieces.drop("ids"))
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    # one row a length, so at most ``size``
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ranked = pieces.join(offsets, ["part", "length"]).select(*kept, (F.col("rank") + F.col("before")).alias("rank"))
    types = dict(ranked.dtypes)
    return ranked.mapInArrow(_placed(runs(solve(total, size), size)), ", ".join([*(f"{c} {types[c]}" for c in kept), "sequence_id long", "offset long"]))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all of ``documents`` whole into sequences of 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
