"""Periodic runs of words by Kruskal's algorithm over suffix classes, longest common prefixes first.

The suffixes of a text, sorted, are the nodes of a path whose edges weigh what neighbours have in common (their LCP). Edges
are taken by descending weight; union-find joins the classes at both ends, and each class keeps its places in the text
in order, the smaller class going into the larger. When an edge of weight L joins two classes, any place of one and any
of the other have exactly L words in common, and two of them that become neighbours at a distance d <= L seed a run: the
text repeats itself with period d from the first place on, for d + L words and no word longer. No shorter period holds
there, since a place between the two would have joined the class before. The seeds with one period and one end belong
to one run, whose start is the least of their places.

A run of at least ``least`` words and ``times`` periods has seeds of weight at least ``least - least // times``: lighter
edges are left out, and so are texts in which no gram of so many words occurs twice, which is told first for a batch of
texts at once. Words are compared by their bytes. A task handles some texts at once and nothing is shuffled; memory is
bounded by the longest text and grows with its words times the logarithm of their number.

Null and empty texts have no words and no runs. Documents with a null or repeated id are handled row by row. Columns other
than the id and the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import prefix_sums, range_hash, sub_batches

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, n_dropped long, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def repeating(codes: np.ndarray, of: np.ndarray, gram: int) -> np.ndarray:
    """Numbers of the texts in which a gram of so many words may occur twice (told by hashes, so that none is missed)."""
    at = np.arange(max(len(codes) - gram + 1, 0))
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    at = at[doc[at] == doc[at + gram - 1]]
    if not len(at):
        return np.zeros(0, np.int64)
    hashes = range_hash(prefix_sums(codes.astype(np.uint64) + np.uint64(1), 0), at, at + gram, 0) ^ doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(hashes)
    again = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    return np.unique(doc[at[order[again]]])


def suffix_neighbours(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of all texts together, text by text, and what each has in common with the one before it (-1 where a
    text begins). Prefixes are doubled; the ranks of every step tell common prefixes afterwards."""
    n = len(codes)
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    end = of[1:][doc]
    rank = np.unique(doc * np.int64(int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while int(rank.max(initial=-1)) + 1 < n:
        after = np.arange(n) + step
        key = rank * np.int64(n + 1) + np.where(after < end, rank[np.minimum(after, n - 1)] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        equal = inside & (levels[i][np.minimum(x, n - 1)] == levels[i][np.minimum(y, n - 1)])
        common += equal * np.int64(1 << i)
    common[doc[a] != doc[b]] = -1
    return order, np.r_[np.full(min(n, 1), -1), common]


def seeds(order: np.ndarray, common: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """``(period, end): start`` of all runs of at least ``least`` words and ``times`` periods."""
    found: dict[tuple[int, int], int] = {}
    heavy = np.flatnonzero(common >= max(1, least - least // times))
    heavy = heavy[np.argsort(-common[heavy], kind="stable")]
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def seed(first: int, second: int, weight: int) -> None:
        period = second - first
        if period * (times - 1) <= weight and period + weight >= least:
            key = period, second + weight
            found[key] = min(first, found.get(key, first))

    for x, y, weight in zip(order[heavy - 1].tolist(), order[heavy].tolist(), common[heavy].tolist(), strict=True):
        x, y = root(x), root(y)
        many, few = places.pop(x, [x]), places.pop(y, [y])
        if len(many) < len(few):
            x, y, many, few = y, x, few, many
        parent[y] = x
        last = len(few) - 1
        for k, place in enumerate(few):
            i = bisect(many, place)
            if i and (k == 0 or few[k - 1] < many[i - 1]):
                seed(many[i - 1], place, weight)
            if i < len(many) and (k == last or many[i] < few[k + 1]):
                seed(place, many[i], weight)
        if len(few) < 8:
            for place in few:
                insort(many, place)
        else:
            many += few
            many.sort()
        places[x] = many
    return found


def runs_of(codes: np.ndarray, of: np.ndarray, least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), sorted by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(of) - 1)]
    some = repeating(codes, of, max(1, least - least // times))
    if not len(some):
        return out
    sizes = np.diff(of)[some]
    inner = np.r_[0, np.cumsum(sizes)]
    at = np.arange(inner[-1]) - np.repeat(inner[:-1] - of[some], sizes)
    for (period, end), start in seeds(*suffix_neighbours(codes[at], inner), least, times).items():
        text = int(np.searchsorted(inner, start, "right")) - 1
        out[some[text]].append((start - int(inner[text]), end - start, period))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def _rows(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            # white space of bytes is the six ASCII characters that part words
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            of = np.r_[0, np.cumsum([len(w) for w in words])]
            codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            found = runs_of(codes, of, least, times)
            dropped, collapsed = [], []
            for w, own in zip(words, found, strict=True):
                change = np.zeros(len(w) + 1, np.int64)
                for start, length, period in own:
                    change[start + period] += 1
                    change[start + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                dropped.append(int(gone.sum()))
                collapsed.append((b" ".join(w) if not own else b" ".join([w[i] for i in np.flatnonzero(~gone).tolist()])).decode())
            flat = [r for own in found for r in own]
            columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(_RUN.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(of)), lists, pa.array(dropped, pa.int64()), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "n_dropped", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per document: n_words, ``runs`` of at least ``least`` words and ``times`` smallest periods that no neighbouring word
    extends, sorted by start and period, n_dropped, and ``collapsed``, the words less those that a run holds after its
    first period, joined by one space."""
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rows(least, times), SCHEMA)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text, or for one in ten documents by the checksum of its id, its words with a period from some word on."""
    h = F.crc32(doc_id.cast("string"))
    g, words = F.floor(h / 10), F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.coalesce(F.size(words), F.lit(0))
    first = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int")))
    planted = F.slice(F.concat(F.slice(words, F.lit(1), first), again), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, one in ten of which is made periodic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs.select("doc_id", with_planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    # a larger exponent first, by cross multiplication, then the smaller start, then the smaller period
    cross = lambda a, b: b["length"].cast("decimal(19,0)") * a["period"].cast("decimal(19,0)") - a["length"].cast("decimal(19,0)") * b["period"].cast("decimal(19,0)")
    best = F.get(F.array_sort("runs", lambda a, b: F.coalesce(F.nullif(F.signum(cross(a, b)), F.lit(0.0)), F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["period"] - b["period"])).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
