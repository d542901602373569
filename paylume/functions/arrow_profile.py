"""Payload statistics in one Arrow pass: single ones by name, and the full feature table of 307 columns. Undefined
statistics are NaN. The kernels of :mod:`.batch` are row-local, so that a pass runs on tables and on streams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch
from .batch import BANDS, Payloads, spectrum  # noqa: F401

NAN = float("nan")
FAMILIES = ["histogram", "entropy", "ngrams", "autocorrelation", "complexity", "frequency"]


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution."""
    return float(batch.chi2_tails(np.array([x], float), dof)[0])


def with_pvalue(df: DataFrame, column: str, dof: int) -> DataFrame:
    """Adds ``p_value``, worked out on the aggregated rows only."""

    @F.pandas_udf("double")
    def tail(x):
        return x.__class__(batch.chi2_tails(x.to_numpy(float), dof), index=x.index)

    return df.withColumn("p_value", tail(F.coalesce(F.col(column), F.lit(NAN))))


def phrase_count(data: bytes) -> int:
    """Phrases of one payload."""
    return int(batch.phrase_counts(Payloads.of(data))[0])


#: Column names by family (fixed values).
NAMES = {
    "histogram": [f"byte_hist_{i:03d}" for i in range(256)],
    "entropy": ["shannon_entropy", "chi2_statistic", "chi2_dof", "chi2_pvalue"],
    "ngrams": [f"ngram_{g}_{s}" for g in (2, 3, 4) for s in ("entropy", "nunique", "max_freq", "chi2", "collision_rate")],
    "autocorrelation": [*(f"autocorr_lag_{k:02d}" for k in range(1, 17)), "runs_count", "runs_zscore"],
    "complexity": ["lz_complexity", "lz_complexity_normalized", "compression_ratio_zlib", "compression_ratio_bz2"],
    "frequency": [*(f"fft_band_{i}" for i in range(BANDS)), "fft_peak_freq", "fft_spectral_entropy"],
}


def feature_names(families: list[str] | None = None) -> list[str]:
    """Columns in the fixed order of the families."""
    chosen = FAMILIES if families is None else families
    if unknown := set(chosen) - set(FAMILIES):
        raise ValueError(f"unknown families: {sorted(unknown)}")
    return [n for f in FAMILIES if f in chosen for n in NAMES[f]]


def _complexity(p: Payloads) -> np.ndarray:
    found = np.concatenate([batch.phrases(p), batch.ratios(p)], axis=1)
    found[p.n == 0] = NAN
    return found


Kernel = Callable[[Payloads], np.ndarray]
#: Kernels of the families, by the order of their columns in ``NAMES``.
KERNELS: dict[str, list[Kernel]] = {
    "histogram": [batch.histogram],
    "entropy": [batch.uniformity],
    "ngrams": [lambda p: batch.grams(p, 2), lambda p: batch.grams(p, 3), lambda p: batch.grams(p, 4)],
    "autocorrelation": [batch.lag_correlations, batch.runs_test],
    "complexity": [_complexity],
    "frequency": [batch.spectra],
}

#: Single statistics by name: their columns and kernel.
PARTS: dict[str, tuple[list[str], Kernel]] = {
    "histogram": (NAMES["histogram"], batch.histogram),
    "uniformity": (NAMES["entropy"], batch.uniformity),
    **{f"ngrams_{g}": (NAMES["ngrams"][5 * i : 5 * i + 5], lambda p, g=g: batch.grams(p, g)) for i, g in enumerate((2, 3, 4))},
    "complexity": (NAMES["complexity"][:2], batch.phrases),
    "compression": (NAMES["complexity"][2:], batch.ratios),
    "zlib": (NAMES["complexity"][2:3], lambda p: batch.ratios(p, zlib.compress)),
    "frequency": (NAMES["frequency"], batch.spectra),
    "autocorrelation": (NAMES["autocorrelation"][:16], batch.lag_correlations),
    "runs": (NAMES["autocorrelation"][16:], batch.runs_test),
    "counts": (["entropy", "chi2", "ic"], batch.count_statistics),
    "blocks": (["rate"], batch.block_rate),
    "plain_lag": (["acf"], batch.plain_lag),
}


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores, such as one small file, is dealt out before long work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _pass(df: DataFrame, keep: list[str], names: list[str], kernels: list[Kernel]) -> DataFrame:
    """The kept columns and the kernels' columns of each row's payload; a table's batches, or a stream's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in batch.slices(whole, len(keep)) if whole.num_rows else ():
                p = Payloads(part.column(len(keep)))
                matrix = np.concatenate([k(p) for k in kernels], axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(c)) for c in matrix.T)], names=[*keep, *names])

    kinds = dict(df.dtypes)
    return spread(df.select(*keep, "payload")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} double" for n in names)]))


def feature_table(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Metadata and features of each payload, in one Arrow pass; the payload itself is dropped."""
    names, chosen = feature_names(families), [f for f in FAMILIES if families is None or f in families]
    return _pass(df, [c for c in df.columns if c != "payload"], names, [k for f in chosen for k in KERNELS[f]])


def profile(df: DataFrame, parts: list[str], *keep: str) -> DataFrame:
    """Single statistics by id in one Arrow pass, see ``PARTS``; other columns may be kept."""
    return _pass(df, ["id", *keep], [n for p in parts for n in PARTS[p][0]], [PARTS[p][1] for p in parts])


def bigrams(df: DataFrame) -> DataFrame:
    """``id, b1, b2, freq``: the pairs of bytes that occur in a payload, and their share of its pairs, in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in batch.slices(whole, 1) if whole.num_rows else ():
                row, pair, freq = batch.pair_shares(Payloads(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array((pair >> 8).astype(np.int32)), pa.array((pair & 255).astype(np.int32)), pa.array(freq)], names=["id", "b1", "b2", "freq"])

    return spread(df.select("id", "payload")).mapInArrow(run, f"id {dict(df.dtypes)['id']}, b1 int, b2 int, freq double")


def xor_digests(df: DataFrame) -> DataFrame:
    """``id, hexed_md5, opens`` of rows of ``id, payload, key``: md5 of the hexadecimal text of the payload XORed with the
    repeating key, and whether the key gives the payload back; null for a null payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in batch.slices(whole, 1) if whole.num_rows else ():
                digests, opens = batch.xor_digests(Payloads(part.column(1)), part.column(2))
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.string(), mask=null), pa.array(opens, pa.bool_(), mask=null)], names=["id", "hexed_md5", "opens"])

    return spread(df.select("id", "payload", "key")).mapInArrow(run, f"id {dict(df.dtypes)['id']}, hexed_md5 string, opens boolean")
