"""Profiling invariants on payload literals: empty, one byte, short, constant, random."""

import math

import numpy as np
import pytest

from paylume.functions import arrow_profile, payload
from paylume.operators import corpus, evaluation, relational, selection

RNG = np.random.default_rng(1)
PAYLOADS = {"empty": b"", "one": b"\xff", "four": b"abcd", "eight": bytes(range(8)), "constant": b"\x2a" * 500, "random": RNG.integers(0, 256, 4096, dtype=np.uint8).tobytes(), "null": None}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in PAYLOADS.items()], "id string, payload binary")


def by_id(rows):
    return {r["id"]: r for r in rows.collect()}


def test_histogram(df):
    got = by_id(payload.histogram(df))
    assert sum(got["random"][1:]) == pytest.approx(1)
    assert sum(got["empty"][1:]) == 0 == sum(got["null"][1:])
    assert got["one"]["byte_hist_255"] == 1 and got["constant"]["byte_hist_042"] == 1


def test_counts(df):
    got = by_id(payload.count_profile(df))
    assert len(got) == len(PAYLOADS)
    assert got["constant"]["entropy"] == 0 == got["empty"]["entropy"] == got["null"]["entropy"]
    assert got["random"]["entropy"] > 7.9 and math.isnan(got["eight"]["chi2"]) and got["constant"]["ic"] == 1


def test_short_payloads_have_no_grams(df):
    got = by_id(payload.gram_profile(df, 2))
    assert math.isnan(got["one"]["entropy"]) and got["constant"]["distinct"] == 1 and got["constant"]["chi2"] == 0


def test_autocorrelation(df):
    got = by_id(payload.autocorrelation(df, [1, 4, 16]))
    assert got["constant"]["acf_1"] == 1 and math.isnan(got["four"]["acf_4"]) and abs(got["random"]["acf_1"]) < 0.1


def test_runs(df):
    got = by_id(payload.runs(df))
    assert got["constant"]["runs_count"] == 1 and math.isnan(got["constant"]["runs_z"]) and math.isnan(got["one"]["runs_count"])


def test_blocks(df):
    got = by_id(payload.block_repetition(df))
    assert got["constant"]["rate"] == 1 and got["random"]["rate"] == 0 == got["null"]["rate"]


def test_arrow_features_agree_with_native(df):
    names = arrow_profile.feature_names()
    assert len(names) == 307
    wide = by_id(arrow_profile.feature_table(df))
    native = by_id(payload.autocorrelation(df, [1, 16]))
    runs, grams = by_id(payload.runs(df)), by_id(payload.gram_profile(df, 3))
    for k in ("constant", "random", "four"):
        for a, b in ((wide[k]["autocorr_lag_01"], native[k]["acf_1"]), (wide[k]["autocorr_lag_16"], native[k]["acf_16"]), (wide[k]["runs_zscore"], runs[k]["runs_z"]), (wide[k]["ngram_3_entropy"], grams[k]["entropy"])):
            assert a == pytest.approx(b, abs=1e-6, nan_ok=True)
    assert "payload" not in wide["random"].asDict()
    assert math.isnan(wide["four"]["fft_peak_freq"]) and sum(wide["random"][f"fft_band_{i}"] for i in range(8)) == pytest.approx(1)
    with pytest.raises(ValueError):
        arrow_profile.feature_names(["absent"])


def test_phrases():
    assert [arrow_profile.phrase_count(x) for x in (b"", b"\0", b"\0" * 100)] == [0, 1, 2]


def plain_phrases(data):
    """Grows each phrase byte by byte."""
    start = phrases = 0
    while start < len(data):
        end = start + 1
        while end <= len(data) and data[start:end] in data[: end - 1]:
            end += 1
        start, phrases = end, phrases + 1
    return phrases


def test_phrases_are_those_of_the_plain_parsing():
    for i in range(300):
        data = bytes(RNG.integers(0, 2 + i % 4, i % 90, dtype=np.uint8))
        assert arrow_profile.phrase_count(data) == plain_phrases(data)


def test_spectrum_is_that_of_the_plain_transform():
    for n in (8, 9, 31, 64, 100):
        data = RNG.integers(0, 256, n).astype(np.uint8)
        power = []
        for k in range(1, n // 2 + 1):
            angle = -2j * np.pi * k * np.arange(n) / n
            power.append(abs((data * np.exp(angle)).sum()) ** 2)
        m = len(power)
        bands = [sum(power[i * m // 8 : (i + 1) * m // 8]) / sum(power) for i in range(8)]
        entropy = -sum(b * math.log2(b) for b in bands if b > 0)
        assert arrow_profile.spectrum(data) == pytest.approx([*bands, power.index(max(power)) / m, entropy])


def test_single_statistics(df):
    import bz2
    import zlib

    got = by_id(arrow_profile.profile(df, ["complexity", "compression", "autocorrelation", "runs"]))
    native, runs = by_id(payload.autocorrelation(df, [1, 5, 16])), by_id(payload.runs(df))
    for k, v in PAYLOADS.items():
        if v:
            assert got[k]["lz_complexity"] == plain_phrases(v) and got[k]["lz_complexity_normalized"] == plain_phrases(v) / len(v)
            assert (got[k]["compression_ratio_zlib"], got[k]["compression_ratio_bz2"]) == (len(zlib.compress(v, 9)) / len(v), len(bz2.compress(v, 9)) / len(v))
        for a, b in (("autocorr_lag_01", "acf_1"), ("autocorr_lag_05", "acf_5"), ("autocorr_lag_16", "acf_16")):
            assert got[k][a] == pytest.approx(native[k][b], abs=1e-9, nan_ok=True)
        assert got[k]["runs_count"] == pytest.approx(runs[k]["runs_count"], nan_ok=True) and got[k]["runs_zscore"] == pytest.approx(runs[k]["runs_z"], abs=1e-9, nan_ok=True)


def test_arrow_statistics_are_the_native_ones(df):
    got = by_id(arrow_profile.profile(df, ["counts", "blocks", "plain_lag"]))
    counts, blocks, lag = by_id(payload.count_profile(df)), by_id(payload.block_repetition(df)), by_id(payload.plain_autocorrelation(df, 4))
    for k in PAYLOADS:
        for name, native in (("entropy", counts), ("chi2", counts), ("ic", counts), ("rate", blocks), ("acf", lag)):
            assert got[k][name] == pytest.approx(native[k][name], abs=1e-9, nan_ok=True), (k, name)


def test_chi2_tail_is_the_area_of_the_density():
    for x, dof in ((200.0, 255), (255.0, 255), (310.0, 255), (9.0, 5)):
        t = np.linspace(x, x + 600, 600_001)
        density = np.exp((dof / 2 - 1) * np.log(t) - t / 2 - dof / 2 * math.log(2) - math.lgamma(dof / 2))
        assert arrow_profile.chi2_tail(x, dof) == pytest.approx(float(np.trapezoid(density, t)), abs=1e-6)


def test_softmax_of_one_score(spark):
    rows = spark.createDataFrame([(1, [2.0]), (2, [1.0, 1.0, 1.0]), (3, [1000.0, 0.0])], "k int, v array<double>")
    got = {r["k"]: r["p"] for r in relational.softmax(rows, "v", "p").collect()}
    assert got[1] == pytest.approx([1 / (1 + math.exp(4)), 1 / (1 + math.exp(-4))]) and got[2] == pytest.approx([1 / 3] * 3) and got[3] == [1, 0]


def test_bootstrap_is_that_of_drawn_rows(spark):
    """The intervals from draws over cells agree with those from draws over rows."""
    true, pred = RNG.integers(0, 3, 600), RNG.integers(0, 3, 600)
    pred[:400] = true[:400]
    rows = spark.createDataFrame([("m", int(a), int(b)) for a, b in zip(true, pred, strict=True)], "model string, y_true int, y_pred int")
    got = evaluation.bootstrap(evaluation.confusion(rows, "model")).first()
    f1s, recalls = [], []
    for _ in range(1000):
        i = RNG.integers(0, 600, 600)
        cells = [(((true[i] == k) & (pred[i] == k)).sum(), (true[i] == k).sum(), (pred[i] == k).sum()) for k in range(3)]
        f1s.append(np.mean([2 * tp / (t + p) for tp, t, p in cells]))
        recalls.append(np.mean([tp / t for tp, t, _ in cells]))
    want = [*np.percentile(f1s, [2.5, 97.5]), *np.percentile(recalls, [2.5, 97.5])]
    assert [got["f1_low"], got["f1_high"], got["balanced_low"], got["balanced_high"]] == pytest.approx(want, abs=0.012)


def test_grid_search_takes_the_plain_mean_over_classes(spark):
    from paylume.operators import models

    found = spark.createDataFrame([("m", y, p) for y, p in [(0, 0)] * 90 + [(1, 0)] * 10], "model string, y_true int, y_pred int")
    assert models.scores(found, "model").first()["f1_macro"] == pytest.approx(2 * 90 / 190 / 2, abs=1e-4)


def test_chi2_tail():
    for x in (0.5, 3.0, 40.0):
        assert arrow_profile.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2))
        assert arrow_profile.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
    assert arrow_profile.chi2_tail(293.2478, 255) == pytest.approx(0.05, abs=1e-5)


def test_xor_known_values(spark):
    one = spark.createDataFrame([(bytearray(12), bytearray(b"ABC\x01")), (bytearray(12), bytearray(b"ABC\x81"))], "raw binary, key binary")
    got = [bytes.fromhex(r[0]) for r in one.select(corpus.xor_repeating(one.raw, one.key)).collect()]
    assert got == [b"ABC\x01" * 3] * 2


def test_guards(spark):
    with pytest.raises(ValueError):
        relational.check_no_leakage(["a", "len_ct"])
    with pytest.raises(ValueError):
        payload.fixed_grid("payload", 0)


def test_record_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Count = 1\r\nKey = 00FF\r\nNonce = 01\r\nPT = \r\nAD = \r\nCT = AA\r\n\r\nCount = 2\nNonce = 01\nCT = BB\n\n\nCount = 3\nKey = 01\nNonce = 02\nPT = 0A\nAD =\nCT = CC")
    got = corpus.record_blocks(spark, str(tmp_path)).orderBy("count").collect()
    assert [r["count"] for r in got] == [1, 2, 3]
    assert [r["bad"] is None for r in got] == [True, False, True]
    assert bytes(got[0]["pt"]) == b"" and bytes(got[2]["pt"]) == b"\n" and bytes(got[0]["key"]) == b"\x00\xff"


def test_mcnemar_without_discordance(spark):
    got = evaluation.mcnemar(spark.createDataFrame([(True, True), (False, False)], "a boolean, b boolean")).first()
    assert got["statistic"] == 0 and got["p_value"] == 1


def test_calibration_extremes(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "conf double, right double")
    assert evaluation.ece(rows).first()["ece"] == 0
    assert evaluation.ece(rows.selectExpr("conf", "0D AS right")).first()["ece"] > 0.8


def test_shadows_keep_each_column(spark):
    df = spark.range(50).selectExpr("id AS k", "CAST(id AS DOUBLE) AS a", "CAST(id * id AS DOUBLE) AS b")
    got = selection.shadow_table(df, ["a", "b"], "k", 0).collect()
    assert sorted(r["shadow_a"] for r in got) == [float(i) for i in range(50)]
    assert all(r["shadow_b"] == r["shadow_a"] ** 2 for r in got) and any(r["shadow_a"] != r["a"] for r in got)


def test_selector_errors(spark):
    with pytest.raises(ValueError):
        selection.Selector().transform(spark.range(1))


def test_profile_on_a_stream(spark, tmp_path):
    from paylume.streaming import profiled_stream

    spark.createDataFrame([("a", bytearray(b"abcabc")), ("b", bytearray())], "id string, payload binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, payload binary").parquet(str(tmp_path / "in"))
    q = profiled_stream(stream).writeStream.format("memory").queryName("profiled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["n"] for r in spark.table("profiled").collect()} == {"a": 6, "b": 0}
