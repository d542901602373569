"""Streams against tables, file scans, stage records and the incremental store."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylume import streaming
from paylume.functions import arrow_profile, batch, payload
from paylume.operators import audits, corpus

from .test_payload import PAYLOADS, plain_phrases

SCHEMA = "id string, payload binary, tag string"


@pytest.fixture(scope="module")
def rows(spark):
    return [(f"{k}{i}", None if v is None else bytearray(v), "t") for i in range(2) for k, v in PAYLOADS.items()]


@pytest.fixture(scope="module")
def arriving(spark, rows, tmp_path_factory):
    """A stream of two files."""
    path = str(tmp_path_factory.mktemp("in"))
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def same(a, b):
    plain = lambda df: sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert plain(a) == plain(b) != []


@pytest.mark.parametrize("families", [["histogram"], ["entropy"], ["ngrams"], ["autocorrelation"], ["complexity"], ["frequency"], None])
def test_feature_streams_equal_tables(arriving, families):
    stream, table = arriving
    same(streaming.drained(streaming.feature_stream(stream, families)), streaming.feature_stream(table, families))


def test_other_streams_equal_tables(spark, arriving, tmp_path):
    stream, table = arriving
    for f in (lambda df: streaming.shaped_stream(df, 16, 4).select("id", F.to_json("sequence"), F.to_json("grid")), streaming.uniform_stream, streaming.profiled_stream):
        pick = lambda df, f=f: (lambda out: out.select("id", *(F.col(c).cast("string").alias(c) for c in out.columns[1:])))(f(df))
        same(streaming.drained(pick(stream)), pick(table))
    path = str(tmp_path / "scores")
    spark.createDataFrame([(1, [1.0, 3.0, 2.0]), (2, [0.5]), (3, [7.0, 7.0])], "k int, scores array<double>").write.parquet(path)
    got = {r["k"]: r for r in streaming.drained(streaming.decided_stream(spark.readStream.schema("k int, scores array<double>").parquet(path))).collect()}
    assert [got[k]["place"] for k in (1, 2, 3)] == [1, 1, 0] and got[3]["proba"] == [0.5, 0.5] and sum(got[1]["proba"]) == pytest.approx(1)


def test_row_checks(spark):
    df = spark.createDataFrame([("a", "x", "k", 4, 20), (None, "x", "k", 4, 20), ("c", None, "k", 4, 21)], "sample_id string, algorithm string, key_id string, len_pt int, len_ct int")
    got = sorted((r["errors"] for r in audits.row_structure(df).collect()), key=len)
    assert got == [[], ["sample_id is null"], ["algorithm is null", "len_ct"]]
    assert audits.row_structure(df.drop("len_ct")).first()["errors"] == ["no column len_ct"]


def test_batch_kernels_equal_native_columns(spark, rows):
    """F1 to F7 of the feature table against the native expressions."""
    df = spark.createDataFrame(rows, SCHEMA).drop("tag")
    wide = {r["id"]: r.asDict() for r in arrow_profile.feature_table(df).collect()}
    by = lambda d: {r["id"]: r for r in d.collect()}
    near = lambda a, b: a == pytest.approx(b, abs=1e-9, nan_ok=True)
    histogram, counts, runs, lags = by(payload.histogram(df)), by(payload.count_profile(df)), by(payload.runs(df)), by(payload.autocorrelation(df, [1, 7, 16]))
    grams = {g: by(payload.gram_profile(df, g)) for g in (2, 3, 4)}
    for k, row in wide.items():
        assert all(near(row[f"byte_hist_{i:03d}"], histogram[k][f"byte_hist_{i:03d}"]) for i in range(256))
        assert near(row["shannon_entropy"], counts[k]["entropy"]) and near(row["chi2_statistic"], counts[k]["chi2"])
        assert near(row["runs_count"], runs[k]["runs_count"]) and near(row["runs_zscore"], runs[k]["runs_z"])
        assert all(near(row[f"autocorr_lag_{i:02d}"], lags[k][f"acf_{i}"]) for i in (1, 7, 16))
        for g, found in grams.items():
            for mine, native in (("entropy", "entropy"), ("nunique", "distinct"), ("max_freq", "max_freq"), ("chi2", "chi2"), ("collision_rate", "collision_rate")):
                assert near(row[f"ngram_{g}_{mine}"], found[k][native]), (k, g, mine)


def test_kernels_do_not_depend_on_their_batch():
    rng = np.random.default_rng(3)
    many = [bytes(rng.integers(0, 1 + 4 ** (i % 5), rng.integers(0, 60), dtype=np.uint16).astype(np.uint8)) for i in range(80)]
    whole = batch.Payloads.of(*many)
    for kernels in arrow_profile.KERNELS.values():
        for kernel in kernels:
            assert np.allclose(kernel(whole), np.concatenate([kernel(batch.Payloads.of(x)) for x in many]), equal_nan=True, atol=1e-9)
    assert batch.phrase_counts(whole).tolist() == [plain_phrases(x) for x in many]


def test_phrase_steps_are_linear():
    """Twice the bytes take no more than some three times as long, on random and on periodic payloads."""
    import time

    rng = np.random.default_rng(1)
    for make in (lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes(), lambda n: b"abcdefgh" * (n // 8), lambda n: bytes(n)):
        seconds = []
        for n in (1 << 15, 1 << 18):
            began = time.process_time()
            batch.phrase_counts(batch.Payloads.of(make(n)))
            seconds.append(time.process_time() - began)
        assert seconds[1] < 8 * 4 * max(seconds[0], 0.02)


def test_corpus_of_files(spark, tmp_path):
    good = ("Größe  and\n\tweight " * 100).strip()
    for name, raw in (("a.txt", good.encode()), ("sub/b.txt", good.encode() + b"\xff"), ("sub/deep/c.txt", b"short"), ("d.md", good.encode()), ("sub/e.txt", b"")):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(raw)
    got = corpus.read_texts(spark, str(tmp_path)).collect()
    assert [(r["path"].endswith("/a.txt"), r["text"]) for r in got] == [(True, " ".join(good.split()))]
    assert corpus.read_texts(spark, str(tmp_path), "*.md").count() == 1
    assert corpus.read_texts(spark, str(tmp_path), "*.txt", 1).count() == 2


def counted(spark, df):
    """The rows, and a count of how often they are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_stages_are_reused_and_redone(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "stage")
    spark.range(10).coalesce(1).write.parquet(source)
    rows = lambda: spark.read.parquet(source).where("id > 1")
    first, seen = counted(spark, rows())
    assert corpus.stage(first, path, k=1).count() == 8 and seen.value == 8
    assert corpus.stage(first, path, k=1).count() == 8 and seen.value == 8
    # other parameters and changed inputs are worked out again
    assert corpus.stage(first, path, k=2).count() == 8 and seen.value == 16
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    assert corpus.stage(rows(), path, k=1).count() == 13
    assert len(corpus.committed(spark, path)) == 3
    # data without a record, as a lost driver leaves them, count for nothing
    other = str(tmp_path / "half")
    rows().limit(2).write.parquet(other + "/data-lost")
    assert corpus.stage(rows(), other).count() == 13


def test_increments_work_out_new_keys_only(spark, tmp_path):
    path, done = str(tmp_path / "store"), []

    def work(df):
        out, seen = counted(spark, df.select("id", (F.col("id") * 2).alias("v")))
        done.append(seen)
        return out

    assert corpus.incremental(path, spark.range(5), work, "id").count() == 5
    assert sorted(map(tuple, corpus.incremental(path, spark.range(8), work, "id").collect())) == [(i, 2 * i) for i in range(8)]
    assert corpus.incremental(path, spark.range(8), work, "id").count() == 8
    assert [s.value for s in done] == [5, 3, 0]


def test_folder_needs_a_shared_place_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        corpus.folder(Cluster)


def test_grid_is_a_loop_over_folds_of_whole_groups(spark):
    from paylume.operators import models

    rng = np.random.default_rng(0)
    data = [(i, float(i % 2), i // 5, [float(v) for v in rng.normal(size=3) + 2 * (i % 2)]) for i in range(90)]
    from pyspark.ml.functions import array_to_vector

    train = models.balanced(spark.createDataFrame(data, "vec_id long, label double, grp long, a array<double>").select("vec_id", "label", "grp", array_to_vector("a").alias("x"))).coalesce(1).sortWithinPartitions("vec_id").cache()
    got = {r["reg"]: r["f1"] for r in models.grid_scores(train, [0.01, 10.0], 3, 5).collect()}
    for reg in got:
        each = []
        for fold in range(3):
            one = models.linear_svc(reg)
            one.setClassifier(models.svm(reg, 5))
            out = models.fit_predict("m", one, train.where(F.col("grp") % 3 != fold), train.where(F.col("grp") % 3 == fold)).collect()
            f1s = []
            for c in (0, 1):
                tp = sum(r["y_true"] == c == r["y_pred"] for r in out)
                f1s.append(2 * tp / max(sum(r["y_true"] == c for r in out) + sum(r["y_pred"] == c for r in out), 1))
            each.append(np.mean(f1s))
        assert got[reg] == pytest.approx(np.mean(each), abs=1e-4)
