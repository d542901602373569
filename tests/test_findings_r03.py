"""Cases of the findings of round 3."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paylume.plans.queries import QUERIES, SQL

from .compare import assert_same, connect
from .conftest import SMALL


def folder(tmp_path, texts):
    """The small tables, with these documents."""
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["web"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_payloads_shorter_than_a_gram(spark, tmp_path, n):
    sf_dir = folder(tmp_path, ["", "a", "ab", "abc", "abcd", "aaaa", "é", "a longer one, a longer one"])
    assert_same(QUERIES[f"f5_ngrams_{n}"](spark, sf_dir), connect(sf_dir), SQL[f"f5_ngrams_{n}"])


def test_stage_report_goes_through_all_rounds(spark, monkeypatch):
    """The report covers the shadow stage, which takes all its 100 rounds."""
    from paylume.operators import selection

    taken = []
    whole = selection.importances

    def noted(tables, key, label, rounds, *args):
        taken.append(rounds)
        return whole(tables, key, label, rounds, *args)

    monkeypatch.setattr(selection, "importances", noted)
    row = QUERIES["x6_stage_report"](spark, SMALL).first()
    assert taken == [100] and row["final_fits"] is True and row["mrmr"] == 24


def test_a_level_of_boosting_is_one_job(spark, monkeypatch):
    from paylume.operators import boosting, shadow

    df = spark.range(300).selectExpr("id AS k", "CAST(id % 3 AS DOUBLE) AS label", "(id * 7919) % 101 + 9.0 * (id % 3) AS a", "(id * 104729) % 89 AS b").cache()
    monkeypatch.setattr(shadow, "BLOCK_ROWS", 50)
    sc, jobs = spark.sparkContext, {}
    for rounds in (1, 4):
        sc.setJobGroup(f"boosting {rounds}", "")
        boosting.fit(df, ["a", "b"], "k", rounds=rounds, depth=3)
        jobs[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"boosting {rounds}"))
    sc.setJobGroup("", "")
    assert 0 < jobs[4] - jobs[1] <= 3 * 3


@pytest.mark.parametrize("name", ["f13_bigram_map", "f15_block_repetition", "g7_xor_variant", "p13_fixed_grid"])
def test_row_by_row(spark, tmp_path, name):
    """The same rows as the SQL on odd payloads, and no grouping of parts of a payload."""
    sf_dir = folder(tmp_path, ["", "a", "ab", "abc", "aaaa", "é" * 9, "0123456789abcdef" * 3, "x" * 33, "a longer one, " * 50])
    df = QUERIES[name](spark, sf_dir)
    assert_same(df, connect(sf_dir), SQL[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert "substr" in plan if name.startswith("p13") else "MapInArrow" in plan


def test_cuts_take_few_nodes_at_once(monkeypatch):
    """However many sums come in one batch, few are added up at once, and equal nodes across such parts are brought together."""
    import numpy as np

    from paylume.operators import shadow

    forests = shadow.Forests({0: 4}, 2, 1, 300, 2, 8, 42)
    sums = np.random.default_rng(3).random((1200, forests.drawn * 8 * 2))
    keys = np.stack([np.zeros(1200), np.zeros(1200), np.arange(1200) // 4, np.ones(1200)], 1).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([*(pa.array(keys[:, c]) for c in range(4)), pa.array([v.tobytes() for v in sums], pa.binary())], names=["job", "round", "tree", "node", "sums"])
    whole = pa.Table.from_batches(shadow.cuts(forests)(iter([batch])))
    sizes, stack = [], np.stack

    def noted(arrays, *args, **kwargs):
        out = stack(arrays, *args, **kwargs)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(shadow, "NODES_AT_ONCE", 30)
    monkeypatch.setattr(shadow.np, "stack", noted)
    parts = pa.Table.from_batches(shadow.cuts(forests)(iter([batch])))
    assert max(sizes) <= 30
    assert parts.select(range(6)).equals(whole.select(range(6)))


def test_phrases_of_short_payloads_are_searched(monkeypatch):
    """Both ways of parsing give equal counts, and a short payload sorts no suffixes."""
    import numpy as np

    from paylume.functions import batch

    rng = np.random.default_rng(1)
    odd = [b"", b"a", b"aa", b"abc", b"abcd", b"abcabcab", b"a" * 500, b"ab" * 200, bytes(range(256)) * 3] + [bytes(rng.integers(0, k, n, dtype=np.uint8)) for k in (2, 3, 256) for n in (4, 5, 50, 700)]
    p = batch.Payloads.of(*odd)
    monkeypatch.setattr(batch, "SEARCHED", -1)
    by_suffixes = batch.phrase_counts(p)
    monkeypatch.setattr(batch, "SEARCHED", 100)
    assert (batch.phrase_counts(p) == by_suffixes).all()
    monkeypatch.undo()
    monkeypatch.setattr(batch, "longest_earlier", None)
    assert (batch.phrase_counts(p) == by_suffixes).all()


@pytest.fixture(scope="module")
def three(spark):
    """Three classes that the vectors tell for most rows; a column that is constant."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from paylume.operators import models

    rng = np.random.default_rng(2)
    centre = np.array([[2.0, 0, 0, 0.1], [0, 2.0, 0, 0.1], [0, 0, 2.0, 0.1]])
    data = [(i, float(c), i // 5, [float(v) for v in centre[c] + np.r_[rng.normal(size=3), 0.0]]) for i, c in enumerate(rng.integers(0, 3, 300))]
    rows = spark.createDataFrame(data, "vec_id long, label double, grp long, a array<double>")
    return models.balanced(rows.select("vec_id", "label", "grp", array_to_vector("a").alias("x"))).coalesce(1).sortWithinPartitions("vec_id").cache()


def test_all_classes_at_once_reach_the_optimum_of_each(three):
    """Objective and predictions against the classifiers of ``pyspark.ml``, one by one."""
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F

    from paylume.operators import models, svc

    model = svc.fit(three.withColumn("fold", F.lit(0)), [0.01], [1], 100)[0.01, 1]
    rows = three.orderBy("vec_id").collect()
    x, y, w = np.array([r["x"].toArray() for r in rows]), np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
    mean = w @ x / w.sum()
    deviation = np.sqrt(w @ (x - mean) ** 2 / (w.sum() - w @ w / w.sum()))
    for c in range(3):
        one = Pipeline(stages=[models.scaler(), models.svm(0.01, 100)]).fit(three.withColumn("label", (F.col("label") == c).cast("double"))).stages[1]
        scaled = model.coefficients[c] * deviation
        value = w @ np.maximum(0, 1 - np.where(y == c, 1, -1) * (x @ model.coefficients[c] + model.intercepts[c])) / w.sum() + 0.005 * scaled @ scaled
        assert value == pytest.approx(min(one.summary().objectiveHistory), rel=0.01)
    assert (model.coefficients[:, 3] == 0).all()
    want = {r["vec_id"]: r["y_pred"] for r in models.fit_predict("m", models.linear_svc(0.01), three, three).collect()}
    got = {r["vec_id"]: r["y_pred"] for r in models.svc_predictions(three, three, 0.01).collect()}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in got) >= 0.97 * len(got)


def test_grid_shares_its_passes(spark, three):
    """27 classifiers take about the jobs of one, and each part of the rows sends one sum."""
    from paylume.operators import models

    sc, jobs = spark.sparkContext, []
    for regs in ([0.1], [0.001, 0.1, 1.0]):
        sc.setJobGroup(f"grid {len(regs)}", "")
        assert models.grid_scores(three, regs, 3, 10).count() == len(regs)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"grid {len(regs)}")))
    sc.setJobGroup("", "")
    assert jobs[1] < 150 and jobs[1] < 2.5 * jobs[0]


def test_svc_without_rows_and_with_odd_vectors(spark, three):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from paylume.operators import models, svc

    assert models.svc_predictions(three.where("false"), three.where("false")).count() == 0
    odd = three.withColumn("x", array_to_vector(F.when(F.col("vec_id") == 7, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))))
    with pytest.raises(Exception, match="one length"):
        svc.fit(odd.withColumn("fold", F.lit(0)), [0.1], [1])


def test_release_gives_back_what_the_driver_has_freed(spark):
    import psutil

    from paylume.llm.shared import release

    held = [bytes(3000) for _ in range(60_000)]
    pins = held[::1000]  # spread, so that the heap can't shrink from its end
    del held
    before = psutil.Process().memory_info().rss
    release(spark)
    assert before - psutil.Process().memory_info().rss > 100e6 and len(pins) == 60


def test_release_gives_back_the_freed_heap_of_the_driver(spark):
    from paylume.llm import shared

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    held = [gateway.new_array(jvm.long, 1 << 22) for _ in range(12)]
    for x in held:
        gateway.detach(x)
    shared.release(spark)
    runtime = jvm.Runtime.getRuntime()
    assert runtime.freeMemory() < 0.6 * runtime.totalMemory()
    assert shared.managed(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value") == "70"


def test_examples_of_toxicity_are_held_in_narrow_types(spark):
    from paylume.llm import toxicity

    docs = spark.createDataFrame([(i, f"plain words w{i % 7} and " + ("awful nasty" if i % 2 else "kind good") + f" x{i}") for i in range(60)], "doc_id long, text string")
    index = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS label"))
    assert index.example.dtype == np.int32 and index.focus.example.dtype == np.int32
    scores = {r[0]: r[1] for r in toxicity.score(docs, index).select("doc_id", "score").collect()}
    assert all((s > 0.5) == bool(i % 2) for i, s in scores.items())
