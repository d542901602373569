"""Evaluation of predictions. The confusion cells are one aggregation; all metrics follow from these few rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import hash_int, sql_hash, table

CLASSES = 4
#: Share, in tenths, of rows that each model of the prediction fixture gets right.
MODELS = {"forest": 8, "linear": 6, "chance": 2}
LABELS = "l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS y FROM (SELECT DISTINCT lang FROM documents))"
PREDICTED = LABELS + (
    ", m(model, right_tenths) AS (VALUES " + ", ".join(f"('{m}', {r})" for m, r in MODELS.items()) + ")"
    f", pr AS MATERIALIZED (SELECT model, doc_id, CAST(y AS INTEGER) AS y_true, CAST(CASE WHEN {sql_hash('model', 'doc_id')} % 10 < right_tenths THEN y ELSE {sql_hash('model', 'doc_id')} // 10 % 4 END AS INTEGER) AS y_pred, ({sql_hash('model', 'doc_id')} // 100 % 1000) / 1000.0::DOUBLE AS u FROM documents JOIN l USING (lang), m)"
)


def predictions(spark, sf_dir: str) -> DataFrame:
    """(doc_id, model, y_true, y_pred, u): predictions over all documents of three models made from hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    codes = docs.select("lang").distinct().select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).alias("y_true"))
    rows = docs.join(codes, "lang").withColumn("m", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(r).alias("right")) for m, r in MODELS.items()))))
    h = hash_int(F.col("m.model"), F.col("doc_id"))
    pred = F.when(h % 10 < F.col("m.right"), F.col("y_true")).otherwise((F.floor(h / 10) % CLASSES).cast("int"))
    return rows.select("doc_id", F.col("m.model").alias("model"), "y_true", pred.alias("y_pred"), (F.floor(h / 100) % 1000 / 1000.0).alias("u"))


def probabilities(rows: DataFrame) -> DataFrame:
    """Adds ``proba``: confidence 0.4 + 0.5 u in the predicted class, the rest shared."""
    p = 0.4 + 0.5 * F.col("u")
    return rows.withColumn("proba", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.when(i == F.col("y_pred"), p).otherwise((1 - p) / (CLASSES - 1))))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Cells over the sorted union of labels, zero cells present."""
    counts = rows.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))
    grid = counts.select(*by).distinct().crossJoin(grid) if by else grid
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def per_class(cells: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each class; 0 for empty denominators."""
    flat = cells.select(*by, "y_true", "y_pred", "n", F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    same = (F.col("y_true") == F.col("label")) & (F.col("y_pred") == F.col("label"))
    sums = flat.groupBy(*by, "label").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~same & (F.col("y_pred") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~same & (F.col("y_true") == F.col("label")), F.col("n")).otherwise(0)).alias("fn")
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


CELLS = PREDICTED + ", g AS (SELECT model, a.y AS y_true, b.y AS y_pred FROM m, l a, l b), c AS MATERIALIZED (SELECT g.model, CAST(g.y_true AS INTEGER) AS y_true, CAST(g.y_pred AS INTEGER) AS y_pred, count(pr.doc_id) AS n FROM g LEFT JOIN pr ON pr.model = g.model AND pr.y_true = g.y_true AND pr.y_pred = g.y_pred GROUP BY ALL)"
PER_CLASS = CELLS + ", pc AS (SELECT model, CAST(l.y AS INTEGER) AS label, sum(n) FILTER (y_true = l.y AND y_pred = l.y) AS tp, sum(n) FILTER (y_true <> l.y AND y_pred = l.y) AS fp, sum(n) FILTER (y_true = l.y AND y_pred <> l.y) AS fn FROM c, l GROUP BY ALL), q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM pc)"


@query("e1_confusion_matrix", f"WITH {CELLS} SELECT model, y_true, y_pred, n FROM c")
def confusion_matrix(spark, sf_dir: str) -> DataFrame:
    return confusion(predictions(spark, sf_dir), "model")


@query("e2_f1_macro", f"WITH {PER_CLASS} SELECT model, round(avg(f), 6) AS f1_macro FROM q GROUP BY 1")
def f1_macro(spark, sf_dir: str) -> DataFrame:
    return per_class(confusion(predictions(spark, sf_dir), "model"), "model").groupBy("model").agg(F.round(F.avg("f1"), 6).alias("f1_macro"))


@query("e3_balanced_accuracy", f"WITH {PER_CLASS} SELECT model, round(avg(r) FILTER (tp + fn > 0), 6) AS balanced_accuracy FROM q GROUP BY 1")
def balanced_accuracy(spark, sf_dir: str) -> DataFrame:
    found = per_class(confusion(predictions(spark, sf_dir), "model"), "model").where("tp + fn > 0")
    return found.groupBy("model").agg(F.round(F.avg("recall"), 6).alias("balanced_accuracy"))


@query("e4_class_metrics", f"WITH {PER_CLASS}, a AS (SELECT model, sum(n) FILTER (y_true = y_pred) / sum(n) AS accuracy FROM c GROUP BY 1) SELECT model, label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(accuracy, 6) AS accuracy FROM q JOIN a USING (model)")
def class_metrics(spark, sf_dir: str) -> DataFrame:
    cells = confusion(predictions(spark, sf_dir), "model")
    accuracy = cells.groupBy("model").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return per_class(cells, "model").join(accuracy, "model").select("model", "label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query("e5_reordered_matrix", f"WITH {CELLS} SELECT model, (y_true + 2) % 4 AS row_place, (y_pred + 2) % 4 AS column_place, n FROM c")
def reordered_matrix(spark, sf_dir: str) -> DataFrame:
    cells = confusion(predictions(spark, sf_dir), "model")
    order = cells.select(F.col("y_true").alias("label")).distinct().withColumn("place", (F.col("label") + 2) % CLASSES)
    rows = cells.join(order.select(F.col("label").alias("y_true"), F.col("place").alias("row_place")), "y_true")
    return rows.join(order.select(F.col("label").alias("y_pred"), F.col("place").alias("column_place")), "y_pred").select("model", "row_place", "column_place", "n")


def bootstrap(cells: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile intervals of F1 macro and balanced accuracy by model. Both depend on the cells only, so a draw is a
    multinomial over the cells: the data are read once, and the draws are spread over tasks."""
    lists = cells.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("y_true", "y_pred", "n"))).alias("cells"))

    def run(batches):
        for pdf in batches:
            rows = []
            for model, cell, rep in zip(pdf["model"], pdf["cells"], pdf["rep"], strict=True):
                labels = sorted({c["y_true"] for c in cell} | {c["y_pred"] for c in cell})
                place = {v: i for i, v in enumerate(labels)}
                n = np.array([c["n"] for c in cell], float)
                draw = np.random.default_rng([seed, int(rep), *model.encode()]).multinomial(int(n.sum()), n / n.sum())
                m = np.zeros((len(labels), len(labels)))
                for c, x in zip(cell, draw, strict=True):
                    m[place[c["y_true"]], place[c["y_pred"]]] += x
                tp, true, pred = np.diag(m), m.sum(1), m.sum(0)
                f1 = np.where(true + pred > 0, 2 * tp / np.maximum(true + pred, 1), 0)
                rows.append((model, float(f1.mean()), float((tp / np.maximum(true, 1))[true > 0].mean())))
            yield pd.DataFrame(rows, columns=["model", "f1", "balanced"])

    reps = lists.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition("rep")
    found = reps.mapInPandas(run, "model string, f1 double, balanced double")
    q = lambda c, p: F.percentile(c, F.lit(p))
    return found.groupBy("model").agg(q("f1", 0.025).alias("f1_low"), q("f1", 0.975).alias("f1_high"), q("balanced", 0.025).alias("balanced_low"), q("balanced", 0.975).alias("balanced_high"))


@query("e6_bootstrap_interval", "SELECT model, true AS f1_inside, true AS balanced_inside, true AS in_range FROM (VALUES ('forest'), ('linear'), ('chance')) m(model)")
def bootstrap_interval(spark, sf_dir: str) -> DataFrame:
    cells = confusion(predictions(spark, sf_dir), "model")
    scores = per_class(cells, "model").groupBy("model").agg(F.avg("f1").alias("f1"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))).alias("balanced"))
    ends = F.col("f1_low").between(0, 1) & F.col("f1_high").between(0, 1) & F.col("balanced_low").between(0, 1) & F.col("balanced_high").between(0, 1)
    return bootstrap(cells).join(scores, "model").select("model", F.col("f1").between(F.col("f1_low"), F.col("f1_high")).alias("f1_inside"), F.col("balanced").between(F.col("balanced_low"), F.col("balanced_high")).alias("balanced_inside"), ends.alias("in_range"))


@query("e6_interval")
def interval(spark, sf_dir: str) -> DataFrame:
    """The intervals themselves, from 1000 draws."""
    found = bootstrap(confusion(predictions(spark, sf_dir), "model"))
    return found.select("model", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


PROBA = PREDICTED + ", pb AS (SELECT *, 0.4 + 0.5 * u AS p FROM pr)"


@query("e7_top_k_accuracy", f"WITH {PROBA} SELECT model, round(avg(CASE WHEN y_true = y_pred OR (y_true - CAST(y_true > y_pred AS INTEGER)) < 1 THEN 1.0 ELSE 0.0 END), 6) AS top2 FROM pb GROUP BY 1")
def top_k_accuracy(spark, sf_dir: str) -> DataFrame:
    rows = probabilities(predictions(spark, sf_dir))
    return rows.groupBy("model").agg(F.round(F.avg(F.when(in_top(F.col("proba"), F.col("y_true"), 2), 1.0).otherwise(0.0)), 6).alias("top2"))


def in_top(proba: Column, label: Column, k: int) -> Column:
    """Whether the label's score is among the k largest; on ties the smaller class number comes first."""
    own = F.get(proba, label)
    ahead = F.filter(F.transform(proba, lambda p, i: (p > own) | ((p == own) & (i < label))), lambda x: x)
    return F.size(ahead) < k


@query("e8_calibration_error", f"WITH {PROBA}, b AS (SELECT model, least(floor(p * 10), 9) AS bin, avg(p) AS conf, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc, count(*) AS n FROM pb GROUP BY 1, 2) SELECT model, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def calibration_error(spark, sf_dir: str) -> DataFrame:
    rows = probabilities(predictions(spark, sf_dir)).withColumn("conf", F.array_max("proba"))
    return ece(rows.withColumn("right", (F.col("y_true") == F.col("y_pred")).cast("double")), "model")


def ece(rows: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error in ten equal bins of the confidence, the last one closed."""
    bins = rows.groupBy(*by, F.least(F.floor(F.col("conf") * 10), F.lit(9)).alias("bin")).agg(F.avg("conf").alias("c"), F.avg("right").alias("a"), F.count("*").alias("n"))
    return bins.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"))


def roc(rows: DataFrame, *by: str) -> DataFrame:
    """Curve points by falling score, from counts by score: tp and fp up to it, and all positives and negatives. Ties
    are one point. The counts are cut into equal score ranges, so the running sums need no single sorted task."""
    counts = rows.groupBy(*by, "score").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("q"))
    cut = counts.withColumn("part", F.floor(F.col("score") * 64))
    inside = Window.partitionBy(*by, "part").orderBy(F.desc("score"))
    parts = cut.groupBy(*by, "part").agg(F.sum("p").alias("pp"), F.sum("q").alias("qq"))
    before = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    parts = parts.select(*by, "part", F.coalesce(F.sum("pp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("qq").over(before), F.lit(0)).alias("q0"), F.sum("pp").over(whole).alias("all_p"), F.sum("qq").over(whole).alias("all_q"))
    points = cut.join(parts, [*by, "part"])
    return points.select(*by, "score", "p", "q", (F.col("p0") + F.sum("p").over(inside)).alias("tp"), (F.col("q0") + F.sum("q").over(inside)).alias("fp"), "all_p", "all_q")


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the curve by trapezoids; null without both classes."""
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    return roc(rows, *by).groupBy(*by).agg((area / F.nullif(F.max("all_p") * F.max("all_q"), F.lit(0))).alias("auc"))


SCORED = PROBA + ", sc AS (SELECT model, doc_id, CAST(y_true = 1 AS INTEGER) AS positive, CASE WHEN y_pred = 1 THEN p ELSE (1 - p) / 3 END AS score FROM pb)"
RANKED = "SELECT model, (sum(r) FILTER (positive = 1) - count(*) FILTER (positive = 1) * (count(*) FILTER (positive = 1) + 1) / 2.0) / (count(*) FILTER (positive = 1) * count(*) FILTER (positive = 0)) AS auc"


@query("e9_auc_binary", f"WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM sc) SELECT model, round(auc, 6) AS auc FROM ({RANKED} FROM r GROUP BY model)")
def auc_binary(spark, sf_dir: str) -> DataFrame:
    rows = probabilities(predictions(spark, sf_dir))
    binary = rows.select("model", (F.col("y_true") == 1).cast("int").alias("positive"), F.get("proba", F.lit(1)).alias("score"))
    return auc(binary, "model").select("model", F.round("auc", 6).alias("auc"))


@query("e9_roc_points", f"WITH {SCORED}, t AS (SELECT model, score, sum(positive) AS p, sum(1 - positive) AS q FROM sc GROUP BY 1, 2) SELECT model, round(score, 6) AS score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp FROM t WINDOW w AS (PARTITION BY model ORDER BY score DESC)")
def roc_points(spark, sf_dir: str) -> DataFrame:
    rows = probabilities(predictions(spark, sf_dir))
    binary = rows.select("model", (F.col("y_true") == 1).cast("int").alias("positive"), F.get("proba", F.lit(1)).alias("score"))
    return roc(binary, "model").select("model", F.round("score", 6).alias("score"), "tp", "fp")


def auc_one_vs_rest(rows: DataFrame, *by: str) -> DataFrame:
    flat = rows.select(*by, "y_true", F.posexplode("proba").alias("class", "score"))
    each = auc(flat.withColumn("positive", (F.col("y_true") == F.col("class")).cast("int")), *by, "class")
    return each.groupBy(*by).agg(F.avg("auc").alias("auc_macro"))


@query("e10_auc_multiclass", f"WITH {PROBA}, sc AS (SELECT model || '#' || k AS model, CAST(y_true = k AS INTEGER) AS positive, CASE WHEN y_pred = k THEN p ELSE (1 - p) / 3 END AS score FROM pb, (SELECT unnest(range(0, 4)) AS k)), r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM sc) SELECT split_part(model, '#', 1) AS model, round(avg(auc), 6) AS auc_macro FROM ({RANKED} FROM r GROUP BY model) GROUP BY 1")
def auc_multiclass(spark, sf_dir: str) -> DataFrame:
    return auc_one_vs_rest(probabilities(predictions(spark, sf_dir)), "model").select("model", F.round("auc_macro", 6).alias("auc_macro"))


def mcnemar(pairs: DataFrame, *by: str, corrected: bool = True) -> DataFrame:
    """Counts of joint correctness (``a``, ``b``), the statistic, and p from the chi-square tail with one degree of
    freedom, on the one aggregated row; without discordance the statistic is 0 and p is 1."""
    n = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), 1).otherwise(0))
    counts = pairs.groupBy(*by).agg(n(True, True).alias("n11"), n(True, False).alias("n10"), n(False, True).alias("n01"), n(False, False).alias("n00"))
    apart, gap = F.col("n10") + F.col("n01"), F.abs(F.col("n10") - F.col("n01"))
    gap = gap - 1 if corrected else gap
    found = counts.withColumn("statistic", F.when(apart == 0, F.lit(0.0)).otherwise(gap * gap / apart))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return found.withColumn("p_value", F.when(apart == 0, F.lit(1.0)).otherwise(tail("statistic")))


def _joined(rows: DataFrame) -> DataFrame:
    right = rows.select("doc_id", "model", (F.col("y_true") == F.col("y_pred")).alias("right"))
    a, b = right.alias("a"), right.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.model") < F.col("b.model"))).select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("a.right").alias("a"), F.col("b.right").alias("b"))


PAIRED = PREDICTED + ", mc AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.y_true = a.y_pred AND b.y_true = b.y_pred) AS n11, count(*) FILTER (a.y_true = a.y_pred AND b.y_true <> b.y_pred) AS n10, count(*) FILTER (a.y_true <> a.y_pred AND b.y_true = b.y_pred) AS n01, count(*) FILTER (a.y_true <> a.y_pred AND b.y_true <> b.y_pred) AS n00 FROM pr a JOIN pr b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY 1, 2)"


@query("e11_mcnemar", f"WITH {PAIRED} SELECT model_a, model_b, n11, n10, n01, n00, round(CASE WHEN n10 + n01 = 0 THEN 0 ELSE (abs(n10 - n01) - 1) ** 2 / (n10 + n01) END, 6) AS statistic FROM mc WHERE model_a = 'forest' AND model_b = 'linear'")
def mcnemar_test(spark, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("model IN ('forest', 'linear')")
    return mcnemar(_joined(rows), "model_a", "model_b").select("model_a", "model_b", "n11", "n10", "n01", "n00", F.round("statistic", 6).alias("statistic"))


@query("e12_mcnemar_pairs", f"WITH {PAIRED} SELECT model_a, model_b, round((abs(n10 - n01) - 1) ** 2 / (n10 + n01), 6) AS statistic, round(0.05 / (SELECT count(*) FROM mc), 6) AS alpha FROM mc")
def mcnemar_pairs(spark, sf_dir: str) -> DataFrame:
    found = mcnemar(_joined(predictions(spark, sf_dir)), "model_a", "model_b")
    return found.select("model_a", "model_b", F.round("statistic", 6).alias("statistic"), F.round(0.05 / F.count("*").over(Window.partitionBy()), 6).alias("alpha"))


RUNS = PREDICTED + ", rn AS (SELECT model, 'run' || (doc_id % 2) AS run, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc FROM pr GROUP BY 1, 2)"


@query("e13_run_comparison", f"WITH {RUNS}, w AS (SELECT model, max(acc) FILTER (run = 'run0') AS run0, max(acc) FILTER (run = 'run1') AS run1 FROM rn GROUP BY 1) SELECT model, round(run0, 6) AS run0, round(run1, 6) AS run1, round(run1 - run0, 6) AS delta, 0.25::DOUBLE AS chance, round(run1 - 0.25, 6) AS gain FROM w")
def run_comparison(spark, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), F.col("doc_id") % 2))
    wide = rows.groupBy("model").pivot("run", ["run0", "run1"]).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")))
    return wide.select("model", F.round("run0", 6).alias("run0"), F.round("run1", 6).alias("run1"), F.round(F.col("run1") - F.col("run0"), 6).alias("delta"), F.lit(1 / CLASSES).alias("chance"), F.round(F.col("run1") - 1 / CLASSES, 6).alias("gain"))


@query("e14_consolidated", f"WITH {RUNS}, x(run) AS (VALUES ('run0'), ('run1'), ('run2')) SELECT x.run, m.model, round(acc, 6) AS accuracy, CASE WHEN acc IS NULL THEN 'pending' ELSE 'done' END AS state FROM x CROSS JOIN m LEFT JOIN rn ON rn.run = x.run AND rn.model = m.model")
def consolidated(spark, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), F.col("doc_id") % 2))
    done = rows.groupBy("run", "model").agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("accuracy"))
    wanted = rows.select("model").distinct().withColumn("run", F.explode(F.array(F.lit("run0"), F.lit("run1"), F.lit("run2"))))
    return wanted.join(done, ["run", "model"], "left").select("run", "model", "accuracy", F.when(F.col("accuracy").isNull(), "pending").otherwise("done").alias("state"))


@query("e15_stage_counts", f"WITH {PREDICTED} SELECT model, count(*) FILTER (doc_id % 2 = 0) AS run0, count(*) FILTER (doc_id % 2 = 1) AS run1, count(*) FILTER (doc_id % 2 = 1) - count(*) FILTER (doc_id % 2 = 0) AS delta FROM pr WHERE y_true = y_pred GROUP BY 1")
def stage_counts(spark, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("y_true = y_pred").withColumn("run", F.concat(F.lit("run"), F.col("doc_id") % 2))
    return rows.groupBy("model").pivot("run", ["run0", "run1"]).count().na.fill(0).withColumn("delta", F.col("run1") - F.col("run0"))


@query("j6_reorder_by_key", f"WITH {PREDICTED} SELECT a.doc_id, a.y_pred AS first_pred, b.y_pred AS second_pred FROM pr a JOIN pr b ON a.doc_id = b.doc_id WHERE a.model = 'forest' AND b.model = 'linear'")
def reorder_by_key(spark, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    one = lambda m, name: rows.where(F.col("model") == m).select("doc_id", F.col("y_pred").alias(name))
    return one("forest", "first_pred").join(one("linear", "second_pred"), "doc_id")


@query("s8_comparison_table", f"WITH {RUNS} SELECT '| model | run | accuracy |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown FROM (SELECT '| ' || model || ' | ' || run || ' | ' || printf('%.4f', acc) || ' |' AS line FROM rn)")
def comparison_table(spark, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), F.col("doc_id") % 2))
    means = rows.groupBy("model", "run").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return markdown(means, ["model", "run", "accuracy"])


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A small result as one Markdown text; numbers with four places, lines in order."""
    kinds = dict(rows.dtypes)
    cell = F.format_string("| " + " | ".join("%.4f" if kinds[c] == "double" else "%s" for c in columns) + " |", *columns)
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.select(cell.alias("line")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("markdown"))
