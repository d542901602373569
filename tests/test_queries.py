"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest
from pyspark.sql import functions as F

from paylume.plans.queries import QUERIES, SQL

from .compare import assert_same, connect
from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SMALL), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(1).count() == 1


def test_long_queries_with_few_rounds(spark):
    from paylume.operators import models, selection

    train, test = models._split(spark, SMALL)
    assert models.boosted(train, test, 3).count() == test.count() > 0
    hits, rounds = selection.shadow_hits(selection.features(spark, SMALL), selection.NAMES[:12], "vec_id", rounds=2, trees=5)
    assert rounds == 2 and len(hits) == 12 and all(0 <= k <= 2 for k in hits.values())
    rows = models.balanced(models.vectors(spark, SMALL)).withColumn("fold", F.col("grp") % 5).cache()
    found = models.selected_fits("logistic", {"a": (rows.where("fold <> 0"), rows.where("fold = 0"))}, rounds=1)["a"]
    assert models.scores(found, "model").first()["f1_macro"] is not None and found.count() == rows.where("fold = 0").count()


def test_a_feature_that_tells_the_label_is_confirmed_early(spark):
    """The rounds end when all features are over or under chance; the one that is the label is confirmed."""
    from paylume.operators import selection

    df = spark.range(300).selectExpr("id AS k", "CAST(id % 2 AS BIGINT) AS y", "CAST(id % 2 AS DOUBLE) + rand(1) * 0.1 AS a", "rand(2) AS b", "rand(3) AS c").cache()
    hits, rounds = selection.shadow_hits(df, ["a"], "k", rounds=40, trees=5)
    assert selection.confirmed(hits, rounds) == ["a"] and rounds < 40


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
