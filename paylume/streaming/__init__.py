"""Profiles, projections and row checks on streams. Everything here is row-local: a stream of payloads keeps no state, needs
no watermark, and gives for each row what the same function gives on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow_profile, payload
from ..operators.audits import row_structure, row_uniformity
from ..operators.corpus import folder
from ..operators.profile import NULLED
from ..operators.relational import softmax
from ..plans.registry import query
from ..sources.tables import SQL_P

PROFILES = ["histogram", "entropy", "ngrams", "autocorrelation"]


def profiled_stream(df: DataFrame) -> DataFrame:
    """Size, sums and lag-1 product sum, and the first 32 bytes as a fixed sequence, for each payload that arrives."""
    sums = payload.lag_sums(df.withColumn("head", payload.fixed_sequence("payload", 32)), [1], "head")
    n = F.greatest("n", F.lit(1))
    return sums.select("id", "n", (F.col("s") / n).alias("mean_byte"), (F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n)).alias("variance"), F.col("p_1").alias("lag1_sum"), "head")


def feature_stream(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Feature columns of each payload that arrives: by default those of the histogram, entropy with its chi-square and tail,
    grams, autocorrelation and runs."""
    return arrow_profile.feature_table(df, PROFILES if families is None else families)


def shaped_stream(df: DataFrame, size: int, side: int) -> DataFrame:
    """``sequence``, the first ``size`` bytes padded with zeros, and ``grid``, ``side`` rows of scaled bytes."""
    return df.withColumn("sequence", payload.fixed_sequence("payload", size)).withColumn("grid", payload.fixed_grid("payload", side))


def decided_stream(df: DataFrame, scores: str = "scores") -> DataFrame:
    """``proba``, the softmax of an array of scores, and ``place``, its largest."""
    soft = softmax(df, scores, "proba")
    return soft.withColumn("place", F.array_position("proba", F.array_max("proba")) - 1)


def checked_stream(df: DataFrame) -> DataFrame:
    """``errors`` of the structure of each row."""
    return row_structure(df)


def uniform_stream(df: DataFrame, least: int = 256, alpha: float = 0.05) -> DataFrame:
    """Chi-square, tail and rejection of each payload."""
    return row_uniformity(df, least, alpha)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives now, written as Parquet to the shared folder and read again. A query that is run again with
    the same checkpoint goes on where it stopped."""
    spark = stream.sparkSession
    path, kept = folder(spark), folder(spark)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", kept).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def arriving(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def payload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = arriving(spark, sf_dir, "documents", "doc_id long, text string, lang string")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.encode("text", "UTF-8").alias("payload"))


@query("st1_stream_entropy", f"WITH {SQL_P}, c AS (SELECT id, n, x, count(*) AS c FROM (SELECT id, n, substr(hx, 2 * i - 1, 2) AS x FROM (SELECT id, n, hx, unnest(range(1, n + 1)) AS i FROM p)) GROUP BY ALL), s AS (SELECT id, greatest(log2(n) - sum(c * log2(c)) / n, 0) AS entropy, CASE WHEN n >= 16 THEN 256.0 * sum(c * c) / n - n END AS chi2 FROM c GROUP BY id, n) SELECT p.id, p.label, round(coalesce(entropy, 0), 6) AS entropy, round(chi2, 6) AS chi2 FROM p LEFT JOIN s USING (id)")
def stream_entropy(spark, sf_dir: str) -> DataFrame:
    """Entropy and chi-square of the documents as their files arrive."""
    found = drained(feature_stream(payload_stream(spark, sf_dir), ["entropy"]))
    return found.select("id", "label", F.round("shannon_entropy", 6).alias("entropy"), NULLED("chi2_statistic").alias("chi2"))


@query("st2_stream_features")
def stream_features(spark, sf_dir: str) -> DataFrame:
    """Histogram, entropy, grams, autocorrelation and runs of the documents as their files arrive."""
    return drained(feature_stream(payload_stream(spark, sf_dir)))


@query("st3_stream_checks", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place, CASE WHEN label IS NULL THEN 1 ELSE 0 END AS n_errors FROM embeddings")
def stream_checks(spark, sf_dir: str) -> DataFrame:
    """The largest of each vector's softmax, and the errors of rows built from it, as the vectors' files arrive."""
    rows = arriving(spark, sf_dir, "embeddings", "vec_id long, embedding array<float>, label int")
    found = decided_stream(rows.withColumn("scores", F.col("embedding").cast("array<double>")))
    made = found.select("vec_id", "place", F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("algorithm"), F.lit("k").alias("key_id"), F.size("scores").alias("len_pt"), (F.size("scores") + 16).alias("len_ct"))
    return drained(checked_stream(made).select("vec_id", "place", F.size("errors").alias("n_errors")))
