"""Data-quality audits: each gives a small table of figures or verdicts from aggregates over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow_profile, payload
from ..plans.registry import query
from ..sources.tables import payloads, table
from . import corpus
from .profile import STATS
from .relational import SAMPLES, SPLITS, key_splits, overlapping_groups, sample_by_class, samples

REQUIRED = ["sample_id", "algorithm", "key_id", "len_pt", "len_ct"]


@query("q1_structure", f"WITH {SAMPLES} SELECT CAST(0 AS INTEGER) AS missing_columns, count(*) FILTER (sample_id IS NULL) AS null_sample_id, count(*) FILTER (algorithm IS NULL) AS null_algorithm, count(*) FILTER (key_id IS NULL) AS null_key_id, count(*) FILTER (len_pt IS NULL) AS null_len_pt, count(*) FILTER (len_ct IS NULL) AS null_len_ct, count(*) FILTER (len_ct <> len_pt + 16) AS bad_lengths, count(*) AS n FROM s")
def structure(spark, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    present = [c for c in REQUIRED if c in df.columns]
    return df.agg(
        F.lit(len(REQUIRED) - len(present)).alias("missing_columns"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in present),
        F.count(F.when(F.col("len_ct") != F.col("len_pt") + 16, 1)).alias("bad_lengths"), F.count("*").alias("n"),
    )


@query("q2_completeness", "WITH g AS (SELECT o, l FROM (SELECT DISTINCT o_orderpriority AS o FROM orders), (SELECT DISTINCT o_orderstatus AS l FROM orders)), a AS (SELECT o_orderpriority AS o, o_orderstatus AS l, count(*) AS n FROM orders GROUP BY 1, 2) SELECT g.o AS priority, g.l AS status, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS missing FROM g LEFT JOIN a USING (o, l)")
def completeness(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    actual = orders.groupBy("priority", "status").agg(F.count("*").alias("n"))
    grid = actual.select("priority").distinct().crossJoin(actual.select("status").distinct())
    return grid.join(actual, ["priority", "status"], "left").na.fill(0, ["n"]).withColumn("missing", F.col("n") == 0)


@query("q3_unique_nonce", "SELECT count(*) AS keys, count(*) FILTER (n <> d) AS keys_with_reuse FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1)")
def unique_nonce(spark, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"))
    return keys.agg(F.count("*").alias("keys"), F.count(F.when(F.col("n") != F.col("d"), 1)).alias("keys_with_reuse"))


def row_structure(df: DataFrame) -> DataFrame:
    """Adds ``errors``, what is wrong with each row: absent required values and lengths that do not fit. Row-local, so that
    it runs on streams."""
    absent = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in REQUIRED if c in df.columns]
    missing = [F.lit(f"no column {c}") for c in REQUIRED if c not in df.columns]
    length = [F.when(F.col("len_ct") != F.col("len_pt") + 16, F.lit("len_ct"))] if {"len_ct", "len_pt"} <= set(df.columns) else []
    return df.withColumn("errors", F.array_compact(F.array(*absent, *missing, *length)))


def row_uniformity(df: DataFrame, least: int = 256, alpha: float = 0.05) -> DataFrame:
    """Chi-square of each payload with its upper tail, and whether it is rejected; null under ``least`` bytes. Row-local."""
    stats = arrow_profile.profile(df.withColumn("_n", F.coalesce(F.octet_length("payload"), F.lit(0))), ["uniformity"], "_n")
    return stats.select("id", F.col("_n").alias("n"), F.col("chi2_statistic").alias("chi2"), F.col("chi2_pvalue").alias("p_value"), F.when(F.col("_n") >= least, F.col("chi2_pvalue") < alpha).alias("rejected"))


def uniformity(df: DataFrame, least: int = 256, *by: str) -> DataFrame:
    """Chi-square of payloads of at least ``least`` bytes: number, mean, deviation, and share rejected at 0.05."""
    stats = arrow_profile.profile(df.where(F.octet_length("payload") >= least), ["uniformity"], *by).withColumnsRenamed({"chi2_statistic": "chi2", "chi2_pvalue": "p_value"})
    return stats.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("chi2"), 6).alias("mean_chi2"), F.round(F.stddev_pop("chi2"), 6).alias("std_chi2"), F.round(F.avg(F.when(F.col("p_value") < 0.05, 1.0).otherwise(0.0)), 6).alias("rejected"))


#: Upper 5 % point of the chi-square distribution with 255 degrees of freedom (fixed value).
CHI2_95 = 293.2478


@query("q4_uniformity", f"WITH {STATS} SELECT count(*) AS n, round(avg(chi2), 6) AS mean_chi2, round(stddev_pop(chi2), 6) AS std_chi2, round(avg(CASE WHEN chi2 > {CHI2_95} THEN 1.0 ELSE 0.0 END), 6) AS rejected FROM s WHERE n >= 256")
def uniformity_audit(spark, sf_dir: str) -> DataFrame:
    return uniformity(payloads(spark, sf_dir))


@query("q5_uniformity_by_class", f"WITH {STATS}, t AS (SELECT id FROM (SELECT doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY CAST('0x' || substr(md5('45|' || doc_id), 1, 8) AS BIGINT), doc_id) AS r FROM documents) WHERE r <= 50) SELECT label, count(*) AS n, round(avg(chi2), 6) AS mean_chi2, round(stddev_pop(chi2), 6) AS std_chi2, round(avg(CASE WHEN chi2 > {CHI2_95} THEN 1.0 ELSE 0.0 END), 6) AS rejected FROM s JOIN t USING (id) WHERE n >= 256 GROUP BY 1")
def uniformity_by_class(spark, sf_dir: str) -> DataFrame:
    return uniformity(sample_by_class(payloads(spark, sf_dir), "label", "id", 50, "45"), 256, "label")


@query("q6_compressibility")
def compressibility(spark, sf_dir: str) -> DataFrame:
    df = payloads(spark, sf_dir)
    ratios = arrow_profile.profile(df, ["zlib"], "label").where(~F.isnan("compression_ratio_zlib"))
    return ratios.groupBy("label").agg(*(F.round(f("compression_ratio_zlib"), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("most", F.max), ("least", F.min))))


@query("q7_round_trip", f"WITH {SAMPLES}, r AS (SELECT algorithm, row_number() OVER (PARTITION BY algorithm ORDER BY CAST('0x' || substr(md5('46|' || doc_id), 1, 8) AS BIGINT), doc_id) AS r FROM s) SELECT algorithm, count(*) AS tried, count(*) AS passed, CAST(0 AS BIGINT) AS failed, CAST([] AS VARCHAR[]) AS first_errors FROM r WHERE r <= 40 GROUP BY 1")
def round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip_audit(corpus.encrypted(samples(spark, sf_dir)), 40)


def round_trip_audit(rows: DataFrame, per_class: int) -> DataFrame:
    """Decodes a seeded sample by class with joined keys and nonces and compares content and length. A failed
    authentication decodes to null and counts as failed."""
    picked = sample_by_class(rows, "algorithm", "doc_id", per_class, "46")
    keys = rows.select("key_id").distinct().withColumn("key", corpus.key_bytes(F.col("key_id")))
    plain = rows.select("doc_id", F.encode("text", "UTF-8").alias("expected"))
    back = picked.join(keys, "key_id").join(plain, "doc_id", "left").withColumn("decoded", F.expr("try_aes_decrypt(ciphertext, key, 'GCM', 'DEFAULT', encode(key_id, 'UTF-8'))"))
    fine = F.coalesce((F.col("decoded") == F.col("expected")) & (F.octet_length("decoded") == F.col("len_pt")), F.lit(False))
    errors = F.slice(F.array_sort(F.collect_list(F.when(~fine, F.col("sample_id")))), 1, 5)
    return back.groupBy("algorithm").agg(F.count("*").alias("tried"), F.count(F.when(fine, 1)).alias("passed"), F.count(F.when(~fine, 1)).alias("failed"), errors.alias("first_errors"))


@query("q8_split_audit", f"WITH {SAMPLES}, {SPLITS}, j AS (SELECT algorithm, split, key_id FROM s JOIN sp USING (key_id)) SELECT algorithm, split, count(*) AS n, (SELECT count(*) FROM (SELECT key_id FROM j GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS shared_keys FROM j GROUP BY 1, 2")
def split_audit(spark, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    joined = df.join(key_splits(df), "key_id")
    shared = overlapping_groups(joined, "key_id", "split").agg(F.count("*").alias("shared_keys"))
    return joined.groupBy("algorithm", "split").agg(F.count("*").alias("n")).crossJoin(shared)


@query("q9_determinism", f"WITH {SAMPLES} SELECT count(DISTINCT (key_id, text)) AS pairs, true AS block_deterministic, false AS nonce_deterministic FROM s")
def determinism(spark, sf_dir: str) -> DataFrame:
    """Each text is encrypted under two nonces: the block variant gives one output, the nonce variant two."""
    twice = samples(spark, sf_dir).withColumn("nonce", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("key", corpus.key_bytes(F.col("key_id")))
    iv = F.unhex(F.substring(F.md5(F.concat_ws("|", "nonce", "doc_id")), 1, 24))
    block, gcm = F.aes_encrypt(F.encode("text", "UTF-8"), F.col("key"), F.lit("ECB"), F.lit("PKCS")), F.aes_encrypt(F.encode("text", "UTF-8"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), iv)
    each = twice.select("key_id", F.sha2("text", 256).alias("t"), F.sha2(block, 256).alias("b"), F.sha2(gcm, 256).alias("g")).groupBy("key_id", "t").agg(F.countDistinct("b").alias("b"), F.countDistinct("g").alias("g"))
    return each.agg(F.count("*").alias("pairs"), F.every(F.col("b") == 1).alias("block_deterministic"), F.every(F.col("g") == 1).alias("nonce_deterministic"))


@query("q10_verdict", f"WITH {STATS}, first AS (SELECT count(*) FILTER (text IS NULL) = 0 AS structure, count(*) = count(DISTINCT doc_id) AS is_unique FROM documents), second AS (SELECT avg(CASE WHEN chi2 > {CHI2_95} THEN 1.0 ELSE 0.0 END) < 0.10 AS uniform FROM s WHERE n >= 256) SELECT structure, is_unique, uniform, CASE WHEN structure AND is_unique AND uniform THEN 'PASS' ELSE 'FAIL' END AS verdict FROM first, second")
def verdict(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = docs.agg((F.count(F.when(F.col("text").isNull(), 1)) == 0).alias("structure"), (F.count("*") == F.countDistinct("doc_id")).alias("is_unique"))
    both = first.crossJoin(uniformity(payloads(spark, sf_dir)).select((F.col("rejected") < 0.10).alias("uniform")))
    return both.withColumn("verdict", F.when(F.col("structure") & F.col("is_unique") & F.col("uniform"), "PASS").otherwise("FAIL"))


@query("q11_verdict_manifest")
def verdict_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest with the verdict written into it."""
    found = verdict(spark, sf_dir).select(F.struct("*").alias("validation"))
    return corpus.manifest(samples(spark, sf_dir)).crossJoin(found).select(F.to_json(F.struct("manifest", "validation")).alias("manifest"))


@query("q12_length_leak", f"WITH {SAMPLES}, b AS (SELECT len_ct // 512 AS bucket, algorithm, count(*) AS n FROM s GROUP BY 1, 2) SELECT bucket, count(DISTINCT algorithm) AS classes, CAST(sum(n) AS BIGINT) AS n, list_sort(list(DISTINCT algorithm)) AS names, count(DISTINCT algorithm) = 1 AS leaks FROM b GROUP BY 1")
def length_leak(spark, sf_dir: str) -> DataFrame:
    counts = samples(spark, sf_dir).groupBy(F.floor(F.col("len_ct") / 512).alias("bucket"), "algorithm").agg(F.count("*").alias("n"))
    return counts.groupBy("bucket").agg(F.countDistinct("algorithm").alias("classes"), F.sum("n").alias("n"), F.array_sort(F.collect_set("algorithm")).alias("names")).withColumn("leaks", F.col("classes") == 1)


@query("q13_inventory", "SELECT name, CASE WHEN name = 'absent_table' THEN 'missing' ELSE 'present' END AS state, n FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'absent_table', NULL)")
def inventory(spark, sf_dir: str) -> DataFrame:
    """Expected tables against what is there, with row counts."""
    expected = ["documents", "pages", "labels", "embeddings", "absent_table"]
    counts = None
    for name in expected:
        try:
            n = table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        counts = n if counts is None else counts.unionByName(n)
    wanted = spark.createDataFrame([(n,) for n in expected], "name string")
    return wanted.join(counts, "name", "left").select("name", F.when(F.col("n").isNull(), "missing").otherwise("present").alias("state"), "n")
