"""Projections, joins, aggregates, samples and set operations over payload tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payload
from ..plans.registry import query
from ..sources.tables import hash_int, payloads, sql_hash, table

#: Columns that are never features.
METADATA = {"sample_id", "doc_id", "algorithm", "key_id", "nonce_id", "split", "len_pt", "len_ad", "len_ct"}
FORBIDDEN = {"len_pt", "len_ad", "len_ct"}
SAMPLES = "s AS (SELECT doc_id, 'doc_' || doc_id AS sample_id, lang AS algorithm, source AS key_id, CAST(strlen(text) AS BIGINT) AS len_pt, CAST(strlen(text) AS BIGINT) + 16 AS len_ct, text FROM documents)"
SPLITS = "k AS (SELECT key_id, row_number() OVER (ORDER BY key_id) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT source AS key_id FROM documents)), sp AS (SELECT key_id, CASE WHEN m <= 10 THEN NULL WHEN r <= m * 6 // 10 THEN 'train' WHEN r <= m * 6 // 10 + m * 2 // 10 THEN 'val' ELSE 'test' END AS split FROM k)"


def samples(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    return docs.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("sample_id"), F.col("lang").alias("algorithm"), F.col("source").alias("key_id"), size.alias("len_pt"), (size + 16).alias("len_ct"), "text")


def key_splits(df: DataFrame, train: int = 6, val: int = 2) -> DataFrame:
    """Holdout by group: of the keys in order, the first tenths train, the next validate, the rest test; no split for
    ten keys or fewer. Only the distinct keys are ranked."""
    ranked = df.select("key_id").distinct().select("key_id", F.row_number().over(Window.orderBy("key_id")).alias("r"), F.count("*").over(Window.partitionBy()).alias("m"))
    first = F.floor(F.col("m") * train / 10)
    second = first + F.floor(F.col("m") * val / 10)
    return ranked.select("key_id", F.when(F.col("m") <= 10, None).when(F.col("r") <= first, "train").when(F.col("r") <= second, "val").otherwise("test").alias("split"))


def check_no_leakage(columns: list[str]) -> None:
    """Raises if a payload length is among the features."""
    if bad := sorted(FORBIDDEN & set(columns)):
        raise ValueError(f"forbidden feature columns: {bad}")


def feature_columns(df: DataFrame) -> list[str]:
    numeric = (T.NumericType,)
    return [f.name for f in df.schema.fields if f.name not in METADATA and isinstance(f.dataType, numeric)]


# scans


@query("s1_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan(spark, sf_dir: str) -> DataFrame:
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    return spark.read.schema(schema).parquet(f"{sf_dir}/orders.parquet").drop("o_orderdate")


@query("s2_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def pruned_scan(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").where("l_quantity > 45")


# projections and predicates


@query("p1_select_by_value", f"WITH {SAMPLES} SELECT sample_id, len_pt FROM s WHERE algorithm = 'de' AND len_pt > 1000")
def select_by_value(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where((F.col("algorithm") == "de") & (F.col("len_pt") > 1000)).select("sample_id", "len_pt")


@query("p2_min_length", f"WITH {SAMPLES} SELECT sample_id, len_ct FROM s WHERE len_ct >= 64")
def min_length(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("len_ct >= 64").select("sample_id", "len_ct")


@query("p3_feature_projection", "SELECT doc_id, n_chars FROM documents")
def feature_projection(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *feature_columns(docs))


@query("p4_forbidden_guard", f"WITH {SAMPLES} SELECT count(*) AS n, 'forbidden feature columns: [''len_ct'', ''len_pt'']' AS refused FROM s")
def forbidden_guard(spark, sf_dir: str) -> DataFrame:
    df, refused = samples(spark, sf_dir), ""
    try:
        check_no_leakage([f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    except ValueError as e:
        refused = str(e)
    return df.agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@query("p5_label_encode", f"WITH {SAMPLES}, l AS (SELECT algorithm, row_number() OVER (ORDER BY algorithm) - 1 AS y FROM (SELECT DISTINCT algorithm FROM s)) SELECT sample_id, CAST(y AS INTEGER) AS y FROM s JOIN l USING (algorithm)")
def label_encode(spark, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return df.join(label_codes(df, "algorithm"), "algorithm").select("sample_id", "y")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct labels from 0 up."""
    return df.select(column).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("y"))


@query("p6_value_remap", f"WITH {SPLITS} SELECT key_id, CASE WHEN split IN ('train', 'val') THEN 'trainval' WHEN split = 'test' THEN 'test' END AS split2 FROM sp")
def value_remap(spark, sf_dir: str) -> DataFrame:
    return key_splits(samples(spark, sf_dir)).select("key_id", remap(F.col("split")).alias("split2"))


def remap(split: Column) -> Column:
    """train and val become trainval; what is unknown becomes null."""
    return F.when(split.isin("train", "val"), "trainval").when(split == "test", "test")


@query("p7_impute", f"WITH {SAMPLES} SELECT sample_id, CASE WHEN len_pt < 256 THEN 0.0 ELSE CAST(len_pt AS DOUBLE) END AS v FROM s")
def impute(spark, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("len_pt") < 100, F.lit(None)).when(F.col("len_pt") < 256, F.lit(float("nan"))).otherwise(F.col("len_pt").cast("double"))
    return samples(spark, sf_dir).select("sample_id", raw.alias("v")).na.fill(0.0)


@query("p8_hex", f"WITH {SAMPLES} SELECT sample_id, md5(hex(encode(text))) AS hexed_md5, true AS same FROM s")
def hexed(spark, sf_dir: str) -> DataFrame:
    """Every text as hexadecimal digits (their md5, as texts may be long) and back."""
    raw = F.encode("text", "UTF-8")
    return samples(spark, sf_dir).select("sample_id", F.md5(F.hex(raw)).alias("hexed_md5"), (F.unhex(F.hex(raw)) == raw).alias("same"))


@query("p9_formatted_id", f"WITH {SAMPLES} SELECT sample_id, replace(lower(algorithm), '-', '') || '_ref_k' || lpad(substr(key_id, 4), 4, '0') || '_n' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '_pt' || CASE WHEN len_pt > 9999 THEN CAST(len_pt AS VARCHAR) ELSE lpad(CAST(len_pt AS VARCHAR), 4, '0') END AS made FROM s")
def formatted_id(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", F.format_string("%s_ref_k%04d_n%06d_pt%04d", F.regexp_replace(F.lower("algorithm"), "-", ""), F.substring("key_id", 4, 9).cast("int"), "doc_id", "len_pt").alias("made"))


@query("p10_number_in_id", f"WITH {SAMPLES} SELECT sample_id, CAST(split_part(sample_id, '_', 2) AS INTEGER) AS number FROM s")
def number_in_id(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("sample_id", F.split_part("sample_id", F.lit("_"), F.lit(2)).cast("int").alias("number"))


@query("p11_body_and_trailer", f"WITH {SAMPLES} SELECT sample_id, md5(substr(hx, 1, greatest(2 * (len_pt - 16), 0))) AS body_md5, substr(hx, greatest(2 * (len_pt - 16), 0) + 1) AS trailer FROM (SELECT *, hex(encode(text)) AS hx FROM s)")
def body_and_trailer(spark, sf_dir: str) -> DataFrame:
    """The last 16 bytes, and the md5 of what is before them; a shorter payload is all trailer."""
    df = samples(spark, sf_dir).withColumn("raw", F.encode("text", "UTF-8"))
    cut = F.greatest(F.octet_length("raw") - 16, F.lit(0))
    return df.select("sample_id", F.md5(F.hex(F.col("raw").substr(F.lit(1), cut))).alias("body_md5"), F.hex(F.col("raw").substr(cut + 1, F.lit(16))).alias("trailer"))


@query("p12_fixed_sequence", "WITH p AS (SELECT doc_id AS id, rpad(substr(hex(encode(text)), 1, 128), 128, '0') AS hx FROM documents) SELECT id, list_transform(range(0, 64), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)) AS sequence FROM p")
def fixed_sequence(spark, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select("id", payload.fixed_sequence("payload", 64).alias("sequence"))


@query("p13_fixed_grid", "WITH p AS (SELECT doc_id AS id, rpad(substr(hex(encode(text)), 1, 128), 128, '0') AS hx FROM documents) SELECT id, list_transform(range(0, 8), lambda r: list_transform(range(0, 8), lambda c: CAST('0x' || substr(hx, CAST(2 * (8 * r + c) + 1 AS BIGINT), 2) AS INTEGER) / 255.0::DOUBLE)) AS grid FROM p")
def fixed_grid(spark, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select("id", payload.fixed_grid("payload", 8).alias("grid"))


SOFT = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top FROM e), x AS (SELECT vec_id, list_transform(v, lambda a: exp(a - top)) AS w FROM m), y AS (SELECT vec_id, w, list_sum(w) AS total FROM x)"


def softmax(df: DataFrame, scores: str, name: str) -> DataFrame:
    """Adds ``name``: the softmax of an array of scores, the largest taken off first. One score s counts as [-s, s].
    A generated array of one keeps the largest and the sum from being worked out for every element."""
    both = F.when(F.size(scores) == 1, F.array(-F.get(scores, F.lit(0)), F.get(scores, F.lit(0)))).otherwise(F.col(scores))
    keep = [F.col(c) for c in df.columns if c != name]
    led = df.select(*keep, F.explode(F.array(F.struct(both.alias("v"), F.array_max(both).alias("top")))).alias("_s"))
    risen = led.select(*keep, F.explode(F.array(F.transform("_s.v", lambda x: F.exp(x - F.col("_s.top"))))).alias("_w"))
    summed = risen.select(*keep, F.explode(F.array(F.struct(F.col("_w").alias("w"), F.aggregate("_w", F.lit(0.0), lambda s, x: s + x).alias("total")))).alias("_s"))
    return summed.select(*keep, F.transform("_s.w", lambda x: x / F.col("_s.total")).alias(name))


@query("p14_softmax", f"WITH {SOFT} SELECT vec_id, list_transform(w, lambda a: round(a / total, 6)) AS proba FROM y")
def softmax_of_scores(spark, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return softmax(scores, "v", "proba").select("vec_id", F.transform("proba", lambda x: F.round(x, 6)).alias("proba"))


@query("p15_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place FROM embeddings")
def argmax(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("place"))


# joins


@query("j1_left_join", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_join(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def validated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row with the figures of a join that must be one to one: doubled keys of both sides and unmatched rows."""
    doubled = lambda df, name: df.groupBy(key).count().where("count > 1").agg(F.count("*").alias(name))
    lost = left.select(key).join(right.select(key, F.lit(1).alias("_hit")), key, "left").agg(F.count(F.when(F.col("_hit").isNull(), 1)).alias("unmatched"), F.count("*").alias("rows"))
    return doubled(left, "doubled_left").crossJoin(doubled(right, "doubled_right")).crossJoin(lost)


@query("j2_validated_join", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS doubled_left, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS doubled_right, count(*) FILTER (d.doc_id IS NULL) AS unmatched, count(*) AS \"rows\" FROM labels l LEFT JOIN documents d USING (doc_id)")
def one_to_one(spark, sf_dir: str) -> DataFrame:
    return validated_join(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("j3_lookup_join", f"WITH {SAMPLES}, k AS (SELECT DISTINCT key_id, upper(md5('42|' || key_id)) AS key_hex FROM s) SELECT sample_id, key_hex FROM s JOIN k USING (key_id)")
def lookup_join(spark, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    keys = df.select("key_id").distinct().withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.lit("42"), "key_id"))))
    # left to the optimiser: the key table is broadcast only while its size at run time allows
    return df.join(keys, "key_id").select("sample_id", F.hex("key").alias("key_hex"))


@query("j4_composite_join", "SELECT l_orderkey, l_linenumber, count(p.l_partkey) AS hits, count(*) - count(p.l_partkey) AS missing FROM lineitem l LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F') p USING (l_partkey, l_suppkey, l_returnflag) GROUP BY 1, 2")
def composite_join(spark, sf_dir: str) -> DataFrame:
    """Lines against the combinations of part, supplier and flag that stand in finished orders, by all three."""
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", *keys)
    known = lines.where("l_linestatus = 'F'").select(*keys).distinct().withColumn("hit", F.lit(1))
    return lines.join(known, keys, "left").groupBy("l_orderkey", "l_linenumber").agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("missing"))


@query("j5_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("j7_cross_product", "SELECT k.i AS key, z.size, n.i AS sample, v.v AS variant FROM (SELECT unnest(range(1, 1 + (SELECT count(DISTINCT source) FROM documents))) AS i) k, (VALUES (64), (256), (1024)) z(size), (SELECT unnest(range(0, 5)) AS i) n, (VALUES ('a'), ('b')) v(v)")
def cross_product(spark, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select("source").distinct().select(F.row_number().over(Window.orderBy("source")).cast("long").alias("key"))
    grid = keys.withColumn("size", F.explode(F.array(*map(F.lit, (64, 256, 1024))))).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return grid.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b"))))


@query("j8_pairs", "WITH g AS (SELECT source, CAST(avg(n_chars) AS DOUBLE) AS m FROM documents GROUP BY 1) SELECT a.source AS a, b.source AS b, round(abs(a.m - b.m), 6) AS gap FROM g a JOIN g b ON a.source < b.source")
def pairs(spark, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"))
    a, b = groups.alias("a"), groups.alias("b")
    return a.join(b, F.col("a.source") < F.col("b.source")).select(F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.round(F.abs(F.col("a.m") - F.col("b.m")), 6).alias("gap"))


@query("j9_split_join", f"WITH {SAMPLES}, {SPLITS} SELECT sample_id, key_id, split FROM s JOIN sp USING (key_id)")
def split_join(spark, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    return df.join(key_splits(df), "key_id").select("sample_id", "key_id", "split")


# aggregates


@query("a1_count_by_key", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def count_by_key(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a2_relative_frequency", "SELECT lang, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY 1")
def relative_frequency(spark, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


@query("a3_length_totals", f"WITH {SAMPLES} SELECT CAST(sum(len_ct) AS BIGINT) AS total, min(len_ct) AS least, max(len_ct) AS most FROM s")
def length_totals(spark, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).agg(F.sum("len_ct").alias("total"), F.min("len_ct").alias("least"), F.max("len_ct").alias("most"))


@query("a4_uniqueness", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, count(*) = count(DISTINCT l_linenumber) AS is_unique FROM lineitem GROUP BY 1")
def uniqueness(spark, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("n_distinct"))
    return found.withColumn("is_unique", F.col("n") == F.col("n_distinct"))


@query("a5_sorted_sets", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1")
def sorted_sets(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


@query("a6_crosstab", "SELECT l_returnflag, min(l_quantity) FILTER (l_linestatus = 'F') AS low_f, max(l_quantity) FILTER (l_linestatus = 'F') AS high_f, min(l_quantity) FILTER (l_linestatus = 'O') AS low_o, max(l_quantity) FILTER (l_linestatus = 'O') AS high_o FROM lineitem GROUP BY 1")
def crosstab(spark, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return wide.select("l_returnflag", F.col("F_low").alias("low_f"), F.col("F_high").alias("high_f"), F.col("O_low").alias("low_o"), F.col("O_high").alias("high_o"))


@query("a7_moments", "SELECT l_shipmode, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, max(l_extendedprice) AS most, min(l_extendedprice) AS least FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_extendedprice FROM lineitem) GROUP BY 1")
def moments(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_extendedprice")
    return df.groupBy("l_shipmode").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std"), F.max("l_extendedprice").alias("most"), F.min("l_extendedprice").alias("least"))


@query("a8_fold_summary", "WITH f AS (SELECT label % 3 AS model, vec_id % 5 AS fold, avg(embedding[1]) AS v FROM embeddings GROUP BY 1, 2) SELECT model, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, list(round(v, 6) ORDER BY fold) AS folds FROM f GROUP BY 1")
def fold_summary(spark, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 3).alias("model"), (F.col("vec_id") % 5).alias("fold")).agg(F.avg(F.get("embedding", F.lit(0))).alias("v"))
    return summarise_folds(folds, "model", "v")


def summarise_folds(folds: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, sample deviation and the fold values in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("fold", value))), lambda x: F.round(x[value], 6))
    return folds.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), ordered.alias("folds"))


@query("a9_rejection_share", f"SELECT lang, round(avg(CASE WHEN {sql_hash('7', 'doc_id')} % 1000 < 50 THEN 1.0 ELSE 0.0 END), 6) AS rejected FROM documents GROUP BY 1")
def rejection_share(spark, sf_dir: str) -> DataFrame:
    p = hash_int("7", F.col("doc_id")) % 1000 / 1000.0
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(F.when(p < 0.05, 1.0).otherwise(0.0)), 6).alias("rejected"))


# sorts, samples, sets


@query("t1_top_k", "SELECT source, n FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 10")
def top_k(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("t2_simple_sample", f"SELECT doc_id FROM documents ORDER BY {sql_hash('42', 'doc_id')}, doc_id LIMIT 100")
def simple_sample(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(hash_int("42", F.col("doc_id")), "doc_id").limit(100)


def sample_by_class(df: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each class without replacement, by hash of the key."""
    order = Window.partitionBy(by).orderBy(hash_int(seed, F.col(key)), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


@query("t3_class_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash('43', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 25")
def class_sample(spark, sf_dir: str) -> DataFrame:
    return sample_by_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, "43")


@query("t4_shuffle", f"SELECT doc_id, {sql_hash('44', 'doc_id')} AS place FROM documents ORDER BY place, doc_id")
def full_shuffle(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hash_int("44", F.col("doc_id")).alias("place")).orderBy("place", "doc_id")


@query("t5_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def first_rows(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(20)


@query("t6_counter", "WITH k AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)) SELECT source, z, i, ((k - 1) * 3 + z) * 4 + i + 1 AS nonce FROM k, (SELECT unnest(range(0, 3)) AS z), (SELECT unnest(range(0, 4)) AS i)")
def counter(spark, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select("source").distinct().withColumn("k", F.row_number().over(Window.orderBy("source")).cast("long"))
    grid = keys.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return grid.select("source", "z", "i", (((F.col("k") - 1) * 3 + F.col("z")) * 4 + F.col("i") + 1).alias("nonce"))


@query("u1_concatenate", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url, 'doc' AS kind FROM documents UNION ALL SELECT page_id, NULL, url, 'page' FROM pages")
def concatenate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("doc").alias("kind"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("page").alias("kind"))
    return docs.unionByName(pages, allowMissingColumns=True).select("id", "lang", "url", "kind")


@query("u2_group_overlap", "SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def group_overlap(spark, sf_dir: str) -> DataFrame:
    return overlapping_groups(table(spark, sf_dir, "orders").withColumn("split", F.col("o_orderkey") % 3), "o_custkey", "split")


def overlapping_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


@query("u3_set_comparison", "WITH a AS (SELECT DISTINCT source FROM documents WHERE n_chars > 20000), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 3000) SELECT 'both' AS side, source FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', source FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', source FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_comparison(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a, b = docs.where("n_chars > 20000").select("source").distinct(), docs.where("lang = 'de' AND n_chars > 3000").select("source").distinct()
    named = lambda name, df: df.select(F.lit(name).alias("side"), "source")
    return named("both", a.intersect(b)).unionByName(named("left", a.exceptAll(b))).unionByName(named("right", b.exceptAll(a)))


@query("u4_three_way", "SELECT source, max(CAST(lang = 'de' AS INTEGER)) AS in_de, max(CAST(lang = 'es' AS INTEGER)) AS in_es, max(CAST(lang = 'fr' AS INTEGER)) AS in_fr FROM documents WHERE n_chars > 4000 GROUP BY 1")
def three_way(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars > 4000")
    return docs.groupBy("source").agg(*(F.max((F.col("lang") == x).cast("int")).alias(f"in_{x}") for x in ("de", "es", "fr")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@query("u5_mean_jaccard", "WITH g AS (SELECT source, list(DISTINCT lang || (n_chars // 1000)) AS v FROM documents GROUP BY 1) SELECT count(*) AS pairs, round(avg(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v)))), 6) AS mean_jaccard FROM g a JOIN g b ON a.source < b.source")
def mean_jaccard(spark, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set(F.concat("lang", F.floor(F.col("n_chars") / 1000))).alias("v"))
    a, b = sets.alias("a"), sets.alias("b")
    return a.join(b, F.col("a.source") < F.col("b.source")).agg(F.count("*").alias("pairs"), F.round(F.avg(jaccard(F.col("a.v"), F.col("b.v"))), 6).alias("mean_jaccard"))


# splits


@query("v1_group_holdout", f"WITH {SPLITS} SELECT key_id, split FROM sp")
def group_holdout(spark, sf_dir: str) -> DataFrame:
    return key_splits(samples(spark, sf_dir))


@query("v2_trainval_test", f"WITH {SAMPLES}, {SPLITS}, j AS (SELECT s.key_id, CASE WHEN split = 'test' THEN 'test' ELSE 'trainval' END AS split2 FROM s JOIN sp USING (key_id)) SELECT split2, count(*) AS n, count(DISTINCT key_id) AS keys, (SELECT count(*) FROM (SELECT key_id FROM j GROUP BY 1 HAVING count(DISTINCT split2) > 1)) AS shared_keys FROM j GROUP BY 1")
def trainval_test(spark, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir)
    joined = df.join(key_splits(df), "key_id").withColumn("split2", remap(F.col("split")))
    shared = overlapping_groups(joined, "key_id", "split2").agg(F.count("*").alias("shared_keys"))
    return joined.groupBy("split2").agg(F.count("*").alias("n"), F.countDistinct("key_id").alias("keys")).crossJoin(shared)


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold of each group: groups by falling size are dealt to and fro, so that fold sizes are close and no group is
    in two folds. Ties go by group name."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.orderBy(F.desc("n"), group)) - 1
    place = r % (2 * k)
    return sizes.select(group, "n", F.least(place, 2 * k - 1 - place).alias("fold"))


@query("v3_group_kfold", "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT source, n, (row_number() OVER (ORDER BY n DESC, source) - 1) % 10 AS p FROM g) SELECT source, n, CAST(least(p, 9 - p) AS INTEGER) AS fold FROM r")
def group_kfold(spark, sf_dir: str) -> DataFrame:
    return group_folds(table(spark, sf_dir, "documents"), "source")
