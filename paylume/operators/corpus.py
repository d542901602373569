"""Labelled corpora: key tables, sample grids, text chunks, paired variants, manifests, and their sources and sinks."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow_profile, payload
from ..plans.registry import query
from ..sources.tables import hash_int, sql_hash, table
from .relational import SAMPLES, SPLITS, key_splits, samples

SENTENCE = "The quick brown fox jumps over the lazy dog. "


def folder(spark) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local one on
    one machine, as in tests, and an error on a cluster, whose machines would not see it."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{top}/{uuid.uuid4().hex}"


def key_bytes(key_id: Column, seed: str = "42") -> Column:
    """16 bytes from the seed and the key's id."""
    return F.unhex(F.md5(F.concat_ws("|", F.lit(seed), key_id)))


def encrypted(rows: DataFrame) -> DataFrame:
    """Adds ``ciphertext``: authenticated, bound to the key id, with a 12-byte nonce from the row's id."""
    iv = F.unhex(F.substring(F.md5(F.concat_ws("|", F.lit("nonce"), "doc_id")), 1, 24))
    return rows.withColumn("ciphertext", F.aes_encrypt(F.encode("text", "UTF-8"), key_bytes(F.col("key_id")), F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode("key_id", "UTF-8")))


def xor_repeating(raw: Column, key: Column) -> Column:
    """XOR with a repeating 4-byte key of 25 low bits (little-endian), four bytes at a time; as hexadecimal text; its
    own inverse. Both should be columns of a table, since an expression would be worked out for every four bytes."""
    number = lambda c: F.conv(F.rpad(F.hex(c), 8, "0"), 16, 10).cast("long")
    word = number(key.substr(1, 4)).bitwiseAND(F.lit(0xFFFFFF01))
    n = F.octet_length(raw)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n + 3) / 4).cast("int")), lambda i: F.lpad(F.hex(number(raw.substr(i * 4 + 1, F.lit(4))).bitwiseXOR(word)), 8, "0"))
    return F.substring(F.array_join(pieces, ""), F.lit(1), n * 2)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generated array of one, so that lambdas over them don't work them out again."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")).select(*df.columns, "_once.*")


def manifest(rows: DataFrame) -> DataFrame:
    """One row: parameters and statistics as a nested value."""
    by_class = rows.groupBy("algorithm").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("algorithm", "n")))).alias("by_class"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("len_ct").alias("bytes"), F.min("len_ct").alias("least"), F.max("len_ct").alias("most"), F.countDistinct("key_id").alias("keys"))
    return totals.crossJoin(by_class).select(F.struct(F.lit("1.0").alias("version"), F.lit(42).alias("seed"), F.struct("n", "keys", "bytes", "least", "most").alias("totals"), "by_class").alias("manifest"))


# sources


@query("s3_corpus_scan", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE strlen(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 1000")
def corpus_scan(spark, sf_dir: str) -> DataFrame:
    """Texts with white space folded, of 1000 bytes or more; what is not UTF-8 is dropped."""
    return clean_texts(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "text")


def clean_texts(files: DataFrame, least: int = 1000) -> DataFrame:
    """Of a binary ``content`` column, as Spark's binary file source gives it."""
    text = files.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("text", F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s+", " ")))
    return text.where(F.octet_length("text") >= least)


def read_texts(spark, path: str, names: str = "*.txt", least: int = 1000) -> DataFrame:
    """``path, text`` of the files under a folder, at any depth, whose names match a pattern: UTF-8 ones only, white space
    folded, of ``least`` bytes or more. A file is one row, so it has to fit in a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return clean_texts(files, least).select("path", "text")


CORPUS_FILES = r"""
WITH w AS (SELECT source, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text <> '')
SELECT source, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(list_sum(list_transform(w, lambda x: length(x)))) AS BIGINT) AS n_chars FROM w GROUP BY 1
"""


@query("s3_corpus_files", CORPUS_FILES)
def corpus_files(spark, sf_dir: str) -> DataFrame:
    """Writes the documents as text files in a folder for each source, at most 500 of them in a file, reads the tree back as
    files and counts words and characters."""
    path = folder(spark)
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("source", F.col("text").alias("value"))
    docs.write.partitionBy("source").option("maxRecordsPerFile", 500).text(path)
    found = read_texts(spark, path, "part-*", 1)
    words = found.select(F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1)).alias("source"), F.explode(F.split(F.trim("text"), " ")).alias("w")).where("w <> ''")
    return words.groupBy("source").agg(F.count("*").alias("n_words"), F.sum(F.char_length("w")).alias("n_chars"))


@query("s4_json_scan", f"WITH {SPLITS} SELECT split, key_id FROM sp WHERE split IS NOT NULL")
def json_scan(spark, sf_dir: str) -> DataFrame:
    """Writes the splits document, reads it back as multi-line JSON and flattens it."""
    path = folder(spark)
    splits_document(samples(spark, sf_dir)).write.json(path)
    found = spark.read.schema("seed int, train array<string>, val array<string>, test array<string>").option("multiLine", True).json(path)
    return found.select(F.explode(F.create_map(F.lit("train"), "train", F.lit("val"), "val", F.lit("test"), "test")).alias("split", "keys")).select("split", F.explode("keys").alias("key_id"))


def splits_document(rows: DataFrame) -> DataFrame:
    lists = [F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("key_id")))).alias(s) for s in ("train", "val", "test")]
    return key_splits(rows).agg(F.lit(42).alias("seed"), *lists)


def record_blocks(spark, path: str) -> DataFrame:
    """Blocks of ``k = v`` lines with blank lines between: count, key, nonce, pt, ad, ct as bytes, and ``bad`` with a
    block that lacks one of Count, Key, Nonce or CT. Empty values are empty bytes, line ends may be CRLF."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("value", F.regexp_replace("value", "\r", "")).withColumn("value", F.explode(F.split("value", "\n\n+"))).where(F.trim(F.regexp_replace("value", "\n", "")) != "")
    field = lambda name: F.when(F.col("value").rlike(rf"(?m)^{name} *="), F.regexp_extract("value", rf"(?m)^{name} *= *([^\n]*)$", 1))
    bad = field("Count").isNull() | field("Key").isNull() | field("Nonce").isNull() | field("CT").isNull()
    hexed = lambda name: F.unhex(F.trim(F.coalesce(field(name), F.lit("")))).alias(name.lower())
    return blocks.select(F.trim(field("Count")).cast("long").alias("count"), *(hexed(n) for n in ("Key", "Nonce", "PT", "AD", "CT")), F.when(bad, F.col("value")).alias("bad"))


@query("s5_record_blocks", f"WITH {SAMPLES} SELECT doc_id AS count, upper(md5('42|' || key_id)) AS key, CASE WHEN doc_id % 3 = 0 THEN '' ELSE hex(encode(sample_id)) END AS pt, hex(encode(algorithm)) AS ct, doc_id % 10 = 7 AS is_bad FROM s")
def scan_record_blocks(spark, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows = samples(spark, sf_dir)
    pt = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.hex(F.encode("sample_id", "UTF-8")))
    lines = F.concat_ws("\n", F.format_string("Count = %d", "doc_id"), F.concat(F.lit("Key = "), F.hex(key_bytes(F.col("key_id")))), F.when(F.col("doc_id") % 10 != 7, F.concat(F.lit("Nonce = "), F.md5("sample_id"))), F.concat(F.lit("PT = "), pt), F.lit("AD = "), F.concat(F.lit("CT = "), F.hex(F.encode("algorithm", "UTF-8"))), F.lit(""))
    rows.select(lines.alias("value")).write.text(path)
    return record_blocks(spark, path).select("count", F.hex("key").alias("key"), F.hex("pt").alias("pt"), F.hex("ct").alias("ct"), F.col("bad").isNotNull().alias("is_bad"))


# sinks and stages


@query("s6_parquet_sink", f"WITH {SAMPLES}, {SPLITS} SELECT split, count(*) AS n FROM s JOIN sp USING (key_id) GROUP BY 1")
def parquet_sink(spark, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), samples(spark, sf_dir)
    rows.join(key_splits(rows), "key_id").drop("text").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("s7_json_sink", f"WITH {SAMPLES} SELECT '1.0' AS version, CAST(42 AS BIGINT) AS seed, count(*) AS n FROM s")
def json_sink(spark, sf_dir: str) -> DataFrame:
    path = folder(spark)
    manifest(samples(spark, sf_dir)).select("manifest.*").write.json(path)
    return spark.read.json(path).select("version", "seed", F.col("totals.n").alias("n"))


def exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def fingerprint(df: DataFrame, **parameters) -> str:
    """Of what a result comes from: the plan, the parameters, and the places, sizes and times of the files read. The files
    are summed up by Spark; none of their contents is read."""
    spark = df.sparkSession
    files = df.inputFiles()
    read = spark.read.format("binaryFile").load(files).agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first() if files else ()
    plan = re.sub(r"#[0-9]+L?|plan_id=[0-9]+", "", df._jdf.queryExecution().optimizedPlan().toString())
    return hashlib.sha256(json.dumps([plan, sorted(parameters.items()), [str(x) for x in read]], default=str).encode()).hexdigest()


COMMIT = "fingerprint string, data string, at timestamp"


def committed(spark, path: str) -> list[tuple[str, str]]:
    """Fingerprints and data folders of the results that are complete at a path, in the order of their commits. A record is
    one small file that appears when its job is committed, so that what was half written has none."""
    if not exists(spark, path + "/commits"):
        return []
    rows = spark.read.schema(COMMIT).json(path + "/commits").orderBy("at", "data").collect()
    return [(r["fingerprint"], r["data"]) for r in rows]


def commit(df: DataFrame, path: str, mark: str) -> str:
    """Writes rows to a new folder under the path, then a record of it; the folder."""
    spark = df.sparkSession
    data = f"{path}/data-{uuid.uuid4().hex}"
    df.write.parquet(data)
    record = spark.range(1).select(F.lit(mark).alias("fingerprint"), F.lit(data).alias("data"), F.current_timestamp().alias("at"))
    record.coalesce(1).write.mode("append").json(path + "/commits")
    return data


def stage(df: DataFrame, path: str, **parameters) -> DataFrame:
    """The stage at a path: read if a complete result of the same inputs, plan and parameters is there, else written first.
    Changed inputs or parameters make a new result beside the old one."""
    spark, mark = df.sparkSession, fingerprint(df, **parameters)
    done = dict(committed(spark, path))
    return spark.read.schema(df.schema).parquet(done[mark] if mark in done else commit(df, path, mark))


@query("s9_reused_stage", f"WITH {SAMPLES} SELECT algorithm, count(*) AS n, CAST(1 AS INTEGER) AS written FROM s GROUP BY 1")
def reused_stage(spark, sf_dir: str) -> DataFrame:
    """A stage asked for twice, written once."""
    path = folder(spark)
    rows = samples(spark, sf_dir).drop("text")
    stage(rows, path)
    return stage(rows, path).groupBy("algorithm").agg(F.count("*").alias("n")).withColumn("written", F.lit(len(committed(spark, path))))


def incremental(path: str, rows: DataFrame, compute, key: str) -> DataFrame:
    """Results by key at a path: those that are there, and those of ``compute`` for the rows whose key is not among them,
    which are added in one commit. Keys are unique. The columns are those of ``compute``."""
    spark = rows.sparkSession
    parts = [data for _, data in committed(spark, path)]
    new = rows if not parts else rows.join(spark.read.parquet(*parts).select(key), key, "left_anti")
    made = compute(new)
    data = commit(made, path, "increment")
    return spark.read.schema(made.schema).parquet(*parts, data)


@query("s10_incremental", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS batch, len_pt AS v FROM s")
def incremental_stage(spark, sf_dir: str) -> DataFrame:
    """Even ids first, then all of them: the second time only odd ones are worked out."""
    path = folder(spark)
    rows = samples(spark, sf_dir)
    work = lambda batch: lambda df: df.select("doc_id", F.lit(batch).alias("batch"), F.col("len_pt").alias("v"))
    incremental(path, rows.where("doc_id % 2 = 0"), work(1), "doc_id")
    return incremental(path, rows, work(2), "doc_id")


# generation


@query("g1_key_table", "SELECT source AS key_id, upper(md5('42|' || source)) AS key_hex FROM (SELECT DISTINCT source FROM documents)")
def key_table(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("key_id")).distinct().select("key_id", F.hex(key_bytes(F.col("key_id"))).alias("key_hex"))


GRID = "k AS (SELECT source AS key_id, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)), grid AS MATERIALIZED (SELECT key_id, size, i, ((k - 1) * 3 + z) * 6 + i + 1 AS nonce FROM k, (VALUES (0, 64), (1, 256), (2, 1024)) t(z, size), (SELECT unnest(range(0, 6)) AS i))"
SIZES = [64, 256, 1024]


def sample_grid(spark, sf_dir: str, sizes: list[int] = SIZES, per: int = 6) -> DataFrame:
    """Keys x sizes x samples with a shared nonce counter from the grid's coordinates."""
    from pyspark.sql import Window

    keys = table(spark, sf_dir, "documents").select(F.col("source").alias("key_id")).distinct().withColumn("k", F.row_number().over(Window.orderBy("key_id")).cast("long"))
    grid = keys.select("key_id", "k", F.posexplode(F.array(*map(F.lit, sizes))).alias("z", "size")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per - 1).cast("long"))))
    return grid.select("key_id", "size", "i", (((F.col("k") - 1) * len(sizes) + F.col("z")) * per + F.col("i") + 1).alias("nonce"))


@query("g2_sample_grid", f"WITH {GRID} SELECT * FROM grid")
def grid(spark, sf_dir: str) -> DataFrame:
    return sample_grid(spark, sf_dir)


#: Tries for a chunk, and how many of them all rows make; only rows without a fitting chunk go on to the others.
TRIES, FIRST_TRIES = 2000, 8


def _tried(grid_rows: DataFrame, ranked: DataFrame, low: int, high: int) -> DataFrame:
    """The first fitting chunk of each row among the tries from ``low`` to below ``high``."""
    last = ranked.agg(F.max("doc_id").alias("last"))
    tries = grid_rows.crossJoin(last).withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    tries = tries.withColumn("doc_id", F.pmod(hash_int("doc", F.col("nonce"), F.col("t")), F.col("last") + 1))
    found = tries.join(ranked, "doc_id").where(F.octet_length("raw") >= F.col("size"))
    found = found.withColumn("at", F.pmod(hash_int("at", F.col("nonce"), F.col("t")), F.octet_length("raw") - F.col("size") + 1).cast("int"))
    inner = lambda at: F.hex(F.col("raw").substr(at + 1, F.lit(1))).rlike("^[89AB]")
    fine = found.where(~inner(F.col("at")) & ~inner(F.col("at") + F.col("size")))
    return fine.groupBy("nonce").agg(F.min(F.struct("t", F.col("raw").substr(F.col("at") + 1, F.col("size")).alias("chunk"))).alias("best"))


def chunks(grid_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """A text chunk of exactly ``size`` bytes that is valid UTF-8 for each row: of 2000 hash-picked documents and
    offsets the first that neither starts nor ends inside a character, else a repeated ASCII sentence; size 0 is
    empty."""
    ranked = docs.where("text IS NOT NULL").select(F.col("doc_id"), F.encode("text", "UTF-8").alias("raw"))
    first = _tried(grid_rows, ranked, 0, FIRST_TRIES)
    rest = _tried(grid_rows.join(first, "nonce", "left_anti"), ranked, FIRST_TRIES, TRIES)
    filler = F.expr(f"substring(repeat('{SENTENCE}', CAST(size / {len(SENTENCE)} AS INT) + 1), 1, size)")
    source = F.when(F.col("size") == 0, "empty").when(F.col("best").isNull(), "fallback").otherwise("corpus")
    return grid_rows.join(first.unionByName(rest), "nonce", "left").select("nonce", "key_id", "size", "i", F.coalesce(F.decode("best.chunk", "UTF-8"), filler).alias("text"), source.alias("plaintext_source"))


def _tries_sql(name: str, rows: str, low: int, high: int) -> str:
    return (
        f"t{name} AS (SELECT nonce, size, t, {sql_hash(chr(39) + 'doc' + chr(39), 'nonce', 't')} % ((SELECT max(doc_id) FROM documents) + 1) AS doc_id FROM {rows}, (SELECT unnest(range({low}, {high})) AS t)), "
        f"f{name} AS (SELECT nonce, size, t, hx, n, {sql_hash(chr(39) + 'at' + chr(39), 'nonce', 't')} % (n - size + 1) AS place FROM t{name} JOIN d USING (doc_id) WHERE n >= size), "
        f"{name} AS MATERIALIZED (SELECT nonce, first(c ORDER BY t) AS c FROM (SELECT nonce, t, substr(hx, CAST(2 * place + 1 AS BIGINT), CAST(2 * size AS BIGINT)) AS c FROM f{name} WHERE substr(hx, CAST(2 * place + 1 AS BIGINT), 1) NOT IN ('8', '9', 'A', 'B') AND (place + size = n OR substr(hx, CAST(2 * (place + size) + 1 AS BIGINT), 1) NOT IN ('8', '9', 'A', 'B'))) GROUP BY 1)"
    )


@query(
    "g3_chunk_sampling",
    f"WITH {GRID}, d AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents), "
    + _tries_sql("a", "grid", 0, FIRST_TRIES) + ", left_over AS (SELECT * FROM grid WHERE nonce NOT IN (SELECT nonce FROM a)), " + _tries_sql("b", "left_over", FIRST_TRIES, TRIES) + ", u AS (SELECT * FROM a UNION ALL SELECT * FROM b) "
    f"SELECT grid.nonce, size, coalesce(md5(decode(unhex(c))), md5(substr(repeat('{SENTENCE}', CAST(size // {len(SENTENCE)} AS BIGINT) + 1), 1, size))) AS text_md5, CASE WHEN c IS NULL THEN 'fallback' ELSE 'corpus' END AS plaintext_source FROM grid LEFT JOIN u USING (nonce)",
)
def chunk_sampling(spark, sf_dir: str) -> DataFrame:
    made = chunks(sample_grid(spark, sf_dir), table(spark, sf_dir, "documents"))
    return made.select("nonce", "size", F.md5("text").alias("text_md5"), "plaintext_source")


def pattern(index: Column, size: Column) -> Column:
    """Zeros, ones, a 16-character block or a 4-byte counter, by the index in turn; hexadecimal text."""
    return F.when(index % 4 == 0, F.expr("repeat('00', CAST(size AS INT))")).when(index % 4 == 1, F.expr("repeat('FF', CAST(size AS INT))")).when(index % 4 == 2, F.expr("substring(repeat(hex(encode('ABCDEFGHIJKLMNOP', 'UTF-8')), CAST(size / 16 AS INT) + 1), 1, CAST(2 * size AS INT))")).otherwise(F.expr("substring(array_join(transform(sequence(0, CAST(size / 4 AS INT)), x -> lpad(hex(x), 8, '0')), ''), 1, CAST(2 * size AS INT))"))


@query("g4_repetitive", f"WITH {GRID} SELECT nonce, CASE WHEN i % 4 = 0 THEN repeat('00', size) WHEN i % 4 = 1 THEN repeat('FF', size) WHEN i % 4 = 2 THEN substr(repeat(hex(encode('ABCDEFGHIJKLMNOP')), size // 16 + 1), 1, 2 * size) ELSE substr(array_to_string(list_transform(range(0, size // 4 + 1), lambda x: printf('%08X', x)), ''), 1, 2 * size) END AS hexed FROM grid")
def repetitive(spark, sf_dir: str) -> DataFrame:
    return sample_grid(spark, sf_dir).select("nonce", pattern(F.col("i"), F.col("size")).alias("hexed"))


def variants(rows: DataFrame) -> DataFrame:
    """Each row once under each variant, with the same key, nonce and text: block mode, repeating XOR, authenticated."""
    rows = once(rows, _raw=F.encode("text", "UTF-8"), _key=key_bytes(F.col("key_id")))
    raw, key = F.col("_raw"), F.col("_key")
    iv = F.unhex(F.substring(F.md5(F.concat_ws("|", F.lit("nonce"), "nonce")), 1, 24))
    made = F.array(
        F.struct(F.lit("block").alias("algorithm"), F.aes_encrypt(raw, key, F.lit("ECB"), F.lit("PKCS")).alias("ciphertext")),
        F.struct(F.lit("xor").alias("algorithm"), F.unhex(xor_repeating(raw, key)).alias("ciphertext")),
        F.struct(F.lit("aead").alias("algorithm"), F.aes_encrypt(raw, key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode("key_id", "UTF-8")).alias("ciphertext")),
    )
    return rows.withColumn("v", F.explode(made)).select("nonce", "key_id", "size", "i", "v.algorithm", "v.ciphertext", F.octet_length("v.ciphertext").cast("long").alias("len_ct"))


@query("g5_paired_variants", f"WITH {GRID} SELECT nonce, algorithm, CAST(CASE algorithm WHEN 'block' THEN (size // 16 + 1) * 16 WHEN 'xor' THEN size ELSE size + 28 END AS BIGINT) AS len_ct FROM grid, (VALUES ('block'), ('xor'), ('aead')) v(algorithm)")
def paired_variants(spark, sf_dir: str) -> DataFrame:
    made = chunks(sample_grid(spark, sf_dir), table(spark, sf_dir, "documents"))
    return variants(made).select("nonce", "algorithm", "len_ct")


@query("g6_block_variant", f"WITH {SAMPLES} SELECT doc_id, (len_pt // 16 + 1) * 16 AS len_ct, true AS opens FROM s")
def block_variant(spark, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("raw", F.encode("text", "UTF-8")).withColumn("key", key_bytes(F.col("key_id")))
    made = rows.withColumn("ct", F.aes_encrypt("raw", "key", F.lit("ECB"), F.lit("PKCS")))
    return made.select("doc_id", F.octet_length("ct").cast("long").alias("len_ct"), (F.aes_decrypt("ct", "key", F.lit("ECB"), F.lit("PKCS")) == F.col("raw")).alias("opens"))


XOR_SQL = "printf('%02X', xor(CAST('0x' || substr(hx, 2 * i + 1, 2) AS INTEGER), CASE WHEN i % 4 = 3 THEN CAST('0x' || substr(k, 7, 2) AS INTEGER) & 1 ELSE CAST('0x' || substr(k, 2 * (i % 4) + 1, 2) AS INTEGER) END))"


@query("g7_xor_variant", f"WITH {SAMPLES}, b AS (SELECT doc_id, md5('42|' || key_id) AS k, hex(encode(text)) AS hx, unnest(range(0, CAST(len_pt AS BIGINT))) AS i FROM s), x AS (SELECT doc_id, md5(string_agg({XOR_SQL}, '' ORDER BY i)) AS m FROM b GROUP BY doc_id) SELECT s.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(m, md5('')) END AS hexed_md5, CASE WHEN text IS NOT NULL THEN true END AS opens FROM s LEFT JOIN x ON s.doc_id = x.doc_id")
def xor_variant(spark, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("payload"), key_bytes(F.col("key_id")).alias("key"))
    return arrow_profile.xor_digests(rows).withColumnRenamed("id", "doc_id")


@query("g8_authenticated_variant", f"WITH {SAMPLES} SELECT doc_id, len_pt + 28 AS len_ct, true AS opens, true AS wrong_key_fails, true AS wrong_aad_fails FROM s")
def authenticated_variant(spark, sf_dir: str) -> DataFrame:
    rows = encrypted(samples(spark, sf_dir)).withColumn("key", key_bytes(F.col("key_id"))).withColumn("other", key_bytes(F.col("key_id"), "43"))
    opened = lambda key, aad: F.expr(f"try_aes_decrypt(ciphertext, {key}, 'GCM', 'DEFAULT', encode({aad}, 'UTF-8'))")
    return rows.select("doc_id", F.octet_length("ciphertext").cast("long").alias("len_ct"), (opened("key", "key_id") == F.encode("text", "UTF-8")).alias("opens"), opened("other", "key_id").isNull().alias("wrong_key_fails"), opened("key", "'x'").isNull().alias("wrong_aad_fails"))


def random_payloads(rows: DataFrame, seed: str = "42") -> DataFrame:
    """Rows with as many hash-made bytes as ``size`` asks for, nonces moved by a million."""
    many = F.ceil(F.col("size") / 32).cast("int")
    blocks = F.array_join(F.transform(F.sequence(F.lit(1), many), lambda b: F.sha2(F.concat_ws("|", F.lit(seed), F.col("nonce").cast("string"), b.cast("string")), 256)), "")
    made = rows.withColumn("ciphertext", F.unhex(blocks).substr(F.lit(1), F.col("size")))
    return made.select((F.col("nonce") + 1_000_000).alias("nonce"), "key_id", "size", "i", F.lit("random").alias("algorithm"), "ciphertext")


@query("g9_random_control", f"WITH {GRID} SELECT nonce + 1000000 AS nonce, key_id, upper(substr(array_to_string(list_transform(range(1, CAST(ceil(size / 32) AS BIGINT) + 1), lambda b: sha256(printf('42|%d|%d', grid.nonce, b))), ''), 1, 2 * size)) AS hexed FROM grid")
def random_control(spark, sf_dir: str) -> DataFrame:
    return random_payloads(sample_grid(spark, sf_dir)).select("nonce", "key_id", F.hex("ciphertext").alias("hexed"))


@query("g10_flat_table")
def flat_table(spark, sf_dir: str) -> DataFrame:
    """Text, associated data, body, tag, key and nonce side by side."""
    rows = encrypted(samples(spark, sf_dir))
    cut = F.octet_length("ciphertext") - 16
    return rows.select(F.encode("text", "UTF-8").alias("pt"), F.encode("key_id", "UTF-8").alias("ad"), F.col("ciphertext").substr(F.lit(13), cut - 12).alias("ct"), F.col("ciphertext").substr(cut + 1, F.lit(16)).alias("tag"), key_bytes(F.col("key_id")).alias("key"), F.col("ciphertext").substr(F.lit(1), F.lit(12)).alias("nonce"), "sample_id", "len_pt")


#: Payload sizes of the sweep (fixed values).
SWEEP = [16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384]


@query("g11_size_sweep", "SELECT size, count(*) * 2 AS n FROM (SELECT DISTINCT source FROM documents), (SELECT unnest([16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384]) AS size) GROUP BY 1")
def size_sweep(spark, sf_dir: str) -> DataFrame:
    return random_payloads(sample_grid(spark, sf_dir, SWEEP, 2)).groupBy("size").agg(F.count("*").alias("n"))


@query("g12_confidential_split", f"WITH {SAMPLES} SELECT sample_id, len_ct + 12 AS len_ct, md5(text) AS side_md5, true AS public_is_clean FROM s")
def confidential_split(spark, sf_dir: str) -> DataFrame:
    """The public table without key, nonce or text, and the side table that holds the text, joined for comparison."""
    rows = encrypted(samples(spark, sf_dir)).withColumn("len_ct", F.octet_length("ciphertext").cast("long"))
    public, side = rows.select("sample_id", "algorithm", "key_id", "len_ct", "ciphertext"), rows.select("sample_id", "text")
    clean = not {"text", "key", "nonce"} & set(public.columns)
    return public.join(side, "sample_id").select("sample_id", "len_ct", F.md5("text").alias("side_md5"), F.lit(clean).alias("public_is_clean"))


@query("g13_manifest", f"WITH {SAMPLES} SELECT count(*) AS n, CAST(sum(len_ct) AS BIGINT) AS bytes, min(len_ct) AS least, max(len_ct) AS most, count(DISTINCT key_id) AS keys, (SELECT string_agg(algorithm || ':' || n, ',' ORDER BY algorithm) FROM (SELECT algorithm, count(*) AS n FROM s GROUP BY 1)) AS by_class FROM s")
def manifest_row(spark, sf_dir: str) -> DataFrame:
    made = manifest(samples(spark, sf_dir)).select("manifest.totals.*", "manifest.by_class")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("by_class")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return made.select("n", "bytes", "least", "most", "keys", text.alias("by_class"))


@query("g14_assertions", f"WITH {GRID} SELECT count(*) * 3 AS total, true AS even_classes, true AS unique_nonces FROM grid")
def assertions(spark, sf_dir: str) -> DataFrame:
    made = variants(chunks(sample_grid(spark, sf_dir), table(spark, sf_dir, "documents"))).groupBy("algorithm").agg(F.count("*").alias("n"), F.countDistinct("nonce").alias("d"))
    return made.agg(F.sum("n").alias("total"), (F.min("n") == F.max("n")).alias("even_classes"), F.every(F.col("n") == F.col("d")).alias("unique_nonces"))
