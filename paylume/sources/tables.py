"""Readers of the input tables and the payload views made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads: sample id, label (language), group (source), and the UTF-8 bytes of the text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("source").alias("key_id"), F.encode("text", "UTF-8").alias("payload"))


def hash_int(*parts: Column | str) -> Column:
    """A number below 2**32 from the md5 of the parts joined by ``|``: equal on any engine and any partitioning."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: DuckDB: payload bytes as hexadecimal text, and one row per byte (position from 1).
SQL_P = "p AS MATERIALIZED (SELECT doc_id AS id, lang AS label, source AS key_id, encode(text) AS payload, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents)"
SQL_B = SQL_P + ", b AS MATERIALIZED (SELECT id, label, n, i AS pos, CAST('0x' || substr(hx, 2 * i - 1, 2) AS INTEGER) AS x FROM (SELECT id, label, n, hx, unnest(range(1, n + 1)) AS i FROM p))"


def sql_hash(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8) AS BIGINT)"
