"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylume.llm import decontaminate, jaccard_join, packing, pii, toxicity
from paylume.llm.shared import written


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rejected as toxic by their nearest labelled examples."""
    index = toxicity.fit(docs, toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 3, 1))
    bad = toxicity.score(docs, index).where("score >= 0.7").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked copies, the one with the least id. Links are of sets of five words with a
    Jaccard similarity of 0.8 or more. Rows with a null id are linked with nothing and all stay."""
    groups = jaccard_join.classes(docs.where("doc_id IS NOT NULL"), size=5, percent=80)
    copies = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without spans of benchmark items; documents that mostly are such spans go."""
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_length(decontaminate.remove(docs, found), docs)


def without_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return with_length(pii.replace(docs), docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def with_length(changed: DataFrame, docs: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else changed


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
#: Neither the votes of the toxicity stage nor a tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
