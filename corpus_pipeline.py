"""A corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dermotrace.llm import decontaminate, exact_dedup, language_id, packing, simhash
from dermotrace.llm.common import numbered, read_table, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the held-in fold teaches; null texts, texts without letters and far-off ones go. Repeated rows stay; no documents, none out."""
    model = language_id.fit(docs.where(language_id.fold("doc_id") != 2))
    return language_id.predict(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest, then the smallest doc_id, then one of them; null and empty texts are equal. No documents, none out."""
    rows = numbered(docs.select(*COLUMNS))
    gone = exact_dedup.exact_duplicates(rows, number="rid").where("not kept").select("rid")
    return rows.join(gone, "rid", "left_anti").select(*COLUMNS)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest doc_id (nulls last), one of tied rows; null and empty texts are one group. No documents, none out."""
    rows = numbered(docs.select(*COLUMNS))
    groups = simhash.near_duplicates(rows.select(F.col("rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    kept = groups.join(rows.select("rid", "doc_id"), "rid").groupBy("component_id").agg(F.min(order).alias("kept")).select("kept.rid")
    return rows.join(kept, "rid", "left_semi").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: null and empty texts stay, and so do repeated rows. No benchmark, nothing goes."""
    benchmark = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    rows = numbered(docs.select(*COLUMNS))
    found = decontaminate.decontaminate(rows.select(F.col("rid").alias("doc_id"), "text"), benchmark)
    return rows.join(found.where("n_hit > 0").select(F.col("doc_id").alias("rid")), "rid", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids; a null or empty text is its end id. No documents, no pieces."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equals),
    ("near_dedup", one_of_near),
    ("decontaminate", uncontaminated),
    ("packing", packed),
]
#: The stages learn, tokenise and walk graphs: SQL can't express them; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents", *COLUMNS), scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
