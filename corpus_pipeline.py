"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the columns
of documents.

Defined cases: null or empty texts fail the quality rules; rows of one doc_id are judged by their own texts, but for near copies they
are one document; of rows with equal doc_id and text one stays; a null doc_id is a document like another; a very long text is
judged whole; at a limit, each operator's docstring says which side; empty tables give no rows; extra columns go through to the
stage before packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.jaccard_join import jaccard_components
from ledgerloom.llm.packing import pack
from ledgerloom.llm.personal_data import redact
from ledgerloom.llm.quality_rules import cleaned
from ledgerloom.llm.store import keep, only_last, without

#: Near copies of the pipeline share this percentage of their runs of so many words; op7_jaccard_join has bounds of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines."""
    return cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the smallest doc_id; of rows that are equal in doc_id and text, one."""
    found = jaccard_components(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = without(docs, found.where("component_id is not null and not (doc_id <=> component_id)"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight."""
    return without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer; the whole run is tested against plain code (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with only_last():
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
