"""Corpus pipeline: quality classifier, quality rules, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import common, decontamination, packing, quality_qda, quality_rules, simhash_groups, tokens


def _own(docs: DataFrame) -> str:
    """A beginning of the names of columns that a stage adds and drops again; none of docs' has it."""
    prefix = "__stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant does not reject."""
    model = quality_qda.fit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    own = _own(docs)
    return quality_qda.classify(docs, model, prefix=own).filter(f"{own}predicted = 1").select(common.quoted(docs.columns))


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    model = quality_rules.fit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    own = _own(docs)
    return quality_rules.judge(docs, model, prefix=own).filter(f"{own}kept").select(common.quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word-shingle similarity 0.8 or more."""
    return simhash_groups.first_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10-word window with a benchmark item."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: A discriminant and boosted trees are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Each but the last is written to the shared folder and read again, as stages
    number rows and read their input more than once."""
    docs = common.read(spark, sf_dir, "documents")
    folder = common.shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        docs = stage(spark, docs, sf_dir)
    return docs
