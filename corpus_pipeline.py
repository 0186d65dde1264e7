"""The corpus pipeline: STAGES in order, each over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringweave.llm import common, decontaminate, mixing, quality, secrets, simhash, simhash_texts


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts score as the share of good labels; repeated rows all stay or all go."""
    model = quality.learned(spark, docs, sf_dir)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return quality.score(rows, model).filter(F.col("score") >= quality.LEAST).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id, a row without an id only where none has one. Texts without words are one group."""
    return simhash.deduplicated(docs, simhash_texts.similar_texts(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it stands or with other numbers, names or units. Null and empty texts stay."""
    return decontaminate.without(docs, decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text (null for a null text)."""
    out = secrets.redacted(docs, secrets.scan(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed to the target weights: a row for each document with the words that the mix takes."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            common.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier of the first stage is learned, which SQL can't express.
ORACLE_SQL = None
