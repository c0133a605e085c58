"""From documents to token ids in five stages: rules, classifier, near-dedup, mixing, encoding.

Every stage works on all rows that the stage before it kept. All but the last
return the columns of documents. Rows are told apart by a hash of id and text,
so null and repeated ids do no harm.

Null and empty texts have fewer words than the base rule asks for and go in the
first stage. Null languages and sources are groups of their own. Rows with a
null id pass near-dedup; of rows that repeat an id, one passes. Mixing repeats
rows, or leaves them out, by their source's target. Texts are used whole,
however long. An empty table passes all stages as an empty table. Columns other
than those of documents are not carried on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, kneser_ney, mixing, near_dedup, quality_rules
from panelspark.llm.util import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Hashes of rejected rows are broadcast up to this number (8 bytes each), and joined by shuffle beyond it.
BROADCAST_ROWS = 500_000
ROW = "__row"


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs less the rows whose hash (ROW) is among rejected."""
    gone = mixing.small(cut(rejected.select(ROW).distinct(), "pipeline_rejected"), BROADCAST_ROWS)
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text")).join(gone, ROW, "left_anti").drop(ROW)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality_rules.judge(docs.withColumn(ROW, F.xxhash64("doc_id", "text")), key=ROW)
    return _without(docs, judged.where(~F.col("kept"))).select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of trusted text doesn't reject."""
    judged = kneser_ney.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), also=F.xxhash64("doc_id", "text"))
    return _without(docs, judged.where(~F.col("kept")).withColumnRenamed("also", ROW)).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; of rows that repeat an id, one."""
    grouped = near_dedup.groups(docs)
    rejected = grouped.where(~F.col("kept")).select(F.xxhash64("doc_id").alias(ROW)).distinct()
    gone = mixing.small(cut(rejected, "pipeline_copies"), BROADCAST_ROWS)
    left = docs.withColumn(ROW, F.xxhash64("doc_id")).join(gone, ROW, "left_anti")
    twice = cut(left.where("doc_id is not null").groupBy(ROW).count().where("count > 1").select(ROW), "pipeline_twice")
    if twice.limit(1).count():
        again = mixing.small(twice, BROADCAST_ROWS)
        left = left.join(again, ROW, "left_anti").unionByName(left.join(again, ROW, "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: digests of both."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near dedup", dedup), ("mixing", mix), ("byte bpe", encode)]

#: Model estimates and near-duplicate components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
