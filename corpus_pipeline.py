"""The corpus pipeline: toxic and near-duplicate documents and those of benchmarks go, sources are mixed to
target weights, and what is left becomes token files.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. ``run`` writes each stage's
result as Parquet in the folder that all executors share and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdmspark.llm.common import fresh_folder, table
from pdmspark.llm.decontamination import decontaminate
from pdmspark.llm.mixing import mix
from pdmspark.llm.simhash import simhash_dedup
from pdmspark.llm.tokens import default_tokenizer, token_rows
from pdmspark.llm.toxicity import drop_toxic


#: Pieces of text that a worker of the last stage remembers: fewer than in op2, as the workers of the other stages live on.
REMEMBERED = 500_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near-duplicates stays."""
    return simhash_dedup(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents in training order, a row each time one is used.

    Partitions are ranges of positions, sorted within, so the files written from them hold that order.
    """
    return mix(docs).drop("position")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token files in training order; a row for each document in them.

    The order is that of the rows in the Parquet files they were read from: by the part number in the name of the file
    (as a number: part-100000 comes after part-99999; names without one come first), by name, then by place in it. Rows
    that come from no file are in ascending order of id. Rows derived from files but no longer those of a file are refused.
    """
    order = []
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        part = F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS BIGINT)")
        docs = docs.select("doc_id", "text", part.alias("_part"), name.alias("_file"), F.col("_metadata.row_index").alias("_place"))
        order = ["_part", "_file", "_place"]
    return token_rows(docs, fresh_folder(spark, "token-files"), default_tokenizer(), order, REMEMBERED)


STAGES = [("toxicity", toxicity), ("simhash", near_dedup), ("decontamination", benchmarks), ("mixing", mixture), ("tokens", token_files)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``: a row for each document in the token files, in training order.

    Null texts count as empty; of near-duplicates, equal texts included, the row of the least id stays. An empty table gives
    no rows. Each stage's result is kept as Parquet in the shared folder, so a lost executor costs tasks and no stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
