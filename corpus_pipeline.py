"""The corpus pipeline: language identification, near-duplicates, repeated strings, packing.

Each stage takes the documents that the stage before left and returns documents; the last returns the
packed pieces. Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaril.llm.common import Scratch, read
from sonaril.llm.langid import keep_identified
from sonaril.llm.minhash import keep_one
from sonaril.llm.packing import pack
from sonaril.llm.suffix_dedup import WORDS, remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (op 9) stay; texts without a letter go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class (op 3) the document with the smallest id stays."""
    return keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings (op 8) of 51 words go from the texts; documents of which nothing is left go."""
    cut = remove_repeats(docs, WORDS)
    touched = F.col("n_removed") > 0
    left = cut.filter(~touched | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(touched, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' ids in sequences along the curve (op 10)."""
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", packing)]

#: No stage can be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else tmp.table(out, name)
        if i > 1:
            tmp.drop(STAGES[i - 2][0])
    return docs
