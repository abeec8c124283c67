"""A training-data pipeline over the documents: five stages, each calling one operator.

In every stage null and empty texts, null ids, repeated rows and empty tables have the result the
operator's docstring tells; columns of the documents pass through whatever their names, and all
stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import decontamination, outliers, pieces, probminhash, substrings
from logstrata.llm.common import apart, documents, together
from logstrata.llm.queries import tokenizer_path
from logstrata.session import scratch_path

# No SQL tells the robust estimates or the signatures; the tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers; the others go.

    Null and empty texts fail the base rules. Repeated rows share a verdict.
    """
    return outliers.keep_sound(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are alike: that with the least id.

    Of repeated rows one stays; texts without words are like no other.
    """
    return probminhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that repeat; n_chars tells the new length.

    A null text stays null, with a null length; a column n_chars is set where there is one.
    """
    used = ["doc_id", "text"]
    shorter = substrings.without_repeats(apart(docs, used)).select(*together(docs.columns, used))
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.char_length("text").cast("long"))
    return shorter


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; the others go. Null texts have none."""
    used = ["doc_id", "text"]
    found = decontamination.find_benchmark_text(apart(docs, used),
                                                documents(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*together(docs.columns, used))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their text, and whether decoding gives the text again.

    Null and empty texts have no ids. Columns named ``ids``, ``n_tokens`` or ``decodes`` give
    way to the stage's own.
    """
    return pieces.round_trip(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("substring dedup", substring_dedup), ("decontamination", decontaminate),
          ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
