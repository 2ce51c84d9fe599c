"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept. All but the last return the columns of documents, whatever further ones there are and whatever their names; the last returns pieces of sequences. An empty table goes through all stages as one. Texts are read whole, of whatever length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontaminate, line_dedup, packing, simhash, toxicity
from stratalog.llm.common import checkpointed, named, ship, table
from stratalog.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold.

    Null and empty texts score by the model's bias, which is low, and stay. Rows that repeat, and rows without an id, are judged each by their text; only documents with an id are learnt from. Without labels everything scores low.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars, where there is one, follows the text of rows that lost a line.

    A null text stays null, an empty one empty. Rows of one id count as one document, and so do all rows without an id; every row loses its shared lines, but for those of the largest id that holds the line.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_lines_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*map(named, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    One row of a group stays: rows without an id come last, of several rows of the smallest id the one with the least hash of its columns, of equal rows one. All null and empty texts, and those without a word, are one group.
    """
    ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: none of its windows of 13 words, and of items that are shorter less than a twentieth.

    Null and empty texts stay. Rows that repeat are judged each. An empty benchmark drops nothing.
    """
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids.

    Every row gives at least its end id, a null or empty text that alone. Rows that repeat, or that have no id, are packed each; their pieces have the same doc_id.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifier, fingerprints and tokens are beyond SQL; tests/llm holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written to the checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
