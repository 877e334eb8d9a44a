"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage works on the rows that its predecessor kept, written as Parquet and read again; all but the last return the
columns of documents, and any others that the table has, whatever their names. The mix may hold a document more than once;
copies are packed like any other rows.

A null text is a text of one empty line: the classifier scores it as empty, the line stage leaves it null, it is linked with
nothing, counts as one token in the mix and is packed as its end mark alone. A null doc_id or source stays as it is. Very long
texts are read whole by every stage. Ties: of near copies the smallest doc_id stays, of a common line the largest doc_id's.
Rows that repeat a doc_id stand and fall together, and the mix takes them as one document. An empty table gives no sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respira.llm import linededup, mixing, ngramjoin, packing, quality
from respira.llm.common import shared_dir, table, write
from respira.registry import Registry


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps (operator 10)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fewer_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share (operator 7); n_chars follows the text."""
    kept = linededup.without_common_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 3; five words, 80 percent)."""
    return ngramjoin.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them, every one at least once (operator 1)."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences (operator 8); copy tells the copies of a document apart."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fewer_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed),
]

#: Models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/respira/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        write(stage(spark, docs, sf_dir), f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


REGISTRY = Registry()
REGISTRY.add("pipeline", run, ORACLE_SQL)
