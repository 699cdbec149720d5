"""From raw documents to token ids, in five stages, each written as Parquet and read by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a table, all but the last with the columns
of documents.  Rows: null and empty texts are scored, form one near-duplicate class, and have no tokens; repeated rows are
copies of each other; further columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawlmill.llm import op1_bpe, op2_suffix_dedup, op3_near_dedup, op9_decontaminate, op10_quality
from trawlmill.llm.common import rows_with_key, small_batches, table
from trawlmill.sources.staging import stage

#: Passages of more than so many words go, from words of three letters on: 51 of them have 203 bytes with the blanks between.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 203
PASSAGE_GRAM = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low-quality and toxic documents go, by the co-trained classifier."""
    model = op10_quality.train(docs, table(spark, sf_dir, "labels"))
    return op10_quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id."""
    small_batches(spark)
    return op3_near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that are also elsewhere go from the texts; every document stays."""
    small_batches(spark)
    return op2_suffix_dedup.strip_repeats(docs, PASSAGE_BYTES, PASSAGE_GRAM, words=PASSAGE_WORDS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    found = op9_decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return rows_with_key(docs, found.select("row_id", "row_hash").distinct(), "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (unsigned 32-bit, little-endian), and the digests of a decoding that gives the text again."""
    small_batches(spark)
    return op1_bpe.round_trip(docs, *op1_bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("token_ids", token_ids),
]

#: The stages learn, hash and encode; the pipeline is tested against a plain version of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
