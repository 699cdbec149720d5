"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Method: every whole text is encoded; only its length in tokens goes on.  Texts of one length are counted together, so the table
has a row for each different length.  Running sums from the longest length down are taken within blocks of BLOCK lengths
and shifted by the sums of the blocks above, so no task orders the whole histogram.  With D(x), T(x) the texts and tokens of
length x or more: totals are D and T at the shortest length, the share of texts under x is 1 - D(x) / D, and the tokens
left when every text is cut to a limit x are T - (T(x) - x D(x)).

Rows: null and empty texts have length 0 and are counted.  An empty table gives no rows.  Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlmill.llm.common import chunks, table, whole_text
from trawlmill.llm.op1_bpe import default_vocabulary, tokenizer
from trawlmill.sources.staging import stage

BLOCK = 1024


def encoded_lengths(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """n_tokens for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_file, pattern)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(own.encode(x)) // 4 for x in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select(whole_text().alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs: one row for each different length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds docs_at_least, tokens_at_least, share_shorter (of the texts) and truncated_total (limit = the row's length)."""
    own = histogram.select("n_tokens", "docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.col("n_tokens") * F.col("docs")
    inner = own.withColumns({"docs_in": F.sum("docs").over(down), "tokens_in": F.sum(tokens).over(down)})
    blocks = own.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK lengths
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(above), zero).alias("docs_above"), F.coalesce(F.sum("t").over(above), zero).alias("tokens_above"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
    )
    docs_from, tokens_from = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return inner.join(blocks, "block").select(
        "n_tokens", "docs", docs_from.alias("docs_at_least"), tokens_from.alias("tokens_at_least"), (1 - docs_from / F.col("all_docs")).alias("share_shorter"),
        (F.col("all_tokens") - (tokens_from - F.col("n_tokens") * docs_from)).alias("truncated_total"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, tokens left when every text is cut to it; one pass for any list of limits."""
    sums = histogram.agg(*[F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("docs")), F.lit(0)).alias(str(x)) for x in limits])
    return sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in limits]), F.array(*[F.col(str(x)) for x in limits]))).alias("limit", "tokens"))


def length_quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """probability, n_tokens: the least length with at least that share of the texts at or under it; from with_suffix_sums."""
    upto = F.col("share_shorter") + F.col("docs") / (F.col("docs_at_least") / (1 - F.col("share_shorter")))
    least = sums.agg(*[F.min(F.when(upto >= F.lit(p) - 1e-12, F.col("n_tokens"))).alias(f"p{i}") for i, p in enumerate(probabilities)])
    return least.select(F.explode(F.map_from_arrays(F.array(*[F.lit(float(p)) for p in probabilities]), F.array(*[F.col(f"p{i}") for i in range(len(probabilities))]))).alias("probability", "n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), *default_vocabulary())
    return with_suffix_sums(stage(length_histogram(lengths), "lengths"))
