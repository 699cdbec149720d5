"""Exact interpolated quantiles by radix selection.

An exact percentile aggregate keeps every distinct value of a group in the memory of one task, and a sort or a window deals a
whole group to one task.  Here a value is its order-preserving 64-bit image, and each pass counts the next DIGIT_BITS bits
of the images that are still in question: at most 2**DIGIT_BITS counters for a wanted rank, added up map-side.  The counter
that holds the rank fixes the bits, all other values are out, and after at most four passes one value is left, however
the values are spread.  As soon as no more than COUNTERS values are in question anywhere, they are counted one by one
instead; small groups come to that at once.  The result is the exact type-7 quantile (linear interpolation between the two
neighbouring order statistics).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import discard, stage
from .semantics import null_safe_join

DIGIT_BITS = 16
#: Values in question for one rank that are counted one by one.
COUNTERS = 1 << 16


def _with_image(values: DataFrame) -> DataFrame:
    """The values with __x: a long that is ordered as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("__v")).to_numpy(zero_copy_only=False)
            bits = np.ascontiguousarray(v, dtype=np.float64).view(np.int64)
            yield batch.append_column("__x", pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1))))

    return values.mapInArrow(run, T.StructType([*values.schema.fields, T.StructField("__x", T.LongType())]))


def _chosen(wanted: DataFrame, counted: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
    """For each wanted rank (keys, __i, __rank, __p) the counter that holds it, and the rank within that.

    ``counted`` has (keys, __p, __c, __n): how many values of the part __p have __c; at most COUNTERS rows for a part.
    """
    lists = counted.groupBy(*keys, "__p").agg(F.array_sort(F.collect_list(F.struct("__c", "__n"))).alias("__l"))
    both = null_safe_join(wanted, lists, [*keys, "__p"], "inner")
    step = (
        "aggregate(__l, named_struct('left', __rank, 'at', -1, 'i', 0), (a, x) -> CASE WHEN a.at >= 0 THEN a "
        "WHEN a.left < x.__n THEN named_struct('left', a.left, 'at', a.i, 'i', a.i) "
        "ELSE named_struct('left', a.left - x.__n, 'at', -1, 'i', a.i + 1) END)"
    )
    both = both.withColumn("__a", F.expr(step))
    return both.select(*keys, "__i", F.col("__a.left").alias("__rank"), F.expr("__l[__a.at].__c").alias(found))


def _counts(values: DataFrame, keys: Sequence[str], part: Column, counter: Column) -> DataFrame:
    return values.groupBy(*keys, part.alias("__p"), counter.alias("__c")).agg(F.count(F.lit(1)).alias("__n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (0.5,)) -> DataFrame:
    """One row per group and probability: ``keys..., prob, quantile``."""
    keys, probs = list(keys), sorted(float(p) for p in probs)
    # -0 and 0 are one value
    number = (F.col(value).cast("double") + F.lit(0.0)).alias("__v")
    values = stage(df.where(F.col(value).isNotNull()).select(*keys, number), "values")
    totals = stage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total")).where("__total > 0"), "totals")
    h = lambda p: F.lit(p) * (F.col("__total") - 1)
    ranks = [F.struct(F.lit(2 * i + j).alias("__i"), F.least(F.floor(h(p)) + j, F.col("__total") - 1).alias("__rank")) for i, p in enumerate(probs) for j in (0, 1)]
    wanted = totals.select(*keys, F.inline(F.array(*ranks)))
    most = totals.agg(F.max("__total")).first()[0] or 0
    part, shift = F.lit(0).cast("long"), 64
    wanted = wanted.withColumn("__p", part)
    if most > COUNTERS:
        plain, values = values, stage(_with_image(values), "values")
        discard(plain)
    while most > COUNTERS and shift > 0:
        shift -= DIGIT_BITS
        digits = F.shiftright("__x", shift)
        wanted = stage(_chosen(wanted, _counts(values, keys, part, digits), keys, "__p"), "ranks")
        part = digits
        # only the parts that hold a wanted rank go on
        kept = wanted.select(*keys, "__p").distinct()
        plain = values
        values = stage(null_safe_join(values.withColumn("__p", part), kept, [*keys, "__p"], "left_semi").drop("__p"), "values")
        discard(plain)
        most = values.groupBy(*keys, part.alias("__p")).count().agg(F.max("count")).first()[0] or 0
    found = _chosen(wanted, _counts(values, keys, part, F.col("__v")), keys, "__v")
    pairs = found.groupBy(*keys, F.floor(F.col("__i") / 2).cast("int").alias("__j")).agg(
        F.max(F.when(F.col("__i") % 2 == 0, F.col("__v"))).alias("__a"), F.max(F.when(F.col("__i") % 2 == 1, F.col("__v"))).alias("__b")
    )
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("__j") + 1)
    named = null_safe_join(pairs, totals, keys, "inner") if keys else pairs.withColumn("__total", totals.scalar())
    share = prob * (F.col("__total") - 1) - F.floor(prob * (F.col("__total") - 1))
    # without a share the neighbour plays no part, also where it is infinite
    quantile = F.when(share == 0, F.col("__a")).otherwise(F.col("__a") + share * (F.col("__b") - F.col("__a")))
    return named.select(*keys, prob.alias("prob"), quantile.alias("quantile"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, (0.5,)).select(
        *keys, F.col("quantile").alias(name)
    )
