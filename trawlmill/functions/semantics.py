"""Missing-value, rounding and calendar rules shared by every operator.

The tables follow the conventions of statistical data frames, which differ from
SQL in a few places (sums of nothing, membership tests on NULL, joins on NULL,
half-to-even rounding, non-ISO weeks).  Each rule lives here once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum0(col) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def n_distinct(*cols) -> Column:
    """Distinct count in which a missing value counts as one more value."""
    return F.count_distinct(F.struct(*cols))


def not_in(col: Column, values: Iterable) -> Column:
    """True unless the value is in the list; a missing value is kept."""
    return ~F.coalesce(col.isin(list(values)), F.lit(False))


def not_matching(col: Column, pattern: str) -> Column:
    """True unless the text matches; a missing text is kept."""
    return ~F.coalesce(col.rlike(pattern), F.lit(False))


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued choice: an unknown condition gives NULL, not the else branch."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def zero_to_null(col: Column) -> Column:
    return F.when(col != 0, col)


def na_text(col: Column) -> Column:
    """Text form in which a missing value reads "NA"."""
    return F.coalesce(col.cast("string"), F.lit("NA"))


def week_of_year(ts) -> Column:
    """Seven-day blocks counted from 1 January (1..53), not ISO weeks."""
    return (F.floor((F.dayofyear(ts) - 1) / 7) + 1).cast("int")


def seconds_between(start, end) -> Column:
    """Elapsed seconds of two zone-less stamps; the session time zone plays no part."""
    start = start if isinstance(start, Column) else F.col(start)
    end = end if isinstance(end, Column) else F.col(end)
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")


def hours_between(start, end) -> Column:
    """Elapsed hours, whatever the size of the gap."""
    return seconds_between(start, end) / 3600


def strip_punctuation(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"\p{Punct}", "")


def strip_blanks(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+", "")


#: The largest double; the remainder by it leaves every smaller number as it is and makes infinity no number.
LARGEST = 1.7976931348623157e308


def to_number(col: Column) -> Column:
    """Text to double; text that is not a finite number becomes NULL instead of failing.

    The text is parsed once: neither the remainder nor ``nanvl`` names its argument again.
    """
    return F.nanvl(col.try_cast("double") % F.lit(LARGEST), F.lit(None).cast("double"))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi join in which a missing key matches a missing key; left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def full_outer_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe full join with the key columns of both sides merged."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    )
    joined = left.join(renamed, cond, "full")
    merged = {k: F.coalesce(left[k], renamed[f"__{k}"]) for k in keys}
    others = [c for c in left.columns if c not in keys]
    others_r = [c for c in right.columns if c not in keys]
    return joined.select(
        *[merged[k].alias(k) for k in keys],
        *[left[c] for c in others],
        *[renamed[c] for c in others_r],
    )


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Row union by column name; columns absent on one side are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
