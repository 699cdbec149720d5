"""Cleaning of haul registers: names, parties, units, positions, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.haultext import (
    calendar_parts,
    clean_numeric_text,
    force_south_west,
    haul_duration,
    kg_to_tonnes_fallback,
    with_stamps,
)
from ..functions.semantics import (
    if_else,
    not_in,
    not_matching,
    null_safe_join,
    strip_blanks,
    to_number,
    union_by_name,
    zero_to_null,
)

# Country aliases, the parties rolled up into one, vessels left out
# (two register codes with wrong catch units, two names with too many empty hauls),
# one vessel with a fixed flag, and the vessels that reported kilotonnes in one year.
COUNTRY_ALIASES = {"GER": "DEU", "NED": "NLD", "LTU": "LIT"}
VESSEL_FLAG = {"margiris": "LIT"}
EU_COUNTRIES = ("NLD", "DEU", "POL", "LIT")
EXCLUDED_CODES = ("1704", "9505073-6210008")
EXCLUDED_NAMES = "alina|sirius"
RESCALED_VESSELS = (
    "annelies ilena",
    "franziska",
    "helen mary",
    "jan maria",
    "maartje theadora",
)
RESCALED_YEAR = 2008
# Yearly raising factor of the old haul lists.
RAISING_FACTORS = {
    2005: 1.0, 2006: 1.0, 2007: 1.4, 2008: 1.5, 2009: 1.0, 2010: 1.0, 2011: 1.5,
    2012: 1.0, 2013: 1.0, 2014: 1.0, 2015: 1.0, 2016: 1.0, 2017: 1.0, 2018: 1.0, 2019: 1.0,
}

CANONICAL_COLUMNS = (
    "vesselname", "vesselcountry", "vesselcode", "vesselimo", "vesselcp",
    "shootdatetime", "hauldatetime", "duration", "year", "month", "day",
    "shootlat", "shootlon", "haullat", "haullon", "species", "catch",
)


def type_register(df: DataFrame) -> DataFrame:
    """Text register to typed hauls: numbers, stamps, duration, calendar parts."""
    numeric = [
        c for c in ("shootlat", "shootlon", "haullat", "haullon", "catch") if c in df.columns
    ]
    typed = with_stamps(
        df.withColumns({c: to_number(F.col(c)) for c in numeric}), {c: c for c in ("shootdatetime", "hauldatetime")}
    )
    return typed.withColumn("duration", haul_duration("shootdatetime", "hauldatetime")).select(
        "*", *calendar_parts("shootdatetime")
    )


def type_serial_list(df: DataFrame) -> DataFrame:
    """Old haul list: serial dates, reported duration (seconds), wide species columns."""
    out = with_stamps(df, serial={"shootdatetime": ("shootdate", "shoottime"), "hauldatetime": ("hauldate", "haultime")})
    reported = to_number(F.col("duration")) / 3600
    out = out.withColumn(
        "duration", haul_duration("shootdatetime", "hauldatetime", reported)
    ).drop("shootdate", "shoottime", "hauldate", "haultime")
    positions = {
        c: to_number(F.col(c)) for c in ("shootlat", "shootlon", "haullat", "haullon")
    }
    out = out.withColumns(positions)
    out = force_positions(out)
    out = zero_temperature_to_null(out)
    return species_wide_to_long(out).select("*", *calendar_parts("shootdatetime"))


def type_stamped_list(df: DataFrame) -> DataFrame:
    """New haul list: stamps as text, catch and discards as text in kilogrammes."""
    out = with_stamps(canon_vessel(df), {c: c for c in ("shootdatetime", "hauldatetime")}).withColumns(
        {
            "catch": clean_numeric_text("catch") / 1000,
            "discarded": clean_numeric_text("discarded"),
            "species": F.lower("species"),
            "shootlat": to_number(F.col("shootlat")),
            "shootlon": to_number(F.col("shootlon")),
            "haullat": to_number(F.col("haullat")),
            "haullon": to_number(F.col("haullon")),
        }
    )
    out = infer_species(force_positions(out))
    return out.withColumn("duration", haul_duration("shootdatetime", "hauldatetime")).select(
        "*", *calendar_parts("shootdatetime")
    )


def force_positions(df: DataFrame) -> DataFrame:
    """Haul-end zeros to NULL, then every position forced to the south-west."""
    ends = {c: zero_to_null(F.col(c)) for c in ("haullat", "haullon")}
    df = df.withColumns(ends)
    return df.withColumns(
        {c: force_south_west(c) for c in ("shootlat", "shootlon", "haullat", "haullon")}
    )


def canon_vessel(df: DataFrame) -> DataFrame:
    """Lower-case names, codes without blanks or dashes, call signs without dots."""
    rules = {
        "vesselname": F.lower("vesselname"),
        "vesselcode": F.regexp_replace(F.lower("vesselcode"), r"\s+|-", ""),
        "vesselcallsign": F.regexp_replace(F.upper("vesselcallsign"), r"\.", ""),
    }
    return df.withColumns({c: rule for c, rule in rules.items() if c in df.columns})


def canon_country_party(
    df: DataFrame,
    aliases: Mapping[str, str] = COUNTRY_ALIASES,
    vessel_flag: Mapping[str, str] = VESSEL_FLAG,
    union_members: Sequence[str] = EU_COUNTRIES,
    union_name: str = "EU",
) -> DataFrame:
    """Country aliases, vessels with a fixed flag, and the party each country fishes for."""
    country = F.col("vesselcountry")
    alias = F.lit(None).cast("string")
    for old, new in aliases.items():
        alias = F.when(F.col("vesselcountry") == old, new).otherwise(alias)
    country = F.coalesce(alias, country)
    for name, flag in vessel_flag.items():
        # an unknown name leaves the country unknown
        country = if_else(F.col("vesselname") == name, flag, country)
    out = df.withColumn("vesselcountry", country)
    member = F.coalesce(F.col("vesselcountry").isin(list(union_members)), F.lit(False))
    return out.withColumn(
        "vesselcp", F.when(member, union_name).otherwise(F.col("vesselcountry"))
    )


def exclude_bad_vessels(
    df: DataFrame,
    codes: Sequence[str] = EXCLUDED_CODES,
    name_pattern: str = EXCLUDED_NAMES,
) -> DataFrame:
    return df.where(
        not_in(F.col("vesselcode"), codes)
        & not_matching(F.lower("vesselname"), name_pattern)
    )


def target_and_catch_filter(
    df: DataFrame, target: str = "CJM", valid_only: bool = False
) -> DataFrame:
    out = df.where((F.col("targetspeciescode") == target) & F.col("catch").isNotNull())
    return out.where(F.col("validfishing") == "1") if valid_only else out


def unit_correction(
    df: DataFrame,
    vessels: Sequence[str] = RESCALED_VESSELS,
    year: int = RESCALED_YEAR,
    k: float = 1000.0,
) -> DataFrame:
    """Catch times ``k`` for the named vessels in one year.

    A vessel outside the list keeps its catch even when the year is unknown; a
    listed vessel with an unknown year has an unknown catch.
    """
    named = F.coalesce(F.col("vesselname").isin(list(vessels)), F.lit(False))
    return df.withColumn(
        "catch", if_else(named & (F.col("year") == year), F.col("catch") * k, F.col("catch"))
    )


def with_catch_in_tonnes(df: DataFrame, kilos: str = "retainedspecieskg") -> DataFrame:
    return df.withColumn("catch", kg_to_tonnes_fallback("catch", kilos))


def raising_factor(df: DataFrame, factors: DataFrame) -> DataFrame:
    """Yearly factor: ``catch2 = catch * f``; a year without factor gives NULL.

    ``factors`` is grouped to one row a year (at most 10 000 rows), so it is
    broadcast whatever its source.
    """
    dim = factors.where(F.col("year").between(1, 9999)).groupBy("year").agg(F.max("f").alias("f"))
    return df.join(F.broadcast(dim), "year", "left").withColumn(
        "catch2", F.col("catch") * F.col("f")
    )


def raising_factor_table(spark, factors: Mapping[int, float] = RAISING_FACTORS) -> DataFrame:
    return spark.createDataFrame(
        [(int(y), float(f)) for y, f in factors.items()], "year int, f double"
    )


def infer_species(df: DataFrame, default: str = "cjm") -> DataFrame:
    """A record without species and without catch belongs to the target species."""
    empty = F.col("species").isNull() & (F.col("catch") == 0)
    return df.withColumn("species", F.when(empty, default).otherwise(F.col("species")))


def species_wide_to_long(
    df: DataFrame, species: Sequence[str] = ("cjm", "mas", "oth")
) -> DataFrame:
    ids = [c for c in df.columns if c not in species]
    numeric = df.withColumns({s: to_number(F.col(s).cast("string")) for s in species})
    return numeric.unpivot(ids, list(species), "species", "catch")


def zero_temperature_to_null(df: DataFrame) -> DataFrame:
    text = strip_blanks(F.col("temperature").cast("string"))
    return df.withColumn("temperature", if_else(text == "0", F.lit(None).cast("double"), to_number(text)))


def drop_reserved_columns(
    df: DataFrame, columns: Sequence[str] = CANONICAL_COLUMNS
) -> DataFrame:
    """Canonical projection: the fixed column list, in order."""
    return df.select(*columns)


# The digest prefix splits a party into at most 16**3 numbering blocks.
DIGEST_PREFIX = 3


def vessel_numbers(df: DataFrame) -> DataFrame:
    """(vesselcp, vesselname) -> vesselcode2 = party + running number.

    Numbers follow the MD5 digest of the name (then the name), a total order that
    does not depend on row order.  Because the digest prefix splits each party into
    at most 4096 blocks in that same order, numbers are ranks inside a block plus
    the sizes of the blocks before it: no task ever ranks a whole party.
    """
    digest = F.md5(F.coalesce(F.col("vesselname"), F.lit("")))
    vessels = (
        df.select("vesselcp", "vesselname")
        .distinct()
        .withColumn("__digest", digest)
        .withColumn("__block", F.substring("__digest", 1, DIGEST_PREFIX))
    )
    before = Window.partitionBy("vesselcp").orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        vessels.groupBy("vesselcp", "__block")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy("vesselcp", "__block").orderBy("__digest", "vesselname")
    numbered = null_safe_join(
        vessels.withColumn("__rank", F.row_number().over(inside)),
        offsets,
        ["vesselcp", "__block"],
    )
    party = F.coalesce(F.col("vesselcp"), F.lit("NA"))
    return numbered.select(
        "vesselcp",
        "vesselname",
        F.concat(party, (F.col("__before") + F.col("__rank")).cast("string")).alias(
            "vesselcode2"
        ),
    )


def anonymise_vessels(df: DataFrame) -> DataFrame:
    return null_safe_join(df, vessel_numbers(df), ["vesselcp", "vesselname"])


def merge_sources(
    eu_old: DataFrame,
    eu_new: DataFrame,
    non_eu: DataFrame,
    factors: DataFrame,
    union_members: Sequence[str] = ("NLD", "DEU", "LTU", "POL"),
) -> DataFrame:
    """Three differently shaped sources in one table.

    The union's lists are raised by the yearly factor; the union's vessels are
    dropped from the third source, where they would be counted twice.
    """
    eu = raising_factor(union_by_name(eu_old, eu_new), factors)
    others = non_eu.where(not_in(F.col("vesselcountry"), union_members))
    merged = union_by_name(eu, others).where(F.col("catch").isNotNull())
    merged = canon_vessel(merged.withColumn("species", F.upper("species")))
    return canon_country_party(
        merged,
        aliases={"GER": "DEU", "NED": "NLD"},
        union_members=("DEU", "LTU", "NLD", "LIT", "NED", "POL"),
    )


HAUL_KEY = ("vesselname", "shootdatetime", "shootlat", "shootlon")


def dedupe_hauls(
    df: DataFrame,
    keys: Sequence[str] = HAUL_KEY,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per haul; hauls repeat once per species.

    The kept row is the smallest by the remaining columns in order, a missing value
    coming after any other.  A minimum of a struct aggregates map-side, so a haul with
    very many rows stays one row per partition in the shuffle; a row-number window would
    sort them all in one task.
    """
    rest = [c for c in (keep or df.columns) if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ranked = [x for i, c in enumerate(rest) for x in (F.col(c).isNull().alias(f"m{i}"), F.col(c).alias(f"v{i}"))]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__first"))
    return first.select(*keys, *[F.col(f"__first.v{i}").alias(c) for i, c in enumerate(rest)])


def clean_register(df: DataFrame, target: str = "CJM") -> DataFrame:
    """Text register to canonical hauls, with anonymous vessel codes."""
    out = type_register(df.withColumn("vesselname", F.lower("vesselname")))
    out = exclude_bad_vessels(target_and_catch_filter(out, target))
    out = canon_country_party(canon_vessel(out.withColumn("species", F.upper("species"))))
    return anonymise_vessels(drop_reserved_columns(unit_correction(out)))
