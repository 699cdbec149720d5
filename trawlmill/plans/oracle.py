"""The registered queries in SQL, over the same tables.

Common table expressions state the proxies of ``proxy.py``; each query names the
ones it needs.  Doubles are rounded to six digits as in ``catalog.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

# the years that the line items have
FY, LY = ("(SELECT min(year(l_shipdate)) FROM lineitem)", "(SELECT max(year(l_shipdate)) FROM lineitem)")
PARTIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
# SQL has to name its columns: the years of the given tables
YEARS = list(range(1995, 2002))

CTE: dict[str, tuple[Sequence[str], str]] = {}
ORACLE: dict[str, str] = {}


def cte(name: str, needs: Sequence[str], body: str) -> None:
    CTE[name] = (needs, body)


def _ordered(names: Sequence[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTE[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(needs: Sequence[str], body: str, rnd: Sequence[str] = ()) -> str:
    with_ = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in _ordered(needs))
    with_ = f"{with_},\n" if with_ else ""
    star = "*"
    if rnd:
        parts = ", ".join(f'round_even("{c}" * 1e6, 0) / 1e6 + 0::DOUBLE AS "{c}"' for c in rnd)
        star = f"* REPLACE ({parts})"
    return f"WITH {with_}answer AS ({body})\nSELECT {star} FROM answer"


def oracle(key: str, needs: Sequence[str], body: str, rnd: Sequence[str] = ()) -> None:
    ORACLE[key] = sql(needs, body, rnd)


TOW = "(cast(round(l_tax*100) AS INTEGER) - 1)"
DAY = "cast(dayofyear(l_shipdate) AS INTEGER)"
LAT = f"(-50.0 + cast((s_suppkey*7 + {DAY}) % 80 AS DOUBLE)/2)"
LON = f"(-120.0 + cast((s_suppkey*11 + {DAY}*3) % 140 AS DOUBLE)/2)"
ZERO = f"((s_suppkey*7 + {DAY}) % 97 = 0)"
SPECIES = "CASE l_returnflag WHEN 'N' THEN 'CJM' WHEN 'A' THEN 'MAS' ELSE 'OTH' END"
END = f"(l_shipdate + {TOW} * INTERVAL 1 HOUR)"
YEAR = "cast(year(l_shipdate) AS INTEGER)"
MONTH = "cast(month(l_shipdate) AS INTEGER)"

cte("fleet", [], """
SELECT s_suppkey, lower(s_name) AS vesselname, n_name AS vesselcountry, r_name AS vesselcp,
  'v' || s_suppkey AS vesselcode, 'imo' || (s_suppkey + 9000000) AS vesselimo, s_acctbal,
  r_name || s_suppkey AS vesselcode2
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("lines", ["fleet"], "SELECT * FROM lineitem JOIN fleet ON l_suppkey = s_suppkey")
cte("hauls", ["lines"], f"""
SELECT vesselname, vesselcountry, vesselcode, vesselimo, vesselcp, vesselcode2,
  l_shipdate AS shootdatetime, {END} AS hauldatetime,
  CASE WHEN {TOW} > 0 THEN cast({TOW} AS DOUBLE) END AS duration,
  {YEAR} AS year, {MONTH} AS month, {DAY} AS day,
  CASE WHEN {ZERO} THEN 0::DOUBLE ELSE {LAT} END AS shootlat,
  CASE WHEN {ZERO} THEN 0::DOUBLE ELSE {LON} END AS shootlon,
  (CASE WHEN {ZERO} THEN 0::DOUBLE ELSE {LAT} END) + 0.25::DOUBLE AS haullat,
  (CASE WHEN {ZERO} THEN 0::DOUBLE ELSE {LON} END) + 0.25::DOUBLE AS haullon,
  {SPECIES} AS species, l_quantity AS "catch",
  CASE WHEN l_linestatus = 'O' THEN 'own' ELSE 'shared' END AS source
FROM lines""")
cte("monthly", [], """
SELECT cast(year(o_orderdate) AS INTEGER) AS year, cast(month(o_orderdate) AS INTEGER) AS month,
  avg(o_totalprice) AS x FROM orders GROUP BY 1, 2""")
cte("sst", ["monthly"], """
SELECT year, month,
  round((x - (SELECT avg(x) FROM monthly)) / (SELECT stddev_samp(x) FROM monthly), 6) AS sst FROM monthly""")
cte("elnino", ["sst"], """
SELECT year, month, sst, CASE WHEN sst <= -0.5 THEN -1 WHEN sst >= 0.5 THEN 1 ELSE 0 END AS "ELE" FROM sst""")
cte("hci", [], f"""
SELECT {YEAR} AS year, {MONTH} AS month, round(avg(l_discount)*100, 6) AS hci FROM lineitem GROUP BY 1, 2""")
cte("placed", ["hauls"], """
SELECT * REPLACE (CASE WHEN shootlat <> 0 THEN shootlat END AS shootlat,
  CASE WHEN shootlon <> 0 THEN shootlon END AS shootlon) FROM hauls""")
cte("enriched", ["placed", "elnino", "hci"], """
SELECT p.*, e.sst, e."ELE", h.hci FROM placed p
  LEFT JOIN elnino e ON p.year = e.year AND p.month = e.month
  LEFT JOIN hci h ON p.year = h.year AND p.month = h.month""")

MEANS = 'avg(shootlat) AS shootlat, avg(shootlon) AS shootlon, avg(sst) AS sst, avg("ELE") AS "ELE", avg(hci) AS hci'
RATES = ("ln(\"catch\" + 0.1) AS lcatch, \"catch\"/effort AS cpue, ln(\"catch\"/effort + 0.1) AS lcpue")
COMPLETE = ("vesselcp IS NOT NULL AND vesselcode2 IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL "
            "AND \"catch\" IS NOT NULL AND effort IS NOT NULL AND shootlat IS NOT NULL AND shootlon IS NOT NULL "
            "AND sst IS NOT NULL AND \"ELE\" IS NOT NULL AND hci IS NOT NULL")
PICK = f"species = 'CJM' AND year BETWEEN {FY} AND {LY}"
WEEK = "cast((dayofyear(shootdatetime) - 1) // 7 + 1 AS INTEGER)"
RATED = ["shootlat", "shootlon", "sst", "ELE", "hci", "effort", "lcatch", "cpue", "lcpue"]

cte("by_hour", ["enriched"], f"""
SELECT *, {RATES} FROM (
  SELECT vesselcp, vesselcode2, shootdatetime, year, month, day, species,
    round_even(coalesce(sum("catch"), 0), 0) AS "catch",
    CASE WHEN sum(duration) > 0 THEN sum(duration) END AS effort, {MEANS}
  FROM enriched WHERE {PICK} AND duration > 0.005 GROUP BY ALL) WHERE {COMPLETE}""")
cte("by_day", ["enriched"], f"""
SELECT *, {RATES} FROM (
  SELECT vesselcp, vesselcode2, year, month, day, species,
    round_even(coalesce(sum("catch"), 0), 0) AS "catch", {MEANS}, 1::DOUBLE AS effort
  FROM enriched WHERE {PICK} GROUP BY ALL) WHERE {COMPLETE}""")
cte("weeks", ["enriched"], f"""
SELECT vesselcp, vesselcode2, year, month, {WEEK} AS week, species,
    coalesce(sum("catch"), 0) AS "catch", cast(count(DISTINCT day) AS DOUBLE) AS effort, {MEANS}
  FROM enriched WHERE {PICK} GROUP BY ALL""")
cte("by_week", ["weeks"], f"""
SELECT *, {RATES} FROM (SELECT * REPLACE (round_even("catch", 0) AS "catch") FROM weeks)
WHERE "catch" > 0 AND {COMPLETE}""")


def scenarios(values: Sequence[float]) -> str:
    rows = ", ".join(f"({v}::DOUBLE)" for v in values)
    return f"""
SELECT *, {RATES} FROM (
  SELECT w.* REPLACE (round_even(w."catch", 0) AS "catch",
      w.effort * pow(1 + s.efficiency, w.year - (SELECT min(year) FROM weeks)) AS effort), s.efficiency
  FROM weeks w, (VALUES {rows}) s(efficiency)) WHERE "catch" > 0 AND {COMPLETE}"""


# --- sources and sinks -------------------------------------------------------------------
FLAG = ("CASE vesselcountry WHEN 'NATION_0' THEN 'GER' WHEN 'NATION_1' THEN 'NED' WHEN 'NATION_2' THEN 'LTU' "
        "WHEN 'NATION_3' THEN 'POL' ELSE vesselcountry END")
# the register as typed values; text layouts of the stamps differ by order key
cte("register", ["lines"], f"""
SELECT CASE WHEN s_suppkey % 41 = 7 THEN '1704' WHEN s_suppkey % 43 <> 5 THEN 'V -' || s_suppkey END AS vesselcode,
  vesselimo, 'p.b.' || s_suppkey AS vesselcallsign,
  CASE WHEN s_suppkey % 47 = 3 THEN 'Margiris' WHEN s_suppkey % 53 = 4 THEN 'Alina'
    WHEN s_suppkey % 59 = 6 THEN 'Jan Maria' WHEN s_suppkey % 61 <> 8 THEN upper(vesselname) END AS vesselname,
  {FLAG} AS vesselcountry,
  CASE WHEN l_orderkey % 97 <> 0 THEN l_shipdate END AS shootdatetime,
  CASE WHEN (l_orderkey + 1) % 97 <> 0 THEN {END} END AS hauldatetime,
  {LAT} AS shootlat, {LON} AS shootlon, {LAT} + 0.25::DOUBLE AS haullat, {LON} + 0.25::DOUBLE AS haullon,
  CASE WHEN l_linenumber = 7 THEN 'MAS' ELSE 'CJM' END AS targetspeciescode,
  lower({SPECIES}) AS species,
  CASE WHEN l_linenumber <> 6 THEN l_quantity END AS "catch", l_quantity * 1000 AS retainedspecieskg,
  CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END AS validfishing
FROM lines""")

oracle("s1_read_haul_table", ["register"], """
SELECT vesselcode, vesselimo, vesselcallsign, vesselname, vesselcountry, cast(shootlat AS VARCHAR) AS shootlat,
  cast(shootlon AS VARCHAR) AS shootlon, species, cast(cast("catch" AS BIGINT) AS VARCHAR) AS "catch", validfishing
FROM register""")
oracle("s2_read_positional_lists", ["lines"], f"""
SELECT filename, vesselcountry, vesselname, species, count(*) AS n, sum("catch") AS "catch" FROM (
  SELECT 'list' || {YEAR} || '.xlsx' AS filename, vesselcountry, vesselname, 'CJM' AS species, l_quantity AS "catch"
  FROM lines WHERE l_linenumber NOT IN (1, 2)
  UNION ALL SELECT 'list' || {YEAR} || '.xlsx', vesselcountry, vesselname, NULL, cast(l_partkey AS DOUBLE) FROM lines)
GROUP BY ALL""", ["catch"])
PATH = f"""'/data/repository/submission ' || {YEAR} || '/' ||
  CASE WHEN s_suppkey % 5 = 0 THEN 'Alk final/attic' WHEN s_suppkey % 5 = 1 THEN 'other' ELSE 'ALK data' END || '/' ||
  CASE WHEN s_suppkey % 7 = 0 THEN '~$' WHEN s_suppkey % 11 = 0 THEN 'NUEVO ' ELSE '' END || vesselname || '_q' ||
  quarter(l_shipdate) || CASE WHEN s_suppkey % 13 = 2 THEN '.csv' ELSE '.xlsx' END"""
oracle("s4_select_files", ["lines"], f"""
SELECT DISTINCT {PATH} AS path FROM lines
WHERE s_suppkey % 5 NOT IN (0, 1) AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 2""")
oracle("s5_read_csv_skip", ["hci"], "SELECT year, month, hci FROM hci", ["hci"])
oracle("s6_read_wide_months", ["sst"], "SELECT year, month, sst FROM sst", ["sst"])
oracle("s7_merge_current_year", ["register", "lines"], f"""
SELECT flag, caughtspeciescode, targetspeciescode, count(*) AS n, count(t) AS with_tonnes, sum(kg) AS kg FROM (
  SELECT vesselcountry AS flag, species AS caughtspeciescode, targetspeciescode, "catch" AS t, retainedspecieskg AS kg
  FROM register
  UNION ALL
  SELECT vesselcountry, lower({SPECIES}), 'CJM', NULL, l_quantity * 1000 FROM lines WHERE year(l_shipdate) = {LY})
GROUP BY ALL""")

# --- sampling proxies -----------------------------------------------------------------------
cte("samples", ["lines"], f"""
SELECT cast(quarter(l_shipdate) AS INTEGER) AS quarter, {YEAR} AS year, 'F' || (s_suppkey % 4 + 1) AS fleet,
  vesselcountry AS member, {SPECIES} AS species, vesselcp, l_partkey, l_linenumber, l_quantity, l_linestatus
FROM lines""")
cte("sized", ["samples"], "SELECT * FROM samples JOIN part ON l_partkey = p_partkey")
cte("catches", ["samples"], """
SELECT CASE l_linenumber % 3 WHEN 0 THEN 'official landings' WHEN 1 THEN 'retained' ELSE 'discards' END AS variable,
  'tonnes' AS unit, quarter, year, fleet, member, species, CASE WHEN l_quantity > 1 THEN l_quantity END AS value
FROM samples""")
cte("samplings", ["samples"], """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'aged' ELSE 'measured' END AS variable, 'individuals' AS unit,
  quarter, year, fleet, member, species, l_quantity AS value FROM samples""")
cte("lengths", ["sized"], """
SELECT 'thousands' AS unit, quarter, year, fleet, member, species,
  CASE WHEN l_linestatus = 'O' THEN 'Fork Length' ELSE 'total length' END AS lengthtype, 'cm' AS lengthunit,
  cast(p_size AS DOUBLE) AS length, l_linenumber AS age, l_quantity AS value FROM sized""")
cte("canums", ["samples"], """
SELECT CASE WHEN l_linestatus = 'O' THEN 'canum' WHEN l_quantity > 25 THEN 'meanlength' ELSE 'meanweight' END AS variable,
  'thousands' AS unit, quarter, year, fleet, member, species, l_linenumber + l_linenumber % 3 AS age, l_quantity AS value
FROM samples""")
STRATA = "variable, unit, quarter, year, fleet, member, species"
cte("catch_sums", ["catches"], f"SELECT {STRATA}, coalesce(sum(value), 0) AS value FROM catches GROUP BY ALL")
oracle("s8_snapshots", ["catch_sums"], """
SELECT * REPLACE (CASE WHEN year <= 1997 THEN unit END AS unit), CASE WHEN year <= 1997 THEN 'early' ELSE 'late' END AS tag
FROM catch_sums""", ["value"])
cte("year_cpue", ["by_week"], """
SELECT year, round(avg(cpue), 6) AS cpue, min(cpue) AS lwr, max(cpue) AS upr FROM by_week GROUP BY year""")
oracle("s9_write_index_csv", ["year_cpue"], "SELECT year, cpue FROM year_cpue", ["cpue"])


# --- cross-tabs -------------------------------------------------------------------------------
def party_table(cells: str, value: str, fn: str = "sum", margins: Sequence[str] = ("year", "vesselcp"),
                levels: Sequence[str] = PARTIES, row: str = "year", col: str = "vesselcp") -> str:
    """Wide year-by-party table; margins re-aggregate the cells."""
    names = [*levels, *(["(all)"] if col in margins else [])]
    pick = lambda n: f"max(CASE WHEN {col} = '{n}' THEN v END)"
    show = lambda n: f"coalesce({pick(n)}, 0)" if fn == "sum" else pick(n)
    cols = ", ".join(f'{show(n)} AS "{n}"' for n in names)
    agg = f"{'sum' if fn == 'sum' else 'avg'}({value})"
    sets = [f"({row}, {col})"]
    sets += [f"({col})"] if row in margins else []
    sets += [f"({row})"] if col in margins else []
    sets += ["()"] if row in margins and col in margins else []
    return f"""
SELECT {row}, {cols} FROM (
  SELECT CASE WHEN grouping({row}) = 1 THEN '(all)' ELSE {row} END AS {row},
    CASE WHEN grouping({col}) = 1 THEN '(all)' ELSE {col} END AS {col}, {agg} AS v
  FROM (SELECT cast({row} AS VARCHAR) AS {row}, cast({col} AS VARCHAR) AS {col}, cast({value} AS DOUBLE) AS {value} FROM ({cells}))
  GROUP BY GROUPING SETS ({', '.join(sets)}))
GROUP BY {row}"""


def party_oracle(key: str, needs: Sequence[str], cells: str, value: str, fn: str = "sum",
                 margins: Sequence[str] = ("year", "vesselcp")) -> None:
    names = [*PARTIES, *(["(all)"] if "vesselcp" in margins else [])]
    oracle(key, needs, party_table(cells, value, fn, margins), names)


CATCH_CELLS = "SELECT vesselcp, year, sum(\"catch\") AS c FROM hauls WHERE species = 'CJM' GROUP BY ALL"
ORACLE["s10_export_crosstab_csv"] = sql(["hauls"], party_table(CATCH_CELLS, "c"), [*PARTIES, "(all)"])
oracle("s11_file_inventory", ["lines"], f"""
SELECT DISTINCT {YEAR} AS year, regexp_extract({PATH}, '[^/]*$') AS fn FROM lines""")
oracle("s12_read_prev_index", ["year_cpue"], """
SELECT year, cpue, lwr, upr, 'old' AS type, '2001' AS assessmentyear FROM year_cpue""", ["cpue", "lwr", "upr"])
oracle("s13_read_range_series", ["hauls"], """
SELECT 'template.xlsx' AS file, 'CPUE fleet 4' AS sheet, year, cast(sum("catch") AS DOUBLE) AS cpue FROM hauls GROUP BY ALL""", ["cpue"])

# one row per haul: the smallest by the remaining columns
FIRST_HAUL = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rest}) AS rn
FROM (SELECT DISTINCT {cols} FROM {src})) WHERE rn = 1"""


def first_hauls(keys: str, rest: str, src: str = "hauls") -> str:
    order = ", ".join(f"{c.strip()} NULLS LAST" for c in rest.split(","))
    return FIRST_HAUL.format(keys=keys, rest=order, cols=f"{keys}, {rest}", src=src)


NAMED = "vesselname, shootdatetime, shootlat, shootlon"
CODED = "vesselcode2, shootdatetime, shootlat, shootlon"
DAYS_PER_VESSEL = f"""
SELECT vesselcp, year, sum(d) AS x FROM (
  SELECT vesselcp, vesselname, year, count(DISTINCT day) AS d FROM ({first_hauls(NAMED, 'vesselcp, year, day')}) GROUP BY ALL)
GROUP BY ALL"""
oracle("s14_read_reference_index", ["hauls"], f"""
SELECT c.year, c.c AS "catch", NULL::DOUBLE AS cpue, cast(d.x AS DOUBLE) AS effort, 'old cpue' AS model, 'old index, EUROPE' AS "desc"
FROM ({CATCH_CELLS}) c JOIN ({DAYS_PER_VESSEL}) d ON c.vesselcp = d.vesselcp AND c.year = d.year
WHERE c.vesselcp = 'EUROPE' AND c.year >= 1997""", ["catch", "cpue", "effort"])

# --- haul cleaning ------------------------------------------------------------------------------
oracle("h1_parse_mixed_datetime", ["register"], """
SELECT vesselimo, shootdatetime AS shoot, hauldatetime AS haul, count(*) AS n FROM register GROUP BY ALL""")
oracle("h2_serial_date_plus_time", ["lines"], f"""
SELECT vesselname, CASE WHEN l_linenumber <> 3 THEN l_shipdate + INTERVAL 6 HOUR ELSE l_shipdate END AS shoot,
  CASE WHEN l_linenumber <> 3 THEN l_shipdate + ({TOW} + 6) * INTERVAL 1 HOUR ELSE l_shipdate END AS haul, count(*) AS n
FROM lines GROUP BY ALL""")
oracle("h3_haul_duration", ["hauls"], """
SELECT vesselname, year, month, sum(duration) AS plain,
  sum(CASE WHEN month <> 6 THEN duration ELSE 2.5::DOUBLE END) AS filled, count(duration) AS n FROM hauls GROUP BY ALL""", ["plain", "filled"])
oracle("h4_calendar_parts", ["hauls"], "SELECT vesselcp, year, month, day, count(*) AS n FROM hauls GROUP BY ALL")
CODE = "regexp_replace(lower(vesselcode), '\\s+|-', '', 'g')"
cte("named", ["register"], f"""
SELECT * REPLACE (lower(vesselname) AS vesselname, {CODE} AS vesselcode, replace(upper(vesselcallsign), '.', '') AS vesselcallsign)
FROM register""")
cte("country", ["named"], """
SELECT *, CASE WHEN c2 IN ('NLD', 'DEU', 'POL', 'LIT') THEN 'EU' ELSE c2 END AS cp FROM (
  SELECT *, CASE WHEN vesselname IS NULL THEN NULL WHEN vesselname = 'margiris' THEN 'LIT' WHEN vesselcountry = 'GER' THEN 'DEU'
    WHEN vesselcountry = 'NED' THEN 'NLD' WHEN vesselcountry = 'LTU' THEN 'LIT' ELSE vesselcountry END AS c2 FROM named)""")
oracle("h5_canon_vessel", ["named"], "SELECT vesselname, vesselcode, vesselcallsign, count(*) AS n FROM named GROUP BY ALL")
oracle("h6_canon_country_party", ["country"], """
SELECT vesselname, c2 AS vesselcountry, cp AS vesselcp, count(*) AS n FROM country GROUP BY ALL""")
KEEP = """(vesselcode IS NULL OR vesselcode NOT IN ('1704', '9505073-6210008'))
  AND (vesselname IS NULL OR NOT regexp_matches(lower(vesselname), 'alina|sirius'))"""
oracle("h7_exclude_bad_vessels", ["register"], f"""
SELECT vesselcode, vesselname, count(*) AS n FROM register WHERE {KEEP} GROUP BY ALL""")
oracle("h8_target_and_catch_filter", ["register"], """
SELECT vesselimo, species, count(*) AS n, sum("catch") AS "catch" FROM register
WHERE targetspeciescode = 'CJM' AND "catch" IS NOT NULL AND validfishing = '1' GROUP BY ALL""", ["catch"])
oracle("h9_unit_correction", ["hauls"], """
SELECT vesselname, year, sum(CASE WHEN year = 1998 AND vesselname IN
  ('supplier#000000001', 'supplier#000000004', 'supplier#000000007') THEN 1000 * "catch" ELSE "catch" END) AS "catch"
FROM hauls GROUP BY ALL""", ["catch"])
oracle("h10_kg_to_tonnes_fallback", ["register"], """
SELECT vesselimo, count(*) AS n, sum(coalesce("catch", retainedspecieskg/1000)) AS "catch" FROM register GROUP BY ALL""", ["catch"])
oracle("h11_clean_numeric_text", ["lines"], """
SELECT upper(vesselname) AS vesselname, sum(CASE WHEN l_linenumber <> 5 THEN l_quantity*1000 + 500 ELSE 0 END) AS kg, count(*) AS n,
  count(CASE WHEN l_linenumber = 4 THEN 1 END) AS n_discarded FROM lines GROUP BY ALL""", ["kg"])
cte("factors", [], f"""
SELECT {YEAR} AS year, 1 + avg(l_discount) AS f FROM lineitem GROUP BY 1 HAVING {YEAR} <> 1997""")
cte("raised", ["hauls", "factors"], 'SELECT h.*, h."catch" * f.f AS catch2 FROM hauls h LEFT JOIN factors f ON h.year = f.year')
oracle("h12_raising_factor", ["raised"], """
SELECT vesselcp, year, sum("catch") AS "catch", sum(catch2) AS catch2, count(catch2) AS n FROM raised GROUP BY ALL""", ["catch", "catch2"])
oracle("h13_zero_coord_to_null", ["placed"], """
SELECT vesselname, count(shootlat) AS n_lat, count(shootlon) AS n_lon, avg(shootlat) AS lat, avg(shootlon) AS lon
FROM placed GROUP BY ALL""", ["lat", "lon"])
oracle("h14_force_south_west", ["lines"], f"""
SELECT vesselname, avg({LAT}) AS shootlat, avg({LON}) AS shootlon,
  avg(CASE WHEN l_linenumber <> 2 THEN {LAT} END) AS haullat, count(CASE WHEN l_linenumber <> 2 THEN 1 END) AS n
FROM lines GROUP BY ALL""", ["shootlat", "shootlon", "haullat"])
oracle("h15_infer_species", ["lines"], f"""
SELECT CASE WHEN l_linenumber = 5 THEN 'cjm' ELSE lower({SPECIES}) END AS species, count(*) AS n,
  sum(CASE WHEN l_linenumber = 5 THEN 0 ELSE (l_quantity*1000 + 500)/1000 END) AS "catch" FROM lines GROUP BY ALL""", ["catch"])
oracle("h16_species_wide_to_long", ["lines"], f"""
SELECT vesselname, s.species, {YEAR} AS year, count(*) AS n,
  sum(CASE WHEN lower({SPECIES}) = s.species THEN l_quantity END) AS "catch",
  sum(CASE WHEN l_linenumber <> 3 AND {TOW} > 0 THEN cast({TOW} AS DOUBLE) END) AS duration
FROM lines, (VALUES ('cjm'), ('mas'), ('oth')) s(species) GROUP BY ALL""", ["catch", "duration"])
oracle("h17_anonymise_vessels", ["hauls"], """
SELECT vesselcp, vesselname, vesselcp || row_number() OVER (PARTITION BY vesselcp ORDER BY md5(vesselname), vesselname) AS vesselcode2,
  sum("catch") AS "catch" FROM hauls GROUP BY vesselcp, vesselname""", ["catch"])
oracle("h18_canonical_hauls", ["country"], f"""
SELECT r.vesselname, r.c2 AS vesselcountry, r.vesselcode, r.vesselimo, r.cp AS vesselcp, n.vesselcode2,
  shootdatetime, hauldatetime,
  CASE WHEN hauldatetime > shootdatetime THEN date_diff('second', shootdatetime, hauldatetime)/3600 END AS duration,
  cast(year(shootdatetime) AS INTEGER) AS year, cast(month(shootdatetime) AS INTEGER) AS month,
  cast(dayofyear(shootdatetime) AS INTEGER) AS day, shootlat, shootlon, haullat, haullon, upper(species) AS species,
  CASE WHEN r.vesselname = 'jan maria' AND shootdatetime IS NULL THEN NULL ELSE "catch" END AS "catch"
FROM kept r JOIN (
  SELECT cp, vesselname, coalesce(cp, 'NA') ||
    row_number() OVER (PARTITION BY cp ORDER BY md5(coalesce(vesselname, '')), vesselname NULLS FIRST) AS vesselcode2
  FROM (SELECT DISTINCT cp, vesselname FROM kept)) n
  ON r.cp IS NOT DISTINCT FROM n.cp AND r.vesselname IS NOT DISTINCT FROM n.vesselname""".replace("kept", f"""(
  SELECT * FROM country WHERE (vesselcode IS NULL OR vesselcode <> '1704')
  AND (vesselname IS NULL OR vesselname <> 'alina') AND targetspeciescode = 'CJM' AND "catch" IS NOT NULL)"""),
       ["duration", "shootlat", "shootlon", "haullat", "haullon", "catch"])
EU = "(b.vesselcountry IN ('GER', 'NED', 'LTU', 'POL'))"
oracle("h19_merge_sources", ["raised"], f"""
SELECT CASE WHEN c IN ('DEU', 'LTU', 'NLD', 'LIT', 'POL') THEN 'EU' ELSE c END AS vesselcp, c AS vesselcountry, year, count(*) AS n,
  sum("catch") AS "catch", sum(catch2) AS catch2, count(code) AS with_code FROM (
  SELECT CASE WHEN b.vesselcountry = 'GER' THEN 'DEU' WHEN b.vesselcountry = 'NED' THEN 'NLD' ELSE b.vesselcountry END AS c,
    year, "catch", CASE WHEN s.part = 1 THEN catch2 END AS catch2,
    CASE WHEN s.part = 2 OR year < 1998 THEN vesselcode END AS code
  FROM (SELECT * REPLACE ({FLAG} AS vesselcountry) FROM raised) b, (VALUES (1), (2)) s(part)
  WHERE (s.part = 1 AND {EU}) OR (s.part = 2 AND b.vesselcountry NOT IN ('NLD', 'DEU', 'LTU', 'POL')))
GROUP BY ALL""", ["catch", "catch2"])
oracle("h20_dedupe_hauls", ["hauls"], first_hauls(NAMED, 'vesselcp, year, species, "catch"'), ["shootlat", "shootlon", "catch"])
oracle("h21_zero_temperature_to_null", ["lines"], """
SELECT vesselname, count(t) AS n, avg(t) AS temperature FROM (
  SELECT vesselname, CASE WHEN l_linenumber <> 1 AND trunc(l_discount*100) <> 0 THEN trunc(l_discount*100) END AS t FROM lines)
GROUP BY ALL""", ["temperature"])

# --- environment -----------------------------------------------------------------------------------
oracle("e1_ele_indicator", ["elnino"], "SELECT * FROM elnino", ["sst"])
oracle("e2_join_environment", ["enriched"], """
SELECT vesselname, "ELE", count(*) AS n, avg(sst) AS sst, avg(hci) AS hci FROM enriched GROUP BY ALL""", ["sst", "hci"])
oracle("e3_env_series", ["elnino", "hci"], """
SELECT e.*, h.hci, e.year + (e.month - 1)/12.0::DOUBLE AS date FROM elnino e
LEFT JOIN hci h ON e.year = h.year AND e.month = h.month WHERE e.year BETWEEN 1996 AND 2000""", ["sst", "hci", "date"])
oracle("e4_join_vessel_attributes", ["lines"], """
SELECT vesselname, cast(s_suppkey % 13 * 100 + 500 AS DOUBLE) AS gt, s_acctbal AS enginemain, sum(l_quantity) AS "catch"
FROM lines GROUP BY ALL""", ["gt", "enginemain", "catch"])
oracle("e5_local_trend", ["elnino", "hci"], """
SELECT x AS date, max(y) AS hci, CASE WHEN abs(det) > 1e-14*s0*s2*s4 THEN
    (t0*(s2*s4 - s3*s3) - t1*(s1*s4 - s2*s3) + t2*(s1*s3 - s2*s2))/det ELSE t0/s0 END AS trend
FROM (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s2*s3) + s2*(s1*s3 - s2*s2) AS det FROM (
  SELECT x, max(y) AS y, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4,
    sum(w*yy) AS t0, sum(w*u*yy) AS t1, sum(w*u*u*yy) AS t2 FROM (
    SELECT x, y, xx - x AS u, yy, pow(1 - pow(least(d/h, 1), 3), 3) AS w FROM (
      SELECT *, max(d) OVER (PARTITION BY x) AS h FROM (
        SELECT a.date AS x, a.hci AS y, b.date AS xx, b.hci AS yy, abs(b.date - a.date) AS d,
          row_number() OVER (PARTITION BY a.date ORDER BY abs(b.date - a.date), b.date) AS k, a.q
        FROM pts a, pts b) WHERE k <= q))
  GROUP BY x)) GROUP BY ALL""".replace("FROM pts a, pts b", """FROM
        (SELECT *, greatest(2, floor(count(*) OVER () * 0.2 + 1e-5)) AS q FROM series) a, series b"""), ["date", "hci", "trend"])
cte("series", ["elnino", "hci"], f"""
SELECT e.year + (e.month - 1)/12.0::DOUBLE AS date, h.hci FROM elnino e JOIN hci h ON e.year = h.year AND e.month = h.month
WHERE e.year BETWEEN {FY} AND {LY}""")
ORACLE["e5_local_trend"] = ORACLE["e5_local_trend"].replace("answer AS (", f"series AS ({CTE['series'][1]}),\nanswer AS (", 1)

# --- catch per unit effort ----------------------------------------------------------------------------
oracle("c1_cpue_by_hour", ["by_hour"], "SELECT * FROM by_hour", RATED)
oracle("c2_cpue_by_day", ["by_day"], "SELECT * FROM by_day", RATED)
oracle("c3_cpue_by_week", ["weeks"], scenarios((0.0, 0.025)), [*RATED, "efficiency"])
oracle("c4_efficiency_scenarios", ["weeks"], f"""
SELECT efficiency, year, avg(effort) AS effort, avg(cpue) AS cpue FROM ({scenarios((0.0, 0.02, 0.025, 0.03, 0.035, 0.05))})
GROUP BY ALL""", ["efficiency", "effort", "cpue"])
oracle("c5_efficiency_index", ["hauls"], """
SELECT year, pow(1 + e, year - (SELECT min(year) FROM hauls)) AS "index", e AS efficiency FROM (SELECT DISTINCT year FROM hauls),
  (VALUES (0::DOUBLE), (0.02::DOUBLE), (0.025::DOUBLE), (0.03::DOUBLE), (0.035::DOUBLE), (0.05::DOUBLE)) s(e)""", ["index", "efficiency"])
oracle("c6_weekly_catch_unit_effort", ["weeks"], f"""
SELECT *, {RATES} FROM (SELECT * REPLACE (round_even("catch", 0) AS "catch", 1::DOUBLE AS effort) FROM weeks)
WHERE "catch" > 0 AND {COMPLETE}""", RATED)
cte("daily", ["raised"], """
SELECT *, ln("catch" + 1) AS lcatch, ln(catch2 + 1) AS lcatch2, ln(cpue2 + 1) AS lcpue2 FROM (
SELECT *, CASE WHEN duration > 0 THEN catch2/(24*duration) END AS cpue2 FROM (
  SELECT vesselcountry, vesselname, vesselcode, 'list' || year AS filename, shootdatetime AS shootdate, year, month, day,
    coalesce(sum("catch"), 0) AS "catch", coalesce(sum(catch2), 0) AS catch2, coalesce(sum(duration), 0) AS duration,
    avg(shootlon) AS shootlon, avg(shootlat) AS shootlat, avg(haullon) AS haullon, avg(haullat) AS haullat,
    avg("catch") AS temperature, avg(CASE WHEN "catch" > 25 THEN "catch" END) AS geardepth,
    greatest(count(DISTINCT shootdatetime), count(DISTINCT hauldatetime)) AS nhaul
  FROM raised WHERE species = 'CJM' GROUP BY ALL))""")
oracle("c7_eu_daily", ["daily"], "SELECT * FROM daily", [
    "catch", "catch2", "duration", "shootlon", "shootlat", "haullon", "haullat", "temperature", "geardepth",
    "cpue2", "lcatch", "lcatch2", "lcpue2"])
NEAREST = """SELECT '{k}' AS key, cast({k} AS VARCHAR) AS level, lcpue, abs(lcpue - (SELECT avg(m) FROM (SELECT avg(lcpue) AS m FROM by_day GROUP BY {k}))) AS distance
FROM (SELECT {k}, avg(lcpue) AS lcpue FROM by_day GROUP BY {k}) ORDER BY distance, {k} LIMIT 1"""
oracle("c8_nearest_to_mean", ["by_day"], f"""
SELECT * FROM ({NEAREST.format(k='month')}) UNION ALL SELECT * FROM ({NEAREST.format(k='vesselcode2')})""", ["lcpue", "distance"])
oracle("c9_party_year_mean_lcpue", ["by_week"], """
SELECT vesselcp, year, avg(lcpue) AS lcatch, avg(week) AS week, year + avg(week)/52 AS date FROM by_week GROUP BY vesselcp, year""", ["lcatch", "week", "date"])
oracle("c10_add_missing_years", ["daily"], """
SELECT year, avg(lcatch) AS lcatch, avg(day) AS day, year + avg(day)/365 AS date FROM daily WHERE year <> 1999 GROUP BY year
UNION ALL SELECT y, NULL, NULL, NULL FROM (VALUES (1999), (2012)) t(y)""", ["lcatch", "day", "date"])
SCALED = """SELECT vesselcp, year, 'cpue_{t}' AS metric, m / max(m) OVER (PARTITION BY vesselcp) AS value
FROM (SELECT vesselcp, year, avg(cpue) AS m FROM {src} GROUP BY ALL)"""
oracle("c11_scaled_metrics", ["by_hour", "by_day", "by_week"], " UNION ALL ".join(
    SCALED.format(t=t, src=src) for t, src in (("byhour", "by_hour"), ("byday", "by_day"), ("byweek", "by_week"))), ["value"])
oracle("c12_relative_to_mean", ["by_week"], """
SELECT year, cpue, cpue / avg(cpue) OVER () AS rel_cpue FROM (SELECT year, avg(cpue) AS cpue FROM by_week GROUP BY year)""", ["cpue", "rel_cpue"])

# --- overviews --------------------------------------------------------------------------------------------
NESTED = "GROUPING SETS ((vesselcp, year{x}), (vesselcp{x}){y})"


def label(c: str) -> str:
    return f"CASE WHEN grouping({c}) = 1 THEN '(all)' ELSE cast({c} AS VARCHAR) END AS {c}"


SPECIES_COLS = ", ".join(f"coalesce(sum(CASE WHEN species = '{s}' THEN c END), 0) AS \"{s}\"" for s in ("CJM", "MAS", "OTH"))
oracle("d0_crosstab_two_row_variables", ["hauls"], f"""
SELECT {label('vesselcp')}, {label('year')}, {SPECIES_COLS}, coalesce(sum(c), 0) AS "(all)"
FROM (SELECT vesselcp, year, species, sum("catch") AS c FROM hauls GROUP BY ALL) GROUP BY ROLLUP (vesselcp, year)""",
       ["CJM", "MAS", "OTH", "(all)"])
oracle("d1_effort_summary", ["hauls"], f"""
SELECT vesselcp, year, CASE WHEN year <> '(all)' THEN nvessels END AS nvessels, fishingdays, "catch",
  CASE WHEN year <> '(all)' THEN catch_day END AS catch_day FROM (
  SELECT {label('vesselcp')}, {label('year')}, cast(sum(v) AS DOUBLE) AS nvessels, cast(sum(d) AS DOUBLE) AS fishingdays,
    sum(c) AS "catch", sum(c/d) AS catch_day
  FROM (SELECT vesselcp, year, count(DISTINCT vesselcode2) AS v, count(DISTINCT vesselcode2 || ' ' || day) AS d, sum("catch") AS c
    FROM hauls WHERE species = 'CJM' GROUP BY ALL) GROUP BY ROLLUP (vesselcp, year))""", ["nvessels", "fishingdays", "catch", "catch_day"])
VESSELS = "SELECT vesselcp, year, count(DISTINCT vesselcode2) AS x FROM hauls WHERE species = 'CJM' GROUP BY ALL"
party_oracle("d2_vessels_by_party_year", ["hauls"], VESSELS, "x", margins=("vesselcp",))
party_oracle("d3_catch_by_party_year", ["hauls"], CATCH_CELLS, "c")
cte("cjm", ["hauls"], "SELECT * FROM hauls WHERE species = 'CJM'")
party_oracle("d4_season_length", ["cjm"], f"""
SELECT vesselcp, year, max(day) - min(day) + 1 AS x FROM ({first_hauls(CODED, 'vesselcp, year, day', 'cjm')}) GROUP BY ALL""", "x", "avg")
party_oracle("d5_fishing_days", ["hauls"], DAYS_PER_VESSEL, "x")
party_oracle("d5_fishing_days_of_party", ["hauls"], "SELECT vesselcp, year, count(DISTINCT day) AS x FROM hauls GROUP BY ALL", "x", margins=("vesselcp",))
party_oracle("d6_haul_counts", ["hauls"], f"""
SELECT vesselcp, year, count(*) AS x FROM ({first_hauls(NAMED, 'vesselcp, year')}) GROUP BY ALL""", "x")
HAUL_HOURS = first_hauls(NAMED, "vesselcp, year, duration")
party_oracle("d7_fishing_hours", ["hauls"], f"SELECT vesselcp, year, trunc(coalesce(sum(duration), 0)) AS x FROM ({HAUL_HOURS}) GROUP BY ALL", "x")
party_oracle("d8_mean_haul_duration", ["hauls"], f"""
SELECT vesselcp, year, round_even(avg(duration)*10, 0)/10 AS x FROM ({HAUL_HOURS}) GROUP BY ALL""", "x", "avg")
party_oracle("d9_mean_catch_per_day", ["by_day"], """
SELECT vesselcp, year, avg(c) AS x FROM (SELECT vesselcp, vesselcode2, year, day, sum("catch") AS c FROM by_day GROUP BY ALL) GROUP BY ALL""", "x", "avg")
party_oracle("d9_mean_catch_per_party_day", ["cjm"], """
SELECT vesselcp, year, avg(c) AS x FROM (SELECT vesselcp, year, day, sum("catch") AS c FROM cjm GROUP BY ALL) GROUP BY ALL""", "x", "avg", ("vesselcp",))
party_oracle("d10_mean_catch_per_week", ["by_week"], 'SELECT vesselcp, year, avg("catch") AS x FROM by_week GROUP BY ALL', "x", "avg", ("vesselcp",))
party_oracle("d11_mean_days_per_week", ["by_week"], "SELECT vesselcp, year, avg(effort) AS x FROM by_week GROUP BY ALL", "x", "avg", ("vesselcp",))
oracle("d12_catch_by_species_over_threshold", ["hauls"], f"""
SELECT vesselcp, {label('year')}, {SPECIES_COLS}, coalesce(sum(c), 0) AS "(all)"
FROM (SELECT vesselcp, year, species, cast(trunc(sum("catch")) AS DOUBLE) AS c FROM hauls WHERE year >= 1996 AND species IN (
    SELECT species FROM totals WHERE t >= (SELECT avg(t) FROM totals)) GROUP BY ALL)
GROUP BY GROUPING SETS ((vesselcp, year), (vesselcp))""".replace(
    "totals", '(SELECT species, sum("catch") AS t FROM hauls GROUP BY species)'), ["CJM", "MAS", "OTH", "(all)"])
oracle("d13_mark_incomplete_year", ["hauls"], f"""
SELECT vesselcp, year || CASE WHEN year = (SELECT max(year) FROM hauls WHERE species = 'CJM') THEN '*' ELSE '' END AS year, x AS nvessels FROM ({VESSELS})""")
oracle("d14_zero_catch_share", ["enriched"], f"""
SELECT vesselcp, year, count(CASE WHEN c = 0 THEN 1 END) AS n, count(CASE WHEN c = 0 THEN 1 END)/count(*)::DOUBLE AS prop FROM (
  SELECT vesselcp, vesselcode2, year, month, day, round_even(sum("catch"/20), 0) AS c, avg(shootlat) AS lat, avg(sst) AS sst, avg(hci) AS hci
  FROM enriched WHERE {PICK} GROUP BY ALL) WHERE lat IS NOT NULL AND sst IS NOT NULL AND hci IS NOT NULL
GROUP BY ALL HAVING count(CASE WHEN c = 0 THEN 1 END) > 0""", ["prop"])


def by_source(keys: str, rest: str, src: str) -> str:
    return first_hauls(f"source, {keys}", rest, src)


oracle("d15_source_comparison", ["hauls", "cjm"], f"""
SELECT source, year, 'nvessels' AS metric, cast(count(DISTINCT vesselcode2) AS DOUBLE) AS value FROM cjm GROUP BY ALL
UNION ALL SELECT source, year, 'catch', sum("catch") FROM cjm GROUP BY ALL
UNION ALL SELECT source, year, 'duration', trunc(coalesce(sum(duration), 0)) FROM ({by_source(NAMED, 'year, duration', 'hauls')}) GROUP BY ALL
UNION ALL SELECT source, year, 'fishingdays', sum(d) FROM (
  SELECT source, vesselname, year, count(DISTINCT day) AS d FROM hauls GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT source, year, 'nhauls', count(*) FROM ({by_source(NAMED, 'year', 'hauls')}) GROUP BY ALL
UNION ALL SELECT source, year, 'ndays', max(day) - min(day) + 1 FROM cjm GROUP BY ALL""", ["value"])
oracle("d16_vessel_presence_list", ["cjm"], """
SELECT DISTINCT source, vesselcode2, vesselname, year FROM cjm WHERE year BETWEEN 1996 AND 1999""")
oracle("d17_rescaled_source_series", ["placed"], """
SELECT source, vesselname, shootdatetime, CASE WHEN source = 'shared' THEN 1000 * "catch" ELSE "catch" END AS "catch" FROM placed
WHERE vesselname = 'supplier#000000001' AND year = 1998 AND species = 'CJM' AND (shootlat IS NOT NULL OR shootlon IS NOT NULL)""", ["catch"])
oracle("d18_days_by_vessel_year", ["daily"], f"""
SELECT {label('year')}, {label('vesselname')}, cast(sum(d) AS DOUBLE) AS days
FROM (SELECT year, vesselname, count(DISTINCT day) AS d FROM daily GROUP BY ALL) GROUP BY CUBE (year, vesselname)""", ["days"])
oracle("d19_catch_days_totals", ["daily"], """
SELECT year, sum(c) AS "catch", sum(c2) AS catch2, sum(d) AS days FROM (
  SELECT year, vesselcode, vesselname, cast(trunc(sum("catch")) AS BIGINT) AS c, cast(trunc(sum(catch2)) AS BIGINT) AS c2,
    count(DISTINCT day) AS d FROM daily GROUP BY ALL) GROUP BY ALL""")
oracle("d20_vessel_cpue_by_tonnage", ["daily", "fleet"], """
SELECT t.vesselname, t."catch", t.days, t."catch"/t.days::DOUBLE AS cpue, cast(f.s_suppkey % 13 * 100 + 500 AS DOUBLE) AS gt FROM (
  SELECT vesselname, sum(c) AS "catch", sum(d) AS days FROM (
    SELECT year, vesselname, cast(trunc(sum("catch")) AS BIGINT) AS c, count(DISTINCT day) AS d FROM daily GROUP BY ALL) GROUP BY ALL) t
LEFT JOIN fleet f ON t.vesselname = f.vesselname""", ["cpue", "gt"])
MONTH_COLS = ", ".join(f"coalesce(sum(CASE WHEN month = {m} THEN c END), 0) AS \"{m}\"" for m in range(1, 13))
oracle("d21_monthly_activity", ["daily"], f"""
SELECT cast(year AS VARCHAR) AS year, {label('vesselname')}, {MONTH_COLS}, coalesce(sum(c), 0) AS "(all)"
FROM (SELECT vesselname, year, month, cast(trunc(sum("catch")) AS DOUBLE) AS c FROM daily GROUP BY ALL)
GROUP BY GROUPING SETS ((year, vesselname), (year))""", [*[str(m) for m in range(1, 13)], "(all)"])
oracle("d22_weekly_min_max", ["daily"], """
SELECT vesselcode, year, min(c) AS mincatch, max(c) AS maxcatch FROM (
  SELECT vesselcode, year, (dayofyear(shootdate) - 1) // 7 + 1 AS week, avg("catch") AS c FROM daily WHERE "catch" <> 0 GROUP BY ALL)
GROUP BY ALL""", ["mincatch", "maxcatch"])
HAUL_COLS = ["vesselname", "vesselcountry", "vesselcode", "vesselimo", "vesselcp", "vesselcode2", "shootdatetime", "hauldatetime",
             "duration", "year", "month", "day", "shootlat", "shootlon", "haullat", "haullon", "species", "catch", "source"]
oracle("d23_null_profile", ["placed"], " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", count("{c}") AS present, count(*) - count("{c}") AS missing FROM placed' for c in HAUL_COLS))
oracle("d24_coordinate_checks", ["placed"], """
SELECT count(CASE WHEN shootlat IS NOT NULL AND shootlon IS NULL THEN 1 END) AS lat_only,
  count(CASE WHEN shootlat IS NULL AND shootlon IS NOT NULL THEN 1 END) AS lon_only,
  count(CASE WHEN shootlat > -30 THEN 1 END) AS north_of_limit, min(shootlat) AS min_lat, max(shootlat) AS max_lat,
  min(shootlon) AS min_lon, max(shootlon) AS max_lon FROM placed""", ["min_lat", "max_lat", "min_lon", "max_lon"])
oracle("d25_column_summary", ["placed"], " UNION ALL ".join(f"""
SELECT '{c}' AS "column", cast(min("{c}") AS DOUBLE) AS min, avg("{c}") AS mean, cast(max("{c}") AS DOUBLE) AS max,
  count(*) - count("{c}") AS missing, quantile_cont(cast("{c}" AS DOUBLE), 0.25) AS q1, quantile_cont(cast("{c}" AS DOUBLE), 0.5) AS median,
  quantile_cont(cast("{c}" AS DOUBLE), 0.75) AS q3 FROM placed""" for c in ("catch", "duration", "shootlat", "shootlon", "day")),
       ["min", "mean", "max", "q1", "median", "q3"])
oracle("d26_vessel_year_mean_catch", ["cjm"], f"""
SELECT 'week' AS period, vesselcode2, year, avg(c) AS "catch" FROM (
  SELECT vesselcode2, year, {WEEK} AS w, sum("catch") AS c FROM cjm WHERE vesselcp = 'EUROPE' GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT 'day', vesselcode2, year, avg(c) FROM (SELECT vesselcode2, year, day, sum("catch") AS c FROM cjm GROUP BY ALL) GROUP BY ALL""", ["catch"])
oracle("d27_avg_catch_wide_by_year", ["hauls"], "SELECT vesselname, vesselcountry, " + ", ".join(
    f'avg(CASE WHEN year = {y} THEN "catch" END) AS "{y}"' for y in YEARS) + " FROM hauls GROUP BY ALL", [str(y) for y in YEARS])
oracle("d28_zero_catch_counts", ["hauls"], """
SELECT vesselcp, year, vesselname, count(*) AS n FROM hauls WHERE "catch" = 1 AND vesselcp = 'EUROPE' GROUP BY ALL""")
oracle("d29_mean_daily_catch_rank", ["cjm"], """
SELECT vesselcode, avg(c) AS "catch" FROM (SELECT vesselcode, year, day, sum("catch") AS c FROM cjm GROUP BY ALL) GROUP BY ALL""", ["catch"])

# --- spatial -------------------------------------------------------------------------------------------------
MIDX, MIDY = "(floor(shootlon) + 0.5)", "(floor(shootlat/0.5::DOUBLE)*0.5::DOUBLE + 0.25::DOUBLE)"
RECT = "printf('%.2f:%.2f', {x}, {y})"
oracle("g1_grid_cell", ["placed"], f"""
SELECT {RECT.format(x=MIDX, y=MIDY)} AS rect, count(*) AS n, sum("catch") AS "catch" FROM placed
WHERE shootlat IS NOT NULL AND shootlon IS NOT NULL GROUP BY ALL""", ["catch"])


def cells_of(src: str, period: str) -> str:
    return f"""
SELECT year, x AS shootlon, y AS shootlat, avg(c) AS "catch", {RECT.format(x='x', y='y')} AS rect FROM (
  SELECT vesselcode2, year, {period}, {MIDX}::DOUBLE AS x, {MIDY} AS y, sum("catch") AS c FROM {src} GROUP BY ALL)
GROUP BY year, x, y"""


oracle("g2_catch_by_cell", ["by_day"], cells_of("by_day", "day"), ["shootlon", "shootlat", "catch"])
oracle("g2_catch_by_cell_week", ["by_week"], cells_of("by_week", "week"), ["shootlon", "shootlat", "catch"])
oracle("g3_log_class", ["by_day"], f"""
SELECT year, rect, "catch", CASE WHEN "catch" <= 10 THEN '[1,10]' WHEN "catch" <= 100 THEN '(10,100]'
  WHEN "catch" <= 1000 THEN '(100,1000]' WHEN "catch" <= 10000 THEN '(1000,10000]' ELSE '(10000,100000]' END AS class
FROM ({cells_of('by_day', 'day')}) WHERE "catch" >= 1""", ["catch"])
AREA = f"""
SELECT year, sum(effort) AS effort, count(DISTINCT {RECT.format(x=MIDX, y=MIDY)}) AS nrectangles, sum("catch") AS "catch",
  sum("catch")/sum(effort) AS cpue FROM by_week GROUP BY year"""
oracle("g4_fishery_area", ["by_week"], AREA, ["effort", "catch", "cpue"])
oracle("g4_fishery_area_long", ["by_week"], " UNION ALL ".join(
    f"SELECT year, '{v}' AS variable, cast(\"{v}\" AS DOUBLE) AS value FROM ({AREA})" for v in ("effort", "nrectangles", "catch")), ["value"])
oracle("g5_extreme_longitude", ["placed"], """
SELECT year, min(shootlon) AS shootlon FROM placed WHERE shootlat IS NOT NULL AND shootlon IS NOT NULL GROUP BY ALL""", ["shootlon"])
oracle("g6_haul_positions", ["by_hour"], "SELECT vesselcp, year, shootlon, shootlat FROM by_hour", ["shootlon", "shootlat"])
COARSE = "cast(trunc(shootlat/10) AS INTEGER)*10 AS shootlat2, cast(trunc(shootlon/10) AS INTEGER)*10 AS shootlon2"
LABEL = "coalesce(cast(shootlat2 AS VARCHAR), 'NA') || ':' || coalesce(cast(shootlon2 AS VARCHAR), 'NA')"
oracle("g7_coarse_area", ["placed"], f"""
SELECT {LABEL} AS area, shootlat2, shootlon2, count(*) AS n FROM (SELECT {COARSE} FROM placed) GROUP BY ALL""")
oracle("g8_mean_by_area_year", ["daily"], f"""
SELECT year, {LABEL} AS area, shootlat2, shootlon2, avg(lcatch) AS lcatch, year + 0.5::DOUBLE AS date
FROM (SELECT *, {COARSE} FROM daily) WHERE lcatch >= 0.001 AND shootlat2 IN (-20, -30, -40) AND year <> 1997 GROUP BY ALL""", ["lcatch", "date"])
NX, NY = "(-118.0 + (n_nationkey % 5)*14)", "(-47.0 + floor(n_nationkey/5)*8)"
oracle("g9_point_in_polygon", ["placed"], f"""
SELECT vesselcp, species, year, division, c AS "catch" FROM (
  SELECT *, sum(c) OVER (PARTITION BY vesselcp, species) AS total FROM (
    SELECT vesselcp, year, n_name AS division, species, sum("catch") AS c FROM placed
    LEFT JOIN nation ON abs(shootlon - ({NX} + 7.1))/7 + abs(shootlat - ({NY} + 3.55))/4 < 1 GROUP BY ALL))
WHERE total > 1000""", ["catch"])
oracle("g10_daily_position_catch", ["daily"], """
SELECT vesselname, year, day, sum("catch") AS "catch", avg(shootlat) AS shootlat, avg(shootlon) AS shootlon FROM daily GROUP BY ALL""",
       ["catch", "shootlat", "shootlon"])

# --- workbooks -----------------------------------------------------------------------------------------------------
FILE = "member || '_' || year || '.xlsx'"
cte("at_length", ["sized"], f"""
SELECT {FILE} AS file, upper(member) AS member, year, fleet, cast(p_size AS DOUBLE) AS length, quarter,
  cast(sum(l_quantity) AS DOUBLE) AS v FROM sized GROUP BY ALL""")
oracle("s3_cells_at_length", ["at_length"], """
SELECT file, 'LEN ' || fleet AS sheet, cast(length + 9 AS INTEGER) AS row, 1 AS col, cast(cast(length AS INTEGER) AS VARCHAR) AS text FROM at_length GROUP BY ALL
UNION ALL SELECT file, 'LEN ' || fleet, cast(length + 9 AS INTEGER), quarter + 1, cast(cast(v AS BIGINT) AS VARCHAR) FROM at_length""")
oracle("t1_block", ["at_length"], "SELECT file, 'LEN ' || fleet AS sheet, cast(length + 9 AS INTEGER) AS row, cast(cast(length AS INTEGER) AS VARCHAR) AS length, " + ", ".join(
    f"max(CASE WHEN quarter = {q} THEN cast(cast(v AS BIGINT) AS VARCHAR) || ' ' END) AS q{q}" for q in (1, 2, 3, 4)) + " FROM at_length GROUP BY file, fleet, length")
oracle("t2_workbook_meta", ["samples"], f"SELECT DISTINCT {FILE} AS file, upper(member) AS member, 'CJM' AS species, year FROM samples")
oracle("t3_sheet_router", ["samples"], f"""
SELECT DISTINCT {FILE} AS file, replace(s.sheet, '@', fleet) AS sheet, s.kind FROM samples,
  (VALUES ('catch data', 'catch'), ('sampling', 'sampling'), ('LEN @', 'length'), ('WLK @', 'wlk'), ('ALK #@', 'alk'), ('CN @', 'canum')) s(sheet, kind)
""".replace("replace(s.sheet, '@', fleet)", "replace(replace(s.sheet, '#@', 'FLEET ' || substr(fleet, 2)), '@', fleet)"))
oracle("t4_fleet_from_sheet", ["samples"], """
SELECT DISTINCT replace(replace(s.sheet, '#@', 'FLEET ' || substr(fleet, 2)), '@', fleet) AS sheet,
  CASE s.word WHEN '@' THEN fleet ELSE s.word END AS fleet FROM samples,
  (VALUES ('START HERE', 'HERE'), ('catch data', 'DATA'), ('sampling', NULL), ('LEN @', '@'), ('LEN TL @', 'TL'), ('WLK @', '@'), ('ALK #@', '@'), ('CN @', '@')) s(sheet, word)""")
oracle("t5_read_catch", ["samples"], f"""
SELECT {FILE} AS file, quarter, year, CASE l_linenumber % 3 WHEN 0 THEN 'official landings' WHEN 1 THEN 'retained' ELSE 'discards' END AS variable,
  'tonnes' AS unit, fleet, cast(sum(l_quantity) AS DOUBLE) AS value, upper(member) AS member, 'CJM' AS species
FROM samples GROUP BY ALL""", ["value"])
oracle("t6_read_sampling", ["samples"], f"""
SELECT {FILE} AS file, quarter, CASE WHEN l_linenumber % 2 = 0 THEN 'aged' ELSE 'measured' END AS variable, 'individuals' AS unit, fleet,
  cast(sum(l_quantity) AS DOUBLE) AS value, upper(member) AS member, 'CJM' AS species, year FROM samples GROUP BY ALL""", ["value"])
cte("thousands", ["at_length"], "SELECT *, CASE fleet WHEN 'F1' THEN v/1000 WHEN 'F2' THEN v*1000 ELSE v END AS value FROM at_length")
oracle("t7_read_length", ["thousands"], """
SELECT file, length, 'Fork Length' AS lengthtype, 'cm' AS lengthunit, 'thousands' AS unit, quarter, value, fleet,
  value / sum(value) OVER g AS prop, sum(value) OVER (g ORDER BY length) AS cumvalue,
  sum(value) OVER (g ORDER BY length) / sum(value) OVER g AS cumprop, member, 'CJM' AS species, year
FROM thousands WINDOW g AS (PARTITION BY file, fleet, quarter)""", ["length", "value", "prop", "cumvalue", "cumprop"])
oracle("t8_read_wlk", ["at_length"], """
SELECT file, length, 'Fork Length' AS lengthtype, 'cm' AS lengthunit,
  CASE fleet WHEN 'F1' THEN 'individuals' WHEN 'F2' THEN 'millions' ELSE 'thousands' END AS unit, quarter, v AS value, fleet,
  member, 'CJM' AS species, year FROM at_length""", ["length", "value"])
oracle("t9_read_alk", ["sized"], f"""
SELECT file, quarter, length, age, value, lengthtype, lengthunit, fleet, value / sum(value) OVER (PARTITION BY file, fleet, quarter, length) AS prop,
  member, species, year FROM (
  SELECT {FILE} AS file, quarter, cast(p_size AS DOUBLE) AS length, l_linenumber AS age, cast(sum(l_quantity) AS DOUBLE) AS value,
    'fork length' AS lengthtype, 'cm' AS lengthunit, fleet, upper(member) AS member, 'CJM' AS species, year FROM sized GROUP BY ALL)""", ["length", "value", "prop"])
oracle("t10_read_canum", ["sized"], " UNION ALL ".join(f"""
SELECT {FILE} AS file, fleet, l_linenumber AS age, '{v}' AS variable, quarter, '{u}' AS unit, cast({e} AS DOUBLE) AS value,
  upper(member) AS member, 'CJM' AS species, year FROM sized GROUP BY ALL""" for v, u, e in (
    ("canum", "thousands", "sum(l_quantity)*1000"), ("meanlength", "cm", "sum(p_size)"), ("meanweight", "kg", "count(*)"))), ["value"])
oracle("t11_to_thousands", ["samples"], """
SELECT member, fleet, CASE WHEN fleet IN ('F1', 'F2') THEN 'thousands' ELSE 'cm' END AS unit,
  sum(CASE fleet WHEN 'F1' THEN l_quantity/1000 WHEN 'F2' THEN l_quantity*1000 ELSE l_quantity END) AS value FROM samples GROUP BY ALL""", ["value"])

# --- sampling -----------------------------------------------------------------------------------------------------------
oracle("t12_consolidate_sum", ["catch_sums"], "SELECT * FROM catch_sums", ["value"])
cte("props", ["lengths"], """
SELECT *, value / sum(value) OVER g AS prop, sum(value) OVER (g ORDER BY length) AS cumvalue,
  sum(value) OVER (g ORDER BY length) / sum(value) OVER g AS cumprop FROM (
  SELECT unit, quarter, year, fleet, member, species, replace(lower(lengthtype), ' ', '') AS lengthtype, lengthunit, length, sum(value) AS value
  FROM lengths GROUP BY ALL) WINDOW g AS (PARTITION BY member, fleet, species, year, quarter, lengthtype)""")
oracle("t13_length_proportions", ["props"], "SELECT * FROM props", ["length", "value", "prop", "cumvalue", "cumprop"])
cte("canum_means", ["canums"], f"SELECT {STRATA}, age, avg(value) AS value FROM canums GROUP BY ALL")
oracle("t14_consolidate_canum", ["canum_means"], "SELECT * FROM canum_means", ["value"])
cte("alk", ["lengths"], """
SELECT *, value / sum(value) OVER (PARTITION BY lengthtype, lengthunit, quarter, year, fleet, member, species, length) AS prop FROM (
  SELECT replace(lower(lengthtype), ' ', '') AS lengthtype, lengthunit, quarter, year, fleet, member, species, age, length, sum(value) AS value
  FROM lengths GROUP BY ALL)""")
oracle("t15_age_length_key", ["alk"], "SELECT * FROM alk", ["length", "value", "prop"])
cte("chosen", ["catches"], """
SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY year, quarter, fleet, member, unit, species) AS n FROM (
  SELECT year, 'Q' || quarter AS quarter, fleet, member, unit, species,
    CASE WHEN variable IN ('retained', 'discards') THEN 'estimated_catch' ELSE replace(variable, ' ', '_') END AS variable, sum(value) AS value
  FROM catches WHERE value > 0 GROUP BY ALL)) WHERE NOT (n = 2 AND variable = 'official_landings')""")
oracle("t16_catch_component_choice", ["chosen"], "SELECT * FROM chosen", ["value"])
oracle("t17_samples_by", ["samplings"], """
SELECT year, quarter, fleet, member, variable, sum(value) AS value FROM samplings WHERE variable = 'measured' OR value > 0 GROUP BY ALL""", ["value"])
oracle("t18_ages_per_kilotonne", ["samplings", "chosen"], """
SELECT year, quarter, fleet, member, species, a.aged, c.estimated_catch, c.official_landings,
  a.aged / (coalesce(c.estimated_catch, c.official_landings)/1000) AS ages_1000ton FROM (
  SELECT year, 'Q' || quarter AS quarter, fleet, member, species, sum(value) AS aged FROM samplings WHERE variable = 'aged' AND value > 0 GROUP BY ALL) a
FULL JOIN (SELECT year, quarter, fleet, member, species, sum(CASE WHEN variable = 'estimated_catch' THEN value END) AS estimated_catch,
  sum(CASE WHEN variable = 'official_landings' THEN value END) AS official_landings FROM chosen GROUP BY ALL) c
USING (year, quarter, fleet, member, species)
WHERE a.aged IS NOT NULL AND coalesce(c.estimated_catch, c.official_landings) IS NOT NULL""", ["aged", "estimated_catch", "official_landings", "ages_1000ton"])
CURVE = "SELECT member, fleet, species, year, 'Q' || quarter AS quarter, year || 'Q' || quarter AS yearquarter, lengthtype, length, cumprop FROM props"
oracle("t19_cumulative_length_curve", ["props"], f"{CURVE} WHERE lengthtype = 'forklength'", ["length", "cumprop"])
oracle("t19_length_types_of_member", ["props"], f"{CURVE} WHERE member = 'NATION_7'", ["length", "cumprop"])


def pooled(src: str, keys: str, where: str) -> str:
    return f"""
SELECT *, value / sum(value) OVER (PARTITION BY {keys}) AS prop FROM (
  SELECT {keys}, age, sum(value) AS value FROM {src} WHERE {where} GROUP BY ALL)"""


oracle("t20_alk_pooled", ["alk"], pooled("alk", "member, quarter, length", "prop > 0"), ["length", "value", "prop"])
oracle("t20_alk_pooled_one_length", ["alk"], pooled("alk", "member, quarter, length", "prop > 0 AND length = 30"), ["length", "value", "prop"])
oracle("t20_alk_by_fleet", ["lengths"], pooled("lengths", "year, quarter, length, fleet, member", "lower(lengthtype) = 'fork length'"), ["length", "value", "prop"])
for key, by in (("t21_canum_by", "year, fleet, member, age"), ("t21_canum_by_quarter", "year, quarter, member, age")):
    oracle(key, ["canum_means"], f"SELECT {by}, sum(value) AS value FROM canum_means WHERE variable = 'canum' GROUP BY ALL", ["value"])
for key, area in (("t22_relative_catch_at_age", "area, "), ("t22_relative_catch_at_age_total", "")):
    oracle(key, ["samples"], f"""
SELECT * REPLACE (value / avg(value) OVER (PARTITION BY {area}age) AS value), year - age AS yc FROM (
  SELECT {area.replace('area', 'vesselcp AS area')}year, l_linenumber AS age, sum(l_quantity) AS value FROM samples GROUP BY ALL)""", ["value"])
oracle("t23_catch_by_quarter_member", ["catches"], """
SELECT year, 'Q' || quarter AS quarter, year || 'Q' || quarter AS yearquarter, fleet, member, coalesce(sum(value), 0) AS value
FROM catches GROUP BY ALL""", ["value"])
