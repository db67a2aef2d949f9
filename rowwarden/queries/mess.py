"""Messy submissions and file listings derived from the test tables, as SQL text valid in Spark and DuckDB.

Each generator keeps the clean value beside the mess it makes of it, so that the expected answer of every operator is
known from the generator rather than recomputed.  ``{table}`` stands for a test table, ``{days}`` for the engine's way
to count days since 1970.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.operators.spread import running_offset

_SPARK = {"days": "datediff(o_orderdate, date '1970-01-01')"}
_DUCK = {"days": "date_diff('day', date '1970-01-01', cast(o_orderdate as date))"}


def duck(sql: str) -> str:
    for name, text in _DUCK.items():
        sql = sql.replace("{" + name + "}", text)
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name, text in _SPARK.items():
        sql = sql.replace("{" + name + "}", text)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


NAMES = """
select c_custkey as id, c_name as clean, c_nationkey as nation,
  case c_custkey % 5 when 0 then c_name when 1 then concat('  ', c_name, ' ') when 2 then concat(c_name, '  Jr')
    when 3 then concat(c_name, chr(160), 'Jr') else '   ' end as raw
from {customer}
"""

_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (month(o_orderdate) - 1) * 3 + 1, 3)"
_Y, _D = "cast(year(o_orderdate) as string)", "lpad(cast(day(o_orderdate) as string), 2, '0')"
_M = "lpad(cast(month(o_orderdate) as string), 2, '0')"
BIRTHDATES = f"""
select o_orderkey as id, o_orderkey % 14 as variant, {_Y} as y, {_M} as m, {_D} as d,
  case when o_orderkey % 14 = 13 then cast({{days}} + 25569 as double) end as number,
  case o_orderkey % 14
    when 0 then concat({_Y}, '/', {_M}) when 1 then concat({_Y}, '-', {_M}) when 2 then concat({_M}, '/', {_Y})
    when 3 then concat({_Y}, '/', {_M}, '/', {_D}) when 4 then concat({_D}, '/', {_M}, '/', {_Y})
    when 5 then concat({_M}, '/', {_D}, '/', {_Y}) when 6 then concat({_Y}, {_M}) when 7 then concat({_Y}, {_M}, {_D})
    when 8 then concat({_MON}, ' ', {_Y}) when 9 then concat(cast(day(o_orderdate) as string), ' ', {_MON}, ' ', {_Y})
    when 10 then concat({_MON}, ' ', substr({_Y}, 3, 2)) when 11 then {_Y}
    when 12 then concat('not recorded ', cast(o_orderkey as string)) else cast({{days}} + 25569 as string) end as raw
from {{orders}}
"""
BIRTHDATE_ANSWERS = f"""
select id,
  case when variant = 5 and cast(d as int) <= 12 then concat(y, '/', d) when variant in (11, 12) then null
    else concat(y, '/', m) end as value,
  case when variant in (4, 5) and cast(d as int) <= 12 then 'review' when variant in (10, 11) then 'review'
    when variant = 12 then 'unparseable' else 'fixed' end as status
from ({BIRTHDATES}) g
"""

PART_VOCABULARY = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")
ANSWERS = """
select p_partkey as id, p_partkey % 6 as variant, p_type as term,
  case p_partkey % 6 when 1 then lower(p_type) when 2 then substr(p_type, 1, length(p_type) - 1)
    when 3 then concat(substr(p_type, 1, 1), substr(p_type, 3, 1), substr(p_type, 2, 1), substr(p_type, 4))
    when 5 then 'XQZVW' else p_type end as raw,
  case when p_partkey % 6 = 4 then ';' else ', ' end as sep
from {part}
"""

# Whole submission rows: what each cell holds follows from the customer number.
ROWS = """
select c_custkey as id, c_nationkey as file_ix, concat('nation_', cast(c_nationkey as string), '.xlsx') as file,
  'Data' as sheet, cast(c_custkey + 2 as int) as source_row, c_custkey + 2 as merged_row,
  case when c_custkey % 3 = 1 then concat(' ', c_name) else c_name end as participant_name,
  case when c_custkey % 11 = 0 then null else concat('u', cast(c_custkey % 97 as string), '@x.org') end
    as participant_email,
  case c_custkey % 4 when 0 then concat(cast(1950 + c_custkey % 50 as string), '/07')
    when 1 then concat(cast(1950 + c_custkey % 50 as string), '-07') when 2 then 'unknown' else null end as birthdate,
  case c_custkey % 5 when 0 then 'Glasses' when 1 then 'Glases' when 2 then 'Sombrero' when 3 then 'Hat;Scarf'
    else null end as head_and_hair,
  cast(null as string) as facial_features, cast(null as string) as accessories,
  case c_custkey % 7 when 0 then '/' when 1 then 'Freckels, Bindi' else null end as others,
  case c_custkey % 2 when 0 then 'N/A-none apply' else null end as none_apply
from {customer}
"""

# ---- spreadsheets as long cell tables -------------------------------------------------------------------------------
# One workbook per nation.  Header row 1 + n % 4, columns rotated by n, header spelling by n % 3, the country column
# missing where n % 5 = 0, an unknown column where n % 3 = 1.
_FIELDS = (
    (0, "'Participant Name As Per ICF'", "c_name"),
    (1, "'Participant Email'", "concat('u', cast(c_custkey % 97 as string), '@x.org')"),
    (2, "case when n % 2 = 1 then 'DOB' else 'Birthdate' end",
     "concat(cast(1950 + c_custkey % 50 as string), '-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'))"),
    (3, "'Device'", "c_mktsegment"),
    (4, "'Country of Collection'", "concat('N', cast(n as string))"),
    (5, "'Internal Ref'", "concat('ref ', cast(c_custkey as string))"),
)


def _present(k: int) -> str:
    return {4: "n % 5 <> 0", 5: "n % 3 = 1"}.get(k, "true")


def _cells() -> str:
    file, head = "concat('nation_', cast(n as string), '.xlsx')", "1 + n % 4"
    nation = "(select n_nationkey as n from {nation})"
    customer = "(select *, c_nationkey as n from {customer})"
    parts = [
        f"select {file} as file_id, 'Data' as sheet, 0 as sheet_ix, 'visible' as sheet_state, 1 as row, 1 as col, "
        f"concat('Submission ', cast(n as string)) as s from {nation} t where n % 4 > 0"
    ]
    for k, header, value in _FIELDS:
        spelt = (
            f"case n % 3 when 0 then {header} when 1 then upper({header}) else concat(' ', {header}, ' : ') end"
        )
        parts.append(
            f"select {file}, 'Data', 0, 'visible', {head}, 1 + (n + {k}) % 6, {spelt} from {nation} t "
            f"where {_present(k)}"
        )
        parts.append(
            f"select {file}, 'Data', 0, 'visible', cast({head} + 1 + c_custkey as int), 1 + (n + {k}) % 6, {value} "
            f"from {customer} t where {_present(k)}"
        )
    return " union all ".join(parts)


CELLS = f"""
select file_id, sheet, sheet_ix, sheet_state, cast(row as int) as row, cast(col as int) as col, 'string' as kind, s,
  cast(null as double) as d, cast(null as timestamp) as ts, cast(null as boolean) as b
from ({_cells()}) c
"""
CELL_FILES = """
select concat('nation_', cast(n_nationkey as string), '.xlsx') as file_id, cast(n_nationkey as bigint) as file_ix,
  concat('nation_', cast(n_nationkey as string), '.xlsx') as name,
  concat('/lot/Group ', cast(n_nationkey as string), '/nation_', cast(n_nationkey as string), '.xlsx') as path,
  'Upload' as origin
from {nation}
"""

# One metadata workbook per nation with tick columns; a vocabulary reference sheet before the data; every sixth
# workbook is something else altogether.
_TICKS = (("Glasses", 2), ("Hat", 3), ("Mustache", 5), ("Earrings", 7), ("Other tattons", 11))


def _mark_cells() -> str:
    file, head = "concat('nation_', cast(n as string), '.xlsx')", "1 + n % 7"
    nation = "(select n_nationkey as n from {nation})"
    customer = "(select *, c_nationkey as n from {customer})"
    usable = "n % 6 <> 5"
    parts = [
        f"select {file} as file_id, 'Head_Attributes' as sheet, 0 as sheet_ix, 1 as row, {i + 1} as col, '{t}' as s "
        f"from {nation} t" for i, t in enumerate(("Glasses", "Hat", "Beard", "Scarf"))
    ]
    for i, h in enumerate(("Invoice number", "Client", "Amount due")):
        parts.append(f"select {file}, 'Invoices', 1, 1, {i + 1}, '{h}' from {nation} t where not ({usable})")
    headers = ["Participant Name", "Birth Date", "Environment", *[t for t, _ in _TICKS]]
    for i, h in enumerate(headers):
        parts.append(f"select {file}, 'Data', 1, {head}, {i + 1}, '{h}' from {nation} t where {usable}")
    values = [
        "case when c_custkey % 10 = 9 then ' ' else c_name end", "cast(1950 + c_custkey % 50 as string)", "'Indoor'",
        *[f"case when c_custkey % {p} = 0 then ' X ' else '' end" for _, p in _TICKS],
    ]
    for i, v in enumerate(values):
        parts.append(
            f"select {file}, 'Data', 1, cast({head} + 1 + c_custkey as int), {i + 1}, {v} from {customer} t "
            f"where {usable}"
        )
    return " union all ".join(parts)


MARK_CELLS = f"""
select file_id, sheet, sheet_ix, 'visible' as sheet_state, cast(row as int) as row, cast(col as int) as col,
  'string' as kind, s, cast(null as double) as d, cast(null as timestamp) as ts, cast(null as boolean) as b
from ({_mark_cells()}) c
"""

# ---- media listings ---------------------------------------------------------------------------------------------------
# Four events make one participant.  Every event is one media file; consent and assent files come 0, 1 or 2 to a
# participant.  The columns after ``name`` are the answers.
_P = "cast(floor(event_id / 4) as bigint)"
_PID = f"lpad(cast({_P} as string), 7, '0')"
_EID = "lpad(cast(event_id as string), 8, '0')"
_ENV = "case event_id % 3 when 0 then 'Indoor' when 1 then 'Outdoor' else null end"
_ENV_PART = "case event_id % 3 when 0 then '_INDOOR' when 1 then '_OUTDOOR' else '' end"
_NEUTRAL = "(event_id % 5 in (0, 3))"
_WORD = f"case when {_NEUTRAL} and event_id % 11 = 0 then 'N3UTRAL' when {_NEUTRAL} then 'NEUTRAL' else upper(event_type) end"
_EXT = ("case event_id % 7 when 0 then '.MOV' when 1 then ',mp4' when 2 then '.mp4 take' when 3 then '.txt' "
        "else '.mp4' end")
_VIDEO_NAME = f"concat('USER', {_PID}, {_ENV_PART}, '_', {_WORD}, '_', {_EID}, {_EXT})"
_KIND = "case when event_id % 7 = 3 then 'other' else 'video' end"
_FIRST = f"(select distinct {_P} as p, {_PID} as pid from {{events}})"


def _paper(kind: str, copy: int, where: str, ext: str) -> str:
    word = "CONSENT-FORM" if kind == "icf" else "ASSENT_FORM"
    name = f"concat('USER', pid, '-{word}-{copy}{ext}')"
    return (
        f"select p, concat('user', pid) as name_key, concat('/lot/User', pid, '/', {name}) as path, {name} as name, "
        f"'{kind}' as kind, cast(null as string) as environment, cast(null as string) as expression, "
        f"cast(null as string) as token, timestamp '2024-01-01 00:00:00' as server_modified, "
        f"case when p % 3 = 0 then concat('https://www.dropbox.com/scl/fi/', pid, '/{kind}{copy}?rlkey=k', pid, "
        f"'&st=zz&dl=0') end as link from {_FIRST} f where {where}"
    )


FILES = f"""
select p, name_key, path, name, kind, environment, expression, token, server_modified, link from (
select {_P} as p, concat('user', {_PID}) as name_key, concat('/lot/User', {_PID}, '/', {_VIDEO_NAME}) as path,
  {_VIDEO_NAME} as name, {_KIND} as kind,
  case when event_id % 7 <> 3 then {_ENV} end as environment,
  case when event_id % 7 <> 3 then case when {_NEUTRAL} then 'Neutral' else 'Non-Neutral' end end as expression,
  case when event_id % 7 <> 3 then case when {_NEUTRAL} then lower({_WORD}) when event_id % 7 = 2 then 'take'
    else lower(event_type) end end as token,
  ts as server_modified,
  case when event_id % 3 = 0 then concat('https://www.dropbox.com/scl/fi/', {_EID}, '/F.mp4?rlkey=k',
    cast(event_id as string), '&st=abc&dl=1') end as link
from {{events}}
union all {_paper('icf', 1, 'p % 5 > 0', '.pdf')}
union all {_paper('icf', 2, 'p % 5 = 2', '.pdf')}
union all {_paper('assent', 1, 'p % 7 > 0', '.jpg')}
union all {_paper('assent', 2, 'p % 7 = 1', '.png')}
) f
"""

# One sheet row per event: what it wants, with one participant in thirteen spelt as somebody else.
SHEET = f"""
select event_id + 2 as merged_row,
  case when {_P} % 13 = 0 then concat('Nobody ', {_PID}) when event_id % 2 = 0 then concat('USER', {_PID})
    else concat(' user', {_PID}, '_') end as folder_name,
  case when {_P} % 13 = 0 then concat('nobody ', {_PID}) else concat('user', {_PID}) end as name_key,
  case when event_id % 9 = 0 then '' when event_id % 9 = 1 then 'studio' else coalesce({_ENV}, '') end as environment,
  case when event_id % 10 = 7 then '' when {_NEUTRAL} then 'neutral' else 'Non-Neutral' end as expression,
  case when {_NEUTRAL} then cast(null as string) when event_id % 4 = 0 then concat(event_type, 'x')
    else event_type end as non_neutral,
  concat('User', {_PID}) as participant_name,
  case when event_id % 17 = 0 then '2020-01-01' end as recorded_at,
  case when event_id % 19 = 0 then 'old' end as video_url, cast(null as string) as icf_url,
  cast(null as string) as assent_url
from {{events}}
"""

# One participant with a third of all videos in one slot, the others with 2 to about 60; words of 7, of 3 and of 285
# characters.  Every seventh order asks for a word: the token, the token misspelt, inside a sentence, a part, or something else.
_CAST = "case when o_orderkey % 3 = 0 then 'cast 0' else concat('cast ', cast(cast(1 + floor(sqrt(cast(floor(o_orderkey / 7) as double))) as bigint) as string)) end"
_HEX = "md5(cast(o_orderkey as string))"
_TOKEN = (f"case when o_orderkey % 3 = 1 and o_orderkey % 5 = 0 then concat('q', repeat({_HEX}, 8), substr({_HEX}, 1, 28)) "
          f"when o_orderkey % 11 = 0 then concat('k', substr({_HEX}, 1, 2)) else concat('w', substr({_HEX}, 1, 6)) end")
CONTESTED_FILES = f"""
select o_orderkey as id, troupe as name_key, token, concat('/lot/', troupe, '/INDOOR_', upper(token), '.mp4') as path,
  concat('INDOOR_', upper(token), '.mp4') as name from (select o_orderkey, {_CAST} as troupe, {_TOKEN} as token from {{orders}}) t
"""
CONTESTED_SHEET = """
select id as merged_row, name_key, case id % 2 when 0 then 'indoor' else '' end as environment, cast('' as string) as expression,
  upper(name_key) as folder_name, case floor(id / 7) % 6 when 0 then token
    when 1 then concat(substr(token, 1, length(token) - 2), 'z', substr(token, length(token)))
    when 2 then concat(substr(token, 2, 1), substr(token, 1, 1), substr(token, 3), 'y')
    when 3 then concat('the ', token, ' one') when 4 then substr(token, 2, 4) else concat('zzyzx', cast(id as string)) end as non_neutral
from (""" + CONTESTED_FILES + """) f where id % 7 = 1
"""

# Groups of exactly 1, 100 and 101 consent files, a third of the rest in one group, the others in groups of seven.
_PLACED = "(select o_orderkey as id, row_number() over (order by o_orderkey) as n from {orders})"
PAPERS = """
select id, folder, concat('ICF ', lpad(cast(id as string), 9, '0'), '.pdf') as name,
  concat('/lot/', folder, '/ICF ', lpad(cast(id as string), 9, '0'), '.pdf') as path,
  lower(folder) as name_key from (
  select id, case when n = 1 then 'One' when n <= 101 then 'Hundred' when n <= 202 then 'More' when n % 3 = 0 then 'Hot'
    else concat('Seven ', cast(cast(floor(n / 10) as bigint) as string)) end as folder
  from """ + _PLACED + """ r) g
"""
PAPER_SHEET = """
select distinct name_key, folder as folder_name, cast('Indoor' as string) as environment, cast('' as string) as expression,
  cast(null as string) as non_neutral, min(id) over (partition by folder) as merged_row from (""" + PAPERS + """) p
"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``PAPERS``, orders placed by running sums of counts instead of one window over all of them."""
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    placed = running_offset(counts.withColumn("_p", F.coalesce("id", F.lit(-(1 << 63)))), "_p", "c", "before")  # nulls come first
    numbered = placed.select("id", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("c"))).alias("n"))
    return spark.sql(PAPERS.replace(_PLACED, "{numbered}"), numbered=numbered)


def paper_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``PAPER_SHEET``: a row per folder, combined before it is shuffled."""
    folders = papers(spark, sf_dir).groupBy("folder").agg(F.min("id").alias("merged_row"))
    return folders.select(
        F.lower("folder").alias("name_key"), F.col("folder").alias("folder_name"), F.lit("Indoor").alias("environment"),
        F.lit("").alias("expression"), F.lit(None).cast("string").alias("non_neutral"), "merged_row")


# A merged delivery sheet with 30 columns by position, in a workbook of two sheets; the other workbook holds the same rows.
_DELIVERY_VALUES = {
    4: "concat('Group ', cast(c_nationkey as string))", 6: "c_name", 18: "case when c_custkey % 5 = 0 then 'Glases' end",
    22: "case when c_custkey % 5 = 0 then null else 'N/A-none apply' end", 
}
_LINES = " union all ".join(
    f"select cast(c_custkey + 2 as int) as row, {col} as col, case when c_custkey % 4 = 3 then ' ' else {value} end as s from {{customer}}"
    for col, value in _DELIVERY_VALUES.items()
)
OVERRIDE_CELLS = f"""
select file_id, sheet, sheet_ix, 'visible' as sheet_state, row, cast(col as int) as col, 'string' as kind, s, cast(null as double) as d,
  cast(null as timestamp) as ts, cast(null as boolean) as b from (
  select 'b.xlsx' as file_id, 'Merged' as sheet, 1 as sheet_ix, row, col, s from ({_LINES}) a
  union all select 'b.xlsx', 'Merged', 1, 1, 6, 'Participant Name As Per ICF'
  union all select 'b.xlsx', 'Merged', 1, 5, 31, 'beyond the last column'
  union all select 'b.xlsx', 'Notes', 0, row, col, 'not this sheet' from ({_LINES}) b
  union all select 'a.xlsx', 'Merged', 0, row, col, s from ({_LINES}) c) d
where s is not null
"""
OVERRIDE_FILES = """
select concat(x, '.xlsx') as file_id, cast(length(x) as bigint) as file_ix, concat(x, '.xlsx') as name, concat('/lot/', x, '.xlsx') as path
from (select distinct case when r_regionkey % 2 = 0 then 'a' else 'b' end as x from {region}) r
"""
