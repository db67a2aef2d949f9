"""Every operator as a query over the test tables, each with the SQL that states the expected answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import distance, filenames, links, vocab
from rowwarden.functions import text as tx
from rowwarden.functions.dates import parse_birthdate
from rowwarden.operators import annotate as ann
from rowwarden.operators import headers, identity, match, reports, rules, shape, spread
from rowwarden.operators import issues as iss
from rowwarden.operators.layouts import CANONICAL, DELIVERY
from rowwarden.plans import replan
from rowwarden.plans.consolidate import consolidate
from rowwarden.plans.deliver import merge_metadata, workbook_issues
from rowwarden.queries import books, mess
from rowwarden.session import by_merge, remove_at_end, shared_folder, staged
from rowwarden.sources import exports, listing, workbooks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
YEAR = 2026
PRESET = fixed.PRESETS["consent_first"]
ROOTS = ["/lot"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = mess.duck(oracle)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


# ---- text, dates, vocabulary ------------------------------------------------------------------------------------------

@query(f"""
select id, case id % 5 when 0 then clean when 1 then clean when 4 then null else concat(clean, ' Jr') end as name,
  cast(id % 5 <> 0 as int) as changed, cast(id % 5 = 4 as int) as blank
from ({mess.NAMES}) g
""")
def whitespace_clean(spark, sf_dir):
    g = mess.run(spark, sf_dir, mess.NAMES)
    raw, name = F.col("raw"), F.col("name")
    return g.withColumn("name", tx.tidy_or_null(raw)).select(
        "id", "name", flag(~name.eqNullSafe(raw)).alias("changed"), flag(tx.is_blank(raw)).alias("blank")
    )


def _parsed(spark, sf_dir) -> DataFrame:
    g = mess.run(spark, sf_dir, mess.BIRTHDATES)
    bd = parse_birthdate(F.col("raw"), current_year=YEAR, number=F.col("number"))
    return g.select("id", bd.alias("bd")).select("id", "bd.value", "bd.status")


@query(mess.BIRTHDATE_ANSWERS)
def birthdate_normalise(spark, sf_dir):
    return _parsed(spark, sf_dir)


@query(f"select status, count(*) as n from ({mess.BIRTHDATE_ANSWERS}) a group by status")
def birthdate_status_counts(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Typed cells, short years, and months and years out of range: what the texts above leave out.
_TYPED = """
select id, v, y, m, d, ym, case when v = 1 then cast(concat(y, '-', m, '-', d, ' 10:00:00') as timestamp) end as ts,
  case v when 2 then cast(y as double) when 3 then cast(concat(y, m) as double) when 4 then cast(concat(y, m, d) as double)
    when 5 then cast(90000 + id as double) + 0.5 when 6 then -1.0 * id end as number,
  case v when 7 then concat(d, '/', m, '/', substr(y, 3, 2)) when 8 then concat('13/', y) when 9 then concat('1850/', m)
    when 10 then concat(m, '/', substr(y, 3, 2)) when 11 then concat(m, '/', d, '/', y) when 0 then '  ' end as raw
from (select o_orderkey as id, o_orderkey % 12 as v, cast(1950 + o_orderkey % 50 as string) as y,
    lpad(cast(1 + o_custkey % 12 as string), 2, '0') as m, lpad(cast(1 + o_custkey % 28 as string), 2, '0') as d,
    concat(cast(1950 + o_orderkey % 50 as string), '/', lpad(cast(1 + o_custkey % 12 as string), 2, '0')) as ym from {orders}) o
"""


@query(f"""
select id, case when v in (1, 3, 4) then ym when v = 7 then ym when v = 9 then concat('1850/', m) when v = 10 then ym
    when v = 11 then concat(y, '/', m) end as value,
  case when v = 0 then 'empty' when v in (1, 3, 4) then 'fixed' when v = 2 then 'review' when v in (5, 6, 8) then 'unparseable'
    when v = 11 and cast(d as int) > 12 then 'fixed' else 'review' end as status,
  case when v = 7 and cast(d as int) > 12 then null when v = 7 then concat(y, '/', d) else '-' end as month_first
from ({_TYPED}) t
""")
def birthdate_typed(spark, sf_dir):
    """Cells typed as dates and numbers, years of two digits, months and years out of range; months before days where asked."""
    g = mess.run(spark, sf_dir, _TYPED)
    cell = {"number": F.col("number"), "timestamp": F.col("ts")}
    a = parse_birthdate(F.col("raw"), current_year=YEAR, day_first=True, **cell)
    b = parse_birthdate(F.col("raw"), current_year=YEAR, day_first=False, **cell)
    # Where both orders are possible the month is the second number, or the first.
    return g.select("id", "v", a.alias("a"), b.alias("b")).select(
        "id", F.when(F.col("v") == 11, F.col("b.value")).otherwise(F.col("a.value")).alias("value"),
        F.when(F.col("v") == 11, F.col("b.status")).otherwise(F.col("a.status")).alias("status"),
        F.when(F.col("v") == 7, F.col("b.value")).otherwise(F.lit("-")).alias("month_first"))


# Numbers whose digits and place are known: up to 15 digits d at 10^e, and the ends of what a double holds.
_DIGITS = "cast(1 + (o_orderkey * 7919 + o_custkey) % 999999999 as string)"
_NUMBERS = f"""
select id, d, e, concat(d, 'E', cast(e as string)) as written from (
  select o_orderkey as id, {_DIGITS} as d, cast(o_orderkey % 560 - 285 as int) as e from {{orders}}) n
union all select -1, '5', -324, '5E-324' union all select -2, '17976931348623157', 292, '17976931348623157E292'
union all select -3, '22250738585072014', -324, '22250738585072014E-324' union all select -4, '30000000000000004', -17, '0.30000000000000004'
union all select -5, '1', 23, '1E23' union all select -6, '9007199254740993', 3, '9007199254740993E3'
"""


@query(f"""
select id, concat(case when id % 2 = 0 then '-' else '' end, case
  when k <= n and n <= 21 then rpad(s, n, '0')
  when n between 1 and 21 then concat(substr(s, 1, n), '.', substr(s, n + 1))
  when n between -5 and 0 then concat('0.', repeat('0', -n), s)
  else concat(substr(s, 1, 1), case when k > 1 then '.' else '' end, substr(s, 2), 'e', case when n > 0 then '+' else '-' end,
    cast(abs(n - 1) as string)) end) as number_text
from (select id, regexp_replace(d, '0+$', '') as s, cast(length(regexp_replace(d, '0+$', '')) as int) as k, cast(length(d) + e as int) as n from ({_NUMBERS}) g) h
""")
def number_texts(spark, sf_dir):
    x = F.col("written").cast("double") * F.when(F.col("id") % 2 == 0, -1).otherwise(1)
    return mess.run(spark, sf_dir, _NUMBERS).select("id", tx.number_text(x).alias("number_text"))


_OTHERS = """
select p_partkey as id, case p_partkey % 5 when 0 then '/' when 1 then ' / / ' when 2 then '|-/' when 3 then 'n/a'
  else '--' end as others from {part}
"""


@query(f"""
select id, case when id % 5 < 3 then null else others end as others, cast(id % 5 < 3 as int) as cleared
from ({_OTHERS}) g
""")
def slash_placeholder(spark, sf_dir):
    g = mess.run(spark, sf_dir, _OTHERS)
    return rules.clear_placeholder(g, CANONICAL).select("id", "others", F.size("issues").alias("cleared"))


_PAIRS = """
select p_partkey as id, p_name as a, case p_partkey % 6 when 0 then p_name
  when 1 then substr(p_name, 1, length(p_name) - 1) when 2 then concat(p_name, 'q')
  when 3 then concat(substr(p_name, 1, 1), substr(p_name, 3, 1), substr(p_name, 2, 1), substr(p_name, 4))
  when 4 then concat('#', substr(p_name, 2)) else '' end as b
from {part}
"""


@query(f"""
select id, cast(damerau_levenshtein(a, b) as int) as distance,
  case when length(a) < 5 then 1 when length(a) < 9 then 2 else 3 end as allowed
from ({_PAIRS}) g
""")
def edit_distance_pairs(spark, sf_dir):
    g = mess.run(spark, sf_dir, _PAIRS)
    return g.select(
        "id", distance.edit_distance(F.col("a"), F.col("b")).alias("distance"),
        distance.max_edits(F.length("a")).alias("allowed"),
    )


@query(f"""
select id, case variant when 1 then 'normalized' when 2 then 'corrected' when 3 then 'corrected' when 5 then 'unknown'
  else 'exact' end as status, case when variant <> 5 then term end as value
from ({mess.ANSWERS}) g
""")
def vocab_match(spark, sf_dir):
    g = mess.run(spark, sf_dir, mess.ANSWERS)
    m = vocab.match_vocabulary(F.col("raw"), mess.PART_VOCABULARY)
    return g.select("id", m.alias("m")).select("id", "m.status", "m.value")


@query(f"""
select id, concat(case when variant = 5 then raw else term end, ', MEDIUM') as value,
  cast(variant in (1, 2, 3) as int) as n_corrected, cast(variant = 5 as int) as n_unresolved
from ({mess.ANSWERS}) g
""")
def vocab_cell(spark, sf_dir):
    g = mess.run(spark, sf_dir, mess.ANSWERS)
    cell = F.concat("raw", "sep", F.lit("MEDIUM"))
    o = F.col("o")
    return g.select("id", vocab.cell_outcomes(cell, mess.PART_VOCABULARY).alias("o")).select(
        "id", vocab.cell_value(o).alias("value"), F.size(vocab.corrected_pairs(o)).alias("n_corrected"),
        F.size(vocab.unresolved_parts(o)).alias("n_unresolved"),
    )


_NONE = """
select c_custkey as id, case when c_custkey % 2 = 0 then 'Hat' end as head_and_hair,
  case when c_custkey % 3 = 0 then 'Beard' end as facial_features, cast(null as string) as accessories,
  cast(null as string) as others,
  case c_custkey % 5 when 0 then 'N/A-none apply' when 1 then 'none' else null end as none_apply
from {customer}
"""


@query(f"""
select id, case when filled then null else 'N/A-none apply' end as none_apply,
  case when filled and none_apply is not null then 'Head attribute conflict resolved'
    when not filled and coalesce(none_apply, '') <> 'N/A-none apply' then 'Head attribute placeholder added'
    end as rule
from (select *, head_and_hair is not null or facial_features is not null as filled from ({_NONE}) g) h
""")
def none_follows_block(spark, sf_dir):
    done = rules.settle_none(mess.run(spark, sf_dir, _NONE), CANONICAL)
    return done.select("id", "none_apply", F.try_element_at("issues", F.lit(1)).rule.alias("rule"))


def _ruled(spark, sf_dir) -> DataFrame:
    return rules.apply_rules(mess.run(spark, sf_dir, mess.ROWS), CANONICAL, current_year=YEAR)


_ISSUE_BRANCHES = [
    ("id % 3 = 1", "fixed", "Whitespace cleaned", "A", "participant_name", "ltrim(participant_name)"),
    ("id % 4 = 1", "fixed", "Birthdate reformatted to YYYY/MM", "H", "birthdate", "replace(birthdate, '-', '/')"),
    ("id % 4 = 2", "review", "Birthdate needs a manual fix", "H", "birthdate", "birthdate"),
    ("id % 7 = 0", "fixed", "Slash placeholder cleared", "P", "others", "''"),
    ("id % 5 = 1", "fixed", "Value matched to the accepted list", "M", "head_and_hair", "'Glasses'"),
    ("id % 5 = 3", "fixed", "Value matched to the accepted list", "M", "head_and_hair", "'Hat, Scarf'"),
    ("id % 5 = 2", "review", "Value not on the accepted list", "M", "head_and_hair", "head_and_hair"),
    ("id % 7 = 1", "fixed", "Value matched to the accepted list", "P", "others", "'Freckles, Bindi'"),
    ("(id % 5 <> 4 or id % 7 = 1) and id % 2 = 0", "fixed", "Head attribute conflict resolved", "Q",
     "none_apply", "''"),
    ("id % 5 = 4 and id % 7 <> 1 and id % 2 = 1", "fixed", "Head attribute placeholder added", "Q",
     "none_apply", "'N/A-none apply'"),
]
_EXPECTED_ISSUES = " union all ".join(
    f"select merged_row, file_ix, '{sev}' as severity, '{rule}' as rule, '{col}' as column_letter, "
    f"coalesce({orig}, '') as original, {corr} as corrected from ({mess.ROWS}) g where {cond}"
    for cond, sev, rule, col, orig, corr in _ISSUE_BRANCHES
)


@query(_EXPECTED_ISSUES)
def row_rules_issues(spark, sf_dir):
    return iss.explode_row_issues(_ruled(spark, sf_dir)).select(
        "merged_row", "file_ix", "severity", "rule", F.col("column").alias("column_letter"), "original", "corrected"
    )


@query(f"""
select count(*) filter (where severity = 'error') as error, count(*) filter (where severity = 'review') as review,
  count(*) filter (where severity = 'fixed') as fixed from ({_EXPECTED_ISSUES}) e
""")
def severity_counts(spark, sf_dir):
    return iss.severity_counts(iss.explode_row_issues(_ruled(spark, sf_dir)))


@query(f"""
select merged_row, severity, rule from ({_EXPECTED_ISSUES}) e
where severity = 'review' and contains(lower(concat_ws(' ', rule, original, corrected)), 'somb')
""")
def issue_search(spark, sf_dir):
    found = iss.search_issues(iss.explode_row_issues(_ruled(spark, sf_dir)), "review", " SOMBR ")
    return found.select("merged_row", "severity", "rule")


@query(f"""
select merged_row as "row", cast(case column_letter when 'H' then 8 else 13 end as int) as "column", rule
from ({_EXPECTED_ISSUES}) e where severity = 'review'
""")
def review_marks(spark, sf_dir):
    marks = iss.review_marks(iss.explode_row_issues(_ruled(spark, sf_dir)), CANONICAL)
    return marks.select("row", "column", F.substring_index("note", ":", 1).alias("rule"))


_DUP_ROWS = f"select *, case when id % 11 = 0 then concat('P ', cast(id % 53 as string)) else participant_name end as who from ({mess.ROWS}) g"


@query(f"""
select merged_row, case when participant_email is null then 'A' else 'B' end as column_letter,
  coalesce(participant_email, who) as original, first_row
from (select *, min(merged_row) over (partition by coalesce('e' || participant_email, 'n' || lower(who)))
  as first_row from ({_DUP_ROWS}) d) f
where merged_row > first_row
""")
def duplicates_first_seen(spark, sf_dir):
    rows = mess.run(spark, sf_dir, _DUP_ROWS).withColumn("participant_name", F.col("who"))
    dup = iss.find_duplicates(rows, CANONICAL)
    first = F.regexp_extract("message", r"merged row (\d+)", 1).cast("bigint")
    return dup.select("merged_row", F.col("column").alias("column_letter"), "original", first.alias("first_row"))


# ---- numbering --------------------------------------------------------------------------------------------------------

@query("""
select l_orderkey, l_linenumber, l_suppkey,
  row_number() over (order by l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) + 1
    as merged_row
from (select distinct l_orderkey, l_linenumber, l_suppkey, 0 as l_partkey, 0 as l_quantity, 0 as l_extendedprice
  from {lineitem}) d
""")
def merged_positions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    placed = lines.withColumn("position", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return spread.number_rows(placed, "l_suppkey", "position", "merged_row", start=2).drop("position")


@query("""
select doc_id, source, case when n = 0 then name else concat(source, ' (', cast(n as string), ').xlsx') end
  as archive_name
from (select doc_id, source, concat(source, '.xlsx') as name,
  row_number() over (partition by source order by doc_id) - 1 as n from {documents}) d
""")
def archive_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "source", F.concat("source", F.lit(".xlsx")).alias("name"), F.col("doc_id").alias("file_ix"))
    return listing.archive_names(files).select("doc_id", "source", "archive_name")


@query("""
select concat(lang, '.xlsx') as name, n_chars as length, min(doc_id) as file_ix from {documents} group by lang, n_chars
""")
def input_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select(
        F.concat("lang", F.lit(".xlsx")).alias("name"), F.col("n_chars").alias("length"),
        F.col("doc_id").alias("file_ix"), "source",
    )
    return listing.drop_repeated_inputs(files).select("name", "length", "file_ix")


@query("select url, dense_rank() over (order by page_key) - 1 as file_ix from (select url, url as page_key from {pages} group by url) p")
def file_positions(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    return listing.index_files(urls, "url").select("url", "file_ix")


_UPLOADS = """
select doc_id, concat(case when doc_id % 8 = 7 then '~$' else '' end, source, case doc_id % 4 when 0 then '.xlsx'
  when 1 then '.XLSM' when 2 then '.xls' else '.xlsx.pdf' end) as name from {documents}
"""


@query(f"""
select doc_id, cast(doc_id % 4 < 2 as int) as accepted, cast(doc_id % 4 < 2 and doc_id % 8 <> 7 as int) as workbook
from ({_UPLOADS}) u
""")
def upload_filter(spark, sf_dir):
    files = mess.run(spark, sf_dir, _UPLOADS)
    taken, refused = listing.split_uploads(files)
    books, media = listing.split_listing(files)
    accepted = taken.withColumn("accepted", F.lit(1)).unionByName(refused.withColumn("accepted", F.lit(0)))
    kinds = books.select("doc_id", F.lit(1).alias("workbook")).unionByName(media.select("doc_id", F.lit(0).alias("workbook")))
    return accepted.join(kinds, "doc_id").select("doc_id", "accepted", "workbook")


_BOOK_ROWS = """
select cast(floor(c_custkey / 40) as bigint) as book, c_custkey as key, c_name as name, cast(c_acctbal as double) as amount,
  cast(20000 + c_custkey % 20000 as bigint) as serial from {customer}
"""


@query(f"""
with r as (select *, row_number() over (partition by book order by key) + 1 as pos, concat('book ', cast(book as string), '.xlsx') as file_id
  from ({_BOOK_ROWS}) b where book % 7 <> 3)
select file_id, 'Data' as sheet, cast(pos as int) as row, cast(1 as int) as col, 'string' as kind, name as value from r
union all select file_id, 'Data', cast(pos as int), 2, 'number', cast(amount as varchar) from r
union all select file_id, 'Data', cast(pos as int), 3, 'date', strftime(date '1899-12-30' + cast(serial as int), '%Y-%m-%d') from r
union all select file_id, 'Data', cast(pos as int), 4, 'boolean', case when key % 2 = 1 then 'true' else 'false' end from r
union all select distinct file_id, 'Data', 1, 1, 'string', 'Name' from r
union all select distinct concat('book ', cast(book as string), '.xlsx'), null, 0, 0, 'unreadable', null from ({_BOOK_ROWS}) b where book % 7 = 3
""")
def workbook_cells(spark, sf_dir):
    """Workbooks of text in three forms, numbers, dates, flags and errors, built from rows and decoded again; some damaged."""
    cells = workbooks.decode_cells(books.workbooks(mess.run(spark, sf_dir, _BOOK_ROWS)))
    shown = F.when(F.col("kind") == "number", F.col("d").cast("string")).when(F.col("kind") != "unreadable", F.col("s"))
    return cells.filter("sheet is null or sheet <> 'Notes'").select("file_id", "sheet", "row", "col", "kind", shown.alias("value"))


# ---- headers and shape ------------------------------------------------------------------------------------------------

_N = "(select n_nationkey as n, concat('nation_', cast(n_nationkey as string), '.xlsx') as file_id from {nation}) t"


def _headers(spark, sf_dir) -> DataFrame:
    return headers.detect_canonical(mess.run(spark, sf_dir, mess.CELLS))


@query(f"""
select file_id, cast(1 + n % 4 as int) as header_row, cast(case when n % 5 = 0 then 4 else 5 end as int) as hits,
  cast(1 + n % 6 as int) as name_col, cast(1 + (n + 2) % 6 as int) as birthdate_col from {_N}
""")
def header_detect(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "file_id", "header_row", "hits", F.get("cols", F.lit(0)).alias("name_col"),
        F.get("cols", F.lit(CANONICAL.fields.index("birthdate"))).alias("birthdate_col"),
    )


def _missing(with_country: bool) -> str:
    have = {"participant_name", "participant_email", "birthdate", "device"} | ({"country"} if with_country else set())
    return ", ".join(h for f, h in CANONICAL.columns if f not in have)


@query(f"select file_id, case when n % 5 = 0 then '{_missing(False)}' else '{_missing(True)}' end as missing from {_N}")
def header_missing(spark, sf_dir):
    return headers.missing_headers(_headers(spark, sf_dir)).select(
        "file_id", F.array_join("missing", ", ").alias("missing")
    )


@query(f"select file_id, 'INTERNAL REF' as extra from {_N} where n % 3 = 1")
def header_extra(spark, sf_dir):
    found = _headers(spark, sf_dir).select("file_id", F.array_join("unmatched", ", ").alias("extra"))
    return found.filter(F.col("extra") != "")


_C = "(select *, c_nationkey as n, concat('nation_', cast(c_nationkey as string), '.xlsx') as file_id from {customer}) c"
_BIRTH = "cast(1950 + c_custkey % 50 as string)"


@query(f"""
select file_id, cast(2 + n % 4 + c_custkey as int) as source_row, c_name as participant_name,
  concat('u', cast(c_custkey % 97 as string), '@x.org') as participant_email,
  concat({_BIRTH}, '-', lpad(cast(1 + c_custkey % 12 as string), 2, '0')) as birthdate, c_mktsegment as device,
  case when n % 5 <> 0 then concat('N', cast(n as string)) end as country from {_C}
""")
def canonical_rows(spark, sf_dir):
    cells = _cells(spark, sf_dir, mess.CELLS)
    rows = shape.project_canonical(cells, headers.detect_canonical(cells))
    return rows.select(
        "file_id", "source_row", "participant_name", "participant_email", "birthdate", "device", "country"
    )


# Three sheets a workbook: a hidden one that matches best, one that matches a little, one that matches more; every fifth
# workbook has the first two only.  Rows blank in all mapped columns between the others.
_CHOICES = """
select file_id, sheet, sheet_ix, sheet_state, cast(row as int) as row, cast(col as int) as col, 'string' as kind, s,
  cast(null as double) as d, cast(null as timestamp) as ts, cast(null as boolean) as b from (
  select n, concat('nation_', cast(n as string), '.xlsx') as file_id, sheet, sheet_ix, sheet_state, row, col, s from (
    select n_nationkey as n, 'Secret' as sheet, 0 as sheet_ix, 'veryHidden' as sheet_state, 1 as row, k as col, h as s from {nation}, (
      select 1 as k, 'Participant Email' as h union all select 2, 'Birthdate' union all select 3, 'Device' union all select 4, 'Gender') w
    union all select n_nationkey, 'Little', 1, 'visible', 2, 1, 'Participant Email' from {nation}
    union all select n_nationkey, 'More', 2, 'hidden', 1, k, h from {nation}, (
      select 1 as k, 'Age Group' as h union all select 2, 'Device' union all select 4, 'Note') w where n_nationkey % 5 <> 0
    union all select c_nationkey, case when c_nationkey % 5 = 0 then 'Little' else 'More' end, case when c_nationkey % 5 = 0 then 1 else 2 end,
      'visible', c_custkey + 2, k, case when k = 4 then 'a note' when c_custkey % 3 = 0 then ' ' else concat('v', cast(c_custkey as string)) end
      from {customer}, (select 1 as k union all select 4) w) a) b
"""


@query(f"""
select concat('nation_', cast(n as string), '.xlsx') as file_id, case when n % 5 = 0 then 'Little' else 'More' end as sheet,
  cast(c_custkey + 2 as int) as source_row, case when n % 5 = 0 then concat('v', cast(c_custkey as string)) end as participant_email,
  case when n % 5 <> 0 then concat('v', cast(c_custkey as string)) end as age_group
from {_C} where c_custkey % 3 <> 0
""")
def sheet_choice(spark, sf_dir):
    """The sheet that matches best of several, none that is hidden for good; rows blank in every mapped column go."""
    cells = _cells(spark, sf_dir, _CHOICES)
    rows = shape.project_canonical(cells, headers.detect_canonical(cells))
    return rows.select("file_id", "sheet", "source_row", "participant_email", "age_group")


def _cells(spark, sf_dir, generator: str) -> DataFrame:
    """The derived cell table, stored as a decoded one would be."""
    return staged(mess.run(spark, sf_dir, generator))


def _consolidated(spark, sf_dir):
    cells, files = _cells(spark, sf_dir, mess.CELLS), mess.run(spark, sf_dir, mess.CELL_FILES)
    return consolidate(cells, files, current_year=YEAR)


@query(f"""
select row_number() over (order by n, c_custkey) + 1 as merged_row, file_id as file,
  concat({_BIRTH}, '/', lpad(cast(1 + c_custkey % 12 as string), 2, '0')) as birthdate,
  'N/A-none apply' as none_apply, cast(2 as int) as n_issues from {_C}
""")
def consolidated_rows(spark, sf_dir):
    rows = _consolidated(spark, sf_dir).rows
    return rows.select("merged_row", "file", "birthdate", "none_apply", F.size("issues").alias("n_issues"))


_REPORTS = f"""
select t.n as file_ix, t.file_id as name, 'Data' as sheet_name, cast(1 + t.n % 4 as int) as header_row,
  coalesce(k.c, 0) as row_count, case when k.c > 0 then k.upto - k.c + 2 end as first_merged_row,
  case when k.c > 0 then k.upto + 1 end as last_merged_row,
  2 * coalesce(k.c, 0) + 1 + cast(t.n % 3 = 1 as int) as issue_count
from {_N} left join (select c_nationkey as n, count(*) as c, cast(sum(count(*)) over (order by c_nationkey) as bigint)
  as upto from {{customer}} group by c_nationkey) k on k.n = t.n
"""


@query(f"""
select cast(file_ix as bigint) as file_ix, name, sheet_name, header_row, cast(row_count as bigint) as row_count,
  cast(first_merged_row as bigint) as first_merged_row, cast(last_merged_row as bigint) as last_merged_row,
  cast(issue_count as bigint) as issue_count from ({_REPORTS}) r
""")
def file_reports(spark, sf_dir):
    return _consolidated(spark, sf_dir).reports.select(
        "file_ix", "name", "sheet_name", "header_row", "row_count", "first_merged_row", "last_merged_row",
        "issue_count",
    )


_DUP_EMAILS = "(select count(*) - count(distinct c_custkey % 97) as d from {customer})"


@query(f"""
select cast(count(*) as bigint) as files_merged, cast(count(*) as bigint) as files_total,
  cast(sum(row_count) as bigint) as rows_merged, cast(2 * sum(row_count) as bigint) as fixed,
  cast((select d from {_DUP_EMAILS} x) + sum(case when file_ix % 3 = 1 then 1 else 0 end) as bigint) as review,
  cast(count(*) as bigint) as error from ({_REPORTS}) r
""")
def run_summary(spark, sf_dir):
    return _consolidated(spark, sf_dir).summary


_TICK_COLUMNS = {"head_and_hair": ("Glasses", "Hat"), "facial_features": ("Mustache",), "accessories": ("Earrings",),
                 "others": ("Other tattoos",)}
_PRIME = {"Glasses": 2, "Hat": 3, "Mustache": 5, "Earrings": 7, "Other tattoos": 11}


def _ticked(field: str) -> str:
    terms = ", ".join(f"case when c_custkey % {_PRIME[t]} = 0 then '{t}' end" for t in _TICK_COLUMNS[field])
    return f"nullif(concat_ws(', ', {terms}), '') as {field}"


@query(f"""
select file_id, cast(2 + n % 7 + c_custkey as int) as source_row, c_name as participant_name,
  concat('Group ', cast(n as string)) as folder_name, {", ".join(_ticked(f) for f in _TICK_COLUMNS)},
  case when {" and ".join(f"c_custkey % {p} <> 0" for p in _PRIME.values())} then 'N/A-none apply' end as none_apply
from {_C} where n % 6 <> 5 and c_custkey % 10 <> 9
""")
def mark_consolidate(spark, sf_dir):
    cells = _cells(spark, sf_dir, mess.MARK_CELLS)
    files = mess.run(spark, sf_dir, mess.CELL_FILES)
    books = files.withColumn("folder", filenames.folder_of(F.col("path"), ROOTS))
    rows = shape.project_delivery(cells, shape.with_file(headers.detect_delivery(cells), books))
    return rows.select("file_id", "source_row", "participant_name", "folder_name", *_TICK_COLUMNS, "none_apply")


_WHY = (
    "No sheet had at least 3 recognisable headers. Saw — Head_Attributes (best row 1, 4 matched: Glasses | Hat | Beard "
    "| Scarf); Invoices (best row 1, 0 matched: Invoice number | Client | Amount due)"
)


@query(f"""
select file_id, '{iss.RULE_SKIPPED}' as rule, '{_WHY}' as message from {_N} where n % 6 = 5
""")
def diagnose_files(spark, sf_dir):
    cells, books = _cells(spark, sf_dir, mess.MARK_CELLS), mess.run(spark, sf_dir, mess.CELL_FILES)
    hits = headers.header_hits_delivery(cells)
    none = cells.filter("kind = 'unreadable'").select("file_id", F.col("s").alias("read_error"))
    found = workbook_issues(books, headers.choose_delivery_sheet(hits), none, headers.diagnose_delivery(cells, hits))
    return found.select(F.col("file").alias("file_id"), "rule", "message")


@query(f"""
select row_number() over (order by n, c_custkey) + 1 as merged_row, c_name as participant_name, {_BIRTH} as birthdate,
  cast(1 as int) as n_issues from {_C} where n % 6 <> 5 and c_custkey % 10 <> 9
""")
def delivery_rows(spark, sf_dir):
    cells, books = _cells(spark, sf_dir, mess.MARK_CELLS), mess.run(spark, sf_dir, mess.CELL_FILES)
    rows = merge_metadata(cells, books, ROOTS, current_year=YEAR).rows
    return rows.select("merged_row", "participant_name", "birthdate", F.size("issues").alias("n_issues"))


# The workbooks once more, every seventh of them broken after its last sheet was begun.
_BROKEN = mess.MARK_CELLS + """
union all select concat('nation_', cast(n_nationkey as string), '.xlsx'), cast(null as string), -1, cast(null as string), 0, 0, 'unreadable',
  'BadZipFile: it breaks off', cast(null as double), cast(null as timestamp), cast(null as boolean) from {nation} where n_nationkey % 7 = 3
"""
_READ = "(select n_nationkey as n, concat('nation_', cast(n_nationkey as string), '.xlsx') as name from {nation}) t"
_KEPT_ROWS = "(select c_nationkey as n, count(*) as k from {customer} where c_custkey % 10 <> 9 group by c_nationkey)"


@query(f"""
select cast(t.n as bigint) as file_ix, name, t.n % 7 <> 3 and t.n % 6 <> 5 as ok,
  case when t.n % 7 <> 3 and t.n % 6 <> 5 then 1 + t.n % 7 else 0 end as header_row,
  case when t.n % 7 = 3 then 'could not be read' when t.n % 6 = 5 then 'no headers matched'
    else concat(cast(coalesce(k, 0) as string), ' row(s)') end as diagnosis
from {_READ} left join {_KEPT_ROWS} r on r.n = t.n
""")
def delivery_reports(spark, sf_dir):
    """What became of every workbook: rows read, no headers matched, could not be read."""
    cells, books = _cells(spark, sf_dir, _BROKEN), mess.run(spark, sf_dir, mess.CELL_FILES)
    done = merge_metadata(cells, books, ROOTS, current_year=YEAR)
    return done.reports.select("file_ix", "name", "ok", "header_row", "diagnosis")


@query(f"""
select cast(c_custkey + 2 as int) as source_row, row_number() over (order by c_custkey) + 1 as merged_row, c_name as participant_name,
  case when c_custkey % 5 = 0 then 'Glasses' end as head_and_hair, cast(c_custkey % 5 = 0 as int) as n_issues
from {{customer}} where c_custkey % 4 <> 3
""")
def override_rows(spark, sf_dir):
    """One already merged sheet by position, beside other sheets and workbooks that must not be read."""
    cells, books = _cells(spark, sf_dir, mess.OVERRIDE_CELLS), mess.run(spark, sf_dir, mess.OVERRIDE_FILES)
    rows = merge_metadata(cells, books, ROOTS, current_year=YEAR, override_file="b.xlsx").rows
    return rows.select("source_row", "merged_row", "participant_name", "head_and_hair", F.size("issues").alias("n_issues"))


@query("""
select ord, max(case when g = 1 then term end) as part_type, max(case when g = 2 then term end) as segment,
  max(case when g = 3 then term end) as event_type
from (select g, term, cast(row_number() over (partition by g order by term) as int) as ord from (
  select distinct 1 as g, p_type as term from {part} union all select distinct 2, c_mktsegment from {customer}
  union all select distinct 3, event_type from {events}) d) r
group by ord
""")
def vocab_reference(spark, sf_dir):
    sources = (("part_type", "part", "p_type"), ("segment", "customer", "c_mktsegment"), ("event_type", "events", "event_type"))
    lists = [
        table(spark, sf_dir, t).groupBy(F.col(c).alias("term")).agg(F.lit(g).alias("grp")) for g, t, c in sources
    ]
    terms = lists[0].unionByName(lists[1]).unionByName(lists[2])
    # Vocabulary lists are short by nature; here they are the distinct values of three category columns.
    numbered = terms.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy("term")))
    return reports.vocabulary_table(numbered, [g for g, _, _ in sources])


# ---- file names, links, identity ----------------------------------------------------------------------------------------

@query("""
select doc_id, length(k) as key_length, md5(k) as key_md5 from (
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[._\\-–—]+', ' ', 'g'),
  '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as k from {documents}) d where k <> ''
""")
def accent_fold_names(spark, sf_dir):
    # Generated, so that the filter stays behind it and every text is folded once.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(tx.normalize_name(F.col("text")))).alias("k"))
    return docs.filter(F.col("k").isNotNull()).select(
        "doc_id", F.length("k").cast("bigint").alias("key_length"), F.md5("k").alias("key_md5")
    )


@query(f"""
select path, array_to_string(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), ' ')
  as tokens from ({mess.FILES}) f
""")
def filename_tokens(spark, sf_dir):
    files = mess.run(spark, sf_dir, mess.FILES)
    return files.select("path", F.array_join(filenames.tokenize(F.col("path")), " ").alias("tokens"))


def _classified(spark, sf_dir) -> DataFrame:
    return match.classify_files(mess.run(spark, sf_dir, mess.FILES).drop("kind", "environment", "expression", "token"), PRESET)


@query(f"select path, kind from ({mess.FILES}) f")
def classify_files(spark, sf_dir):
    return _classified(spark, sf_dir).select("path", "kind")


@query("""
select path, case when p % 4 = 0 then 'icf' when p % 4 = 1 then 'assent' when p % 4 = 2 then 'icf' else 'video' end as kind,
  case when p % 4 = 3 then case when p % 8 = 3 then 'Non-Neutral' else 'Neutral' end end as expression
from (select s_suppkey as p, s_name as path from {supplier}) s
""")
def preset_kinds(spark, sf_dir):
    """Names with more than one kind of word in them, by the second naming convention; expressions that are negated."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("ICF consent", "Assent ICF", "consent", "Indoor NonNeutral frown", "x ICF", "assent", "ICF", "Outdoor NEUTRAL")]),
                        (F.col("s_suppkey") % 8 + 1).cast("int"))
    ext = F.when(F.col("s_suppkey") % 4 == 3, ".mp4").when(F.col("s_suppkey") % 4 == 1, ".pdf").otherwise(".docx")
    files = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.concat("s_name", F.lit(" "), word, ext).alias("name"))
    return match.classify_files(files, fixed.PRESETS["icf_first"]).select("path", "kind", "expression")


@query(f"""
select row_number() over (order by case severity when 'error' then 0 when 'review' then 1 else 2 end, merged_row, rank) as place,
  merged_row, severity from (select e.*, case rule when 'Whitespace cleaned' then 1 when 'Birthdate reformatted to YYYY/MM' then 2
    when 'Birthdate needs a manual fix' then 2 when 'Slash placeholder cleared' then 3 when 'Head attribute conflict resolved' then 5
    when 'Head attribute placeholder added' then 5 else 4 end as rank from ({_EXPECTED_ISSUES}) e) x
""")
def issue_order(spark, sf_dir):
    """The log in the order of the report: worst first, then by merged row, then as found."""
    # Written before they are sorted: what lies before a range partitioning runs twice, once for its sample.
    found = staged(iss.explode_row_issues(_ruled(spark, sf_dir)).select("severity", "merged_row", "phase", "file_ix", "source_row", "rule_seq"))
    numbered = staged(iss.in_report_order(found).select("merged_row", "severity", F.monotonically_increasing_id().alias("_id")))
    # The number of the partition, and below it 33 bits of the number of the row in it.
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33))
    sizes = spread.running_offset(numbered.groupBy("_part").agg(F.count("*").alias("n")), "_part", "n", "before", 32)
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(sizes, "_part").select((F.col("before") + inside).alias("place"), "merged_row", "severity")


@query(f"""
select path, environment, expression, token, cast(token = 'n3utral' as int) as fuzzy from ({mess.FILES}) f
where kind = 'video'
""")
def derive_slots(spark, sf_dir):
    videos = _classified(spark, sf_dir).filter("kind = 'video'")
    return videos.select("path", "environment", "expression", "token", F.col("fuzzy").cast("int").alias("fuzzy"))


_LINKS = f"""
select concat('p', cast(page_id as string)) as id, url from {{pages}} union all
select path as id, link as url from ({mess.FILES}) f where link is not null
"""


@query(f"""
select id, concat(regexp_extract(url, '^[^?#]*'), '?', case when regexp_matches(url, '[?&]rlkey=[^&#]') then
  concat('rlkey=', regexp_extract(url, '[?&]rlkey=([^&#]*)', 1), '&') else '' end, 'dl=0',
  regexp_extract(url, '#.*$')) as link from ({_LINKS}) l
""")
def normalize_links(spark, sf_dir):
    g = mess.run(spark, sf_dir, _LINKS)
    return g.select("id", links.normalize_shared_link(F.col("url")).alias("link"))


_PASTED = """
select page_id, case page_id % 6 when 0 then concat('https://www.dropbox.com/home/Team%20', cast(page_id as string), '/')
  when 1 then concat('/a/b', cast(page_id as string), '//') when 2 then url
  when 3 then concat('https://www.dropbox.com/scl/fo/', cast(page_id as string))
  when 4 then concat('plain folder ', cast(page_id as string)) else '   ' end as pasted
from {pages}
"""


@query(f"""
select page_id, cast(page_id % 6 in (0, 1, 4) as int) as ok, case page_id % 6
    when 0 then concat('/Team ', cast(page_id as string)) when 1 then concat('/a/b', cast(page_id as string))
    when 4 then concat('/plain folder ', cast(page_id as string)) end as path,
  case page_id % 6 when 2 then '{links.REASON_HOST}' when 3 then '{links.REASON_SHARE.replace("'", "''")}' else '' end
    as reason
from ({_PASTED}) p where page_id % 6 <> 5
""")
def folder_urls(spark, sf_dir):
    g = mess.run(spark, sf_dir, _PASTED).withColumn("u", F.explode(links.parse_folder_urls(F.col("pasted"))))
    return g.select("page_id", F.col("u.ok").cast("int").alias("ok"), "u.path", "u.reason")


# The same media lying flat in the root: half named from the start, half with a word before the name.
_FLAT = f"""
select concat('/lot/', case when p % 2 = 0 then '' else 'take of ' end, name) as path,
  concat(case when p % 2 = 0 then '' else 'take of ' end, name) as name, name_key as answer from ({mess.FILES}) f
union all select path, name, name_key from ({mess.FILES}) f
"""


@query(f"select path, answer as name_key from ({_FLAT}) f")
def file_identity(spark, sf_dir):
    files = mess.run(spark, sf_dir, _FLAT).drop("answer")
    people = mess.run(spark, sf_dir, mess.FILES).select(F.initcap("name_key").alias("folder_name"), F.col("p").alias("at"))
    names = staged(identity.known_names(people, "folder_name", "at"))
    return identity.participant_of_files(staged(files), ROOTS, names).select("path", "name_key")


# ---- matching -----------------------------------------------------------------------------------------------------------

def _media(spark, sf_dir) -> DataFrame:
    files = mess.run(spark, sf_dir, mess.FILES).select("path", "name", "server_modified", "link")
    return match.prepare_files(identity.participant_of_files(files, ROOTS), PRESET)


def _planned(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, media = mess.run(spark, sf_dir, mess.SHEET).drop("name_key"), _media(spark, sf_dir)
    return rows, media, match.plan_rows(rows, media, PRESET)


_GROUPS = f"""
select p, name_key, concat('User', substr(name_key, 5)) as folder, count(*) filter (where kind = 'video') as n_video,
  count(*) filter (where kind = 'icf') as n_icf, count(*) filter (where kind = 'assent') as n_assent,
  count(*) filter (where kind = 'other') as n_other from ({mess.FILES}) f group by p, name_key
"""


@query(f"select name_key, folder, n_video, n_icf, n_assent, n_other from ({_GROUPS}) g")
def group_files(spark, sf_dir):
    return match.group_files(_media(spark, sf_dir)).select(
        "name_key", "folder", "n_video", "n_icf", "n_assent", "n_other"
    )


@query(f"""select concat('folder "', folder, '"') as who from ({_GROUPS}) g where p % 13 = 0""")
def unmatched_folders(spark, sf_dir):
    rows = mess.run(spark, sf_dir, mess.SHEET)
    return match.unmatched_groups(match.group_files(_media(spark, sf_dir)), rows).select("who")


_DURABLE = "regexp_extract(link, '^[^?]*') || '?rlkey=' || regexp_extract(link, 'rlkey=([^&]*)', 1) || '&dl=0'"
_PLAN_CTE = f"""
with files as materialized (select *, {_DURABLE} as url from ({mess.FILES}) f),
sheet as materialized (select *, lower(environment) as we, lower(expression) as wx,
  lower(coalesce(non_neutral, '')) as wk from ({mess.SHEET}) s),
candidates as materialized (select s.merged_row, s.wk, f.path, f.name, f.token, f.url, f.server_modified
  from sheet s join files f on f.name_key = s.name_key and f.kind = 'video'
  and (s.we = '' or f.environment is null or lower(f.environment) = s.we) and (s.wx = '' or lower(f.expression) = s.wx)),
judged as (select merged_row, count(*) as n, min(path) as only_path,
  count(*) filter (where wk <> '' and (contains(wk, token) or contains(token, wk)
    or damerau_levenshtein(token, wk) <= 2)) as hits,
  min(path) filter (where wk <> '' and (contains(wk, token) or contains(token, wk)
    or damerau_levenshtein(token, wk) <= 2)) as hit_path
  from candidates group by merged_row),
papers as (select name_key, kind, count(*) as n, min(path) as path, min(url) as url from files
  where kind in ('icf', 'assent') group by name_key, kind),
plan as materialized (select s.*, exists (select 1 from files f where f.name_key = s.name_key) as found,
  coalesce(j.n, 0) as n_videos,
  case when j.n = 1 then j.only_path when j.n > 1 and j.hits = 1 then j.hit_path end as video,
  case when j.n = 1 then 'unique' when j.n > 1 and j.hits = 1 then 'column-k' end as reason,
  case when i.n = 1 then i.path end as icf, case when a.n = 1 then a.path end as assent,
  case when i.n = 1 then i.url end as icf_link, case when a.n = 1 then a.url end as assent_link
  from sheet s left join judged j on j.merged_row = s.merged_row
  left join papers i on i.name_key = s.name_key and i.kind = 'icf'
  left join papers a on a.name_key = s.name_key and a.kind = 'assent'),
answer as materialized (select p.*, v.url as video_link, v.server_modified as video_time,
  case when not found then 'skipped'
    when video is not null and icf is not null and assent is not null and v.url is not null and icf_link is not null
      and assent_link is not null then 'filled'
    when video is not null and icf is not null and assent is not null then 'awaiting-link'
    when video is not null or icf is not null or assent is not null then 'review' else 'missing' end as status,
  min(p.merged_row) over (partition by p.name_key) as first_row
  from plan p left join files v on v.path = p.video)
"""


@query(_PLAN_CTE + "select merged_row, n_videos from answer where found")
def slot_candidates(spark, sf_dir):
    _, _, plan = _planned(spark, sf_dir)
    return plan.filter(F.col("status") != "skipped").select("merged_row", "n_videos")


@query(_PLAN_CTE + """
select merged_row, status, reason as video_reason, video, icf, assent,
  case when icf is not null and first_row < merged_row then first_row end as icf_repeat_of,
  case when not found then 1 else cast(video is null as int) + cast(icf is null as int) + cast(assent is null as int)
    end as n_problems from answer
""")
def plan_status(spark, sf_dir):
    _, _, plan = _planned(spark, sf_dir)
    return plan.select(
        "merged_row", "status", "video_reason", F.col("video.path").alias("video"), F.col("icf.path").alias("icf"),
        F.col("assent.path").alias("assent"), "icf_repeat_of", F.size("problems").alias("n_problems"),
    )


_HELD = f", groups as (select g.*, exists (select 1 from sheet s where s.name_key = g.name_key) as held from ({_GROUPS}) g)"


@query(_PLAN_CTE + _HELD + """
select kind, severity, count(*) as n from (
select 'unmatched-name' as kind, 'error' as severity from groups where not held
union all select 'missing-icf', 'error' from groups where held and n_icf = 0
union all select 'duplicate-icf', 'warn' from groups where held and n_icf > 1
union all select 'missing-assent', 'error' from groups where held and n_assent = 0
union all select 'duplicate-assent', 'warn' from groups where held and n_assent > 1
union all select 'ambiguous-slot', 'warn' from (select distinct name_key, environment, expression from answer
  where found and video is null and n_videos > 1) d) x
group by kind, severity
""")
def guard_counts(spark, sf_dir):
    rows, media, plan = _planned(spark, sf_dir)
    guards = match.find_guards(media, rows, plan)
    return guards.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


_FITS = "contains(s.non_neutral, f.token) or contains(f.token, s.non_neutral) or damerau_levenshtein(f.token, s.non_neutral) <= 2"


@query(f"""
with files as materialized ({mess.CONTESTED_FILES}), sheet as materialized ({mess.CONTESTED_SHEET}),
met as (select s.merged_row, f.path, {_FITS} as fits from sheet s join files f on f.name_key = s.name_key
  where abs(length(f.token) - length(s.non_neutral)) <= 2 or contains(s.non_neutral, f.token) or contains(f.token, s.non_neutral)),
hits as (select merged_row, count(*) as n, min(path) as path from met where fits group by merged_row),
counts as (select name_key, count(*) as n, min(path) as path from files group by name_key)
select s.merged_row, c.n as n_videos, case when c.n = 1 then c.path when h.n = 1 then h.path end as video,
  case when c.n = 1 then 'unique' when h.n = 1 then 'column-k' end as video_reason
from sheet s join counts c on c.name_key = s.name_key left join hits h on h.merged_row = s.merged_row
""")
def contested_slots(spark, sf_dir):
    """The tie-break by word in slots of two and of thousands of videos."""
    files = mess.run(spark, sf_dir, mess.CONTESTED_FILES).select("path", "name")
    media = match.prepare_files(identity.participant_of_files(files, ROOTS), PRESET)
    plan = match.plan_rows(mess.run(spark, sf_dir, mess.CONTESTED_SHEET).drop("name_key"), media, PRESET)
    return plan.select("merged_row", "n_videos", F.col("video.path").alias("video"), "video_reason")


def _papers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, rows = mess.papers(spark, sf_dir).select("path", "name"), mess.paper_sheet(spark, sf_dir).drop("name_key")
    media = match.prepare_files(identity.participant_of_files(files, ROOTS), PRESET)
    return media, rows, staged(match.plan_rows(rows, media, PRESET))


@query(f"""
select case when n > 1 then 'duplicate-icf' else 'missing-assent' end as kind, folder as who,
  case when n > 1 then concat('Found ', names, '. Ambiguous, so AC is held.') else '{match.DETAIL_MISSING["assent"]}' end as detail
from (select folder, count(*) as n, string_agg(name, ', ' order by path) as names from ({mess.PAPERS}) p group by folder) g
union all select 'missing-assent', folder, '{match.DETAIL_MISSING["assent"]}' from ({mess.PAPERS}) p group by folder having count(*) > 1
""")
def guard_details(spark, sf_dir):
    """Texts of guards over 1, 100, 101 and thousands of files, every name spelt out."""
    media, rows, plan = _papers(spark, sf_dir)
    return match.find_guards(media, rows, plan).select("kind", "who", "detail")


@query(f"""
select 'duplicate-icf' as kind, folder as who, name, path from ({mess.PAPERS}) p
where folder in (select folder from ({mess.PAPERS}) q group by folder having count(*) > 1)
""")
def guard_members(spark, sf_dir):
    media, rows, plan = _papers(spark, sf_dir)
    return match.guard_members(media, rows, plan).select("kind", "who", "name", "path")


_LINKED = """
, linked as (select distinct u.path, f.link is not null as existed from (select video as path from answer union all
  select icf from answer union all select assent from answer) u join files f on f.path = u.path)
"""


@query(_PLAN_CTE + _LINKED + _HELD + """
select * from (select count(*) filter (where status = 'filled') as rows_filled,
  count(*) filter (where status = 'awaiting-link') as rows_awaiting_link,
  count(*) filter (where status = 'review') as rows_review, count(*) filter (where status = 'missing') as rows_missing,
  count(*) filter (where status = 'skipped') as rows_skipped from answer) a,
  (select count(*) as files_matched, count(*) filter (where existed) as links_reused,
  count(*) filter (where not existed) as links_to_create from linked) b,
  (select (select count(*) + count(*) filter (where held and n_icf <> 1) + count(*) filter (where held and n_assent <> 1)
      - count(*) filter (where held) from groups)
    + (select count(*) from (select distinct name_key, environment, expression from answer where found and video is null and n_videos > 1) d)
    as guard_count) c
""")
def plan_metrics(spark, sf_dir):
    rows, media, plan = _planned(spark, sf_dir)
    plan = staged(plan)
    return match.plan_metrics(plan, match.find_guards(media, rows, plan)).drop("rows_matched", "links_resolved")


@query(_PLAN_CTE + _LINKED + "select path from linked where not existed")
def links_to_create(spark, sf_dir):
    _, _, plan = _planned(spark, sf_dir)
    return match.links_to_create(plan).select("path")


@query(_PLAN_CTE + """
select merged_row, coalesce(video_link, video_url) as video_url, icf_link as icf_url, assent_link as assent_url,
  coalesce(recorded_at, strftime(video_time, '%Y-%m-%d %H:%M:%S.%f')) as recorded_at from answer
""")
def write_links_cellwise(spark, sf_dir):
    _, _, plan = _planned(spark, sf_dir)
    done = match.write_links(plan, "cellwise")
    stamp = F.date_format(F.col("video.recorded_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    sheet = mess.run(spark, sf_dir, mess.SHEET).select("merged_row", F.col("recorded_at").alias("given"))
    return done.join(by_merge(sheet), "merged_row").select(
        "merged_row", "video_url", "icf_url", "assent_url", F.coalesce("given", F.when(F.col("recorded_at").isNotNull(), stamp)).alias("recorded_at")
    )


@query(_PLAN_CTE + """
select merged_row, case when status = 'filled' then video_link else video_url end as video_url,
  case when status = 'filled' then icf_link end as icf_url, case when status = 'filled' then assent_link end
  as assent_url, recorded_at, participant_name from answer
""")
def write_links_strict(spark, sf_dir):
    _, _, plan = _planned(spark, sf_dir)
    return match.write_links(plan, "strict").select(
        "merged_row", "video_url", "icf_url", "assent_url", "recorded_at", "participant_name"
    )


# ---- annotation -----------------------------------------------------------------------------------------------------------

_NUMBERED = """
select o_orderkey as merged_row, concat(case when o_orderkey % 2 = 0 then 'Cust-' else ' CUST  ' end,
  cast(o_custkey as string)) as folder_name, cast(null as string) as participant_name from {orders}
"""


@query(f"""
select merged_row, cast(dense_rank() over (order by first_row) as int) as participant_sequence from (
select o_orderkey as merged_row, min(o_orderkey) over (partition by o_custkey) as first_row from {{orders}}) d
""")
def participant_sequence(spark, sf_dir):
    rows = mess.run(spark, sf_dir, _NUMBERED)
    return ann.participant_numbers(rows).select("merged_row", "participant_sequence")


_LINE_ISSUES = """
select l_orderkey as merged_row, l_linenumber as rule_seq, case l_returnflag when 'R' then 'error' when 'A' then 'review'
  else 'fixed' end as severity, concat('Rule ', cast(l_linenumber as string), ' part ', cast(l_partkey as string)) as rule,
  case when l_linenumber % 2 = 0 then '' else l_linestatus end as message from {lineitem}
"""
_ORDER_ROWS = """
select o_orderkey as merged_row, o_custkey, case when o_orderstatus = 'P' then 'held' end as problem from {orders}
"""


@query(f"""
select merged_row, case when n_error > 0 then 'Error' when n_review > 0 or problem is not null then 'Review'
  when n > 0 then 'Auto-fixed' else 'OK' end as qa_result,
  nullif(concat_ws(' | ', findings, problem), '') as comments
from (select r.merged_row, r.problem, count(i.rule) as n, count(*) filter (where i.severity = 'error') as n_error,
  count(*) filter (where i.severity = 'review') as n_review,
  string_agg(case when i.message = '' then i.rule else concat(i.rule, ': ', i.message) end, ' | '
    order by i.rule_seq, i.severity, i.rule, i.message) filter (where i.rule is not null) as findings
  from ({_ORDER_ROWS}) r left join ({_LINE_ISSUES}) i on i.merged_row = r.merged_row group by r.merged_row, r.problem) a
""")
def row_verdicts(spark, sf_dir):
    rows, issues = mess.run(spark, sf_dir, _ORDER_ROWS), mess.run(spark, sf_dir, _LINE_ISSUES)
    bound = ann.attach_issue_rows(rows, issues).withColumn("problems", F.array_compact(F.array("problem")))
    return ann.row_verdicts(bound).select("merged_row", "qa_result", "comments")


@query(_PLAN_CTE + f"""
select merged_row as "row", cast(5 as int) as "column", concat_ws(' ', case when not found then '{match.PROBLEM_NO_FOLDER}' end,
  case when found and video is null and n_videos > 1
    then concat(cast(n_videos as string), ' videos match ', environment, ' / ', expression, ' and column K does not single one out.')
  when found and n_videos = 0
    then concat('No video file matches ', case environment when '' then '?' else environment end, ' / ', case expression when '' then '?' else expression end, '.') end,
  case when found and icf is null then '{match.PROBLEM_NO_ICF}' end, case when found and assent is null then '{match.PROBLEM_NO_ASSENT}' end) as note
from answer where status not in ('filled', 'awaiting-link')
union all select merged_row, cast(case column_letter when 'H' then 13 else 18 end as int), rule from ({_EXPECTED_ISSUES}) e where severity = 'review'
""")
def delivery_marks(spark, sf_dir):
    """Cells to look at again: the findings that need a person, and the video cell of every row that isn't ready."""
    _, _, plan = _planned(spark, sf_dir)
    reviews = iss.explode_row_issues(_ruled(spark, sf_dir))
    marks = reports.delivery_marks(reviews, plan)
    by_rule = F.when(F.col("column") != 5, F.substring_index("note", ":", 1)).otherwise(F.col("note"))
    return marks.select("row", "column", by_rule.alias("note"))


_MERGED = f"(select count(*) from {_C} where n % 6 <> 5 and c_custkey % 10 <> 9)"


@query(_PLAN_CTE + _LINKED + f"""
select {_MERGED} as rows_merged, cast(0 as bigint) as auto_fixes, links_resolved, links_reused, links_to_create,
  {_MERGED} + (select count(*) from {_N} where n % 6 = 5) + (select count(*) from answer where status in ('review', 'missing')) as needs_a_person
from (select count(*) as links_resolved, count(*) filter (where existed) as links_reused,
  count(*) filter (where not existed) as links_to_create from linked) l
""")
def delivery_summary(spark, sf_dir):
    """Rows merged, automatic fixes, links, and what still needs a person; rows were counted while they were written."""
    cells, books_ = _cells(spark, sf_dir, mess.MARK_CELLS), mess.run(spark, sf_dir, mess.CELL_FILES)
    merged = merge_metadata(cells, books_, ROOTS, current_year=YEAR)
    rows, _, plan = _planned(spark, sf_dir)
    return reports.delivery_summary(merged.tally, merged.issues, match.plan_metrics(staged(plan), rows.limit(0)))


# ---- planning again -------------------------------------------------------------------------------------------------------

# Every fortieth participant's files without a link get one.
_NEWLY = "p % 40 = 7 and link is null"
_NEW_LINK = "concat('https://www.dropbox.com/scl/fi/new/', replace(name, ' ', '-'), '?rlkey=n&dl=0')"
_RELINKED = (f"select p, name_key, path, name, kind, environment, expression, token, server_modified, "
             f"case when {_NEWLY} then {_NEW_LINK} else link end as link from ({mess.FILES}) old")


@query(_PLAN_CTE.replace(f"from ({mess.FILES}) f)", f"from ({_RELINKED}) f)", 1) + f"""
select merged_row, status, video_link, icf_link, assent_link,
  cast(name_key in (select name_key from ({mess.FILES}) f where {_NEWLY}) as int) as planned_again from answer
""")
def replan_after_links(spark, sf_dir):
    """The plan once more links exist, only their participants planned again: the same as planning everybody again."""
    rows, media, plan = _planned(spark, sf_dir)
    kept = replan.keep(rows, media, plan, parts=8)
    links = mess.run(spark, sf_dir, mess.FILES).filter(_NEWLY).select("path", F.expr(_NEW_LINK).alias("url"))
    done = replan.replan(kept, links, PRESET)
    again = done.delta.select("merged_row", F.lit(1).alias("planned_again"))
    return done.plan.join(by_merge(again), "merged_row", "left").select(
        "merged_row", "status", *[tx.null_if_empty(F.col(f"{k}.link")).alias(f"{k}_link") for k in ("video", "icf", "assent")],
        F.coalesce("planned_again", F.lit(0)).alias("planned_again"))


# ---- exports, read back through their manifest ------------------------------------------------------------------------------

def _exported(df: DataFrame, kind: str) -> DataFrame:
    folder = f"{shared_folder(df.sparkSession)}/export-{uuid.uuid4().hex}"
    remove_at_end(df.sparkSession, folder)
    exports.export_table(df, folder, kind)
    return exports.read_export(df.sparkSession, folder)


def _titled(layout_columns, values: dict[str, str]) -> str:
    return ", ".join(f'{values.get(f, "cast(null as varchar)")} as "{h}"' for f, h in layout_columns)


@query("select " + _titled(CANONICAL.columns, {
    "participant_name": "c_name", "participant_email": "concat('u', cast(c_custkey % 97 as string), '@x.org')", "device": "c_mktsegment",
    "birthdate": f"concat({_BIRTH}, '/', lpad(cast(1 + c_custkey % 12 as string), 2, '0'))", "none_apply": "'N/A-none apply'",
    "country": "case when n % 5 <> 0 then concat('N', cast(n as string)) end"}) + f" from {_C}")
def export_merged(spark, sf_dir):
    return _exported(reports.merged_table(_consolidated(spark, sf_dir).rows), "csv")


@query(f"""
select case severity when 'review' then 'NEEDS REVIEW' else 'AUTO-FIXED' end as "Severity", file as "Source File", 'Data' as "Sheet",
  merged_row as "Merged Row", column_letter as "Column", rule as "Check", original as "Original Value", corrected as "Corrected Value"
from (select e.*, g.file from ({_EXPECTED_ISSUES}) e join ({mess.ROWS}) g on g.merged_row = e.merged_row) x
""")
def export_qa_report(spark, sf_dir):
    table_ = _exported(reports.qa_report(iss.explode_row_issues(_ruled(spark, sf_dir))), "csv")
    assert table_.columns == list(fixed.QA_REPORT_HEADERS)
    return table_.drop("Source Row", "Header", "Details")


@query(f"""
select upper(severity) as "Severity", file as "Source file", merged_row as "Row", column_letter as "Col", rule as "Check",
  original as "Original", corrected as "Corrected"
from (select e.*, g.file from ({_EXPECTED_ISSUES}) e join ({mess.ROWS}) g on g.merged_row = e.merged_row) x
""")
def export_delivery_qa(spark, sf_dir):
    table_ = _exported(reports.delivery_qa_report(iss.explode_row_issues(_ruled(spark, sf_dir))), "parquet")
    assert table_.columns == list(fixed.DELIVERY_QA_HEADERS)
    return table_.drop("Header", "Details")


@query(f"""
select name as "Source File", 'Upload' as "Origin", sheet_name as "Sheet Used", header_row as "Header Row", cast(row_count as bigint) as "Rows Merged",
  cast(first_merged_row as bigint) as "Merged Rows From", cast(last_merged_row as bigint) as "Merged Rows To", 'Merged' as "Status" from ({_REPORTS}) r
""")
def export_sources(spark, sf_dir):
    return _exported(reports.sources_report(_consolidated(spark, sf_dir).reports), "csv")


@query("select " + _titled(DELIVERY.columns, {
    "participant_sequence": "cast(dense_rank() over (order by n) as int)", "qa_result": "'Review'", "comments": "'left out'",
    "folder_name": "concat('Group ', cast(n as string))", "participant_name": "c_name", "environment": "'Indoor'",
    "birthdate": _BIRTH, **{f: _ticked(f).rsplit(" as ", 1)[0] for f in _TICK_COLUMNS},
    "none_apply": f"case when {' and '.join(f'c_custkey % {p} <> 0' for p in _PRIME.values())} then 'N/A-none apply' end"})
    + f" from {_C} where n % 6 <> 5 and c_custkey % 10 <> 9")
def export_delivery(spark, sf_dir):
    cells, books = _cells(spark, sf_dir, mess.MARK_CELLS), mess.run(spark, sf_dir, mess.CELL_FILES)
    rows = merge_metadata(cells, books, ROOTS, current_year=YEAR).rows
    return _exported(reports.delivery_table(ann.annotate(rows)).withColumn("Comments", F.lit("left out")), "parquet")
