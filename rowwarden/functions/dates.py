"""Birth dates typed by people, brought to the text form YYYY/MM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import text as tx

_SEP = r"[ .,\-/]+"
_MONTH_FIRST = rf"^([A-Za-z]{{3,9}}){_SEP}(\d{{2,4}})\z"
_YEAR_FIRST = rf"^(\d{{2,4}}){_SEP}([A-Za-z]{{3,9}})\z"
_DAY_MONTH_YEAR = rf"^\d{{1,2}}{_SEP}([A-Za-z]{{3,9}}){_SEP}(\d{{2,4}})\z"
_MONTH_DAY_YEAR = rf"^([A-Za-z]{{3,9}}){_SEP}\d{{1,2}}{_SEP}(\d{{2,4}})\z"

# --- fixed values: message formats ---------------------------------------------------------------------------------
MSG_BAD_MONTH = 'Month "%d" is not between 1 and 12.'
MSG_YEAR_RANGE = "Year %d is outside the plausible range %d-%d."
MSG_DATE_CELL = "Converted from a date cell."
MSG_YEAR_ONLY = "Only a year (%s) was supplied; the month is missing."
MSG_NUM_YYYYMM = "Interpreted numeric value as YYYYMM."
MSG_NUM_YYYYMMDD = "Interpreted numeric value as YYYYMMDD."
MSG_SERIAL = "Converted from an Excel date serial number."
MSG_NUM_UNKNOWN = "Numeric value %s is not a recognisable date."
MSG_MONTH_NAME = "Converted month name to numeric format."
MSG_EXPANDED = 'Expanded 2-digit year "%s" to %d. Please confirm.'
MSG_YYYYMM = "Interpreted as YYYYMM."
MSG_YYYYMMDD = "Interpreted as YYYYMMDD."
MSG_Y_M = "Reformatted to YYYY/MM."
MSG_M_Y = "Reordered MM/YYYY to YYYY/MM."
MSG_MM_YY = 'Read "%s" as MM/YY and expanded the year to %d. Please confirm.'
MSG_Y_M_D = "Reformatted from YYYY/MM/DD to YYYY/MM."
MSG_D_M_Y = "Reformatted from DD/MM/YYYY to YYYY/MM."
MSG_M_D_Y = "Reformatted from MM/DD/YYYY to YYYY/MM."
MSG_AMBIGUOUS = 'Day and month are both <= 12, so "%s" is ambiguous. Assumed %s. Please confirm.'
MSG_SHORT_YEAR = 'Read "%s" using a 2-digit year expanded to %d. Please confirm.'
MSG_UNKNOWN = 'Could not recognise "%s" as a date.'


def format_year_month(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("/"), F.lpad(month.cast("string"), 2, "0"))


def excel_serial_to_date(serial: Column) -> Column:
    """Days of the 1900 epoch, rounded to the millisecond, as a UTC date."""
    millis = F.round((serial - 25569) * 86400000.0)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86400000.0).cast("int"))


def expand_two_digit_year(year: Column, current_year: int) -> Column:
    return F.when(year > current_year % 100, year + 1900).otherwise(year + 2000)


def _fmt(template: str, *args: Column) -> Column:
    return F.format_string(template, *args)


def _dated(year: Column, month: Column, status: str, message: str | Column) -> Column:
    return F.struct(
        year.cast("bigint").alias("y"), month.cast("bigint").alias("m"),
        F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"),
    )


def _undated(status: str, message: str | Column) -> Column:
    nothing = F.lit(None).cast("bigint")
    return _dated(nothing, nothing, status, message)


def _number_cases(n: Column, current_year: int) -> Column:
    whole = n == F.floor(n)
    i = F.when(F.abs(n) < 1e15, n).cast("bigint")
    serial = excel_serial_to_date(n)
    return (
        F.when(whole & n.between(fixed.EARLIEST_BIRTH_YEAR, current_year),
               _undated("review", _fmt(MSG_YEAR_ONLY, tx.number_text(n))))
        .when(whole & n.between(190001, 999912), _dated(F.floor(i / 100), i % 100, "fixed", MSG_NUM_YYYYMM))
        .when(whole & n.between(19000101, 99991231),
              _dated(F.floor(i / 10000), F.floor(i / 100) % 100, "fixed", MSG_NUM_YYYYMMDD))
        .when((n > 0) & (n < 80000), _dated(F.year(serial), F.month(serial), "fixed", MSG_SERIAL))
        .otherwise(_undated("unparseable", _fmt(MSG_NUM_UNKNOWN, tx.number_text(n))))
    )


def _named_cases(month: Column, year_token: Column, current_year: int) -> Column:
    year = year_token.cast("bigint")
    expanded = expand_two_digit_year(year, current_year)
    return F.when(
        F.length(year_token) <= 2,
        _dated(expanded, month, "review", _fmt(MSG_EXPANDED, year_token, expanded)),
    ).otherwise(_dated(year, month, "fixed", MSG_MONTH_NAME))


def _digit_cases(text: Column, p: Column, day_first: bool, current_year: int) -> Column:
    """Cases that look only at the runs of digits ``p`` of the text."""
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    na, nb, nc = (x.try_cast("bigint") for x in (a, b, c))
    count, all_digits = F.size(p), text.rlike(r"^\d+\z")
    mm_yy = expand_two_digit_year(nb, current_year)
    short = expand_two_digit_year(nc, current_year)
    chosen = nb if day_first else na
    order = "DD/MM/YYYY" if day_first else "MM/DD/YYYY"
    year_only = (F.length(text) == 4) & na.between(fixed.EARLIEST_BIRTH_YEAR, current_year)
    first4 = F.substring(text, 1, 4).try_cast("bigint")
    next2 = F.substring(text, 5, 2).try_cast("bigint")
    last_is_year = (count == 3) & (F.length(c) == 4)
    return (
        F.when(all_digits & year_only, _undated("review", _fmt(MSG_YEAR_ONLY, na.cast("string"))))
        .when(all_digits & (F.length(text) == 6), _dated(first4, next2, "fixed", MSG_YYYYMM))
        .when(all_digits & (F.length(text) == 8), _dated(first4, next2, "fixed", MSG_YYYYMMDD))
        .when((count == 2) & (F.length(a) == 4), _dated(na, nb, "fixed", MSG_Y_M))
        .when((count == 2) & (F.length(b) == 4), _dated(nb, na, "fixed", MSG_M_Y))
        .when(count == 2, _dated(mm_yy, na, "review", _fmt(MSG_MM_YY, text, mm_yy)))
        .when((count == 3) & (F.length(a) == 4), _dated(na, nb, "fixed", MSG_Y_M_D))
        .when(last_is_year & (na > 12) & (nb <= 12), _dated(nc, nb, "fixed", MSG_D_M_Y))
        .when(last_is_year & (nb > 12) & (na <= 12), _dated(nc, na, "fixed", MSG_M_D_Y))
        .when(last_is_year & (na <= 12) & (nb <= 12),
              _dated(nc, chosen, "review", _fmt(MSG_AMBIGUOUS, text, F.lit(order))))
        .when((count == 3) & (F.length(c) <= 2) & (F.length(a) <= 2),
              _dated(short, chosen, "review", _fmt(MSG_SHORT_YEAR, text, short)))
        .otherwise(_undated("unparseable", _fmt(MSG_UNKNOWN, text)))
    )


def _finish(found: Column, current_year: int) -> Column:
    value = format_year_month(found.y, found.m)
    low, high = F.lit(fixed.EARLIEST_BIRTH_YEAR), F.lit(current_year)

    def out(v: Column | None, status: Column | str, message: Column) -> Column:
        return F.struct(
            (F.lit(None) if v is None else v).cast("string").alias("value"),
            F.lit(status).alias("status"), message.alias("message"),
        )

    return (
        F.when(found.y.isNull() & found.m.isNull(), out(None, found.status, found.message))
        .when(found.y.isNull() | found.m.isNull() | ~found.m.between(1, 12),
              out(None, "unparseable", _fmt(MSG_BAD_MONTH, found.m)))
        .when(~found.y.between(low, high), out(value, "review", _fmt(MSG_YEAR_RANGE, found.y, low, high)))
        .otherwise(out(value, found.status, found.message))
    )


def _text_cases(text: Column, day_first: bool, current_year: int) -> Column:
    has_letter = text.rlike("[A-Za-z]")

    def pick(first: int, second: int, third: int, fourth: int) -> Column:
        return F.when(
            has_letter,
            F.when(text.rlike(_MONTH_FIRST), F.regexp_extract(text, _MONTH_FIRST, first))
            .when(text.rlike(_YEAR_FIRST), F.regexp_extract(text, _YEAR_FIRST, second))
            .when(text.rlike(_DAY_MONTH_YEAR), F.regexp_extract(text, _DAY_MONTH_YEAR, third))
            .when(text.rlike(_MONTH_DAY_YEAR), F.regexp_extract(text, _MONTH_DAY_YEAR, fourth)),
        )

    pieces = F.struct(
        F.split(F.regexp_replace(text, r"^[^0-9]+|[^0-9]+\z", ""), "[^0-9]+").alias("parts"),
        tx.lookup(fixed.MONTHS, F.lower(pick(1, 2, 1, 1))).alias("month"),
        pick(2, 1, 2, 2).alias("year"),
    )
    return tx.let(
        pieces,
        lambda p: F.when(p.month.isNotNull(), _named_cases(p.month, p.year, current_year)).otherwise(
            _digit_cases(text, p.parts, day_first, current_year)
        ),
    )


def parse_birthdate(
    text: Column,
    *,
    current_year: int,
    day_first: bool = True,
    number: Column | None = None,
    timestamp: Column | None = None,
) -> Column:
    """struct(value, status, message) of a birth date; status is empty, fixed, review or unparseable.

    ``number`` and ``timestamp`` are the typed cell where there is one; a value there is used in place of the text.
    """

    def cases(t: Column) -> Column:
        read = F.when(F.coalesce(t, F.lit("")) == "", _undated("empty", ""))
        if timestamp is not None:
            read = F.when(
                timestamp.isNotNull(), _dated(F.year(timestamp), F.month(timestamp), "fixed", MSG_DATE_CELL)
            ).otherwise(read)
        if number is not None:
            read = F.when(number.isNotNull(), _number_cases(number, current_year)).otherwise(read)
        return tx.let(
            F.coalesce(read, _text_cases(t, day_first, current_year)), lambda found: _finish(found, current_year)
        )

    return tx.let(tx.normalize_whitespace(text), cases)
