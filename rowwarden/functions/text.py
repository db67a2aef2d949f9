"""Text and number helpers: plain ``Column -> Column``, all evaluated inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden import fixed

_NEEDS_TIDYING = f"{fixed.WS_OTHER_THAN_SPACE}|{fixed.ZERO_WIDTH}|  |^ | \\z"
_WS_RUN = fixed.WS + "+"
_VOCAB_SEPARATORS = r"[/\\\-_.,;:]+"
_WS_ENDS = f"^{fixed.WS}+|{fixed.WS}+\\z"


def literal_map(values: dict) -> Column:
    """A small constant dictionary as a map literal, for in-row lookups without a join."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Long rule ladders refer to their input many times.  Binding it keeps the expression small even where the optimizer
    moves a filter on the result below the projection that computes it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def quote(text: str) -> str:
    """A constant as a raw SQL string literal."""
    return f'r"{text}"' if "'" in text else f"r'{text}'"


def let_sql(value: Column, name: str, body: str) -> Column:
    """``let`` with the body as SQL text over ``name``; long expressions are parsed in one call."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def _tidied_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {quote(fixed.ZERO_WIDTH)}, ''), {quote(_WS_RUN)}, ' '))"


def normalize_whitespace_sql(x: str) -> str:
    """Collapse every run of white space to one space, drop zero-width characters, trim.

    The cheap test first: clean text, the usual case, is returned as it is with no copying.
    """
    return f"if({x} rlike {quote(_NEEDS_TIDYING)}, {_tidied_sql(x)}, {x})"


def tidy_or_null_sql(x: str) -> str:
    """``normalize_whitespace`` with NULL for text of which nothing remains."""
    return f"case when {x} rlike {quote(_NEEDS_TIDYING)} then nullif({_tidied_sql(x)}, '') when {x} <> '' then {x} end"


def trim_ws_sql(x: str) -> str:
    return f"regexp_replace({x}, {quote(_WS_ENDS)}, '')"


def normalize_whitespace(text: Column) -> Column:
    return let_sql(text, "x", normalize_whitespace_sql("x"))


def tidy_or_null(text: Column) -> Column:
    return let_sql(text, "x", tidy_or_null_sql("x"))


def trim_ws(text: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(text, _WS_ENDS, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{fixed.WS[1:]}")


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def header_key(text: Column) -> Column:
    """Key of a submission header: letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _spaced_key(text: Column, separators: str) -> Column:
    spaced = F.regexp_replace(F.lower(text), separators, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9 ]+", ""), "  +", " "))  # single blanks stay as they are


def delivery_header_key(text: Column) -> Column:
    """Key of a delivery header: words separated by single spaces."""
    return _spaced_key(text, r"[/\\\-_.,;:()]+")


def vocab_key_sql(x: str) -> str:
    spaced = f"regexp_replace(lower({x}), {quote(_VOCAB_SEPARATORS)}, ' ')"
    return f"trim(regexp_replace(regexp_replace({spaced}, '[^a-z0-9 ]', ''), ' +', ' '))"


def vocab_key(text: Column) -> Column:
    """Key of a vocabulary answer: case, punctuation and spacing folded away."""
    return _spaced_key(text, _VOCAB_SEPARATORS)


def fold(text: Column) -> Column:
    """Strip accents but keep the base letters.  Plain ASCII text, the usual case, is returned as it is."""
    composed, base = fixed.accent_pairs()
    stripped = F.translate(F.regexp_replace(text, r"[\x{0300}-\x{036F}]", ""), composed, base)
    return F.when(text.rlike(r"[^\x00-\x7F]"), stripped).otherwise(text)


def normalize_name(text: Column) -> Column:
    """Identity key of a person or folder name; NULL where nothing of it survives, so that it never joins."""
    return null_if_empty(_spaced_key(fold(text), r"[._\-\x{2013}\x{2014}]+"))


def _bound(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shortest_sql() -> str:
    """Fewest digits that read back as ``x``, from its digits ``d``: the JVM may write one digit too many."""
    rounded = (
        "transform(array(if(substr(d.digits, p + 1, 1) >= '5', 1, 0), if(substr(d.digits, p + 1, 1) >= '5', 0, 1)), up -> "
        + _bound("r", "cast(cast(substr(d.digits, 1, p) as bigint) + up as string)",
                 "named_struct('digits', regexp_replace(r, '0+$', ''), 'point', d.point + length(r) - p)") + ")"
    )
    shorter = f"flatten(transform(sequence(1, least(length(d.digits) - 1, 17)), p -> {rounded}))"
    same = "c -> cast(concat(c.digits, 'E', cast(c.point - length(c.digits) as string)) as double) = abs(x)"
    exact = "length(d.digits) < 2 or (length(d.digits) <= 15 and abs(x) >= 1e-300)"
    return f"if({exact}, d, coalesce(get(filter({shorter}, {same}), 0), d))"


def _number_sql() -> str:
    parts = (
        "named_struct('whole', regexp_extract(t, '^([0-9]+)', 1), 'rest', regexp_extract(t, '[.]([0-9]+)', 1), "
        "'e', coalesce(cast(nullif(regexp_extract(t, 'E(-?[0-9]+)', 1), '') as int), 0))"
    )
    digits = (
        "named_struct('digits', regexp_replace(regexp_replace(concat(w.whole, w.rest), '^0+', ''), '0+$', ''), 'point', "
        "length(w.whole) + w.e - length(regexp_extract(concat(w.whole, w.rest), '^(0*)', 1)))"
    )
    scientific = (
        "concat(substr(n.digits, 1, 1), if(length(n.digits) > 1, concat('.', substr(n.digits, 2)), ''), 'e', "
        "if(n.point > 0, '+', '-'), cast(abs(n.point - 1) as string))"
    )
    layout = (
        "case when n.point between length(n.digits) and 21 then rpad(n.digits, n.point, '0') "
        "when n.point between 1 and 21 then concat(substr(n.digits, 1, n.point), '.', substr(n.digits, n.point + 1)) "
        f"when n.point between -5 and 0 then concat('0.', repeat('0', -n.point), n.digits) else {scientific} end"
    )
    # Large whole numbers with all their digits, as a bigint times a power of two: the JVM's text may round the last one.
    twos = "greatest(cast(floor(log2(abs(x))) as int) - 60, 0)"
    whole = f"cast(cast(cast(abs(x) / pow(2, {twos}) as bigint) as decimal(20, 0)) * cast(shiftleft(1L, {twos}) as decimal(20, 0)) as string)"
    general = _bound("t", f"if(abs(x) between 9007199254740992 and 1e36, {whole}, cast(abs(x) as string))", _bound("w", parts, _bound("d", digits, _bound("n", _shortest_sql(), layout))))
    return (
        "case when x is null then null when isnan(x) then 'NaN' "
        "when x = double('infinity') then 'Infinity' when x = double('-infinity') then '-Infinity' "
        "when abs(x) < 1e15 and x = floor(x) then cast(cast(x as bigint) as string) "
        "when abs(x) between 1e-3 and 9999999.0 and length(cast(abs(x) as string)) <= 16 then cast(x as string) "
        f"else concat(if(x < 0, '-', ''), {general}) end"
    )


def number_text(number: Column) -> Column:
    """A double with the fewest digits that give it back, as spreadsheets in a browser write it.

    1992, not 1992.0; plain from 1e-6 to below 1e21, else like 1e-7, 1.5e+21.  No decimal type is involved, so every finite
    double has its text.
    """
    return let_sql(number, "x", _number_sql())


def is_slash_placeholder(text: Column) -> Column:
    """Only slashes, bars, hyphens and white space, with at least one forward slash."""
    return text.rlike(rf"^(?:{fixed.WS}|[/\\|\-])+\z") & text.contains("/")


def column_letter(index: Column) -> Column:
    """0-based column number to spreadsheet letters, up to the last spreadsheet column XFD."""
    def letter(n: Column) -> Column:
        return F.chr(F.lit(65) + F.pmod(n, F.lit(26)))

    i = index.cast("bigint")
    second = F.floor(i / 26) - 1
    third = F.floor(second / 26) - 1
    return F.concat(
        F.when(i >= 702, letter(third)).otherwise(""),
        F.when(i >= 26, letter(second)).otherwise(""),
        letter(i),
    )
