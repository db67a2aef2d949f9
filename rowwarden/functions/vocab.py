"""Matching answers against a controlled vocabulary, in the row, with no join and no shuffle.

The vocabulary is a constant of a few dozen terms.  Exact keys are a map lookup; only the misses are compared with the
terms, and of those only the pairs a plain-distance pre-filter lets through are folded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.functions.distance import distance_to_entry_sql, max_edits_sql, word_table_sql

_FAR = 1000


def plain_vocab_key(term: str) -> str:
    """``text.vocab_key`` of a constant term, at planning time."""
    spaced = "".join(" " if c in "/\\-_.,;:" else c for c in term.lower())
    return " ".join("".join(c for c in spaced if c == " " or (c.isascii() and c.isalnum())).split())


def _outcome(status: str, value: str = "cast(null as string)", distance: str = "cast(null as int)") -> str:
    return f"named_struct('status', {status}, 'value', {value}, 'distance', {distance})"


def match_sql(raw: str, terms: Sequence[str]) -> str:
    by_key: dict[str, str] = {}
    for term in terms:
        by_key.setdefault(plain_vocab_key(term), term)
    known = "map(" + ", ".join(f"{tx.quote(k)}, {tx.quote(t)}" for k, t in by_key.items()) + ")"
    spelled = "array(" + ", ".join(map(tx.quote, by_key.values())) + ")"
    # A distance above 3 can never be accepted, whatever the lengths.
    scored = (
        f"named_struct('distance', if(levenshtein(k.key, e.word, 6) <> -1, {distance_to_entry_sql('k.key', 'e')}, "
        f"{_FAR}), 'ord', e.ord, 'allowed', {max_edits_sql('greatest(length(k.key), e.size)')})"
    )
    ranked = f"array_sort(transform({word_table_sql(list(by_key))}, e -> {scored}))"
    decided = (
        f"case when get(r, 0).distance > get(r, 0).allowed then {_outcome(tx.quote('unknown'))} "
        f"when get(r, 1).distance = get(r, 0).distance then {_outcome(tx.quote('ambiguous'))} "
        f"else {_outcome(tx.quote('corrected'), f'get({spelled}, get(r, 0).ord)', 'get(r, 0).distance')} end"
    )
    exact = f"if({tx.trim_ws_sql(raw)} = k.found, 'exact', 'normalized')"
    judged = (
        f"case when k.key = '' then {_outcome(tx.quote('unknown'))} "
        f"when k.found is not null then {_outcome(exact, 'k.found', '0')} "
        f"else element_at(transform(array({ranked}), r -> {decided}), 1) end"
    )
    looked = f"named_struct('key', vk, 'found', try_element_at({known}, vk))"
    return (
        f"element_at(transform(transform(array({tx.vocab_key_sql(raw)}), vk -> {looked}), k -> {judged}), 1)"
    )


def match_vocabulary(raw: Column, terms: Sequence[str]) -> Column:
    """struct(status, value, distance); status is exact, normalized, corrected, ambiguous or unknown."""
    return tx.let_sql(raw, "raw", match_sql("raw", terms))


def cell_outcomes_sql(cell: str, terms: Sequence[str]) -> str:
    parts = (
        f"filter(transform(split({cell}, {tx.quote(fixed.MULTI_VALUE_SPLIT)}), w -> {tx.normalize_whitespace_sql('w')}), "
        f"w -> w <> '')"
    )
    resolved = (
        f"transform(transform({parts}, pt -> named_struct('part', pt, 'm', {match_sql('pt', terms)})), "
        f"q -> named_struct('part', q.part, 'status', q.m.status, 'value', q.m.value))"
    )
    # A cell that is exactly one term needs no splitting: by far the commonest case.
    plain = f"array(named_struct('part', {cell}, 'status', 'exact', 'value', {cell}))"
    return f"if({cell} in ({', '.join(map(tx.quote, terms))}), {plain}, {resolved})"


def cell_value_sql(outcomes: str) -> str:
    joined = f"array_join(transform({outcomes}, o -> coalesce(o.value, o.part)), '{fixed.MULTI_VALUE_JOIN}')"
    return f"if(size({outcomes}) > 0, {joined}, null)"


def corrected_pairs_sql(outcomes: str) -> str:
    changed = f"filter({outcomes}, o -> o.status in ('normalized', 'corrected'))"
    return f"""transform({changed}, o -> concat(o.part, '" to "', o.value))"""


def unresolved_parts_sql(outcomes: str) -> str:
    return f"transform(filter({outcomes}, o -> o.value is null), o -> o.part)"


def cell_outcomes(cell: Column, terms: Sequence[str]) -> Column:
    """One struct(part, status, value) per answer of a multi-value cell, in the order given."""
    return tx.let_sql(cell, "cell", cell_outcomes_sql("cell", terms))


def cell_value(outcomes: Column) -> Column:
    """The cell rebuilt: resolved terms, unresolved answers verbatim; NULL where nothing was given."""
    return tx.let_sql(outcomes, "os", cell_value_sql("os"))


def corrected_pairs(outcomes: Column) -> Column:
    return tx.let_sql(outcomes, "os", corrected_pairs_sql("os"))


def unresolved_parts(outcomes: Column) -> Column:
    return tx.let_sql(outcomes, "os", unresolved_parts_sql("os"))
