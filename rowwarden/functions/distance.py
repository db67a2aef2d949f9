"""Optimal-string-alignment distance (an adjacent swap costs 1) as native higher-order expressions.

Spark's ``levenshtein`` scores a swap 2, so it cannot stand in; it never exceeds twice the alignment distance though,
which makes it a cheap pre-filter.  The distance itself is the bit-parallel formulation of Hyyro (2003): one fold over
the characters of one string, with the other held as bit masks in a BIGINT.  Both strings longer than 62 characters
fall back to the row-by-row recurrence.

Expressions are assembled as SQL text: they are long, and text is parsed in one call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden.functions import text as tx

_WORD = 62


def _fold_masks(masks: str, size: str) -> str:
    """Distance from the per-character match masks of the scanned string; ``size`` is the length of the other."""
    full, top = f"(shiftleft(1L, {size}) - 1L)", f"shiftleft(1L, {size} - 1)"
    swap = "(shiftleft(~s.d0 & pm, 1) & s.old)"
    d0 = f"(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn | {swap}) & {full})"
    hp, hn = f"(s.vn | (~({d0} | s.vp) & {full}))", f"({d0} & s.vp)"
    hp1, hn1 = f"((shiftleft({hp}, 1) | 1L) & {full})", f"(shiftleft({hn}, 1) & {full})"
    step = (
        f"named_struct('vp', {hn1} | (~({d0} | {hp1}) & {full}), 'vn', {hp1} & {d0}, 'd0', {d0}, 'old', pm, "
        f"'dist', s.dist + if(({hp} & {top}) <> 0L, 1, 0) - if(({hn} & {top}) <> 0L, 1, 0))"
    )
    start = f"named_struct('vp', {full}, 'vn', 0L, 'd0', 0L, 'old', 0L, 'dist', cast({size} as int))"
    return f"aggregate({masks}, {start}, (s, pm) -> {step}, s -> s.dist)"


def word_table_sql(words: Sequence[str]) -> str:
    """Constant words of 1..62 characters as an array of struct(ord, word, size, masks)."""
    entries = []
    for i, word in enumerate(words):
        masks: dict[str, int] = {}
        for at, char in enumerate(word):
            masks[char] = masks.get(char, 0) | (1 << at)
        table = ", ".join(f"{tx.quote(c)}, {m}L" for c, m in masks.items())
        entries.append(f"named_struct('ord', {i}, 'word', {tx.quote(word)}, 'size', {len(word)}, 'masks', map({table}))")
    return f"array({', '.join(entries)})"


def distance_to_entry_sql(text: str, entry: str) -> str:
    """Distance from ``text`` to an entry of the word table."""
    scanned = f"transform(split({text}, ''), ch -> coalesce(try_element_at({entry}.masks, ch), 0L))"
    return f"if(length({text}) = 0, {entry}.size, {_fold_masks(scanned, f'{entry}.size')})"


def distance_to_word_sql(text: str, word: str) -> str:
    return f"element_at(transform({word_table_sql([word])}, wd -> {distance_to_entry_sql(text, 'wd')}), 1)"


def distance_to_word(text: Column, word: str) -> Column:
    """Distance from ``text`` to one constant word."""
    return tx.let_sql(text, "t", distance_to_word_sql("t", word))


def _short_sql(pattern: str, text: str) -> str:
    bits = f"transform(split({pattern}, ''), (c, i) -> if(c = letter, shiftleft(1L, i), 0L))"
    table = (
        f"map_from_arrays(array_distinct(split({pattern}, '')), transform(array_distinct(split({pattern}, '')), "
        f"letter -> aggregate({bits}, 0L, (acc, bit) -> acc | bit)))"
    )
    scanned = f"transform(split({text}, ''), ch -> coalesce(try_element_at(mt, ch), 0L))"
    return f"element_at(transform(array({table}), mt -> {_fold_masks(scanned, f'length({pattern})')}), 1)"


def _long_sql(a: str, b: str) -> str:
    """Row-by-row recurrence; the state is the last two rows of the table."""
    plain = (
        f"least(get(r.p1, j) + 1, get(acc, j - 1) + 1, "
        f"get(r.p1, j - 1) + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1))"
    )
    swapped = (
        f"i > 1 and j > 1 and substr({a}, i, 1) = substr({b}, j - 1, 1) and substr({a}, i - 1, 1) = substr({b}, j, 1)"
    )
    swap_cost = f"get(r.p2, j - 2) + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1)"
    cell = f"array_append(acc, if({swapped}, least({plain}, {swap_cost}), {plain}))"
    row = f"aggregate(sequence(1, length({b})), array(i), (acc, j) -> {cell})"
    start = f"named_struct('p2', cast(array() as array<int>), 'p1', sequence(0, length({b})))"
    return (
        f"aggregate(sequence(1, length({a})), {start}, (r, i) -> named_struct('p2', r.p1, 'p1', {row}), "
        f"r -> get(r.p1, length({b})))"
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Distance between two string columns; NULL if either is NULL."""
    x, y = "p.a", "p.b"
    body = (
        f"case when {x} is null or {y} is null then null when {x} = {y} then 0 "
        f"when length({x}) = 0 then length({y}) when length({y}) = 0 then length({x}) "
        f"when length({x}) <= {_WORD} then {_short_sql(x, y)} when length({y}) <= {_WORD} then {_short_sql(y, x)} "
        f"else {_long_sql(x, y)} end"
    )
    return tx.let_sql(F.struct(a.alias("a"), b.alias("b")), "p", body)


def sorted_letters(text: Column) -> Column:
    """The characters of a text in order, for ``within``."""
    return F.array_join(F.array_sort(F.split(text, "")), "")


def within(a: Column, b: Column, limit: int, letters: tuple[Column, Column] | None = None) -> Column:
    """``edit_distance(a, b) <= limit``; only pairs that the plain distance doesn't settle are folded.

    Beyond a plain distance of ``limit`` there must be a swap, which leaves the characters as they are and one edit less to
    change them: ``letters``, the ``sorted_letters`` of both (null: not known), settle most of the other pairs.
    """
    plain = F.levenshtein(a, b, 2 * limit)
    near = F.when(plain == -1, False).when(plain <= limit, True)
    if letters:
        near = near.when(F.levenshtein(*letters, 2 * (limit - 1)) == -1, False)
    return F.coalesce(near.when(plain.isNotNull(), edit_distance(a, b) <= limit), F.lit(False))


def max_edits_sql(length: str) -> str:
    return f"case when {length} < 5 then 1 when {length} < 9 then 2 else 3 end"


def max_edits(length: Column) -> Column:
    return tx.let_sql(length, "n", max_edits_sql("n"))
