"""What a file name and its path say: kind, place, expression, participant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.fixed import Preset
from rowwarden.functions import text as tx
from rowwarden.functions.distance import distance_to_word_sql

_WORKBOOK = r"(?i)\.xls[xm]\z"
_UPLOAD = r"(?i)\.(xlsx|xlsm)\z"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(name: Column) -> Column:
    """The last ``.xxx`` in lower case, or an empty string."""
    return F.lower(F.regexp_extract(name, r"\.[^.]+\z", 0))


def is_workbook(name: Column) -> Column:
    """A spreadsheet that is not an editor's lock file."""
    return name.rlike(_WORKBOOK) & ~name.startswith("~$")


def is_accepted_upload(name: Column) -> Column:
    return name.rlike(_UPLOAD)


def tokenize(name: Column) -> Column:
    """Lower-case runs of letters and digits of the base name, accents folded."""
    words = F.trim(F.regexp_replace(F.lower(tx.fold(base_name(name))), "[^a-z0-9]+", " "))
    return F.array_remove(F.split(words, " "), "")


def video_extension_in(name: Column, preset: Preset) -> Column:
    """The first of the preset's video extensions found anywhere in the name, a comma read as a full stop."""
    def first(candidate: Column) -> Column:
        found = F.lit(None).cast("string")
        for ext in reversed(preset.video_ext):
            pattern = "(?i)" + ext.replace(".", r"\.") + "(?![a-z0-9])"
            found = F.when(candidate.rlike(pattern), ext).otherwise(found)
        return found

    return tx.let(F.translate(tx.fold(base_name(name)), ",", "."), first)


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def classify_file(name: Column, preset: Preset) -> Column:
    """video, assent, icf or other."""
    def kind(base: Column) -> Column:
        return (
            F.when(video_extension_in(base, preset).isNotNull(), "video")
            .when(_contains_any(base, preset.assent_match) & extension_of(base).isin(*preset.assent_ext), "assent")
            .when(_contains_any(base, preset.icf_match), "icf")
            .otherwise("other")
        )

    return tx.let(F.lower(base_name(name)), kind)


def derive_environment(name: Column) -> Column:
    base = F.lower(base_name(name))
    return F.when(base.contains("indoor"), "Indoor").when(base.contains("outdoor"), "Outdoor")


def is_neutralish_sql(token: str, preset: Preset) -> str:
    """The neutral word itself, or (fuzzy presets) a spelling within two edits of it."""
    target = preset.neutral_token
    same = f"{token} = {tx.quote(target)}"
    if not preset.fuzzy:
        return same
    near = f"abs(length({token}) - {len(target)}) <= 2 and levenshtein({token}, {tx.quote(target)}, 4) <> -1"
    return f"({same} or if({near}, {distance_to_word_sql(token, target)} <= 2, false))"


def descriptive_token(tokens: Column) -> Column:
    """The last word that names an expression rather than the file."""
    useful = F.filter(
        tokens,
        lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.STRUCTURAL_TOKENS) & ~t.rlike(r"^\d+\z"),
    )
    return F.coalesce(F.try_element_at(useful, F.lit(-1)), F.lit(""))


def derive_expression(name: Column, preset: Preset) -> Column:
    """struct(expression, token, fuzzy) of a video name.  A negation in any spelling wins."""
    return tx.let(tokenize(name), lambda tokens: _expression_of(tokens, preset))


def _expression_of(tokens: Column, preset: Preset) -> Column:
    target = preset.neutral_token

    def decide(at: Column) -> Column:
        word = F.get(tokens, at - 1)
        before = F.when(at > 1, F.get(tokens, at - 2))
        negated = (
            F.array_join(tokens, " ").rlike(rf"\bnon\s*{target}\b")
            | (at == 0)
            | (F.coalesce(before, F.lit("")) == "non")
            | (word.startswith("non") & (word != target))
        )
        return F.when(
            negated,
            F.struct(
                F.lit("Non-Neutral").alias("expression"), descriptive_token(tokens).alias("token"),
                F.lit(False).alias("fuzzy"),
            ),
        ).otherwise(
            F.struct(F.lit("Neutral").alias("expression"), word.alias("token"), (word != target).alias("fuzzy"))
        )

    neutralish = F.call_function("transform", tokens, F.expr(f"tok -> {is_neutralish_sql('tok', preset)}"))
    return tx.let(F.array_position(neutralish, True).cast("int"), decide)


def _clean_root(root: str) -> str:
    return root.rstrip("/")


def _first_segment(rest: Column) -> Column:
    """First folder of a relative path; empty where the file is not inside a folder."""
    return F.regexp_extract(rest, "^/*([^/]+)/+[^/]", 1)


def participant_folder_of(path: Column, root: str) -> Column:
    """First folder below ``root``, or below the top where the path is not under it."""
    root = _clean_root(root)
    if not root:
        return _first_segment(path)
    inside = F.lower(path).startswith(root.lower() + "/")
    return _first_segment(F.when(inside, F.substring(path, len(root) + 2, 1 << 30)).otherwise(path))


def relative_to_roots(path: Column, roots: Sequence[str]) -> Column:
    """The path below the first root that contains it; NULL under none."""
    rest = F.lit(None).cast("string")
    for root in reversed([r for r in map(_clean_root, roots) if r]):
        rest = F.when(
            F.lower(path).startswith(root.lower() + "/"), F.substring(path, len(root) + 2, 1 << 30)
        ).otherwise(rest)
    return rest


def folder_of(path: Column, roots: Sequence[str]) -> Column:
    """First folder below the first root that contains the path; empty under no root."""
    return F.coalesce(_first_segment(relative_to_roots(path, roots)), F.lit(""))


def candidate_keys(path: Column, roots: Sequence[str]) -> Column:
    """Distinct name keys of every folder between the root and the file, outermost first."""
    segments = F.split(F.coalesce(relative_to_roots(path, roots), F.lit("")), "/+")
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.array_distinct(F.array_compact(F.transform(folders, tx.normalize_name)))
