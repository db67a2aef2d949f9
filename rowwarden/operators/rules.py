"""The five ordered cleaning rules.  Each changes the row and appends what it did to ``issues``, in one narrow pass.

Order matters: a placeholder cleared by rule 3 is not judged by rule 4 and counts as empty in rule 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.functions import vocab
from rowwarden.functions.dates import parse_birthdate
from rowwarden.operators.layouts import Layout

ROW_ISSUE = (
    "struct<severity:string,column:string,header:string,rule:string,original:string,corrected:string,message:string,"
    "phase:int,rule_seq:int>"
)

# --- fixed values: rule names and messages per layout --------------------------------------------------------------
TEXTS = {
    "canonical": {
        "whitespace": ("Whitespace cleaned", "Trimmed surrounding spaces and collapsed repeated spaces."),
        "birthdate_review": "Birthdate reformatted to YYYY/MM",
        "birthdate_kept": " The original value was kept so nothing is lost - please correct it at source.",
        "slash": "The cell contained only a slash placeholder, so it was emptied.",
        "unlisted": "Kept as submitted for a human to fix.",
        "none_cleared": "Head attribute conflict resolved",
        "none_set": "Head attribute placeholder added",
    },
    "delivery": {
        "whitespace": ("Whitespace tidied", "Leading, trailing or repeated spaces removed."),
        "birthdate_review": "Birthdate reformatted, please confirm",
        "birthdate_kept": " Left exactly as submitted.",
        "slash": "The cell held only a slash, so it was emptied.",
        "unlisted": "Kept as submitted.",
        "none_cleared": "None cleared",
        "none_set": "None set",
    },
}
RULE_BIRTHDATE = "Birthdate reformatted to YYYY/MM"
RULE_BIRTHDATE_FAILED = "Birthdate needs a manual fix"
RULE_SLASH = "Slash placeholder cleared"
RULE_UNLISTED = "Value not on the accepted list"
RULE_MATCHED = "Value matched to the accepted list"
MSG_SEPARATORS = "Separators rewritten."


def _texts(layout: Layout) -> dict:
    return TEXTS["delivery" if layout.name == "delivery" else "canonical"]


def _issue(
    layout: Layout, field: str, phase: int, severity: str | Column, rule: str | Column,
    original: Column, corrected: Column | str, message: str | Column,
) -> Column:
    def txt(value: str | Column) -> Column:
        return F.coalesce(F.lit(value).cast("string"), F.lit(""))

    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(layout.letter(field)).alias("column"),
        F.lit(layout.header(field)).alias("header"),
        F.lit(rule).alias("rule"),
        txt(original).alias("original"),
        txt(corrected).alias("corrected"),
        txt(message).alias("message"),
        F.lit(phase).alias("phase"),
        F.lit(layout.fields.index(field)).alias("rule_seq"),
    )


def _text(constant: str) -> str:
    return tx.quote(constant)


def _issue_sql(
    layout: Layout, field: str, phase: int, severity: str, rule: str, original: str, corrected: str, message: str
) -> str:
    """``_issue`` as SQL text."""
    return (
        f"named_struct('severity', {severity}, 'column', {_text(layout.letter(field))}, "
        f"'header', {_text(layout.header(field))}, 'rule', {rule}, 'original', coalesce({original}, ''), "
        f"'corrected', coalesce({corrected}, ''), 'message', coalesce({message}, ''), 'phase', {phase}, "
        f"'rule_seq', {layout.fields.index(field)})"
    )


def _with_issues(df: DataFrame, found: list[Column], changes: dict[str, Column]) -> DataFrame:
    new = F.array_compact(F.array(*found)).cast(f"array<{ROW_ISSUE}>")
    issues = F.concat("issues", new) if "issues" in df.columns else new
    return df.withColumns({**changes, "issues": issues})


def tidy_whitespace(df: DataFrame, layout: Layout) -> DataFrame:
    """Rule 1: invisible or repeated white space in any text cell."""
    rule, message = _texts(layout)["whitespace"]
    fields = [f for f in layout.fields if f in df.columns]
    df = df.withColumns({"_w_" + f: F.expr(tx.tidy_or_null_sql(f"`{f}`")) for f in fields})
    found = [
        F.expr(
            f"if(coalesce(`_w_{f}`, '') <> `{f}`, "
            f"{_issue_sql(layout, f, 1, _text('fixed'), _text(rule), f'`{f}`', f'`_w_{f}`', _text(message))}, null)"
        )
        for f in fields
    ]
    changes = {f: F.col("_w_" + f) for f in fields}
    return _with_issues(df, found, changes).drop(*["_w_" + f for f in fields])


def reformat_birthdate(
    df: DataFrame, layout: Layout, *, current_year: int, day_first: bool = True, strict_reference: bool = False
) -> DataFrame:
    """Rule 2: birth dates to YYYY/MM; what cannot be read is kept as submitted.

    Every doubtful date is reported.  ``strict_reference`` leaves two gaps as they were: the canonical layout says
    nothing of a doubtful date that needed no rewriting, the delivery layout nothing of a year without a month.
    """
    field = layout.birthdate
    delivery = layout.name == "delivery"
    texts = _texts(layout)
    typed = [c for c in ("birthdate_number", "birthdate_ts") if c in df.columns]
    parsed = parse_birthdate(
        F.col(field),
        current_year=current_year,
        day_first=day_first,
        number=F.col("birthdate_number") if "birthdate_number" in typed else None,
        timestamp=F.col("birthdate_ts") if "birthdate_ts" in typed else None,
    )

    def judge(b: Column) -> Column:
        raw, review = b.raw, b.parsed.status == "review"
        changed = b.parsed.value != raw
        told = changed if strict_reference and not delivery else (changed | review)
        unread = b.parsed.value.isNull() & (b.parsed.status != "empty")
        if strict_reference and delivery:
            unread = unread & (b.parsed.status == "unparseable")
        issue = F.when(
            b.parsed.value.isNotNull() & told,
            _issue(
                layout, field, 2, F.when(review, "review").otherwise("fixed"),
                F.when(review, texts["birthdate_review"]).otherwise(RULE_BIRTHDATE), raw, b.parsed.value,
                b.parsed.message,
            ),
        ).when(
            unread,
            _issue(
                layout, field, 2, "review", RULE_BIRTHDATE_FAILED, raw, raw,
                F.concat(b.parsed.message, F.lit(texts["birthdate_kept"])),
            ),
        )
        return F.struct(F.coalesce(b.parsed.value, raw).alias("value"), issue.alias("issue"))

    judged = tx.let(F.struct(F.col(field).alias("raw"), parsed.alias("parsed")), judge)
    df = df.withColumn("_bd", F.when(F.col(field).isNotNull(), judged))
    return _with_issues(df, [F.col("_bd.issue")], {field: F.col("_bd.value")}).drop("_bd", *typed)


def clear_placeholder(df: DataFrame, layout: Layout) -> DataFrame:
    """Rule 3: a cell of slashes only means nothing."""
    field = layout.placeholder
    hit = tx.is_slash_placeholder(F.col(field))
    found = [F.when(hit, _issue(layout, field, 3, "fixed", RULE_SLASH, F.col(field), "", _texts(layout)["slash"]))]
    return _with_issues(df, found, {field: F.when(hit, F.lit(None).cast("string")).otherwise(F.col(field))})


def match_attributes(df: DataFrame, layout: Layout, *, strict_reference: bool = False) -> DataFrame:
    """Rule 4: attribute cells against their vocabulary; unresolved answers stay verbatim and are reported.

    ``strict_reference`` says nothing where only the separators between answers were rewritten.
    """
    attributes = {f: terms for f, terms in layout.attributes.items() if f in df.columns}
    judged = {
        "_j_" + f: tx.let_sql(F.col(f), "raw", _attribute_sql(layout, f, terms, strict_reference))
        for f, terms in attributes.items()
    }
    changes = {f: F.col(f"_j_{f}.value") for f in attributes}
    done = _with_issues(df.withColumns(judged), [F.col(f"_j_{f}.issue") for f in attributes], changes)
    return done.drop(*judged)


def _attribute_sql(layout: Layout, field: str, terms: tuple[str, ...], strict_reference: bool) -> str:
    """struct(value, issue) of the cell ``raw``."""
    def issue(severity: str, rule: str, message: str) -> str:
        return _issue_sql(layout, field, 4, _text(severity), _text(rule), "c.raw", "c.value", message)

    def listed(lead: str, items: str) -> str:
        return f"""concat('{lead} "', array_join({items}, '", "'), '".')"""

    note = "''"
    if layout.name != "delivery":
        note = f"if(size(c.corrected) > 0, {listed(' Also corrected', 'c.corrected')}, '')"
    accepted = _text(" Accepted values are: " + ", ".join(terms) + ".")
    unlisted = (
        f"concat({listed('Not recognised:', 'c.unresolved')}, {_text(' ' + _texts(layout)['unlisted'])}, {note}, "
        f"{accepted})"
    )
    told = (
        f"when size(c.unresolved) > 0 then {issue('review', RULE_UNLISTED, unlisted)} "
        f"when size(c.corrected) > 0 then {issue('fixed', RULE_MATCHED, listed('Corrected', 'c.corrected'))}"
    )
    if not strict_reference:
        told += f" when coalesce(c.value, '') <> c.raw then {issue('fixed', RULE_MATCHED, _text(MSG_SEPARATORS))}"
    parts = (
        f"named_struct('raw', raw, 'value', {vocab.cell_value_sql('os')}, "
        f"'unresolved', {vocab.unresolved_parts_sql('os')}, 'corrected', {vocab.corrected_pairs_sql('os')})"
    )
    looked = (
        f"element_at(transform(transform(array({vocab.cell_outcomes_sql('raw', terms)}), os -> {parts}), "
        f"c -> named_struct('value', c.value, 'issue', case {told} end)), 1)"
    )
    # A cell that is exactly one term is unchanged and has nothing to report.
    untouched = f"named_struct('value', raw, 'issue', cast(null as {ROW_ISSUE}))"
    exact = ", ".join(_text(t) for t in terms)
    return f"case when raw in ({exact}) then {untouched} when raw is not null then {looked} end"


def settle_none(df: DataFrame, layout: Layout) -> DataFrame:
    """Rule 5: the None column is empty beside any attribute, and says so where there is none."""
    field, text = layout.none, fixed.NONE_APPLY_TEXT
    attributes = [f for f in layout.attributes if f in df.columns]
    delivery, texts = layout.name == "delivery", _texts(layout)
    span = f"{layout.letter(attributes[0])}-{layout.letter(attributes[-1])}"
    written = (
        f'No attributes are present, so None is "{text}".'
        if delivery
        else f'Columns {span} are all empty, so column {layout.letter(field)} was set to "{text}".'
    )
    letters = F.array_compact(
        F.array(*[F.when(F.col(f).isNotNull(), F.lit(layout.letter(f))) for f in attributes])
    )

    def judge(s: Column) -> Column:
        filled = F.size(s.letters) > 0
        cleared = (
            F.lit("An attribute is present, so None must be empty.")
            if delivery
            else F.concat(
                F.lit("Column "), F.array_join(s.letters, ", "),
                F.lit(f" already has head attribute data, so column {layout.letter(field)} was emptied."),
            )
        )
        issue = F.when(
            filled & s.none.isNotNull(), _issue(layout, field, 5, "fixed", texts["none_cleared"], s.none, "", cleared)
        ).when(
            ~filled & (F.coalesce(s.none, F.lit("")) != text),
            _issue(layout, field, 5, "fixed", texts["none_set"], s.none, text, written),
        )
        return F.struct(F.when(~filled, text).alias("value"), issue.alias("issue"))

    df = df.withColumn("_none", tx.let(F.struct(letters.alias("letters"), F.col(field).alias("none")), judge))
    return _with_issues(df, [F.col("_none.issue")], {field: F.col("_none.value")}).drop("_none")


def apply_rules(
    rows: DataFrame, layout: Layout, *, current_year: int, day_first: bool = True, strict_reference: bool = False
) -> DataFrame:
    """All five rules in order; the result has the cleaned columns and ``issues``."""
    rows = tidy_whitespace(rows, layout)
    rows = reformat_birthdate(
        rows, layout, current_year=current_year, day_first=day_first, strict_reference=strict_reference
    )
    rows = clear_placeholder(rows, layout)
    rows = match_attributes(rows, layout, strict_reference=strict_reference)
    return settle_none(rows, layout)
