"""Matching media files to rows: one video, one consent and one assent file each, or a named reason why not.

Files are reduced once to *facts*: how many files a participant has of each kind, place, expression and word, and the
first of them by number.  Rows are reduced once to distinct *asks* (participant, wanted place, wanted expression, wanted
word).  Both keep only what is counted or looked up, are combined before they are shuffled, and everything is decided on
them; a file's own columns are fetched for the files that were picked.  Rows and files of a participant are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.fixed import Preset
from rowwarden.functions import filenames as fn
from rowwarden.functions import text as tx
from rowwarden.functions.links import normalize_shared_link
from rowwarden.operators.wordfit import fitting_tokens
from rowwarden.session import by_merge, dropped, staged

FILE_FIELDS = ("path", "name", "link", "link_existed", "recorded_at", "environment", "expression", "token", "fuzzy")
# Files whose names are joined to one text before the texts are joined: no list of names is longer.
NAMES_BITS = 12

# --- fixed values: problem and guard texts -------------------------------------------------------------------------
PROBLEM_NO_FOLDER = "No scanned folder matches this participant."
PROBLEM_NO_ICF = "No unambiguous consent file for this participant."
PROBLEM_NO_ASSENT = "No unambiguous assent file for this participant."
PROBLEM_AMBIGUOUS = "%d videos match %s / %s and column K does not single one out."
PROBLEM_NO_VIDEO = "No video file matches %s / %s."
GUARDS = {
    "unmatched-name": ("error", "Folder name didn't match a sheet row"),
    "missing-icf": ("error", "Consent file not found"),
    "duplicate-icf": ("warn", "More than one consent file"),
    "missing-assent": ("error", "Assent file not found"),
    "duplicate-assent": ("warn", "More than one assent file"),
    "ambiguous-slot": ("warn", "Two videos, one slot"),
}
DETAIL_UNMATCHED = (
    "No participant name in column D normalizes to it. Confirm the mapping or fix the folder name."
)
DETAIL_MISSING = {
    "icf": "No ICF/consent file in this folder. AC left blank — never borrowed from another participant.",
    "assent": "No assent file in this folder. AD left blank — never borrowed from another participant.",
}
DETAIL_DUPLICATE = {"icf": "Found %s. Ambiguous, so AC is held.", "assent": "Found %s. Ambiguous, so AD is held."}
DETAIL_AMBIGUOUS = "%s both map to %s. Needs column K to pick the row."


def classify_files(files: DataFrame, preset: Preset) -> DataFrame:
    """Add kind, environment, expression, token, fuzzy, link (durable form), link_existed, recorded_at.

    Needs path and name; link and server_modified (or recorded_at) are used where present.
    """
    name = F.coalesce(F.col("name"), fn.base_name(F.col("path")))
    given = F.col("link") if "link" in files.columns else F.lit(None).cast("string")
    stamps = [F.col(c) for c in ("recorded_at", "server_modified") if c in files.columns]
    has_link = F.coalesce(given, F.lit("")) != ""
    video = F.col("kind") == "video"
    read = F.col("_read")
    return (
        files.withColumns({"name": name, "kind": fn.classify_file(name, preset)})
        .withColumn("_read", F.when(video, fn.derive_expression(F.col("name"), preset)))
        .withColumns({
            "environment": F.when(video, fn.derive_environment(F.col("name"))),
            "expression": read.expression, "token": read.token, "fuzzy": read.fuzzy,
            "link": F.when(has_link, normalize_shared_link(given)).otherwise(""),
            "link_existed": has_link,
            "recorded_at": F.coalesce(*stamps) if stamps else F.lit(None).cast("timestamp"),
        })
        .drop("_read")
    )


def prepare_files(files: DataFrame, preset: Preset) -> DataFrame:
    """``classify_files`` with ``fid``, numbers in listing order (``file_ix``, else path); written once.

    Numbers rise with the listing but leave gaps: partitions of a sorted listing count on their own.
    """
    order = ["file_ix", "path"] if "file_ix" in files.columns else ["path"]
    # Classified after the listing was dealt out: what lies before a range partitioning runs twice, once for its sample.
    listed = files.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(classify_files(listed, preset).withColumn("fid", F.monotonically_increasing_id()))


def media_facts(files: DataFrame) -> DataFrame:
    """(group_id, name_key, kind, env, expr, token, n, fid): files of a participant that no row can tell apart by wish.

    A folder whose name leaves no key stands for itself and never meets a row.
    """
    owned = files.filter(F.col("folder").isNotNull()).select(
        F.coalesce("name_key", "folder").alias("group_id"), "name_key", "kind", F.lower("environment").alias("env"),
        F.lower("expression").alias("expr"), "token", "fid",
    )
    return staged(owned.groupBy(*[c for c in owned.columns if c != "fid"]).agg(F.count(F.lit(1)).alias("n"), F.min("fid").alias("fid")))


def _kinds(of: str) -> list[Column]:
    """Per group of facts: files of each kind, the first file, the first consent and assent file."""
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.col(of)))

    counts = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("video", "icf", "assent", "other")]
    return [F.min(of).alias("first_fid"), *counts, first("icf").alias("icf_fid"), first("assent").alias("assent_fid")]


def group_files(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per participant: group_id, name_key, folder as its first file spells it, and files per kind."""
    facts = media_facts(files) if facts is None else facts
    groups = facts.groupBy("group_id", "name_key").agg(*_kinds("fid"))
    spelt = files.select(F.col("fid").alias("first_fid"), "folder")
    return groups.join(by_merge(spelt), "first_fid").select("group_id", "name_key", "folder", "n_video", "n_icf", "n_assent", "n_other")


# ---- slots: the few classes of place and expression a row can ask for ----------------------------------------------
# A wanted place is blank (anything goes), indoor, outdoor, or some other word, which only a video of unknown place
# satisfies.  A wanted expression is blank or must be equal.  So at most 4 x 3 classes per participant have candidates.
_SLOT = ["name_key", "env_class", "expr_class"]


def wanted_environment_class(wanted: Column) -> Column:
    low = F.lower(wanted)
    return F.when(low.isin("", "indoor", "outdoor"), low).otherwise("other")


def wanted_expression_class(wanted: Column) -> Column:
    return F.lower(wanted)


def satisfies(env: Column, expr: Column, env_class: Column, expr_class: Column) -> Column:
    """Whether a video of this place and expression, both in small letters, is a candidate of a slot class."""
    fits_env = env.isNull() | (env_class == "") | (env_class == env)
    return fits_env & ((expr_class == "") | F.coalesce(expr_class == expr, F.lit(False)))


def row_asks(rows: DataFrame) -> DataFrame:
    """Rows with what they ask for; needs folder_name, environment, expression, non_neutral."""
    def text(name: str) -> Column:
        return tx.trim_ws(F.coalesce(F.col(name), F.lit("")))

    return rows.withColumns({
        "name_key": tx.normalize_name(F.col("folder_name")),
        "want_env": text("environment"),
        "want_expr": text("expression"),
        "wanted": F.coalesce(tx.normalize_name(F.col("non_neutral")), F.lit("")),
    })


# ---- the plan -------------------------------------------------------------------------------------------------------

_ASK = ["name_key", "want_env", "want_expr", "wanted"]


def participants(facts: DataFrame, asks: DataFrame, files: DataFrame) -> DataFrame:
    """(name_key, folder, icf, assent, first_row) of the participants that have both files and rows.

    Facts and asks are aggregated together, so that they meet in one shuffle; the three files of a participant are
    fetched by number.
    """
    none = F.lit(None)
    media = facts.filter(F.col("name_key").isNotNull()).select("name_key", "kind", "n", "fid", none.cast("long").alias("first"))
    wanted = asks.select("name_key", none.cast("string").alias("kind"), none.cast("long").alias("n"), none.cast("long").alias("fid"), "first")
    found = media.unionByName(wanted).groupBy("name_key").agg(*_kinds("fid"), F.min("first").alias("first_row")) \
        .filter(F.col("first_fid").isNotNull() & F.col("first_row").isNotNull())
    roles = F.inline(F.array(
        F.struct(F.lit("folder").alias("role"), F.col("first_fid").alias("fid")),
        F.struct(F.lit("icf").alias("role"), F.when(F.col("n_icf") == 1, F.col("icf_fid")).alias("fid")),
        F.struct(F.lit("assent").alias("role"), F.when(F.col("n_assent") == 1, F.col("assent_fid")).alias("fid")),
    ))
    picked = found.select("name_key", "first_row", roles).filter(F.col("fid").isNotNull())
    fetched = picked.join(by_merge(files.select("fid", "folder", F.struct(*FILE_FIELDS).alias("file"))), "fid")

    def of(role: str, column: str) -> Column:
        return F.first(F.when(F.col("role") == role, F.col(column)), ignorenulls=True)

    return fetched.groupBy("name_key").agg(
        of("folder", "folder").alias("folder"), of("icf", "file").alias("icf"), of("assent", "file").alias("assent"), F.first("first_row").alias("first_row"))


def _places(facts: DataFrame) -> DataFrame:
    """(name_key, places): per participant the few places and expressions its videos have, with their number and the first."""
    videos = facts.filter((F.col("kind") == "video") & F.col("name_key").isNotNull())
    each = videos.groupBy("name_key", "env", "expr").agg(F.sum("n").alias("n"), F.min("fid").alias("fid"))
    return each.groupBy("name_key").agg(F.collect_list(F.struct("env", "expr", "n", "fid")).alias("places"))


def answer_asks(asks: DataFrame, files: DataFrame, facts: DataFrame, preset: Preset) -> DataFrame:
    """One row per ask of a participant with files: the ask, folder, icf, assent, n_videos, video, video_reason and ``_judged``.

    ``asks`` has _ASK, first (the first row that asks so) and ask_id.  Every step is written before the next is shuffled.
    """
    fitting = F.filter("places", lambda p: satisfies(p.env, p.expr, F.col("env_class"), F.col("expr_class")))
    placed = _classed(asks).join(by_merge(_places(facts)), "name_key", "left").withColumn("places", fitting).withColumns({
        "n_videos": F.coalesce(F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p.n), F.lit(0)),
        "only_fid": F.array_min(F.transform("places", lambda p: p.fid)),
    })
    placed = staged(placed.drop("places", "first"))
    contested = placed.filter((F.col("n_videos") > 1) & (F.col("wanted") != "")).select(*_SLOT, "ask_id", "wanted")
    tokens = facts.filter((F.col("kind") == "video") & F.col("name_key").isNotNull() & (F.col("token") != ""))
    hits = fitting_tokens(contested, tokens, ["name_key"], "ask_id", preset.fuzzy, ["env", "expr"],
                          satisfies(*map(F.col, ("env", "expr", "env_class", "expr_class"))))
    n, hit = F.col("n_videos"), F.when(F.col("n_hits") == 1, F.col("hit"))
    reason = F.when(n == 0, "none").when(n == 1, "unique").when(hit.isNotNull(), "column-k").otherwise("ambiguous")
    # Asks without a video get a number of their own that no file has, so that they don't meet in one task as nulls would.
    fid = F.when(n == 1, F.col("only_fid")).when(n > 1, hit)
    decided = staged(placed.join(by_merge(hits), "ask_id", "left").select(
        *_ASK, n.alias("n_videos"), F.coalesce(fid, -1 - F.col("ask_id")).alias("fid"), reason.alias("video_reason")))
    picked = files.filter("kind = 'video'").select("fid", F.struct(*FILE_FIELDS).alias("video"))
    dropped(placed)
    people = staged(participants(facts, asks, files))
    shown = staged(decided.join(by_merge(picked), "fid", "left").drop("fid"))
    dropped(decided)
    answers = staged(_judged(shown.join(by_merge(people), "name_key")))
    dropped(shown, people)
    return answers


def _judged(answers: DataFrame) -> DataFrame:
    """Answers with what follows from them for any row: ask_status, ask_problems, and icf_row and assent_row, the row a paper is shown in first."""
    video, icf, assent = F.col("video"), F.col("icf"), F.col("assent")
    shown_env = F.when(F.col("want_env") == "", "?").otherwise(F.col("want_env"))
    shown_expr = F.when(F.col("want_expr") == "", "?").otherwise(F.col("want_expr"))
    problems = F.array_compact(F.array(
        F.when(F.col("video_reason") == "ambiguous",
               F.format_string(PROBLEM_AMBIGUOUS, F.col("n_videos"), F.col("want_env"), F.col("want_expr")))
        .when(F.col("video_reason") == "none", F.format_string(PROBLEM_NO_VIDEO, shown_env, shown_expr)),
        F.when(icf.isNull(), PROBLEM_NO_ICF),
        F.when(assent.isNull(), PROBLEM_NO_ASSENT),
    ))
    return answers.withColumns({
        "ask_status": plan_status(F.lit(True), video, icf, assent), "ask_problems": problems,
        "icf_row": F.when(icf.isNotNull(), F.col("first_row")), "assent_row": F.when(assent.isNotNull(), F.col("first_row")),
        "video_reason": F.when(F.col("video_reason").isin("unique", "column-k"), F.col("video_reason")),
    }).drop("first_row")


def plan_rows(rows: DataFrame, files: DataFrame, preset: Preset, position: str = "merged_row", facts: DataFrame | None = None) -> DataFrame:
    """Rows with their plan: video, video_reason, icf, assent, *_repeat_of, status, problems.

    ``files`` come from ``prepare_files``; ``facts``, where several results need them, from ``media_facts``.  All columns
    of ``rows`` are kept.  Rows meet their answer by what they ask for; asks that many rows share are split by AQE.
    """
    facts = media_facts(files) if facts is None else facts
    asked = row_asks(rows)
    asks = asked.filter(F.col("name_key").isNotNull()).groupBy(*_ASK).agg(F.min(position).cast("long").alias("first"))
    asks = staged(asks.withColumn("ask_id", F.monotonically_increasing_id()))
    answers = answer_asks(asks, files, facts, preset)
    dropped(asks)
    planned = asked.join(by_merge(answers), _ASK, "left")
    return (
        planned.withColumns({
            "status": F.coalesce("ask_status", F.lit("skipped")),
            "problems": F.coalesce("ask_problems", F.array(F.lit(PROBLEM_NO_FOLDER))),
            "icf_repeat_of": F.when(F.col("icf_row") < F.col(position), F.col("icf_row")),
            "assent_repeat_of": F.when(F.col("assent_row") < F.col(position), F.col("assent_row")),
            "matched_folder": F.col("folder"),
        })
        .drop("folder", "ask_status", "ask_problems", "icf_row", "assent_row", "wanted")
    )


def plan_status(found: Column, video: Column, icf: Column, assent: Column) -> Column:
    matched = video.isNotNull() & icf.isNotNull() & assent.isNotNull()
    linked = matched & (video.link != "") & (icf.link != "") & (assent.link != "")
    return (
        F.when(~found, "skipped")
        .when(linked, "filled")
        .when(matched, "awaiting-link")
        .when(video.isNotNull() | icf.isNotNull() | assent.isNotNull(), "review")
        .otherwise("missing")
    )


# ---- guards ---------------------------------------------------------------------------------------------------------

def _guard(kind: str, who: Column, detail: Column | str) -> Column:
    severity, title = GUARDS[kind]
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(title).alias("title"),
        who.alias("who"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def row_keys(rows: DataFrame) -> DataFrame:
    """Distinct name keys that occur in the sheet."""
    return rows.select(tx.normalize_name(F.col("folder_name")).alias("name_key")).filter(
        F.col("name_key").isNotNull()
    ).distinct()


def _unmatched() -> Column:
    return _guard("unmatched-name", F.format_string('folder "%s"', F.col("folder")), DETAIL_UNMATCHED)


def unmatched_groups(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Participants with files but no row, as guards."""
    return groups.join(by_merge(row_keys(rows)), "name_key", "left_anti").select(F.inline(F.array(_unmatched())))


def held_groups(files: DataFrame, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``group_files`` with ``held``: whether the sheet has a row of the participant."""
    keys = row_keys(rows).withColumn("held", F.lit(True))
    return group_files(files, facts).join(by_merge(keys), "name_key", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def ambiguous_slots(plan: DataFrame) -> DataFrame:
    """Distinct (participant, place, expression) asked for by a row no video could be picked for."""
    slots = plan.filter(
        F.col("matched_folder").isNotNull() & F.col("video").isNull() & (F.col("n_videos") > 1)
    )
    return slots.groupBy("name_key", "want_env", "want_expr").agg(F.min("matched_folder").alias("who"))


def _classed(slots: DataFrame) -> DataFrame:
    return slots.withColumns({
        "env_class": wanted_environment_class(F.col("want_env")),
        "expr_class": wanted_expression_class(F.col("want_expr")),
    })


def _members(files: DataFrame, groups: DataFrame, slots: DataFrame) -> DataFrame:
    """(kind, who, _SLOT, fid, name, path): every file behind a guard, once per slot class it is a candidate of.

    The few guards are joined to all files, so a guard of many files is split like any other hot key of a join.
    """
    none = F.lit(None).cast("string")
    double = groups.filter("held").select("name_key", F.col("folder").alias("who"), F.inline(F.array(
        F.struct(F.lit("icf").alias("paper"), F.col("n_icf").alias("n")), F.struct(F.lit("assent").alias("paper"), F.col("n_assent").alias("n")),
    ))).filter("n > 1").select("name_key", "paper", "who")
    papers = files.filter(F.col("kind").isin("icf", "assent") & F.col("name_key").isNotNull()).select(
        "name_key", F.col("kind").alias("paper"), "fid", "name", "path")
    copies = papers.join(by_merge(double), ["name_key", "paper"]).select(
        F.concat(F.lit("duplicate-"), "paper").alias("kind"), "who", "name_key", none.alias("env_class"), none.alias("expr_class"), "fid", "name", "path")
    classes = _classed(slots).groupBy(*_SLOT).agg(F.min("who").alias("who"))
    videos = files.filter((F.col("kind") == "video") & F.col("name_key").isNotNull()).select(
        "name_key", F.lower("environment").alias("env"), F.lower("expression").alias("expr"), "fid", "name", "path")
    candidates = videos.join(by_merge(classes), "name_key").filter(satisfies(*map(F.col, ("env", "expr", "env_class", "expr_class")))).select(
        F.lit("ambiguous-slot").alias("kind"), "who", *_SLOT, "fid", "name", "path")
    return copies.unionByName(candidates)


def guard_members(files: DataFrame, rows: DataFrame, plan: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(kind, who, env_class, expr_class, name, path): every file named by a guard, however many there are.

    Candidates of a contested slot are listed once per class, not once per spelling of the wish.
    """
    facts = media_facts(files) if facts is None else facts
    members = _members(files, held_groups(files, rows, facts), ambiguous_slots(plan))
    return members.select("kind", "who", "env_class", "expr_class", "name", "path")


def _named(members: DataFrame) -> DataFrame:
    """(kind, who, _SLOT, names): the names of each guard's files in listing order, whole.

    Files are joined to texts in blocks of consecutive numbers first, so no task holds the list of one guard's files; only
    the text itself, which is the result, is in one place.
    """
    keys = ["kind", "who", *_SLOT]
    joiner = F.when(F.col("kind") == "ambiguous-slot", " and ").otherwise(", ")

    def joined(order: str, text: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.transform(listed, lambda m: m[text])

    blocks = members.groupBy(*keys, F.shiftright("fid", NAMES_BITS).alias("block")).agg(joined("fid", "name").alias("names")) \
        .withColumn("names", F.array_join("names", "\x00"))
    whole = blocks.groupBy(*keys).agg(joined("block", "names").alias("names"))
    return whole.withColumn("names", F.replace(F.array_join("names", "\x00"), F.lit("\x00"), joiner))


def find_guards(files: DataFrame, rows: DataFrame, plan: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """All six guards: kind, severity, title, who, detail.  A text names every file of its guard."""
    facts = media_facts(files) if facts is None else facts
    groups = staged(held_groups(files, rows, facts))
    slots = staged(ambiguous_slots(plan))
    folder, held = F.col("folder"), F.col("held")
    plain = groups.select(F.inline(F.array_compact(F.array(
        F.when(~held, _unmatched()),
        *[F.when(held & (F.col(f"n_{p}") == 0), _guard(f"missing-{p}", folder, DETAIL_MISSING[p])) for p in ("icf", "assent")],
    ))))
    named = _named(_members(files, groups, slots))
    papers = named.select(F.inline(F.array_compact(F.array(*[
        F.when(F.col("kind") == f"duplicate-{p}", _guard(f"duplicate-{p}", F.col("who"), F.format_string(DETAIL_DUPLICATE[p], F.col("names"))))
        for p in ("icf", "assent")
    ]))))
    contested = _classed(slots).join(by_merge(named.filter("kind = 'ambiguous-slot'").select(*_SLOT, "names")), _SLOT)
    detail = F.format_string(DETAIL_AMBIGUOUS, F.col("names"), F.col("want_expr"))
    videos = contested.select(F.inline(F.array(_guard("ambiguous-slot", F.concat("who", F.lit(" · "), "want_env"), detail))))
    return plain.unionByName(papers).unionByName(videos)


# ---- what the plan amounts to -----------------------------------------------------------------------------------------

def planned_files(plan: DataFrame) -> DataFrame:
    """Distinct files the plan links to."""
    return plan.select(F.explode(F.array_compact(F.array("video", "icf", "assent"))).alias("_f")).groupBy(
        F.col("_f.path").alias("path")
    ).agg(F.min("_f").alias("_f")).select("_f.*")


def plan_metrics(plan: DataFrame, guards: DataFrame) -> DataFrame:
    """One row of counts."""
    statuses = {
        "rows_filled": "filled", "rows_awaiting_link": "awaiting-link", "rows_review": "review",
        "rows_missing": "missing", "rows_skipped": "skipped",
    }
    by_status = plan.agg(*[F.count_if(F.col("status") == s).alias(c) for c, s in statuses.items()]).withColumn(
        "rows_matched", F.col("rows_filled") + F.col("rows_awaiting_link")
    )
    links = planned_files(plan).agg(
        F.count(F.lit(1)).alias("files_matched"),
        F.count_if("link_existed").alias("links_reused"),
        F.count_if(~F.col("link_existed")).alias("links_to_create"),
    ).withColumn("links_resolved", F.col("links_reused") + F.col("links_to_create"))
    n = guards.agg(F.count(F.lit(1)).alias("guard_count"))
    one = F.lit(1).alias("_one")
    parts = [d.select("*", one) for d in (by_status, links, n)]
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").drop("_one")


def links_to_create(plan: DataFrame) -> DataFrame:
    """Distinct planned files that have no shared link yet."""
    return planned_files(plan).filter(~F.col("link_existed"))


def write_links(plan: DataFrame, mode: str = "strict") -> DataFrame:
    """Put the links into video_url, icf_url and assent_url; no other column changes but an empty recording date.

    ``strict`` writes rows that are filled, and nothing else.  ``cellwise`` writes every link that exists, and dates a
    row by its video where the sheet gave no date.
    """
    def link(kind: str) -> Column:
        return tx.null_if_empty(F.col(kind).link)

    targets = {"video_url": "video", "icf_url": "icf", "assent_url": "assent"}
    if mode == "strict":
        filled = F.col("status") == "filled"
        return plan.withColumns({c: F.when(filled, link(k)).otherwise(F.col(c)) for c, k in targets.items()})
    stamp = F.col("video.recorded_at").cast("string")
    written = {c: F.coalesce(link(k), F.col(c)) for c, k in targets.items()}
    return plan.withColumns({**written, "recorded_at": F.coalesce(tx.null_if_empty(F.col("recorded_at")), stamp)})
