import random

import pytest
from pyspark.sql import functions as F
from test_functions import osa

from rowwarden import fixed
from rowwarden.operators import identity, match, wordfit
from rowwarden.session import staged

PRESET = fixed.PRESETS["consent_first"]
ROOT = "/Lot/One/Batch_5"
LINK = "https://www.dropbox.com/scl/fi/e1/F?rlkey=r1&st=tok&dl=0"
FILES = [
    ("Iris Vale", "IRIS_VALE_INDOOR_NEUTRAL.mp4", LINK), ("Iris Vale", "IRIS_VALE_INDOOR_SMILING.mp4", None),
    ("Iris Vale", "IRIS_VALE_OUTDOOR_NEUTRAL.mp4", None), ("Iris Vale", "IRIS-VALE-CONSENT-FORM.pdf", LINK),
    ("Iris Vale", "IRIS_VALE_ASSENT-FORM.jpg", LINK), ("Iris Vale", "batch_metadata.xlsx", None),
    ("Kit Moor", "KIT_MOOR_INDOOR_SMILING.mp4", None), ("Kit Moor", "KIT_MOOR_INDOOR_FROWNING.mp4", None),
    ("Kit Moor", "KIT-MOOR-CONSENT.pdf", None), ("Kit Moor", "KIT_MOOR_ASSENT.jpg", None),
    ("Ana Bell", "ANA_BELL_OUTDOOR_ANGRY.mp4", None), ("Ana Bell", "ANA-BELL-CONSENT.pdf", None),
    ("Pia Holt", "PIA_HOLT_INDOOR_NEUTRAL.mp4", None), ("Pia Holt", "PIA-HOLT-CONSENT.pdf", None),
    ("Pia Holt", "PIA_HOLT_ASSENT.jpg", None), ("Pia Holtt", "PIA_HOLTT_INDOOR_NEUTRAL.mp4", None),
    ("Pia Holtt", "PIA-HOLTT-CONSENT.pdf", None), ("Pia Holtt", "PIA_HOLTT_ASSENT.jpg", None),
    ("fay Quill", "FAY_QUILL_INDOOR_N3UTRAL.MOV", None), ("fay Quill", "FAY-QUILL-CONSENT.pdf", None),
    ("fay Quill", "FAY_QUILL_ASSENT.png", None), ("Ed Marsh", "ED_MARSH_INDOOR_NEUTRAL.mp4", None),
    ("Ed Marsh", "ICF 1.pdf", None), ("Ed Marsh", "ICF 2.pdf", None), ("Ed Marsh", "ED_MARSH_ASSENT.pdf", None),
    ("B. Stone", "B_STONE_INDOOR_NEUTRAL.mp4", None), ("B. Stone", "B-STONE-CONSENT.pdf", None),
    ("Анна", "INDOOR_NEUTRAL.mp4", None),
]
ROWS = [
    ("Iris Vale", "Neutral", "Indoor", None), ("Iris Vale", "Non-Neutral", "Indoor", "Smiling"),
    ("Iris Vale", "Neutral", "Outdoor", None), ("Kit Moor", "Non-Neutral", "Indoor", None),
    ("Kit Moor", "Non-Neutral", "Indoor", "Frowning"), ("Ana Bell", "Non-Neutral", "Outdoor", "Angry"),
    ("Pia Holt", "Neutral", "Indoor", None), ("Pia Holtt", "Neutral", "Indoor", None),
    ("fay Quill", "Neutral", "Indoor", None), ("Ed Marsh", "Neutral", "Indoor", None),
    ("Борис", "Neutral", "Indoor", None),
]


@pytest.fixture(scope="module")
def scenario(spark):
    files = spark.createDataFrame([(f"{ROOT}/{d}/{n}", n, l) for d, n, l in FILES], "path string, name string, link string")
    rows = spark.createDataFrame(
        [(i + 2, *r, f"u{i}", "old", "old", "old", None) for i, r in enumerate(ROWS)],
        "merged_row bigint, folder_name string, expression string, environment string, non_neutral string, gender string,"
        "video_url string, icf_url string, assent_url string, recorded_at string",
    )
    owned = identity.participant_of_files(files, [ROOT], identity.known_names(rows, "folder_name", "merged_row"))
    media = match.prepare_files(owned, PRESET)
    return rows, media, staged(match.plan_rows(rows, media, PRESET))


def test_outcomes(scenario):
    plan = {r["merged_row"]: r for r in scenario[2].collect()}
    assert {k: (r["status"], r["video_reason"]) for k, r in plan.items()} == {
        2: ("filled", "unique"), 3: ("awaiting-link", "unique"), 4: ("awaiting-link", "unique"), 5: ("review", None),
        6: ("awaiting-link", "column-k"), 7: ("review", "unique"), 8: ("awaiting-link", "unique"),
        9: ("awaiting-link", "unique"), 10: ("awaiting-link", "unique"), 11: ("review", "unique"), 12: ("skipped", None),
    }
    assert [plan[i]["icf_repeat_of"] for i in (2, 3, 4, 6)] == [None, 2, 2, 5]
    assert plan[3]["video"]["name"] == "IRIS_VALE_INDOOR_SMILING.mp4"
    assert plan[6]["video"]["name"] == "KIT_MOOR_INDOOR_FROWNING.mp4"
    assert plan[7]["assent"] is None and plan[11]["icf"] is None
    assert plan[8]["video"]["name"] != plan[9]["video"]["name"]
    assert plan[5]["problems"] == ["2 videos match Indoor / Non-Neutral and column K does not single one out."]
    assert plan[12]["problems"] == ["No scanned folder matches this participant."]


def test_guards_and_metrics(scenario):
    rows, media, plan = scenario
    guards = match.find_guards(media, rows, plan)
    got = sorted((g["kind"], g["who"]) for g in guards.collect())
    assert got == [("ambiguous-slot", "Kit Moor · Indoor"), ("duplicate-icf", "Ed Marsh"), ("missing-assent", "Ana Bell"),
                   ("unmatched-name", 'folder "B. Stone"'), ("unmatched-name", 'folder "Анна"')]
    details = {g["kind"]: g["detail"] for g in guards.collect()}
    assert details["duplicate-icf"] == "Found ICF 1.pdf, ICF 2.pdf. Ambiguous, so AC is held."
    assert details["ambiguous-slot"].startswith("KIT_MOOR_INDOOR_FROWNING.mp4 and KIT_MOOR_INDOOR_SMILING.mp4 both map")
    members = match.guard_members(media, rows, plan)
    assert sorted(m["name"] for m in members.collect()) == [
        "ICF 1.pdf", "ICF 2.pdf", "KIT_MOOR_INDOOR_FROWNING.mp4", "KIT_MOOR_INDOOR_SMILING.mp4"]
    m = match.plan_metrics(plan, guards).first()
    assert (m["rows_filled"], m["rows_awaiting_link"], m["rows_matched"], m["rows_review"], m["links_reused"]) == (1, 6, 7, 3, 3)
    assert m["links_to_create"] == match.links_to_create(plan).count() > 0
    assert match.planned_files(plan).filter("name like '%.xlsx'").count() == 0


@pytest.mark.parametrize(("copies", "bits"), [(1, 12), (2, 0), (100, 12), (101, 3), (5000, 12)])
def test_guards_name_every_file(spark, monkeypatch, copies, bits):
    monkeypatch.setattr(match, "NAMES_BITS", bits)
    papers = [f"ICF {i:05d}.pdf" for i in range(copies)]
    videos = [f"INDOOR_WORD{i:05d}A.mp4" for i in range(copies + 1)]
    files = spark.createDataFrame([(f"/r/One Hot/{n}", n, i) for i, n in enumerate([*papers[::-1], *videos, "ASSENT.jpg"])] + [("/r/Two/ICF.pdf", "ICF.pdf", -1)],
                                  "path string, name string, file_ix bigint").repartition(5)
    rows = spark.createDataFrame([(2, "One Hot", "Indoor", "", None), (3, "ONE_HOT", "indoor", "", "nothing like it")],
                                 "merged_row bigint, folder_name string, environment string, expression string, non_neutral string")
    media = match.prepare_files(identity.participant_of_files(files, ["/r"]), PRESET)
    plan = staged(match.plan_rows(rows, media, PRESET))
    guards = {(g["kind"], g["who"]): g["detail"] for g in match.find_guards(media, rows, plan).collect()}
    listed = ", ".join(papers[::-1])
    assert guards.pop(("duplicate-icf", "One Hot"), None) == (f"Found {listed}. Ambiguous, so AC is held." if copies > 1 else None)
    between = " and ".join(videos)
    for place in ("Indoor", "indoor"):
        assert guards.pop(("ambiguous-slot", f"One Hot · {place}")) == f"{between} both map to . Needs column K to pick the row."
    assert set(guards) == {("unmatched-name", 'folder "Two"')}
    members = match.guard_members(media, rows, plan)
    assert members.count() == copies * (copies > 1) + copies + 1 and members.filter("kind = 'ambiguous-slot'").select("name").distinct().count() == copies + 1


def test_writes_touch_only_link_columns(scenario):
    rows, _, plan = scenario
    strict = match.write_links(plan, "strict")
    changed = strict.filter("video_url <> 'old' or icf_url <> 'old' or assent_url <> 'old'").collect()
    assert [(r["merged_row"], r["video_url"]) for r in changed] == [(2, "https://www.dropbox.com/scl/fi/e1/F?rlkey=r1&dl=0")]
    untouched = [c for c in rows.columns if c not in ("video_url", "icf_url", "assent_url")]
    assert strict.select(untouched).exceptAll(rows.select(untouched)).count() == 0
    cellwise = match.write_links(plan, "cellwise").filter("icf_url <> 'old'")
    assert sorted(r["merged_row"] for r in cellwise.collect()) == [2, 3, 4]


@pytest.mark.parametrize("edits", [True, False])
def test_word_fits_like_brute_force(spark, edits):
    draw = random.Random(5)

    def word(n, letters="abcd"):
        return "".join(draw.choices(letters, k=n))

    long = [word(n) for n in (255, 256, 300, 700)]
    tokens = {"two": ["abcd", long[2]], "many": sorted({word(draw.randint(3, 9)) for _ in range(400)}), "few": [word(draw.randint(3, 7)) for _ in range(33)],
              "long": [*long, word(9)], "huge": [f"{word(6, 'abcdefghij')}{i}" for i in range(2500)]}
    wants = {(s, w) for s in ("many", "few", "two") for w in (word(draw.randint(1, 11)) + draw.choice(["", " " + word(4)]) for _ in range(90))}
    for place in (0, 100, 254, 299):
        wants |= {("long", long[2][:place] + "z" + long[2][place + 1:]), ("long", long[2][:place] + "zzz" + long[2][place + 1:]), ("long", "x" + long[1] + "y")}
    wants |= {("long", long[0][:200]), ("long", long[3][::-1]), ("long", f"{long[3]} {long[0]}"), ("two", long[2][1:]), ("two", long[2][3:] + "zzz")}
    wants |= {("huge", draw.choice([t, t[:-1], t[1] + t[0] + t[2:], f"so {t} it is", t[2:5]])) for t in draw.choices(tokens["huge"], k=60)} | {("none", "abcd")}
    wants = sorted(wants)
    files = [(s, t, 1 + i % 3 // 2, 100 * i) for s, held in tokens.items() for i, t in enumerate(held)] + [("few", tokens["few"][0], 1, 99_999)]
    got = {r["at"]: (r["n_hits"], r["hit"]) for r in wordfit.fitting_tokens(
        spark.createDataFrame([(*w, i) for i, w in enumerate(wants)], "slot string, wanted string, at bigint").repartition(3),
        spark.createDataFrame(files, "slot string, token string, n int, fid bigint").repartition(3), ["slot"], "at", edits).collect()}
    for i, (slot, w) in enumerate(wants):
        hits = [(n, fid) for s, t, n, fid in files if s == slot and (t in w or w in t or edits and abs(len(t) - len(w)) <= 2 and osa(t, w) <= 2)]
        assert got.get(i, (0, None)) == (sum(n for n, _ in hits), min((f for _, f in hits), default=None)), (slot, w, got.get(i), hits)


def test_words_meet_few_tokens_of_a_large_slot(spark):
    draw = random.Random(8)
    tokens = sorted({f"w{draw.randrange(16 ** 6):06x}" for _ in range(4000)})
    wants = [f"{t[0]}{t[2]}{t[1]}{t[3:]}" for t in draw.sample(tokens, 100)] * 5
    wanted = spark.createDataFrame([("s", w, i) for i, w in enumerate(wants)], "slot string, wanted string, at bigint")
    held = spark.createDataFrame([("s", t, 1, i) for i, t in enumerate(tokens)], "slot string, token string, n int, fid bigint")
    # All begin alike, and each word is asked for five times.
    assert wordfit.meetings(wanted, held, ["slot"], True).count() < 100 * 100
    assert wordfit.fitting_tokens(wanted, held, ["slot"], "at", True).select("at").distinct().count() == len(wants)


def test_other_files_do_not_change_a_hit(spark):
    """A word's hits are the same beside two tokens and beside thousands."""
    rows = spark.createDataFrame([(2, "Ann", "", "", "smilling"), (3, "Ann", "", "", "q" * 300)],
                                 "merged_row bigint, folder_name string, environment string, expression string, non_neutral string")
    picked = set()
    for others in (1, 32, 33, 3000):
        names = ["ANN_SMILING.mp4", f"ANN_{'q' * 299}Z.mp4", *[f"ANN_OTHER{i:06d}X.mp4" for i in range(others)]]
        files = spark.createDataFrame([(f"/r/Ann/{n}", n) for n in names], "path string, name string")
        media = match.prepare_files(identity.participant_of_files(files, ["/r"]), PRESET)
        picked.add(tuple(r["video"]["name"] for r in match.plan_rows(rows, media, PRESET).orderBy("merged_row").collect()))
    assert picked == {("ANN_SMILING.mp4", f"ANN_{'q' * 299}Z.mp4")}


def test_names_in_file_names_like_brute_force(spark):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(2, 6))).strip() or "a" for _ in range(25)})
    rnd.shuffle(names)
    texts = ["".join(rnd.choice("abc ") for _ in range(14)).strip() for _ in range(120)] + ["zzz", ""]
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "known string, first_seen bigint")
    files = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, base string")
    got = {r["path"]: r["known"] for r in identity.match_known_names(files, known, "path", "base").collect()}
    for i, t in enumerate(texts):
        scored = [((1000 if t.startswith(n) else 0) + len(n), -at, n) for at, n in enumerate(names) if n in t]
        assert got.get(f"p{i}") == (max(scored)[2] if scored else None), t


def test_few_pieces_that_are_no_names_are_looked_up(spark):
    rnd = random.Random(2)
    names = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10 ** 6)} {rnd.choice('klmnop')}{rnd.randrange(1000)}" for _ in range(3000)]
    texts = [f"take of {n} outdoor" if i % 3 else f"nothing known {i}" for i, n in enumerate(names)]
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "known string, first_seen bigint").dropDuplicates(["known"])
    files = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)] + [("none", None), ("", "")], "path string, base string")
    pieces = identity.name_pieces(files, known, "path", "base")
    assert pieces.join(known, "known").count() >= 2000 and pieces.count() <= 2 * pieces.join(known, "known").count()
    assert identity.match_known_names(files, known.limit(0), "path", "base").count() == 0
    assert identity.match_known_names(files.limit(0), known, "path", "base").count() == 0


def test_identity(spark):
    known = spark.createDataFrame([("Pia Holt", 1), ("Pia Holtt", 2), ("Dov", 3), ("Dov Lee", 4), ("Chloe Marat", 5), ("Holt", 6)],
                                  "folder_name string, at bigint")
    names = identity.known_names(known, "folder_name", "at")
    cases = {"Iris Vale/A_INDOOR.mp4": "iris vale", "PIA-HOLTT_INDOOR_NEUTRAL.mp4": "pia holtt",
             "Dov Lee – Indoor.mp4": "dov lee", "Chloé Marát – Outdoor.mp4": "chloe marat", "readme.txt": None,
             "PIA HOLT_INDOOR.mp4": "pia holt", "take of dov.mp4": "dov"}
    files = spark.createDataFrame([(f"{ROOT}/{p}", p.split("/")[-1]) for p in cases], "path string, name string")
    owned = identity.participant_of_files(files, [ROOT.upper() + "/"], names)
    assert {r["path"][len(ROOT) + 1:]: r["name_key"] for r in owned.collect()} == cases
    strict = identity.participant_of_files(files, [ROOT], names, strict_reference=True)
    assert strict.filter("name_key = 'lot'").count() == 1


def test_no_table_of_the_plan_is_broadcast(spark):
    # Through the driver, tables that grow with the files fill it: AQE goes by compressed bytes, which these few rows have little of.
    files = spark.createDataFrame([(f"/r/Cast {i}/INDOOR_{w}.mp4", f"INDOOR_{w}.mp4") for i in range(3) for w in ("GRIN", "FROWN")], "path string, name string")
    rows = spark.createDataFrame([(i + 2, f"cast {i}", "Indoor", "", "grin") for i in range(3)],
                                 "merged_row bigint, folder_name string, environment string, expression string, non_neutral string")
    media = match.prepare_files(identity.participant_of_files(files, ["/r"]), PRESET)
    facts = match.media_facts(media)
    plan = match.plan_rows(rows, media, PRESET, facts=facts)
    groups = match.group_files(media, facts)
    assert [r["video"]["name"] for r in plan.collect()] == ["INDOOR_GRIN.mp4"] * 3 and groups.count() == 3
    for df in (plan, groups, match.unmatched_groups(groups, rows)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_listing_is_dealt_out_before_names_are_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(match, "staged", lambda df: written.append(df) or df)
    files = spark.createDataFrame([(f"/r/A/{n}.mp4", f"{n}.mp4", "A", "a") for n in "cab"], "path string, name string, folder string, name_key string")
    got = match.prepare_files(files, PRESET).orderBy("fid").collect()
    assert [r["name"] for r in got] == ["a.mp4", "b.mp4", "c.mp4"]
    below = written[0]._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "RLIKE" not in below


def test_the_name_filter_meets_batches_of_texts(spark):
    names = spark.createDataFrame([("ann lee", 1), ("bo", 2)], "known string, first_seen long")
    files = spark.createDataFrame([(i, f"take {i} of ann lee") for i in range(3000)] + [(9000, None), (None, "bo")], "id long, base string").coalesce(1)
    pieces = identity.name_pieces(files, names, "id", "base")
    found = {(r["id"], r["known"]) for r in pieces.collect()}
    assert {(i, "ann lee") for i in range(3000)} <= found and (None, "bo") in found
    met = pieces._jdf.queryExecution().analyzed().toString()
    assert " AS texts#" in met


def test_words_of_a_small_slot_are_not_cut_to_pieces(spark):
    wants = spark.createDataFrame([("s", "grinn", 0), ("s", "zzzzzzzz", 1)], "slot string, wanted string, at bigint")
    tokens = spark.createDataFrame([("s", t, 1, i) for i, t in enumerate(("grin", "frown", "grim"))], "slot string, token string, n int, fid bigint")
    found = wordfit.fitting_tokens(wants, tokens, ["slot"], "at", True)
    assert [tuple(r) for r in found.collect()] == [(0, 2, 0)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_large_slots_in_rounds_like_brute_force(spark, monkeypatch):
    for name, value in (("FEW", 3), ("TOKENS_AT_ONCE", 40), ("ROUNDS", 4)):
        monkeypatch.setattr(wordfit, name, value)
    draw = random.Random(6)

    def word():
        return "".join(draw.choices("abc", k=draw.randint(2, 7)))

    tokens = [(s, word(), draw.choice(["x", None]), 1 + i % 2, i) for i, s in enumerate(["hot"] * 120 + ["cold"] * 30 + ["mild"] * 20 + ["few"] * 3)]
    wants = [(draw.choice(["hot", "cold", "mild", "few", "none"]), word(), draw.choice(["", "x"]), i) for i in range(120)]
    got = {r["at"]: (r["n_hits"], r["hit"]) for r in wordfit.fitting_tokens(
        spark.createDataFrame(wants, "slot string, wanted string, place string, at bigint"),
        spark.createDataFrame(tokens, "slot string, token string, env string, n int, fid bigint"), ["slot"], "at", True, ["env"],
        F.expr("place = '' or env is null")).collect()}
    for slot, w, place, at in wants:
        hits = [(n, fid) for s, t, env, n, fid in tokens if s == slot and (place == "" or env is None) and (t in w or w in t or osa(t, w) <= 2)]
        assert got.get(at, (0, None)) == (sum(n for n, _ in hits), min((f for _, f in hits), default=None)), (slot, w)


def test_videos_are_not_copied_for_every_slot(scenario, monkeypatch):
    rows, media, plan = scenario
    written = []
    monkeypatch.setattr(match, "staged", lambda df: written.append(df._jdf.queryExecution().analyzed().toString()) or staged(df))
    members = match.guard_members(media, rows, match.plan_rows(rows, media, PRESET))
    assert sorted(m["name"] for m in members.collect()) == [
        "ICF 1.pdf", "ICF 2.pdf", "KIT_MOOR_INDOOR_FROWNING.mp4", "KIT_MOOR_INDOOR_SMILING.mp4"]
    assert not any("explode(" in p for p in [*written, members._jdf.queryExecution().analyzed().toString()])
