import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import dates, distance, filenames, links, vocab
from rowwarden.functions import text as tx

X = F.col("x")
PRESET = fixed.PRESETS["consent_first"]


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + cost)
    return d[-1][-1]


def browser_text(x):
    """What a browser writes for a double, from Python's shortest digits."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    point = len(digits) + exponent
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        text = digits.ljust(point, "0")
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + text


def test_whitespace(values):
    cases = {
        "  IRIS   VALE  ": "IRIS VALE", "a b": "a b", "a​b": "ab", "﻿x": "x", "tab\there": "tab here",
        "ok": "ok", "line\r\nbreak ": "line break", "　wide ": "wide",
    }
    assert values(list(cases), tx.normalize_whitespace(X)) == list(cases.values())
    assert values(["  ", "", None, "​", " a"], tx.tidy_or_null(X)) == [None, None, None, None, "a"]
    assert values([" ", " ", None, "", "a"], tx.is_blank(X)) == [True, True, True, True, False]


def test_keys_and_names(values):
    assert values(["For Non Neutral, Please Select", "D.O.B"], tx.header_key(X)) == ["fornonneutralpleaseselect", "dob"]
    assert values(["Name of Parents/Legal  Guardian"], tx.delivery_header_key(X)) == ["name of parents legal guardian"]
    assert values(["Face/neck  Tattoos!"], tx.vocab_key(X)) == ["face neck tattoos"]
    names = {
        "Iris Vale": "iris vale", "IRIS-VALE": "iris vale", "iris_vale.": "iris vale", "Chloé Marát": "chloe marat",
        "é x": "e x", "Łódź": "odz", "Анна": None, " – ": None,
    }
    assert values(list(names), tx.normalize_name(X)) == list(names.values())


def test_numbers_and_letters(values, spark):
    cases = {1992.0: "1992", 0.5: "0.5", 12345678.5: "12345678.5", -3.0: "-3", 0.0001: "0.0001"}
    cases |= {1.23456789e-5: "0.0000123456789", 1e-13: "1e-13", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", -1e30: "-1e+30"}
    cases |= {1e26: "1e+26", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e15: "1000000000000000", -0.0: "0"}
    cases |= {5e-324: "5e-324", 1.2345678901234567e-30: "1.2345678901234567e-30", 1.7976931348623157e308: "1.7976931348623157e+308"}
    cases |= {0.1 + 0.2: "0.30000000000000004", 2e-323: "2e-323", 1e23: "1e+23", 2.2250738585072014e-308: "2.2250738585072014e-308", 4.35: "4.35"}
    rnd = random.Random(8)
    for _ in range(3000):
        x = rnd.choice([rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-320, 308), rnd.randint(1, 999) * 10.0 ** rnd.randint(-30, 30),
                        struct.unpack("d", rnd.randbytes(8))[0]])
        if math.isfinite(x) and x:
            cases[x] = browser_text(x)
    assert values(list(cases), tx.number_text(X), "double") == list(cases.values())
    columns = [0, 25, 26, 51, 52, 701, 702, 16383]
    assert values(columns, tx.column_letter(X), "int") == [fixed.column_letter(c) for c in columns]
    assert fixed.column_letter(16383) == "XFD"


def test_slash_placeholder(values):
    cases = {"/": True, " / / ": True, "|-/": True, "--": False, "n/a": False, "": False, "\\ /": True}
    assert values(list(cases), tx.is_slash_placeholder(X)) == list(cases.values())


def test_distance_matches_recurrence(spark):
    rnd = random.Random(3)
    pairs = [tuple("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in "ab") for _ in range(600)]
    long = "".join(rnd.choice("ab") for _ in range(70))
    pairs += [(long, long[:30] + "z" + long[32:]), (long, long[:5] + long[6] + long[5] + long[7:]), ("ca", "abc")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    for r in df.withColumn("d", distance.edit_distance(F.col("a"), F.col("b"))).collect():
        assert r["d"] == osa(r["a"], r["b"]), r
    near = df.withColumn("w", distance.within(F.col("a"), F.col("b"), 2)).collect()
    assert all(r["w"] == (osa(r["a"], r["b"]) <= 2) for r in near)


def test_sorted_letters_change_no_verdict(spark):
    rnd = random.Random(4)
    pairs = [tuple("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 8))) for _ in "ab") for _ in range(1500)]
    pairs += [(a, a[1] + a[0] + a[2:-2] + a[-1] + a[-2]) for a, _ in pairs if len(a) > 4]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    letters = tuple(distance.sorted_letters(F.col(c)) for c in "ab")
    for known in (letters, (letters[0], F.lit(None).cast("string"))):
        assert all(r["w"] == (osa(r["a"], r["b"]) <= 2) for r in df.withColumn("w", distance.within(F.col("a"), F.col("b"), 2, known)).collect())


def test_vocabulary(values):
    cases = {
        "facial_features": {"Moustache": ("corrected", "Mustache"), "Face/neck tattoos": ("exact", "Face/neck tattoos"),
                            "face neck tattoos": ("normalized", "Face/neck tattoos"), "Sombrero": ("unknown", None),
                            "Facial scabs": ("corrected", "Facial scars"), "": ("unknown", None)},
        "head_and_hair": {"Glases": ("corrected", "Glasses"), "Ht": ("corrected", "Hat"), "Cat": ("corrected", "Hat")},
        "others": {"Freckels": ("corrected", "Freckles"), "Other tattons": ("corrected", "Other tattoos")},
    }
    for field, terms in cases.items():
        got = values(list(terms), vocab.match_vocabulary(X, fixed.VOCABULARY[field]))
        assert [(g["status"], g["value"]) for g in got] == list(terms.values())
    tied = values(["Bat"], vocab.match_vocabulary(X, ("Hat", "Mat")))
    assert tied[0]["status"] == "ambiguous"
    cells = ["Makeup; Earrings", " ; ", "Makup,Bell", "Makeup"]
    got = values(cells, vocab.cell_value(vocab.cell_outcomes(X, fixed.VOCABULARY["accessories"])))
    assert got == ["Makeup, Earrings", None, "Makeup, Bell", "Makeup"]


BIRTHDATES = {
    "1990/05": ("1990/05", "fixed"), "1988-11": ("1988/11", "fixed"), "07/1992": ("1992/07", "fixed"),
    "1993/4": ("1993/04", "fixed"), "not recorded": (None, "unparseable"), "May 1990": ("1990/05", "fixed"),
    "1990 Sept": ("1990/09", "fixed"), "12 May": ("2012/05", "review"), "12 May 1990": ("1990/05", "fixed"),
    "May 12, 90": ("1990/05", "review"), "13/05/1990": ("1990/05", "fixed"), "05/13/1990": ("1990/05", "fixed"),
    "05/06/1990": ("1990/06", "review"), "5/6/90": ("1990/06", "review"), "5/90": ("1990/05", "review"),
    "Q3 1990": ("1990/03", "fixed"), "1990": (None, "review"), "199005": ("1990/05", "fixed"),
    "19900512": ("1990/05", "fixed"), "1850/03": ("1850/03", "review"), "13/1990": (None, "unparseable"),
    "13/13/1990": (None, "unparseable"), "Foo 1990": (None, "unparseable"), "12 Foo 1990": ("1990/12", "fixed"),
    "2001-01-02 10:11:12": (None, "unparseable"), "  ": (None, "empty"), "2050": (None, "unparseable"),
}


def test_birthdates(values):
    got = values(list(BIRTHDATES), dates.parse_birthdate(X, current_year=2026))
    assert [(g["value"], g["status"]) for g in got] == list(BIRTHDATES.values())
    month_first = values(["05/06/1990"], dates.parse_birthdate(X, current_year=2026, day_first=False))
    assert month_first[0]["value"] == "1990/05"
    numbers = {1990.0: (None, "review"), 199005.0: ("1990/05", "fixed"), 19900512.0: ("1990/05", "fixed"),
               32874.0: ("1990/01", "fixed"), 2050.0: ("1905/08", "fixed"), -4.0: (None, "unparseable")}
    got = values(list(numbers), dates.parse_birthdate(tx.number_text(X), current_year=2026, number=X), "double")
    assert [(g["value"], g["status"]) for g in got] == list(numbers.values())
    stamp = dates.parse_birthdate(F.lit("x"), current_year=2026, timestamp=X.cast("timestamp"))
    assert values(["1991-02-03 00:00:00"], stamp)[0]["value"] == "1991/02"


NAMES = {
    "IRIS-VALE_INDOOR_N3UTRAL.mp4": ("video", "Indoor", "Neutral", "n3utral", True),
    "Chloé Marát – Outdoor Non Neutral Expression.mp4 Frowning": ("video", "Outdoor", "Non-Neutral", "frowning", False),
    "Dov – Indoor Non Neutral Expression Smiling.mp4": ("video", "Indoor", "Non-Neutral", "smiling", False),
    "Dov Lee – Indoor Non Neutral Expression Smiling,mp4": ("video", "Indoor", "Non-Neutral", "smiling", False),
    "T Q Osk - Indoor NonNeutral angry.mp4": ("video", "Indoor", "Non-Neutral", "angry", False),
    "Kit Non-Neutral smile.mp4": ("video", None, "Non-Neutral", "smile", False),
    "Kit Non N3UTRAL smile.mp4": ("video", None, "Non-Neutral", "smile", False),
    "X_INDOOR_NEUTRAL.MOV": ("video", "Indoor", "Neutral", "neutral", False),
}


def test_file_names(values):
    kinds = {"IRIS-VALE-CONSENT-FORM.pdf": "icf", "Kit Moor – ICF.pdf": "icf", "IRIS_VALE_ASSENT-FORM.jpg": "assent",
             "batch_metadata.xlsx": "other", "assent.docx": "other", "clip.mp4x": "other"}
    assert values(list(kinds), filenames.classify_file(X, PRESET)) == list(kinds.values())
    for name, (kind, place, expression, token, fuzzy) in NAMES.items():
        got = values([name], F.struct(
            filenames.classify_file(X, PRESET).alias("k"), filenames.derive_environment(X).alias("e"),
            filenames.derive_expression(X, PRESET).alias("r"),
        ))[0]
        assert (got["k"], got["e"], *got["r"].values()) == (kind, place, expression, token, fuzzy)
    books = {"Batch.xlsx": True, "Batch.XLSM": True, "~$Batch.xlsx": False, "X.mp4": False, "a.xls": False}
    assert values(list(books), filenames.is_workbook(X)) == list(books.values())


def test_folders(values):
    paths = ["/Lot/One/Iris/a.mp4", "/lot/one/b.mp4", "/Else/c/d.mp4"]
    assert values(paths, filenames.folder_of(X, ["/Lot/One/"])) == ["Iris", "", ""]
    assert values(paths, filenames.participant_folder_of(X, "/Lot/One")) == ["Iris", "", "Else"]
    assert values(["/Lot/One/Iris/Day 1/a.mp4"], filenames.candidate_keys(X, ["/Lot/One"])) == [["iris", "day 1"]]


def test_links(values):
    cases = {
        "https://www.dropbox.com/scl/fi/q/F.mp4?rlkey=K&st=E&dl=0": "https://www.dropbox.com/scl/fi/q/F.mp4?rlkey=K&dl=0",
        "https://www.dropbox.com/scl/fi/q/F.mp4?dl=1": "https://www.dropbox.com/scl/fi/q/F.mp4?dl=0",
        "plain": "plain", "": "",
    }
    assert values(list(cases), links.normalize_shared_link(X)) == list(cases.values())
    folders = {
        "https://www.dropbox.com/home/Team%20Folder/Batch_5_July%2029th": (True, "/Team Folder/Batch_5_July 29th"),
        "https://www.dropbox.com/scl/fo/9xk2/x": (False, None), "/Lot/Two/2026": (True, "/Lot/Two/2026"),
        "/a/b/": (True, "/a/b"), "https://example.com/home/x": (False, None), "/a%zz": (True, "/a%zz"),
        "https://www.dropbox.com/home": (False, None),
    }
    got = values(list(folders), links.parse_folder_url(X))
    assert [(g["ok"], g["path"]) for g in got] == list(folders.values())
    many = values(["/a\r\n\r\n/b/"], F.transform(links.parse_folder_urls(X), lambda u: u.path))
    assert many == [["/a", "/b"]]


@pytest.mark.parametrize("limit", [4, 5, 8, 9])
def test_max_edits(values, limit):
    assert values([limit], distance.max_edits(X), "int") == [1 if limit < 5 else 2 if limit < 9 else 3]
