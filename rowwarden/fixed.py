"""Fixed values.

Everything in this module is a constant of the domain (column layouts, header spellings, word lists, thresholds,
rule names, message formats).  They are part of the results, so they are stated once, in natural order.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# --- fixed values: whitespace and zero-width characters ------------------------------------------------------------
# Written with \x{..} so that both Java regular expressions and RE2 accept them.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_OTHER_THAN_SPACE = (
    r"[\t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"

# --- fixed values: the 21-column submission layout, in order (field, header) ---------------------------------------
CANONICAL_COLUMNS = (
    ("participant_name", "Participant Name As Per ICF"),
    ("participant_email", "Participant Email"),
    ("guardian_name", "Name of Parents/Legal Guardian"),
    ("guardian_email", "Email of Parents/Legal Guardian"),
    ("expression", "Expressions"),
    ("non_neutral", "For Non Neutral, Please Select"),
    ("age_group", "Age Group"),
    ("birthdate", "Birthdate"),
    ("gender", "Gender"),
    ("main_ethnicity", "Main Ethnicity"),
    ("secondary_ethnicity", "Secondary Ethnicity"),
    ("environment", "Environment"),
    ("head_and_hair", "Head and Hair"),
    ("facial_features", "Facial Features"),
    ("accessories", "Accessories and jewellery"),
    ("others", "Others"),
    ("none_apply", "None"),
    ("skintone", "Skintone"),
    ("device", "Device"),
    ("country", "Country of Collection"),
    ("state", "State Abbreviation"),
)

# --- fixed values: other spellings of submission headers, as header keys -> field ----------------------------------
CANONICAL_ALIASES = {
    "dob": "birthdate",
    "dateofbirth": "birthdate",
    "birthday": "birthdate",
    "accessoriesandjewelry": "accessories",
    "accessoriesjewellery": "accessories",
    "accessoriesjewelry": "accessories",
    "participantnameasperlcf": "participant_name",
    "nameofparentlegalguardian": "guardian_name",
    "emailofparentlegalguardian": "guardian_email",
    "stateabbrev": "state",
    "stateabbreviations": "state",
    "countryofcollections": "country",
}

# --- fixed values: the 30-column delivery layout, in order (field, header) -----------------------------------------
DELIVERY_COLUMNS = (
    ("participant_sequence", "participant_sequence"),
    ("qa_result", "QA Result"),
    ("comments", "Comments"),
    ("folder_name", "Dropbox Folder Name"),
    ("video_url", "Dropbox URL"),
    ("participant_name", "Participant Name As Per ICF"),
    ("participant_email", "Participant Email"),
    ("guardian_name", "Name of Parents/Legal Guardian"),
    ("guardian_email", "Email of Parents/Legal Guardian"),
    ("expression", "Expressions"),
    ("non_neutral", "For Non Neutral, Please Select"),
    ("age_group", "Age Group"),
    ("birthdate", "Birthdate"),
    ("gender", "Gender"),
    ("main_ethnicity", "Main Ethnicity"),
    ("secondary_ethnicity", "Secondary Ethnicity"),
    ("environment", "Environment"),
    ("head_and_hair", "Head and Hair"),
    ("facial_features", " Facial Features"),
    ("accessories", "Accessories and jewellery"),
    ("others", "Others"),
    ("none_apply", "None"),
    ("skintone", "Skintone"),
    ("device", "Device"),
    ("device_model", "Specific Device Model"),
    ("recorded_at", "Date of Recording"),
    ("country", "Country of Collection"),
    ("state", "State Abbreviation"),
    ("icf_url", "ICF URL"),
    ("assent_url", "Assent URL"),
)

# --- fixed values: delivery header spellings per field -------------------------------------------------------------
DELIVERY_SPELLINGS = {
    "participant_name": ("participant name as per icf", "participant name", "name as per icf"),
    "participant_email": ("participant email",),
    "guardian_name": ("name of parents legal guardian", "guardian name"),
    "guardian_email": ("email of parents legal guardian", "guardian email"),
    "expression": ("expressions", "expression"),
    "non_neutral": ("for non neutral please select", "non neutral"),
    "age_group": ("age group",),
    "birthdate": ("birthdate", "birth date", "date of birth"),
    "gender": ("gender",),
    "main_ethnicity": ("main ethnicity",),
    "secondary_ethnicity": ("secondary ethnicity",),
    "environment": ("environment",),
    "skintone": ("skintone", "skin tone"),
    "device": ("device",),
    "device_model": ("specific device model", "device model"),
    "recorded_at": ("date of recording", "recording date"),
    "country": ("country of collection", "country"),
    "state": ("state abbreviation", "state"),
}
DELIVERY_IGNORED = ("head and hair", "facial features", "accessories and jewellery", "others", "none")

# --- fixed values: controlled vocabulary per attribute field -------------------------------------------------------
VOCABULARY = {
    "head_and_hair": ("Glasses", "Religious headwear", "Hat", "Scarf"),
    "facial_features": ("Mustache", "Beard", "Dimples", "Facial scars", "Facial moles", "Acne", "Face/neck tattoos"),
    "accessories": ("Makeup", "Necklace", "Earrings", "Nose piercing", "Lip piercing", "Eyebrow piercing"),
    "others": ("Freckles", "Wrinkles", "Bindi", "Other tattoos", "Other piercings", "Other - not specified"),
}
ATTRIBUTE_FIELDS = tuple(VOCABULARY)
VOCABULARY_SHEET_HEADERS = ("Head and Hair", "Facial Features ", "Accessories and jewellery", "Others")
NONE_APPLY_TEXT = "N/A-none apply"
MULTI_VALUE_SPLIT = "[;,]"
MULTI_VALUE_JOIN = ", "

# --- fixed values: month spellings ---------------------------------------------------------------------------------
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
EARLIEST_BIRTH_YEAR = 1900

# --- fixed values: thresholds --------------------------------------------------------------------------------------
CANONICAL_SCAN_ROWS = 12
CANONICAL_GOOD_MATCHES = 13
DELIVERY_SCAN_ROWS = 25
DELIVERY_MIN_MATCHES = 3
FUZZY_HEADER_MIN_LENGTH = 6
DIAGNOSIS_HEADERS = 12
ISSUE_PREVIEW_ROWS = 500
PLAN_PREVIEW_ROWS = 300

# --- fixed values: filename words that describe the file, not the expression ----------------------------------------
STRUCTURAL_TOKENS = (
    "indoor", "outdoor", "video", "expression", "expressions", "non", "neutral", "nonneutral",
    "mp4", "mov", "m4v", "avi", "mkv",
)

# --- fixed values: severities and labels ---------------------------------------------------------------------------
SEVERITY_RANK = {"error": 0, "review": 1, "fixed": 2}
SEVERITY_LABEL = {"error": "ERROR", "review": "NEEDS REVIEW", "fixed": "AUTO-FIXED"}
VERDICT_OK, VERDICT_FIXED, VERDICT_REVIEW, VERDICT_ERROR = "OK", "Auto-fixed", "Review", "Error"

# --- fixed values: report headers ----------------------------------------------------------------------------------
QA_REPORT_HEADERS = (
    "Severity", "Source File", "Sheet", "Source Row", "Merged Row", "Column", "Header", "Check",
    "Original Value", "Corrected Value", "Details",
)
DELIVERY_QA_HEADERS = (
    "Severity", "Source file", "Row", "Col", "Header", "Check", "Original", "Corrected", "Details",
)
SOURCES_HEADERS = (
    "Source File", "Origin", "Sheet Used", "Header Row", "Rows Merged", "Merged Rows From", "Merged Rows To", "Status",
)


# --- fixed values: filename rules of the two known naming conventions ----------------------------------------------
@dataclass(frozen=True)
class Preset:
    """How one agency names its files."""

    video_ext: tuple[str, ...] = (".mp4", ".mov")
    icf_match: tuple[str, ...] = ("consent", "icf")
    assent_match: tuple[str, ...] = ("assent",)
    assent_ext: tuple[str, ...] = (".pdf", ".jpg", ".jpeg", ".png")
    neutral_token: str = "neutral"
    fuzzy: bool = True


PRESETS = {"consent_first": Preset(), "icf_first": Preset(icf_match=("icf", "consent"))}


def column_letter(index: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    letters = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """(composed, base) character strings for ``translate``.

    Built from the Unicode data: every BMP character whose canonical decomposition is one base character followed
    only by combining marks U+0300..U+036F.
    """
    composed, base = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        stripped = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F)
        if stripped != char and len(stripped) == 1 and not 0xD800 <= ord(stripped) <= 0xDFFF:
            composed.append(char)
            base.append(stripped)
    return "".join(composed), "".join(base)
