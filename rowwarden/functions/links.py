"""Folder addresses and shared links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowwarden.functions import text as tx

# --- fixed values: patterns and reasons ----------------------------------------------------------------------------
_SHARE_LINK = r"(?i)/scl/fo/|/sh/"
_WEB = r"(?i)^https?://"
_HOST = r"^(?:https?)://(?:[^/?#@]*@)?([^/?#:]*)"
_STORAGE_HOST = r"(?i)(^|\.)dropbox\.com\z"
REASON_SHARE = "Share links can't be listed. Use the folder's path, e.g. /Team Folder/Agency Collection/…"
REASON_INVALID = "Not a valid URL or folder path."
REASON_HOST = "Not a Dropbox URL."
REASON_EMPTY = "No folder path found in that link."


def normalize_shared_link(url: Column) -> Column:
    """The durable form of a link: ``rlkey`` kept, ``dl=0`` forced, every other parameter dropped.

    Anything that is not a web address is returned trimmed; NULL and blank give an empty string.
    """
    return tx.let(tx.trim_ws(F.coalesce(url, F.lit(""))), _durable)


def _durable(link: Column) -> Column:
    origin = F.lower(F.regexp_extract(link, r"(?i)^https?://[^/?#]+", 0))
    path = F.regexp_extract(link, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(link, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(link, r"#.*\z", 0)
    raw = F.regexp_extract(query, r"(?:^|&)rlkey=([^&]*)", 1)
    key = F.when(raw.rlike(r"^[A-Za-z0-9_.*\-]*\z"), raw).otherwise(
        F.url_encode(F.coalesce(F.try_url_decode(raw), raw))
    )
    rebuilt = F.concat(
        origin,
        F.when(path == "", "/").otherwise(F.replace(path, F.lit(" "), F.lit("%20"))),
        F.lit("?"),
        F.when(key != "", F.concat(F.lit("rlkey="), key, F.lit("&"))).otherwise(""),
        F.lit("dl=0"),
        fragment,
    )
    return F.when(origin != "", rebuilt).otherwise(link)


def parse_folder_url(raw: Column) -> Column:
    """struct(input, ok, path, reason) of one pasted folder address; NULL for a blank one."""
    return tx.let(tx.trim_ws(raw), _folder_address)


def _folder_address(given: Column) -> Column:
    is_web = given.rlike(_WEB)
    host = F.regexp_extract(F.lower(given), _HOST, 1)
    web_path = F.regexp_replace(F.regexp_extract(given, r"(?i)^https?://[^/?#]*([^?#]*)", 1), r"(?i)^/home", "")
    encoded = F.when(is_web, web_path).otherwise(given)
    # '+' is a plain character in a path, so it is protected from form decoding.
    decoded = F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)
    trimmed = F.regexp_replace(decoded, r"/+\z", "")
    rooted = tx.let(trimmed, lambda p: F.when(p.startswith("/") | (p == ""), p).otherwise(F.concat(F.lit("/"), p)))

    def out(ok: bool, value: Column | None, reason: str) -> Column:
        return F.struct(
            given.alias("input"), F.lit(ok).alias("ok"),
            (F.lit(None) if value is None else value).cast("string").alias("path"), F.lit(reason).alias("reason"),
        )

    return F.when(
        given != "",
        F.when(given.rlike(_SHARE_LINK), out(False, None, REASON_SHARE))
        .when(is_web & (host == ""), out(False, None, REASON_INVALID))
        .when(is_web & ~host.rlike(_STORAGE_HOST), out(False, None, REASON_HOST))
        .otherwise(
            tx.let(rooted, lambda p: F.when(p == "", out(False, None, REASON_EMPTY)).otherwise(out(True, p, "")))
        ),
    )


def parse_folder_urls(text: Column) -> Column:
    """Pasted lines to an array of parsed addresses, blank lines dropped."""
    return F.array_compact(F.transform(F.split(text, r"\r?\n"), parse_folder_url))
