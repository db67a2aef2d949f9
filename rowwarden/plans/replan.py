"""Bringing a plan up to date once more links exist, without planning everybody again.

Rows, files and plan are kept in parts by participant.  New links touch some files; only the parts of the participants those
files belong to are read, and only these participants are planned again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.fixed import Preset
from rowwarden.functions import text as tx
from rowwarden.functions.links import normalize_shared_link
from rowwarden.operators import match
from rowwarden.session import by_merge, staged

PARTS = 64


@dataclass(frozen=True)
class Kept:
    """What planning again needs: rows, classified files and their plan, each by parts of participants."""

    rows: DataFrame
    files: DataFrame
    plan: DataFrame
    parts: int


@dataclass(frozen=True)
class Replanned:
    """``delta``: the rows planned again; ``plan``: all rows, the others as they were; ``files`` with the new links."""

    delta: DataFrame
    plan: DataFrame
    files: DataFrame


def _part(name_key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(name_key, F.lit(""))), F.lit(parts)).cast("int")


def keep(rows: DataFrame, files: DataFrame, plan: DataFrame, parts: int = PARTS) -> Kept:
    """Write rows, files (``match.prepare_files``) and plan (``match.plan_rows``) in ``parts`` parts by participant."""
    owners = rows.withColumn("name_key", tx.normalize_name(F.col("folder_name")))
    return Kept(*(staged(d.withColumn("_part", _part(F.col("name_key"), parts)), by="_part") for d in (owners, files, plan)), parts)


def changed_files(files: DataFrame, links: DataFrame) -> DataFrame:
    """(path, link) of the files whose link differs from the one they had; ``links`` has path and url."""
    wanted = links.groupBy("path").agg(F.min("url").alias("url")).select("path", normalize_shared_link(F.col("url")).alias("_link"))
    return files.join(by_merge(wanted), "path").filter(F.col("_link") != F.col("link")).select("path", "name_key", F.col("_link").alias("link"))


def replan(kept: Kept, links: DataFrame, preset: Preset, position: str = "merged_row") -> Replanned:
    """Plan again the participants whose files have new links; the result equals planning everybody again.

    ``links`` need hold new links only.  The parts to read are at most ``kept.parts`` numbers; with them the stored rows,
    files and plan are pruned to the folders of those parts.
    """
    changed = staged(changed_files(kept.files, links))
    people = changed.select("name_key").filter(F.col("name_key").isNotNull()).distinct()
    parts = sorted(r["_part"] for r in people.select(_part(F.col("name_key"), kept.parts).alias("_part")).distinct().collect())
    here = F.col("_part").isin(parts) if parts else F.lit(False)

    def touched(table: DataFrame, how: str) -> DataFrame:
        return table.filter(here).join(by_merge(people), "name_key", how)

    new = changed.select("path", F.col("link").alias("_link"))

    def linked(files: DataFrame) -> DataFrame:
        found = files.join(by_merge(new), "path", "left")
        given = F.col("_link").isNotNull()
        return found.withColumns({"link": F.coalesce("_link", "link"), "link_existed": F.col("link_existed") | given}).drop("_link").select(*files.columns)

    files = staged(linked(touched(kept.files, "left_semi").select(*kept.files.columns)))
    rows = touched(kept.rows, "left_semi")
    columns = [c for c in kept.plan.columns if c != "_part"]
    delta = staged(match.plan_rows(rows.drop("_part", "name_key"), files.drop("_part"), preset, position).select(*columns))
    rest = kept.plan.filter(~here).unionByName(touched(kept.plan, "left_anti").select(*kept.plan.columns)).select(*columns)
    others = kept.files.filter(~here).unionByName(touched(kept.files, "left_anti").select(*kept.files.columns))
    return Replanned(delta, rest.unionByName(delta), others.unionByName(files).drop("_part"))
