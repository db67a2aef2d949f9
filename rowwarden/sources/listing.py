"""File listings: what is a workbook, what is media, which files are copies, where they stand in the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowwarden.functions import filenames as fn
from rowwarden.functions.links import parse_folder_urls
from rowwarden.operators.spread import ordinal_within, running_offset
from rowwarden.session import staged


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing of a folder: name, path, size, server_modified.  Contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(
            fn.base_name(F.col("path")).alias("name"),
            F.col("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("server_modified"),
        )
    )


def index_files(files: DataFrame, order: str = "path") -> DataFrame:
    """Add ``file_ix``: consecutive numbers in order of ``order``, without passing the listing through one task.

    The listing is range-partitioned and pinned by a checkpoint, so that the partition numbers cannot change.
    """
    ranged = staged(files.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = running_offset(sizes, "_part", "_n", "_base").select("_part", "_base")
    inside = Window.partitionBy("_part").orderBy(order)
    return (
        ranged.join(bases, "_part")
        .withColumn("file_ix", (F.col("_base") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_part", "_base")
    )


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted spreadsheets, rejected files)."""
    accepted = fn.is_accepted_upload(F.col("name"))
    return files.filter(accepted), files.filter(~accepted | F.col("name").isNull())


def drop_repeated_inputs(files: DataFrame) -> DataFrame:
    """Keep the first file, by ``file_ix``, of every (name, length)."""
    rest = [c for c in files.columns if c not in ("name", "length", "file_ix")]
    first = F.min(F.struct("file_ix", *rest)).alias("_first")
    return files.groupBy("name", "length").agg(first).select("name", "length", "_first.*").select(*files.columns)


def split_listing(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata workbooks, media) of a listing; lock files count as media, as every other file does."""
    workbook = fn.is_workbook(F.coalesce(F.col("name"), F.lit("")))
    return files.filter(workbook), files.filter(~workbook)


def expand_folders(requests: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pasted locations (``location``) to workbooks: the file itself, or the workbooks directly inside the folder.

    Returns (workbooks with their ``location``, errors with ``location`` and ``message``).  A place that is pasted more
    than once, with or without closing slashes, is expanded once, under the smallest spelling.
    """
    asked = requests.select("location", F.regexp_replace("location", r"/+\z", "").alias("_at")).groupBy("_at").agg(F.min("location").alias("location"))
    books = listing.filter(fn.is_accepted_upload(F.col("name")))
    parent = F.expr("substring(path, 1, length(path) - length(name) - 1)")
    direct = books.withColumn("_at", F.col("path")).unionByName(books.withColumn("_at", parent))
    found = asked.join(direct, "_at").drop("_at")
    empty = asked.join(found.select("location").distinct(), "location", "left_anti")
    is_file = empty.join(listing.select(F.col("path").alias("_at"), F.col("name")), "_at", "left")
    last = fn.base_name(F.col("_at"))
    message = F.when(
        F.col("name").isNotNull(), F.format_string('"%s" is not an .xlsx or .xlsm file.', F.col("name"))
    ).otherwise(F.format_string('Folder "%s" contains no .xlsx or .xlsm files.', last))
    return found, is_file.select("location", message.alias("message"))


def archive_names(files: DataFrame) -> DataFrame:
    """Add ``archive_name``: the second ``a.xlsx`` in listing order becomes ``a (1).xlsx``."""
    ranked = ordinal_within(files, ["name"], "file_ix", "_seen")
    ext = F.regexp_extract("name", r"(\.[^.]*)\z", 1)  # empty where there is no dot
    stem = F.expr("substring(name, 1, length(name) - length(regexp_extract(name, '([.][^.]*)$', 1)))")
    numbered = F.concat(stem, F.lit(" ("), F.col("_seen").cast("string"), F.lit(")"), ext)
    return ranked.withColumn("archive_name", F.when(F.col("_seen") > 0, numbered).otherwise(F.col("name"))).drop("_seen")


def attach_links(files: DataFrame, links: DataFrame) -> DataFrame:
    """Left-join the first existing shared link per path; ``links`` has (path, url) and optionally ``ord``."""
    rank = F.col("ord") if "ord" in links.columns else F.col("url")
    first = links.groupBy("path").agg(F.min_by("url", rank).alias("link"))
    return files.drop("link").join(first, "path", "left")


def read_folder_requests(pasted: DataFrame, column: str) -> DataFrame:
    """Pasted multi-line text to one row per address: input, ok, path, reason."""
    return pasted.select(F.explode(parse_folder_urls(F.col(column))).alias("_u")).select("_u.*")


def valid_roots(requests: DataFrame) -> DataFrame:
    return requests.filter("ok").select("path").distinct()
