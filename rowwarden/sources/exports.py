"""Exports that are whole or not there: files are staged, listed in a manifest, and become valid with it.

An export is a folder that holds ``manifest.json`` and the data folder it names.  Tasks write to a new data folder; only when
all have committed is the manifest of that folder put in place of the one before, by a rename.  A reader looks at the
manifest first, so a run that is lost half-way leaves the last whole export as it was, and the data folder it began is
removed by the next run.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest.json"
_CSV = {"header": "true", "quoteAll": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "", "multiLine": "true",
        "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
FORMATS = {"parquet": {}, "csv": _CSV}
# A file of quoted line feeds can't be split, so one task reads it whole: no file is longer.
CSV_ROWS = 200_000


@dataclass(frozen=True)
class Manifest:
    """What an export consists of."""

    data: str
    format: str
    columns: list[str]
    types: list[str]
    rows: int
    files: dict[str, int]


class _Store:
    """The few things needed of the file system a folder lies in, whichever one Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str):
        at = self.root
        for name in names:
            at = self.jvm.org.apache.hadoop.fs.Path(at, name)
        return at

    def names(self, *names: str) -> dict[str, tuple[bool, int]]:
        """Of everything directly in a folder: whether it is a folder, and its size."""
        at = self.path(*names)
        return {s.getPath().getName(): (s.isDirectory(), s.getLen()) for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def read(self, name: str) -> str | None:
        at = self.path(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file beside its place and rename it, so that it is never seen half written."""
        draft, at = self.path(f".{name}-{uuid.uuid4().hex}"), self.path(name)
        stream = self.fs.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(rename, 0, options.Rename.OVERWRITE)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.fs.getConf())
        context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(at), rename)

    def remove(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)


def read_manifest(spark: SparkSession, folder: str) -> Manifest | None:
    """The manifest of the last whole export to ``folder``; None where there is none."""
    text = _Store(spark, folder).read(MANIFEST)
    return None if text is None else Manifest(**json.loads(text))


def _as_text(kind: T.DataType, column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS") if isinstance(kind, T.TimestampType) else column.cast("string")


def export_table(df: DataFrame, folder: str, format: str = "parquet") -> Manifest:
    """Write a table with exactly its columns and headers; the export before stays valid until this one is whole.

    ``csv`` holds every value as text, quoted, a null as ``\\N``, so that an empty text, line feeds and leading zeros survive.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    spark, store = df.sparkSession, _Store(df.sparkSession, folder)
    before = read_manifest(spark, folder)
    for name, (is_folder, _) in store.names().items():      # what runs that were lost have left
        if is_folder and name.startswith("data-") and (before is None or name != before.data):
            store.remove(name)
    data = f"data-{uuid.uuid4().hex}"
    fields = df.schema.fields
    written = df if format != "csv" else df.select(*[_as_text(f.dataType, df[_quoted(f.name)]).alias(f.name) for f in fields])
    longest = {"maxRecordsPerFile": CSV_ROWS} if format == "csv" else {}
    written.write.format(format).options(**FORMATS[format], **longest).save(f"{folder}/{data}")
    listed = store.names(data)
    if "_SUCCESS" not in listed:
        raise RuntimeError(f"the files in {folder}/{data} were not committed")
    files = {n: size for n, (_, size) in sorted(listed.items()) if not n.startswith(("_", "."))}
    names, kinds = [f.name for f in fields], [f.dataType.simpleString() for f in fields]
    rows = _load(spark, folder, data, format, df.schema, files).count()
    made = Manifest(data, format, names, kinds, rows, files)
    store.put(MANIFEST, json.dumps(made.__dict__, ensure_ascii=False, indent=1))
    if before is not None:
        store.remove(before.data)
    return made


def _quoted(name: str) -> str:
    return f"`{name}`"


def _load(spark: SparkSession, folder: str, data: str, format: str, schema: T.StructType, files: dict[str, int]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    read = spark.read.schema(text if format == "csv" else schema).format(format).options(**FORMATS[format])
    loaded = read.load([f"{folder}/{data}/{name}" for name in files])
    return loaded if format != "csv" else loaded.select(*[loaded[_quoted(f.name)].cast(f.dataType).alias(f.name) for f in schema.fields])


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last whole export: of the files its manifest lists, all of them and no others."""
    made = read_manifest(spark, folder)
    if made is None:
        raise FileNotFoundError(f"{folder} holds no whole export")
    there = _Store(spark, folder).names(made.data)
    lost = [n for n, size in made.files.items() if there.get(n, (False, -1))[1] != size]
    if lost:
        raise RuntimeError(f"{folder} has lost or changed {len(lost)} file(s) of its export, the first of them {lost[0]}")
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(made.columns, made.types, strict=True)])
    return _load(spark, folder, made.data, made.format, schema, made.files)
