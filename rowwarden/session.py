"""Session settings the library expects, and intermediate results written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Has a query's shuffle files deleted when the query has ended.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "rowwarden", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local session without one gets a folder of its own; a cluster without one is an error, because a folder on one
    machine does not survive its loss.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="rowwarden-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Have a folder of intermediate results deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is to be shuffled, for tables that grow with the data.

    AQE measures compressed bytes; a table of a few MB of those takes hundreds in the driver when it is broadcast, and a plan
    with ten such joins broadcasts several at once.  A merge join still has its skewed partitions split.
    """
    return df.hint("merge")


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, for results that several later steps read.

    Readers prune columns and push filters down, and a lost executor costs no recomputation.  ``by`` names a column of few
    values; there is a folder for each, and readers that ask for some of them list only those.  What was shuffled to write it is
    deleted once it is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        if by is None:
            df.write.parquet(folder)
        else:
            df.repartition(by).write.partitionBy(by).parquet(folder)
    finally:
        spark.conf.unset(_SHUFFLES_END) if before is None else spark.conf.set(_SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(folder).select(*df.columns)


def dropped(*tables: DataFrame) -> None:
    """Delete what ``staged`` wrote for tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
