"""Session builder and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` where it is set.

    Only a local session may fall back to a temporary folder of this machine; on a cluster a
    missing setting is an error, as other machines could not read what is written here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """Name of a new folder in the shared folder, deleted when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives a lost executor.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`written` made and nothing reads any more; other tables are left alone."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it would come in fewer partitions than there are cores.

    A table of one small file is read by one task, and all that follows would run there. Larger
    inputs have at least as many partitions as cores and are left as they are, without a shuffle; so
    is what comes out of a shuffle, whose partitions could only be counted by running it.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or "Exchange" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
