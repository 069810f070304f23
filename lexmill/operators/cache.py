"""Key-value tables: last write wins, merge, expiry, lookup, statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces of the programs' caches.
NAMESPACES = ("phrases", "extraction", "verdicts", "separable", "difficulty", "synonyms", "selection", "dictionary", "base_forms", "roots")

SCHEMA = "namespace string, key string, value_json string, created_at timestamp"


def latest(kv: DataFrame) -> DataFrame:
    """One row for each namespace and key: the last written, of ties the largest value; reduced before the shuffle."""
    newest = F.max(F.struct("created_at", "value_json"))
    return kv.groupBy("namespace", "key").agg(newest.alias("_n")).select("namespace", "key", "_n.value_json", "_n.created_at")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """All keys of both; where both have one, the new table's."""
    rows = latest(old).withColumn("_o", F.lit(0)).unionByName(latest(new).withColumn("_o", F.lit(1)))
    best = F.max(F.struct("_o", "created_at", "value_json"))
    return rows.groupBy("namespace", "key").agg(best.alias("_b")).select("namespace", "key", "_b.value_json", "_b.created_at")


def unexpired(kv: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return kv.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def clear(kv: DataFrame, namespace: str | None = None, prefix: str = "") -> DataFrame:
    """What stays after one namespace, or keys with a prefix, are cleared."""
    gone = F.col("key").startswith(prefix)
    return kv.filter(~(gone & (F.col("namespace") == namespace) if namespace is not None else gone))


def lookup(requests: DataFrame, kv: DataFrame, namespace: str, key_col: str = "key") -> DataFrame:
    """Requests with ``cached`` (null where there is none)."""
    stored = latest(kv.filter(F.col("namespace") == namespace)).select(F.col("key").alias("_k"), F.col("value_json").alias("cached"))
    return requests.join(stored, F.col(key_col) == F.col("_k"), "left").drop("_k")


def stats(kv: DataFrame) -> DataFrame:
    """(namespace, n_rows, n_keys, n_chars)."""
    one = kv.groupBy("namespace", "key").agg(F.count("*").alias("n"), F.sum(F.length("value_json")).alias("c"))
    return one.groupBy("namespace").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum("c").alias("n_chars"))


def accepted(kv: DataFrame, more_than: int = 15_000) -> bool:
    """Whether a master table is large enough to be used."""
    return kv.limit(more_than + 1).count() > more_than


def file_name(app: str, kind: str, identifier: str = "") -> str:
    """Name of a cache file: the application, the kind and the first eight digits of the identifier's md5."""
    return f"{app}_{kind}_{hashlib.md5(identifier.encode()).hexdigest()[:8]}.json" if identifier else f"{app}_{kind}.json"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at ``path``, empty where there is none; see :func:`latest` for one row of each key."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def save(kv: DataFrame, path: str) -> None:
    """Append rows to the cache table at ``path``, a folder for each namespace; written twice they change nothing, as the last of each key holds."""
    kv.select("namespace", "key", "value_json", "created_at").write.mode("append").partitionBy("namespace").parquet(path)


def compacted(kv: DataFrame, path: str) -> None:
    """Write a new cache table with one row for each key."""
    latest(kv).write.mode("errorifexists").partitionBy("namespace").parquet(path)


def usage(log: DataFrame) -> DataFrame:
    """(namespace, n_calls, n_hits, hit_rate) of a log with (namespace, hit)."""
    one = log.groupBy("namespace").agg(F.count("*").alias("n_calls"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_hits"))
    return one.withColumn("hit_rate", F.round(F.col("n_hits") * 100.0 / F.col("n_calls"), 2))
