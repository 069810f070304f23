"""Frequency of every distinct term: recursive radix spilling (problem 1).

Terms are counted per task first, so a term leaves a task a few times at most however often it
occurs, and the partial counts are written to disk. They are partitioned by the leading bits of the
term's hash, as many as the number of distinct terms asks for; partitions with more than ``leaf_rows``
distinct terms are split by further bits, again and again, until none is too large. Each leaf is then
summed out-of-core by DuckDB, which reads it as a stream and spills beyond its memory, in a task of its own.
"""

from __future__ import annotations

import math
import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import scratch_root, spread, written

_ASCII_TERM = re.compile(r"[a-z]+")
_TERM = regex.compile(r"\p{L}+")

PARTIAL = "term string, n_occurrences bigint, n_rows bigint"
#: Most bits of the hash used at one level, and in all.
LEVEL_BITS, ALL_BITS = 12, 60
DUCK_MEMORY = "256MB"


def terms(text: str) -> list[str]:
    """Longest runs of letters of any script, in lower case."""
    low = text.lower()
    return (_ASCII_TERM if low.isascii() else _TERM).findall(low)


def _count(batches: Iterator[pa.RecordBatch], flush_at: int) -> Iterator[pa.RecordBatch]:
    occurrences: Counter[str] = Counter()
    in_rows: Counter[str] = Counter()
    rows = 0

    def flush() -> pa.RecordBatch:
        names = list(in_rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*names, None], pa.string()),
                pa.array([*map(occurrences.__getitem__, names), 0], pa.int64()),
                pa.array([*map(in_rows.__getitem__, names), rows], pa.int64()),
            ],
            names=["term", "n_occurrences", "n_rows"],
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            rows += 1
            found = terms(text)
            occurrences.update(found)
            in_rows.update(set(found))
            if len(in_rows) >= flush_at:
                yield flush()
                occurrences.clear()
                in_rows.clear()
                rows = 0
    if rows:
        yield flush()


def partial_counts(df: DataFrame, text_col: str, flush_at: int = 500_000) -> DataFrame:
    """Counts per task: (term, n_occurrences, n_rows); a row with a null term holds the number of texts."""
    return spread(df.select(F.col(text_col).cast("string"))).mapInArrow(lambda b: _count(b, flush_at), PARTIAL)


def _duck_sum(batches: Iterator[pa.RecordBatch], spill: str) -> Iterator[pa.RecordBatch]:
    """Sum by term what comes in, as a stream; all rows of a term are in this task."""
    first = next(batches, None)
    if first is None:
        return
    folder = f"{spill}/{uuid.uuid4().hex}" if spill else ""
    if folder:
        os.makedirs(folder, exist_ok=True)
    con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        con.register("leaf", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
        yield from con.sql(
            "SELECT term, sum(n_occurrences)::BIGINT AS n_occurrences, sum(n_rows)::BIGINT AS n_rows FROM leaf GROUP BY term"
        ).to_arrow_reader(50_000)
    finally:
        con.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _spill_folder(spark: SparkSession) -> str:
    """Folder of DuckDB's spill files: in the shared folder where that is a mounted one, else none, and DuckDB keeps to its memory."""
    root = scratch_root(spark)
    return re.sub("^file:(//)?", "", root) + "/duckdb" if root.startswith(("file:", "/")) else ""


def _prefix(bits: int | Column) -> Column:
    # a shift by 64 is one by 0
    return F.when(F.lit(bits) == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.col("h"), (64 - F.lit(bits)).cast("int")))


def leaves(partial: DataFrame, leaf_rows: int, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, int]:
    """(``partial`` with the column ``leaf``, number of leaves): the leading bits of ``h``, as many as each part of the table needs.

    Sizes are distinct hashes (estimated, so that a leaf may be some percent larger), as the many partial
    counts of a hot term can be split by no bits and need no room. Only the hashes are read again for
    a further level, and only those of partitions that were too large; what is known of the
    partitions stays in tables.
    """
    n_terms = partial.agg(F.approx_count_distinct("h")).first()[0] or 0
    bits = min(level_bits, max(0, math.ceil(math.log2(max(n_terms, 1) / leaf_rows))))
    n_leaves, done = 1 << bits, partial.withColumn("bits", F.lit(bits))
    rest = partial.select("h")
    while bits < ALL_BITS and n_terms > leaf_rows:
        # one row for each partition that is too large
        sizes = rest.groupBy(_prefix(bits).alias("p")).agg(F.approx_count_distinct("h").alias("n")).filter(F.col("n") > leaf_rows)
        big = written(sizes, "oversized")
        n_big, largest = big.agg(F.count("*"), F.max("n")).first()
        if not n_big:
            break
        step = min(level_bits, ALL_BITS - bits, max(1, math.ceil(math.log2(largest / leaf_rows))))
        n_leaves += n_big << step
        prefix = big.select("p", F.lit(True).alias("big"))
        done = done.withColumn("p", F.when(F.col("bits") == bits, _prefix(bits))).join(prefix, "p", "left")
        done = done.withColumn("bits", F.when(F.col("big"), bits + step).otherwise(F.col("bits"))).drop("p", "big")
        rest = rest.withColumn("p", _prefix(bits)).join(prefix, "p", "left_semi").drop("p")
        bits += step
    return done.withColumn("leaf", F.struct("bits", _prefix(F.col("bits")).alias("prefix"))).drop("bits"), n_leaves


def radix_sum(partial: DataFrame, leaf_rows: int = 1_000_000, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Sum partial counts by term. ``partial``: a table already written, with the term's hash ``h``."""
    spark = partial.sparkSession
    placed, n_leaves = leaves(partial, leaf_rows, level_bits)
    n_parts = min(max(n_leaves, spark.sparkContext.defaultParallelism), 1 << 17)
    spill = _spill_folder(spark)
    # a task gets whole leaves; while there are fewer leaves than cores, the next bits of the hash give every core its share
    key = "leaf" if n_leaves >= n_parts else "h"
    return placed.repartition(n_parts, key).select("term", "n_occurrences", "n_rows").mapInArrow(lambda b: _duck_sum(b, spill), PARTIAL)


def term_frequencies(
    df: DataFrame,
    text_col: str = "content",
    rare_below: int = 3,
    common_above: float = 0.30,
    leaf_rows: int = 1_000_000,
    flush_at: int = 500_000,
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """(term, n_occurrences, n_rows, mark) of every distinct term of ``text_col``.

    ``mark`` is 'rare' where the term occurs in fewer than ``rare_below`` rows, else 'common' where it
    occurs in more than ``common_above`` of the rows with a non-null text, else null.

    Null texts count nowhere; empty texts count as rows without terms. Repeated rows each count.
    Very long texts are read whole. An empty table gives an empty result. Other columns are not read.
    Terms are counted in bounded tables per task (``flush_at`` distinct terms), so no group, however
    hot, has more rows than there are flushes.
    """
    partial = written(partial_counts(df, text_col, flush_at).withColumn("h", F.xxhash64("term")), "terms")
    n_texts = partial.filter("term IS NULL").agg(F.sum("n_rows")).first()[0] or 0
    summed = radix_sum(partial.filter("term IS NOT NULL"), leaf_rows, level_bits)
    mark = F.when(F.col("n_rows") < rare_below, "rare").when(F.col("n_rows") > common_above * n_texts, "common")
    return summed.withColumn("mark", mark)
