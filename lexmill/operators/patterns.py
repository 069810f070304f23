"""N-gram patterns: counted in one pass for all lengths, filtered, scored, categorised, ranked."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import fixed, rules, words
from lexmill.session import spread


def _count(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], flush_at: int) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    for batch in batches:
        for body in batch.column(0).to_pylist():
            clean = words.clean_text(body)
            if len(clean) < 5:
                continue
            toks = words.split_clean(clean)
            for n in lengths:
                counts.update(map(" ".join, zip(*(toks[i:] for i in range(n)))))
            if len(counts) >= flush_at:
                yield flush()
                counts.clear()
    yield flush()


def ngram_counts(
    df: DataFrame, text_col: str = "content", lengths=(2, 3, 4, 5), min_frequency: dict[int, int] | None = None, flush_at: int = 1_000_000
) -> DataFrame:
    """(length, pattern, frequency): texts are tokenised once, counts are combined in each task before the shuffle.

    Texts of fewer than five characters once cleaned are left out; n-grams that begin or end with an
    article too; frequencies below the limit of their length are dropped.
    """
    limits = min_frequency or fixed.MIN_FREQUENCY
    source = df.select(F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    partial = spread(source).mapInArrow(lambda b: _count(b, tuple(lengths), flush_at), "pattern string, n bigint")
    length = F.length("pattern") - F.length(F.replace("pattern", F.lit(" "))) + 1
    least = F.lit(1)
    for n in lengths:
        least = F.when(F.col("length") == n, limits.get(n, 1)).otherwise(least)
    counted = partial.filter(~F.col("pattern").rlike(r"^(a|an|the) | (a|an|the)$")).groupBy("pattern").agg(F.sum("n").alias("frequency"))
    return counted.select(length.alias("length"), "pattern", "frequency").filter(F.col("frequency") >= least)


def with_pos(counts: DataFrame) -> DataFrame:
    """Adds pos_pattern and is_important; the tags are made once for each surviving pattern."""
    tags = F.transform(F.split("pattern", " "), rules.pos_tag)
    return counts.withColumn("pos_pattern", tags).withColumn("is_important", rules.important_pos(F.col("pos_pattern")))


def pos_filter(tagged: DataFrame, always_from: int = 5) -> DataFrame:
    """Keeps important sequences, and frequent patterns whatever their tags."""
    return tagged.filter(F.col("is_important") | (F.col("frequency") >= always_from))


def scored(counts: DataFrame) -> DataFrame:
    return counts.withColumn("educational_score", rules.educational_score(F.col("pattern"), F.col("frequency"), F.col("length")))


def top(scored_: DataFrame, most: int = 200) -> DataFrame:
    """The best of each length; ties by pattern. Spark cuts each task to ``most`` rows before the shuffle."""
    w = Window.partitionBy("length").orderBy(F.desc("educational_score"), "pattern")
    ranked = scored_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.withColumn("educational_score", F.round("educational_score", 2)).withColumn("category", rules.category(F.col("pattern")))
