"""Word lists and word frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import fixed, text, words
from lexmill.operators import annotate
from lexmill.session import spread, written


def split_lexicon(df: DataFrame, term_col: str = "term", lower: bool = True) -> DataFrame:
    """(term, kind, n_words), distinct: two or more words separated by spaces make an idiom."""
    t = text.strip(F.col(term_col))
    rows = df.select((F.lower(t) if lower else t).alias("term")).filter(F.length("term") > 0)
    n = F.size(F.filter(F.split("term", " "), lambda w: F.length(w) > 0))
    return rows.select("term", F.when(n >= 2, "idiom").otherwise("word").alias("kind"), n.alias("n_words")).distinct()


def idiom_filter(df: DataFrame, term_col: str, alphabetic: bool = True) -> DataFrame:
    """(phrase), distinct and in lower case: 2 to 8 words, 100 characters at most; for tables also letters, spaces and hyphens only."""
    raw = df.select(F.col(term_col).alias("_raw"))
    phrase = F.lower(text.strip(F.col("_raw")))
    rows = raw.select("_raw", phrase.alias("phrase"), F.size(F.split(phrase, r"\s+")).alias("_n")).filter(F.col("_n").between(2, 8))
    rows = rows.filter(F.length("phrase" if alphabetic else "_raw") <= 100)
    if alphabetic:
        rows = rows.filter(F.regexp_replace("phrase", "[ -]", "").rlike(r"^\p{L}+$"))
    else:
        rows = rows.filter(~F.col("_raw").rlike("^(#|//)"))
    return rows.select("phrase").distinct()


def union_lexicons(*parts: DataFrame) -> DataFrame:
    """(term, source) of lists given as (term, source); each term once, with its first source by name."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term").agg(F.min("source").alias("source"))


def _count_tokens(batches: Iterator[pa.RecordBatch], flush_at: int) -> Iterator[pa.RecordBatch]:
    """Of each token of three letters or more its count and first place, per task."""
    table: dict[str, list] = {}

    def flush() -> pa.RecordBatch:
        n, ids, places = zip(*table.values()) if table else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], names=["token", "n", "id", "pos"])

    for batch in batches:
        for row_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for pos, token in enumerate(words.split_clean(words.clean_text(body))):
                if len(token) < 3:
                    continue
                got = table.get(token)
                if got is None:
                    table[token] = [1, row_id, pos]
                else:
                    got[0] += 1
                    if (row_id, pos) < (got[1], got[2]):
                        got[1:] = row_id, pos
        if len(table) >= flush_at:
            yield flush()
            table.clear()
    yield flush()


def word_frequencies(df: DataFrame, text_col: str, id_col: str, stopwords: DataFrame | None = None, flush_at: int = 500_000) -> DataFrame:
    """(lemma, frequency, first_id, first_pos) of words of three letters or more that are no stop words.

    Tokens are counted in each task; stop words are taken away from the counted tokens, and the counts
    of the forms of a word are added up under its lemma. Rows without an id or text are left out.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    counted = spread(rows).mapInArrow(lambda b: _count_tokens(b, flush_at), "token string, n bigint, id bigint, pos int")
    tokens = counted.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.struct("id", "pos")).alias("f"))
    if stopwords is not None:
        tokens = tokens.join(stopwords.select(F.lower(text.strip(F.col(stopwords.columns[0]))).alias("token")).filter("token IS NOT NULL").distinct(), "token", "left_anti")
    lemmas = tokens.groupBy(annotate.lemma(F.col("token")).alias("lemma")).agg(F.sum("n").alias("frequency"), F.min("f").alias("_f"))
    return lemmas.select("lemma", "frequency", F.col("_f.id").alias("first_id"), F.col("_f.pos").alias("first_pos"))


def ranked(freq: DataFrame) -> DataFrame:
    """Adds rank (by frequency, then first occurrence) and n_words, without bringing all words into one task.

    Ranks are counted inside ranges of the sort key, and each range gets the number of words before it.
    """
    key = ["_neg", "first_id", "first_pos"]
    parts = freq.withColumn("_neg", -F.col("frequency")).repartitionByRange(*key).withColumn("_part", F.spark_partition_id())
    placed = written(parts, "ranks")  # ranges must not be drawn anew between the two uses
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    # one row for each shuffle partition
    joined = placed.join(F.broadcast(before.drop("_n")), "_part")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    return joined.withColumn("rank", inside + F.col("_before")).withColumn("n_words", F.lit(total).cast("bigint")).drop("_neg", "_part", "_before")


def tiers(freq: DataFrame) -> DataFrame:
    """(lemma, frequency, rank, tier): the most frequent 5, 20 and 50 % are 1, 2 and 3; the rest runs from 4 to 5."""
    r, n = F.col("rank"), F.col("n_words")
    tier = F.when(r <= n * 0.05, 1.0).when(r <= n * 0.2, 2.0).when(r <= n * 0.5, 3.0).otherwise(4.0 + (r - n * 0.5) / (n * 0.5))
    return ranked(freq).select("lemma", "frequency", r.cast("bigint").alias("rank"), tier.alias("tier"))


def members(words: DataFrame, lists: DataFrame, word_col: str = "lemma", term_col: str = "term") -> DataFrame:
    """Words that stand in the lists (semi join)."""
    terms = lists.select(F.lower(text.strip(F.col(term_col))).alias("_term")).distinct()
    return words.join(terms, F.lower(words[word_col]) == terms["_term"], "left_semi")


def strangers(words: DataFrame, lists: DataFrame, word_col: str = "lemma", term_col: str = "term") -> DataFrame:
    """Words that stand in none of the lists (anti join); null terms are in no list."""
    terms = lists.select(F.lower(text.strip(F.col(term_col))).alias("_term")).filter("_term IS NOT NULL").distinct()
    return words.join(terms, F.lower(words[word_col]) == terms["_term"], "left_anti")


def basic_words(df: DataFrame) -> DataFrame:
    """The shipped basic words as (term, source)."""
    return df.sparkSession.createDataFrame([(w, "basic") for w in fixed.BASIC_WORDS], "term string, source string")
