"""Difficulty of words: cascade, decisions, candidates, baseline, level of a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import rules, text


def cascade(words: DataFrame, user: DataFrame, external: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, ok, reason) of distinct words against the user's and external lists."""
    w = words.select(F.lower(F.col(word_col)).alias("word")).filter("word IS NOT NULL").distinct()
    u = user.select(F.lower(text.strip(F.col(user.columns[0]))).alias("word")).distinct().withColumn("_u", F.lit(True))
    e = external.select(F.lower(text.strip(F.col(external.columns[0]))).alias("word")).distinct().withColumn("_e", F.lit(True))
    flagged = w.join(u, "word", "left").join(e, "word", "left")
    said = rules.suitability(F.col("word"), F.coalesce("_u", F.lit(False)), F.coalesce("_e", F.lit(False)))
    return flagged.select("word", said.alias("_s")).select("word", "_s.ok", "_s.reason")


def easy(words: DataFrame, external: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, pos, too_easy) of distinct words, tagged by rule."""
    w = words.select(F.lower(F.col(word_col)).alias("word")).filter("word IS NOT NULL").distinct()
    e = external.select(F.lower(text.strip(F.col(external.columns[0]))).alias("word")).distinct().withColumn("_e", F.lit(True))
    tag = rules.pos_tag(F.col("word"))
    flagged = w.join(e, "word", "left").withColumn("pos", tag)
    return flagged.select("word", "pos", rules.too_easy(F.col("word"), F.col("pos"), F.coalesce("_e", F.lit(False)), F.lit(False)).alias("too_easy"))


def decisions(analysis: DataFrame, json_col: str = "response", least: float = 7.0) -> DataFrame:
    """Adds ok and reason from difficulty analyses given as JSON; scores from ``least`` on are difficult."""
    parsed = F.from_json(text.fenced_json(F.col(json_col)), "difficulty_score double, is_basic_vocabulary boolean, recommendation string")
    rows = analysis.withColumn("_a", parsed)
    known = F.col("_a").isNotNull() & F.col(json_col).isNotNull()
    said = rules.difficulty_decision(known, F.col("_a.is_basic_vocabulary"), F.col("_a.difficulty_score"), F.col("_a.recommendation"), least)
    return rows.withColumn("_s", said).select(*analysis.columns, "_s.ok", "_s.reason")


def first_candidates(tokens: DataFrame, stopwords: DataFrame, most: int = 10, min_lemma: int = 5) -> DataFrame:
    """(id, pos, start, end, word): of each text the first ``most`` candidates (a feature of the word choice), of those the long ones.

    ``tokens`` has id, pos, token as written, start and end; capitalised ones count as names and are left out.
    """
    rows = tokens.filter(F.col("token").rlike(r"^\p{L}{3,}$") & ~F.col("token").rlike(r"^\p{Lu}")).withColumn("word", F.lower("token"))
    stop = stopwords.select(F.lower(text.strip(F.col(stopwords.columns[0]))).alias("word")).filter("word IS NOT NULL").distinct()
    rows = rows.join(stop, "word", "left_anti")
    n = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).filter(F.length("word") >= min_lemma).select("id", "pos", "start", "end", "word")


def baseline(words: DataFrame, scores: DataFrame | None = None, most: int = 15, seed: int = 42) -> DataFrame:
    """(average, threshold) over up to ``most`` single words drawn by a keyed hash; fixed defaults where there is none or no score."""
    single = words.select(F.col(words.columns[0]).alias("word")).filter("word IS NOT NULL").distinct().filter(~F.col("word").rlike("[ -]"))
    drawn = single.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "word")), "word").limit(most)
    rated = drawn.withColumn("score", F.lit(None).cast("double")) if scores is None else drawn.join(scores, "word", "left")
    both = rated.agg(F.count_distinct("word").alias("_n"), F.avg("score").alias("_a"))
    average = F.when(F.col("_n") == 0, 5.0).otherwise(F.coalesce("_a", F.lit(6.0)))
    limit = F.when(F.col("_n") == 0, 3.5).when(F.col("_a").isNull(), 5.5).otherwise(F.greatest(F.lit(3.0), F.col("_a") - 1.5))
    return both.select(average.alias("average"), limit.alias("threshold"))


def level(wb: DataFrame, word_col: str = "word") -> DataFrame:
    """(avg_length, complex_share, level) of all words of a workbook."""
    w = wb.select(text.strip(F.coalesce(word_col, F.lit(""))).alias("w"))
    longer = F.length("w") >= 2
    share = F.count_if(longer & rules.complex_word(F.col("w"))) / F.nullif(F.count_if(longer), F.lit(0))
    one = w.agg(F.coalesce(F.avg(F.when(F.length("w") > 0, F.length("w"))), F.lit(5.0)).alias("avg_length"), F.coalesce(share, F.lit(0.0)).alias("complex_share"))
    return one.withColumn("level", rules.vocabulary_level(F.col("avg_length"), F.col("complex_share")))
