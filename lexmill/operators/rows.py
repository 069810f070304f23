"""Rows of the workbook and of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import fixed, rules, text


def workbook_rows(made: DataFrame) -> DataFrame:
    """Matches with their passage's columns to the 22 columns, with row_id in front."""
    single = F.col("kind").isin(3, 5)
    info = F.concat(F.lit("Studio: "), F.coalesce("studio_title", F.lit("")), F.lit(", Unit: "), F.coalesce("textbook_unit_id", F.lit("")))
    values = {
        "textbook_id": F.col("textbook_id"), "book_title": F.col("book_title"), "passage_id": F.col("textbook_studio_passage_id"), "seq": F.col("seq"),
        "passage_preview": F.col("preview"), "word": F.col("original"), "base_form": F.col("base_form"),
        "pos": F.when(single, text.simple_pos(rules.pos_tag(F.lower("original")))).otherwise(""),
        "meaning_ko": F.concat("original", F.lit(fixed.GENERIC_MEANING)), "meaning_en": F.lit(""), "synonyms": F.lit(""), "antonyms": F.lit(""),
        "context": F.col("context"), "is_separated": F.col("is_separated"), "confidence": F.col("confidence"),
        "user_db_match": F.col("kind").isin(1, 2, 3), "match_type": F.col("match_type"), "pattern_info": info, "contextual_meaning": F.lit(""),
        "synonym_confidence": F.lit(0.0), "process_method": F.lit("lexicon"),
        "inclusion_reason": F.when(F.col("kind") <= 3, "사용자DB매칭").when(F.col("kind") == 4, "참조숙어").otherwise("난이도"),
    }
    return made.select("row_id", *[values[n].cast(t).alias(n) for n, _, t in fixed.WORKBOOK])


def entry_counts(wb: DataFrame) -> DataFrame:
    """(passage_id, n_entries, n_separated, n_idioms, n_words, n_user) of each passage."""
    return wb.groupBy("passage_id").agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.coalesce("is_separated", F.lit(False))).alias("n_separated"),
        F.count_if(F.coalesce(F.col("word").contains(" "), F.lit(False))).alias("n_idioms"),
        F.count_if(F.coalesce(~F.col("word").contains(" "), F.lit(False))).alias("n_words"),
        F.count_if(F.coalesce("user_db_match", F.lit(False))).alias("n_user"),
    )


def user_share(wb: DataFrame) -> DataFrame:
    """(n_entries, n_user, user_share): rows that match the user's list, in percent of all; a null flag is no match."""
    flag = F.coalesce("user_db_match", F.lit(False))
    share = F.coalesce(F.round(F.avg(flag.cast("int")) * 100, 2), F.lit(0.0))
    return wb.agg(F.count("*").alias("n_entries"), F.count_if(flag).alias("n_user"), share.alias("user_share"))


def confidence_buckets(wb: DataFrame, column: str = "confidence") -> DataFrame:
    """(bucket, n): from 0.7, from 0.4, below; null values have a bucket of their own."""
    c = F.col(column)
    bucket = F.when(c >= 0.7, "high").when(c >= 0.4, "medium").when(c.isNull(), "missing").otherwise("low")
    return wb.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
