"""Candidate synonyms: filters, root and stem dedup, selection, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import rules, text
from lexmill.functions.porter import stem


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), text.strip), lambda w: F.length(w) > 0)


def filter_basic(candidates: Column, word: Column) -> Column:
    """Single words of 3 to 12 letters, not the word itself, no very common one."""
    return F.filter(_list(candidates), lambda c: rules.valid_candidate(c, word, basic=True))


def filter_form(candidates: Column, word: Column) -> Column:
    """As above, very common words too, but none in capitals."""
    return F.filter(_list(candidates), lambda c: rules.valid_candidate(c, word, basic=False))


def filter_strict(candidates: Column, word: Column) -> Column:
    """Also none that reads too much like the word, no compounds, and one for each root."""
    kept = F.filter(filter_form(candidates, word), lambda c: ~rules.too_similar(F.lower(c), F.lower(word)) & ~rules.compound_word(c))
    return rules.root_dedup(kept, word)


def enhanced(candidates: Column, word: Column, most: int = 3) -> Column:
    """Form filter, root dedup, the first ``most``."""
    return F.slice(rules.root_dedup(filter_form(candidates, word), word), 1, most)


def merged(a: Column, b: Column, most: int = 3) -> Column:
    """Both lists without repeats, in order, the second by two at most."""
    return F.slice(F.array_distinct(F.concat(_list(a), F.slice(_list(b), 1, 2))), 1, most)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_dedup_udf(candidates: pd.Series, word: pd.Series, most: pd.Series) -> pd.Series:
    def one(cands, w, n):
        seen, out = {stem((w or "").lower())}, []
        for c in cands if cands is not None else ():
            s = stem(c.lower()) if c else None
            if s and s not in seen:
                seen.add(s)
                out.append(c)
                if len(out) >= n:
                    break
        return out

    return pd.Series([one(c, w, n) for c, w, n in zip(candidates, word, most)])


def stem_dedup(candidates: Column, word: Column, most: int = 3) -> Column:
    """One candidate for each Porter stem, none with the word's own."""
    return stem_dedup_udf(candidates, word, F.lit(most))


def validated(records: DataFrame) -> DataFrame:
    """Synonym records with both lists filtered and deduplicated (3 and 2 at most) and confidence within 0 to 1."""
    return (
        records.withColumn("synonyms", stem_dedup(filter_basic(F.col("synonyms"), F.col("word")), F.col("word"), 3))
        .withColumn("antonyms", stem_dedup(filter_basic(F.col("antonyms"), F.col("word")), F.col("word"), 2))
        .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
    )


def record_stats(records: DataFrame) -> DataFrame:
    """One row: number of records, of those with lists, coverage, averages over the non-empty, by source."""
    s, a = F.size(F.coalesce("synonyms", F.array().cast("array<string>"))), F.size(F.coalesce("antonyms", F.array().cast("array<string>")))
    return records.agg(
        F.count("*").alias("n_records"),
        F.count_if(s > 0).alias("with_synonyms"),
        F.count_if(a > 0).alias("with_antonyms"),
        F.round(F.avg(F.when(s > 0, 100.0).otherwise(0.0)), 2).alias("synonym_coverage"),
        F.round(F.avg(F.when(s > 0, s)), 4).alias("avg_synonyms"),
        F.round(F.avg(F.when(a > 0, a)), 4).alias("avg_antonyms"),
        F.count_if(F.coalesce(F.col("confidence") > 0, F.lit(False))).alias("successful"),
    )


def latest(records: DataFrame, key_col: str = "cache_key", time_col: str = "created_at", id_col: str = "record_id") -> DataFrame:
    """One record for each key: the last written; reduced before the shuffle."""
    newest = F.max_by(F.struct(*records.columns), F.struct(F.col(time_col), F.col(id_col)))
    return records.groupBy(F.col(key_col).alias("_k")).agg(newest.alias("_r")).select("_r.*")


def to_refine(wb: DataFrame) -> DataFrame:
    """Rows with synonyms or antonyms; all rows if there is none."""
    some = wb.filter(~text.missing(F.col("synonyms")) | ~text.missing(F.col("antonyms")))
    return some if not some.isEmpty() else wb



def attach(wb: DataFrame, records: DataFrame, key_col: str = "word") -> DataFrame:
    """Workbook rows with the lists of the last record of their word; synonym_confidence is 0.8 with synonyms, else 0."""
    newest = F.max_by(F.struct("synonyms", "antonyms"), F.struct("created_at", "record_id"))
    last = records.groupBy(F.lower("word").alias("_w")).agg(newest.alias("_r"))
    joined = wb.join(last, F.lower(F.col(key_col)) == F.col("_w"), "left")
    syn, ant = F.array_join("_r.synonyms", ","), F.array_join("_r.antonyms", ",")
    out = joined.withColumn("synonyms", F.coalesce(syn, "synonyms")).withColumn("antonyms", F.coalesce(ant, "antonyms"))
    return out.withColumn("synonym_confidence", F.when(text.missing(F.col("synonyms")), 0.0).otherwise(0.8)).drop("_w", "_r")
