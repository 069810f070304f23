"""The other programs: pattern mining, quality check, refinement, phrase corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import patterns, quality, refine
from lexmill.sources import readers


def mine_patterns(df: DataFrame, text_col: str = "content", most: int = 200, pos: bool = True) -> DataFrame:
    """Scored, categorised patterns of 2 to 5 words, the best of each length, all sorted by score and frequency."""
    counts = patterns.ngram_counts(df, text_col)
    if pos:
        counts = patterns.pos_filter(patterns.with_pos(counts))
    return patterns.top(patterns.scored(counts), most).orderBy(F.desc("educational_score"), F.desc("frequency"), "length", "pattern")


def check(wb: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row: counts of issues, score and band; ``verdicts`` (key, response) add the checks of contexts and meanings."""
    judged = [quality.verdict_issues(wb, verdicts, of_context) if verdicts is not None else None for of_context in (True, False)]
    return quality.score(quality.breakdown(wb, *judged)).withColumn("band", quality.band(F.col("quality_score")))


def check_and_repair(wb: DataFrame, meanings: DataFrame | None = None, lists: DataFrame | None = None, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return check(wb, verdicts), quality.repair(wb, meanings, lists)


def refinement(
    wb: DataFrame, services: DataFrame | None = None, contextual: DataFrame | None = None, forms: DataFrame | None = None, answers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refined workbook, detail, before and after) of the rows to refine.

    ``services`` (word, source, synonyms, antonyms) are the answers of dictionary services, ``contextual``
    (word, synonyms, antonyms) lists made from chosen senses, ``forms`` (word, is_base) the base-form
    check, ``answers`` (key, response) the final selection. Without services the lists of the workbook are the candidates.
    """
    lists = refine.candidates(refine.service_lists(services), contextual, forms) if services is not None else None
    detail = refine.refined(wb, lists, answers, forms is not None)
    return detail.select(*wb.columns), detail, refine.comparison(detail)


def phrase_corpus(local: DataFrame | None, remote: DataFrame | None) -> DataFrame:
    """Local idioms first, then sentences of the remote corpus, each phrase once."""
    parts = []
    if local is not None:
        parts.append(local.select(F.col("idiom").alias("phrase")).withColumn("source", F.lit("local")))
    if remote is not None:
        parts.append(remote.withColumn("source", F.lit("remote")))
    return readers.phrase_corpus(*parts)
