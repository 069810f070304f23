"""Command line: python -m lexmill.cli vocab | patterns | check | refine | phrases."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import cache, difficulty, lexicon, quality, refine
from lexmill.plans import pipelines, vocabulary
from lexmill.session import session
from lexmill.sources import readers, sinks


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") or "." not in path.rsplit("/", 1)[-1] else readers.read_csv(spark, path)


PATTERN_TOP, PHRASE_LIMIT, DIFFICULTY_LEAST, CACHE_DAYS, MASTER_MORE_THAN = 200, 30_000, 7.0, 100, 15_000


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill")
    p.add_argument("-v", "--verbose", action="store_true", help="log what Spark does")
    sub = p.add_subparsers(dest="program", required=True)
    v = sub.add_parser("vocab", help="passages and a lexicon to the workbook")
    v.add_argument("--input", "-i", required=True)
    v.add_argument("--output", "-o", required=True)
    v.add_argument("--user-words", required=True)
    v.add_argument("--data-dir", help="folder of idiom files and word lists")
    v.add_argument("--profile", choices=("lexicon", "full"), default="lexicon")
    v.add_argument("--threshold", "-t", type=float, default=DIFFICULTY_LEAST, help="least score of a difficult word that has an analysis in the cache")
    v.add_argument("--cache", "-c", help="cache table; answers of its namespaces extraction and difficulty are used")
    v.add_argument("--no-quality-check", action="store_true")
    n = sub.add_parser("patterns", help="ranked n-gram patterns")
    n.add_argument("--input", required=True)
    n.add_argument("--output", required=True)
    n.add_argument("--text-column")
    n.add_argument("--encoding", default="cp949", help="tried after UTF-8")
    n.add_argument("--top", type=int, default=PATTERN_TOP)
    c = sub.add_parser("check", help="issues, score and repair of a workbook")
    c.add_argument("workbook")
    c.add_argument("--issues")
    c.add_argument("--repaired")
    c.add_argument("--cache", help="cache table; answers of its namespace verdicts are used")
    r = sub.add_parser("refine", help="refined synonyms and antonyms")
    r.add_argument("workbook")
    r.add_argument("--candidates", help="table of word, source, synonyms, antonyms: the answers of dictionary services")
    r.add_argument("--max-items", type=int)
    r.add_argument("--batch-size", type=int, default=20, help="words of one base-form request")
    r.add_argument("--disable-ai-base-form", action="store_true", help="every form of a candidate passes")
    r.add_argument("--cache", help="cache table; answers of its namespaces selection and base_forms are used")
    r.add_argument("--output-prefix", required=True)
    f = sub.add_parser("phrases", help="phrase corpus of a sentence file and local idioms")
    f.add_argument("--sentences")
    f.add_argument("--local")
    f.add_argument("--limit", "-l", type=int, default=PHRASE_LIMIT)
    f.add_argument("--output", "-o", required=True)
    f.add_argument("--no-cache", action="store_true")
    f.add_argument("--clear-cache", action="store_true")
    f.add_argument("--cache-dir")
    f.add_argument("--cache-validity", type=int, default=CACHE_DAYS, help="days")
    return p


def _answers(spark: SparkSession, path: str | None, namespace: str) -> DataFrame | None:
    """(key, response) of one namespace of a cache table, the last of each key; None without a cache or without an answer."""
    if not path:
        return None
    rows = cache.latest(cache.load(spark, path).filter(F.col("namespace") == namespace)).select("key", F.col("value_json").alias("response"))
    return None if rows.isEmpty() else rows


def _passages(spark: SparkSession, path: str) -> DataFrame:
    df = _table(spark, path)
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    df = df.withColumnRenamed(readers.find_text_column(df), "content")
    for c in readers.METADATA:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def _lexicon(spark: SparkSession, user_words: str, data_dir: str | None) -> DataFrame:
    raw = readers.read_csv(spark, user_words)
    split = lexicon.split_lexicon(raw, raw.columns[0])
    out = split.select("term", F.when(F.col("kind") == "idiom", "user_idiom").otherwise("user_word").alias("kind"))
    if data_dir:
        ref = readers.idiom_directory(spark, f"{data_dir}/*.csv", f"{data_dir}/*.txt")
        out = out.unionByName(ref.select(F.col("phrase").alias("term"), F.lit("reference_idiom").alias("kind")))
    basic = lexicon.basic_words(out)
    return out.unionByName(basic.select("term", F.lit("easy").alias("kind")))


def _numbered(df: DataFrame) -> DataFrame:
    return df if "entry_id" in df.columns else df.withColumn("entry_id", F.monotonically_increasing_id())


def _vocab(spark: SparkSession, a: argparse.Namespace) -> None:
    wb = vocabulary.workbook(
        _passages(spark, a.input), _lexicon(spark, a.user_words, a.data_dir), a.profile, _answers(spark, a.cache, "extraction"), check=not a.no_quality_check
    )
    analysed = _answers(spark, a.cache, "difficulty")
    if analysed is not None:
        # words that were found easy are taken out; those without an analysis stay
        easy = difficulty.decisions(analysed, least=a.threshold).filter(~F.col("ok")).select(F.col("key").alias("base_form"), F.lit("difficult_word").alias("match_type"))
        wb = wb.join(easy, ["base_form", "match_type"], "left_anti").select(*wb.columns)
    sinks.write_workbook(wb, a.output)


def _refine(spark: SparkSession, a: argparse.Namespace) -> None:
    wb = _numbered(readers.workbook(_table(spark, a.workbook)))
    if a.max_items:
        wb = wb.orderBy("entry_id").limit(a.max_items)
    services = spark.read.parquet(a.candidates) if a.candidates else None
    said = None if a.disable_ai_base_form else _answers(spark, a.cache, "base_forms")
    forms = None
    if services is not None and said is not None:
        known = said.select(F.col("key").alias("word"), (F.col("response") == "true").alias("is_base"))
        open_ = refine.base_forms(refine.base_form_requests(refine.service_lists(services), known, a.batch_size), said)
        forms = known.unionByName(open_)
    _, detail, _ = pipelines.refinement(wb, services, forms=forms, answers=_answers(spark, a.cache, "selection"))
    sinks.write_refinement(detail, a.output_prefix, [c for c in wb.columns if c != "entry_id"])


def _phrases(spark: SparkSession, a: argparse.Namespace) -> None:
    path = f"{a.cache_dir}/phrases" if a.cache_dir and not a.no_cache else None
    if path and not a.clear_cache:
        kept = cache.unexpired(cache.load(spark, path), F.current_timestamp(), a.cache_validity)
        if cache.accepted(kept, MASTER_MORE_THAN):
            rows = cache.latest(kept).select(F.from_json("value_json", "phrase string, definition string, example string, source string").alias("r"))
            rows.select("r.*").write.mode("overwrite").parquet(a.output)
            return
    local = readers.read_csv(spark, a.local).select("idiom") if a.local else None
    remote = readers.sentences(spark, a.sentences, limit=a.limit) if a.sentences else None
    pipelines.phrase_corpus(local, remote).write.mode("overwrite").parquet(a.output)
    if path:
        made = spark.read.parquet(a.output)
        kv = made.select(F.lit("phrases").alias("namespace"), F.col("phrase").alias("key"), F.to_json(F.struct(*made.columns)).alias("value_json"), F.current_timestamp().alias("created_at"))
        kv.write.mode("overwrite" if a.clear_cache else "append").partitionBy("namespace").parquet(path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(args)
    spark = spark or session("lexmill")
    if a.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if a.program == "vocab":
        _vocab(spark, a)
    elif a.program == "patterns":
        df = readers.read_csv(spark, a.input, ("utf-8", a.encoding)) if a.input.endswith(".csv") else _table(spark, a.input)
        column = a.text_column if a.text_column in df.columns else df.columns[0] if a.text_column is None and "content" not in df.columns else a.text_column or "content"
        sinks.write_patterns(pipelines.mine_patterns(df, column, a.top), a.output)
    elif a.program == "check":
        wb = _numbered(readers.workbook(_table(spark, a.workbook)))
        verdicts = _answers(spark, a.cache, "verdicts")
        pipelines.check(wb, verdicts).show(truncate=False)
        judged = [quality.verdict_issues(wb, verdicts, of_context) if verdicts is not None else None for of_context in (True, False)]
        quality.first_issues(quality.issue_table(wb, *judged)).select("issue_type", "description", "recommendation").show(truncate=False)
        if a.issues:
            sinks.write_issues(wb, a.issues, *judged)
        if a.repaired:
            sinks.write_workbook(quality.repair(wb), a.repaired)
    elif a.program == "refine":
        _refine(spark, a)
    else:
        _phrases(spark, a)


if __name__ == "__main__":
    main()
