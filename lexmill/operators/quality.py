"""Checks, score and repair of a workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import fixed, rules, text


def resolve(columns: list[str]) -> dict[str, str]:
    """Logical name to the column that has one of its aliases; the first alias wins, case aside."""
    lower = [c.lower() for c in columns]
    out = {}
    for name, aliases in fixed.ALIASES.items():
        for a in aliases:
            if a.lower() in lower:
                out[name] = columns[lower.index(a.lower())]
                break
    return out


def _norm(c: Column) -> Column:
    return F.lower(text.strip(c))


def duplicate_counts(wb: DataFrame, keep_null_keys: bool = True) -> DataFrame:
    """(passage_id, word, n) of words that occur more than once in a passage, as written; null keys form groups of their own unless told otherwise."""
    rows = wb if keep_null_keys else wb.filter("passage_id IS NOT NULL AND word IS NOT NULL")
    return rows.groupBy("passage_id", "word").agg(F.count("*").alias("n")).filter("n > 1")


def duplicates(wb: DataFrame, keep_null_keys: bool = True) -> DataFrame:
    """(passage_id, word, n, entry_id): one row for each entry of the groups of :func:`duplicate_counts`.

    No group is brought into one row or task, however often an entry was copied: a hot key of the join is split,
    as the other side has one row for each group.
    """
    counts = duplicate_counts(wb, keep_null_keys).select(F.col("passage_id").alias("_p"), F.col("word").alias("_w"), "n")
    rows = wb.select("passage_id", "word", "entry_id")
    return rows.join(counts, rows["passage_id"].eqNullSafe(counts["_p"]) & rows["word"].eqNullSafe(counts["_w"])).select("passage_id", "word", "n", "entry_id")


def _kinds(wb: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = wb.filter("passage_id IS NOT NULL").select("passage_id", _norm(F.col("word")).alias("w")).filter("w IS NOT NULL").distinct()
    is_idiom = F.col("w").contains(" ")
    idioms = rows.filter(is_idiom).select("passage_id", F.col("w").alias("idiom"), F.explode(F.array_distinct(F.split("w", r"\s+"))).alias("w"))
    return idioms, rows.filter(~is_idiom)


def conflicts(wb: DataFrame) -> DataFrame:
    """(passage_id, idiom, word): single words of a passage that are part of one of its idioms."""
    idioms, words = _kinds(wb)
    return idioms.join(words, ["passage_id", "w"]).select("passage_id", "idiom", F.col("w").alias("word"))


def meaning_issues(wb: DataFrame, compat_nan: bool = False) -> DataFrame:
    """(entry_id, word, meaning_ko, problem_type, severity)."""
    problem = rules.meaning_problem(F.col("meaning_ko"), compat_nan)
    severity = F.when(F.col("problem_type").isin("missing_or_too_short", "generic_meaning_pattern"), "high").otherwise("medium")
    return wb.select("entry_id", "word", "meaning_ko", problem.alias("problem_type")).filter("problem_type IS NOT NULL").withColumn("severity", severity)


def synonym_issues(wb: DataFrame) -> DataFrame:
    """(entry_id, word) without synonyms."""
    return wb.filter(text.missing(F.col("synonyms"))).select("entry_id", "word")


def breakdown(wb: DataFrame, context_issues: DataFrame | None = None, accuracy_issues: DataFrame | None = None) -> DataFrame:
    """One row: total and number of issues of each kind; checks that need verdicts count 0 without them."""
    checks = {
        "duplicates": duplicate_counts(wb),
        "conflicts": conflicts(wb),
        "total_entries": wb,
        "meanings": wb.filter(rules.meaning_problem(F.col("meaning_ko")).isNotNull()),
        "synonyms": wb.filter(text.missing(F.col("synonyms"))),
        "contexts": context_issues,
        "accuracy": accuracy_issues,
    }
    counted = None
    for name, issues in checks.items():
        if issues is not None:
            one = issues.agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
            counted = one if counted is None else counted.unionByName(one)
    names = ("total_entries", *fixed.PENALTIES)
    return counted.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in names])


def score(breakdown_: DataFrame) -> DataFrame:
    """Adds issues_found and quality_score: 100 less the weighted shares, 0 at least, one decimal; 0 for no entries."""
    lost = sum((F.col(k) / F.col("total_entries") * w for k, w in fixed.PENALTIES.items()), F.lit(0.0))
    found = sum((F.col(k) for k in fixed.PENALTIES), F.lit(0))
    value = F.when(F.col("total_entries") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 - lost), 1))
    return breakdown_.withColumn("issues_found", found).withColumn("quality_score", value)


def band(score_col: Column) -> Column:
    return F.when(score_col >= 90, "excellent").when(score_col >= 75, "good").when(score_col >= 60, "fair").otherwise("poor")


def issue_table(wb: DataFrame, context_issues: DataFrame | None = None, accuracy_issues: DataFrame | None = None) -> DataFrame:
    """All issues in one table of the 15 columns of the issue sheet, under internal names.

    Duplicates and conflicts name a passage, not an entry. ``context_issues`` and ``accuracy_issues``
    come from :func:`verdict_issues`; without them there are none of these kinds.
    """

    def shaped(df: DataFrame, kind: str, severity: str | Column, description: Column, recommendation: Column | str = "") -> DataFrame:
        df = df.withColumn("issue_type", F.lit(kind)).withColumn("severity", severity if isinstance(severity, Column) else F.lit(severity))
        df = df.withColumn("description", description).withColumn("recommendation", recommendation if isinstance(recommendation, Column) else F.lit(recommendation))
        made = [(F.col(c) if c in df.columns else F.lit(None)).cast("bigint" if c == "entry_id" else "string").alias(c) for c in fixed.ISSUE_COLUMNS]
        return df.select(*made)

    def said(template: str, *columns: str) -> Column:
        return F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    t = fixed.ISSUE_TEXTS
    c = conflicts(wb).withColumnRenamed("word", "conflicting_word")
    m = meaning_issues(wb).withColumnRenamed("meaning_ko", "current_meaning")
    out = (
        shaped(duplicate_counts(wb), "within_passage_duplicate", "high", said(t["within_passage_duplicate"], "passage_id", "word", "n"))
        .unionByName(shaped(c, "idiom_word_conflict", "high", said(t["idiom_word_conflict"], "passage_id", "idiom", "conflicting_word"), said(t["resolve_conflict"], "idiom", "conflicting_word")))
        .unionByName(shaped(m, "missing_korean_meaning", F.col("severity"), said(t["missing_korean_meaning"], "word", "current_meaning"), t["make_meaning"]))
        .unionByName(shaped(synonym_issues(wb), "missing_synonyms", "low", said(t["missing_synonyms"], "word"), t["make_synonyms"]))
    )
    for issues, kind in ((context_issues, "context_meaning_mismatch"), (accuracy_issues, "word_meaning_mismatch")):
        if issues is not None:
            out = out.unionByName(shaped(issues, kind, F.col("severity"), said(t[kind], "word", "meaning")))
    return out


def issue_sheet(issues: DataFrame) -> DataFrame:
    """The issue table under the names of the sheet, in their order; what is absent is empty text."""
    return issues.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(sheet) for c, sheet in fixed.ISSUE_COLUMNS.items()])


def issue_label(kind: Column) -> Column:
    """The label of an issue's type; a type without one stays."""
    out = kind
    for k, label in fixed.ISSUE_LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def first_issues(issues: DataFrame, most: int = 5) -> DataFrame:
    """The issues that a report shows: by type in the order of the checks, then passage, entry and word (a top-k report)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in fixed.ISSUE_LABELS]), F.col("issue_type"))
    return issues.orderBy(rank, "passage_id", "entry_id", "word", "conflicting_word").limit(most)


def sample_for_verdict(wb: DataFrame, n: int, seed: int = 42, with_context: bool = True) -> DataFrame:
    """The ``n`` entries with the smallest keyed hash among those with a meaning and a context (a sampling operator)."""
    rows = wb.filter("word IS NOT NULL AND meaning_ko IS NOT NULL AND context IS NOT NULL" if with_context else "word IS NOT NULL AND meaning_ko IS NOT NULL")
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entry_id").cast("string"))), "entry_id").limit(n)


def verdict_key(word: Column, meaning: Column, context: Column | None = None) -> Column:
    """Key of a question to the judge: the same for entries that ask the same."""
    return F.md5(F.concat_ws("\x1f", F.lit("context" if context is not None else "accuracy"), word, meaning, *([context] if context is not None else [])))


def verdict_issues(wb: DataFrame, verdicts: DataFrame, of_context: bool, most: int | None = None, seed: int = 42) -> DataFrame:
    """(entry_id, passage_id, word, meaning, context, severity, analysis, suggested_meaning) of sampled entries that the judge finds wrong.

    ``verdicts`` has (key, response): a JSON answer with ``is_appropriate`` (of contexts) or ``is_accurate``, severity,
    explanation and suggested_meaning; of another text, whether it says true. Entries without a verdict pass.
    At most ``most`` entries are judged (50 contexts, 30 meanings).
    """
    sample = sample_for_verdict(wb, most or (50 if of_context else 30), seed, of_context)
    context = F.col("context") if of_context else None
    answers = verdicts.groupBy(F.col("key").alias("_k")).agg(F.min("response").alias("_r"))
    asked = sample.withColumn("_key", verdict_key(F.col("word"), F.col("meaning_ko"), context)).join(answers, F.col("_key") == F.col("_k"))
    flag = "is_appropriate" if of_context else "is_accurate"
    parsed = F.from_json(text.fenced_json(F.col("_r")), f"{flag} boolean, severity string, explanation string, suggested_meaning string")
    rows = asked.withColumn("_a", parsed)
    # an answer without the flag passes; one that is no JSON is read as text
    is_json = text.fenced_json(F.col("_r")).rlike(r"^\s*\{")
    good = F.when(is_json, F.coalesce(F.col(f"_a.{flag}"), F.lit(True))).otherwise(F.lower("_r").contains("true"))
    shown = F.when(F.length("context") > 100, F.concat(F.substring("context", 1, 100), F.lit("..."))).otherwise(F.col("context"))
    return rows.filter(F.col("_r").isNotNull() & ~good).select(
        "entry_id", "passage_id", "word", F.col("meaning_ko").alias("meaning"), (shown if of_context else F.lit(None).cast("string")).alias("context"),
        F.coalesce("_a.severity", F.lit("medium")).alias("severity"), F.coalesce("_a.explanation", F.lit("")).alias("analysis"), F.coalesce("_a.suggested_meaning", F.lit("")).alias("suggested_meaning"),
    )


def repair_meanings(wb: DataFrame, meanings: DataFrame) -> DataFrame:
    """Problem meanings replaced from (word, meaning) where that holds something better than the generic one."""
    m = meanings.groupBy("word").agg(F.min("meaning").alias("_m"))
    bad = rules.meaning_problem(F.col("meaning_ko")).isin("generic_meaning_pattern", "contains_english", "missing_or_too_short")
    usable = F.col("_m").isNotNull() & (F.col("_m") != F.concat(F.col("word"), F.lit(fixed.GENERIC_MEANING)))
    out = wb.join(m, "word", "left").withColumn("meaning_ko", F.when(bad & usable, F.col("_m")).otherwise(F.col("meaning_ko")))
    return out.select(*wb.columns)


def repair_candidates(wb: DataFrame, most: int | None = 20) -> DataFrame:
    """Single words with fewer than two synonyms, in order of entry; at most ``most`` are repaired in one run."""
    few = text.missing(F.col("synonyms")) | (F.size(F.split("synonyms", ",")) < 2)
    rows = wb.filter(few & ~F.col("word").contains(" ")).select("entry_id", "word", "synonyms").orderBy("entry_id")
    return rows if most is None else rows.limit(most)


def repair_conflicts(wb: DataFrame) -> DataFrame:
    """Single words that are part of an idiom of their passage are dropped."""
    idioms, _ = _kinds(wb)
    parts = idioms.select("passage_id", F.col("w").alias("_w")).distinct()
    single = ~F.col("_key").contains(" ")
    rows = wb.withColumn("_key", _norm(F.col("word")))
    kept = rows.join(parts, (rows["passage_id"] == parts["passage_id"]) & (rows["_key"] == parts["_w"]) & single, "left_anti")
    return kept.drop("_key")


def repair_duplicates(wb: DataFrame, order: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """One row for each passage and word: the longest context, then the first by the columns ``order``, which name a row.

    Rows without a passage or word are in no group, so all of them stay. Rows are reduced before the
    shuffle, so a word copied very often costs one row for each task.
    """
    grouped = F.col("passage_id").isNotNull() & F.col("word").isNotNull()
    best = wb.filter(grouped).groupBy("passage_id", "word").agg(
        F.max(F.struct(F.coalesce(F.length("context"), F.lit(-1)).alias("n"), *[(-F.col(c)).alias(c) for c in order])).alias("_b")
    )
    kept = wb.filter(grouped).join(best.select(*[(-F.col(f"_b.{c}")).alias(c) for c in order]), list(order), "left_semi")
    return kept.select(*wb.columns).unionByName(wb.filter(~grouped))


def _with_lists(wb: DataFrame, chosen: DataFrame, lists: DataFrame) -> DataFrame:
    """Entries of ``chosen`` (entry_id) get the cleaned lists of their word from (word, synonyms, antonyms), where those hold anything."""
    new = lists.groupBy(F.lower("word").alias("_w")).agg(F.min(F.struct(text.clean_list(F.col("synonyms")).alias("s"), text.clean_list(F.col("antonyms")).alias("a"))).alias("_n"))
    rows = wb.join(chosen.select(F.col("entry_id").alias("_id")), F.col("entry_id") == F.col("_id"), "left").join(new, F.lower(text.strip(F.col("word"))) == F.col("_w"), "left")

    def better(field: str, name: str) -> Column:
        use = F.col("_id").isNotNull() & (F.length(f"_n.{field}") > 0)
        return F.when(use, F.col(f"_n.{field}")).otherwise(F.col(name))

    return rows.withColumn("synonyms", better("s", "synonyms")).withColumn("antonyms", better("a", "antonyms")).select(*wb.columns)


def repair_synonyms(wb: DataFrame, lists: DataFrame, most: int | None = 20) -> DataFrame:
    """The first ``most`` single words with fewer than two synonyms get lists from (word, synonyms, antonyms) as comma texts."""
    return _with_lists(wb, repair_candidates(wb, most), lists)


def repair(wb: DataFrame, meanings: DataFrame | None = None, lists: DataFrame | None = None, order: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """Meanings, then synonyms, then conflicts, then duplicates; what has no table to draw from is left out."""
    out = repair_meanings(wb, meanings) if meanings is not None else wb
    out = repair_synonyms(out, lists) if lists is not None else out
    return repair_duplicates(repair_conflicts(out), order)


def bulk_candidates(wb: DataFrame, max_items: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entries whose meanings and whose synonyms are to be made in one run: half of ``max_items`` each, in order of entry."""
    half = max_items // 2
    m = text.strip(F.col("meaning_ko"))
    poor = m.isNull() | m.endswith("의미") | (F.length(m) < 2)
    return wb.filter(poor).orderBy("entry_id").limit(half), wb.filter(text.missing(F.col("synonyms"))).orderBy("entry_id").limit(half)


def enhance(wb: DataFrame, meanings: DataFrame, lists: DataFrame, max_items: int = 50) -> DataFrame:
    """The workbook with better meanings and lists for the entries of :func:`bulk_candidates`, where the tables have them."""
    poor, empty = bulk_candidates(wb, max_items)
    new = meanings.groupBy("word").agg(F.min("meaning").alias("_m"))
    chosen = poor.select(F.col("entry_id").alias("_p"))
    rows = wb.join(chosen, F.col("entry_id") == F.col("_p"), "left").join(new, "word", "left")
    usable = F.col("_p").isNotNull() & F.col("_m").isNotNull() & (F.col("_m") != F.concat(F.col("word"), F.lit(fixed.GENERIC_MEANING)))
    out = rows.withColumn("meaning_ko", F.when(usable, F.col("_m")).otherwise(F.col("meaning_ko"))).select(*wb.columns)
    return _with_lists(out, empty, lists)
