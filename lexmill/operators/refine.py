"""Refinement of synonyms and antonyms: candidates of dictionary services, base-form check, selection, results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import fixed, rules, text
from lexmill.operators import synonyms

#: Order of the services whose lists are joined (fixed values), results of each that count, words of one base-form request.
SERVICES = ("datamuse", "wordsapi", "merriam")
MOST_RESULTS, BATCH = 20, 20
NONE = "CAST(array() AS array<string>)"


def service_lists(answers: DataFrame) -> DataFrame:
    """(word, api_synonyms, api_antonyms) from (word, source, synonyms, antonyms): one row for each word.

    Lists of a word are joined in the order of :data:`SERVICES`, then other sources by name; of each source the first
    20 of a relation count, then the basic filter applies. Null lists hold nothing. Of several answers of one
    source for a word the smallest counts; they are reduced before the shuffle, so a hot word costs no more than its sources.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SERVICES]), F.col("source")), F.lit(0)), F.lit(len(SERVICES) + 1))
    cut = [F.slice(F.coalesce(c, F.expr(NONE)), 1, MOST_RESULTS).alias(c) for c in ("synonyms", "antonyms")]
    rows = answers.filter("word IS NOT NULL").select(F.lower(text.strip(F.col("word"))).alias("word"), "source", F.struct(rank.alias("rank"), "source", *cut).alias("r"))
    # a word has one row for each source
    grouped = rows.groupBy("word", "source").agg(F.min("r").alias("r")).groupBy("word").agg(F.array_sort(F.collect_list("r")).alias("r"))
    joined = grouped.select("word", F.flatten("r.synonyms").alias("s"), F.flatten("r.antonyms").alias("a"))
    return joined.select("word", synonyms.filter_basic(F.col("s"), F.col("word")).alias("api_synonyms"), synonyms.filter_basic(F.col("a"), F.col("word")).alias("api_antonyms"))


def base_form_requests(candidates: DataFrame, known: DataFrame | None = None, size: int = BATCH) -> DataFrame:
    """(key, words): the distinct candidate words, without those whose base form is ``known`` (word, is_base), in batches of ``size`` at most."""
    words = candidates.select(F.explode(F.concat("api_synonyms", "api_antonyms")).alias("w")).select(F.lower("w").alias("word")).distinct()
    if known is not None:
        words = words.join(known.select(F.lower("word").alias("word")), "word", "left_anti")

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def out(part: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([",".join(part)]), pa.array([part], pa.list_(pa.string()))], names=["key", "words"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= size:
                yield out(sorted(held[:size]))
                held = held[size:]
        if held:
            yield out(sorted(held))

    return words.mapInArrow(batched, "key string, words array<string>")


def base_forms(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(word, is_base) from requests and (key, response): a JSON object of words; a word or answer that is missing counts as no base form."""
    joined = requests.join(answers.select(F.col("key").alias("_k"), F.col("response").alias("_r")), F.col("key") == F.col("_k"), "left")
    said = F.from_json(text.fenced_json(F.col("_r")), "map<string,boolean>")
    one = joined.select(F.explode("words").alias("word"), said.alias("_s"))
    return one.select("word", F.coalesce(F.try_element_at("_s", F.col("word")), F.lit(False)).alias("is_base")).groupBy("word").agg(F.bool_or("is_base").alias("is_base"))


def candidates(services: DataFrame, contextual: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """(word, api_synonyms, api_antonyms) for the selection, from :func:`service_lists`.

    With ``contextual`` (word, synonyms, antonyms) its lists come first, then two synonyms and one antonym of the
    services, three and two at most. Words without one keep only base forms where ``forms`` (word, is_base) is given
    (without it every form passes), then the enhanced filter, three and two at most.
    """
    rows = services
    if forms is not None:
        # one map for each word, bounded by its lists
        lists = rows.select("word", F.explode(F.array_distinct(F.concat("api_synonyms", "api_antonyms"))).alias("c"))
        good = lists.join(forms.filter("is_base").select(F.lower("word").alias("f")), F.lower("c") == F.col("f")).groupBy("word").agg(F.collect_set("c").alias("_good"))
        rows = rows.join(good, "word", "left").withColumn("_good", F.coalesce("_good", F.expr(NONE)))

        def only_base(name: str) -> Column:
            return F.filter(name, lambda c: F.array_contains("_good", c))
    else:

        def only_base(name: str) -> Column:
            return F.col(name)

    plain_s, plain_a = synonyms.enhanced(only_base("api_synonyms"), F.col("word"), 3), synonyms.enhanced(only_base("api_antonyms"), F.col("word"), 2)
    if contextual is None:
        return rows.select("word", plain_s.alias("api_synonyms"), plain_a.alias("api_antonyms"))
    c = contextual.groupBy(F.lower(text.strip(F.col("word"))).alias("_w")).agg(F.min(F.struct("synonyms", "antonyms")).alias("_c"))
    joined = rows.join(c, F.col("word") == F.col("_w"), "left")
    both_s = synonyms.merged(F.col("_c.synonyms"), F.col("api_synonyms"), 3)
    both_a = F.slice(F.array_distinct(F.concat(F.coalesce("_c.antonyms", F.expr(NONE)), F.slice("api_antonyms", 1, 1))), 1, 2)
    has = F.col("_c").isNotNull()
    return joined.select("word", F.when(has, both_s).otherwise(plain_s).alias("api_synonyms"), F.when(has, both_a).otherwise(plain_a).alias("api_antonyms"))


def selected(rows: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Adds the final lists to rows with word, api_synonyms and api_antonyms (and key, where ``answers`` (key, response) are given).

    An answer is a JSON object with final_synonyms, final_antonyms, contextual_meaning, contextual_confidence and
    reasoning; its lists are filtered again. Without one the lists of the services are taken, with confidence 0.3.
    Two synonyms and one antonym at most.
    """
    schema = "final_synonyms array<string>, final_antonyms array<string>, contextual_meaning string, contextual_confidence double, reasoning string"
    said = F.lit(None).cast(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    if answers is not None:
        one = answers.groupBy(F.col("key").alias("_k")).agg(F.min("response").alias("_r"))
        rows = rows.join(one, F.col("key") == F.col("_k"), "left")
        said = F.from_json(text.fenced_json(F.col("_r")), schema)
    rows = rows.withColumn("_a", said)
    answered = F.col("_a").isNotNull()
    n_s, n_a = F.size(F.coalesce("api_synonyms", F.expr(NONE))), F.size(F.coalesce("api_antonyms", F.expr(NONE)))
    level = F.when(~answered, "low").when((n_s >= 2) | (n_a >= 2), "high").when((n_s > 0) | (n_a > 0), "medium").otherwise("low")

    def final(answer: str, own: str, most: int) -> Column:
        return synonyms.enhanced(F.when(answered, F.col(f"_a.{answer}")).otherwise(F.col(own)), F.col("word"), most)

    out = rows.withColumns(
        {
            "final_synonyms": final("final_synonyms", "api_synonyms", 2),
            "final_antonyms": final("final_antonyms", "api_antonyms", 1),
            "found_meaning": F.coalesce("_a.contextual_meaning", F.lit("")),
            "found_confidence": F.when(answered, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_a.contextual_confidence", F.lit(0.5))))).otherwise(0.3),
            "reasoning": F.coalesce("_a.reasoning", F.lit("")),
            "api_confidence": level,
            "n_api_synonyms": n_s,
            "n_api_antonyms": n_a,
            "method": F.when(answered, "hybrid_api_gpt_enhanced").otherwise("api_only_fallback_enhanced"),
        }
    )
    return out.drop("_a", "_k", "_r")


#: Columns of the detail beside those of the workbook.
DETAIL = ("original_synonyms", "original_antonyms", "n_api_synonyms", "n_api_antonyms", "n_final_synonyms", "n_final_antonyms", "seconds", "method")


def refined(wb: DataFrame, services: DataFrame | None = None, answers: DataFrame | None = None, base_form_check: bool = False) -> DataFrame:
    """The rows to refine with refined lists, and the columns of :data:`DETAIL`.

    Rows are those with synonyms or antonyms, or all if there are none. ``services`` (word, api_synonyms, api_antonyms; one row
    for each word) holds the candidates; without it the lists already in the workbook are the candidates.
    Rows without a word keep their lists. Nothing of the workbook is shuffled but by word, where ``services`` is given.
    """
    rows = synonyms.to_refine(wb).withColumn("original_synonyms", F.coalesce("synonyms", F.lit(""))).withColumn("original_antonyms", F.coalesce("antonyms", F.lit("")))
    if services is None:
        rows = rows.withColumn("api_synonyms", text.to_list(F.col("synonyms"))).withColumn("api_antonyms", text.to_list(F.col("antonyms")))
    else:
        one = services.select(F.col("word").alias("_w"), "api_synonyms", "api_antonyms")
        rows = rows.join(one, F.lower(text.strip(F.col("word"))) == F.col("_w"), "left").drop("_w")
    key = text.cache_key(F.col("word"), F.col("context"), F.col("pos"))
    rows = selected(rows.withColumn("key", key), answers)
    there = F.length(text.strip(F.coalesce("word", F.lit("")))) > 0
    mark = fixed.REFINED_WITH_FORMS if base_form_check else fixed.REFINED

    def new(value: Column, name: str) -> Column:
        return F.when(there, value).otherwise(F.col(name))

    out = rows.withColumns(
        {
            "synonyms": new(F.array_join("final_synonyms", ", "), "synonyms"),
            "antonyms": new(F.array_join("final_antonyms", ", "), "antonyms"),
            "contextual_meaning": F.when(there & (F.col("found_meaning") != ""), F.col("found_meaning")).otherwise(F.col("contextual_meaning")),
            "synonym_confidence": new(F.col("found_confidence"), "synonym_confidence"),
            "process_method": new(F.lit(mark), "process_method"),
            "inclusion_reason": F.when(there & (F.col("reasoning") != ""), F.col("reasoning")).otherwise(F.col("inclusion_reason")),
            "n_final_synonyms": F.when(there, F.size("final_synonyms")).otherwise(0),
            "n_final_antonyms": F.when(there, F.size("final_antonyms")).otherwise(0),
            "n_api_synonyms": F.when(there, F.col("n_api_synonyms")).otherwise(0),
            "n_api_antonyms": F.when(there, F.col("n_api_antonyms")).otherwise(0),
            "seconds": F.lit(None).cast("double"),  # rows are not timed one by one
        }
    )
    return out.select(*wb.columns, *DETAIL)


def comparison(detail: DataFrame) -> DataFrame:
    """The 12 columns of the sheet before and after, under its names."""
    changed = {f: F.when(F.col(f"original_{f}") != F.coalesce(f, F.lit("")), fixed.CHANGED).otherwise(fixed.SAME) for f in ("synonyms", "antonyms")}
    return detail.select(
        F.col("word").alias("단어"), F.col("meaning_ko").alias("뜻(한글)"), F.col("context").alias("문맥"),
        F.col("original_synonyms").alias("원본_동의어"), F.col("synonyms").alias("개선된_동의어"), F.col("original_antonyms").alias("원본_반의어"), F.col("antonyms").alias("개선된_반의어"),
        changed["synonyms"].alias("동의어_변화"), changed["antonyms"].alias("반의어_변화"), F.col("synonym_confidence").alias("신뢰도"), F.col("process_method").alias("처리방식"), F.col("seconds").alias("처리시간"),
    )


def statistics(detail: DataFrame) -> DataFrame:
    """One row: sums of candidates and chosen words, adoption rates, confidence buckets, changed rows and the rate of improvement (percent)."""
    n = F.count("*")
    c = F.coalesce("synonym_confidence", F.lit(0.0))
    sums = {k: F.coalesce(F.sum(k), F.lit(0)) for k in ("n_api_synonyms", "n_final_synonyms", "n_api_antonyms", "n_final_antonyms")}

    def rate(kind: str) -> Column:
        return F.coalesce(F.round(sums[f"n_final_{kind}"] * 100.0 / F.nullif(sums[f"n_api_{kind}"], F.lit(0)), 1), F.lit(0.0))

    changed = {f: F.count_if(F.col(f"original_{f}") != F.coalesce(f, F.lit(""))) for f in ("synonyms", "antonyms")}
    return detail.agg(
        n.alias("n_rows"), *[v.alias(k) for k, v in sums.items()], rate("synonyms").alias("synonym_adoption"), rate("antonyms").alias("antonym_adoption"),
        F.count_if(c >= 0.7).alias("high_confidence"), F.count_if((c >= 0.4) & (c < 0.7)).alias("medium_confidence"), F.count_if(c < 0.4).alias("low_confidence"),
        changed["synonyms"].alias("synonyms_changed"), changed["antonyms"].alias("antonyms_changed"),
        F.coalesce(F.round((changed["synonyms"] + changed["antonyms"]) * 100.0 / F.nullif(n * 2, F.lit(0)), 1), F.lit(0.0)).alias("improvement_rate"),
    )


def report(statistics_: DataFrame, usage: DataFrame | None = None) -> str:
    """The text report of one row of :func:`statistics`, and of the cost of requests where there were any."""
    s = statistics_.first()
    lines = []
    if usage is not None:
        u = usage.first()
        lines += ["requests", f"- calls: {u['n_requests']}", f"- tokens: {u['prompt_tokens'] + u['completion_tokens']:,}", f"- cost: ${u['cost']:.3f}", ""]
    lines += [
        "results",
        f"synonyms: {s['n_api_synonyms']} candidates, {s['n_final_synonyms']} chosen ({s['synonym_adoption']:.1f}%)",
        f"antonyms: {s['n_api_antonyms']} candidates, {s['n_final_antonyms']} chosen ({s['antonym_adoption']:.1f}%)",
        f"confidence: {s['high_confidence']} high, {s['medium_confidence']} medium, {s['low_confidence']} low",
        "",
        "changes",
        f"- rows with other synonyms: {s['synonyms_changed']}",
        f"- rows with other antonyms: {s['antonyms_changed']}",
        f"- rate of improvement: {s['improvement_rate']:.1f}%",
    ]
    return "\n".join(lines) + "\n"


def guarded_root_dedup(candidates_: Column, word: Column) -> Column:
    """Candidates in order, each with a short root of its own that is not the word's; a root of two letters or fewer also needs a word not yet kept."""
    root = rules.short_root
    start = F.struct(F.expr(NONE).alias("kept"), F.expr(NONE).alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        r = root(c)
        repeated = (F.length(r) <= 2) & F.exists(acc["kept"], lambda k: F.lower(k) == F.lower(c))
        skip = c.isNull() | (F.length(c) == 0) | (r == root(word)) | F.array_contains(acc["seen"], r) | repeated
        grown = F.struct(F.concat(acc["kept"], F.array(c)).alias("kept"), F.concat(acc["seen"], F.array(r)).alias("seen"))
        return F.when(skip, acc).otherwise(grown)

    return F.aggregate(F.coalesce(candidates_, F.expr(NONE)), start, step, lambda acc: acc["kept"])


def pair_filter(synonyms_: Column, antonyms_: Column, word: Column, most_synonyms: int = 3, most_antonyms: int = 2) -> Column:
    """STRUCT<synonyms, antonyms>: of each list the first single words of three characters or more other than the word."""

    def kept(c: Column, most: int) -> Column:
        listed = F.filter(F.coalesce(c, F.expr(NONE)), lambda w: w.isNotNull() & (F.lower(w) != F.lower(word)))
        return F.slice(F.filter(F.transform(listed, text.strip), lambda w: (F.length(w) > 2) & ~w.contains(" ")), 1, most)

    return F.struct(kept(synonyms_, most_synonyms).alias("synonyms"), kept(antonyms_, most_antonyms).alias("antonyms"))


def senses(answers: DataFrame, json_col: str = "response") -> DataFrame:
    """Adds contextual_meaning, semantic_field, usage_type and meaning_certainty from JSON answers; without one a general, literal sense of certainty 0.5."""
    said = F.from_json(text.fenced_json(F.col(json_col)), "contextual_meaning string, semantic_field string, usage_type string, meaning_certainty double")
    rows = answers.withColumn("_a", said)
    defaults = {"contextual_meaning": "", "semantic_field": "general", "usage_type": "literal", "meaning_certainty": 0.5}
    return rows.withColumns({k: F.coalesce(f"_a.{k}", F.lit(v)) for k, v in defaults.items()}).drop("_a")


def validated_synonyms(candidates_: Column, response: Column) -> Column:
    """Candidates that the judge keeps (validated_synonyms of a JSON answer, three at most); two or fewer need no judge, without an answer the first two stay."""
    own = F.coalesce(candidates_, F.expr(NONE))
    said = F.from_json(text.fenced_json(response), "validated_synonyms array<string>")
    judged = F.when(said.isNull(), F.slice(own, 1, 2)).otherwise(F.slice(F.coalesce(said["validated_synonyms"], F.expr(NONE)), 1, 3))
    return F.when(F.size(own) <= 2, own).otherwise(judged)


def contextual_lists(rows: DataFrame) -> DataFrame:
    """(word, synonyms, antonyms) from rows with word, synonyms and antonyms of chosen senses and the judge's ``response``: judged, one for each root."""
    s = rules.root_dedup(validated_synonyms(F.col("synonyms"), F.col("response")), F.col("word"))
    a = rules.root_dedup(F.slice(F.coalesce("antonyms", F.expr(NONE)), 1, 2), F.col("word"))
    return rows.select("word", s.alias("synonyms"), a.alias("antonyms"))
