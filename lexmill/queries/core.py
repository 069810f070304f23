"""Queries of the core operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import fixed, rules, text
from lexmill.operators import annotate, cache, difficulty, enrich, lexicon, packed, patterns, quality, refine, rows, spans, synonyms
from lexmill.plans import pipelines, vocabulary
from lexmill.queries import core_sql
from lexmill.sources import readers, sinks
from lexmill.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _lexicon(s: SparkSession, d: str, *kinds: str) -> DataFrame:
    return _t(s, d, "lexicon").filter(F.col("kind").isin(*kinds) & F.col("term").isNotNull() & ~F.col("term").startswith("#")).select("term")


@query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return packed.unpack(_t(s, d, "workbook"), lists=_t(s, d, "synonym_records"))


@query
def passage_scan(s: SparkSession, d: str) -> DataFrame:
    p = readers.passages(_t(s, d, "passages"), text_col="content", order_col="row_id")
    return p.select("row_id", "id", text.preview(F.col("content")).alias("preview"), F.length("content").alias("n_chars"))


def _ngrams(n: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return patterns.ngram_counts(_t(s, d, "passages"), lengths=(n,)).select("pattern", "frequency")

    return run


for _n in (2, 3, 4, 5):
    QUERIES[f"ngram_{_n}"] = _ngrams(_n)


@query
def pattern_top(s: SparkSession, d: str) -> DataFrame:
    top = pipelines.mine_patterns(_t(s, d, "passages"), pos=False)
    return top.select("length", "pattern", "frequency", "educational_score", "rank", "category")


@query
def pattern_top_pos(s: SparkSession, d: str) -> DataFrame:
    top = pipelines.mine_patterns(_t(s, d, "passages"))
    return top.select("length", "pattern", "frequency", "educational_score", "rank", "category", F.array_join("pos_pattern", " -> ").alias("pos_pattern"), "is_important")


@query
def pattern_category_counts(s: SparkSession, d: str) -> DataFrame:
    return sinks.distribution(pipelines.mine_patterns(_t(s, d, "passages"), pos=False), "category")


def _frequencies(s: SparkSession, d: str) -> DataFrame:
    return lexicon.word_frequencies(_t(s, d, "passages"), "content", "row_id", _lexicon(s, d, "easy"))


@query
def frequency_tiers(s: SparkSession, d: str) -> DataFrame:
    return lexicon.tiers(_frequencies(s, d)).withColumn("tier", F.round("tier", 6))


@query
def tier_histogram(s: SparkSession, d: str) -> DataFrame:
    return lexicon.tiers(_frequencies(s, d)).groupBy(F.floor("tier").alias("tier_floor")).agg(F.count("*").alias("n"), F.sum("frequency").alias("frequency"))


@query
def lexicon_split(s: SparkSession, d: str) -> DataFrame:
    return lexicon.split_lexicon(_t(s, d, "lexicon"))


@query
def lexicon_union(s: SparkSession, d: str) -> DataFrame:
    own = _t(s, d, "lexicon").filter("term IS NOT NULL").select(F.lower(text.strip(F.col("term"))).alias("term"), F.lit("lexicon").alias("source"))
    return lexicon.union_lexicons(own, lexicon.basic_words(own))


@query
def idiom_filter(s: SparkSession, d: str) -> DataFrame:
    return lexicon.idiom_filter(_t(s, d, "part"), "p_name")


@query
def idiom_lines(s: SparkSession, d: str) -> DataFrame:
    return lexicon.idiom_filter(_t(s, d, "lexicon"), "term", alphabetic=False)


@query
def basic_word_semi(s: SparkSession, d: str) -> DataFrame:
    return lexicon.members(_frequencies(s, d), lexicon.basic_words(_t(s, d, "lexicon"))).select("lemma", "frequency")


@query
def easy_word_anti(s: SparkSession, d: str) -> DataFrame:
    words = lexicon.word_frequencies(_t(s, d, "passages"), "content", "row_id")
    return lexicon.strangers(words, _t(s, d, "lexicon")).select("lemma", "frequency")


@query
def user_word_hits(s: SparkSession, d: str) -> DataFrame:
    return spans.hits(_t(s, d, "passages"), _lexicon(s, d, "user_word"))


@query
def user_idiom_hits(s: SparkSession, d: str) -> DataFrame:
    return spans.hits(_t(s, d, "passages"), _lexicon(s, d, "user_idiom", "reference_idiom"))


@query
def span_suppressed(s: SparkSession, d: str) -> DataFrame:
    return spans.hits(_t(s, d, "passages"), _lexicon(s, d, "user_word", "user_idiom", "reference_idiom"), gap=5).select("id", "start", "end", "term")


@query
def sentence_context(s: SparkSession, d: str) -> DataFrame:
    return spans.hits(_t(s, d, "passages"), _lexicon(s, d, "user_word"), with_context=True).select("id", "term", "start", "context")


@query
def reference_idiom_first(s: SparkSession, d: str) -> DataFrame:
    return spans.first_substrings(_t(s, d, "passages"), _lexicon(s, d, "reference_idiom"), "row_id", "content")


@query
def separable_hits(s: SparkSession, d: str) -> DataFrame:
    pairs = vocabulary.separable_pairs(_lexicon(s, d, "user_idiom", "reference_idiom"))
    return spans.separable(_t(s, d, "passages"), pairs).select("id", "verb", "particle", "start", "end", "gap", "pattern_type")


@query
def phrasal_class(s: SparkSession, d: str) -> DataFrame:
    verbs = s.createDataFrame([(v,) for v in sorted({p.split()[0] for p in fixed.OPTIONAL_SEPARABLE} | set(fixed.MANDATORY_SEPARABLE))], "verb string")
    particles = s.createDataFrame([(p,) for p in sorted({p.split()[1] for p in fixed.OPTIONAL_SEPARABLE} | {"out", "back", "away", "apart", "about"})], "particle string")
    # all pairs of two fixed lists of about 20 words
    pairs = verbs.withColumn("k", F.lit(1)).join(particles.withColumn("k", F.lit(1)), "k").drop("k")
    found = spans.separable(_t(s, d, "passages"), pairs)
    said = rules.phrasal_class(F.col("verb"), F.col("particle"), F.col("gap") + 1)
    return found.select("id", "start", said.alias("c")).select("id", "start", "c.*")


@query
def grammar_patterns(s: SparkSession, d: str) -> DataFrame:
    return spans.grammar_patterns(_t(s, d, "passages"), "row_id", "content")


@query
def known_phrases(s: SparkSession, d: str) -> DataFrame:
    return spans.known_phrases(_t(s, d, "passages"), "row_id", "content")


def _words(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "workbook").select(F.lower(text.strip(F.col("word"))).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).distinct()


@query
def phonetic_complexity(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("word", F.round(rules.phonetic_complexity(F.col("word")), 4).alias("complexity"))


@query
def word_difficulty(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("word", rules.word_difficulty(F.col("word")).alias("difficulty"))


@query
def word_pos(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("word", rules.pos_tag(F.col("word")).alias("pos"))


@query
def word_lemmas(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("word", annotate.lemma(F.col("word")).alias("lemma"))


@query
def stop_and_names(s: SparkSession, d: str) -> DataFrame:
    """Annotated tokens of the passages, counted by what they are."""
    one = annotate.annotated(spans.tokens(_t(s, d, "passages"), "row_id", "content"), _lexicon(s, d, "easy"))
    return one.groupBy("tag", "is_stop", "is_name").agg(F.count("*").alias("n"))


@query
def attached_synonyms(s: SparkSession, d: str) -> DataFrame:
    out = synonyms.attach(_t(s, d, "workbook"), _t(s, d, "synonym_records"))
    return out.select("entry_id", "synonyms", "antonyms", "synonym_confidence")


@query
def difficulty_cascade(s: SparkSession, d: str) -> DataFrame:
    return difficulty.cascade(_words(s, d), _lexicon(s, d, "user_word"), _lexicon(s, d, "easy"))


@query
def too_easy_words(s: SparkSession, d: str) -> DataFrame:
    return difficulty.easy(_words(s, d), _lexicon(s, d, "easy"))


@query
def difficult_words(s: SparkSession, d: str) -> DataFrame:
    """Without a dictionary every word has no senses, so each that passes the first tests is difficult."""
    easy = _lexicon(s, d, "easy").select(F.lower(text.strip(F.col("term"))).alias("word")).distinct().withColumn("_e", F.lit(True))
    w = _words(s, d).join(easy, "word", "left")
    hard = rules.is_difficult(F.col("word"), F.coalesce("_e", F.lit(False)), F.lit(False), F.lit(0), F.lit(0.0))
    return w.select("word", hard.alias("is_difficult"))


@query
def difficulty_baseline(s: SparkSession, d: str) -> DataFrame:
    words = _lexicon(s, d, "user_word").select(F.lower(text.strip(F.col("term"))).alias("word"))
    scores = words.distinct().withColumn("score", F.length("word") + F.lit(0.0))
    return difficulty.baseline(words, scores)


@query
def vocabulary_level(s: SparkSession, d: str) -> DataFrame:
    out = difficulty.level(_t(s, d, "workbook"))
    return out.select(F.round("avg_length", 6).alias("avg_length"), F.round("complex_share", 6).alias("complex_share"), "level")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """Words of the workbook with the values of their synonym field as candidates."""
    wb = _t(s, d, "workbook").filter("word IS NOT NULL AND synonyms IS NOT NULL")
    return wb.select("entry_id", text.strip(F.col("word")).alias("word"), text.to_list(F.col("synonyms")).alias("c"))


def _filtered(f) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return _candidates(s, d).select("entry_id", F.array_join(f(F.col("c"), F.col("word")), ",").alias("kept"))

    return run


QUERIES["synonym_filter_basic"] = _filtered(synonyms.filter_basic)
QUERIES["synonym_filter_form"] = _filtered(synonyms.filter_form)
QUERIES["synonym_filter_strict"] = _filtered(synonyms.filter_strict)
QUERIES["root_dedup"] = _filtered(lambda c, w: rules.root_dedup(c, w))
QUERIES["synonym_enhanced"] = _filtered(synonyms.enhanced)
QUERIES["stem_dedup"] = _filtered(synonyms.stem_dedup)


@query
def word_roots(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).select("word", rules.word_root(F.col("word")).alias("root"), rules.short_root(F.col("word")).alias("short_root"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    c = _candidates(s, d).select(F.lower("word").alias("word"), F.explode("c").alias("candidate"))
    return c.select("word", F.lower("candidate").alias("candidate")).distinct()


@query
def edit_similarity(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("word"), F.col("candidate")
    return _pairs(s, d).select("word", "candidate", rules.too_similar(a, b).alias("too_similar"), rules.same_root(a, b).alias("same_root"), rules.compound_word(b).alias("compound"))


@query
def high_quality_candidates(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).filter(rules.high_quality(F.col("candidate"), F.col("word")))


@query
def synonym_record_stats(s: SparkSession, d: str) -> DataFrame:
    return synonyms.record_stats(_t(s, d, "synonym_records"))


@query
def synonym_sources(s: SparkSession, d: str) -> DataFrame:
    return sinks.distribution(_t(s, d, "synonym_records"), "source")


@query
def synonym_latest(s: SparkSession, d: str) -> DataFrame:
    return synonyms.latest(_t(s, d, "synonym_records")).select("cache_key", "record_id", "confidence")


@query
def synonym_keys(s: SparkSession, d: str) -> DataFrame:
    r = _t(s, d, "synonym_records")
    return r.select("record_id", text.cache_key(F.col("word"), F.col("context"), F.col("pos")).alias("key"), text.pos_letter(F.col("pos")).alias("pos_letter"))


def _services(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "synonym_records").select("word", "source", "synonyms", "antonyms")


@query
def refined_workbook(s: SparkSession, d: str) -> DataFrame:
    return pipelines.refinement(_t(s, d, "workbook"))[1].select("entry_id", "synonyms", "antonyms", "synonym_confidence", "process_method", *refine.DETAIL)


@query
def refinement_stats(s: SparkSession, d: str) -> DataFrame:
    return refine.statistics(pipelines.refinement(_t(s, d, "workbook"))[1])


@query
def refined_comparison(s: SparkSession, d: str) -> DataFrame:
    """The sheet before and after, counted by what changed."""
    return pipelines.refinement(_t(s, d, "workbook"))[2].groupBy("동의어_변화", "반의어_변화", "처리방식").agg(F.count("*").alias("n"))


@query
def service_candidates(s: SparkSession, d: str) -> DataFrame:
    out = refine.service_lists(_services(s, d))
    return out.select("word", F.array_join("api_synonyms", ",").alias("api_synonyms"), F.array_join("api_antonyms", ",").alias("api_antonyms"))


@query
def guarded_roots(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("entry_id", F.array_join(refine.guarded_root_dedup(F.col("c"), F.col("word")), ",").alias("kept"))


@query
def pair_filter(s: SparkSession, d: str) -> DataFrame:
    wb = _t(s, d, "workbook").filter("word IS NOT NULL")
    both = refine.pair_filter(text.to_list(F.col("synonyms")), text.to_list(F.col("antonyms")), F.col("word"))
    return wb.select("entry_id", both.alias("p")).select("entry_id", F.array_join("p.synonyms", ",").alias("synonyms"), F.array_join("p.antonyms", ",").alias("antonyms"))


@query
def quality_duplicates(s: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(_t(s, d, "workbook"))


@query
def quality_conflicts(s: SparkSession, d: str) -> DataFrame:
    return quality.conflicts(_t(s, d, "workbook"))


@query
def quality_meaning(s: SparkSession, d: str) -> DataFrame:
    return quality.meaning_issues(_t(s, d, "workbook"))


@query
def quality_synonym(s: SparkSession, d: str) -> DataFrame:
    return quality.synonym_issues(_t(s, d, "workbook"))


@query
def quality_score(s: SparkSession, d: str) -> DataFrame:
    return pipelines.check(_t(s, d, "workbook"))


@query
def issue_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.issue_table(_t(s, d, "workbook")).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


@query
def issue_sheet(s: SparkSession, d: str) -> DataFrame:
    return quality.issue_sheet(quality.issue_table(_t(s, d, "workbook")))


@query
def issue_labels(s: SparkSession, d: str) -> DataFrame:
    return quality.issue_table(_t(s, d, "workbook")).groupBy(quality.issue_label(F.col("issue_type")).alias("label")).agg(F.count("*").alias("n"))


@query
def first_issues(s: SparkSession, d: str) -> DataFrame:
    return quality.first_issues(quality.issue_table(_t(s, d, "workbook"))).select("issue_type", "passage_id", "entry_id", "word", "conflicting_word", "description")


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    """A judge by rule: meanings of an even number of characters are wrong; every fifth length answers in plain text, every seventh not at all."""
    wb = _t(s, d, "workbook").filter("word IS NOT NULL AND meaning_ko IS NOT NULL")
    n = F.length("meaning_ko")
    rows = None
    for flag, context in (("is_appropriate", F.col("context")), ("is_accurate", None)):
        said = F.format_string('{"%s": %s, "severity": "high", "explanation": "%d characters", "suggested_meaning": "?"}', F.lit(flag), F.when(n % 2 == 0, "false").otherwise("true"), n)
        response = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 5 == 0, F.when(n % 2 == 0, "no").otherwise("That is true.")).otherwise(said)
        one = (wb if context is None else wb.filter("context IS NOT NULL")).select(quality.verdict_key(F.col("word"), F.col("meaning_ko"), context).alias("key"), response.alias("response"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def verdict_issues(s: SparkSession, d: str) -> DataFrame:
    wb, verdicts = _t(s, d, "workbook"), _verdicts(s, d)
    both = [quality.verdict_issues(wb, verdicts, of_context).withColumn("kind", F.lit(kind)) for of_context, kind in ((True, "context"), (False, "accuracy"))]
    return both[0].unionByName(both[1])


@query
def quality_score_judged(s: SparkSession, d: str) -> DataFrame:
    return pipelines.check(_t(s, d, "workbook"), _verdicts(s, d))


def _meanings(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "synonym_records").filter("contextual_meaning <> ''").select("word", F.col("contextual_meaning").alias("meaning"))


def _comma_lists(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "synonym_records").select("word", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("antonyms", ",").alias("antonyms"))


@query
def repair_synonyms(s: SparkSession, d: str) -> DataFrame:
    return quality.repair_synonyms(_t(s, d, "workbook"), _comma_lists(s, d)).select("entry_id", "synonyms", "antonyms")


@query
def repaired_workbook(s: SparkSession, d: str) -> DataFrame:
    return quality.repair(_t(s, d, "workbook"), _meanings(s, d), _comma_lists(s, d)).select("entry_id", "word", "meaning_ko", "synonyms", "antonyms")


@query
def enhanced_workbook(s: SparkSession, d: str) -> DataFrame:
    return quality.enhance(_t(s, d, "workbook"), _meanings(s, d), _comma_lists(s, d)).select("entry_id", "word", "meaning_ko", "synonyms", "antonyms")


@query
def valid_results(s: SparkSession, d: str) -> DataFrame:
    wb = _t(s, d, "workbook")
    return wb.select("entry_id", rules.valid_result(F.to_json(F.struct(F.col("word").alias("original"), F.col("meaning_ko").alias("meaning")))).alias("valid"))


@query
def difficulty_decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions from answers made of the words: the score is the length, basic are words in -s, included those with an e; every ninth length has no answer."""
    w = _words(s, d)
    n = F.length("word")
    made = F.format_string(
        '```json\n{"difficulty_score": %d, "is_basic_vocabulary": %s, "recommendation": "%s"}\n```',
        n, F.when(F.col("word").endswith("s"), "true").otherwise("false"), F.when(F.col("word").contains("e"), "include").otherwise("exclude"),
    )
    return difficulty.decisions(w.withColumn("response", F.when(n % 9 == 0, F.lit(None).cast("string")).otherwise(made))).select("word", "ok", "reason")


@query
def separable_analysis(s: SparkSession, d: str) -> DataFrame:
    """The table of separable idioms from answers made of the idioms: those of an even length are separable."""
    idioms = _lexicon(s, d, "user_idiom", "reference_idiom").select(F.lower(text.strip(F.col("term"))).alias("idiom")).distinct()
    made = F.format_string('{"is_separable": %s, "confidence": 0.7}', F.when(F.length("idiom") % 2 == 0, "true").otherwise("false"))
    return spans.separable_table(idioms.withColumn("response", made)).select("idiom", "verb", "particle", "display_form", "confidence", "reason")


@query
def cached_words(s: SparkSession, d: str) -> DataFrame:
    kv = _t(s, d, "synonym_records").select(F.lit("synonyms").alias("namespace"), F.lower("word").alias("key"), F.col("cache_key").alias("value_json"), F.col("created_at").cast("timestamp").alias("created_at"))
    return cache.lookup(_words(s, d), kv, "synonyms", "word")


@query
def budgeted_requests(s: SparkSession, d: str) -> DataFrame:
    return enrich.within_budget(_words(s, d).withColumnRenamed("word", "key"), 500)


@query
def external_lists(s: SparkSession, d: str) -> DataFrame:
    return readers.external_lists(s, f"{d}/no_such_folder")


@query
def sense_counts(s: SparkSession, d: str) -> DataFrame:
    dictionary = _t(s, d, "synonym_records").select("word", "pos", F.col("record_id").cast("int").alias("sense_no"), F.col("contextual_meaning").alias("gloss"))
    return annotate.sense_counts(_words(s, d), dictionary)


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    """The synonym records as senses, numbered within their word."""
    r = _t(s, d, "synonym_records").withColumn("word", F.lower("word"))
    nth = F.row_number().over(Window.partitionBy("word").orderBy("record_id"))
    return r.select("word", "pos", nth.alias("sense_no"), F.col("contextual_meaning").alias("gloss"), F.array("context").alias("examples"), "synonyms", "antonyms")


@query
def word_info(s: SparkSession, d: str) -> DataFrame:
    out = annotate.info(_words(s, d), _dictionary(s, d))
    return out.select("word", "gloss", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("antonyms", ",").alias("antonyms"))


@query
def best_senses(s: SparkSession, d: str) -> DataFrame:
    wb = _t(s, d, "workbook").select(F.lower(text.strip(F.col("word"))).alias("word"), F.col("context").alias("meaning")).filter("word rlike '^[a-z]+$'")
    return annotate.best_senses(wb, _dictionary(s, d)).select("word", "meaning", "sense_no", F.round("score", 2).alias("score"))


@query
def difficult_words_scored(s: SparkSession, d: str) -> DataFrame:
    """Difficulty by score: senses of the records, half a point of morphology."""
    easy = _lexicon(s, d, "easy").select(F.lower(text.strip(F.col("term"))).alias("word")).distinct().withColumn("_e", F.lit(True))
    w = annotate.sense_counts(_words(s, d), _dictionary(s, d)).join(easy, "word", "left")
    hard = rules.is_difficult(F.col("word"), F.coalesce("_e", F.lit(False)), F.lit(False), F.col("n_senses"), F.lit(0.5))
    return w.select("word", "n_senses", F.round(rules.difficulty_score(F.lit(0.5), F.col("n_senses"), F.col("word")), 4).alias("score"), hard.alias("is_difficult"))


@query
def whitelisted(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "workbook").filter("context IS NOT NULL").select("entry_id", text.whitelist_clean(F.col("context")).alias("cleaned"))


@query
def refinable_rows(s: SparkSession, d: str) -> DataFrame:
    return synonyms.to_refine(_t(s, d, "workbook")).select("entry_id")


@query
def repair_conflicts(s: SparkSession, d: str) -> DataFrame:
    return quality.repair_conflicts(_t(s, d, "workbook")).select("entry_id", "word", "passage_id")


@query
def repair_duplicates(s: SparkSession, d: str) -> DataFrame:
    return quality.repair_duplicates(_t(s, d, "workbook")).select("entry_id", "word", "passage_id")


@query
def repair_candidates(s: SparkSession, d: str) -> DataFrame:
    return quality.repair_candidates(_t(s, d, "workbook"))


@query
def clean_meanings(s: SparkSession, d: str) -> DataFrame:
    wb = _t(s, d, "workbook").filter("word IS NOT NULL AND meaning_ko IS NOT NULL")
    return wb.select("entry_id", text.clean_meaning(F.col("word"), F.col("meaning_ko")).alias("meaning"))


@query
def confidence_buckets(s: SparkSession, d: str) -> DataFrame:
    return rows.confidence_buckets(_t(s, d, "workbook"))


@query
def match_counts(s: SparkSession, d: str) -> DataFrame:
    return sinks.distribution(_t(s, d, "workbook"), "match_type")


@query
def passage_entry_counts(s: SparkSession, d: str) -> DataFrame:
    return rows.entry_counts(_t(s, d, "workbook"))


@query
def verdict_sample(s: SparkSession, d: str) -> DataFrame:
    return quality.sample_for_verdict(_t(s, d, "workbook"), 50).select("entry_id", "word")


@query
def coercions(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "workbook")
    flag = F.col("is_separated").cast("string")
    return e.select("entry_id", text.to_bool(flag).alias("flag"), text.to_int(F.col("passage_id")).alias("as_int"), text.to_float(F.col("word"), -1.0).alias("as_float"), F.size(text.to_list(F.col("synonyms"))).alias("n_values"))


def _kv(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events")
    return e.select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value_json"), F.col("ts").alias("created_at"))


@query
def cache_latest(s: SparkSession, d: str) -> DataFrame:
    return cache.latest(_kv(s, d)).select("namespace", "key", "value_json")


@query
def cache_merge(s: SparkSession, d: str) -> DataFrame:
    kv = _kv(s, d)
    odd = F.col("value_json").cast("bigint") % 2 == 1
    return cache.merge(kv.filter(~odd), kv.filter(odd)).select("namespace", "key", "value_json")


@query
def cache_expire(s: SparkSession, d: str) -> DataFrame:
    kv = _kv(s, d)
    now = kv.agg(F.max("created_at")).first()[0]
    return cache.unexpired(kv, F.lit(now)).select("namespace", "key", "value_json")


@query
def cache_stats(s: SparkSession, d: str) -> DataFrame:
    return cache.stats(_kv(s, d))


@query
def usage_cost(s: SparkSession, d: str) -> DataFrame:
    log = _t(s, d, "documents").select(F.col("n_chars").alias("prompt_tokens"), F.col("textbook_id").cast("bigint").alias("completion_tokens"))
    return enrich.cost(log).withColumn("cost", F.round("cost", 6))


@query
def phrase_corpus(s: SparkSession, d: str) -> DataFrame:
    local = _lexicon(s, d, "user_idiom", "reference_idiom").select(F.lower(text.strip(F.col("term"))).alias("idiom"))
    remote = readers.phrases_of(_t(s, d, "documents"), "en", lang_col="lang", text_col="text")
    return pipelines.phrase_corpus(local, remote).select("phrase", "source")


def _stream(s: SparkSession, d: str) -> DataFrame:
    return stream.table(s, f"{d}/passages.parquet", _t(s, d, "passages").schema)


@query
def stream_word_counts(s: SparkSession, d: str) -> DataFrame:
    return stream.drained(stream.running_counts(_stream(s, d)), "word_counts")


@query
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    out = stream.drained(stream.windowed_counts(_stream(s, d)), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n_passages", "n_chars")


@query
def user_share(s: SparkSession, d: str) -> DataFrame:
    return rows.user_share(_t(s, d, "workbook"))


@query
def clean_definitions(s: SparkSession, d: str) -> DataFrame:
    wb = _t(s, d, "workbook").filter("word IS NOT NULL AND meaning_ko IS NOT NULL")
    return wb.select("entry_id", text.clean_definition(F.col("word"), F.col("meaning_ko")).alias("definition"))


@query
def vocabulary_workbook_lexicon(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.workbook(_t(s, d, "passages"), _t(s, d, "lexicon"))


@query
def vocabulary_workbook_full(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.workbook(_t(s, d, "passages"), _t(s, d, "lexicon"), profile="full")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return core_sql.oracle_sql()
