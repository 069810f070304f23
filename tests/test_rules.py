import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import rules, text
from lexmill.functions.porter import stem
from lexmill.operators import cache, difficulty, enrich, lexicon, quality, spans, synonyms


def one(spark, column, **values):
    df = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>")).alias(k) for k, v in values.items()])
    return df.select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="I don't -- it's cannot, x café well-known 42 ok2 The--End") == ["do", "it", "can", "not", "café", "the", "end"]
    assert one(spark, text.tokens(F.col("t").cast("string")), t=None) == []
    assert one(spark, text.ngrams(F.col("t"), 3), t=["a", "b"]) == []


def test_context(spark):
    t = "One here. Two is up now. Three."
    assert one(spark, text.sentence_context(F.col("t"), F.lit(17), F.lit(19)), t=t) == "Two is up now"


@pytest.mark.parametrize("pattern, frequency, n, score", [("as a result", 4, 3, 8.5), ("in order to", 4, 3, 11.25), ("blue hat", 3, 2, 3.0)])
def test_score(spark, pattern, frequency, n, score):
    assert one(spark, rules.educational_score(F.col("p"), F.lit(frequency), F.lit(n)), p=pattern) == score


@pytest.mark.parametrize("pattern, label", [("information about", "전치사구"), ("as a result", "연결어구"), ("real life", "조건표현"), ("give up", "동사구"), ("blue hat", "기타표현")])
def test_category(spark, pattern, label):
    assert one(spark, rules.category(F.col("p")), p=pattern) == label


def test_phonetic(spark):
    assert round(one(spark, rules.phonetic_complexity(F.col("w")), w="strength"), 6) == 3.1


@pytest.mark.parametrize("word, root", [("better", "good"), ("happiness", "happi"), ("running", "runn"), ("eldest", "old"), ("sly", "sly"), ("us", "us")])
def test_root(spark, word, root):
    assert one(spark, rules.word_root(F.col("w")), w=word) == root


def test_candidates(spark):
    c = ["fast runner", "up-to-date", "ab", "ABC", "quick", "Quickly", "good", "verylongwordindeed", "w1nd", " glad ", ""]
    assert one(spark, synonyms.filter_basic(F.col("c"), F.lit("quick")), c=c) == ["ABC", "Quickly", "glad"]
    assert one(spark, synonyms.filter_form(F.col("c"), F.lit("quick")), c=c) == ["Quickly", "good", "glad"]
    assert one(spark, synonyms.enhanced(F.col("c"), F.lit("run")), c=["running", "runner", "walker", "walking", "jump"]) == ["running", "walker", "jump"]
    assert one(spark, synonyms.stem_dedup(F.col("c"), F.lit("run")), c=["running", "walks", "walking", "jump"]) == ["walks", "jump"]


def test_porter():
    known = "caresses caress ponies poni agreed agre plastered plaster sing sing conflated conflat hopping hop filing file happy happi relational relat operator oper replacement replac adoption adopt controll control"
    pairs = known.split()
    for word, root in zip(pairs[::2], pairs[1::2]):
        assert stem(word) == root


def test_meanings(spark):
    p = rules.meaning_problem(F.col("m").cast("string"))
    for m, problem in [("x의 의미", "generic_meaning_pattern"), ("a word", "contains_english"), ("말", "missing_or_too_short"), ("가" * 31, "too_long"), ("좋은 말", None), (None, "missing_or_too_short")]:
        assert one(spark, p, m=m) == problem
    assert one(spark, rules.meaning_problem(F.col("m").cast("string"), compat_nan=True), m=None) == "contains_english"
    assert one(spark, text.clean_meaning(F.lit("cat"), F.col("m")), m='답변: "고양이"') == "고양이"


def test_decision(spark):
    d = rules.difficulty_decision(F.lit(True), F.lit(False), F.col("s"), F.lit("include"))
    assert not one(spark, d, s=6.9)["ok"] and one(spark, d, s=7.0)["ok"]


def test_fold(spark):
    starts = [0, 3, 9, 4, 40, 44, 5, 46, 60]
    spans_ = F.transform(F.array(*map(F.lit, starts)), lambda x: F.struct(x.alias("start"), x.alias("end")))
    kept = spark.range(1).select(rules.keep_apart(spans_, 5).alias("k")).first()["k"]
    assert [k["start"] for k in kept] == [0, 9, 40, 46, 60]


def test_phrasal(spark):
    def said(v, p, d):
        return one(spark, rules.phrasal_class(F.col("v"), F.col("p"), F.lit(d)), v=v, p=p)["display_form"]

    assert (said("pick", "up", 2), said("carry", "out", 2), said("log", "in", 3), said("log", "in", 1)) == ("pick up", "carry ~ out", "log ~ in", "log in")


def test_hits_and_separable(spark):
    df = spark.createDataFrame([(1, "Pick one up. He carried it out; well-known, known up"), (2, None), (3, "")], "row_id bigint, content string")
    found = spans.hits(df, spark.createDataFrame([("well-known",), ("known",), (" UP ",), (None,)], "term string"))
    assert sorted((r["term"], r["start"]) for r in found.collect()) == [("known", 37), ("known", 44), ("up", 9), ("up", 50), ("well-known", 32)]
    pairs = spark.createDataFrame([("pick", "up"), ("carried", "out")], "verb string, particle string")
    got = {(r["verb"], r["gap"], r["pattern_type"]) for r in spans.separable(df, pairs).collect()}
    assert got == {("pick", 1, "separated_noun"), ("carried", 1, "separated_pronoun")}
    assert spans.hits(df, spark.createDataFrame([], "term string")).count() == 0
    grammar = spans.grammar_patterns(spark.createDataFrame([(1, "I spend time reading and prevent him from going")], "i bigint, t string"), "i", "t")
    assert {r["display_form"] for r in grammar.collect()} == {"spend time V-ing", "prevent N from V-ing"}


def test_tiers(spark):
    freq = spark.createDataFrame([(f"w{i}", 100 - i, i, 0) for i in range(10)], "lemma string, frequency bigint, first_id bigint, first_pos int")
    got = {r["rank"]: r["tier"] for r in lexicon.tiers(freq).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 6, 10)] == [2.0, 2.0, 3.0, 3.0, 4.2, 5.0]
    assert lexicon.tiers(freq.limit(0)).count() == 0


def test_score_of_workbook(spark):
    row = spark.createDataFrame([(10, 1, 1, 2, 3, 0, 0)], "total_entries long, duplicates long, conflicts long, meanings long, synonyms long, contexts long, accuracy long")
    assert quality.score(row).first()["quality_score"] == 87.5
    assert quality.score(row.withColumn("total_entries", F.lit(0))).first()["quality_score"] == 0.0


def test_repairs(spark):
    schema = "entry_id bigint, passage_id string, word string, context string, meaning_ko string, synonyms string"
    wb = spark.createDataFrame(
        [(1, "p", "give up", "c", "포기", "a"), (2, "p", "Give", "c", "주다", None), (3, "p", "cat", "aa", "말", "x"), (4, "p", "cat", "aaaa", "말뭉치", "x"), (5, None, "give", None, None, "nan"), (6, "p", "cat", "bbbb", "말", "x")],
        schema,
    )
    assert [r["word"] for r in quality.conflicts(wb).collect()] == ["give"]
    assert sorted(r["entry_id"] for r in quality.repair_conflicts(wb).collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["entry_id"] for r in quality.repair_duplicates(wb).collect()) == [1, 2, 4, 5]
    fixed_ = quality.repair_meanings(wb, spark.createDataFrame([("cat", "고양이")], "word string, meaning string"))
    assert {r["entry_id"]: r["meaning_ko"] for r in fixed_.collect()}[3] == "고양이"
    assert quality.resolve(["단어", "Context", "지문ID"]) == {"word": "단어", "context": "Context", "passage_id": "지문ID"}
    assert quality.repair(wb.limit(0)).count() == 0


def test_cache(spark):
    t = datetime.datetime
    old = spark.createDataFrame([("n", "k", "1", t(2024, 1, 1)), ("n", "k", "2", t(2024, 1, 2)), ("n", "j", "3", t(2024, 1, 1))], cache.SCHEMA)
    new = spark.createDataFrame([("n", "k", "9", t(2023, 1, 1))], cache.SCHEMA)
    assert {r["key"]: r["value_json"] for r in cache.merge(old, new).collect()} == {"k": "9", "j": "3"}
    assert cache.unexpired(old, F.lit(t(2024, 1, 8)).cast("timestamp"), 7).count() == 3
    assert cache.unexpired(old, F.lit(t(2024, 1, 8, 12)).cast("timestamp"), 7).count() == 1
    assert cache.clear(old, "n", "k").count() == 1
    assert not cache.accepted(old)
    assert {r["key"]: r["cached"] for r in cache.lookup(spark.createDataFrame([("k",), ("z",)], "key string"), old, "n").collect()} == {"k": "2", "z": None}


def test_enrich(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert enrich.retrying(flaky, sleep=lambda s: None)("a") == "ok"
    asked = spark.createDataFrame([("cat",), ("cat",), ("dog",)], "key string")
    answers = enrich.answer(asked, lambda k: k.upper() if k == "cat" else None)
    got = enrich.with_answers(asked, answers, "key", "m", enrich.generic_meaning(F.col("key"))).collect()
    assert sorted((r["key"], r["m"]) for r in got) == [("cat", "CAT"), ("cat", "CAT"), ("dog", "dog의 의미")]
    for answer, fits in [('{"fits": false}', False), ("It is true", True), ("no", False), (None, True)]:
        assert one(spark, enrich.verdict(F.col("v").cast("string")), v=answer) is fits


def test_baseline(spark):
    none = spark.createDataFrame([], "w string")
    assert tuple(difficulty.baseline(none).first()) == (5.0, 3.5)
    some = spark.createDataFrame([("cat",), ("give up",)], "w string")
    assert tuple(difficulty.baseline(some).first()) == (6.0, 5.5)
    assert tuple(difficulty.baseline(some, spark.createDataFrame([("cat", 4.0)], "word string, score double")).first()) == (4.0, 3.0)
