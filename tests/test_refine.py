"""Refinement, verdicts and repairs on small cases."""

import json

from pyspark.sql import functions as F

from lexmill.functions import rules, text
from lexmill.operators import quality, refine

LISTS = "word string, source string, synonyms array<string>, antonyms array<string>"


def test_service_lists_are_joined_in_order(spark):
    rows = [
        ("Fast", "merriam", ["rapid", "speedy"], None), ("fast", "datamuse", ["quick", "x", "fast"], ["slow"]), (None, "datamuse", ["no"], []), ("fast", "other", [f"word{chr(97 + i)}" for i in range(26)], []),
    ]
    (got,) = refine.service_lists(spark.createDataFrame(rows, LISTS)).collect()
    assert got["word"] == "fast" and got["api_synonyms"][:3] == ["quick", "rapid", "speedy"] and len(got["api_synonyms"]) == 3 + 20 and got["api_antonyms"] == ["slow"]
    assert refine.service_lists(spark.createDataFrame([], LISTS)).count() == 0


def test_base_forms(spark):
    services = spark.createDataFrame([("go", ["walks", "move"], ["stay"]), ("run", ["move", "jog"], None)], "word string, api_synonyms array<string>, api_antonyms array<string>").withColumn("api_antonyms", F.coalesce("api_antonyms", F.expr(refine.NONE)))
    requests = refine.base_form_requests(services, size=2)
    batches = [r["words"] for r in requests.collect()]
    assert sorted(w for b in batches for w in b) == ["jog", "move", "stay", "walks"] and max(map(len, batches)) <= 2
    known = spark.createDataFrame([("move", True)], "word string, is_base boolean")
    assert sorted(w for r in refine.base_form_requests(services, known).collect() for w in r["words"]) == ["jog", "stay", "walks"]
    one = spark.createDataFrame([("a", ["jog", "walks", "stay"]), ("b", ["move"]), ("c", ["err"])], "key string, words array<string>")
    said = spark.createDataFrame([("a", "```json\n" + json.dumps({"jog": True, "walks": False}) + "\n```"), ("c", "no json")], "key string, response string")
    forms = refine.base_forms(one, said)
    assert {r["word"]: r["is_base"] for r in forms.collect()} == {"jog": True, "walks": False, "stay": False, "move": False, "err": False}
    kept = {r["word"]: r["api_synonyms"] for r in refine.candidates(services, forms=forms).collect()}
    assert kept == {"go": [], "run": ["jog"]}
    # without the check every form passes; contextual lists come first
    assert {r["word"]: r["api_synonyms"] for r in refine.candidates(services).collect()} == {"go": ["walks", "move"], "run": ["move", "jog"]}
    contextual = spark.createDataFrame([("Run", ["sprint"], ["halt"])], "word string, synonyms array<string>, antonyms array<string>")
    both = {r["word"]: (r["api_synonyms"], r["api_antonyms"]) for r in refine.candidates(services, contextual).collect()}
    assert both["run"] == (["sprint", "move", "jog"], ["halt"]) and both["go"][0] == ["walks", "move"]


WB = "entry_id bigint, word string, context string, pos string, synonyms string, antonyms string, contextual_meaning string, synonym_confidence double, process_method string, inclusion_reason string, meaning_ko string"


def test_refined_rows(spark):
    rows = [(1, "fast", "c", "a", "quick, rapid, swift", "slow", "", 0.8, "m", "r", "x"), (2, "go", None, None, "move", "", None, 0.8, "m", "r", None), (3, None, None, None, "x", None, None, 0.5, "m", "r", None), (4, "idle", "", "", None, "nan", "", 0.0, "m", "r", "")]
    wb = spark.createDataFrame(rows, WB)
    answer = {"final_synonyms": ["rapid", "RAPID", "quickly"], "final_antonyms": [], "contextual_meaning": "speedy", "contextual_confidence": 1.7, "reasoning": "why"}
    key = wb.filter("entry_id = 1").select(text.cache_key(F.col("word"), F.col("context"), F.col("pos"))).first()[0]
    detail = refine.refined(wb, answers=spark.createDataFrame([(key, json.dumps(answer)), ("other", "x")], "key string, response string"))
    got = {r["entry_id"]: r for r in detail.collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["synonyms"], got[1]["antonyms"], got[1]["contextual_meaning"], got[1]["synonym_confidence"], got[1]["inclusion_reason"]) == ("rapid, quickly", "", "speedy", 1.0, "why")
    assert (got[2]["synonyms"], got[2]["synonym_confidence"], got[2]["method"], got[2]["inclusion_reason"]) == ("move", 0.3, "api_only_fallback_enhanced", "r")
    assert (got[3]["synonyms"], got[3]["n_api_synonyms"]) == ("x", 0)
    stats = refine.statistics(detail).first()
    assert (stats["n_rows"], stats["n_api_synonyms"], stats["n_final_synonyms"], stats["synonym_adoption"], stats["high_confidence"]) == (3, 4, 3, 75.0, 1)
    assert "75.0%" in refine.report(refine.statistics(detail)) and len(refine.comparison(detail).columns) == 12
    empty = refine.statistics(refine.refined(wb.limit(0))).first()
    assert empty["n_rows"] == 0 and empty["improvement_rate"] == 0.0


def test_small_columns(spark):
    row = spark.range(1).select(
        text.clean_list(F.lit("a, bb,, ccc ,dd,ee")).alias("list"),
        text.labelled_lists(F.lit("동의어: a, b\nAntonyms: c d\nSynonyms: x, y")).alias("labelled"),
        text.text_lists(F.lit('the Synonyms are: "fast, quick"\nantonyms: slow')).alias("loose"),
        refine.validated_synonyms(F.array(*map(F.lit, "abc")), F.lit('{"validated_synonyms": ["b"]}')).alias("judged"),
        refine.validated_synonyms(F.array(*map(F.lit, "abc")), F.lit(None).cast("string")).alias("unjudged"),
        refine.guarded_root_dedup(F.array(*[F.lit(x) for x in ("jumping", "jumped", "is", "Is", None)]), F.lit("go")).alias("roots"),
        rules.valid_result(F.lit('{"original": 1, "meaning": null}')).alias("ok"),
        rules.valid_result(F.lit("[1]")).alias("bad"),
        text.md5_suffix(F.lit("id")).alias("suffix"),
    ).first()
    assert row["list"] == "bb, ccc, dd" and tuple(row["labelled"]) == ("x,y", "cd") and tuple(row["loose"]) == ("fast, quick", "slow")
    assert row["judged"] == ["b"] and row["unjudged"] == ["a", "b"] and row["roots"] == ["jumping", "is"]
    assert row["ok"] and not row["bad"] and len(row["suffix"]) == 8
    senses = refine.senses(spark.createDataFrame([('{"contextual_meaning": "m"}',), (None,), ("x",)], "response string")).collect()
    assert [(r["contextual_meaning"], r["semantic_field"], r["meaning_certainty"]) for r in senses] == [("m", "general", 0.5), ("", "general", 0.5), ("", "general", 0.5)]
    lists = spark.createDataFrame([("fast", ["quick", "swift", "rapid"], ["slow", "slowly", "lazy"], '{"validated_synonyms": ["swift", "swiftly"]}')], "word string, synonyms array<string>, antonyms array<string>, response string")
    (r,) = refine.contextual_lists(lists).collect()
    assert r["synonyms"] == ["swift"] and r["antonyms"] == ["slow"]


def test_verdicts_without_an_answer_pass(spark):
    wb = spark.createDataFrame([(i, "p", f"w{i}", "뜻", "c" * 120) for i in range(6)] + [(9, "p", None, "뜻", "c")], "entry_id bigint, passage_id string, word string, meaning_ko string, context string")
    keys = {r["entry_id"]: r["k"] for r in wb.select("entry_id", quality.verdict_key(F.col("word"), F.col("meaning_ko"), F.col("context")).alias("k")).collect()}
    said = [(keys[0], '{"is_appropriate": false, "severity": "low", "explanation": "e"}'), (keys[1], "no, wrong"), (keys[2], "that is true"), (keys[3], '{"severity": "high"}'), (keys[4], None)]
    got = {r["entry_id"]: (r["severity"], r["analysis"], len(r["context"])) for r in quality.verdict_issues(wb, spark.createDataFrame(said, "key string, response string"), True).collect()}
    assert got == {0: ("low", "e", 103), 1: ("medium", "", 103)}
