import datetime as dt

from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import rules, text
from lexmill.operators import annotate, cache, spans, synonyms


def test_lemmas(spark):
    pairs = {"cities": "city", "boxes": "box", "cats": "cat", "bus": "bus", "stopped": "stop", "running": "run", "went": "go", "sing": "sing", "children": "child", "tried": "try"}
    df = spark.createDataFrame([(w,) for w in pairs], "w string").select("w", annotate.lemma(F.col("w")).alias("l"))
    assert {r["w"]: r["l"] for r in df.collect()} == pairs


def test_annotated(spark):
    df = spark.createDataFrame([(1, "The cats met Anna quickly")], "row_id bigint, content string")
    rows = annotate.annotated(spans.tokens(df, "row_id", "content"), spark.createDataFrame([("the",)], "t string")).collect()
    assert sorted((r["pos"], r["lemma"], r["tag"], r["is_stop"], r["is_name"]) for r in rows) == [
        (0, "the", "DET", True, False), (1, "cat", "NOUN", False, False), (2, "met", "NOUN", False, False), (3, "anna", "NOUN", False, True), (4, "quickly", "ADV", False, False),
    ]


def test_dictionary(spark):
    d = spark.createDataFrame(
        [("Big", "a", 1, "large in size", ["a big house"], ["large", "great_sized"], ["small"]), ("big", "a", 2, "important in society", [], ["large", "major"], None), ("run", "v", 1, "move fast", [], ["dash"], [])],
        annotate.DICTIONARY,
    )
    words = spark.createDataFrame([("big",), ("zap",)], "word string")
    got = {r["word"]: (r["gloss"], r["synonyms"], r["antonyms"]) for r in annotate.info(words, d).collect()}
    assert got == {"big": ("large in size", ["large", "great sized", "major"], ["small"]), "zap": ("", [], [])}
    assert {r["word"]: r["n_senses"] for r in annotate.sense_counts(words, d).collect()} == {"big": 2, "zap": 0}
    asked = spark.createDataFrame([("big", "important person"), ("big", None), ("big", "zzz")], "word string, meaning string")
    best = sorted((r["meaning"] or "", r["sense_no"]) for r in annotate.best_senses(asked, d).collect())
    assert best == [("", 1), ("", 2), ("important person", 2), ("zzz", 1)]
    cands = spark.createDataFrame([("x", "big", "a"), ("x", "big", "v"), ("x", "zap", None)], "word string, candidate string, pos string")
    assert {(r["candidate"], r["pos"]) for r in annotate.filter_by_pos(cands, d).collect()} == {("big", "a"), ("zap", None)}
    assert annotate.filter_by_pos(cands, annotate.empty_dictionary(spark)).count() == 3


def test_json(spark):
    fields = {"is_separable": "boolean", "verb": "string", "examples": "array<string>", "confidence": "double"}
    rows = [('```json\n{"is_separable": true, "verb": "pick", "examples": ["a"], "confidence": 0.5}\n```',), ('{"is_separable": true, "verb": "pick", "examples": ["a", "b"], "confidence": 0.5, broken',), (None,)]
    got = [tuple(r["j"]) for r in spark.createDataFrame(rows, "c string").select(text.parse_json(F.col("c"), fields).alias("j")).collect()]
    assert got == [(True, "pick", ["a"], 0.5), (True, "pick", ["a", "b"], 0.5), (None, None, None, None)]


def test_filter_and_attach(spark):
    said = rules.database_filter(F.col("w"), F.lit(False), F.lit(None).cast("struct<ok:boolean,reason:string>"), F.struct(F.lit(False).alias("ok"), F.lit("x").alias("reason")))
    got = spark.createDataFrame([("give up",), ("cat",)], "w string").select(said.alias("s")).collect()
    assert [r["s"]["ok"] for r in got] == [True, False]
    wb = spark.createDataFrame([("Cat", "", ""), ("dog", "hound", "")], "word string, synonyms string, antonyms string")
    rec = spark.createDataFrame([(1, "cat", ["old"], [], 1), (2, "cat", ["feline", "kitty"], [], 2)], "record_id int, word string, synonyms array<string>, antonyms array<string>, created_at int")
    assert sorted((r["word"], r["synonyms"], r["synonym_confidence"]) for r in synonyms.attach(wb, rec).collect()) == [("Cat", "feline,kitty", 0.8), ("dog", "hound", 0.8)]


def test_command_line(spark, tmp_path):
    (tmp_path / "p.csv").write_text("content\n\"She tried to give it up, and the analysis was long.\"\n\"The analysis of a well-known idea.\"\n")
    (tmp_path / "w.csv").write_text("word\ngive up\nanalysis\n")
    cli.main(["vocab", "--input", str(tmp_path / "p.csv"), "--output", str(tmp_path / "wb"), "--user-words", str(tmp_path / "w.csv")], spark)
    wb = spark.read.parquet(str(tmp_path / "wb"))
    assert len(wb.columns) == 22
    # the passages have no ids, so the repeated word is no duplicate within a passage
    assert sorted((r["단어"], r["원형"], r["분리형여부"]) for r in wb.collect()) == [("analysis", "analysis", False), ("analysis", "analysis", False), ("give it up", "give ~ up", True)]
    cli.main(["patterns", "--input", str(tmp_path / "p.csv"), "--output", str(tmp_path / "pat")], spark)
    assert spark.read.parquet(str(tmp_path / "pat/all")).count() > 0
    cli.main(["check", str(tmp_path / "wb"), "--issues", str(tmp_path / "issues"), "--repaired", str(tmp_path / "fixed")], spark)
    cli.main(["refine", str(tmp_path / "wb"), "--output-prefix", str(tmp_path / "r")], spark)
    assert {p.name for p in (tmp_path / "r").iterdir()} == {"refined", "detail", "before_after", "report"}
    assert len(spark.read.parquet(str(tmp_path / "r/refined")).columns) == 22 and len(spark.read.parquet(str(tmp_path / "r/before_after")).columns) == 12
    (tmp_path / "loc.csv").write_text("idiom\ngive up\n")
    for _ in range(2):
        cli.main(["phrases", "--local", str(tmp_path / "loc.csv"), "--output", str(tmp_path / "ph"), "--cache-dir", str(tmp_path / "c")], spark)
    assert spark.read.parquet(str(tmp_path / "ph")).count() == 1
    assert spark.read.parquet(str(tmp_path / "issues")).count() > 0 and len(spark.read.parquet(str(tmp_path / "issues")).columns) == 15


def test_command_line_uses_a_cache(spark, tmp_path, monkeypatch):
    passages = "content\n\"She made a remarkable discovery and a sandwich for breakfast.\"\n"
    (tmp_path / "p.csv").write_text(passages)
    (tmp_path / "w.csv").write_text("word\ndiscovery\n")
    rows = [("extraction", "discovery", "발견"), ("difficulty", "sandwich", '{"difficulty_score": 2}'), ("difficulty", "remarkable", '{"difficulty_score": 9, "recommendation": "include"}')]
    kv = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1)) for r in rows], cache.SCHEMA)
    cache.save(kv, str(tmp_path / "kv"))
    cli.main(["vocab", "-i", str(tmp_path / "p.csv"), "-o", str(tmp_path / "wb"), "--user-words", str(tmp_path / "w.csv"), "--profile", "full", "-c", str(tmp_path / "kv"), "--data-dir", str(tmp_path / "none")], spark)
    got = {r["단어"]: r["뜻(한글)"] for r in spark.read.parquet(str(tmp_path / "wb")).collect()}
    assert got["discovery"] == "발견" and "sandwich" not in got and "remarkable" in got
    monkeypatch.setattr(cli, "MASTER_MORE_THAN", 1)
    (tmp_path / "loc.csv").write_text("idiom\ngive up\nby and large\n")
    phrases = ["phrases", "--local", str(tmp_path / "loc.csv"), "-o", str(tmp_path / "ph"), "--cache-dir", str(tmp_path / "c")]
    cli.main(phrases, spark)
    (tmp_path / "loc.csv").write_text("idiom\nin time\n")
    cli.main(phrases, spark)
    assert spark.read.parquet(str(tmp_path / "ph")).count() == 2
    cli.main([*phrases, "--clear-cache"], spark)
    assert spark.read.parquet(str(tmp_path / "ph")).count() == 1


def test_letters_and_single_lemmas(spark):
    df = spark.createDataFrame([("JJ", "good"), ("VBD", "go"), ("NNS", "x"), ("RB", "y"), ("IN", None)], "tag string, w string")
    assert [r[0] for r in df.select(annotate.letter_of_tag(F.col("tag"))).collect()] == ["a", "v", "n", "r", None]
    lists = spark.createDataFrame([(["good", "better off", "fine", "ok", "a-b", "Good"], "good")], "c array<string>, w string")
    assert lists.select(annotate.single_lemmas(F.col("c"), F.col("w"))).first()[0] == ["fine"]
