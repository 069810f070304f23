import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.operators import cache, lexicon
from lexmill.plans import pipelines
from lexmill.sources import readers, sinks
from lexmill.streaming import stream


def test_legacy_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("지문,번호\n안녕하세요 반갑습니다,1\n".encode("cp949"))
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.select("지문", "번호").collect()] == [("안녕하세요 반갑습니다", "1")]
    (tmp_path / "b.csv").write_text("content,x\n\"a, b\",2\n", encoding="utf-8-sig")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("a, b", "2")]


def test_passages(spark):
    df = spark.createDataFrame([(1, "  ten chars!  ", None, 7), (2, "123456789", "s", 7), (3, None, "s", 7), (4, "a good text", "S1", None)], "n bigint, Content string, textbook_studio_passage_id string, textbook_id bigint")
    assert readers.find_text_column(df) == "Content"
    rows = {r["n"]: (r["id"], r["content"]) for r in readers.passages(df, order_col="n").collect()}
    assert rows == {1: ("text_7", "ten chars!"), 4: ("S1", "a good text")}
    plain = spark.createDataFrame([("k", "word " * 20)], "a string, b string")
    assert readers.find_text_column(plain) == "b"


def test_idiom_files(spark, tmp_path):
    (tmp_path / "i.txt").write_text("level 2 idea\n# comment here\none\ntop-notch idea\n")
    (tmp_path / "i.csv").write_text("phrase\nlevel 2 idea\nTop-notch idea\na b c d e f g h i\n")
    got = sorted(r[0] for r in readers.idiom_directory(spark, str(tmp_path / "*.csv"), str(tmp_path / "*.txt")).collect())
    assert got == ["level 2 idea", "top-notch idea"]
    (tmp_path / "e.txt").write_text("")
    (tmp_path / "j.csv").write_text("no,Idiom\n1,by and large\n")
    summary = {r["file"].rsplit("/", 1)[1]: (r["n_rows"], r["status"]) for r in readers.directory_summary(spark, str(tmp_path / "*.csv"), str(tmp_path / "*.txt"), (str(tmp_path / "gone.xlsx"),)).collect()}
    assert summary == {"i.txt": (4, "success"), "e.txt": (0, "empty"), "i.csv": (3, "success"), "j.csv": (1, "success"), "gone.xlsx": (0, "failed")}
    # the column of phrases is chosen by each file's own header; the result is sorted
    every = [r[0] for r in readers.idiom_directory(spark, str(tmp_path / "*.csv"), str(tmp_path / "*.txt")).collect()]
    assert every == ["by and large", "level 2 idea", "top-notch idea"]


def test_excel_without_a_reader_is_an_error(spark, tmp_path, monkeypatch):
    def none(*_, **__):
        raise ImportError("no engine")

    monkeypatch.setattr(pd, "read_excel", none)
    with pytest.raises(RuntimeError):
        readers.read_excel_sheets("x.xlsx")
    with pytest.raises(RuntimeError):
        readers.idiom_directory(spark, xlsx_paths=("x.xlsx",))
    assert readers.idiom_directory(spark, xlsx_paths=("x.xlsx",), tolerant=True).count() == 0
    monkeypatch.setattr(pd, "read_excel", lambda *_, **__: {"a": pd.DataFrame({"no": [1], "Phrase": ["by and large"]}), "b": pd.DataFrame()})
    assert [r[0] for r in readers.idiom_directory(spark, xlsx_paths=("x.xlsx",)).collect()] == ["by and large"]


def test_files_of_all_encodings_and_headers(spark, tmp_path):
    """A column that only some files have is kept, whatever their encoding and order; nothing is read as one cell."""
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_bytes("x,z\n가,나\n\"다\n라\",3\n".encode("cp949"))
    (tmp_path / "c.csv").write_text("z,x\n9,8\n", encoding="utf-8-sig")
    (tmp_path / "d.csv").write_text("")
    got = {(r["x"], r["y"], r["z"]) for r in readers.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("1", "2", None), ("가", None, "나"), ("다\n라", None, "3"), ("8", None, "9")}
    (tmp_path / "e.csv").write_text("x\n" + "\n".join(map(str, range(5000))))
    split = readers.read_csv(spark, str(tmp_path / "e.csv"), multi_line=False)
    assert split.count() == 5000
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "d.csv"))


def test_json_caches(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"created_at": 86400.0, "app_name": "x"}, "data": {"k:1": {"synonyms": ["a", "나"]}, "b": 2}}))
    (tmp_path / "b.json").write_text(json.dumps({"k": "v"}, indent=2))
    (tmp_path / "c.json").write_text("no json")
    got = {(r["namespace"], r["key"], r["value_json"], r["created_at"].year) for n in ("a", "b", "c", "gone") for r in readers.json_cache(spark, str(tmp_path / f"{n}.json"), n).collect()}
    assert got == {("a", "k:1", '{"synonyms":["a","나"]}', 1970), ("a", "b", "2", 1970), ("b", "k", '"v"', 1970)}
    rows = readers.json_cache(spark, str(tmp_path / "a.json"), "synonyms")
    path = str(tmp_path / "cache")
    assert cache.load(spark, path).count() == 0
    cache.save(rows, path)
    cache.save(rows, path)
    assert cache.load(spark, path).count() == 4 and cache.latest(cache.load(spark, path)).count() == 2
    cache.compacted(cache.load(spark, path), str(tmp_path / "small"))
    assert cache.load(spark, str(tmp_path / "small")).count() == 2
    assert cache.file_name("app", "kind") == "app_kind.json" and cache.file_name("app", "kind", "id") == f"app_kind_{hashlib.md5(b'id').hexdigest()[:8]}.json"
    log = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", True)], "namespace string, hit boolean")
    assert {tuple(r) for r in cache.usage(log).collect()} == {("a", 3, 1, 33.33), ("b", 1, 1, 100.0)}


def test_word_lists(spark, tmp_path):
    (tmp_path / "oxford_3000.txt").write_text("Alpha\n\n beta \n")
    got = readers.external_lists(spark, str(tmp_path))
    assert {r["term"] for r in got.filter("source = 'oxford'").collect()} == {"alpha", "beta"} and got.filter("source = 'coca'").count() > 80
    stop = spark.createDataFrame([("The",), (None,)], "w string")
    easy = {r[0] for r in readers.easy_words(None, stop.limit(0), stopwords=stop).collect()}
    assert {"the", "young", "know"} <= easy and len(easy) > 100
    assert readers.easy_words(None, stop).count() == 2
    with pytest.raises(ValueError):
        readers.easy_words(None)


def test_a_limit_takes_the_same_sentences_in_every_run(spark):
    raw = spark.createDataFrame([(str(i), "eng", f"sentence number {i}") for i in range(200, 0, -1)], "id string, lang string, sentence string").repartition(7)
    for _ in range(2):
        assert {r[0] for r in readers.phrases_of(raw, limit=3, id_col="id").collect()} == {f"sentence number {i}" for i in (1, 2, 3)}
    with pytest.raises(ValueError):
        readers.phrases_of(raw, limit=3)


def test_lexicon(spark):
    df = spark.createDataFrame([("Give up",), (" spaced ",), (None,), ("give up",), ("well-known",)], "term string")
    assert sorted(tuple(r) for r in lexicon.split_lexicon(df).collect()) == [("give up", "idiom", 2), ("spaced", "word", 1), ("well-known", "word", 1)]


def test_sentences(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("id\tlang\tsentence\n1\teng\tHello there\n2\tdeu\tGuten Tag\n3\teng\tOne\n4\teng\t\n5\teng\n")
    assert [r[0] for r in readers.sentences(spark, str(tmp_path / "s.tsv")).collect()] == ["Hello there"]
    local = spark.createDataFrame([("hello there",), ("Hello there",)], "idiom string")
    remote = spark.createDataFrame([("Hello there",), ("good day",)], "phrase string")
    assert {r["phrase"]: r["source"] for r in pipelines.phrase_corpus(local, remote).collect()} == {"hello there": "local", "Hello there": "local", "good day": "remote"}


def test_workbook_round_trip(spark, tmp_path):
    wb = readers.workbook(spark.createDataFrame([("p", "cat"), ("p", "dog")], "`지문ID` string, `단어` string"), order_col="word")
    assert wb.select("seq", "confidence", "synonyms").first() == (1, 0.8, "")
    sinks.write_workbook(wb, str(tmp_path / "wb"))
    again = readers.workbook(spark.read.parquet(str(tmp_path / "wb")))
    assert again.columns == wb.columns and again.count() == 2
    sinks.write_workbook(wb, str(tmp_path / "csv"), "csv")


def test_patterns_written(spark, tmp_path):
    df = spark.createDataFrame([("look at the red hat and look at the red cat",)] * 3, "content string")
    sinks.write_patterns(pipelines.mine_patterns(df), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "by_length")).filter("length = 2").count() > 0


def test_stream(spark, tmp_path):
    rows = [(1, "red hat red", "a", "2024-01-01 10:00:00"), (2, "hat", "a", "2024-01-01 11:00:00"), (3, "cat", "b", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "row_id bigint, content string, textbook_studio_passage_id string, at string").withColumn("ingested_at", F.col("at").cast("timestamp_ntz")).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    source = stream.passages(spark, str(tmp_path / "in"), df.schema)
    q = stream.running_counts(source).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r["lemma"]: r["n"] for r in spark.table("counts").collect()} == {"red": 2, "hat": 2, "cat": 1}
    q = stream.windowed_counts(source).writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n_passages"] for r in spark.table("windows").collect()) == [1, 2]
    q = stream.each_batch(stream.first_deliveries(source), lambda b: b.select("row_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_aliases_and_bare_texts(spark):
    df = spark.createDataFrame([("Cat", "고양이", "p1", "kitty")], "base_form string, `한글뜻` string, source_id string, Synonym string").withColumnRenamed("base_form", "원형")
    (row,) = readers.workbook(df).collect()
    assert (row["base_form"], row["meaning_ko"], row["passage_id"], row["synonyms"]) == ("Cat", "고양이", "p1", "kitty")
    other = spark.createDataFrame([("Cat", "c")], "original string, sentence string")
    (row,) = readers.workbook(other).collect()
    assert (row["word"], row["context"]) == ("Cat", "c")
    made = readers.text_passages(spark.createDataFrame([("some text",), (None,)], "content string"))
    assert {r["book_title"] for r in made.collect()} == {"Advanced Vocabulary"} and set(readers.METADATA) <= set(made.columns)


def test_spreadsheet_sink(spark, tmp_path, monkeypatch):
    wb = readers.workbook(spark.createDataFrame([("cat",)], "word string"))
    asked = []
    monkeypatch.setattr(pd.DataFrame, "to_excel", lambda self, path, index: asked.append((list(self.columns)[5], path)))
    sinks.write_workbook(wb, "x.xlsx", "xlsx")
    assert asked == [("단어", "x.xlsx")]

    def none(*_, **__):
        raise ModuleNotFoundError("no writer")

    monkeypatch.setattr(pd.DataFrame, "to_excel", none)
    with pytest.raises(RuntimeError):
        sinks.write_workbook(wb, "x.xlsx", "xlsx")
    monkeypatch.setattr(fixed, "SHEET_ROWS", 0)
    with pytest.raises(ValueError):
        sinks.write_workbook(wb, "x.xlsx", "xlsx")
