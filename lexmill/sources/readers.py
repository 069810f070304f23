"""Readers: passages, lexicons, phrase lists, workbooks, caches; legacy encodings included."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import fixed, text
from lexmill.operators import cache, lexicon, quality


def decode(data: bytes, encodings=fixed.ENCODINGS) -> str | None:
    """First encoding that decodes; a byte order mark is dropped."""
    for e in encodings:
        try:
            return data.decode(e).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return None


#: Java's names of encodings that Python names otherwise (fixed values).
JAVA_NAMES = {"cp949": "x-windows-949", "latin1": "ISO-8859-1", "utf-8-sig": "UTF-8"}


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a path, glob or folder, empty ones included; hidden ones are passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(where) or ():
        inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [s.getPath().toString() for s in inside if not s.isDirectory() and s.getPath().getName()[0] not in "._"]
    return sorted(re.sub("^file:/+", "/", f) for f in out)


def _file_name() -> Column:
    """Name of the file of a row, as :func:`files` writes it."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def _file_encodings(spark: SparkSession, path: str, encodings) -> dict[str, str]:
    """The first encoding that decodes every line of each file; lines are tested where they are read."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [[_decodes(line, e) for line in batch.column(1).to_pylist()] for e in encodings]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(zip(*ok)), pa.list_(pa.bool_()))], names=["file", "ok"])

    lines = spark.read.text(path).select(_file_name().alias("file"), F.col("value").cast("binary").alias("line"))
    # most lines are valid in UTF-8, which needs no worker
    odd = lines.filter(~F.expr("is_valid_utf8(CAST(line AS STRING))"))
    flags = odd.mapInArrow(test, "file string, ok array<boolean>").groupBy("file")
    tested = {r["file"]: r for r in flags.agg(*[F.bool_and(F.get("ok", F.lit(i))).alias(e) for i, e in enumerate(encodings)]).collect()}
    out = {}
    for file in files(spark, path):
        row = tested.get(file)
        out[file] = "utf-8" if row is None else next((e for e in encodings if row[e]), encodings[-1])
    return out


def _decodes(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _first_line(spark: SparkSession, path: str, encoding: str) -> str | None:
    """The first line of a file, by one short read of the driver; None where the file is empty."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(
        jvm.java.io.InputStreamReader(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where), JAVA_NAMES.get(encoding, encoding))
    )
    try:
        return reader.readLine()
    finally:
        reader.close()


def csv_tables(spark: SparkSession, path: str, encodings=fixed.ENCODINGS, sep: str = ",", multi_line: bool = True) -> list[tuple[list[str], DataFrame]]:
    """(files, table) for each combination of encoding and header among the CSV files of ``path``; columns are strings.

    Spark reads every file in its own encoding. With ``multi_line`` false no value may hold a line break,
    and large files are split. Empty files are left out.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    if not files(spark, path):
        return []
    for file, encoding in sorted(_file_encodings(spark, path, encodings).items()):
        head = _first_line(spark, file, encoding)
        if head is not None and head.strip("\ufeff \r"):
            groups.setdefault((encoding, head.strip("\ufeff\r")), []).append(file)
    out = []
    if any(encoding in ("cp949", "euc-kr") for encoding, _ in groups):
        # allows encodings beyond Spark's own few
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for (encoding, _), named in groups.items():
        table = spark.read.csv(named, header=True, sep=sep, multiLine=multi_line, escape='"', encoding=JAVA_NAMES.get(encoding, encoding), enforceSchema=True)
        out.append((named, table.toDF(*[c.strip("\ufeff").strip() for c in table.columns])))
    return out


def read_csv(spark: SparkSession, path: str, encodings=fixed.ENCODINGS, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """CSV files of any of the encodings and any headers as one table of strings; a file without a column has nulls there."""
    tables = [t for _, t in csv_tables(spark, path, encodings, sep, multi_line)]
    if not tables:
        raise ValueError(f"no CSV file with a header in {path}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def find_text_column(df: DataFrame) -> str:
    """Column of the texts: by name, by part of the name, by mean length over 50, else the first text column."""
    strings = [c for c, t in df.dtypes if t == "string"]
    lower = {c.lower(): c for c in reversed(df.columns)}
    for name in fixed.TEXT_COLUMNS:
        if name in lower:
            return lower[name]
    for c in df.columns:
        if any(part in c.lower() for part in ("content", "text", "passage", "body")):
            return c
    if not strings:
        raise ValueError("no text column")
    means = df.agg(*[F.coalesce(F.avg(F.length(F.col(f"`{c}`"))), F.lit(0.0)).alias(str(i)) for i, c in enumerate(strings)]).first()
    best = max(range(len(strings)), key=lambda i: (means[i], -i))
    return strings[best] if means[best] > 50 else strings[0]


METADATA = (
    "textbook_id", "product_id", "textbook_studio_passage_id", "textbook_unit_id", "book_title", "studio_title", "studio_series",
    "studio_title2", "textbook_studio_passage_title", "passage_order",
)


def passages(df: DataFrame, text_col: str | None = None, order_col: str | None = None, min_chars: int = 10) -> DataFrame:
    """(id, content, metadata): bodies stripped, those under ``min_chars`` left out.

    The id is the studio id, else text_ and the textbook id, else text_ and the row number in the
    order of ``order_col``; absent metadata columns are null.
    """
    col = text_col or find_text_column(df)
    body = text.strip(F.col(col))
    if "textbook_studio_passage_id" in df.columns:
        own: Column = F.col("textbook_studio_passage_id").cast("string")
    else:
        own = F.lit(None).cast("string")
    if "textbook_id" in df.columns:
        fallback = F.concat(F.lit("text_"), F.coalesce(F.col("textbook_id").cast("string"), F.lit("nan")))
    elif order_col:
        fallback = F.concat(F.lit("text_"), F.col(order_col).cast("string"))
    else:
        fallback = F.concat(F.lit("text_"), F.monotonically_increasing_id().cast("string"))
    meta = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in METADATA]
    keep = [F.col(order_col)] if order_col and order_col not in METADATA else []
    return df.select(*keep, F.coalesce(own, fallback).alias("id"), body.alias("content"), *meta).filter(F.length("content") >= min_chars)


def phrase_column(columns: list[str]) -> str:
    """First column in file order with a name for phrases, else the first."""
    return next((c for c in columns if c.lower() in fixed.PHRASE_COLUMNS), columns[0])


def _phrase_tables(spark: SparkSession, csv_glob: str | None, txt_glob: str | None, xlsx_paths: tuple[str, ...], tolerant: bool):
    """(file, phrases, error): phrases of each CSV header, of all TXT files, of each Excel sheet."""
    for named, table in csv_tables(spark, csv_glob) if csv_glob else ():
        yield named, lexicon.idiom_filter(table, phrase_column(table.columns)), table, None
    if txt_glob and files(spark, txt_glob):
        lines = spark.read.text(txt_glob)
        yield None, lexicon.idiom_filter(lines, "value", alphabetic=False), lines, None
    for path in xlsx_paths:
        try:
            for sheet in read_excel_sheets(path):
                table = spark.createDataFrame(sheet.astype("string").astype(object).where(lambda d: d.notna(), None))
                yield [path], lexicon.idiom_filter(table, phrase_column(table.columns)), table, None
        except (RuntimeError, ValueError, OSError) as error:
            if not tolerant:
                raise
            yield [path], None, None, str(error)


def idiom_directory(
    spark: SparkSession, csv_glob: str | None = None, txt_glob: str | None = None, xlsx_paths: tuple[str, ...] = (), tolerant: bool = False
) -> DataFrame:
    """(phrase), distinct and sorted, of all CSV, TXT and Excel files; the column is chosen by each file's own header.

    A file that can't be read is an error, unless ``tolerant``; then :func:`directory_summary` names it.
    """
    parts = [phrases for _, phrases, _, error in _phrase_tables(spark, csv_glob, txt_glob, xlsx_paths, tolerant) if error is None]
    out = spark.createDataFrame([], "phrase string")
    for p in parts:
        out = out.unionByName(p)
    return out.distinct().orderBy("phrase")


def read_excel_sheets(path: str) -> list[pd.DataFrame]:
    """All sheets of a spreadsheet that have columns; needs an optional reader, and says so where there is none."""
    try:
        return [d for d in pd.read_excel(path, sheet_name=None).values() if len(d.columns)]
    except ImportError as error:
        raise RuntimeError(f"no reader of Excel files is installed, {path} can't be read") from error


def directory_summary(spark: SparkSession, csv_glob: str | None = None, txt_glob: str | None = None, xlsx_paths: tuple[str, ...] = ()) -> DataFrame:
    """(file, n_rows, status, error): each file of the directory, success, empty or failed; of text files the lines that are not blank."""
    schema = "file string, n_rows bigint, status string, error string"
    out = spark.createDataFrame([], schema)

    def add(counts: DataFrame) -> None:
        nonlocal out
        n = F.col("n_rows")
        out = out.unionByName(counts.select("file", n, F.when(n > 0, "success").otherwise("empty").alias("status"), F.lit(None).cast("string").alias("error")))

    for glob, text_ in ((csv_glob, False), (txt_glob, True)):
        if not glob or not files(spark, glob):
            continue
        every = spark.createDataFrame([(f,) for f in files(spark, glob)], "file string")
        lines = spark.read.text(glob).select(_file_name().alias("file"), "value").filter(F.length(F.trim("value")) > 0)
        counts = lines.groupBy("file").agg(F.count("*").alias("n"))
        # the header of a table is no row
        n = F.greatest(F.coalesce("n", F.lit(0)) - (0 if text_ else 1), F.lit(0))
        add(every.join(counts, "file", "left").select("file", n.alias("n_rows")))
    rows = []
    for path in xlsx_paths:
        try:
            n = sum(len(d) for d in read_excel_sheets(path))
            rows.append((path, n, "success" if n else "empty", None))
        except (RuntimeError, ValueError, OSError) as error:
            rows.append((path, 0, "failed", str(error)))
    return out.unionByName(spark.createDataFrame(rows, schema))


def json_cache(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """Key-value rows of a JSON cache file, as in :data:`lexmill.operators.cache.SCHEMA`.

    A file with ``metadata`` and ``data`` is unwrapped and dated by its metadata; else its top keys are the keys.
    A file that is missing or no JSON object gives no rows.
    """
    empty = spark.createDataFrame([], cache.SCHEMA)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return empty
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    parsed = whole.select("j", F.get_json_object("j", "$.data").alias("data"), F.get_json_object("j", "$.metadata.created_at").cast("double").alias("at"))
    body = F.when(F.col("data").startswith("{"), F.col("data")).otherwise(F.col("j"))
    # variants keep each value as it is written
    pairs = parsed.select("at", body.alias("b")).filter(F.expr("try_parse_json(b) IS NOT NULL") & F.ltrim("b").startswith("{"))
    rows = pairs.select("at", F.explode(F.from_json("b", "map<string,variant>")).alias("key", "v"))
    created = F.coalesce(F.timestamp_seconds("at"), F.lit(0).cast("timestamp"))
    return rows.select(F.lit(namespace).alias("namespace"), "key", F.to_json("v").alias("value_json"), created.alias("created_at"))


def word_list(spark: SparkSession, path: str, default: tuple[str, ...]) -> DataFrame:
    """(term): the lines of a word list in lower case, else the words of ``default`` where there is no such file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        lines = spark.read.text(path)
    else:
        lines = spark.createDataFrame([(w,) for w in default], "value string")
    return lines.select(F.lower(text.strip(F.col("value"))).alias("term")).filter("term <> ''").distinct()


def external_lists(spark: SparkSession, folder: str = "data") -> DataFrame:
    """(term, source) of the three external lists, from files of ``folder`` or else the built-in parts of them."""
    out = spark.createDataFrame([], "term string, source string")
    for name, (file, default) in fixed.EXTERNAL_LISTS.items():
        out = out.unionByName(word_list(spark, f"{folder}/{file}", default).withColumn("source", F.lit(name)))
    return out


def easy_words(*candidates: DataFrame | None, default: DataFrame | None = None, stopwords: DataFrame | None = None) -> DataFrame:
    """The first list that holds anything, else ``default``, else stop words with the basic words and a few more."""
    for c in candidates:
        if c is not None and not c.isEmpty():
            return c
    if default is not None:
        return default
    if stopwords is None:
        raise ValueError("no list of easy words, and no stop words to begin one with")
    spark = stopwords.sparkSession
    own = spark.createDataFrame([(w,) for w in (*fixed.BASIC_WORDS, *fixed.EASY_EXTRA)], "term string")
    return stopwords.select(F.lower(text.strip(F.col(stopwords.columns[0]))).alias("term")).unionByName(own).filter("term <> ''").distinct()


def sentences(spark: SparkSession, path: str, language: str = "eng", limit: int | None = None) -> DataFrame:
    """(phrase) of a sentence TSV (id, language, sentence; the first line is skipped): 2 to 15 words of one language."""
    raw = spark.read.csv(path, sep="\t", schema="id string, lang string, sentence string", header=True, quote="", enforceSchema=True)
    return phrases_of(raw, language, limit, id_col="id")


def phrases_of(
    raw: DataFrame, language: str = "eng", limit: int | None = None, lang_col: str = "lang", text_col: str = "sentence", id_col: str | None = None
) -> DataFrame:
    """(phrase) of 2 to 15 words of one language; with a ``limit`` the first by ``id_col``, so every run takes the same."""
    body = text.strip(F.col(text_col))
    rows = raw.filter(F.col(lang_col) == language).withColumn("phrase", body).filter((F.length("phrase") > 0) & F.size(F.split("phrase", r"\s+")).between(2, 15))
    if limit is not None:
        if id_col is None:
            raise ValueError("a limit needs the column to order by")
        rows = rows.orderBy(F.col(id_col).try_cast("bigint"), id_col, "phrase").limit(limit)
    return rows.select("phrase")


def phrase_corpus(*parts: DataFrame) -> DataFrame:
    """(phrase, definition, example, source) of parts in order of precedence; each phrase once, from the first part that has it."""
    rows = None
    for i, p in enumerate(parts):
        shaped = p.select("phrase", *[(F.col(c) if c in p.columns else F.lit("")).alias(c) for c in ("definition", "example", "source")], F.lit(i).alias("_o"))
        rows = shaped if rows is None else rows.unionByName(shaped)
    first = F.min(F.struct("_o", "definition", "example", "source"))
    return rows.groupBy("phrase").agg(first.alias("_f")).select("phrase", "_f.definition", "_f.example", "_f.source")


def text_passages(texts: DataFrame, text_col: str = "content", order_col: str | None = None) -> DataFrame:
    """Bare texts as a passage table: no ids, and the title that texts without metadata get."""
    meta = {c: F.lit(None).cast("string") for c in METADATA} | {"book_title": F.lit(fixed.DEFAULT_TITLE)}
    row = F.col(order_col).cast("bigint") if order_col else F.monotonically_increasing_id()
    return texts.select(row.alias("row_id"), F.col(text_col).cast("string").alias("content"), *[v.alias(c) for c, v in meta.items()])


#: Internal names of the logical columns of the quality check.
LOGICAL = {"word": "word", "meaning": "meaning_ko", "context": "context", "passage_id": "passage_id", "synonyms": "synonyms", "antonyms": "antonyms"}


def workbook(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """A workbook with all 22 columns: sheet names and known aliases become internal ones, absent columns get their defaults."""
    names = {sheet: name for name, sheet, _ in fixed.WORKBOOK}
    for c in df.columns:
        if c in names:
            df = df.withColumnRenamed(c, names[c])
    for logical, column in quality.resolve(df.columns).items():
        if logical in LOGICAL and LOGICAL[logical] not in df.columns and column not in fixed.WORKBOOK_NAMES:
            df = df.withColumnRenamed(column, LOGICAL[logical])
    defaults = {"textbook_id": F.lit(1.0), "is_separated": F.lit(False), "confidence": F.lit(0.8), "user_db_match": F.lit(False), "synonym_confidence": F.lit(0.0)}
    if "seq" not in df.columns and order_col:
        per = Window.partitionBy("passage_id") if "passage_id" in df.columns else Window.partitionBy(F.lit(1))
        df = df.withColumn("seq", F.row_number().over(per.orderBy(order_col)))
    extra = [c for c in df.columns if c not in fixed.WORKBOOK_NAMES]
    shaped = [(F.col(n) if n in df.columns else defaults.get(n, F.lit("") if t == "string" else F.lit(None))).cast(t).alias(n) for n, _, t in fixed.WORKBOOK]
    return df.select(*extra, *shaped)
