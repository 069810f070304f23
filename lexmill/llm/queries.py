"""Queries of the operators for training text, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import formatdup, leakage, mixing, neardup, pii, reading, terms

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(_t(spark, sf_dir, "passages")).filter("mark IS NOT NULL").select("term", "mark")


def p1_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(_t(spark, sf_dir, "passages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(_t(spark, sf_dir, "passages"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_t(spark, sf_dir, "passages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.found(_t(spark, sf_dir, "workbook"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.collapse(_t(spark, sf_dir, "workbook")).select("entry_id", "word", "passage_id", "n_copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.found(_t(spark, sf_dir, "passages"), _t(spark, sf_dir, "reading_labels"))


def p5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(_t(spark, sf_dir, "passages"), _t(spark, sf_dir, "reading_labels"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.found(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(_t(spark, sf_dir, "documents"))
    return mixing.report(sizes, mixing.plan(sizes, _t(spark, sf_dir, "mix_targets")))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))
    return mixed.select("doc_id", "source", "copy_no")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_t(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        p1_found, p1_term_frequency, p3_found, p3_classes, p4_found, p4_collapsed, p5_found, p5_levels,
        p6_found, p7_found, p7_report, p7_mix, p8_found, p8_redacted,
    )
    return {f.__name__: f for f in found}


_TERMS = r"""
t AS (SELECT row_id, unnest(regexp_extract_all(lower(content), '\p{L}+')) AS term FROM passages WHERE content IS NOT NULL),
c AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT row_id) AS n_rows FROM t GROUP BY term),
m AS (SELECT *, CASE WHEN n_rows < 3 THEN 'rare' WHEN n_rows > 0.3 * (SELECT count(content) FROM passages) THEN 'common' END AS mark FROM c)
"""

_ENTRIES = r"""
b AS (SELECT entry_id, word, passage_id, regexp_replace(lower(word), '[^\p{L}\p{N}]+', '', 'g') AS w,
             regexp_replace(lower(passage_id), '[^\p{L}\p{N}]+', '', 'g') AS p FROM workbook),
k AS (SELECT *, regexp_extract_all(p, '\p{L}+\p{N}+') AS parts FROM b),
e AS (SELECT entry_id, word, passage_id, w,
             CASE WHEN len(parts) = 3 AND array_to_string(parts, '') = p THEN array_to_string(list_sort(parts), '-') ELSE p END AS p FROM k),
g AS (SELECT *, min(entry_id) OVER (PARTITION BY w, p) AS first_id, count(*) OVER (PARTITION BY w, p) AS n FROM e
      WHERE w IS NOT NULL AND p IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p1_term_frequency": f"WITH {_TERMS} SELECT term, n_occurrences, n_rows, mark FROM m",
        "p3_found": r"""
            WITH w AS (SELECT row_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM passages),
            g AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
                  FROM w WHERE len(ws) >= 20),
            n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
            o AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
            SELECT row_id_a, row_id_b FROM o JOIN n x ON x.row_id = row_id_a JOIN n y ON y.row_id = row_id_b WHERE o >= 0.6 * (x.n + y.n - o)""",
        "p3_classes": r"""
            WITH RECURSIVE w AS (SELECT row_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM passages),
            g AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5),
            n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
            o AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.row_id <> b.row_id GROUP BY ALL),
            e AS (SELECT a, b FROM o JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE o >= 0.8 * (x.n + y.n - o)),
            r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
            d AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
            SELECT a AS row_id, least(a, min(b)) AS class_id, n_links FROM r JOIN d USING (a) GROUP BY a, n_links""",
        "p4_found": f"WITH {_ENTRIES} SELECT first_id AS entry_id_first, entry_id AS entry_id_copy FROM g WHERE entry_id > first_id",
        "p4_collapsed": f"""WITH {_ENTRIES} SELECT entry_id, word, passage_id, n AS n_copies FROM g WHERE entry_id = first_id
            UNION ALL SELECT entry_id, word, passage_id, 1 FROM workbook WHERE word IS NULL OR passage_id IS NULL""",
        "p6_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
            i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items),
            dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM d WHERE len(ws) >= 12),
            ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i WHERE len(ws) >= 12)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        # no case depends on the tokenizer, so runs of letters, of digits and of marks stand for tokens
        "p7_found": r"""
            WITH n AS (SELECT source, coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')), 0) AS n FROM documents WHERE source IS NOT NULL),
            t AS (SELECT source, sum(greatest(target_weight, 0)) AS w, max(greatest(coalesce(max_repeats, 1), 0)) AS m FROM mix_targets
                  WHERE source IS NOT NULL AND target_weight IS NOT NULL GROUP BY source),
            a AS (SELECT t.source, w, m, coalesce(sum(n), 0) AS size FROM t LEFT JOIN n USING (source) GROUP BY ALL)
            SELECT source FROM a WHERE size * m < w / (SELECT sum(w) FROM a) * (SELECT sum(size) FROM a)""",
    }
