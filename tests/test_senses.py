"""Best senses against every pair scored one by one, and on many meanings and senses of one word."""

import random
import re
import time

from pyspark.sql import functions as F

from lexmill.operators import annotate


def by_hand(asked, senses):
    def words(s):
        return {w for w in re.split(r"[^a-zA-Z0-9_]+", (s or "").lower()) if w}

    out = []
    for word, meaning in set(asked):
        scored = [(-len(words(meaning) & words(g)) - 0.5 * len(words(meaning) & words(" ".join(e or []))), n) for w, _, n, g, e, *_ in senses if w is not None and w.lower() == word]
        if not (meaning or "").strip(" "):
            kept = sorted(scored, key=lambda x: x[1])[:2]
        else:
            kept = sorted(x for x in scored if x[0] < -0.1)[:2] or sorted(scored, key=lambda x: x[1])[:1]
        out += [(word, meaning, n, -s) for s, n in kept]
    return sorted(out, key=str)


def test_every_pair(spark):
    some = random.Random(7)
    pool = ["red", "hat", "A", "the", "cat's", "x_1", "개", "ÉTÉ", "?", "run"]

    def text(most):
        return some.choice([None, "", "  ", "개", "..."]) if some.random() < 0.2 else " ".join(some.choices(pool, k=some.randint(0, most)))

    senses = [(some.choice(["Big", "big", "run", "cat", "unasked", None]), "n", k, text(3), some.choice([None, [], [text(6) or "", text(4) or ""]]), [], []) for k in some.sample(range(1000), 120)]
    asked = [(some.choice(["big", "run", "cat", "unknown", None]), text(7)) for _ in range(300)]
    d, rows = spark.createDataFrame(senses, annotate.DICTIONARY), spark.createDataFrame(asked, "word string, said string")
    want = by_hand([(w, m) for w, m in asked if w is not None], senses)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most, cell_rows in (("10000", 16_384), ("7", 10)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = annotate.best_senses(rows, d, "said", cell_rows=cell_rows)
            assert got.columns == ["word", "said", "sense_no", "score"] and [t for _, t in got.dtypes] == ["string", "string", "int", "double"]
            assert sorted((tuple(r) for r in got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_many_meanings_and_senses_of_a_word(spark):
    n = 4000
    said = F.concat_ws(" ", F.lit("the"), F.concat(F.lit("a"), F.col("id") % 97), F.concat(F.lit("b"), F.col("id") % 41), F.concat(F.lit("c"), F.col("id")))
    asked = spark.range(n).select(F.lit("house").alias("word"), said.alias("meaning"))
    d = spark.range(n).select(F.lit("House").alias("word"), F.lit("n").alias("pos"), F.col("id").cast("int").alias("sense_no"), F.lit("집").alias("gloss"), F.array(said).alias("examples"), F.array().cast("array<string>").alias("synonyms"), F.array().cast("array<string>").alias("antonyms"))
    began = time.time()
    got = annotate.best_senses(asked, d).collect()
    # 16 million pairs: one row for each takes minutes
    assert time.time() - began < 40
    by_meaning = {}
    for r in got:
        by_meaning.setdefault(r["meaning"], []).append((r["score"], r["sense_no"]))
    assert len(by_meaning) == n
    for i in (0, 1, 97, 2500, 3999):
        # itself, then the first other with both a and b, else the first with either
        (kept,) = [v for m, v in by_meaning.items() if m.endswith(f" c{i}")]
        others = [(-0.5 * (1 + (k % 97 == i % 97) + (k % 41 == i % 41)), k) for k in range(n) if k != i]
        assert sorted((-s, k) for s, k in kept) == sorted([(-2.0, i), min(others)])
