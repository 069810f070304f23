import random
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from lexmill.llm import terms


def brute(texts, rare=3, common=0.3):
    all_, rows = Counter(), Counter()
    for t in texts:
        if t is not None:
            found = regex.findall(r"\p{L}+", t.lower())
            all_.update(found)
            rows.update(set(found))
    n = sum(t is not None for t in texts)
    return {w: (all_[w], rows[w], "rare" if rows[w] < rare else "common" if rows[w] > common * n else None) for w in rows}


def table(df):
    return {r["term"]: (r["n_occurrences"], r["n_rows"], r["mark"]) for r in df.collect()}


def test_against_brute_force_with_many_splits(spark):
    rng = random.Random(1)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)] + ["Été", "낱말", "x²y", "a_b"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + " the" for _ in range(300)] + [None, "", "the " * 50_000, "İx"]
    df = spark.createDataFrame([(t, 1, 2) for t in texts], "content string, term bigint, n_rows int").repartition(5)
    want = brute(texts)
    assert table(terms.term_frequencies(df)) == want
    # flushes after few terms and leaves of a few rows: splits over several levels, and a term that can't be split
    assert table(terms.term_frequencies(df, leaf_rows=3, flush_at=20)) == want
    assert table(terms.term_frequencies(df, leaf_rows=40, flush_at=20, level_bits=1)) == want


def test_empty(spark):
    df = spark.createDataFrame([], "content string")
    assert terms.term_frequencies(df).count() == 0
    assert terms.term_frequencies(spark.createDataFrame([(None,), ("",), ("12 !",)], "content string")).count() == 0


def test_leaves_follow_the_number_of_terms(spark):
    """As many leaves as distinct terms ask for; the many partial counts of a hot term ask for none."""
    rows = spark.range(4000).select(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("term"))
    hot = spark.range(5000).select(F.xxhash64(F.lit("the")).alias("h"), F.lit("the").alias("term"))
    placed, n = terms.leaves(rows.unionByName(hot), leaf_rows=100, level_bits=3)
    sizes = placed.groupBy("leaf").agg(F.count_distinct("h").alias("n")).collect()
    assert len(sizes) <= n and max(r["n"] for r in sizes) < 200 and placed.count() == 9000
    assert placed.groupBy("h").agg(F.count_distinct("leaf").alias("n")).filter("n > 1").isEmpty()
    _, one = terms.leaves(hot, leaf_rows=100, level_bits=3)
    assert one == 1


def test_a_leaf_is_summed_beyond_memory(tmp_path):
    """DuckDB reads a stream and spills; the folder is gone afterwards."""
    def batches():
        for k in range(40):
            ids = range(k * 5000, k * 5000 + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array([f"term number {i:09d}" * 3 for i in ids]), pa.array([2] * 20_000), pa.array([1] * 20_000)], names=["term", "n_occurrences", "n_rows"])

    memory, terms.DUCK_MEMORY = terms.DUCK_MEMORY, "60MB"
    try:
        out = list(terms._duck_sum(batches(), f"{tmp_path}/not/yet/there"))
    finally:
        terms.DUCK_MEMORY = memory
    assert sum(b.num_rows for b in out) == 215_000 and sum(b.column(1).to_numpy().sum() for b in out) == 1_600_000
    assert not list((tmp_path / "not/yet/there").iterdir())
