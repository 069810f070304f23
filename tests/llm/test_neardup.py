import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import neardup
from lexmill.llm.words import words


def brute(rows, shingle, threshold, min_words):
    sets = {}
    for i, t in rows:
        w = words(t) if t else []
        if len(w) >= max(min_words, shingle):
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed, n=120, vocabulary=40):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                action = rng.random()
                if action < 0.4:
                    w[k] = rng.choice(names)
                elif action < 0.7:
                    w.insert(k, rng.choice(names))
                elif len(w) > 5:
                    del w[k]
            if rng.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
        else:
            w = rng.choices(names, k=rng.randint(5, 60))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"hot_count": 2}), (3, {"hot_count": 2, "n_fragments": 1, "broadcast_rows": 0}), (4, {"threshold": 0.4}), (1, {"max_bits": 2}), (2, {"max_bits": 2, "hot_count": 2})])
def test_all_links_are_found(spark, seed, options):
    rows = corpus(seed)
    # few slots: a coarse order, many n-grams in one slot
    options = {"threshold": 0.6, "shingle": 3, "min_words": 20, "max_bits": 12} | options
    df = spark.createDataFrame(rows, "row_id bigint, content string").repartition(3)
    got = {tuple(r) for r in neardup.found(df, **options).collect()}
    assert got == brute(rows, 3, options["threshold"], 20)


@pytest.mark.parametrize("most_paired, max_bits", [(48, 18), (3, 18), (0, 18), (3, 2)])
def test_hot_grams_are_keyed_in_pairs(spark, monkeypatch, most_paired, max_bits):
    """All n-grams frequent: keys of two, and keys of one for prefixes with many of them, must still find every link."""
    monkeypatch.setattr(neardup, "MOST_PAIRED", most_paired)
    rng = random.Random(5)
    base = [rng.choices("abcdefgh", k=30) for _ in range(4)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(30)] = rng.choice("abcdefgh")
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "row_id bigint, content string")
    got = {tuple(r) for r in neardup.found(df, max_bits=max_bits, hot_count=4).collect()}
    want = brute(rows, 3, 0.6, 20)
    assert got == want and len(want) > 100


def test_copies_nulls_and_long_texts(spark):
    a = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, a), (2, a.upper() + "!"), (3, None), (4, ""), (5, "short text"), (6, long), (7, long + " end"), (8, a + " x y")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "row_id bigint, content string, a bigint, words string")
    assert {tuple(r) for r in neardup.found(df, max_bits=14).collect()} == {(1, 2), (1, 8), (2, 8), (6, 7)}
    links, copies = neardup.links(df, threshold=0.6, shingle=3, min_words=20, max_bits=14)
    assert {tuple(r) for r in copies.collect()} == {(1, 1), (2, 1)}
    assert {(r["a"], r["b"]) for r in links.collect()} == {(1, 8), (6, 7)}
    assert neardup.found(df.limit(0), max_bits=14).count() == 0
    # repeated rows count as one
    assert neardup.found(df.union(df), max_bits=14).count() == 4


def test_classes(spark):
    a = [f"w{i}" for i in range(40)]
    chain = [" ".join(a[k:] + [f"z{j}" for j in range(k)]) for k in (0, 3, 6, 9)]
    rows = [(10 + i, t) for i, t in enumerate(chain)] + [(20, chain[3]), (30, "other words " * 5), (31, "other words " * 5), (40, "alone " + " ".join(a[::-1]))]
    df = spark.createDataFrame(rows, "row_id bigint, content string")
    got = {r["row_id"]: (r["class_id"], r["n_links"]) for r in neardup.classes(df, threshold=0.8, max_bits=14).collect()}
    assert {k: v[0] for k, v in got.items()} == {10: 10, 11: 10, 12: 10, 13: 10, 20: 10, 30: 30, 31: 30}
    # 13 and 20 are copies, linked to 12; copies count as links
    assert got[10][1] == 1 and got[12][1] == 3 and got[20] == got[13] == (10, 2) and got[30] == (30, 1)
    ten = spark.createDataFrame([(i, chain[0]) for i in range(10)] + [(50, chain[1])], "row_id bigint, content string")
    assert {r["row_id"]: r["n_links"] for r in neardup.classes(ten).collect()} == {i: 10 for i in [*range(10), 50]}


def test_a_long_chain_is_one_class(spark):
    """Successive edits with ids in any order: each text is linked to the one before and after it only."""
    ids = list(range(100, 400))
    random.Random(1).shuffle(ids)
    rows = [(i, " ".join(f"w{j}" for j in range(3 * k, 3 * k + 40))) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "row_id bigint, content string")
    got = {r["row_id"]: (r["class_id"], r["n_links"]) for r in neardup.classes(df, threshold=0.8, max_bits=14).collect()}
    assert got == {i: (100, 1 if i in (ids[0], ids[-1]) else 2) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    edges += [(1000 + i, 999) for i in range(50)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(label) and {r["a"]: r["l"] for r in got} == label
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keys_of_a_long_boilerplate_text_grow_in_line():
    """Of a text with very many frequent n-grams each gives one key, not one with each other."""
    made = []
    for n in (2_000, 8_000):
        grams = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        read = lambda _, n=n, grams=grams: (grams, np.full(n, 200, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.arange(n), np.full(n, n))
        batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["row_id"])
        (out,) = neardup._postings([batch], read, np.array([100]), 0.6, 2, 100)
        made.append(out.num_rows)
    assert made[1] < 4.1 * made[0] and made[1] <= 8_000


def test_the_order_table_follows_the_collection(spark):
    recs = spark.range(10).select(F.array_repeat(F.lit(1).cast("bigint"), 102).alias("words"))
    assert neardup.table_bits(recs, 3, 26) == 12 and neardup.table_bits(recs, 3, 7) == 7 and neardup.table_bits(recs, 3, 6) is None
