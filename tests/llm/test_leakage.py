import random

import numpy as np
import pytest

from lexmill.llm import leakage
from lexmill.llm.words import WordHasher, flat_hashes, ngram_hashes, starts_in_text, words


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = words(t) if t else []
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t) if t else []
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


@pytest.mark.parametrize("run, k", [(12, 6), (6, 6), (8, 3)])
def test_no_span_is_missed(spark, run, k):
    rng = random.Random(run)
    names = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(names, k=rng.randint(3, 40)))) for i in range(30)]
    docs = []
    for d in range(60):
        w = rng.choices(names, k=rng.randint(0, 50))
        if rng.random() < 0.7:
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            w[5:5] = part[a : a + rng.randint(run - 2, run + 6)]
        docs.append((d, " ".join(w).upper()))
    docs += [(100, None), (101, ""), (102, "same " * 40), (102, "same " * 40)]
    items += [(100, None), (101, "same " * 20), (102, "one two")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, fp int").repartition(3)
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, before int")
    got = leakage.leaks(df, it, run=run, k=k).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, run)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert all(r["run_words"] >= run for r in got)
    assert leakage.leaks(df.limit(0), it, run=run, k=k).count() == 0
    assert leakage.leaks(df, it.limit(0), run=run, k=k).count() == 0


def test_grams_stay_in_their_text():
    flat, offsets = flat_hashes(["a b c d", None, "e f", "g h i"], WordHasher())
    assert starts_in_text(offsets, 3).tolist() == [0, 1, 6]
    other, _ = flat_hashes(["x b c d"], WordHasher())
    assert ngram_hashes(flat, 3)[1] == ngram_hashes(other, 3)[1]
    assert len(starts_in_text(np.array([0]), 2)) == 0


def test_whole_length_of_a_run(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(60)]
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, "same " * 50)]
    docs = [
        (1, "x " + " ".join(a) + " y"),
        (2, " ".join(a[:28])),
        (3, " ".join(a[:90] + ["x"] + a[91:])),  # two runs beside each other
        (4, " ".join(b[20:] + b[:20])),
        (5, " ".join(b[:30])),
        (5, " ".join(["x"] * 25 + b[25:])),  # another text under the same id
        (6, "same " * 70),
    ]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["run_words"] for r in leakage.leaks(df, it).collect()}
    assert got == {(1, 1): 200, (2, 1): 28, (3, 1): 109, (4, 2): 40, (5, 2): 35, (6, 3): 50}


def test_same_items_and_the_size_of_the_map(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    items = spark.createDataFrame([(1, a), (2, a), (2, b), (3, a.upper() + "!")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    got = {tuple(r) for r in leakage.leaks(df, items).collect()}
    assert got == {(1, 1, 30), (1, 2, 30), (1, 3, 30), (2, 2, 30)}
    # a map that is far too small lets more through to the join, and changes nothing
    assert {tuple(r) for r in leakage.leaks(df, items, max_bits=8).collect()} == got
    assert leakage.map_bits(0, 30) == 16 and leakage.map_bits(10**6, 30) == 24 and leakage.map_bits(10**9, 30) == 30
    fps = spark.range(5000).selectExpr("xxhash64(id) AS fp")
    for bits in (10, 16, 22):
        table = leakage._bit_map(fps, bits)
        slots = {(r["fp"] & (2**64 - 1)) >> (64 - bits) for r in fps.collect()}
        assert {int(i) for i in np.nonzero(np.unpackbits(table, bitorder="little"))[0]} == slots
