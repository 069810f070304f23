import random
import re

import pyarrow as pa

from lexmill.llm import formatdup

SCHEMA = "entry_id bigint, word string, passage_id string, n_copies string, _k int"


def brute(rows):
    groups = {}
    for i, w, p, *_ in rows:
        if w is None or p is None:
            continue
        w, p = (re.sub(r"[\W_]+", "", x.lower()) for x in (w, p))
        parts = re.findall(r"[^\W\d_]+\d+", p)
        if len(parts) == 3 and "".join(parts) == p:
            p = "-".join(sorted(parts))
        groups.setdefault((w, p), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i > min(g)}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = rng.choice(["cat", "Cat ", "c-at", "“CAT”", "act", "give up", "GIVEUP", "été", None, "", "--"])
        parts = [f"B{rng.randint(1, 3)}", f"U{rng.randint(1, 2)}", f"P{rng.randint(1, 12):03d}"]
        rng.shuffle(parts)
        p = rng.choice(["-", "/", "", " : ", "_"]).join(parts)
        p = rng.choice([p, p.lower() + ".", f"[{p}]", None, "free text"]) if rng.random() < 0.5 else p
        rows.append((i, w, p, "x", 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {tuple(r) for r in formatdup.found(df).collect()} == brute(rows)


def test_parts_are_not_mixed_up(spark):
    rows = [(1, "a", "B1-U23-P4"), (2, "a", "B12-U3-P4"), (3, "a", "U23 B1 P4"), (4, "a", "B1U23P4x"), (5, "a", "P4/B1/U23.")]
    df = spark.createDataFrame(rows, "entry_id bigint, word string, passage_id string")
    assert {tuple(r) for r in formatdup.found(df).collect()} == {(1, 3), (1, 5)}


def test_collapse(spark):
    rows = [(3, "Cat", "B1-U1-P1", "x", 1), (1, "cat!", "P1 U1 B1", "y", 2), (2, None, "B1-U1-P1", "z", 3), (4, "dog", "q" * 100_000, "w", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = formatdup.collapse(df)
    assert {(r["entry_id"], r["_k"], r["n_copies"]) for r in out.collect()} == {(1, 2, 2), (2, 3, 1), (4, 4, 1)}
    assert out.columns == ["entry_id", "word", "passage_id", "_k", "n_copies"]
    assert formatdup.collapse(df.limit(0)).count() == 0 and formatdup.found(df.limit(0)).count() == 0


def test_the_invariant_holds_for_all_that_the_key_calls_equal():
    """Whatever has the same bare text, or another order of parts, has the same sum; other letters have another."""
    rng = random.Random(9)
    alphabet = "aAbBzZ019 .-_/“”·éÉßİıΣσςЖж가힣²Ⅷ①́ "
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        bare = formatdup.bare(text)
        shuffled = "".join(rng.sample(bare, len(bare)))
        got = formatdup.histogram_sums(pa.array([text, bare, shuffled, bare + "a", "x"]))
        assert got[0] == got[1] == got[2] != got[3]
    sliced = pa.array(["ab", "", "c-D", "dc", "é!"]).slice(2)
    sums = formatdup.histogram_sums(sliced)
    assert sums[0] == sums[1] and (formatdup.histogram_sums(pa.array(["É"])) == sums[2]).all()
    assert not len(formatdup.histogram_sums(pa.array([], pa.string())))


def test_joins_by_shuffle_give_the_same(spark):
    rows = [(i, f"w{i % 40}", f"B1-U1-P{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "entry_id bigint, word string, passage_id string")
    want = sorted(map(tuple, formatdup.members(df).collect()))
    assert sorted(map(tuple, formatdup.members(df, broadcast_rows=0).collect())) == want
    assert formatdup.collapse(df, broadcast_rows=0).count() == 120 == formatdup.collapse(df).count()
