import random

import pytest

from lexmill.llm import mixing


SIZES, TARGETS = "doc_id bigint, source string, n_tokens bigint", "source string, target_weight double, max_repeats int"


def filled(spark, rows, total=None):
    sizes = spark.createDataFrame([(i, s, a) for i, (s, _, _, a) in enumerate(rows)], SIZES)
    targets = spark.createDataFrame([(s, float(w), m) for s, w, m, _ in rows], TARGETS)
    return {r["source"]: r for r in mixing.plan(sizes, targets, total).collect()}


def test_water_filling(spark):
    got = filled(spark, [("a", 1, 1, 100), ("b", 1, 2, 10), ("c", 2, 1, 90)])
    # b is clamped at 20; of the 180 left a asks 60, c 120 and is clamped at 90; a gets the other 90
    assert {k: v["allotted_tokens"] for k, v in got.items()} == {"a": 90.0, "b": 20.0, "c": 90.0}
    assert {k for k, v in got.items() if v["misses_target"]} == {"b", "c"}
    none = filled(spark, [("a", 1, 1, 0), ("b", 0, 1, 5)])
    assert none["a"]["allotted_tokens"] == 0 and none["a"]["misses_target"] and not none["b"]["misses_target"]


def test_nothing_is_lost_or_over_its_cap(spark):
    rng = random.Random(2)
    for _ in range(12):
        rows = [(str(i), rng.random() * rng.choice([0, 1, 10]), rng.randint(0, 4), rng.randint(0, 1000)) for i in range(rng.randint(1, 8))]
        got = filled(spark, rows)
        cap = {s: m * a for s, _, m, a in rows}
        total, caps = sum(a for *_, a in rows), sum(cap[s] for s, w, _, _ in rows if w > 0)
        assert all(v["allotted_tokens"] <= cap[s] + 1e-6 for s, v in got.items())
        assert sum(v["allotted_tokens"] for v in got.values()) == pytest.approx(min(total, caps))
        # the sources that are not clamped share by weight
        levels = [got[s]["allotted_tokens"] / w for s, w, _, _ in rows if w > 0 and got[s]["allotted_tokens"] < cap[s] - 1e-6]
        assert not levels or max(levels) == pytest.approx(min(levels))


def test_many_sources(spark):
    ids = spark.range(30_000)
    sizes = ids.selectExpr("id AS doc_id", "cast(id AS string) AS source", "id % 97 AS n_tokens")
    targets = ids.selectExpr("cast(id AS string) AS source", "1.0 + id % 13 AS target_weight", "2 AS max_repeats")
    got = mixing.plan(sizes, targets)
    row = got.selectExpr("sum(allotted_tokens) AS a", "sum(available_tokens) AS b", "count(*) AS n").first()
    assert row["n"] == 30_000 and row["a"] == pytest.approx(row["b"])


def test_the_mix_does_not_shuffle_texts(spark):
    df = spark.createDataFrame([(i, "some text " * 5, "a") for i in range(50)], "doc_id bigint, text string, source string")
    out = mixing.mix(df, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.count() == 50


def test_mix(spark):
    rows = [(i, f"word {i} " * 20, "big", 7) for i in range(300)] + [(1000 + i, "tiny text here", "small", 7) for i in range(5)] + [(2000, None, "small", 7), (2001, "x", None, 7), (2002, "y", "other", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy_no int")
    targets = spark.createDataFrame([("big", 1.0, 1), ("small", 1.0, 3), ("gone", 1.0, 1), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert sorted(r[0] for r in mixing.found(df, targets).collect()) == ["gone", "small"]
    out = mixing.mix(df, targets).collect()
    small = [r["copy_no"] for r in out if r["source"] == "small" and r["text"]]
    assert sorted(small) == sorted([1, 2, 3] * 5) and {r["source"] for r in out} == {"big", "small"}
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(7), targets).collect()))
    sizes = mixing.sized(df)
    report = {r["source"]: r for r in mixing.report(sizes, mixing.plan(sizes, targets)).collect()}
    assert report["gone"]["mixed_tokens"] == 0 and sum(r["mixed_share"] for r in report.values()) == pytest.approx(1)
    assert mixing.found(df.limit(0), targets).count() == 0
    assert mixing.mix(df, targets.limit(0)).count() == 0


def test_fractions_are_drawn_by_their_share(spark):
    df = spark.createDataFrame([(i, "same text of one size", "a" if i % 2 else "b") for i in range(4000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 1)], "source string, target_weight double, max_repeats int")
    sizes = mixing.sized(df)
    got = {r["source"]: r["mixed_share"] for r in mixing.report(sizes, mixing.plan(sizes, targets)).collect()}
    assert got["a"] == pytest.approx(0.75, abs=0.02)


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "a" * 200_000, "s"), (2, "가나 " * 50_000, "s")], "doc_id bigint, text string, source string")
    assert all(r["n_tokens"] > 1000 for r in mixing.token_counts(df).collect())
