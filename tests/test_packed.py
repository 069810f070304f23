import random
import re

import pytest

from lexmill.operators.packed import automaton, folded, given, learned, split_values, unpack


@pytest.mark.parametrize(
    "field, values",
    [
        ("teacher,tautological", ["teacher", "tautological"]),
        ('"calm | still";cow', ["calm | still", "cow"]),
        ('"take apart"/"the ""free"" kind"/make clear', ["take apart", 'the "free" kind', "make clear"]),
        ("[\"one's own\", 'in good shape']", ["one's own", "in good shape"]),
        ("['rise, as of the sun', 'at odds']", ["rise, as of the sun", "at odds"]),
        ("1. a b\n2. c", ["a b", "c"]),
        ("(1) x y (2) up-to-date", ["x y", "up-to-date"]),
        ("1) hand over 2) q", ["hand over", "q"]),
        ("a - b - c", ["a", "b", "c"]),
        ("well-known / one's own", ["well-known", "one's own"]),
        ("speculative,ramification,", ["speculative", "ramification"]),
        ("frog，law、x·y", ["frog", "law", "x", "y"]),
        ("a||b\t c \n d", ["a", "b", "c", "d"]),
        ('"the ""free"" kind" ,dissemination', ['the "free" kind', "dissemination"]),
        ("a, a, b", ["a", "a", "b"]),
        ("2. late 3. later", ["2. late 3. later"]),
        ('say "hi, you', ['say "hi', "you"]),
        ("", []), (" , ;", []), ("-", ["-"]), ("nan", ["nan"]), (None, []), ('"",""', []),
    ],
)
def test_fields(field, values):
    assert split_values(field) == values


def test_known_values_keep_their_dividers():
    known = automaton(["and/or", "Rise, as of the sun", "cow"])
    assert split_values("cow, and/or, x", known) == ["cow", "and/or", "x"]
    assert split_values("rise, as of the sun; b", known) == ["rise, as of the sun", "b"]
    assert split_values("cow/dog and/or x", known) == ["cow", "dog and", "or x"]
    assert split_values('"and/or", "a,b"', known) == ["and/or", "a,b"]


def test_round_trip():
    rng = random.Random(7)
    words = ["cow", "up-to-date", "one's own", "hand over", "bright, clear", "calm | still", 'the "free" kind', "and/or", "quick; short"]
    for _ in range(500):
        chosen = [rng.choice(words) for _ in range(rng.randint(2, 7))]
        divider = rng.choice([",", ", ", " ; ", "|", "\t", "\n", "·", " / ", "，"])
        shown = ['"' + w.replace('"', '""') + '"' if any(c in w for c in ',;|/"') or rng.random() < 0.3 else w for w in chosen]
        assert split_values(divider.join(shown)) == chosen


def test_unpack(spark):
    schema = "entry_id bigint, synonyms string, antonyms string, item string"
    long = ", ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, "a, b", None, "x"), (1, "a, b", "", "x"), (2, "one", "p|q|p", None), (None, "c;d", " ", "x"), (3, long, "nan", "")], schema)
    rows = sorted((r["entry_id"] or 0, r["field_name"], r["item_no"], r["item"]) for r in unpack(df).filter("entry_id IS NULL OR entry_id < 3").collect())
    assert rows == [
        (0, "synonyms", 1, "c"), (0, "synonyms", 2, "d"), (1, "synonyms", 1, "a"), (1, "synonyms", 1, "a"), (1, "synonyms", 2, "b"), (1, "synonyms", 2, "b"),
        (2, "antonyms", 1, "p"), (2, "antonyms", 2, "q"), (2, "antonyms", 3, "p"),
    ]
    assert unpack(df).filter("entry_id = 3").count() == 20_000
    assert unpack(df.limit(0)).count() == 0


def test_a_capital_of_two_letters_keeps_the_dictionary():
    """The lower case of some capitals is longer; places are mapped, so nothing is switched off."""
    assert "İ".lower() != "i" and len("İ".lower()) == 2
    known = automaton(["salt, pepper"])
    assert split_values("salt, pepper; sugar", known) == ["salt, pepper", "sugar"]
    assert split_values("salt, pepper; sugar; İ", known) == ["salt, pepper", "sugar", "İ"]
    assert split_values("İ; Salt,  pepper; sugar", known) == ["İ", "Salt,  pepper", "sugar"]
    low, at = folded("aİ  B")
    assert [("aİ  B"[i]) for i in at] == ["a", "İ", "İ", " ", "B"] and low.endswith(" b")


def rows_of(df):
    return sorted((r["entry_id"], r["field_name"], r["item_no"], r["item"]) for r in df.collect())


def test_the_dictionary_is_learned_from_the_collection(spark):
    """A value in quotes here is kept whole without quotes there; by automaton and by join alike."""
    rows = [(i, '"bright, clear"; cow', None) for i in range(5)] + [(10, "dog; Bright, clear; ox", "x/y"), (11, "bright, clear", "and/or | up"), (12, "cow, dog", "ox, up, cow, dog")]
    # often side by side, seldom whole: the atoms are likelier
    rows += [(20 + i, "cow, dog, hen", None) for i in range(60)] + [(90, '"cow, dog" | ox', None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "entry_id bigint, synonyms string, antonyms string, value string")
    lists = spark.createDataFrame([(["And/or"], None), (["and/or", None], ["up"])], "synonyms array<string>, antonyms array<string>")
    dictionary = {r["value"]: r["support"] for r in learned(df, lists=lists).collect()}
    assert dictionary == {"bright, clear": 5, "and/or": 2}
    got = rows_of(unpack(df, lists=lists))
    assert [r[3] for r in got if r[0] == 10 and r[1] == "synonyms"] == ["dog", "Bright, clear", "ox"]
    assert [r[3] for r in got if r[0] == 11] == ["and/or", "up"]
    assert [r[3] for r in got if r[0] == 12 and r[1] == "synonyms"] == ["cow", "dog"]
    assert got == rows_of(unpack(df, lists=lists, broadcast_known=0))
    none = rows_of(unpack(df, known=given(spark.createDataFrame([(None,), (" ",)], "t string"))))
    assert [r[3] for r in none if r[0] == 10 and r[1] == "synonyms"] == ["dog", "Bright", "clear", "ox"]
    assert learned(df.limit(0)).count() == 0


def test_planted_values_without_quotes(spark):
    """The workbook with the quotes taken from some fields: the values learned from the others come back whole."""
    wb = spark.read.parquet("/root/testdata/sf0.01/workbook.parquet").filter("synonyms IS NOT NULL").select("entry_id", "synonyms", "antonyms")
    value = r'"(bright, clear|open, as of a door|large, of a crowd|hot/cold|to move; to stir)"'
    hit = wb.filter(f"synonyms rlike '{value}'").collect()
    planted = spark.createDataFrame([(-r["entry_id"], re.sub(value, r"\1", r["synonyms"]), None) for r in hit], wb.schema)
    dictionary = learned(wb)
    want = {(r["entry_id"], r["item_no"], r["item"]) for r in unpack(wb, known=dictionary).filter("field_name = 'synonyms'").join(wb.filter(f"synonyms rlike '{value}'"), "entry_id", "left_semi").collect()}
    got = {(-r["entry_id"], r["item_no"], r["item"]) for r in unpack(planted, known=dictionary).collect()}
    plain = {(-r["entry_id"], r["item_no"], r["item"]) for r in unpack(planted, known=dictionary.limit(0)).collect()}
    assert len(hit) > 50 and got == want
    assert len({i for i, _, _ in plain - want}) == len(hit)
