"""Matches in texts: lookups in workers against joins, brute force, and the program over them."""

import random
import re

import pytest

from lexmill.operators import quality, spans
from lexmill.plans import vocabulary

DATA = "/root/testdata/sf0.001"


def brute(texts, terms):
    out = set()
    for i, t in texts:
        for term in {x.strip().lower() for x in terms if x}:
            if re.match(r"\w", term) and re.search(r"\w$", term):
                out |= {(i, term, m.start(), m.end()) for m in re.finditer(rf"(?<!\w)(?={re.escape(term)}(?!\w))", (t or "").lower()) for m in [re.compile(re.escape(term)).match(t.lower(), m.start())]}
    return out


def test_hits_against_brute_force_by_lookup_and_by_join(spark):
    rng = random.Random(4)
    words = ["give", "up", "well", "known", "a", "give up", "one's", "déjà", "give_up"]
    texts = [(i, "".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) + rng.choice([" ", "-", "  ", ". "]) for _ in range(30))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, "give up")]
    long = " ".join(["give up"] * 6)
    terms = ["give", "Give Up", "well-known", "up", "one's a", long, None, "-up", "déjà", "give up"]
    df, t = spark.createDataFrame(texts, "row_id bigint, content string"), spark.createDataFrame([(x, 1) for x in terms], "term string, id int")
    want = brute(texts, terms)
    for options in ({}, {"broadcast_terms": 0}):
        got = spans.hits(df, t, **options).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    apart = [sorted(map(tuple, spans.hits(df, t, gap=5, with_context=True, **o).collect())) for o in ({}, {"broadcast_terms": 0})]
    assert apart[0] == apart[1] and 0 < len(apart[0]) < len(want)


def test_a_capital_of_two_letters_does_not_move_places(spark):
    df = spark.createDataFrame([(1, "İİ give it up.")], "row_id bigint, content string")
    terms = spark.createDataFrame([("give",)], "term string")
    for n in (0, 9):
        assert [tuple(r) for r in spans.hits(df, terms, broadcast_terms=n).collect()] == [(1, "give", 3, 7)]
        pairs = spark.createDataFrame([("give", "up")], "verb string, particle string")
        assert [(r["start"], r["end"], r["pattern_type"]) for r in spans.separable(df, pairs, broadcast_pairs=n).collect()] == [(3, 13, "separated_pronoun")]


def test_apart_is_the_greedy_choice():
    rng = random.Random(2)
    for _ in range(200):
        found = [("x" * rng.randint(1, 4), s, s + 3) for s in rng.sample(range(60), rng.randint(0, 20))]
        kept = []
        for h in sorted(found, key=lambda h: (-len(h[0]), h)):
            if all(abs(h[1] - k[1]) >= 5 for k in kept):
                kept.append(h)
        assert spans.apart(found, 5) == kept


@pytest.mark.parametrize("profile", ["lexicon", "full"])
def test_a_lexicon_too_large_for_workers_gives_the_same_workbook(spark, profile):
    passages, lexicon = spark.read.parquet(f"{DATA}/passages.parquet"), spark.read.parquet(f"{DATA}/lexicon.parquet")
    by_lookup = sorted(map(str, vocabulary.workbook(passages, lexicon, profile).collect()))
    by_join = sorted(map(str, vocabulary.workbook(passages, lexicon, profile, broadcast_terms=0).collect()))
    assert by_lookup == by_join and len(by_lookup) > 100


def test_no_passage_id_is_no_group(spark):
    schema = "row_id bigint, content string, textbook_id bigint, book_title string, textbook_studio_passage_id string, studio_title string, textbook_unit_id string"
    rows = [(i, "The analysis of it.", 1, None, None, None, None) for i in (1, 2)] + [(i, t, 1, None, "p", None, None) for i, t in ((3, "An analysis."), (4, "An analysis of much more than that."), (5, "Other analysis of much more than it."))]
    lexicon = spark.createDataFrame([("analysis", "user_word"), (None, "user_word")], "term string, kind string")
    got = vocabulary.workbook(spark.createDataFrame(rows, schema), lexicon).collect()
    # of the three in passage p the longest sentence stays, of equal ones the first row
    assert sorted((r["row_id"], r["passage_id"]) for r in got) == [(1, None), (2, None), (5, "p")]
    tie = [(7, "p", "w", "same", 2), (3, "p", "w", "same", 9), (3, "p", "w", "same", 1), (1, None, "w", "a", 1), (2, None, "w", "b", 1), (4, "p", None, "c", 1)]
    wb = spark.createDataFrame(tie, "row_id bigint, passage_id string, word string, context string, seq bigint")
    assert sorted((r["row_id"], r["seq"]) for r in quality.repair_duplicates(wb, ("row_id", "seq")).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_nothing(spark):
    passages, lexicon = spark.read.parquet(f"{DATA}/passages.parquet"), spark.read.parquet(f"{DATA}/lexicon.parquet")
    assert vocabulary.workbook(passages.limit(0), lexicon, "full").count() == 0
    assert vocabulary.workbook(passages, lexicon.limit(0)).count() == 0
