import random
import time

import pytest

from lexmill.llm import names, pii


def found(text):
    return [(h.kind, text[h.start : h.end]) for h in pii.detect(text)]


@pytest.mark.parametrize(
    "text, hits",
    [
        ("Write to ann.lee+x@mail.school.test now.", [("email", "ann.lee+x@mail.school.test")]),
        ("-> <A_B@SCHOOL.TEST>", [("email", "A_B@SCHOOL.TEST")]),
        ("ann at mail dot school dot test please", [("email", "ann at mail dot school dot test")]),
        ("a.b (at) school.test; c[at]school[dot]test", [("email", "a.b (at) school.test"), ("email", "c[at]school[dot]test")]),
        ("ann @ school.test", [("email", "ann @ school.test")]),
        ("аnn＠school．test", [("email", "аnn＠school．test")]),
        ("Meet at noon.Then go. Follow @grade7 news at school.", []),
        ("Call +1 303 555-0125!!", [("phone", "+1 303 555-0125")]),
        ("+82 (0)10 0041 5731 or +82-10-0398-2957", [("phone", "+82 (0)10 0041 5731"), ("phone", "+82-10-0398-2957")]),
        ("(415) 555-0179, 415.555.0179, 010-1234-5678, 01012345678, 020 7946 0844", [("phone", x) for x in ("(415) 555-0179", "415.555.0179", "010-1234-5678", "01012345678", "020 7946 0844")]),
        ("０１０-１２３４-５６７８", [("phone", "０１０-１２３４-５６７８")]),
        ("zero one zero, one two three four five six seven eight", [("phone", "zero one zero, one two three four five six seven eight")]),
        ("One two three, and zero one two.", []),
        ("850712-1234567; 850712 - 1234567; 8507121234567; 123-45-6789; Z01234567", [("id_number", x) for x in ("850712-1234567", "850712 - 1234567", "8507121234567", "123-45-6789", "Z01234567")]),
        ("Item 7093.5477.1900, ISBN 979-0-0000-1533-1, order 20230417-0092454, batch 631-18-376, 8614780828 words, 2023-04-23, pp. 911-826", []),
        ("at Flat 41, 735 Old Tannery Court, Keliswick 66905.", [("address", "Flat 41, 735 Old Tannery Court, Keliswick 66905")]),
        ("to 115C Mill Road, Apt 11, Elvel and 656 FOX COURT, DRAM", [("address", "115C Mill Road, Apt 11, Elvel"), ("address", "656 FOX COURT, DRAM")]),
        ("주소: 너른시 다온구 물안개로 677", [("address", "너른시 다온구 물안개로 677")]),
        ("Room 617, Unit 27, Main Street Reading Set", []),
        ("Thanks to Ann-Eve Leemoor for it.", [("name", "Ann-Eve Leemoor")]),
        ("Absent today: Eskalane, Pradela; L. Kestreforth", [("name", "Eskalane, Pradela"), ("name", "L. Kestreforth")]),
        ("marked by Dr. Rose B. Vintermoss.", [("name", "Rose B. Vintermoss")]),
        ("[WILL GRELMOOR] agreed with this.", [("name", "WILL GRELMOOR")]),
        ("학생 묭미르샘 의 연락처는 010-1111-2222", [("name", "묭미르샘"), ("phone", "010-1111-2222")]),
        ("Ann Lee\n12 Mill Road, Elvel\n010-1111-2222", [("name", "Ann Lee"), ("address", "12 Mill Road, Elvel"), ("phone", "010-1111-2222")]),
        ("Thanks to Silver Harbor Press for the book. Dear Class, hello.", []),
        ("THE DOCTOR AS WELL AS THE TEACHER AND THE BOX", []),
    ],
)
def test_finds(text, hits):
    assert found(text) == hits


def test_places_survive_rewriting():
    text = "나 ​ｘ ann at mail dot b dot test 그리고 Ｚ０１２３４５６７ 그리고 zero one zero one two three four five six seven eight."
    for h in pii.detect(text):
        assert text[h.start : h.end].strip() == text[h.start : h.end]
    assert [(h.kind, text[h.start]) for h in pii.detect(text)] == [("email", "a"), ("id_number", "Ｚ"), ("phone", "z")]


def test_redaction(spark):
    text = "Dear Ann Lee,\nmail a@b.test or 010-1234-5678."
    assert pii.redact(text, pii.detect(text)) == "Dear [NAME],\nmail [EMAIL] or [PHONE]."
    long = "plain words here " * 50_000 + "a@b.test"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, long), (5, "nothing")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kind string")
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in pii.found(df).collect()}
    assert got == {(1, "name", 6), (1, "email", 20), (1, "phone", 32), (4, "email", len(long) - 7)}
    assert pii.found(df).count() == 7
    masked = {r["doc_id"]: r["n_found"] for r in pii.redacted(df).collect()}
    assert masked == {1: 3, 2: 0, 3: 0, 4: 1, 5: 0} and pii.redacted(df).count() == 6
    assert pii.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("address", ["j.lee at site (dot) com", "j.lee at site[dot]com", "j.lee [ at ] site.com", "j.lee (at ) site.com", "j.lee at site\ndot\tcom", "J.LEE { AT\n} SITE.COM"])
def test_a_disguise_needs_no_other_trigger(address):
    assert found(f"Write to {address}, please.") == [("email", address)]
    assert found(f"See @home. Write to {address}, please.") == [("email", address)]


@pytest.mark.parametrize(
    "text, name",
    [
        ("Corrected by Kellan Vintermoss.", ["Kellan Vintermoss"]),
        ("In the fifth row, Jastla Hastosham raised a hand.", ["Jastla Hastosham"]),
        ("Ilvaro Inglevik turned in this essay.", ["Ilvaro Inglevik"]),
        ("Brisowin Morvandish helped; I met John Smith yesterday.", ["Brisowin Morvandish", "John Smith"]),
        ("My neighbour 묭도람 waved.", ["묭도람"]),
        ("담임 선생님 Ilvaro Inglevik 께", ["Ilvaro Inglevik"]),
        ("We heard from O'Brien, Sean that J. R. Tolland's dog ran.", ["O'Brien, Sean", "J. R. Tolland"]),
        ("The Hague is in Holland. Monday Morning Press printed Oak Valley School news.", []),
        ("전화 010-1111-2222", []),
    ],
)
def test_names_in_other_frames(text, name):
    assert [t for k, t in found(text) if k == "name"] == name


def test_other_identifiers():
    text = "Card 4111 1111 1111 1111, not 4111 1111 1111 1112; IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00. Call 1-800-555-0199 at Hauptstraße 12, 10115 Berlin or Via Roma 12."
    assert found(text) == [
        ("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("phone", "1-800-555-0199"), ("address", "Hauptstraße 12, 10115 Berlin"), ("address", "Via Roma 12"),
    ]


def test_no_windows_and_linear_time():
    local = "a" * 3000
    assert found(f"Write {local}@b.test or {local} at b dot test") == [("email", f"{local}@b.test"), ("email", f"{local} at b dot test")]
    address = "가" * 11 + "시 " + "나" * 10 + "구 " + "다" * 18 + "로 12"
    assert found(f"주소: {address}") == [("address", address)]
    took = []
    for n in (2_000, 20_000):
        text = "".join(f"u{i}@b.test, Kellan Vintermoss; " for i in range(n))
        began = time.time()
        assert len(pii.detect(text)) == 2 * n
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 0.5


#: Frames that share no words with those of the test tables.
FRAMES = (
    "Yesterday {} walked across town without a coat.", "The prize went to {} after a long vote.", "Nobody believed {} at first.", "A letter from {} arrived on time.",
    "{} plays the cello.", "According to {}, rain is likely.", "We elected {} last spring.", "Her cousin, {}, bakes bread.",
)


def test_names_of_the_collection_in_held_out_frames(spark):
    """Fitted to the documents, the model finds new combinations of names in frames that it never saw, and no places or ordinary words."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = names.fit(documents)
    rng = random.Random(5)
    given = "Ilvaro Jastla Kellan Brisowin Marivek Oskaro Dawn Mark Will Nolwina Sariko".split()
    family = "Inglevik Hastosham Vintermoss Morvandish Grelkine Skelforth Rastequist Brindvik".split()
    asked = right = said = 0
    for _ in range(400):
        g, f = rng.choice(given), rng.choice(family)
        name = rng.choice([f"{g} {f}", f"{g} {rng.choice('ABKT')}. {f}", f"{g[0]}. {f}", f"{f}, {g}"])
        text = rng.choice(FRAMES).format(name)
        got = [text[h.start : h.end] for h in pii.detect(text, model) if h.kind == "name"]
        asked, said, right = asked + 1, said + len(got), right + (name in got)
    assert right / asked > 0.95 and right / said > 0.95
    others = "The old bridge in Orugallen fell. According to the harbor, Silver Harbor Press and Green Valley library closed. 학생들은 예문을 적어 왔다."
    assert [h for h in pii.detect(others, model) if h.kind == "name"] == []


def test_fit_of_nothing(spark):
    empty = names.fit(spark.createDataFrame([(None,), ("",)], "text string"))
    assert not empty.common and not empty.openers and not empty.weights.any()
