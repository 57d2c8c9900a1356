import random

import pytest

from palimpsest.llm import personal

GIVEN = ["Lena", "Tomas", "Priya", "Oskar", "Greta", "Nadia", "Hugo", "Selma"]
FAMILY = [a + b for a in ("Hald", "Quor", "Strel", "Norr", "Pell", "Zabr") for b in ("inger", "quist", "ovic", "holt")]
STREETS = ["Beacon", "Harrow", "Juniper", "Osprey", "Tannery"]


def _texts(n=600, seed=1):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        name = f"{r.choice(GIVEN + ['Karim'])} {r.choice(FAMILY)}"
        mail = f"{r.choice(FAMILY).lower()}{digits(2)}{r.choice(['@', ' (at) ', ' @ '])}mail.example.org"
        phone = r.choice([f"+44 7700 900 {digits(3)}", f"({digits(3)}) 555-{digits(4)}", f"{digits(3)}-555-{digits(4)}", "five five five zero one " + r.choice(["two nine", "three one", "six six"])])
        ident = r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"X{digits(9)}", f"{digits(2)}/{digits(3)}/{digits(5)}"])
        home = r.choice([f"{r.randint(1, 200)} {r.choice(STREETS)} Lane", f"{r.choice(STREETS)}weg {r.randint(1, 99)}"])
        order = f"The order number is {digits(4)}-{digits(3)}-{digits(2)}, and it shipped on 2023-08-1{digits(1)}."
        kind, item, text = r.choice([
            ("email", mail, f"You can write to {mail}, I read it daily."), ("phone", phone, f"Call me on {phone} after six."), ("phone", phone, f"My number is {phone}."),
            ("id_number", ident, f"My passport says {ident}."), ("id_number", ident, f"Identity card {ident}, valid until 2019"), ("address", home, f"I live at {home}."), ("name", name, f"It was signed by {name}, I think."), ("name", name, f"Ask for {name} at the desk."),
            (None, None, order), (None, None, "Grant Hall and Rose Terrace Cafe both close at 9."), (None, None, f"{r.choice(GIVEN)} said the reed box looks sturdy."), (None, None, "Version 1.41.2926 passed."),
        ])
        out.append((text, kind, item))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = _texts()
    texts = spark.createDataFrame([("t", str(i), "f", 0, t) for i, (t, _, _) in enumerate(rows)], "source_table string, record_key string, field_name string, turn_index int, text string")
    given = spark.createDataFrame([(g,) for g in GIVEN] + [(None,), (" ",)], "given_name string")
    return rows, texts, personal.learn(texts, given)


def test_finds_items_and_only_those(learned):
    rows, texts, lex = learned
    found = personal.find(texts, lex, ["record_key"]).collect()
    got = {(int(r["record_key"]), r["pii_type"], r["found_text"]) for r in found}
    want = {(i, k, s) for i, (_, k, s) in enumerate(rows) if k}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_unlisted_given_name_is_discovered(learned):
    assert "karim" in learned[2].given


def test_other_spellings(learned):
    lex = learned[2]
    found = lambda t: [(t[a:b], k) for a, b, k in personal.spans(t, lex)]
    assert found("It was signed by lena haldinger, I think.") == [("lena haldinger", "name")]
    assert found("Ask for QUOROVIC, GRETA at the desk.") == [("QUOROVIC, GRETA", "name")]
    assert found("Dr. Lena R. Haldinger-Norrholt looked.") == [("Lena R. Haldinger-Norrholt", "name")]
    assert found("I live at 12 beacon lane.") == [("12 beacon lane", "address")]
    assert found("I live at Flat 3, 21 Osprey Lane, near Harnwick.") == [("Flat 3, 21 Osprey Lane", "address")]
    assert found("Call me on five five five zero one three nine after six.") == [("five five five zero one three nine", "phone")]
    assert found("I pinned numkit@1.59.8 there; tag @zemozas") == []


@pytest.mark.parametrize("text,want", [
    ("The note says '12 rue Lepic'.", ["12 rue Lepic"]), ("It said ‘4 via Roma’, no more.", ["4 via Roma"]), ("He read '3 rue de l'Orme', then left.", ["3 rue de l'Orme"]),
    ("I live at 12 rue Foo-", ["12 rue Foo"]), ("at 5 rue d' once", []), ("at 5 rue l'", []),
])
def test_quoted_addresses(learned, spark, text, want):
    assert [text[a:b] for a, b, k in personal.spans(text, personal.Lexicon()) if k == "address"] == want
    rows = spark.createDataFrame([(1, text)], "k int, text string")
    assert [r["found_text"] for r in personal.find(rows, learned[2], ["k"]).collect() if r["pii_type"] == "address"] == want
    assert personal.learn(rows, spark.createDataFrame([], "given_name string")).given == set()


def test_batches_without_an_item(learned, spark):
    rows = spark.createDataFrame([("a", "nothing here"), ("b", "Version 1.41.2926 passed."), ("c", "Call me on +44 7700 900 123 after six.")], "k string, text string").repartition(3)
    assert [tuple(r) for r in personal.find(rows, learned[2], ["k"]).collect()] == [("c", "phone", "+44 7700 900 123")]
    assert personal.find(rows.where("k <> 'c'"), learned[2], ["k"]).count() == 0


def test_redaction_keeps_the_rest(learned, spark):
    texts = spark.createDataFrame([(1, "Call me on +44 7700 900 123 after six.", 5), (2, "nothing here", 6), (3, "word " * 30000, 7)], "k int, text string, pii_type int")
    got = {r["k"]: r["text"] for r in personal.redact(texts, learned[2]).collect()}
    assert got[1] == "Call me on [PHONE] after six." and got[2] == "nothing here" and got[3] == "word " * 30000


def test_no_pattern_is_lost_as_the_texts_grow(learned, spark, monkeypatch):
    _, texts, lex = learned
    monkeypatch.setattr(personal, "SHARE", 0.01, raising=False)  # a floor by share, as texts of 10 and more times the number would have it
    assert personal.learn(texts, spark.createDataFrame([(g,) for g in GIVEN], "given_name string")).score.keys() == lex.score.keys()


def test_patterns_too_many_to_send(learned, spark, monkeypatch):
    _, texts, lex = learned
    monkeypatch.setattr(personal, "MOST_PATTERNS", 5)
    joined = personal.learn(texts, spark.createDataFrame([(g,) for g in GIVEN], "given_name string"))
    assert joined.table is not None and not joined.score and (joined.given, joined.ends) == (lex.given, lex.ends)
    found = lambda x: sorted(map(tuple, personal.find(texts, x, ["record_key"]).collect()))
    assert found(joined) == found(lex)
    redacted = lambda x: sorted(map(tuple, personal.redact(texts, x).collect()))
    assert redacted(joined) == redacted(lex)


def test_fields_nulls_and_repeats(spark):
    s = spark.createDataFrame([("s1", [("user", "a@b.example"), ("user", None), ("user", " ")], "x"), ("s1", [("user", "a@b.example"), ("user", None), ("user", " ")], "x"), (None, [("user", "c@d.example")], "x"), ("s2", None, "x")], "session_id string, turns array<struct<role:string,content:string>>, text string")
    m = spark.createDataFrame([(1, "user: mail e@f.example", None, "x"), (1, "user: mail e@f.example", None, "x"), (None, "g@h.example", "i@j.example", "x")], "id bigint, raw string, fact string, text string")
    texts = personal.memory_texts(s, m)
    lex = personal.learn(texts, spark.createDataFrame([], "given_name string"))
    got = {tuple(r) for r in personal.find(texts, lex, ["source_table", "record_key", "field_name", "turn_index"]).collect()}
    assert got == {("sessions", "s1", "turns", 0, "email", "a@b.example"), ("memories", "1", "raw", -1, "email", "e@f.example")}
    empty = personal.memory_texts(s.limit(0), m.limit(0))
    assert personal.find(empty, personal.learn(empty, spark.createDataFrame([], "given_name string")), ["record_key"]).count() == 0
