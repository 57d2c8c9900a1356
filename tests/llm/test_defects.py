import pytest

from palimpsest.llm import defects as d

Q = "Where did I put the violin bow after Tamerobu?"
EN = "the notes say that you put the lens cloth in the balcony and the trail shoe in the garage because it was cheaper"


@pytest.fixture(scope="module")
def model():
    return d.LanguageModel([("en", EN)] * 5 + [("de", "wir haben am abend die liste geprüft und einträge gelöscht")] * 5)


CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("...", "empty"), ("N/A", "empty"), ("<answer></answer>", "empty"), ("**Answer:** ", "empty"), ("​", "empty"),
    (Q, "copy"), ("You asked: " + Q, "copy"), (Q.upper(), "copy"), (f"> {Q}", "copy"), (f"{Q}\n{Q}", "copy"), ("Where did you put the violin bow after Tamerobu?", "copy"),
    ("Sorry, I don't know.", "refusal"), ("I'm sorry, but I can't help with that.", "refusal"), ("I have no record of Tamerobu. Please ask your aunt instead.", "refusal"), ("Non posso rispondere a questa domanda.", "refusal"),
    ("Вы сказали, что позже всё изменилось.", "other_language"), ("Du hast mir gesagt, dass es später geändert wurde.", "other_language"), ("四十分くらいです", "other_language"),
    ("It was in the balcony, next to the old boxes, and your aunt (which was the", "truncated"), ("You told me it was in the balc", "truncated"), ("It was in the garage and the", "truncated"), ("You noted it was in the shed.\n\n- ", "truncated"),
    ("In the balcony", None), ("In the balcony.", None), ("in the garage", None), ("It was in the garage.", None), ("I can't see every old chat, but in May you clearly said it was in the balcony.", None),
    ("Unfortunately it turned out to be in the balcony, which you did not like.", None), ('The note says "in the balcony"', None), ("You asked about Tamerobu. According to the notes it was in the garage.", None),
]


@pytest.mark.parametrize("predicted,want", CASES)
def test_cases(model, predicted, want):
    assert d.defect_of(model, set(), False, Q, "in the balcony", predicted) == want


def test_refusing_is_right_for_an_unanswerable_question(model):
    assert d.defect_of(model, set(), True, Q, "You did not mention it.", "Sorry, I don't know.") is None
    assert d.defect_of(model, set(), True, Q, "You did not mention it.", "") == "empty"


def test_list_endings(model):
    t = "From May:\n- Tamerobu came up twice\n- the bow was left for later"
    assert d.defect_of(model, {"for later"}, False, Q, "in the balcony", t) is None
    assert d.defect_of(model, {"for later"}, False, Q, "in the balcony", t[:-12]) == "truncated"


def test_frame(spark):
    rows = [("r", str(i), False, Q, "in the balcony", p, "x") for i, (p, _) in enumerate(CASES)]
    rows += [rows[0], ("r", "n1", None, None, None, "word " * 30000, "x"), ("r", "n2", None, None, None, None, None), (None, None, None, Q, None, "In the shed.", "x")]
    df = spark.createDataFrame(rows, "run_id string, question_id string, is_abstention boolean, question string, answer string, predicted string, defect string")
    docs = spark.createDataFrame([("en", EN)] * 4 + [(None, EN), ("und", EN), ("EN-x", None)], "lang string, text string")
    got = [tuple(r) for r in d.flag_defects(df, d.fit_language_model(docs)).collect()]
    assert len(got) == len(set(got)) and ("r", "0", "empty") in got and ("r", "n2", "empty") in got
    assert d.flag_defects(df.limit(0), d.fit_language_model(docs.limit(0))).count() == 0


def test_language_model_counts_all_documents(spark):
    rows = [(lang, f"{text} {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[i // 100 % 5]} zz") for i in range(700) for lang, text in (("en", EN), ("de", "wir haben die liste geprüft"), ("ja", "四十分くらい 𐐨𐐩𐐪"))]
    docs = spark.createDataFrame([*rows, ("xx", "rare label"), ("und", EN), (None, EN), ("en", None)], "lang string, text string")
    whole, model = d.LanguageModel(rows), d.fit_language_model(docs)
    assert model.logp == whole.logp and model.rest == whole.rest
    assert {r["word"] for r in model.table.collect()} == whole.known
    last = ["balc", "Aaaku.", "aaakv", "jjj", "jjjt", "zz", "z", "geprüf", "四十分く", "𐐨𐐩", "nowhere", "12", "ＧＥＰ", "it's"]
    predictions = spark.createDataFrame([(f"In the {w}",) for w in last] + [(None,), ("",)], "predicted string")
    sent = model.over(predictions)
    ends = [d.words(f"In the {w}")[-1] for w in last]
    assert sent.table is None and [sent.cut(w) for w in ends] == [whole.cut(w) for w in ends] and sum(map(sent.cut, ends)) >= 5
