import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.leakage import SeedIndex, alignment_scores, blocks_of_items, leak_report, leaked_documents, smith_waterman, words_of

PASSAGE = "The quick brown fox jumps over the lazy dog, while seven wizards brew strong tea near the old harbour"


def _items(spark, rows):
    return spark.createDataFrame(rows, "question_id string, passage string, question string, doc_id bigint")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "q", "p") for i, t in rows], "doc_id bigint, text string, question_id string, passage string")


def test_words():
    assert words_of("Don't stop—NOW, ｆｕｌｌ ѕсоре!") == ["don", "t", "stop", "now", "full", "scope"] and words_of(None) == [] and words_of("") == []


def _score(a, b):
    """The recurrence, a cell at a time."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=14))
def test_alignment(a, b):
    code = lambda w: np.array([ord(x) for x in w], dtype=np.int64)
    score, matched, first, last = smith_waterman(code(a), code(b))
    assert score == _score(a, b) and 2 * matched >= score and (not score or a and b[first : last + 1])
    assert _score(a, b[first : last + 1]) == score
    assert list(alignment_scores([(code(a), code(b)), (code(b), code(a)), (code("abc"), code("xabcx"))], block=2)) == [score, score, 6]


def test_whole_partial_and_edited(spark):
    items = _items(spark, [("q1", PASSAGE, "Where did seven wizards brew their strong tea on that cold day in May?", 1), ("q2", None, "short", 2), (None, PASSAGE, None, 3)])
    ten = "fox jumps over the lazy dog while seven wizards brew"
    docs = _docs(spark, [
        (1, "Intro. " + PASSAGE.upper() + " Outro."),
        (2, "xx " + ten.replace(" ", "\n> ") + " yy"),
        (3, "xx " + " ".join(ten.split()[:9]) + " yy"),  # nine words
        (4, "fox jumps over the rather lazy dog while seven indeed wizards brew strong tea near the old harbour"),
        (5, None), (6, ""), (7, "nothing " * 50000), (1, "Intro. " + PASSAGE.upper() + " Outro."),
        (8, "WHERE DID SEVEN WIZARDS BREW THEIR STRONG TEA ON THAT cold day in may"),
    ])
    assert {tuple(r) for r in leaked_documents(docs, items).collect()} == {(1, "q1"), (2, "q1"), (8, "q1")}
    report = {(r["doc_id"], r["field"]): r for r in leak_report(docs, items).collect()}
    assert report[(4, "passage")]["run_words"] < 10 and report[(4, "passage")]["score"] >= 16
    assert {tuple(r) for r in blocks_of_items(docs, items, 3).where("run_words >= 10").select("doc_id", "question_id").distinct().collect()} == {(1, "q1"), (2, "q1"), (8, "q1")}


def test_against_brute_force():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(f"q{k}", "passage", " ".join(rng.choice(vocab) for _ in range(25))) for k in range(30)]
    index = SeedIndex(items, 10, common=2)
    for _ in range(200):
        q, _, t = rng.choice(items)
        w = t.split()
        a = rng.randint(0, 15)
        doc = [rng.choice(vocab) for _ in range(10)] + w[a : a + rng.randint(5, 14)] + [rng.choice(vocab) for _ in range(10)]
        want = set()
        for name, _, text in items:
            x = text.split()
            if any(doc[i : i + 10] == x[j : j + 10] for i in range(len(doc) - 9) for j in range(len(x) - 9)):
                want.add(name)
        assert {r[0] for r in index.find([None, " ".join(doc)], 10**6)[1]} == want


def test_empty(spark):
    none, items = _docs(spark, []), _items(spark, [("q", PASSAGE, "x", 1)])
    assert leaked_documents(none, items).count() == 0 and leaked_documents(_docs(spark, [(1, PASSAGE)]), _items(spark, [])).count() == 0


def test_ambiguous_words_in_a_text_of_another_script(spark):
    """Words that could be Cyrillic by their look count as what they look like, whatever script their text is in."""
    said = "gift budget did my neighbour bring to the old house on a friday after September"
    odd = said.replace("did", "\u0501\u0456\u0501").replace(" a ", " \u0430 ")
    docs = spark.createDataFrame([(1, "\u0420\u0430\u0437\u0433\u043e\u0432\u043e\u0440 \u043f\u0440\u043e \u0435\u0449\u0451 \u043d\u0435 \u0433\u043e\u0442\u043e\u0432\u0430. " + odd)], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", said, None)], "question_id string, passage string, question string")
    assert [tuple(r) for r in leaked_documents(docs, items).collect()] == [(1, "q")]
