from pyspark.sql import functions as F
import random

import pytest

from palimpsest.llm.lookalike import consistent, lookalike_pairs, membership

SAME = [
    ("scope", "ѕсоре"),  # whole word in Cyrillic letters
    ("The cat sat", "Тhe сat ѕаt"),
    ("Привет, мир и кот", "Пpивeт, миp и кoт"),  # Latin letters in Cyrillic words
    ("full width 12", "ｆｕｌｌ　ｗｉｄｔｈ　１２"),
    ("café Ångström", "café Ångström"),
    ("office ﬂow", "oﬃce flow"),
    ("zero width", "ze​ro wi­dth﻿"),
    ("a b c", "a b c"),
    ("ガギ", "ｶﾞｷﾞ"),
    ("ё", "ё"),
    ("line\nbreak", "line\r\nbreak"),
]
DIFFERENT = [("cafe", "café"), ("x2", "x²"), ("Cat", "cat"), ("l0g", "log"), ("two words", "twowords"), ("a  b", "a b"), ("👩‍🌱", "👩🌱"), ("line\nbreak", "line break"), ("α", "a")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert consistent(a) != consistent(b)


def test_script_of_the_text_is_kept():
    assert consistent("Кот ест сок и рис") == "Кот ест сок и рис"
    assert consistent("Кот ест coк и риc") == "Кот ест сок и рис"
    assert consistent("plain text") == "plain text" and consistent("") == "" and consistent(None) is None


def test_idempotent():
    rng = random.Random(5)
    letters = "aаoоcсpрxхeеyуЖλΑA é́​ ﬁ１。Я"
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert consistent(consistent(t)) == consistent(t)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id bigint, text string, look string, exact string")


def test_pairs_and_classes(spark):
    rows = [(1, "same text"), (2, "ѕame text"), (3, "same text"), (4, "other"), (5, None), (6, ""), (7, "​"), (2, "ѕame text"), (8, "long " * 20000), (9, "lоng " * 20000)]
    df = _docs(spark, rows)
    got = {tuple(r) for r in lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (8, 9)}
    classes = {r["id"]: (r["class_id"], r["text_class_id"]) for r in membership(df).collect()}
    assert classes[3] == (1, 1) and classes[2] == (1, 2) and classes[7] == (6, 7) and 5 not in classes


def test_large_group_of_copies_is_not_expanded(spark):
    rows = [(i, "copy") for i in range(100)] + [(1000, "сopy"), (1001, "сopу")]
    got = {tuple(r) for r in lookalike_pairs(_docs(spark, rows), expand=10).collect()}
    assert got == {(0, 1000), (0, 1001), (1000, 1001)}


def test_empty(spark):
    assert lookalike_pairs(_docs(spark, [])).count() == 0 and membership(_docs(spark, [])).count() == 0


def test_script_report(spark):
    from palimpsest.llm.lookalike import script_report, scripts_column

    assert script_report("plain words") == ("Latin", 0, 0) and script_report("12 !") == (None, 0, 0)
    assert script_report("the p\u0430yment of \u0430\u0441\u0435 players") == ("Latin", 1, 1)
    assert script_report("\u0440\u0430\u0437\u0433\u043e\u0432\u043e\u0440 \u043f\u0440\u043e ace") == ("Cyrillic", 0, 1)
    df = spark.createDataFrame([("p\u0430y",), (None,), ("",)], "t string").select(scripts_column(F.col("t")).alias("s")).select("s.*")
    assert [tuple(r) for r in df.collect()] == [("Latin", 1, 0), (None, None, None), (None, 0, 0)]
