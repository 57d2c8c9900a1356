from pyspark.sql import functions as F

from palimpsest.functions import extraction, extractors
from palimpsest.memory import Memory
from palimpsest.sources.schema import Config

SESSIONS = "session_id string, user_id string, session_date string, turns array<struct<role:string,content:string,has_answer:boolean>>"


def _fact(content, raw, o, when=None):
    return (content, raw, when, "user", "lives in", o, 1.0)


SCRIPT = {
    "I live in Boston.": [_fact("The user lives in Boston.", "user: I live in Boston.", "Boston")],
    "I moved to Seattle.": [("The user moved to Seattle.", "user: I moved to Seattle.", None, "user", "moved to", "Seattle", 1.0)],
}


def test_write_and_read(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), Config(render_unit="round+facts"), extractors.scripted(SCRIPT))
    s1 = spark.createDataFrame([("a", "u", "2023-01-05", [("user", "I live in Boston.", None), ("assistant", "Nice.", None)])], SESSIONS)
    s2 = spark.createDataFrame([("b", "u", "2023-06-05", [("user", "I moved to Seattle.", None), ("user", "Thanks!", None), ("user", "I live in Boston.", None)])], SESSIONS)
    first = m.add(s1)
    assert first["pieces"] == 2 and first["exact"] == 0
    m.add(s2)
    facts = {r["object"]: r for r in m.store.read().where("kind = 'fact' AND created_at LIKE '2023-06%'").collect()}
    old = m.store.read().where("kind = 'fact' AND created_at LIKE '2023-01%'").first()
    assert facts["Seattle"]["pair_key"] == "user|lives in" and old["salience"] == 0
    again = m.add(s2.withColumn("session_id", s2.session_id))
    assert again["exact"] >= 2
    q = spark.createDataFrame([(1, "u", "[Current date: 2023-06-06]\nwhere do I live? Seattle")], "qid bigint, user_id string, query string")
    text = m.context(q, 3).first()["context"]
    assert "[Session date: 2023-06-05]" in text and "- The user moved to Seattle." in text
    m.consolidate()
    before = {r["id"]: r["salience"] for r in m.store.read().collect()}
    m.consolidate()
    assert before == {r["id"]: r["salience"] for r in m.store.read().collect()}
    assert m.export().count() == m.store.read().count() and m.export(markdown=True).count() > 0


ROUND = "key string, turns array<struct<role:string,content:string>>"


def _facts(df):
    return {r["key"]: [f["content"] for f in r["facts"]] for r in df.collect()}


def test_extractors(spark):
    rounds = spark.createDataFrame([("a", [("user", "I like tea."), ("assistant", "I do too.")]), ("b", [("assistant", "hm")])], ROUND)
    assert _facts(extractors.rules(rounds)) == {"a": ["The user like tea."], "b": []}
    assert _facts(extractors.scripted({"I like tea.": SCRIPT["I live in Boston."]})(rounds)) == {"a": ["The user lives in Boston."], "b": []}
    said = lambda turns: ([(f"said {turns[0][1]}", "user: x", None, None, None, None, 1.0)], False)
    paths = spark.createDataFrame([("a", [("user", "C:\\a\\b")]), ("b", [("user", "none")])], ROUND)
    assert _facts(extractors.escaping(extractors.model(said))(paths)) == {"a": ["said C:\\a\\b"], "b": ["said none"]}
    assert extractors.digest({"b": 1, "a": 2}) == extractors.digest({"a": 2, "b": 1}) and len(extractors.rule_digests()) == 3


def test_splitting(spark):
    """Pieces are read where the whole is empty, full or broken, and taken where they hold more."""
    fact = lambda s: (s, "assistant: " + s, None, None, None, None, 0.5)

    def said(turns):
        text = " ".join(t for _, t in turns)
        if "broken" in text:
            return [], True
        if len(text) > 30:
            return ([fact(str(i)) for i in range(8)] if "full" in text else []), False
        return [fact(text)], False

    rows = [("long", "Aaaa aaaa. Bbbb bbbb. Cccc cccc."), ("full", "full aaaa. Bbbb bbbb. Cccc cccc."), ("short", "hi"), ("bad", "Aaaa aaaa. broken bb. Cccc cccc.")]
    rounds = spark.createDataFrame([(k, [("user", "Q?"), ("assistant", t)]) for k, t in rows], ROUND)
    out = extractors.splitting(extractors.model(said), 12)(rounds)
    got = _facts(out)
    assert got["long"] == ["Q? Aaaa aaaa.", "Bbbb bbbb.", "Cccc cccc."] and len(got["full"]) == 8 and got["short"] == ["Q? hi"] and got["bad"] == ["Q? Aaaa aaaa.", "Cccc cccc."]
    assert {r["key"]: r["truncated"] for r in out.collect()} == {"long": False, "full": False, "short": False, "bad": True}


def test_source_of(spark):
    df = spark.createDataFrame([("likes tea", "", [("user", "I said: likes tea.")]), ("likes tea", "user: q", [("user", "x")]), ("zzz", None, [("user", "x")])], "c string, r string, turns array<struct<role:string,content:string>>")
    assert [r["s"] for r in df.select(extraction.source_of(F.col("c"), F.col("r"), F.col("turns")).alias("s")).collect()] == ["user: I said: likes tea.", "user: q", "user: zzz"]


def test_cached_extract(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(turns):
        calls.add(1)
        return [(turns[0][1], "user: x", None, None, None, None, 1.0)], False

    rounds = spark.createDataFrame([(1, [("user", "I like tea.")]), (2, [("user", "I like tea.")]), (3, [("user", "I own a cat.")])], "k int, turns array<struct<role:string,content:string>>")
    got, fresh = extractors.cached_extract(rounds, extractors.model(counting), None)
    assert fresh.count() == 2 and calls.value == 2
    got, more = extractors.cached_extract(rounds, extractors.model(counting), fresh)
    assert more.count() == 0 and {len(r["facts"]) for r in got.collect()} == {1} and calls.value == 2
