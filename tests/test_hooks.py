import pytest
from pyspark.sql import functions as F

from palimpsest.functions import extractors
from palimpsest.memory import Memory
from palimpsest.operators import conflict, ingest, render, retrieve
from palimpsest.sources import artifacts
from palimpsest.sources.schema import Config

SESSIONS = "session_id string, user_id string, session_date string, turns array<struct<role:string,content:string,has_answer:boolean>>"
RECORDS = "id bigint, user_id string, kind string, round_key string, salience double, fact string, content string, turns array<struct<role:string,content:string>>"


def test_rerank_members_and_scorer(spark):
    """A round is scored by the record that ranked it and its active facts, by any scorer; its other records do not count."""
    records = spark.createDataFrame([(1, "u", "round", "a", 1.0, None, "tea", None), (2, "u", "fact", "a", 1.0, "long fact here", "x", None), (3, "u", "fact", "a", 0.0, "a very long inactive fact indeed", "x", None), (4, "u", "round", "b", 1.0, None, "medium text", None), (5, "u", "round", "b", 1.0, None, "another much longer text of the round", None)], RECORDS)
    pool = spark.createDataFrame([(9, 1, 1, "a"), (9, 2, 4, "b")], "qid bigint, rank int, id bigint, round string")
    asked = spark.createDataFrame([(9, "u", "q")], "qid bigint, user_id string, question string")
    length = retrieve.pair_scorer(lambda pairs: [float(len(p)) for _, p in pairs])
    got = {r["round"]: (r["rank"], r["pair_score"]) for r in retrieve.rerank_rounds(pool, asked, records, 5, length).collect()}
    assert got == {"a": (1, 14.0), "b": (2, 11.0)}
    got = {r["round"]: r["pair_score"] for r in retrieve.rerank_rounds(pool, asked, records, 5, length, active_only=False).collect()}
    assert got == {"a": 32.0, "b": 11.0}


def test_tokenizer_windows(spark):
    letters = lambda t: [(i, i + 1) for i, c in enumerate(t) if c != " "]
    df = spark.createDataFrame([("s", 0, "ab cdefg"), ("s", 1, "xy"), ("s", 2, ""), ("s", 3, None)], "session_id string, round_no int, text string")
    got = {(r["round_no"], r["piece"]): r["text"] for r in ingest.window_pieces(df, 4, 1, letters).collect()}
    assert got == {(0, 0): "ab cd", (0, 1): "defg", (1, 0): "xy", (2, 0): ""}


FACTS = "id bigint, user_id string, kind string, pair_key string, fact string, subject string, predicate string, object string, valid_time string, created_at string, raw string"


def _fact(i, key, fact, s=None, p=None, o=None, at="2023-01-01"):
    return (i, "u", "fact", key, fact, s, p, o, None, at, "user: x")


def test_resolve_new(spark):
    rows = [_fact(1, "user|lives in", "f", "user", "lives in", "Boston"), _fact(2, "user|drives", "f", "user", "drives", "a van"), _fact(3, "user|drives", "f", "user", "drives", "a car"), _fact(4, "user|lives in", "f", "user", "moved to", "Oslo", "2023-05-01"),
            _fact(5, None, "The user likes tea."), _fact(6, None, "The user never likes tea.", at="2023-06-01"), _fact(7, None, "The assistant likes tea."), _fact(8, None, "The user likes no tea.", at="2022-06-01")]
    facts = conflict.ordered_facts(spark.createDataFrame(rows, FACTS))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    pairs = spark.createDataFrame([(6, 5), (7, 5), (8, 5), (4, 1)], "id bigint, neighbour bigint")
    got = {tuple(r) for r in conflict.resolve_new(facts, ids(4, 6, 7, 8), pairs).collect()}
    assert got == {(1, 4, "functional"), (5, 6, "negation"), (8, 5, "negation")}  # the key of 2 and 3 is not touched
    assert {tuple(r) for r in conflict.resolve_new(facts, ids(2)).collect()} == {(2, 3, "functional")}
    said = facts.select("id", conflict.of_assistant(F.col("triple"), F.col("fact")).alias("a")).where("a").collect()
    assert [r["id"] for r in said] == [7]


def test_plain_ingest_stores_copies(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), Config())
    s = spark.createDataFrame([("a", "u", "2023-01-05", [("user", "I live in Boston.", None)])], SESSIONS)
    assert m.add(s, screens=False)["pieces"] == 1 and m.add(s, screens=False)["exact"] == 0
    assert m.store.read().count() == 2


def test_other_rules_are_refused(spark, tmp_path, monkeypatch):
    Memory(spark, str(tmp_path / "m"), Config())
    monkeypatch.setattr(extractors.triples, "MAX_VALUE_WORDS", 7)
    with pytest.raises(ValueError, match="conflict_rules"):
        Memory(spark, str(tmp_path / "m"), Config())


def test_reader_prompt(spark):
    p = spark.range(1).select(render.reader_prompt(F.lit("{q} ctx"), F.lit("why?"), F.lit(None).cast("string"), F.lit("7")).alias("p")).first()["p"]
    assert p.startswith("7\n\nI will give you") and "History Chats:\n\n{q} ctx\n\nCurrent Date: \nQuestion: why?\nAnswer" in p


def test_probe_rows(spark, tmp_path):
    rows = spark.createDataFrame([("q1", [1, -1], [("s", 0, "exact", None, None, True, 0, "round")], 3)], "question_id string, evidence_ranks array<int>, drops array<struct<session_id:string,round_index:int,screen:string,cosine:double,neighbour_session_id:string,is_evidence:boolean,piece:int,kind:string>>, n_rounds int")
    artifacts.write_probes(rows, str(tmp_path / "p"))
    r = artifacts.read_probes(spark, str(tmp_path / "p")).first()
    assert r["evidence_ranks"] == [1, -1] and r["drops"][0]["screen"] == "exact" and r["n_rounds"] == 3 and r["superseded"] == 0 and r["conflicts"] == {} and r["top_sessions"] == [] and r["category"] is None
    with pytest.raises(Exception, match="exist"):
        artifacts.write_probes(rows, str(tmp_path / "p"))
