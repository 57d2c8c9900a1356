import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import conflict, dedup, evaluation, ingest, render, retrieve
from palimpsest.sources import artifacts, store
from palimpsest.sources.schema import MEMORIES, Config
from palimpsest.streaming import ingest as stream

TURNS = "session_id string, user_id string, session_date string, turns array<struct<role:string,content:string,has_answer:boolean>>, arrived_at timestamp"


def _memory(**over):
    base = dict.fromkeys([c.strip().split(" ")[0] for c in "id,user_id,content,created_at,salience,source,supersedes,turns,round_key,kind,fact,raw,subject,predicate,object,valid_time,time_mention,pair_key,last_accessed,initial_salience,embedding".split(",")])
    base |= {"user_id": "u", "content": "c", "created_at": "2023-01-01", "salience": 1.0, "kind": "round", "initial_salience": 1.0, "last_accessed": "2023-01-01"}
    return base | over


def _memories(spark, rows):
    names = [c.split(" ")[0] for c in _memory()]
    return spark.createDataFrame([tuple(_memory(**r)[n] for n in names) for r in rows], MEMORIES)


def test_rounds(spark):
    t = [("user", "a", None), ("assistant", " b\n", True), ("assistant", "c", None), ("user", " ", None), ("user", "d", False), ("system", "e", None), ("assistant", "f", None)]
    s = spark.createDataFrame([("s", "u", None, t, None), ("empty", None, "2023", [], None), ("none", None, None, None, None), ("blank", "u", "x", [("user", "\u00a0", None)], None)], TURNS)
    got = [(r["roles"], r["text"], r["has_evidence"]) for r in ingest.rounds(s).orderBy("round_no").collect()]
    assert got == [("user+assistant", "a\nb", True), ("assistant", "c", False), ("user", "d", False), ("system", "e", False), ("assistant", "f", False)]


def test_greedy_walk_against_model(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64))
    rows = [{"id": i, "user_id": f"u{rng.integers(2)}", "kind": ["round", "fact"][rng.integers(2)], "created_at": f"2023-01-0{rng.integers(1, 4)}", "embedding": (base[rng.integers(6)] + rng.normal(size=64) * 0.17).astype("f4").tolist()} for i in range(150)]
    rows += [{"id": 900, "embedding": None}, {"id": 901, "embedding": [0.0] * 64}, {"id": 902, "embedding": [1.0]}]
    df = _memories(spark, rows)
    for session in (True, False):
        got = {(r["id"], r["neighbour"]) for r in dedup.greedy_drops(dedup.near_links(df), session).collect()}
        want, stored = set(), {}
        for r in rows[:150]:
            v = np.asarray(r["embedding"], "f4").astype(float)
            v /= np.linalg.norm(v)
            near = stored.setdefault((r["user_id"], r["kind"]), [])
            best = min(((-round(float(v @ x), 6), i, t) for i, t, x in near), default=None)
            if best and -best[0] >= 0.95 and (best[2] == r["created_at"] or not session):
                want.add((r["id"], best[1]))
            else:
                near.append((r["id"], r["created_at"], v))
        assert got == want


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 64))
    df = _memories(spark, [{"id": i, "embedding": (base[rng.integers(4)] + rng.normal(size=64) * 0.15).astype("f4").tolist()} for i in range(60)])
    for k in range(3):
        stream.packed_records(df.where(F.col("id").between(20 * k, 20 * k + 19))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.run_available(stream.stream_dedup(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["id"], r["neighbour"]) for r in spark.read.schema("id bigint, neighbour bigint, cosine double").parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["id"], r["neighbour"]) for r in dedup.greedy_drops(dedup.near_links(df)).collect()}


def test_stream_walk_of_a_busy_key():
    """6,000 records of one key, in two batches of which the second has smaller ids too: whole, in seconds, with few calls to the state."""

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            return iter(self.rows)

        def appendList(self, rows):
            self.rows, self.calls = self.rows + rows, self.calls + 1

    rng = np.random.default_rng(3)
    x = (rng.normal(size=(1500, 64))[rng.integers(1500, size=6000)] + rng.normal(size=(6000, 64)) * 0.17).astype("f4")
    ids, ts = rng.permutation(6000), rng.choice(["2023-01-01", "2023-01-02"], 6000)
    df = pd.DataFrame({"id": ids, "ts": ts, "vec": [v.tobytes() for v in x]})
    walk = stream.GreedyDedup()
    walk.stored, began = State(), time.perf_counter()
    got = pd.concat([g for b in (df[:4000], df[4000:]) for g in walk.handleInputRows(None, iter([b[:1000], b[1000:]]), None)])
    assert time.perf_counter() - began < 10 and walk.stored.calls <= 12
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosine, stored, want = np.round(u @ u.T, 6), set(), []
    for k in [*sorted(range(4000), key=lambda k: ids[k]), *sorted(range(4000, 6000), key=lambda k: ids[k])]:
        near = [(-cosine[k, j], ids[j], j) for j in np.flatnonzero(cosine[k] >= 0.95) if j in stored]
        if near and ts[min(near)[2]] == ts[k]:
            want.append((ids[k], min(near)[1], -min(near)[0]))
        else:
            stored.add(k)
    assert [tuple(r) for r in got.itertuples(index=False)] == want and len(want) > 500
    assert sorted(r[0] for r in walk.stored.rows) == sorted(ids[list(stored)])


def test_exact_duplicates(spark):
    df = _memories(spark, [{"id": 1, "content": "Hello!"}, {"id": 2, "content": " hello"}, {"id": 3, "content": "hello", "kind": "fact"}, {"id": 4, "content": "Hello", "kind": "fact", "created_at": "2024-01-01"}, {"id": 5, "content": None}])
    assert {tuple(r) for r in dedup.exact_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_contradictions(spark):
    fact = lambda i, o, vt=None, at="2023-01-01", p="lives in", raw="user: x": {"id": i, "kind": "fact", "pair_key": f"user|{p}", "subject": "user", "predicate": p, "object": o, "valid_time": vt, "created_at": at, "raw": raw}
    df = _memories(spark, [fact(1, "Boston"), fact(2, "Seattle", at="2023-06-01"), fact(3, "Rome", vt="2019", at="2023-07-01"), fact(4, "jazz", p="like"), fact(5, "rock", p="like"), {"id": 6}])
    losers = {tuple(r) for r in conflict.resolve_all(conflict.keyed_facts(df)).collect()}
    assert losers == {(1, 2, "functional"), (3, 2, "functional")}
    done = {r["id"]: r for r in conflict.consolidate(df).collect()}
    assert done[1]["salience"] == 0 and done[2]["supersedes"] == 3 and done[2]["salience"] > 0 and done[4]["salience"] > 0
    again = {r["id"]: (r["salience"], r["supersedes"]) for r in conflict.consolidate(conflict.consolidate(df)).collect()}
    assert again == {i: (r["salience"], r["supersedes"]) for i, r in done.items()}


@pytest.mark.parametrize("initial,days,want", [(1.0, 30, 0.5), (1.0, 60, 0.25), (1.0, 90, 0.15), (0.25, 30, 0.15), (0.1, 30, 0.1)])
def test_decay(spark, initial, days, want):
    got = spark.range(1).select(conflict.decayed(F.lit(initial), F.lit(days)).alias("s")).first()["s"]
    assert abs(got - want) < 1e-12


def test_rank_rounds(spark):
    v = lambda c: [float(c), float((1 - c * c) ** 0.5)] + [0.0] * 62
    df = _memories(spark, [{"id": 1, "round_key": "A", "salience": 0.25, "embedding": v(0.9)}, {"id": 2, "round_key": "B", "embedding": v(0.8)}, {"id": 3, "round_key": "C", "embedding": v(0.5)}, {"id": 4, "round_key": "A", "embedding": v(0.3)}, {"id": 5, "embedding": None}, {"id": 6, "user_id": "w", "embedding": v(1.0)}])
    q = spark.createDataFrame([(1, "u", v(1.0)), (2, "nobody", v(1.0)), (3, "u", None)], "qid bigint, user_id string, embedding array<float>")
    ids = lambda k: [r["id"] for r in retrieve.rank_rounds(q, df, k).orderBy("rank").collect()]
    assert ids(2) == [2, 3] and ids(3) == [2, 3, 4]
    with pytest.raises(ValueError):
        retrieve.Weights(similarity=-1)


def test_budget_and_floor(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 50), (1, 2, 0.5, 10), (1, 3, 0.4, 1)], "qid int, rank int, similarity double, cost bigint")
    assert [r["rank"] for r in retrieve.within_budget(hits, F.col("cost"), 20).collect()] == [1]
    assert retrieve.above_floor(hits, 0.45).count() == 2 and retrieve.above_floor(hits, 0).count() == 3


def test_render(spark):
    turns = "array<struct<role:string,content:string>>"
    items = spark.createDataFrame([(1, "2023-02", 2, [("user", "b")]), (1, "2023-01", 1, [("user", "a"), ("assistant", None)]), (1, None, 0, [("user", "z")]), (1, "2023-02", 3, [("user", "c")])], f"g int, ts string, id int, turns {turns}")
    assert render.render(items, "g").first()["context"] == "user: z\n[Session date: 2023-01]\nuser: a\nassistant: \n[Session date: 2023-02]\nuser: b\nuser: c"
    facts = items.where("id = 2").withColumn("facts", F.array(F.struct(F.lit("f").alias("fact"), F.lit("2020").alias("valid_time"), F.lit("user: r").alias("raw"))))
    assert render.render(facts, "g", "round+facts").first()["context"] == "[Session date: 2023-02]\nfacts:\n- f (2020)\nuser: b"
    assert render.render(facts, "g", "facts").first()["context"] == "[Session date: 2023-02]\nfact: f (2020)\nsource: user: r"
    with pytest.raises(ValueError):
        render.render(items, "g", "pages")


def test_unknown_category_is_an_error(spark):
    df = spark.createDataFrame([("no-such", "q", "a", "r", False)], "c string, q string, a string, r string, x boolean")
    with pytest.raises(Exception, match="no prompt"):
        df.select(render.judge_prompt(*[F.col(c) for c in "cqarx"])).collect()


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read().count() == 0
    s.insert(_memories(spark, [{"id": 1, "initial_salience": None, "last_accessed": None}]))
    s.insert(_memories(spark, [{"id": 2, "kind": "fact"}]))
    s.update(spark.createDataFrame([(1, 0.5)], "id bigint, salience double"), ["salience"])
    rows = {r["id"]: r for r in s.read().collect()}
    assert s.versions() == [1, 2, 3] and rows[1]["salience"] == 0.5 and rows[1]["initial_salience"] == 1.0 and s.read(1).count() == 1
    with pytest.raises(store.GuardError):
        store.Store(spark, str(tmp_path / "s"), Config(dedup_scope="store"))
    for bad in ({"id": 3, "created_at": None}, {"id": 3, "kind": "other"}, {"id": 3, "salience": 1.5}):
        with pytest.raises(Exception, match="missing|unknown|not in"):
            s.insert(_memories(spark, [bad]))
    with pytest.raises(ValueError):
        Config(chunk_tokens=10, chunk_overlap=10)


def test_artifacts(spark, tmp_path):
    sheet = spark.createDataFrame([("1", "Yes"), ("2", " n "), ("3", None)], "row_id string, human string")
    artifacts.write_sheet(sheet, str(tmp_path / "sheet"))
    assert {tuple(r) for r in artifacts.read_labels(spark, str(tmp_path / "sheet")).collect()} == {("1", True), ("2", False), ("3", None)}
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_sheet(sheet, str(tmp_path / "sheet"))
    reg = spark.createDataFrame([("a", "d", "x", "r", "5", "pending", "y", "open", "c"), ("b", "d", "x", "r", "5", "4/5", "y", "open", "c")], "run_id string, date string, arm string, reader string, n string, score string, clean string, status string, claim string")
    ok = store.registry_merge(reg, spark.createDataFrame([("a", "done", "5/5")], "run_id string, status string, score string")).collect()
    assert {(r["run_id"], r["status"], r["score"]) for r in ok} == {("a", "done", "5/5"), ("b", "open", "4/5")}
    with pytest.raises(Exception, match="final"):
        store.registry_merge(reg, spark.createDataFrame([("b", "done", "5/5")], "run_id string, status string, score string")).collect()
    assert artifacts.markdown_table(sheet.where("row_id = '1'")) == "| row_id | human |\n| --- | --- |\n| 1 | Yes |"
    req = spark.createDataFrame([("x", "m", 'say "hi"\n', 5)], "custom_id string, model string, prompt string, max_tokens int")
    artifacts.write_requests(req, str(tmp_path / "req"))
    assert artifacts.read_requests(spark, str(tmp_path / "req")).first()["body"]["messages"][0]["content"] == 'say "hi"\n'


def test_chunks_and_replanning(spark):
    items = spark.createDataFrame([("g", i, c) for i, c in enumerate([4, 4, 4, 20, 1, 1])], "g string, o int, c bigint")
    planned = evaluation.plan_chunks(items, "g", "o", "c", 10)
    assert [r["chunk"] for r in planned.orderBy("o").collect()] == [0, 0, 1, 2, 3, 3]
    state = planned.withColumn("status", F.when(F.col("chunk") == 0, "completed").when(F.col("chunk") == 1, "failed"))
    again = evaluation.replan(items, state, "g", "o", "c", 5)
    assert [(r["o"], r["chunk"]) for r in again.orderBy("o").collect()] == [(2, 1), (3, 2), (4, 3), (5, 3)]


def test_empty_inputs(spark):
    m = _memories(spark, [])
    assert dedup.near_links(m).count() == 0 and dedup.exact_duplicates(m).count() == 0 and conflict.consolidate(m).count() == 0 and conflict.now_logical(m).count() == 0
    assert render.export_lines(m).count() == 0 and retrieve.rank_rounds(m.select(F.col("id").alias("qid"), "user_id", "embedding"), m).count() == 0
    assert ingest.fact_pieces(ingest.rounds(spark.createDataFrame([], TURNS))).count() == 0


def test_conflict_demo(spark):
    rows = {r["family"]: r for r in evaluation.demo_result(spark).collect()}
    assert set(rows) == set(evaluation.DEMO) and all(r["passes"] and r["pairs"] == evaluation.DEMO[f][0] for f, r in rows.items())
    assert evaluation.demo_pairs(1) == evaluation.demo_pairs(1) != evaluation.demo_pairs(2)


def test_render_json(spark):
    import json

    turns = "array<struct<role:string,content:string>>"
    items = spark.createDataFrame([(1, None, 0, [("user", "z")]), (1, "2023-01", 1, [("user", "a"), ("assistant", None)]), (1, "2023-01", 2, [("user", "b")])], f"g int, ts string, id int, turns {turns}")
    got = json.loads(render.render_json(items, "g").first()["context"])
    assert got == [{"session_date": None, "turns": [{"role": "user", "content": "z"}]}, {"session_date": "2023-01", "turns": [{"role": "user", "content": "a"}, {"role": "assistant", "content": ""}, {"role": "user", "content": "b"}]}]
    facts = items.where("id = 2").withColumn("facts", F.array(F.struct(F.lit("f").alias("fact"), F.lit("2020").alias("valid_time"), F.lit("user: r").alias("raw"))))
    assert json.loads(render.render_json(facts, "g", "facts").first()["context"]) == [{"session_date": "2023-01", "items": [{"facts": [{"fact": "f", "valid_time": "2020", "source": "user: r"}]}]}]


def test_stages(spark):
    q = spark.createDataFrame([("q1", "multi-session", "who?", "me", False, "ctx"), ("q2", "multi-session", "what?", "tea", False, "ctx")], "question_id string, category string, question string, answer string, is_abstention boolean, context string")
    p = evaluation.answer(q, lambda pairs: [a.upper() for a, _ in pairs], 1)
    assert {r["predicted"] for r in p.collect()} == {"WHO?", "WHAT?"}
    all_, fresh = evaluation.judge(p, lambda prompt: " Yes." if "WHO" in prompt else "no")
    verdicts = spark.createDataFrame(all_.collect(), all_.schema)
    assert {r["question_id"]: r["correct"] for r in verdicts.collect()} == {"q1": True, "q2": False}
    again, more = evaluation.judge(p, lambda prompt: 1 / 0, verdicts)
    assert more.count() == 0 and again.count() == 2


def test_conflict_stream_equals_all_pairs(spark):
    """The stream finds what comparing every pair in order finds, over keys with many facts and few batches."""
    import random

    from palimpsest.functions import triples
    from palimpsest.operators import conflict

    r = random.Random(3)
    said = {"lives in": ["Boston", "Seattle", "the Boston", "a b c d e f g h"], "have": ["2 cats", "three cats", "about 2 cats", "a dog", "no dog", "no 2 cats"], "like": ["jazz", "tea", "not jazz"]}
    rows = []
    for i in range(400):
        p = r.choice(list(said))
        rows.append((i, r.choice(["u", "v", "v", None]), r.choice(["user", "user", "assistant"]) if p == "like" else "user", r.choice([p, p, f"no longer {p}"]), r.choice(said[p] + [None] * (r.random() < 0.05)), r.choice([None, "2022", "2023-01"]), f"2023-0{r.randint(1, 9)}-01", r.choice(["user: x", "assistant: x"]), p, "fact"))
    df = spark.createDataFrame(rows, "id bigint, user_id string, subject string, predicate string, object string, valid_time string, created_at string, raw string, pair_key string, kind string")
    facts = conflict.keyed_facts(df)
    a, b = facts.select("id", "user_id", "pair_key", "triple", "ok"), facts.select(F.col("id").alias("j"), F.col("user_id").alias("u"), F.col("pair_key").alias("k"), F.col("triple").alias("t2"), F.col("ok").alias("ok2"))
    pairs = a.join(b, (F.col("user_id") == F.col("u")) & (F.col("pair_key") == F.col("k")) & (F.col("id") < F.col("j"))).select("id", "j", (F.col("ok2") > F.col("ok")).alias("later"), triples.conflict_rule(F.col("triple"), F.col("t2")).alias("rule"))
    dead, want = set(), set()
    for x in sorted(pairs.where("rule IS NOT NULL").collect(), key=lambda x: (x["j"], x["id"])):
        if x["id"] not in dead and x["j"] not in dead:
            lose, win = (x["id"], x["j"]) if x["later"] else (x["j"], x["id"])
            dead.add(lose)
            want.add((lose, win, x["rule"]))
    assert {tuple(x) for x in conflict.resolve_all(facts).collect()} == want and len(want) > 50
