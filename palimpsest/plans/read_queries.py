"""Queries over retrieval and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import evaluation, ingest, render, retrieve
from palimpsest.plans.ingest_queries import ROUNDS_SQL, words_sql
from palimpsest.plans.write_queries import day_sql
from palimpsest.session import materialize, once, read_table

#: What ranking reads of a record; texts come in only where they are rendered.
_RANKED = ("user_id", "kind", "created_at", "salience", "round_key", "valid_time", "embedding")


def _records(spark, sf_dir, *cols):
    return materialize(once(read_table(spark, sf_dir, "memories").select("id", *(cols or _RANKED)), "id"), "records")


def _queries(records):
    """Every row whose id is divisible by 20, against all rows."""
    return records.where("id % 20 = 0").select(F.col("id").alias("qid"), "user_id", "embedding", F.lit("2023-01-01").alias("start_day"), F.lit("2024-12-31").alias("end_day"))


def _hits(df):
    return df.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("similarity", 4).alias("similarity"), F.round("score", 4).alias("score"))


def similarity_topk(spark, sf_dir):
    """Nearest records of any kind, superseded ones too."""
    r = _records(spark, sf_dir)
    return _hits(retrieve.rank_rounds(_queries(r).drop("start_day", "end_day"), r.withColumn("salience", F.lit(1.0)), 10, active_only=False, per_round=False))


def round_topk(spark, sf_dir):
    r = _records(spark, sf_dir)
    return _hits(retrieve.rank_rounds(_queries(r).drop("start_day", "end_day"), r.withColumn("salience", F.lit(1.0)), 10, active_only=False))


_W = retrieve.Weights(similarity=1.0, recency=0.2, time=0.05)


def recall_score(spark, sf_dir):
    r = _records(spark, sf_dir)
    return _hits(retrieve.rank_rounds(_queries(r), r, 10, _W))


def recall_updates(spark, sf_dir):
    r = _records(spark, sf_dir)
    q = _queries(r)
    hits = retrieve.above_floor(retrieve.rank_rounds(q, r, 10, _W), 0.5)
    return retrieve.recall_updates(hits, q, r)


def rerank_overlap(spark, sf_dir):
    r = _records(spark, sf_dir)
    q = _queries(r)
    pool = retrieve.rank_rounds(q, r, 50, _W)
    t = _records(spark, sf_dir, "user_id", "kind", "salience", "round_key", "fact", "turns", "content")
    asked = t.where("id % 20 = 0").select(F.col("id").alias("qid"), "user_id", F.col("content").alias("question"))
    return retrieve.rerank_rounds(pool, asked, t, 10).select("qid", F.col("rank").cast("bigint").alias("rank"), "round", F.round("pair_score", 6).alias("pair_score"))


def budget_prefix(spark, sf_dir):
    r = _records(spark, sf_dir)
    hits = retrieve.rank_rounds(_queries(r), r, 10, _W).join(_records(spark, sf_dir, "content").select("id", F.col("content").alias("body")), "id")
    return retrieve.within_budget(hits, text.cost_in_tokens(F.col("body")), 300).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", "spent")


def context_text(spark, sf_dir):
    r = _records(spark, sf_dir)
    hits = retrieve.rank_rounds(_queries(r), r, 10, _W).select("qid", "id")
    turns = F.coalesce(F.when(F.size("turns") > 0, F.col("turns")), F.array(F.struct(F.col("source").alias("role"), F.col("content").alias("content"))))
    t = _records(spark, sf_dir, "created_at", "turns", "source", "content")
    items = hits.join(t.select("id", F.col("created_at").alias("ts"), turns.alias("turns")), "id")
    return render.render(items, "qid").select("qid", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def context_with_facts(spark, sf_dir):
    r = _records(spark, sf_dir)
    hits = retrieve.rank_rounds(_queries(r), r, 10, _W).select("qid", "id")
    t = _records(spark, sf_dir, "user_id", "kind", "round_key", "created_at", "turns", "source", "content", "fact", "valid_time", "raw")
    facts = t.where("kind = 'fact'").groupBy("user_id", "round_key").agg(F.array_sort(F.collect_list(F.struct("id", "fact", "valid_time", "raw"))).alias("facts"))
    base = t.select("id", "user_id", "round_key", F.col("created_at").alias("ts"), F.coalesce("turns", F.array(F.struct(F.col("source").alias("role"), F.col("content").alias("content")))).alias("turns"))
    items = hits.join(base, "id").join(facts, ["user_id", "round_key"], "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<id:bigint,fact:string,valid_time:string,raw:string>>")))
    return render.render(items, "qid", "round+facts").select("qid", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def session_texts(spark, sf_dir):
    s = ingest.with_defaults(ingest.sessions_once(read_table(spark, sf_dir, "sessions")))
    return s.select("session_id", render.session_text(F.col("session_date"), F.col("turns")).alias("context"))


def _export(spark, sf_dir):
    cols = ("user_id", "kind", "content", "created_at", "salience", "source", "turns", "round_key", "fact", "valid_time", "pair_key", "supersedes", "initial_salience")
    return once(read_table(spark, sf_dir, "memories").select("id", *cols), "id")


def export_text(spark, sf_dir):
    return render.export_lines(_export(spark, sf_dir)).select("user_id", "ts", F.coalesce("round_id", F.lit(-1)).alias("round_id"), "fact_id", "line")


def export_markdown(spark, sf_dir):
    return render.markdown_bullets(_export(spark, sf_dir))


def judge_prompts(spark, sf_dir):
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "category", "is_abstention", "question", "answer", "predicted"), "run_id", "question_id").where("category IS NOT NULL")
    prompt = render.judge_prompt(F.col("category"), F.col("question"), F.col("answer"), F.col("predicted"), F.col("is_abstention"))
    return p.select("run_id", "question_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("chars"))


def trimmed_contexts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = text.keep_last(F.col("text"), 400)
    return d.select("doc_id", F.md5(kept).alias("kept_md5"), (F.greatest(F.lit(0), F.length("text") - 400) / 4).cast("bigint").alias("tokens_dropped"), text.cost_in_tokens(kept).alias("tokens"))


def hashed_embeddings(spark, sf_dir):
    """Vectors of all stored texts."""
    m = once(read_table(spark, sf_dir, "memories").select("id", "content"), "id")
    return m.select("id", retrieve.hash_embedding_column(F.col("content")).alias("embedding"))


def probe_ranks(spark, sf_dir):
    """Where a fact's own round stands among the 50 best rounds for the fact's vector."""
    r = _records(spark, sf_dir)
    f = r.where("kind = 'fact' AND round_key IS NOT NULL")
    hits = retrieve.rank_rounds(_queries(f).drop("start_day", "end_day"), r.where("kind = 'round'"), 50)
    asked = _queries(f.where((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0))).select("qid").join(f.select(F.col("id").alias("qid"), F.col("round_key").alias("round")), "qid")
    return evaluation.probe_ranks(hits, asked).select("qid", F.col("rank").cast("bigint").alias("rank"))


def hit_carriers(spark, sf_dir):
    r = _records(spark, sf_dir)
    hits = retrieve.rank_rounds(_queries(r).drop("start_day", "end_day"), r.withColumn("salience", F.lit(1.0)), 10, active_only=False)
    return evaluation.carriers(hits, r)


def reader_prompts(spark, sf_dir):
    """Digest of what a reader is asked for each prediction, with the question's sessions as its context."""
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "question", "answer"), "run_id", "question_id")
    prompt = render.reader_prompt(F.col("answer"), F.col("question"), F.col("question_id"), F.col("run_id"))
    return p.select("run_id", "question_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("chars"))


def json_contexts(spark, sf_dir):
    s = ingest.with_defaults(ingest.sessions_once(read_table(spark, sf_dir, "sessions")))
    items = s.select("session_id", F.col("session_date").alias("ts"), F.lit(0).alias("id"), "turns")
    return render.render_json(items, "session_id")


def conflict_demo(spark, sf_dir):
    return evaluation.demo_result(spark)


QUERIES = {f.__name__: f for f in (probe_ranks, hit_carriers, reader_prompts, json_contexts, conflict_demo, similarity_topk, round_topk, recall_score, recall_updates, rerank_overlap, budget_prefix, context_text, context_with_facts, session_texts, export_text, export_markdown, judge_prompts, trimmed_contexts, hashed_embeddings)}

_R = """(SELECT id, any_value(user_id) AS user_id, any_value(kind) AS kind, any_value(content) AS content, any_value(created_at) AS created_at, any_value(salience) AS salience, any_value(source) AS source,
    any_value(turns) AS turns, any_value(round_key) AS round_key, any_value(fact) AS fact, any_value(valid_time) AS valid_time, any_value(raw) AS raw, any_value(embedding) AS embedding,
    any_value(pair_key) AS pair_key, any_value(supersedes) AS supersedes, any_value(initial_salience) AS initial_salience FROM memories GROUP BY id)"""
_BASE = f"""
    WITH r AS {_R},
    clock AS (SELECT user_id, max(struct_pack(d := {day_sql('created_at')}, ts := created_at)).ts AS now FROM r WHERE {day_sql('created_at')} IS NOT NULL GROUP BY user_id),
    e AS (SELECT r.*, now, CAST(embedding AS DOUBLE[]) AS v, coalesce(nullif(valid_time, ''), strftime({day_sql('created_at')}, '%Y-%m-%d')) AS eff FROM r LEFT JOIN clock USING (user_id)
          WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    pairs AS (SELECT q.id AS qid, m.*, round(list_cosine_similarity(q.v, m.v), 9) AS similarity, coalesce(m.round_key, 'id:' || m.id) AS round,
              pow(0.5, greatest(0, coalesce(date_diff('day', {day_sql('m.created_at')}, {day_sql('m.now')}), 0)) / 30.0) AS recency,
              CASE WHEN regexp_full_match(m.eff, '\\d+-\\d+-\\d+') AND try_cast(m.eff AS DATE) BETWEEN DATE '2023-01-01' AND DATE '2024-12-31' THEN 1.0
                   WHEN regexp_full_match(m.eff, '\\d+-\\d+') AND try_cast(m.eff || '-01' AS DATE) <= DATE '2024-12-31' AND last_day(try_cast(m.eff || '-01' AS DATE)) >= DATE '2023-01-01' THEN 1.0 ELSE 0.0 END AS tm
              FROM e q JOIN e m ON q.user_id = m.user_id WHERE q.id % 20 = 0)"""
_TOP = """, scored AS (SELECT *, round((similarity + 0.2 * recency + 0.05 * tm) * salience, 9) AS score FROM pairs WHERE salience > 0),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, round ORDER BY score DESC, similarity DESC, kind DESC, id) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, similarity DESC, kind DESC, id) AS rank FROM best),
    top AS (SELECT * FROM ranked WHERE rank <= 10)"""
_TURNS = "array_to_string(list_transform(CASE WHEN len(turns) > 0 THEN turns ELSE [struct_pack(role := source, content := content)] END, lambda t: coalesce(t.role, '') || ': ' || coalesce(t.content, '')), chr(10))"
_LINE4 = "printf('%.4f', {0})"
_STD = render.STANDARD


def _prompt_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fill = lambda t: f"replace(replace(replace({quote(t)}, '{{q}}', coalesce(question, '')), '{{a}}', coalesce(answer, '')), '{{r}}', coalesce(predicted, ''))"
    cases = " ".join(f"WHEN category = '{k}' THEN {fill(t)}" for k, t in render.PROMPTS.items())
    return f"CASE WHEN coalesce(is_abstention, false) THEN {fill(render.ABSTENTION)} {cases} END"


_FACT = """'  ' || concat_ws('  ', 'fact: ' || coalesce(fact, content), 'salience ' || CAST(CAST(salience AS DECIMAL(12,4)) AS VARCHAR), CASE WHEN abs(initial_salience - salience) > 1e-9 THEN '(initial ' || CAST(CAST(initial_salience AS DECIMAL(12,4)) AS VARCHAR) || ')' END,
    CASE WHEN salience = 0 THEN 'superseded' END, 'valid_time ' || nullif(valid_time, ''), 'pair ' || nullif(pair_key, ''), 'supersedes ' || supersedes)"""
ORACLES = {
    "probe_ranks": f"""WITH r AS {_R}, v AS (SELECT id, user_id, kind, round_key, salience, CAST(embedding AS DOUBLE[]) AS e FROM r WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        q AS (SELECT * FROM v WHERE kind = 'fact' AND round_key IS NOT NULL AND id % 20 = 0), p AS (SELECT q.id AS qid, m.id, coalesce(m.round_key, 'id:' || m.id) AS round, round(list_cosine_similarity(q.e, m.e), 9) AS c, m.salience AS s FROM q JOIN v m ON q.user_id = m.user_id WHERE m.kind = 'round' AND m.salience > 0),
        b AS (SELECT *, round(c * s, 9) AS score FROM p QUALIFY row_number() OVER (PARTITION BY qid, round ORDER BY round(c * s, 9) DESC, c DESC, id) = 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, c DESC, id) AS rank FROM b)
        SELECT q.id AS qid, CASE WHEN rank <= 50 THEN rank ELSE -1 END AS rank FROM q LEFT JOIN k ON k.qid = q.id AND k.round = q.round_key""",
    "hit_carriers": _BASE + """, best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid, round ORDER BY similarity DESC, kind DESC, id) = 1), top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, kind DESC, id) <= 10)
        SELECT count(*) FILTER (salience = 0) AS superseded, count(*) FILTER (salience > 0 AND salience < 1) AS downweighted, count(*) AS hits FROM top""",
    "similarity_topk": _BASE + " SELECT qid, rank, id, round(similarity, 4) AS similarity, round(similarity, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, kind DESC, id) AS rank FROM pairs) WHERE rank <= 10",
    "round_topk": _BASE + """, best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid, round ORDER BY similarity DESC, kind DESC, id) = 1)
        SELECT qid, rank, id, round(similarity, 4) AS similarity, round(similarity, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, kind DESC, id) AS rank FROM best) WHERE rank <= 10""",
    "recall_score": _BASE + _TOP + " SELECT qid, rank, id, round(similarity, 4) AS similarity, round(score, 4) AS score FROM top",
    "recall_updates": _BASE + _TOP + " SELECT id, max(now) AS last_accessed FROM top WHERE similarity >= 0.5 GROUP BY id",
    "rerank_overlap": _BASE + _TOP + f""", pool AS (SELECT qid, user_id, round, id AS own, rank AS seed FROM ranked WHERE rank <= 50),
        qw AS (SELECT id AS qid, list_distinct(list_filter(string_split({words_sql('content')}, ' '), lambda w: length(w) > 2)) AS q FROM r WHERE id % 20 = 0),
        pw AS (SELECT user_id, id, kind, salience, coalesce(round_key, 'id:' || id) AS round, string_split({words_sql("coalesce(fact, CASE WHEN len(turns) > 0 THEN " + _TURNS + " END, content)")}, ' ') AS p FROM r),
        s AS (SELECT pool.qid, pool.round, seed, max(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, p)) / len(q) END) AS pair_score FROM pool JOIN qw USING (qid) JOIN pw ON pw.user_id = pool.user_id AND pw.round = pool.round AND (pw.id = own OR (pw.kind = 'fact' AND pw.salience > 0)) GROUP BY ALL)
        SELECT qid, rank, round, round(pair_score, 6) AS pair_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, seed) AS rank FROM s) WHERE rank <= 10""",
    "budget_prefix": _BASE + _TOP + ", b AS (SELECT qid, rank, id, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS spent FROM top) SELECT * FROM b WHERE spent <= 300 OR rank = 1",
    "context_text": _BASE + _TOP + f""", o AS (SELECT qid, created_at, id, {_TURNS} AS body, row_number() OVER (PARTITION BY qid ORDER BY coalesce(created_at, ''), id) AS n FROM top),
        h AS (SELECT *, nullif(created_at, '') AS ts, last_value(nullif(created_at, '') IGNORE NULLS) OVER (PARTITION BY qid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
        c AS (SELECT qid, string_agg(CASE WHEN ts IS NOT NULL AND ts IS DISTINCT FROM before THEN '[Session date: ' || ts || ']' || chr(10) || body ELSE body END, chr(10) ORDER BY n) AS context FROM h GROUP BY qid)
        SELECT qid, md5(context) AS context_md5, CAST(length(context) AS INTEGER) AS chars FROM c""",
    "context_with_facts": _BASE + _TOP + f""", f AS (SELECT user_id, round_key, string_agg('- ' || coalesce(fact, '') || CASE WHEN coalesce(valid_time, '') = '' THEN '' ELSE ' (' || valid_time || ')' END, chr(10) ORDER BY id) AS facts FROM r WHERE kind = 'fact' GROUP BY user_id, round_key),
        o AS (SELECT qid, created_at, id, CASE WHEN facts IS NULL THEN '' ELSE 'facts:' || chr(10) || facts || chr(10) END || {_TURNS} AS body, row_number() OVER (PARTITION BY qid ORDER BY coalesce(created_at, ''), id) AS n FROM top LEFT JOIN f ON f.user_id = top.user_id AND f.round_key = top.round_key),
        h AS (SELECT *, nullif(created_at, '') AS ts, last_value(nullif(created_at, '') IGNORE NULLS) OVER (PARTITION BY qid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
        c AS (SELECT qid, string_agg(CASE WHEN ts IS NOT NULL AND ts IS DISTINCT FROM before THEN '[Session date: ' || ts || ']' || chr(10) || body ELSE body END, chr(10) ORDER BY n) AS context FROM h GROUP BY qid)
        SELECT qid, md5(context) AS context_md5, CAST(length(context) AS INTEGER) AS chars FROM c""",
    "session_texts": ROUNDS_SQL + ", t AS (SELECT session_id, any_value(ts) AS ts, string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10) ORDER BY i) AS body FROM said GROUP BY session_id) SELECT session_id, CASE WHEN ts = '' THEN body ELSE '[Session date: ' || ts || ']' || chr(10) || body END AS context FROM t",
    "export_text": f"""WITH r AS {_R}, rounds AS (SELECT user_id, coalesce(created_at, '') AS ts, id AS round_id, round_key, CASE WHEN coalesce(created_at, '') = '' THEN {_TURNS} ELSE '[Session date: ' || created_at || ']' || chr(10) || {_TURNS} END AS line FROM r WHERE kind = 'round'),
        home AS (SELECT user_id, round_key, min(struct_pack(ts := ts, id := round_id)) AS h FROM rounds WHERE round_key IS NOT NULL GROUP BY user_id, round_key)
        SELECT user_id, ts, round_id, CAST(0 AS BIGINT) AS fact_id, line FROM rounds UNION ALL
        SELECT f.user_id, coalesce(h.ts, f.created_at, '') AS ts, coalesce(h.id, -1) AS round_id, f.id AS fact_id, {_FACT} AS line FROM r f LEFT JOIN home ON home.user_id = f.user_id AND home.round_key = f.round_key WHERE kind = 'fact'""",
    "export_markdown": f"""WITH r AS {_R}, w AS (SELECT supersedes AS id, max(id) AS winner FROM r WHERE kind = 'fact' AND supersedes IS NOT NULL GROUP BY supersedes),
        t AS (SELECT r.*, winner, CASE WHEN coalesce(valid_time, '') = '' THEN coalesce(fact, content) ELSE coalesce(fact, content) || ' (**' || valid_time || '**)' END AS said FROM r LEFT JOIN w USING (id) WHERE kind = 'fact')
        SELECT id, CASE WHEN salience = 0 THEN '- ~~' || said || '~~ (superseded' || coalesce(' by #' || winner, '') || ')' ELSE '- ' || said || coalesce(' → supersedes #' || supersedes, '') END AS bullet FROM t""",
    "judge_prompts": f"WITH p AS (SELECT DISTINCT run_id, question_id, category, is_abstention, question, answer, predicted FROM predictions WHERE category IS NOT NULL) SELECT run_id, question_id, md5({_prompt_sql()}) AS prompt_md5, CAST(length({_prompt_sql()}) AS INTEGER) AS chars FROM p",
    "trimmed_contexts": "SELECT doc_id, md5(k) AS kept_md5, CAST(greatest(0, length(t) - 400) // 4 AS BIGINT) AS tokens_dropped, CAST(ceil(length(k) / 4.0) AS BIGINT) AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN length(coalesce(text, '')) <= 400 THEN coalesce(text, '') ELSE substr(text, length(text) - 399) END AS k FROM documents)",
}
ORACLES["json_contexts"] = ROUNDS_SQL + """SELECT session_id, '[{"session_date":' || CASE WHEN any_value(ts) = '' THEN 'null' ELSE to_json(any_value(ts)) END || ',"turns":[' || string_agg('{"role":' || to_json(coalesce(role, '')) || ',"content":' || to_json(coalesce(content, '')) || '}', ',' ORDER BY i) || ']}]' AS context FROM said GROUP BY session_id"""
_PROMPT = "run_id || chr(10) || chr(10) || 'I will give you several history chats between you and a user. Please answer the question based on the relevant chat history. Answer the question step by step: first extract all the relevant information, and then reason over the information to get the answer. If the chat history does not contain enough information to answer the question, say that you do not know rather than guessing.' || chr(10) || chr(10) || chr(10) || 'History Chats:' || chr(10) || chr(10) || coalesce(answer, '') || chr(10) || chr(10) || 'Current Date: ' || question_id || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer (step by step):'"
ORACLES["reader_prompts"] = f"SELECT run_id, question_id, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS chars FROM (SELECT run_id, question_id, {_PROMPT} AS p FROM (SELECT run_id, question_id, any_value(question) AS question, any_value(answer) AS answer FROM predictions GROUP BY run_id, question_id))"
