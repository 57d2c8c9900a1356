"""Queries over segmentation and the store's records."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import ingest
from palimpsest.session import once, read_table


def _rounds(spark, sf_dir):
    return ingest.rounds(ingest.sessions_once(read_table(spark, sf_dir, "sessions")))


def _memories(spark, sf_dir, *cols):
    return once(read_table(spark, sf_dir, "memories").select("id", *cols), "id")


def rounds(spark, sf_dir):
    r = _rounds(spark, sf_dir)
    return r.select("session_id", "round_no", F.size("turns").alias("n_turns"), "roles", "text", "has_evidence")


def embed_texts(spark, sf_dir):
    r = _rounds(spark, sf_dir)
    return r.select("session_id", "round_no", ingest.embed_text(F.col("ts"), F.col("text")).alias("embed_text"), ingest.round_key(F.col("ts"), F.col("text")).alias("round_key"))


def token_windows(spark, sf_dir):
    return ingest.window_pieces(_rounds(spark, sf_dir), 12, 4)


def session_messages(spark, sf_dir):
    m = ingest.messages(ingest.sessions_once(read_table(spark, sf_dir, "sessions")))
    return m.select("session_id", "turn", "role", "ts", F.length("content").alias("chars"))


def evidence_messages(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "predictions").select("question_id", F.explode("retrieved_ids").alias("session_id"))
    m = ingest.evidence_arm(ingest.sessions_once(read_table(spark, sf_dir, "sessions")), wanted)
    return m.groupBy("question_id").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("session_id").alias("sessions"))


def fact_embed_texts(spark, sf_dir):
    m = _memories(spark, sf_dir, "kind", "raw", "fact").where("kind = 'fact'")
    return m.select("id", ingest.fact_embed_text(F.col("raw"), F.col("fact")).alias("embed_text"))


def record_counts(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "kind", "salience", "created_at")
    return m.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("salience") > 0).alias("active"), F.countDistinct("created_at").alias("timestamps"))


def facts_of_rounds(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "kind", "salience", "round_key")
    r = m.where("kind = 'round' AND round_key IS NOT NULL").select(F.col("id").alias("round_id"), "user_id", "round_key")
    f = m.where("kind = 'fact'").groupBy("user_id", "round_key").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("salience") > 0).alias("active_facts"), F.min("id").alias("first_fact"))
    return r.join(f, ["user_id", "round_key"], "left").select("round_id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("active_facts", F.lit(0)).alias("active_facts"), F.coalesce("first_fact", F.lit(-1)).alias("first_fact"))


def pair_candidates(spark, sf_dir):
    """Active facts that meet under one pair key, counted without writing out the pairs."""
    m = _memories(spark, sf_dir, "user_id", "kind", "salience", "pair_key").where("kind = 'fact' AND salience > 0 AND pair_key IS NOT NULL")
    g = m.groupBy("user_id", "pair_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return g.where("n > 1").select("user_id", "pair_key", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), "first_id", "last_id")


def store_scan(spark, sf_dir):
    """The active contents of one user in order, as a reader of the store sees them."""
    m = _memories(spark, sf_dir, "user_id", "kind", "content", "created_at", "salience").where("salience > 0 AND kind = 'round'")
    return m.select("user_id", "id", "created_at", F.sha2("content", 256).alias("content_sha"))


def prefilter_rates(spark, sf_dir):
    return ingest.drop_rates(_rounds(spark, sf_dir))


def rule_facts(spark, sf_dir):
    return ingest.fact_pieces(_rounds(spark, sf_dir))


def stored_pieces(spark, sf_dir):
    return ingest.pieces(_rounds(spark, sf_dir))


def exact_keys(spark, sf_dir):
    d = read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "question").distinct()
    return d.select("run_id", "question_id", F.md5(text.exact_key(F.col("question"))).alias("key"))


def token_entropy(spark, sf_dir):
    m = _memories(spark, sf_dir, "fact").where("fact IS NOT NULL")
    return m.select("id", F.round(text.token_entropy(F.col("fact")), 6).alias("bits"))


def number_values(spark, sf_dir):
    m = _memories(spark, sf_dir, "object").where("object IS NOT NULL")
    key = text.exact_key(F.col("object"))
    return m.select("id", F.array_join(text.numbers_of(key), ",").alias("numbers"), text.number_residue(key).alias("residue"))


QUERIES = {f.__name__: f for f in (rounds, embed_texts, token_windows, session_messages, evidence_messages, fact_embed_texts, record_counts, facts_of_rounds, pair_candidates, store_scan, prefilter_rates, rule_facts, stored_pieces, exact_keys, token_entropy, number_values)}

_S = r"\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def key_sql(expr: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({expr}), '[^\pL\pN_{_S}]', '', 'g'), '[{_S}]+', ' ', 'g'))"


def words_sql(expr: str) -> str:
    return rf"trim(regexp_replace(lower({expr}), '[{_S}]+', ' ', 'g'))"


_ROUNDS = rf"""
    WITH once AS (SELECT session_id, arg_min(user_id, arrived_at) AS user_id, arg_min(coalesce(session_date, ''), arrived_at) AS ts, arg_min(turns, arrived_at) AS turns FROM sessions GROUP BY session_id),
    said AS (SELECT session_id, user_id, ts, t.role AS role, t.content AS content, coalesce(t.has_answer, false) AS has_answer, i
             FROM (SELECT session_id, user_id, ts, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM once)),
    kept AS (SELECT * FROM said WHERE regexp_replace(coalesce(content, ''), '[{_S}]', '', 'g') <> ''),
    marked AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY session_id ORDER BY i) = 'user' THEN 0 ELSE 1 END AS opens FROM kept),
    numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY i) - 1 AS INTEGER) AS round_no FROM marked),
    rnd AS (SELECT session_id, round_no, any_value(user_id) AS user_id, any_value(ts) AS ts, CAST(count(*) AS INTEGER) AS n_turns, string_agg(role, '+' ORDER BY i) AS roles,
                   string_agg(regexp_replace(content, '^[{_S}]+|[{_S}]+$', '', 'g'), chr(10) ORDER BY i) AS text, bool_or(has_answer) AS has_evidence
            FROM numbered GROUP BY session_id, round_no)
"""
_M = "(SELECT id, any_value(user_id) AS user_id, any_value(kind) AS kind, any_value(salience) AS salience, any_value(round_key) AS round_key, any_value(pair_key) AS pair_key, any_value(created_at) AS created_at, any_value(content) AS content, any_value(raw) AS raw, any_value(fact) AS fact, any_value(object) AS object, any_value(valid_time) AS valid_time, any_value(last_accessed) AS last_accessed, any_value(initial_salience) AS initial_salience, any_value(supersedes) AS supersedes FROM memories GROUP BY id)"
ONE_MEMORY = _M
ROUNDS_SQL = _ROUNDS

ORACLES = {
    "rounds": _ROUNDS + "SELECT session_id, round_no, n_turns, roles, text, has_evidence FROM rnd",
    "embed_texts": _ROUNDS + "SELECT session_id, round_no, CASE WHEN ts = '' THEN text ELSE '[Session date: ' || regexp_extract(ts, '^[^T ]*') || '] ' || text END AS embed_text, ts || '|' || substr(sha256(text), 1, 16) AS round_key FROM rnd",
    "token_windows": _ROUNDS + rf""", w AS (SELECT session_id, round_no, list_filter(string_split(trim(regexp_replace(text, '[{_S}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM rnd),
        p AS (SELECT session_id, round_no, ws, unnest(range(0, CAST(CASE WHEN len(ws) <= 12 THEN 0 ELSE ceil((len(ws) - 12) / 8.0) END AS BIGINT) + 1)) AS k FROM w)
        SELECT session_id, round_no, CAST(k AS INTEGER) AS piece, array_to_string(list_slice(ws, k * 8 + 1, k * 8 + 12), ' ') AS text FROM p""",
    "session_messages": _ROUNDS + "SELECT session_id, CAST(i - 1 AS INTEGER) AS turn, role, ts, CAST(length(coalesce(content, '')) AS INTEGER) AS chars FROM said",
    "evidence_messages": _ROUNDS + ", want AS (SELECT DISTINCT question_id, unnest(retrieved_ids) AS session_id FROM predictions) SELECT question_id, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM said JOIN want USING (session_id) GROUP BY question_id",
    "fact_embed_texts": f"SELECT id, coalesce(raw, '') || chr(10) || coalesce(fact, '') AS embed_text FROM {_M} WHERE kind = 'fact'",
    "record_counts": f"SELECT user_id, kind, count(*) AS records, count(*) FILTER (salience > 0) AS active, count(DISTINCT created_at) AS timestamps FROM {_M} GROUP BY user_id, kind",
    "facts_of_rounds": f"""WITH m AS {_M}, f AS (SELECT user_id, round_key, count(*) AS facts, count(*) FILTER (salience > 0) AS active_facts, min(id) AS first_fact FROM m WHERE kind = 'fact' GROUP BY ALL)
        SELECT r.id AS round_id, coalesce(facts, 0) AS facts, coalesce(active_facts, 0) AS active_facts, coalesce(first_fact, -1) AS first_fact FROM m r LEFT JOIN f ON r.user_id = f.user_id AND r.round_key = f.round_key WHERE r.kind = 'round' AND r.round_key IS NOT NULL""",
    "pair_candidates": f"SELECT user_id, pair_key, count(*) * (count(*) - 1) // 2 AS pairs, min(id) AS first_id, max(id) AS last_id FROM {_M} WHERE kind = 'fact' AND salience > 0 AND pair_key IS NOT NULL GROUP BY user_id, pair_key HAVING count(*) > 1",
    "store_scan": f"SELECT user_id, id, created_at, sha256(content) AS content_sha FROM {_M} WHERE salience > 0 AND kind = 'round'",
    "exact_keys": f"SELECT DISTINCT run_id, question_id, md5({key_sql('question')}) AS key FROM predictions",
    "token_entropy": rf"""WITH w AS (SELECT id, list_filter(string_split({key_sql("regexp_replace(fact, '[''’]', '', 'g')")}, ' '), lambda x: x <> '') AS ws0 FROM {_M} WHERE fact IS NOT NULL),
        c AS (SELECT * FROM (VALUES ('isnt','is not'),('arent','are not'),('wasnt','was not'),('werent','were not'),('doesnt','does not'),('dont','do not'),('didnt','did not'),('cant','can not'),('cannot','can not'),('couldnt','could not'),('wont','will not'),('wouldnt','would not'),('hasnt','has not'),('havent','have not'),('hadnt','had not'),('shouldnt','should not'),('mustnt','must not'),('aint','is not'),('neednt','need not')) v(a, b)),
        t AS (SELECT id, unnest(string_split(coalesce(b, x), ' ')) AS word FROM (SELECT id, unnest(ws0) AS x FROM w) LEFT JOIN c ON a = x),
        n AS (SELECT id, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS total FROM t GROUP BY id, word)
        SELECT w.id, round(coalesce(e, 0.0), 6) AS bits FROM w LEFT JOIN (SELECT id, CAST(-sum(n / total * log2(n / total)) AS DOUBLE) AS e FROM n GROUP BY id) USING (id)""",
    "number_values": rf"""WITH v AS (SELECT id, list_filter(string_split({key_sql('object')}, ' '), lambda x: x <> '' AND NOT list_contains(['about','around','roughly','approximately','nearly','almost','over','under','close','to','at','least','most','up','more','than','less','only','exactly','just','some','currently','now'], x)) AS ws FROM {_M} WHERE object IS NOT NULL)
        SELECT id, array_to_string(list_filter(ws, lambda x: regexp_full_match(x, '\d+(\.\d+)?')), ',') AS numbers, array_to_string(list_filter(ws, lambda x: NOT regexp_full_match(x, '\d+(\.\d+)?')), ' ') AS residue FROM v""",
}
