"""Queries over guards, caches, inserts and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import evaluation as ev
from palimpsest.operators.ingest import sessions_once
from palimpsest.plans.evaluation_queries import ORACLES as EVALUATION
from palimpsest.plans.ingest_queries import ONE_MEMORY
from palimpsest.session import once, read_table, scratch_path
from palimpsest.sources import artifacts, store


def _predictions(spark, sf_dir):
    p = read_table(spark, sf_dir, "predictions")
    return once(p, "run_id", "question_id")


def meta_guard(spark, sf_dir):
    """Guard rows that differ between two runs: what each was opened with, by source."""
    t = read_table(spark, sf_dir, "mix_targets")
    expected = t.select(F.col("source").alias("key"), F.col("max_repeats").cast("string").alias("value"))
    stored = t.where("weight > 2.5").select(F.col("source").alias("key"), F.when(F.col("weight") > 11, F.lit("1")).otherwise(F.col("max_repeats").cast("string")).alias("value"))
    d = store.guard_differences(expected, stored)
    return d.select("key", F.coalesce("expected", F.lit("-")).alias("expected"), F.coalesce("stored", F.lit("-")).alias("stored"))


def inserted_records(spark, sf_dir):
    m = once(read_table(spark, sf_dir, "memories").drop("embedding", "turns"), "id")
    v = store.validated(m.where("created_at IS NOT NULL").withColumns({"initial_salience": F.when(F.col("id") % 3 != 0, F.col("initial_salience")), "last_accessed": F.when(F.col("id") % 5 != 0, F.col("last_accessed"))}))
    return v.select("id", "kind", "created_at", F.round("salience", 6).alias("salience"), F.round("initial_salience", 6).alias("initial_salience"), "last_accessed")


def verdict_cache_misses(spark, sf_dir):
    p = _predictions(spark, sf_dir).select("run_id", "question_id", F.sha2(F.coalesce("predicted", F.lit("")), 256).alias("digest"), "verdicts")
    cache = p.where("size(verdicts) > 0").select("question_id", "digest").distinct()
    return store.cache_misses(p, cache, ["question_id", "digest"]).select("run_id", "question_id", "digest")


def annotated_verdicts(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    new = p.where("NOT coalesce(truncated, false)").select("run_id", "question_id", F.coalesce(F.col("predicted") == F.col("answer"), F.lit(False)).alias("correct"), F.lit("exact").alias("judge_hash"), F.lit("2026-01-01T00:00:00Z").alias("graded_utc"))
    a = store.annotated(p, new)
    last = F.try_element_at("verdicts", F.lit(-1))
    return a.select("run_id", "question_id", F.coalesce(F.size("verdicts"), F.lit(0)).alias("n"), F.coalesce(last["judge_hash"], F.lit("-")).alias("last_judge"), F.coalesce(F.col("verdicts")[0]["judge_hash"], F.lit("-")).alias("first_judge"))


def predictions_roundtrip(spark, sf_dir):
    """Prediction lines written as JSON and read back."""
    p = _predictions(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    artifacts.write_predictions(p, path)
    return artifacts.read_predictions(spark, path).select("run_id", "question_id", F.coalesce("category", F.lit("-")).alias("category"), F.md5(F.coalesce("predicted", F.lit("-"))).alias("predicted_md5"), F.coalesce(F.size("verdicts"), F.lit(-1)).alias("n_verdicts"), F.coalesce(F.size("retrieved_ids"), F.lit(-1)).alias("n_retrieved"))


def run_summaries(spark, sf_dir):
    return artifacts.summary_json(ev.accuracy(ev.graded(read_table(spark, sf_dir, "predictions"))))


def benchmark_sessions(spark, sf_dir):
    """Sessions of each question, parsed from the nested form of a benchmark file."""
    s = sessions_once(read_table(spark, sf_dir, "sessions")).select("session_id", "session_date", "turns")
    q = read_table(spark, sf_dir, "predictions").select("question_id", F.explode("retrieved_ids").alias("session_id")).distinct().join(s, "session_id")
    each = F.array_sort(F.collect_list(F.struct("session_id", "session_date", "turns")))
    nested = q.groupBy("question_id").agg(each.alias("x")).select(
        "question_id", F.lit("-").alias("question_type"), F.lit("-").alias("question"), F.lit("-").alias("answer"), F.lit("-").alias("question_date"),
        F.transform("x", lambda e: e.session_id).alias("haystack_session_ids"), F.transform("x", lambda e: e.session_date).alias("haystack_dates"), F.transform("x", lambda e: e.turns).alias("haystack_sessions"),
        F.slice(F.transform("x", lambda e: e.session_id), 1, 1).alias("answer_session_ids"),
    )
    return artifacts.parse_benchmark(nested).select("question_id", "session_no", "session_id", "session_date", F.size("turns").alias("turns"), "is_evidence")


def superseded_update(spark, sf_dir):
    """Records after the losers that winners name got salience 0."""
    from palimpsest.operators import conflict

    m = once(read_table(spark, sf_dir, "memories").select("id", "salience", "supersedes"), "id")
    losers = m.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("loser"), F.col("id").alias("winner"))
    out = conflict.apply_updates(m, conflict.supersede_updates(losers), ["salience", "supersedes"])
    return out.select("id", F.round("salience", 6).alias("salience"), F.coalesce("supersedes", F.lit(-1)).alias("supersedes"))


QUERIES = {f.__name__: f for f in (meta_guard, inserted_records, verdict_cache_misses, annotated_verdicts, predictions_roundtrip, run_summaries, benchmark_sessions, superseded_update)}

from palimpsest.plans.evaluation_queries import _P  # noqa: E402

ORACLES = {
    "meta_guard": """WITH e AS (SELECT source AS key, CAST(max_repeats AS VARCHAR) AS expected FROM mix_targets), s AS (SELECT source AS key, CASE WHEN weight > 11 THEN '1' ELSE CAST(max_repeats AS VARCHAR) END AS stored FROM mix_targets WHERE weight > 2.5)
        SELECT key, coalesce(expected, '-') AS expected, coalesce(stored, '-') AS stored FROM e FULL JOIN s USING (key) WHERE expected IS DISTINCT FROM stored""",
    "inserted_records": f"SELECT id, kind, created_at, round(salience, 6) AS salience, round(CASE WHEN id % 3 <> 0 THEN coalesce(initial_salience, salience) ELSE salience END, 6) AS initial_salience, CASE WHEN id % 5 <> 0 THEN coalesce(last_accessed, created_at) ELSE created_at END AS last_accessed FROM {ONE_MEMORY} WHERE created_at IS NOT NULL",
    "verdict_cache_misses": f"WITH p AS (SELECT run_id, question_id, sha256(coalesce(predicted, '')) AS digest, verdicts FROM {_P}) SELECT run_id, question_id, digest FROM p WHERE NOT EXISTS (SELECT 1 FROM p c WHERE len(c.verdicts) > 0 AND c.question_id = p.question_id AND c.digest = p.digest)",
    "annotated_verdicts": f"SELECT run_id, question_id, CAST(coalesce(len(verdicts), 0) + CASE WHEN coalesce(truncated, false) THEN 0 ELSE 1 END AS INTEGER) AS n, CASE WHEN coalesce(truncated, false) THEN coalesce(verdicts[-1].judge_hash, '-') ELSE 'exact' END AS last_judge, CASE WHEN len(verdicts) > 0 THEN verdicts[1].judge_hash WHEN coalesce(truncated, false) THEN '-' ELSE 'exact' END AS first_judge FROM {_P}",
    "predictions_roundtrip": f"SELECT run_id, question_id, coalesce(category, '-') AS category, md5(coalesce(predicted, '-')) AS predicted_md5, CAST(coalesce(len(verdicts), -1) AS INTEGER) AS n_verdicts, CAST(coalesce(len(retrieved_ids), -1) AS INTEGER) AS n_retrieved FROM {_P}",
    "benchmark_sessions": """WITH s AS (SELECT session_id, any_value(session_date) AS session_date, any_value(len(turns)) AS turns FROM sessions GROUP BY session_id), q AS (SELECT DISTINCT question_id, unnest(retrieved_ids) AS session_id FROM predictions),
        j AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY session_id) - 1 AS k FROM q JOIN s USING (session_id))
        SELECT question_id, CAST(k AS INTEGER) AS session_no, session_id, coalesce(session_date, '') AS session_date, CAST(turns AS INTEGER) AS turns, k = 0 AS is_evidence FROM j""",
    "superseded_update": f"WITH m AS {ONE_MEMORY}, w AS (SELECT id, max(supersedes) AS s FROM m WHERE supersedes IS NOT NULL GROUP BY id) SELECT m.id, round(CASE WHEN m.id IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL) THEN 0.0 ELSE salience END, 6) AS salience, coalesce(w.s, m.supersedes, -1) AS supersedes FROM m LEFT JOIN w USING (id)",
}
_J = """'{"group":' || to_json("group") || ',"correct":' || correct || ',"total":' || total || ',"accuracy":' || accuracy || ',"low":' || low || ',"high":' || high || '}'"""
ORACLES["run_summaries"] = f"SELECT run_id, '[' || string_agg({_J}, ',' ORDER BY \"group\", correct, total) || ']' AS summary FROM ({EVALUATION['accuracy_wilson']}) GROUP BY run_id"
