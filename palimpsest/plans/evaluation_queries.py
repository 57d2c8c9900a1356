"""Queries over runs, verdicts, samples and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import stats, text
from palimpsest.operators import evaluation as ev
from palimpsest.operators import ingest
from palimpsest.session import once, read_table

SYSTEM, ORACLE = "store_p3_b", "oracle_a"


def _grades(spark, sf_dir):
    return ev.graded(read_table(spark, sf_dir, "predictions"))


def _ranks(spark, sf_dir):
    s = ingest.sessions_once(read_table(spark, sf_dir, "sessions"))
    return ev.evidence_ranks(read_table(spark, sf_dir, "predictions"), s.where(F.exists("turns", lambda t: t.has_answer)))


def accuracy_wilson(spark, sf_dir):
    return ev.accuracy(_grades(spark, sf_dir))


def mcnemar_holm(spark, sf_dir):
    p = ev.paired(_grades(spark, sf_dir))
    return p.select("first", "second", "b", "c", "pairs", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


def judge_agreement(spark, sf_dir):
    return ev.agreement(_grades(spark, sf_dir))


def retest_unstable(spark, sf_dir):
    return ev.retest(_grades(spark, sf_dir))


def outcome_buckets(spark, sf_dir):
    return ev.buckets(_grades(spark, sf_dir), SYSTEM, ORACLE)


def recall_at_k(spark, sf_dir):
    return ev.recall_at(_ranks(spark, sf_dir))


def miss_kinds(spark, sf_dir):
    return ev.misses(_grades(spark, sf_dir), _ranks(spark, sf_dir))


def drop_summary(spark, sf_dir):
    return ev.drops(read_table(spark, sf_dir, "drop_events"))


def drift_diff(spark, sf_dir):
    return ev.drift(read_table(spark, sf_dir, "predictions"), "store_p3_b", "store_p4_c")


def audit_flips(spark, sf_dir):
    return ev.flips(_grades(spark, sf_dir))


def truncation_caveat(spark, sf_dir):
    return ev.truncation(read_table(spark, sf_dir, "predictions"))


def token_percentiles(spark, sf_dir):
    return ev.token_percentiles(read_table(spark, sf_dir, "predictions"))


def _ledger(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ts"), F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("projected_usd"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") * 0.5).alias("actual_usd"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1).alias("supersedes_ts"))


def ledger_spend(spark, sf_dir):
    return ev.spent(_ledger(spark, sf_dir))


def cost_projection(spark, sf_dir):
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "question", "reader_prompt_tokens"), "run_id", "question_id")
    prices = p.select("run_id").distinct().select(F.col("run_id").alias("model"), F.length("run_id").cast("double").alias("input_usd"), (F.length("run_id") * 4).cast("double").alias("output_usd"))
    return ev.projected_costs(p.select(F.col("run_id").alias("model"), F.col("question").alias("prompt"), F.lit(64).alias("max_tokens")), prices, batch=True)


def parity_check(spark, sf_dir):
    p = read_table(spark, sf_dir, "predictions").groupBy("run_id").agg(F.countDistinct("category").alias("categories"), F.max("truncated").alias("truncates"), F.min(F.lit("v1")).alias("version"), F.max("reader_prompt_tokens").alias("longest_prompt"))
    return ev.parity(p, ["categories", "truncates", "version", "longest_prompt"])


def accuracy_pivot(spark, sf_dir):
    return ev.accuracy_table(_grades(spark, sf_dir), ["fullctx_a", "naive_rag_a", "oracle_a", "store_p2_b", "store_p3_b", "store_p4_c"])


def distinct_answers(spark, sf_dir):
    return ev.distinct_answers(read_table(spark, sf_dir, "predictions"))


def question_digests(spark, sf_dir):
    return ev.id_digest(read_table(spark, sf_dir, "predictions"), "run_id", "question_id")


def answer_overlap(spark, sf_dir):
    """Jaccard of the words of given and expected answer."""
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "answer", "predicted"), "run_id", "question_id").where("answer IS NOT NULL AND predicted IS NOT NULL")
    words = lambda c: F.array_distinct(text.tokens(text.exact_key(F.col(c))))
    return p.select("run_id", "question_id", F.round(text.jaccard(words("answer"), words("predicted")), 6).alias("jaccard"))


def sample_stratified(spark, sf_dir):
    d = read_table(spark, sf_dir, "heldout_items").select("question_id", "question_type")
    return ev.sample_stratified(d, "question_type", "question_id", 50, 7).select("question_id", "question_type", F.col("round").cast("bigint").alias("round"))


def sample_deciles(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")).where("chars IS NOT NULL")
    return ev.sample_deciles(d, "chars", "doc_id", 200, 7).select("doc_id", "chars", F.col("decile").cast("bigint").alias("decile"))


def label_sheet(spark, sf_dir):
    g = _grades(spark, sf_dir).where("size(verdicts) > 1").select("run_id", "question_id", F.when(F.col("correct") == F.col("verdicts")[1]["correct"], "agree").otherwise("disagree").alias("kind"))
    return ev.draw_sheet(g, "kind", ["run_id", "question_id"], 40, 11).select("run_id", "question_id", "kind", F.col("place").cast("bigint").alias("place"))


def plan_chunks(spark, sf_dir):
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "reader_prompt_tokens"), "run_id", "question_id").select("run_id", "question_id", F.coalesce("reader_prompt_tokens", F.lit(0)).alias("cost"))
    return ev.plan_chunks(p, "run_id", "question_id", "cost", 90000).select("run_id", "question_id", F.col("chunk").cast("bigint").alias("chunk"))


def power_table(spark, sf_dir):
    grid = spark.createDataFrame([(n, d / 100, g / 100) for n in (100, 200, 500) for d in (10, 20) for g in (2, 5, 10)], "n int, discordance double, gap double")
    return stats.power_grid(grid).withColumn("power", F.round("power", 6))


def pair_wins(spark, sf_dir):
    return ev.win_lists(_grades(spark, sf_dir))


def unpaired_questions(spark, sf_dir):
    return ev.same_questions(_grades(spark, sf_dir), SYSTEM, ORACLE)


def pin_differences(spark, sf_dir):
    """What two runs were fed: questions by category, as pins."""
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "category"), "run_id", "question_id").groupBy("run_id", F.coalesce("category", F.lit("none")).alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    side = lambda r: p.where(F.col("run_id") == r).select("key", "value")
    return ev.pin_differences(side(SYSTEM), side(ORACLE), ("none",))


def missing_paths(spark, sf_dir):
    p = read_table(spark, sf_dir, "predictions")
    required = p.select("run_id").distinct().select(F.explode(F.array(F.concat("run_id", F.lit("/predictions")), F.concat("run_id", F.lit("/summary")))).alias("path"))
    present = p.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(F.concat("run_id", F.lit("/predictions")).alias("path"), F.when(F.col("n") > 100, F.col("n").cast("string")).otherwise("UNKNOWN").alias("value"))
    return ev.missing_paths(required, present)


def round_slices(spark, sf_dir):
    r = ingest.rounds(ingest.sessions_once(read_table(spark, sf_dir, "sessions")))
    return ev.slices(r, read_table(spark, sf_dir, "predictions").select(F.explode("retrieved_ids").alias("session_id")))


def emitted_differences(spark, sf_dir):
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "predicted"), "run_id", "question_id")
    side = lambda r: p.where(F.col("run_id") == r)
    return ev.emitted_differences(side("store_p3_b"), side("store_p4_c"), "question_id", "predicted")


def filled_outputs(spark, sf_dir):
    p = once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "reader_prompt_tokens"), "run_id", "question_id")
    wanted = p.select("question_id").distinct().withColumn("run_id", F.explode(F.array(F.lit(SYSTEM), F.lit(ORACLE))))
    return ev.filled(wanted, p, ["run_id", "question_id"], "reader_prompt_tokens", F.lit(0).cast("bigint"))


def label_scores(spark, sf_dir):
    g = _grades(spark, sf_dir).where("size(verdicts) > 1").select(F.col("group").alias("kind"), F.col("correct").alias("first"), F.col("verdicts")[1]["correct"].alias("second"), (F.length("question_id") % 2 == 0).alias("human"))
    return ev.score_labels(g)


def sign_agreement(spark, sf_dir):
    return ev.sign_agreement(_grades(spark, sf_dir))


def evidence_moves(spark, sf_dir):
    return ev.evidence_moves(_ranks(spark, sf_dir), "store_p3_b", "store_p4_c")


def token_histogram(spark, sf_dir):
    return ev.histogram(once(read_table(spark, sf_dir, "predictions").select("run_id", "question_id", "reader_prompt_tokens"), "run_id", "question_id"), "reader_prompt_tokens", 5000)


QUERIES = {f.__name__: f for f in (evidence_moves, token_histogram, pair_wins, unpaired_questions, pin_differences, missing_paths, round_slices, emitted_differences, filled_outputs, label_scores, sign_agreement, accuracy_wilson, mcnemar_holm, judge_agreement, retest_unstable, outcome_buckets, recall_at_k, miss_kinds, drop_summary, drift_diff, audit_flips, truncation_caveat, token_percentiles, ledger_spend, cost_projection, parity_check, accuracy_pivot, distinct_answers, question_digests, answer_overlap, sample_stratified, sample_deciles, label_sheet, plan_chunks, power_table)}

from palimpsest.plans.ingest_queries import ROUNDS_SQL, key_sql  # noqa: E402

_P = "(SELECT run_id, question_id, any_value(category) AS category, any_value(is_abstention) AS is_abstention, any_value(question) AS question, any_value(answer) AS answer, any_value(predicted) AS predicted, any_value(reader_prompt_tokens) AS reader_prompt_tokens, any_value(truncated) AS truncated, any_value(tokens_dropped) AS tokens_dropped, any_value(retrieved_ids) AS retrieved_ids, any_value(verdicts) AS verdicts FROM predictions GROUP BY run_id, question_id)"
_G = f"WITH p AS {_P}, g AS (SELECT run_id, question_id, CASE WHEN coalesce(is_abstention, false) THEN 'abstention' ELSE coalesce(category, 'unknown') END AS grp, verdicts[1].correct AS correct, verdicts, list_transform(verdicts, lambda v: v.correct) AS vs FROM p WHERE len(verdicts) > 0)"
_Z = 1.959963984540054
_RANKS = ", ev AS (SELECT DISTINCT session_id FROM (SELECT session_id, arg_min(turns, arrived_at) AS turns FROM sessions GROUP BY session_id) WHERE len(list_filter(turns, lambda t: coalesce(t.has_answer, false))) > 0), evl AS (SELECT list(session_id) AS es FROM ev), rk AS (SELECT p.*, list_filter(list_transform(retrieved_ids, lambda s, i: CASE WHEN list_contains(es, s) THEN i ELSE 0 END), lambda x: x > 0) AS ranks FROM p, evl)"
_KS = (1, 2, 3, 5, 10)
ORACLES = {
    "evidence_moves": _G + _RANKS + """ SELECT a.question_id, a.ranks = b.ranks AS same, len(list_filter(b.ranks, lambda r: r <= 2)) > 0 AND len(list_filter(a.ranks, lambda r: r <= 2)) = 0 AS entered, len(list_filter(a.ranks, lambda r: r <= 2)) > 0 AND len(list_filter(b.ranks, lambda r: r <= 2)) = 0 AS "left"
        FROM rk a JOIN rk b USING (question_id) WHERE a.run_id = 'store_p3_b' AND b.run_id = 'store_p4_c'""",
    "token_histogram": f"SELECT CAST(reader_prompt_tokens // 5000 * 5000 AS BIGINT) AS low, count(*) AS rows, CAST(sum(reader_prompt_tokens) AS BIGINT) AS total FROM {_P} WHERE reader_prompt_tokens IS NOT NULL GROUP BY low",
    "pair_wins": _G + """ SELECT a.run_id AS first, b.run_id AS second, coalesce(string_agg(question_id, ',' ORDER BY question_id) FILTER (a.correct), '') AS first_wins, coalesce(string_agg(question_id, ',' ORDER BY question_id) FILTER (b.correct), '') AS second_wins
        FROM g a JOIN g b USING (question_id) WHERE a.run_id < b.run_id AND a.correct <> b.correct GROUP BY ALL""",
    "unpaired_questions": _G + f" SELECT coalesce(a.question_id, b.question_id) AS question_id, CASE WHEN b.question_id IS NULL THEN '{SYSTEM}' ELSE '{ORACLE}' END AS only_in FROM (SELECT question_id FROM g WHERE run_id = '{SYSTEM}') a FULL JOIN (SELECT question_id FROM g WHERE run_id = '{ORACLE}') b ON a.question_id = b.question_id WHERE a.question_id IS NULL OR b.question_id IS NULL",
    "pin_differences": f"WITH p AS (SELECT run_id, coalesce(category, 'none') AS key, CAST(count(*) AS VARCHAR) AS value FROM {_P} GROUP BY ALL) SELECT key, a.value AS first, b.value AS second FROM p a JOIN p b USING (key) WHERE a.run_id = '{SYSTEM}' AND b.run_id = '{ORACLE}' AND a.value <> b.value AND key <> 'none'",
    "missing_paths": "WITH c AS (SELECT run_id, count(*) AS n FROM predictions GROUP BY run_id) SELECT run_id || '/summary' AS path, 'missing' AS state FROM c UNION ALL SELECT run_id || '/predictions', 'unknown' FROM c WHERE n <= 100",
    "round_slices": ROUNDS_SQL + ", q AS (SELECT DISTINCT unnest(retrieved_ids) AS session_id FROM predictions) SELECT CASE WHEN session_id IN (SELECT session_id FROM q) THEN 'inside' ELSE 'outside' END AS part, count(*) AS rounds, CAST(sum(length(text)) AS BIGINT) AS chars FROM rnd GROUP BY part",
    "emitted_differences": f"""WITH p AS {_P}, a AS (SELECT question_id, predicted, true AS h FROM p WHERE run_id = 'store_p3_b'), b AS (SELECT question_id, predicted, true AS h FROM p WHERE run_id = 'store_p4_c')
        SELECT CASE WHEN a.h IS NULL THEN 'only-second' WHEN b.h IS NULL THEN 'only-first' WHEN a.predicted IS NOT DISTINCT FROM b.predicted THEN 'same' ELSE 'different' END AS state, count(*) AS rows FROM a FULL JOIN b USING (question_id) GROUP BY state""",
    "filled_outputs": f"""WITH p AS {_P}, w AS (SELECT DISTINCT question_id, r.run_id FROM p, (VALUES ('{SYSTEM}'), ('{ORACLE}')) r(run_id))
        SELECT w.run_id, w.question_id, CASE WHEN p.run_id IS NULL THEN 0 ELSE reader_prompt_tokens END AS reader_prompt_tokens, p.run_id IS NOT NULL AS answered FROM w LEFT JOIN p ON p.run_id = w.run_id AND p.question_id = w.question_id""",
    "label_scores": _G + f""", l AS (SELECT grp AS kind, length(question_id) % 2 = 0 AS human, vs FROM g WHERE len(vs) > 1), v AS (SELECT kind, 'first' AS judge, vs[1] = human AS ok FROM l UNION ALL SELECT kind, 'second', vs[2] = human FROM l),
        s AS (SELECT kind, judge, count(*) AS n, count(*) FILTER (ok) AS agree, {_Z} AS z FROM v GROUP BY kind, judge), w AS (SELECT *, agree / n AS p FROM s)
        SELECT kind, judge, n, agree, round(p, 6) AS rate, round(CASE WHEN agree = 0 THEN 0.0 ELSE greatest(0.0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)) END, 6) AS low,
          round(CASE WHEN agree = n THEN 1.0 ELSE least(1.0, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)) END, 6) AS high FROM w""",
    "sign_agreement": _G + """, s AS (SELECT a.run_id AS first, b.run_id AS second, CAST(sign(sum(CAST(b.vs[1] AS INTEGER) - CAST(a.vs[1] AS INTEGER))) AS INTEGER) AS sign, CAST(sign(sum(CAST(b.vs[2] AS INTEGER) - CAST(a.vs[2] AS INTEGER))) AS INTEGER) AS second_sign
        FROM g a JOIN g b USING (question_id) WHERE a.run_id < b.run_id AND len(a.vs) > 1 AND len(b.vs) > 1 GROUP BY ALL) SELECT *, sign = second_sign AS agree FROM s""",
    "accuracy_wilson": _G + f""", s AS (SELECT run_id, CASE WHEN grouping(grp) = 1 THEN 'overall' ELSE grp END AS "group", count(*) FILTER (correct) AS correct, count(*) AS total FROM g GROUP BY GROUPING SETS ((run_id, grp), (run_id))),
        w AS (SELECT *, correct / total AS p, {_Z} AS z FROM s)
        SELECT run_id, "group", correct, total, round(p, 6) AS accuracy, round(CASE WHEN correct = 0 THEN 0.0 ELSE greatest(0.0, (p + z*z/(2*total) - z * sqrt(p*(1-p)/total + z*z/(4*total*total))) / (1 + z*z/total)) END, 6) AS low,
          round(CASE WHEN correct = total THEN 1.0 ELSE least(1.0, (p + z*z/(2*total) + z * sqrt(p*(1-p)/total + z*z/(4*total*total))) / (1 + z*z/total)) END, 6) AS high FROM w""",
    "mcnemar_holm": _G + """, j AS (SELECT a.run_id AS first, b.run_id AS second, count(*) FILTER (b.correct AND NOT a.correct) AS b, count(*) FILTER (a.correct AND NOT b.correct) AS c, count(*) AS pairs FROM g a JOIN g b USING (question_id) WHERE a.run_id < b.run_id GROUP BY ALL),
        t AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) END AS p FROM j),
        h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY first) - row_number() OVER (PARTITION BY first ORDER BY p, second) + 1) * p) AS q FROM t)
        SELECT first, second, b, c, pairs, round(p, 6) AS p, round(max(q) OVER (PARTITION BY first ORDER BY p, second ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""",
    "judge_agreement": _G + """, c AS (SELECT CASE WHEN grouping(run_id) = 1 THEN 'pooled' ELSE run_id END AS run_id, count(*) AS n, count(*) FILTER (vs[1] AND vs[2]) AS yy, count(*) FILTER (vs[1] AND NOT vs[2]) AS yn, count(*) FILTER (NOT vs[1] AND vs[2]) AS ny, count(*) FILTER (NOT vs[1] AND NOT vs[2]) AS nn FROM g WHERE len(vs) > 1 GROUP BY GROUPING SETS ((run_id), ())),
        e AS (SELECT *, (yy + yn) / n * ((yy + ny) / n) + (1 - (yy + yn) / n) * (1 - (yy + ny) / n) AS ch FROM c)
        SELECT run_id, n, yy, yn, ny, nn, round((yy + nn) / n, 6) AS rate, round(CASE WHEN ch = 1 THEN CASE WHEN yy + nn = n THEN 1.0 ELSE 0.0 END ELSE ((yy + nn) / n - ch) / (1 - ch) END, 6) AS kappa FROM e""",
    "retest_unstable": _G + " SELECT run_id, count(*) AS regraded, count(*) FILTER (len(list_distinct(vs)) > 1) AS unstable, CAST(sum(CASE WHEN correct THEN len(list_filter(vs[2:], lambda x: NOT x)) ELSE 0 END) AS BIGINT) AS to_wrong, CAST(sum(CASE WHEN NOT correct THEN len(list_filter(vs[2:], lambda x: x)) ELSE 0 END) AS BIGINT) AS to_right FROM g WHERE len(vs) > 1 GROUP BY run_id",
    "outcome_buckets": _G + f""", j AS (SELECT s.grp, s.correct AS s, o.correct AS o, len(list_distinct(s.vs)) = 1 AND len(list_distinct(o.vs)) = 1 AS ok FROM g s JOIN g o USING (question_id) WHERE s.run_id = '{SYSTEM}' AND o.run_id = '{ORACLE}')
        SELECT CASE WHEN grouping(grp) = 1 THEN 'overall' ELSE grp END AS "group", count(*) FILTER (ok AND s AND o) AS both_right, count(*) FILTER (ok AND NOT s AND o) AS oracle_only, count(*) FILTER (ok AND s AND NOT o) AS system_only, count(*) FILTER (ok AND NOT s AND NOT o) AS both_wrong, count(*) FILTER (NOT ok) AS unstable FROM j GROUP BY GROUPING SETS ((grp), ())""",
    "recall_at_k": _G + _RANKS + " SELECT CASE WHEN grouping(c) = 1 THEN 'overall' ELSE c END AS category, count(*) AS questions, " + ", ".join(f"count(*) FILTER (len(list_filter(ranks, lambda r: r <= {k})) > 0) AS any_at_{k}, count(*) FILTER (len(ranks) > 0 AND len(list_filter(ranks, lambda r: r <= {k})) = len(ranks)) AS all_at_{k}" for k in _KS) + " FROM (SELECT *, coalesce(category, 'unknown') AS c FROM rk WHERE NOT coalesce(is_abstention, false)) GROUP BY GROUPING SETS ((c), ())",
    "miss_kinds": _G + _RANKS + " SELECT g.run_id, CASE WHEN coalesce(is_abstention, false) OR len(list_filter(ranks, lambda r: r <= 10)) > 0 THEN 'reading-miss' ELSE 'retrieval-miss' END AS kind, count(*) AS answers FROM g JOIN rk USING (run_id, question_id) WHERE NOT correct GROUP BY ALL",
    "drop_summary": "SELECT kind, screen, count(*) AS drops, count(*) FILTER (is_evidence) AS evidence, count(*) FILTER (screen = 'cosine' AND neighbour_session_id <> session_id) AS cross_session, count(cosine) AS with_cosine FROM drop_events GROUP BY kind, screen",
    "drift_diff": f"""WITH p AS {_P}, j AS (SELECT a.question_id, coalesce(a.predicted, '') AS x, coalesce(b.predicted, '') AS y, a.reader_prompt_tokens IS DISTINCT FROM b.reader_prompt_tokens AS tokens_changed FROM p a JOIN p b USING (question_id) WHERE a.run_id = 'store_p3_b' AND b.run_id = 'store_p4_c'),
        h AS (SELECT *, hex(encode(x)) AS hx, hex(encode(y)) AS hy FROM j WHERE x <> y)
        SELECT question_id, CAST(coalesce(list_filter(range(0, least(length(hx), length(hy)) // 2), lambda i: substr(hx, CAST(i * 2 + 1 AS BIGINT), 2) <> substr(hy, CAST(i * 2 + 1 AS BIGINT), 2))[1], least(length(hx), length(hy)) // 2) AS INTEGER) AS first_divergence, tokens_changed FROM h""",
    "audit_flips": _G + """, f AS (SELECT run_id, count(*) AS compared, count(*) FILTER (vs[2] AND NOT vs[1]) AS to_correct, count(*) FILTER (vs[1] AND NOT vs[2]) AS to_wrong, count(*) FILTER (verdicts[1].judge_hash <> verdicts[2].judge_hash) AS fresh FROM g WHERE len(vs) > 1 GROUP BY run_id)
        SELECT run_id, compared, to_correct, to_wrong, CASE WHEN to_correct + to_wrong = 0 THEN 'MATCHES' WHEN fresh > 0 THEN 'WITHIN RE-GRADE' ELSE 'DIVERGES' END AS verdict FROM f""",
    "truncation_caveat": f"SELECT run_id, count(*) FILTER (truncated) AS truncated, count(*) AS total, round(avg(reader_prompt_tokens), 6) AS mean_fed, round(sum(tokens_dropped) / (sum(tokens_dropped) + sum(reader_prompt_tokens)), 6) AS dropped_share FROM {_P} GROUP BY run_id",
    "token_percentiles": f"SELECT run_id, count(*) AS n, round(median(reader_prompt_tokens), 6) AS p50, list(reader_prompt_tokens ORDER BY reader_prompt_tokens)[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p90, round(avg(reader_prompt_tokens), 6) AS mean FROM {_P} WHERE reader_prompt_tokens IS NOT NULL GROUP BY run_id",
    "ledger_spend": "WITH l AS (SELECT o_orderkey AS ts, o_orderpriority AS stage, o_totalprice AS projected, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice * 0.5 END AS actual, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS gone FROM orders) SELECT stage, count(*) AS lines, CAST(sum(CAST(coalesce(actual, projected, 0) AS DECIMAL(18,4))) AS DOUBLE) AS usd FROM l WHERE ts NOT IN (SELECT gone FROM l WHERE gone IS NOT NULL) GROUP BY stage",
    "cost_projection": f"SELECT run_id AS model, count(*) AS requests, CAST(sum(length(question) // 4) AS BIGINT) AS prompt_tokens, round((sum(length(question) // 4) * length(run_id) + count(*) * 64 * length(run_id) * 4) / 1e6 * 0.5, 6) AS usd FROM {_P} GROUP BY run_id",
    "parity_check": """WITH r AS (SELECT run_id, count(DISTINCT category) AS categories, max(truncated) AS truncates, 'v1' AS version, max(reader_prompt_tokens) AS longest_prompt FROM predictions GROUP BY run_id),
        u AS (SELECT 'categories' AS field, CAST(categories AS VARCHAR) AS v FROM r UNION ALL SELECT 'truncates', CAST(truncates AS VARCHAR) FROM r UNION ALL SELECT 'version', version FROM r UNION ALL SELECT 'longest_prompt', CAST(longest_prompt AS VARCHAR) FROM r)
        SELECT field, count(DISTINCT coalesce(v, chr(1))) AS values_seen FROM u GROUP BY field HAVING count(DISTINCT coalesce(v, chr(1))) > 1""",
    "accuracy_pivot": _G + ' SELECT grp AS "group", ' + ", ".join(f"count(*) FILTER (correct AND run_id = '{r}') AS {r}" for r in ("fullctx_a", "naive_rag_a", "oracle_a", "store_p2_b", "store_p3_b", "store_p4_c")) + " FROM g GROUP BY grp",
    "distinct_answers": f"SELECT question_id, sha256(coalesce(predicted, '')) AS digest, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS run_ids FROM {_P} GROUP BY question_id, digest",
    "question_digests": "SELECT run_id, sha256(string_agg(DISTINCT question_id, chr(10) ORDER BY question_id)) AS digest FROM predictions GROUP BY run_id",
    "answer_overlap": f"""WITH w AS (SELECT run_id, question_id, list_distinct(list_filter(string_split({key_sql('answer')}, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split({key_sql('predicted')}, ' '), lambda x: x <> '')) AS b FROM {_P} WHERE answer IS NOT NULL AND predicted IS NOT NULL),
        u AS (SELECT *, len(list_distinct(list_concat(a, b))) AS n FROM w) SELECT run_id, question_id, round(CASE WHEN n = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / n END, 6) AS jaccard FROM u""",
    "sample_stratified": "WITH r AS (SELECT question_id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY md5('7|' || question_id), question_id) AS round FROM heldout_items) SELECT * FROM r ORDER BY round, question_type LIMIT 50",
    "sample_deciles": """WITH o AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER () AS total FROM documents WHERE text IS NOT NULL),
        d AS (SELECT doc_id, chars, ((i + 1) * 10 - 1) // total AS decile FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY md5('7|' || doc_id), doc_id) AS n FROM d) SELECT doc_id, chars, decile FROM n WHERE n <= 20""",
    "label_sheet": _G + ", k AS (SELECT run_id, question_id, CASE WHEN vs[1] = vs[2] THEN 'agree' ELSE 'disagree' END AS kind FROM g WHERE len(vs) > 1) SELECT run_id, question_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('11|' || run_id || '|' || question_id), run_id, question_id) AS place FROM k QUALIFY place <= 40",
    "plan_chunks": f"""WITH RECURSIVE o AS (SELECT run_id, question_id, coalesce(reader_prompt_tokens, 0) AS cost, row_number() OVER (PARTITION BY run_id ORDER BY question_id) AS n FROM {_P}),
        c AS (SELECT run_id, question_id, n, cost AS load, CAST(0 AS BIGINT) AS chunk FROM o WHERE n = 1 UNION ALL
              SELECT o.run_id, o.question_id, o.n, CASE WHEN c.load + o.cost > 90000 THEN o.cost ELSE c.load + o.cost END, CASE WHEN c.load + o.cost > 90000 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN o ON o.run_id = c.run_id AND o.n = c.n + 1)
        SELECT run_id, question_id, chunk FROM c""",
}
ORACLES["power_table"] = """WITH g AS (SELECT n, d / 100.0::DOUBLE AS discordance, p / 100.0::DOUBLE AS gap FROM (VALUES (100), (200), (500)) a(n), (VALUES (10), (20)) b(d), (VALUES (2), (5), (10)) c(p)),
    f AS (SELECT m, k, exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2)) AS half, lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) AS c FROM (SELECT unnest(range(0, 501)) AS m), LATERAL (SELECT unnest(range(0, m + 1)) AS k)),
    t AS (SELECT m, k, c, least(1.0, 2 * sum(half) OVER (PARTITION BY m ORDER BY k)) <= 0.05 AND 2 * k <= m AS low FROM f),
    e AS (SELECT m, max(k) AS edge FROM t WHERE low GROUP BY m),
    o AS (SELECT t.m, t.k, t.c, CAST(t.k <= edge AS INTEGER) + CAST(t.m - t.k <= edge AS INTEGER) AS times FROM t JOIN e USING (m) WHERE t.k <= edge OR t.m - t.k <= edge),
    q AS (SELECT g.n, discordance, gap, exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * ln(discordance) + (n - m) * ln(1 - discordance)) AS w, c, m, k, times, (1 + gap / discordance) / 2 AS psi FROM g JOIN o ON o.m <= g.n)
    SELECT CAST(n AS INTEGER) AS n, discordance, gap, round(coalesce(sum(w * times * CASE WHEN psi >= 1 THEN CASE WHEN k = m THEN 1.0 ELSE 0.0 END ELSE exp(c + k * ln(psi) + (m - k) * ln(1 - psi)) END), 0.0), 6) AS power FROM q GROUP BY ALL"""
