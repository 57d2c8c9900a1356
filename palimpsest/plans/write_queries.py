"""Queries over duplicates, contradictions, logical time and decay."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, triples
from palimpsest.functions.text import token_entropy
from palimpsest.operators import conflict, dedup
from palimpsest.operators.history import pair_key_of, squeeze
from palimpsest.plans.fact_sql import GREEDY_SQL, SCREENED_SQL, TRIPLES_SQL, losers_sql
from palimpsest.plans.ingest_queries import ONE_MEMORY, key_sql
from palimpsest.session import once, read_table


def _memories(spark, sf_dir, *cols):
    return once(read_table(spark, sf_dir, "memories").select("id", *cols), "id")


def exact_dedup(spark, sf_dir):
    return dedup.exact_duplicates(_memories(spark, sf_dir, "user_id", "kind", "created_at", "content"))


def _links(spark, sf_dir):
    return dedup.near_links(_memories(spark, sf_dir, "user_id", "kind", "created_at", "embedding"))


def cosine_flags(spark, sf_dir):
    return dedup.nearest_earlier(_links(spark, sf_dir)).select("id", F.col("earlier").alias("neighbour"), F.round("cosine", 5).alias("cosine"), "same_session")


def greedy_dedup(spark, sf_dir):
    return dedup.greedy_drops(_links(spark, sf_dir))


def duplicate_counts(spark, sf_dir):
    d = exact_dedup(spark, sf_dir)
    return d.where("id <> first_id").groupBy("first_id").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("last_copy"))


def normalized_triples(spark, sf_dir):
    m = _memories(spark, sf_dir, "subject", "predicate", "object").where("subject IS NOT NULL")
    return m.select("id", triples.triple_column(F.col("subject"), F.col("predicate"), F.col("object")).alias("t")).select("id", "t.subject", "t.predicate", "t.object", F.coalesce("t.polarity", F.lit(0)).alias("polarity"), "t.functional")


def screened_pairs(spark, sf_dir):
    """What the screens say of each near fact and its nearest earlier one."""
    near = dedup.nearest_earlier(_links(spark, sf_dir))
    m = _memories(spark, sf_dir, "kind", "fact", "subject", "predicate", "object").where("kind = 'fact'")
    t = m.select("id", "fact", triples.triple_column(F.col("subject"), F.col("predicate"), F.col("object")).alias("t"), token_entropy(F.coalesce("fact", F.lit(""))).alias("e"))
    both = near.join(t, "id").join(t.select(F.col("id").alias("earlier"), F.col("fact").alias("fact_b"), F.col("t").alias("t_b"), F.col("e").alias("e_b")), "earlier")
    return both.select("id", "earlier", triples.screen(F.col("fact"), F.col("t"), F.col("fact_b"), F.col("t_b"), 2.0, F.col("e"), F.col("e_b")).alias("verdict"))


def conflict_losers(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "kind", "pair_key", "subject", "predicate", "object", "valid_time", "created_at", "raw")
    return conflict.resolve_all(conflict.keyed_facts(m))


def supersede_latest(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "kind", "pair_key", "object", "valid_time", "created_at", "raw")
    m = m.where("kind = 'fact' AND pair_key IS NOT NULL").withColumn("key", pair_key_of(F.col("pair_key"))).where(squeeze(F.col("object")) != "")
    order = conflict.order_key(F.col("valid_time"), F.col("created_at"), F.col("raw"), F.col("id"))
    c = conflict.champions(m, ["user_id", "key"], "object", order)
    return c.select("id", "is_active", F.coalesce("supersedes", F.lit(-1)).alias("supersedes"))


def order_keys(spark, sf_dir):
    m = _memories(spark, sf_dir, "kind", "valid_time", "created_at", "raw").where("kind = 'fact'")
    k = dates.effective_key(F.col("valid_time"), F.col("created_at"))
    return m.select("id", k["y"].alias("y"), k["m"].alias("m"), k["d"].alias("d"), conflict.trust(F.col("raw")).alias("trust"))


def now_logical(spark, sf_dir):
    return conflict.now_logical(_memories(spark, sf_dir, "user_id", "created_at")).where("user_id IS NOT NULL")


def decay(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "created_at", "salience", "initial_salience", "last_accessed")
    return conflict.decay(m).select("id", F.round("salience", 6).alias("salience"))


def consolidate(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "kind", "pair_key", "subject", "predicate", "object", "valid_time", "created_at", "raw", "salience", "initial_salience", "last_accessed", "supersedes")
    return conflict.consolidate(m).select("id", F.round("salience", 6).alias("salience"), F.coalesce("supersedes", F.lit(-1)).alias("supersedes"))


def logical_days(spark, sf_dir):
    m = _memories(spark, sf_dir, "user_id", "created_at", "last_accessed")
    return m.join(conflict.now_logical(m), "user_id").select("id", dates.logical_days(F.col("now"), F.col("last_accessed")).alias("days"))


def anchor_dates(spark, sf_dir):
    m = _memories(spark, sf_dir, "created_at").select("created_at").distinct()
    return m.select("created_at", F.coalesce(dates.iso(dates.anchor_date(F.col("created_at"))), F.lit("")).alias("day"), dates.date_of(F.col("created_at")).alias("text_day"), F.coalesce(dates.epoch(F.col("created_at")), F.lit(-1)).alias("epoch"))


def effective_times(spark, sf_dir):
    m = _memories(spark, sf_dir, "kind", "valid_time", "created_at").where("kind = 'fact'")
    return m.select("id", F.coalesce(dates.effective_time(F.col("valid_time"), F.col("created_at")), F.lit("")).alias("effective"))


def question_windows(spark, sf_dir):
    q = read_table(spark, sf_dir, "predictions").select("question").distinct()
    w = dates.question_window(F.col("question"), F.lit("2023-04-01").cast("date"))
    return q.select("question", w.alias("w")).where("w.start IS NOT NULL").select("question", dates.iso(F.col("w.start")).alias("start_day"), dates.iso(F.col("w.end")).alias("end_day"), "w.precision")


def time_matches(spark, sf_dir):
    m = _memories(spark, sf_dir, "kind", "valid_time", "created_at").where("kind = 'fact'")
    w = dates.question_window(F.lit("what happened in the past two years?"), F.lit("2024-06-15").cast("date"))
    return m.select("id", dates.time_match(dates.effective_time(F.col("valid_time"), F.col("created_at")), w).alias("time_match"))


def resolved_mentions(spark, sf_dir):
    m = _memories(spark, sf_dir, "time_mention", "created_at", "fact").where("time_mention IS NOT NULL")
    return m.select("id", "time_mention", F.coalesce(dates.resolve_column(F.col("time_mention"), F.col("created_at"), F.col("fact")), F.lit("")).alias("valid_time"))


QUERIES = {f.__name__: f for f in (exact_dedup, cosine_flags, greedy_dedup, duplicate_counts, normalized_triples, screened_pairs, conflict_losers, supersede_latest, order_keys, now_logical, decay, consolidate, logical_days, anchor_dates, effective_times, question_windows, time_matches, resolved_mentions)}

_DAY = "try_cast(replace(regexp_extract({0}, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}'), '/', '-') AS DATE)"
_M = ONE_MEMORY
_V = "(SELECT id, any_value(user_id) AS user_id, any_value(kind) AS kind, any_value(created_at) AS created_at, any_value(embedding) AS embedding FROM memories GROUP BY id)"


def day_sql(c: str) -> str:
    return _DAY.format(c)


def _time_key(v: str, c: str) -> str:
    part = lambda n, f: f"CASE WHEN regexp_full_match(trim({v}), '\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?') THEN coalesce(try_cast(nullif(split_part(trim({v}), '-', {n}), '') AS INTEGER), 0) ELSE coalesce(CAST({f}({day_sql(c)}) AS INTEGER), 0) END"
    return f"struct_pack(y := {part(1, 'year')}, m := {part(2, 'month')}, d := {part(3, 'day')})"


_NOW = f"(SELECT user_id, max(struct_pack(d := {day_sql('created_at')}, ts := created_at)).ts AS now FROM {_M} WHERE {day_sql('created_at')} IS NOT NULL GROUP BY user_id)"
_DAYS = f"greatest(0, coalesce(date_diff('day', {day_sql('last_accessed')}, {day_sql('now')}), 0))"

_MON = "january|february|march|april|may|june|july|august|september|october|november|december"
_MON_NO = "list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], {0})"
# The forms that the table's mentions have: yesterday, month and day either way round, month, year; none looks forward.
_MENTIONS = f"""WITH m AS (SELECT id, time_mention, lower(time_mention) AS t, {_DAY.format('created_at')} AS seen FROM (SELECT id, any_value(time_mention) AS time_mention, any_value(created_at) AS created_at FROM memories WHERE time_mention IS NOT NULL GROUP BY id)),
    p AS (SELECT *, regexp_extract(t, '\\b({_MON}) (\\d{{1,2}})\\b', ['mon', 'd']) AS md, regexp_extract(t, '\\b(\\d{{1,2}}) ({_MON})\\b', ['d', 'mon']) AS dm, regexp_extract(t, '\\b({_MON})\\b', 1) AS mo, regexp_extract(t, '\\b((?:19|20)\\d{{2}})\\b', 1) AS y FROM m),
    q AS (SELECT *, CASE WHEN md.mon <> '' THEN md.mon ELSE dm.mon END AS mn, CASE WHEN md.mon <> '' THEN md.d ELSE dm.d END AS dd FROM p),
    r AS (SELECT *, {_MON_NO.format('mn')} AS mi, {_MON_NO.format('mo')} AS oi, try_cast(dd AS INTEGER) AS di FROM q),
    s AS (SELECT *, try_cast(year(seen) || '-' || lpad(CAST(mi AS VARCHAR), 2, '0') || '-' || lpad(CAST(di AS VARCHAR), 2, '0') AS DATE) AS d_this, try_cast((year(seen) - 1) || '-' || lpad(CAST(mi AS VARCHAR), 2, '0') || '-' || lpad(CAST(di AS VARCHAR), 2, '0') AS DATE) AS d_last FROM r)
    SELECT id, time_mention, coalesce(CASE WHEN seen IS NULL THEN NULL WHEN t LIKE '%yesterday%' THEN strftime(seen - 1, '%Y-%m-%d') WHEN mn <> '' THEN CASE WHEN d_this IS NULL THEN NULL WHEN d_this > seen THEN strftime(d_last, '%Y-%m-%d') ELSE strftime(d_this, '%Y-%m-%d') END
      WHEN mo <> '' THEN (CASE WHEN oi <= month(seen) THEN year(seen) ELSE year(seen) - 1 END) || '-' || lpad(CAST(oi AS VARCHAR), 2, '0') WHEN y <> '' THEN y END, '') AS valid_time FROM s"""

ORACLES = {
    "resolved_mentions": _MENTIONS,
    "exact_dedup": f"""WITH k AS (SELECT id, user_id, kind, CASE WHEN kind = 'fact' THEN coalesce(created_at, '') ELSE '' END AS s, md5({key_sql("coalesce(content, '')")}) AS key FROM {_M})
        SELECT id, min(id) OVER (PARTITION BY user_id, kind, s, key) AS first_id FROM k""",
    "duplicate_counts": f"""WITH k AS (SELECT id, user_id, kind, CASE WHEN kind = 'fact' THEN coalesce(created_at, '') ELSE '' END AS s, md5({key_sql("coalesce(content, '')")}) AS key FROM {_M})
        SELECT min(id) AS first_id, count(*) - 1 AS copies, max(id) AS last_copy FROM k GROUP BY user_id, kind, s, key HAVING count(*) > 1""",
    "cosine_flags": f"""WITH v AS (SELECT id, coalesce(user_id, '') AS u, kind, coalesce(created_at, '') AS ts, CAST(embedding AS DOUBLE[]) AS e FROM {_V} WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        p AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, a.ts = b.ts AS same_session FROM v a JOIN v b ON a.u = b.u AND a.kind = b.kind AND b.id < a.id)
        SELECT id, neighbour, round(cosine, 5) AS cosine, same_session FROM p WHERE cosine >= 0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p.cosine DESC, neighbour) = 1""",
    "supersede_latest": f"""WITH f AS (SELECT id, user_id, trim(regexp_replace(lower(pair_key), '\\s*\\|\\s*', '|', 'g')) AS key,
              struct_pack(t := {_time_key('valid_time', 'created_at')}, s := struct_pack(y := coalesce(CAST(year({day_sql('created_at')}) AS INTEGER), 0), m := coalesce(CAST(month({day_sql('created_at')}) AS INTEGER), 0), d := coalesce(CAST(day({day_sql('created_at')}) AS INTEGER), 0)), c := coalesce(created_at, ''), u := CAST(coalesce(starts_with(raw, 'user:'), false) AS INTEGER), i := id) AS k
            FROM {_M} WHERE kind = 'fact' AND pair_key IS NOT NULL AND trim(regexp_replace(object, '\\s+', ' ', 'g')) <> ''),
        m AS (SELECT *, max(k) OVER (PARTITION BY user_id, key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(k) OVER (PARTITION BY user_id, key) AS best FROM f),
        d AS (SELECT greatest(k, before).i AS win, least(k, before).i AS lose FROM m WHERE before IS NOT NULL),
        b AS (SELECT win, max(lose) AS supersedes FROM d GROUP BY win)
        SELECT id, best.i = id AS is_active, coalesce(supersedes, -1) AS supersedes FROM m LEFT JOIN b ON win = id""",
    "order_keys": f"SELECT id, k.y AS y, k.m AS m, k.d AS d, trust FROM (SELECT id, {_time_key('valid_time', 'created_at')} AS k, CAST(coalesce(starts_with(raw, 'user:'), false) AS INTEGER) AS trust FROM {_M} WHERE kind = 'fact')",
    "now_logical": f"SELECT user_id, now FROM {_NOW} WHERE user_id IS NOT NULL",
    "decay": f"""WITH d AS (SELECT id, salience AS was, coalesce(initial_salience, salience) AS init, {_DAYS} AS days FROM {_M} LEFT JOIN {_NOW} USING (user_id) WHERE salience > 0),
        n AS (SELECT id, was, greatest(least(0.15, init), init * pow(0.5, days / 30.0)) AS s FROM d) SELECT id, round(s, 6) AS salience FROM n WHERE abs(s - was) > 1e-9""",
    "logical_days": f"SELECT id, CAST({_DAYS} AS INTEGER) AS days FROM {_M} JOIN {_NOW} USING (user_id)",
    "anchor_dates": f"SELECT DISTINCT created_at, coalesce(strftime({day_sql('created_at')}, '%Y-%m-%d'), '') AS day, regexp_extract(created_at, '^[^T ]*') AS text_day, coalesce(CAST(epoch(try_strptime(regexp_replace(created_at, ' \\([A-Za-z]{{3}}\\) ', ' '), '%Y/%m/%d %H:%M')) AS BIGINT), -1) AS epoch FROM memories",
    "effective_times": f"SELECT id, coalesce(nullif(valid_time, ''), strftime({day_sql('created_at')}, '%Y-%m-%d'), '') AS effective FROM {_M} WHERE kind = 'fact'",
    "question_windows": """WITH q AS (SELECT DISTINCT question, regexp_extract(regexp_replace(replace(lower(question), ',', ' '), '\\s+', ' ', 'g'), '\\b(?:in|during|of)(?: the month of)? (january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\\b', 1) AS mon FROM predictions),
        d AS (SELECT question, make_date(CASE WHEN n <= 4 THEN 2023 ELSE 2022 END, n, 1) AS s FROM (SELECT question, CASE substr(mon, 1, 3) WHEN 'jan' THEN 1 WHEN 'feb' THEN 2 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4 WHEN 'may' THEN 5 WHEN 'jun' THEN 6 WHEN 'jul' THEN 7 WHEN 'aug' THEN 8 WHEN 'sep' THEN 9 WHEN 'oct' THEN 10 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 END AS n FROM q WHERE mon <> ''))
        SELECT question, strftime(s, '%Y-%m-%d') AS start_day, strftime(last_day(s), '%Y-%m-%d') AS end_day, 'month' AS precision FROM d""",
    "time_matches": f"""WITH e AS (SELECT id, coalesce(nullif(valid_time, ''), strftime({day_sql('created_at')}, '%Y-%m-%d')) AS eff FROM {_M} WHERE kind = 'fact')
        SELECT id, CASE WHEN regexp_full_match(eff, '\\d+-\\d+-\\d+') AND try_cast(eff AS DATE) BETWEEN DATE '2022-06-15' AND DATE '2024-06-15' THEN 1.0::DOUBLE
                        WHEN regexp_full_match(eff, '\\d+-\\d+') AND try_cast(eff || '-01' AS DATE) <= DATE '2024-06-15' AND last_day(try_cast(eff || '-01' AS DATE)) >= DATE '2022-06-15' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS time_match FROM e""",
}
ORACLES |= {
    "greedy_dedup": GREEDY_SQL,
    "normalized_triples": TRIPLES_SQL,
    "screened_pairs": SCREENED_SQL,
    "conflict_losers": f"WITH RECURSIVE {losers_sql(day_sql, _time_key('valid_time', 'created_at'), 'true')} SELECT loser, winner, rule FROM lost",
    "consolidate": f"""WITH RECURSIVE {losers_sql(day_sql, _time_key('valid_time', 'created_at'), 'salience > 0')},
        won AS (SELECT winner, max(loser) AS beaten FROM lost GROUP BY winner),
        now AS {_NOW},
        r AS (SELECT x.id, x.user_id, x.last_accessed, x.initial_salience, CASE WHEN lost.loser IS NOT NULL THEN 0.0 ELSE x.salience END AS was, coalesce(won.beaten, x.supersedes) AS supersedes FROM {_M} x LEFT JOIN lost ON lost.loser = x.id LEFT JOIN won ON won.winner = x.id),
        d AS (SELECT r.*, coalesce(initial_salience, was) AS init, {_DAYS} AS days FROM r LEFT JOIN now USING (user_id))
        SELECT id, round(CASE WHEN was > 0 THEN greatest(least(0.15, init), init * pow(0.5, days / 30.0)) ELSE was END, 6) AS salience, coalesce(supersedes, -1) AS supersedes FROM d""",
}
