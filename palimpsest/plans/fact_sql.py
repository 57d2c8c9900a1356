"""SQL of the queries that bring triples to one form, compare facts in order, or walk duplicates in order.

The word lists are those of the operators; what is done with them is written
anew for DuckDB: texts with doubled blanks take the place of look-arounds, and
walks are recursive queries with a list as their state.
"""

from __future__ import annotations

from palimpsest.functions import text, triples
from palimpsest.plans.ingest_queries import key_sql

_COLUMNS = ["user_id", "kind", "fact", "subject", "predicate", "object", "pair_key", "valid_time", "created_at", "raw", "salience", "initial_salience", "last_accessed", "supersedes"]
_M = f"(SELECT id, {', '.join(f'any_value({c}) AS {c}' for c in _COLUMNS)} FROM memories GROUP BY id)"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _lookup(pairs: dict[str, str], key: str) -> str:
    return f"MAP({_list(pairs)}, {_list(pairs.values())})[{key}]"


def _words(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '')"


def plain_sql(c: str) -> str:
    bare = key_sql(f"regexp_replace({c}, '[''’]', '', 'g')")
    return f"array_to_string(list_transform({_words(bare)}, lambda w: coalesce({_lookup(text.CONTRACTIONS, 'w')}, w)), ' ')"


_MARKS = "|".join(sorted((m.replace(" ", "  ") for m in triples.MARKERS), key=len, reverse=True))


def _wide(p: str) -> str:
    return f"(' ' || replace({p}, ' ', '  ') || ' ')"


def negations_sql(p: str) -> str:
    return f"len(regexp_extract_all({_wide(p)}, ' ({_MARKS}) '))"


def bare_sql(p: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_wide(p)}, ' ({_MARKS}) ', ' ', 'g'), ' +', ' ', 'g'))"


def _behind(p: str, words: list[str]) -> str:
    return f"regexp_replace({p}, '^((?:{'|'.join(words)}) )+', '')"


_SIGNED = {form: sign + name for name, sides in triples.ANTONYMS.items() for side, sign in (("positive", "+"), ("negative", "-")) for form in sides[side]}
_GROUP = {name: name for name in triples.FUNCTIONAL} | {form: name for name, said in triples.FUNCTIONAL.items() for form in said}
_DENIALS = [form for form, said in _SIGNED.items() if said[0] == "-"]


def triples_sql(source: str, columns: str) -> str:
    """CTEs up to ``tri``: rows of ``source`` with ``id``, the columns named, and ``s, p, o, polarity, functional``, null where there is no triple."""
    return f"""
    t0 AS (SELECT id, {columns} subject AS s0, predicate AS p0, object AS o0, {plain_sql('subject')} AS ps, {plain_sql('predicate')} AS pp, {plain_sql('object')} AS po FROM {source}),
    t1 AS (SELECT *, {_behind('ps', triples.ARTICLES)} AS s1, {_lookup(_SIGNED, 'pp')} AS whole, {_behind(f"coalesce(nullif({bare_sql('pp')}, ''), pp)", triples.AUXILIARIES)} AS rest,
             array_to_string(list_transform({_words('po')}, lambda w: coalesce({_lookup(triples.NUMBER_WORDS, 'w')}, w)), ' ') AS o1 FROM t0),
    t2 AS (SELECT *, CASE WHEN list_contains({_list(triples.FIRST_PERSON)}, s1) THEN 'user' ELSE s1 END AS s, coalesce(whole, {_lookup(_SIGNED, 'rest')}) AS hit,
             CASE WHEN whole IS NOT NULL THEN 0 ELSE {negations_sql('pp')} END AS pn, {_behind(bare_sql('o1'), triples.ARTICLES)} AS o, {negations_sql('o1')} AS nn FROM t1),
    t3 AS (SELECT *, coalesce(substr(hit, 2), rest) AS p1, (CASE WHEN hit LIKE '-%' THEN 1 ELSE 0 END + pn + nn) % 2 AS odd FROM t2),
    tri AS (SELECT id, {columns} CASE WHEN fine THEN s END AS s, CASE WHEN fine THEN p END AS p, CASE WHEN fine THEN o END AS o, CASE WHEN fine THEN CAST(1 - 2 * odd AS INTEGER) END AS polarity, CASE WHEN fine THEN functional END AS functional
            FROM (SELECT *, {_lookup(_GROUP, 'p1')} AS functional, coalesce({_lookup(_GROUP, 'p1')}, p1) AS p, coalesce(s0 <> '' AND p0 <> '' AND o0 <> '' AND s <> '' AND p1 <> '' AND o <> '', false) AS fine FROM t3))"""


def polarity_sql(fact: str) -> str:
    p = plain_sql(fact)
    return f"CAST(1 - 2 * (({negations_sql(p)} + len(list_filter({_list(_DENIALS)}, lambda f: contains(' ' || {p} || ' ', ' ' || f || ' ')))) % 2) AS INTEGER)"


_SIZE = "len(string_split({0}, ' '))"
_ENTROPY = f"""(SELECT id, coalesce(-sum(n / total * log2(n / total)), 0.0) AS bits FROM (SELECT id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS total FROM (SELECT id, unnest({_words(plain_sql('fact'))}) AS w FROM {_M} WHERE fact IS NOT NULL) GROUP BY id, w) GROUP BY id)"""

_VECTORS = """v AS (SELECT id, coalesce(user_id, '') AS u, kind, coalesce(created_at, '') AS ts, CAST(embedding AS DOUBLE[]) AS e
      FROM (SELECT id, any_value(user_id) AS user_id, any_value(kind) AS kind, any_value(created_at) AS created_at, any_value(embedding) AS embedding FROM memories GROUP BY id) WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    near AS (SELECT a.u, a.kind, a.id, b.id AS earlier, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, a.ts = b.ts AS same FROM v a JOIN v b ON a.u = b.u AND a.kind = b.kind AND b.id < a.id AND list_cosine_similarity(a.e, b.e) > 0.949999)"""

#: The walk over near records in order of id; its state are the records dropped so far.
GREEDY_SQL = f"""WITH RECURSIVE {_VECTORS},
    l AS (SELECT u, kind, id, list(struct_pack(o := earlier, c := cosine, s := same) ORDER BY cosine DESC, earlier) AS near, row_number() OVER (PARTITION BY u, kind ORDER BY id) AS k FROM near WHERE cosine >= 0.95 GROUP BY u, kind, id),
    walk AS (SELECT DISTINCT u, kind, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS dropped, CAST(NULL AS BIGINT) AS id, CAST(NULL AS STRUCT(o BIGINT, c DOUBLE, s BOOLEAN)) AS best FROM l
      UNION ALL
      SELECT u, kind, k, CASE WHEN best.s THEN list_append(dropped, id) ELSE dropped END, id, best
      FROM (SELECT l.u, l.kind, l.k, w.dropped, l.id, list_filter(l.near, lambda x: NOT list_contains(w.dropped, x.o))[1] AS best FROM walk w JOIN l ON l.u = w.u AND l.kind = w.kind AND l.k = w.k + 1))
    SELECT id, best.o AS neighbour, best.c AS cosine FROM walk WHERE best.s"""

TRIPLES_SQL = f"""WITH m AS (SELECT * FROM {_M} WHERE subject IS NOT NULL), {triples_sql('m', '')} SELECT id, s AS subject, p AS predicate, o AS object, coalesce(polarity, 0) AS polarity, functional FROM tri"""

SCREENED_SQL = f"""WITH m AS (SELECT * FROM {_M} WHERE kind = 'fact'), {triples_sql('m', 'fact,')}, {_VECTORS},
    best AS (SELECT id, earlier FROM near WHERE cosine >= 0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, earlier) = 1),
    e AS {_ENTROPY},
    f AS (SELECT tri.*, coalesce(polarity, {polarity_sql("coalesce(fact, '')")}) AS sign, coalesce(bits, 0.0) AS bits FROM tri LEFT JOIN e USING (id))
    SELECT a.id, b.id AS earlier, CASE WHEN a.sign <> b.sign THEN 'keep negation'
        WHEN coalesce(a.s = b.s AND a.p = b.p AND a.o <> b.o AND {_SIZE.format('a.o')} <= 6 AND {_SIZE.format('b.o')} <= 6, false) THEN 'keep value' WHEN least(a.bits, b.bits) < 2.0 THEN 'keep low-entropy' ELSE 'merge duplicate' END AS verdict
    FROM best JOIN f a ON a.id = best.id JOIN f b ON b.id = best.earlier"""


def losers_sql(day_sql, time_key: str, where: str) -> str:
    """CTEs up to ``lost (loser, winner, rule)``: every pair of a key in order, skipping facts that have lost."""
    day = day_sql("created_at")
    number = r"regexp_full_match(w, '\d+(\.\d+)?')"
    rough = f"list_contains({_list(text.APPROXIMATORS)}, w)"
    return f"""
    m AS (SELECT * FROM {_M} WHERE kind = 'fact' AND pair_key <> '' AND {where}), {triples_sql('m', 'user_id, pair_key, valid_time, created_at, raw,')},
    ff AS (SELECT *, list_filter(string_split(o, ' '), lambda w: {number} AND NOT {rough}) AS nums, list_filter(string_split(o, ' '), lambda w: NOT {number} AND NOT {rough}) AS res, {_SIZE.format('o')} AS words,
         struct_pack(t := {time_key}, s := struct_pack(y := coalesce(CAST(year({day}) AS INTEGER), 0), m := coalesce(CAST(month({day}) AS INTEGER), 0), d := coalesce(CAST(day({day}) AS INTEGER), 0)),
                     c := coalesce(created_at, ''), u := CAST(coalesce(starts_with(raw, 'user:'), false) AS INTEGER), i := id) AS ok FROM tri WHERE o IS NOT NULL AND s <> 'assistant'),
    pr AS (SELECT a.user_id AS u, a.pair_key AS k, a.id AS i, b.id AS j, b.ok > a.ok AS later,
         CASE WHEN a.o = b.o THEN CASE WHEN a.polarity <> b.polarity THEN 'negation' END WHEN a.polarity < 0 OR b.polarity < 0 OR greatest(a.words, b.words) > 6 THEN NULL WHEN a.functional IS NOT NULL THEN 'functional'
              WHEN len(a.nums) > 0 AND len(b.nums) > 0 AND a.nums <> b.nums AND a.res = b.res THEN 'numeric' END AS rule
         FROM ff a JOIN ff b ON a.user_id = b.user_id AND a.pair_key = b.pair_key AND a.id < b.id),
    st AS (SELECT *, row_number() OVER (PARTITION BY u, k ORDER BY j, i) AS n FROM pr WHERE rule IS NOT NULL),
    wk AS (SELECT DISTINCT u, k, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS dead, CAST(NULL AS BIGINT) AS loser, CAST(NULL AS BIGINT) AS winner, CAST(NULL AS VARCHAR) AS rule FROM st
      UNION ALL
      SELECT st.u, st.k, st.n, CASE WHEN list_contains(dead, i) OR list_contains(dead, j) THEN dead ELSE list_append(dead, CASE WHEN later THEN i ELSE j END) END,
             CASE WHEN NOT list_contains(dead, i) AND NOT list_contains(dead, j) THEN CASE WHEN later THEN i ELSE j END END, CASE WHEN later THEN j ELSE i END, st.rule
      FROM wk JOIN st ON st.u = wk.u AND st.k = wk.k AND st.n = wk.n + 1),
    lost AS (SELECT loser, winner, rule FROM wk WHERE loser IS NOT NULL)"""
