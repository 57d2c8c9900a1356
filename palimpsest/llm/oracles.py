"""SQL of the queries for training text that DuckDB can express: brute force over all pairs of a scope, walks, runs of words."""

from __future__ import annotations

import unicodedata

from palimpsest.llm import lookalike

_VECTORS = """v AS (SELECT id, coalesce(user_id, '') AS u, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT id, any_value(user_id) AS user_id, any_value(embedding) AS embedding FROM memories GROUP BY id)
      WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 AND list_sum(list_transform(embedding, lambda x: CAST(x IS NULL OR NOT isfinite(x) AS INTEGER))) = 0),
    near AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.u = b.u AND a.id <> b.id),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM near)"""

_BLANK = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{85}"


def _key(c: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(lower({c}), '[^\\pL\\pN_{_BLANK}]', '', 'g'), '[{_BLANK}]+', ' ', 'g')), '')"


_WALK = f"""WITH RECURSIVE
    fine AS (SELECT 'm' AS t, id, coalesce(user_id, '') AS u, coalesce(kind, '') AS kind, {_key('content')} AS key, embedding AS e, 0 AS b FROM (SELECT id, any_value(user_id) AS user_id, any_value(kind) AS kind, any_value(content) AS content, any_value(embedding) AS embedding FROM memories GROUP BY id)
      UNION ALL SELECT 'a', arrival_id, coalesce(user_id, ''), coalesce(kind, ''), {_key('content')}, embedding, batch_no FROM (SELECT arrival_id, any_value(user_id) AS user_id, any_value(kind) AS kind, any_value(content) AS content, any_value(embedding) AS embedding, min(batch_no) AS batch_no FROM arrivals GROUP BY arrival_id)),
    r AS (SELECT t, id, u, kind, key, b FROM fine),
    w AS (SELECT t, id, u, kind, b, CAST(e AS DOUBLE[]) AS e FROM fine WHERE len(e) = 64 AND list_max(list_transform(e, lambda x: abs(x))) > 0 AND list_sum(list_transform(e, lambda x: CAST(x IS NULL OR NOT isfinite(x) AS INTEGER))) = 0),
    pairs AS (SELECT a.id, CASE WHEN p.t = 'a' THEN p.id END AS other, true AS same, false AS near FROM r a JOIN r p ON a.u = p.u AND a.kind = p.kind AND a.key = p.key AND a.t = 'a' AND (p.t = 'm' OR p.b < a.b OR (p.b = a.b AND p.id < a.id))
      UNION ALL SELECT a.id, CASE WHEN p.t = 'a' THEN p.id END, false, round(list_cosine_similarity(a.e, p.e), 6) >= 0.95 FROM w a JOIN w p ON a.u = p.u AND a.kind = p.kind AND a.t = 'a' AND (p.t = 'm' OR p.b < a.b OR (p.b = a.b AND p.id < a.id))),
    l AS (SELECT r.u, r.kind, r.id, coalesce(bool_or(same AND other IS NULL), false) AS same, coalesce(bool_or(near AND other IS NULL), false) AS near, coalesce(list(other) FILTER (pairs.same AND other IS NOT NULL), []) AS sames, coalesce(list(other) FILTER (pairs.near AND other IS NOT NULL), []) AS nears,
        row_number() OVER (PARTITION BY r.u, r.kind ORDER BY r.b, r.id) AS k FROM r LEFT JOIN pairs USING (id) WHERE r.t = 'a' GROUP BY r.u, r.kind, r.id, r.b),
    walk AS (SELECT DISTINCT u, kind, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS screen FROM l
      UNION ALL SELECT u, kind, k, CASE WHEN screen IS NULL THEN list_append(kept, id) ELSE kept END, id, screen FROM (
        SELECT l.u, l.kind, l.k, w.kept, l.id, CASE WHEN l.same OR list_has_any(l.sames, w.kept) THEN 'exact' WHEN l.near OR list_has_any(l.nears, w.kept) THEN 'cosine' END AS screen FROM walk w JOIN l ON l.u = w.u AND l.kind = w.kind AND l.k = w.k + 1))
    SELECT id AS arrival_id, screen FROM walk WHERE screen IS NOT NULL"""


def _shapes() -> tuple[str, str]:
    """Characters and what they look like, one for one: letters drawn alike, and forms that differ in width only."""
    pairs = {x: next(y for y in row if y) for row in lookalike._SHAPES for x in row if x}
    pairs |= {x: pairs.get(y, y) for x, y in lookalike._ALSO.items()}
    wide = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF)}
    pairs |= {x: pairs.get(y, y) for x, y in wide.items() if len(y) == 1 and y != x}
    pairs = {x: y for x, y in pairs.items() if x != y}
    return "".join(pairs), "".join(pairs.values())


def _words(c: str) -> str:
    """Words as they look: accents composed, invisible characters and joined letters resolved, shapes in one script."""
    gone = "\u00ad\u034f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
    a, b = (x.replace("'", "''") for x in _shapes())
    out = f"regexp_replace({c}, '[{gone}]', '', 'g')"
    for joined in "ﬀﬁﬂﬃﬄﬅﬆ":
        out = f"replace({out}, '{joined}', '{unicodedata.normalize('NFKC', joined)}')"
    return f"regexp_extract_all(lower(nfc_normalize(translate({out}, '{a}', '{b}'))), '[\\pL\\pN]+')"


def _runs(words: str) -> str:
    return f"list_transform(range(1, len({words}) - 8), lambda i: array_to_string(list_slice({words}, i, i + 9), ' '))"


_LEAKS = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT question_id, {_words('t')} AS w FROM (SELECT question_id, passage AS t FROM heldout_items UNION ALL SELECT question_id, question FROM heldout_items) WHERE t IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, unnest({_runs('w')}) AS g FROM d WHERE len(w) >= 10), ig AS (SELECT DISTINCT question_id, unnest({_runs('w')}) AS g FROM i WHERE len(w) >= 10)
    SELECT DISTINCT doc_id, question_id FROM dg JOIN ig USING (g)"""

ORACLES = {
    "p3_found": f"WITH {_VECTORS} SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM best WHERE rank <= 5 AND cosine >= 0.9",
    "p3_neighbours": f"WITH {_VECTORS} SELECT id, neighbour, cosine, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 5",
    "p4_found": _WALK,
    "p6_found": _LEAKS,
}
