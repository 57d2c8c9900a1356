"""Queries over attribute histories."""

from __future__ import annotations

from palimpsest.operators.history import attribute_history
from palimpsest.session import read_table

_FACTS = r"""
    WITH one AS (
      SELECT id, any_value(user_id) AS user_id, any_value(pair_key) AS pair_key, any_value(object) AS object, any_value(valid_time) AS valid_time,
             any_value(created_at) AS created_at, any_value(supersedes) AS supersedes, any_value(salience) AS salience
      FROM memories WHERE pair_key IS NOT NULL AND trim(regexp_replace(object, '\s+', ' ', 'g')) <> '' GROUP BY id),
    facts AS (
      SELECT id, user_id, trim(regexp_replace(lower(pair_key), '\s*\|\s*', '|', 'g')) AS key, trim(regexp_replace(lower(object), '\s+', ' ', 'g')) AS value,
             supersedes, salience IS DISTINCT FROM 0 AS live,
             coalesce(CASE WHEN regexp_full_match(trim(valid_time), '\d{4}') THEN try_cast(trim(valid_time) || '-01-01' AS DATE)
                           WHEN regexp_full_match(trim(valid_time), '\d{4}-\d{2}') THEN try_cast(trim(valid_time) || '-01' AS DATE)
                           WHEN regexp_full_match(trim(valid_time), '\d{4}-\d{2}-\d{2}') THEN try_cast(trim(valid_time) AS DATE) END,
                      try_cast(replace(regexp_extract(created_at, '\d{4}[-/]\d{1,2}[-/]\d{1,2}'), '/', '-') AS DATE)) AS start
      FROM one),
    stand AS (
      SELECT * FROM facts f WHERE start IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM facts g WHERE g.user_id IS NOT DISTINCT FROM f.user_id AND g.key = f.key AND g.start = f.start AND g.id <> f.id AND g.supersedes = f.id)),
    win AS (SELECT * FROM stand QUALIFY row_number() OVER (PARTITION BY user_id, key, start ORDER BY live DESC, id DESC) = 1),
    runs AS (SELECT *, lag(value) OVER (PARTITION BY user_id, key ORDER BY start) AS before FROM win),
    heads AS (SELECT * FROM runs WHERE before IS NULL OR before <> value)
"""


def p5_found(spark, sf_dir):
    return attribute_history(read_table(spark, sf_dir, "memories")).select("id", "valid_from", "valid_to")


QUERIES = {"p5_found": p5_found}
ORACLES = {
    "p5_found": _FACTS + """
    SELECT id, strftime(start, '%Y-%m-%d') AS valid_from,
           coalesce(strftime(lead(start) OVER (PARTITION BY user_id, key ORDER BY start), '%Y-%m-%d'), '') AS valid_to FROM heads""",
}
