"""SQL for the rows that hold among several deliveries."""

from __future__ import annotations


def ref_sql(column: str) -> str:
    return f"nullif(lower(trim(replace(replace(trim({column}), '{{', ''), '}}', ''))), '')"


#: Chapters by the latest ``loaded_at``; a text of the same digest stands for a missing one.
CH = rf"""delivered AS (SELECT id, {ref_sql('manuscript_version_id')} AS v, ordinal, title, text, loaded_at,
  coalesce(sha256(text), nullif(regexp_replace(lower(regexp_replace(content_hash, '\s+', '', 'g')), '^(sha-?256:|0x)', ''), '')) AS h FROM chapters),
ch AS (SELECT r.id AS chapter_id, v AS version_id, ordinal, title, (SELECT max(t.text) FROM delivered t WHERE t.id = r.id AND t.h = r.h) AS chapter_text FROM delivered r
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST, title DESC NULLS LAST, ordinal DESC NULLS LAST, v DESC NULLS LAST) = 1)"""
