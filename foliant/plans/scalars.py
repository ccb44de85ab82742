"""X: scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators.deliveries import latest_chapters
from foliant.plans.deliveries import CH
from foliant.plans.registry import Catalogue
from foliant.refs import normal_ref
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql

#: A name in the form of ``normalized_name``, for the notations that the test tables have.
NAME = r"trim(regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_STRIP = r"regexp_replace({}, '^[\x09-\x0d\x20]+|[\x09-\x0d\x20]+$', '', 'g')"
_LINES = rf"""
raw AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, u.i::INTEGER AS line_no, {_STRIP.format('ls[u.i]')} AS line FROM raw, unnest(range(1, len(ls) + 1)) AS u(i))
"""


def document_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.lines("text")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


@_c.query(rf"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '{X.TOKEN}')), 0)::INTEGER AS n_tokens FROM documents""")
def x1_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count("text").alias("n_tokens"))


@_c.query(f"WITH {_LINES} SELECT doc_id, line_no, line FROM line")
def x2_lines(spark, d):
    return document_lines(spark, d)


@_c.query(rf"""WITH {_LINES}
SELECT doc_id, line_no, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{X.CHAPTER_HEADING}') THEN 'chapter'
  WHEN regexp_matches(line, '{X.SCENE_BREAK}') THEN 'break' WHEN regexp_matches(line, '{X.MARKDOWN_HEADING}') THEN 'markdown'
  WHEN regexp_matches(line, '{X.NUMBER_HEADING}') THEN 'number' WHEN regexp_matches(line, '{X.ROMAN_HEADING}') THEN 'roman' ELSE 'body' END AS kind
FROM line""")
def x3_line_kinds(spark, d):
    return document_lines(spark, d).select("doc_id", "line_no", X.line_kind("line").alias("kind"))


_ROMAN_SQL = """
(SELECT list_sum(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN coalesce(list_max(vs[i + 1:]), 0) > vs[i] THEN -vs[i] ELSE vs[i] END))
 FROM (SELECT list_transform(string_split(upper({0}), ''), lambda ch: (CASE ch WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50
 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END)) AS vs))"""


@_c.query(f"""
WITH found AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[IVXLCDM]+')) AS numeral FROM documents)
SELECT numeral, {_ROMAN_SQL.format('numeral')}::INTEGER AS value FROM found""")
def x4_roman(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[IVXLCDM]+"), F.lit(0))).alias("numeral")).distinct()
    return found.select("numeral", X.roman_value("numeral").alias("value"))


@_c.query(rf"""
WITH {_LINES}, one AS (SELECT DISTINCT line FROM line WHERE line <> ''),
part AS (SELECT line, regexp_extract(line, '(?i)^chapter[ \t]+([0-9]+|[ivxlcdm]+)(?:[^\p{{L}}\p{{N}}_]|\z)', 1) AS c,
  regexp_extract(line, '(?i)^(prologue|epilogue)(?:[^\p{{L}}\p{{N}}_]|\z)', 1) AS p, regexp_extract(line, '{X.NUMBER_HEADING}', 1) AS n,
  regexp_extract(line, '{X.ROMAN_HEADING}', 1) AS r FROM one)
SELECT line, CASE WHEN c <> '' THEN 'chapter:' || upper(c) WHEN p <> '' THEN lower(p) WHEN n <> '' THEN 'number:' || regexp_replace(n, '^0+([0-9])', '\1')
  ELSE 'roman:' || {_ROMAN_SQL.format('r')}::VARCHAR END AS key
FROM part WHERE c <> '' OR p <> '' OR n <> '' OR r <> ''""")
def x5_chapter_key(spark, d):
    lines = document_lines(spark, d).select("line").where("line <> ''").distinct()
    return lines.select("line", X.chapter_key("line").alias("key")).where("key is not null")


@_c.query("SELECT doc_id, sha256(text) AS digest FROM documents")
def x6_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sha256("text").alias("digest"))


@_c.query("""
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS evidence_id
FROM (SELECT DISTINCT id, sha1(from_hex(replace(manuscript_version_id, '-', '')) || encode(chapter_id || ':' || start_offset || ':' || end_offset)) AS h FROM entity_mentions)""")
def x7_uuid5(spark, d):
    name = F.concat_ws(":", "chapter_id", F.col("start_offset").cast("string"), F.col("end_offset").cast("string"))
    return table(spark, d, "entity_mentions").select("id", X.uuid5("manuscript_version_id", name).alias("evidence_id")).distinct()


@_c.query(f"SELECT DISTINCT surface_text, {NAME.format('surface_text')} AS name FROM entity_mentions")
def x8_normalized_names(spark, d):
    rows = table(spark, d, "entity_mentions").select("surface_text").distinct()
    return rows.select("surface_text", X.normalized_name("surface_text").alias("name"))


@_c.query(f"""
SELECT alias, array_to_string(list_sort(list_distinct(list_filter(string_split({NAME.format('alias')}, ' '),
  lambda w: w NOT IN ('', 'mr', 'mrs', 'ms', 'dr')))), ' ') AS words FROM (SELECT DISTINCT alias FROM entity_aliases)""")
def x9_without_honorifics(spark, d):
    rows = table(spark, d, "entity_aliases").select("alias").distinct()
    return rows.select("alias", F.array_join(X.name_words("alias"), " ").alias("words"))


_SPANS = f"""
{CH},
mention AS (SELECT DISTINCT id, chapter_id, surface_text, start_offset, end_offset FROM entity_mentions)
"""


def _spans(spark, d):
    chapters = latest_chapters(table(spark, d, "chapters")).select("chapter_id", "chapter_text")
    mentions = table(spark, d, "entity_mentions").select("id", normal_ref("chapter_id").alias("chapter_id"), "surface_text", "start_offset", "end_offset").distinct()
    return mentions.join(chapters, "chapter_id")


@_c.query(f"""WITH {_SPANS}
SELECT id, sha256(substr(chapter_text, greatest(0, start_offset - 500) + 1, least(length(chapter_text), end_offset + 500) - greatest(0, start_offset - 500))) AS excerpt_digest
FROM mention JOIN ch USING (chapter_id)""")
def x10_excerpt(spark, d):
    return _spans(spark, d).select("id", F.sha2(X.excerpt("chapter_text", "start_offset", "end_offset"), 256).alias("excerpt_digest"))


@_c.query(f"""WITH {_SPANS}
SELECT id, coalesce(start_offset >= 0 AND end_offset <= length(chapter_text) AND substr(chapter_text, start_offset + 1, end_offset - start_offset) = surface_text, false) AS matches
FROM mention JOIN ch USING (chapter_id)""")
def x11_span_check(spark, d):
    return _spans(spark, d).select("id", X.span_matches("chapter_text", "start_offset", "end_offset", "surface_text").alias("matches"))


@_c.query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[\x09-\x0d\x20]+', ' ', 'g'), '^ | $', '', 'g'), 1, 600) AS preview FROM documents""")
def x12_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


@_c.query("SELECT doc_id, CASE WHEN starts_with(title, 'The ') THEN substr(title, 5) ELSE title END AS bare_title FROM documents")
def x13_without_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", X.without_prefix("title", "The ").alias("bare_title"))


@_c.query(r"""
SELECT DISTINCT replace(normalized_alias, ' ', '_') AS name,
  coalesce(regexp_matches(replace(normalized_alias, ' ', '_'), '^[a-z][a-z0-9_]*\z') AND NOT regexp_matches(replace(normalized_alias, ' ', '_'), '^(has_|is_|was_|became_)'), false) AS ok
FROM entity_aliases""")
def x14_predicate_names(spark, d):
    name = F.replace(F.col("normalized_alias"), F.lit(" "), F.lit("_"))
    return table(spark, d, "entity_aliases").select(name.alias("name")).distinct().select("name", X.is_predicate("name").alias("ok"))


@_c.query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid FROM embeddings")
def x15_finite(spark, d):
    return table(spark, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & X.all_finite("embedding")).alias("valid"))


@_c.query("SELECT vec_id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY label ORDER BY vec_id)), 6) AS term FROM embeddings")
def x16_rrf_term(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.lit(1.0) / (60 + rank), 6).alias("term"))


@_c.query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 20 * 20""")
def x17_cosine(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") - F.col("vec_id") % 20).alias("other_id"))
    other = table(spark, d, "embeddings").select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return rows.join(other, "other_id").select("vec_id", F.round(X.cosine("embedding", "other"), 5).alias("cosine"))


@_c.query("SELECT DISTINCT id, (greatest(0, epoch_us(ready_at) - epoch_us(created_at)) // 1000)::BIGINT AS elapsed_ms FROM manuscript_versions WHERE ready_at IS NOT NULL")
def x18_elapsed(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, d, "manuscript_versions").where("ready_at is not null").select("id", "created_at", "ready_at").distinct()
    return rows.select("id", F.floor(F.greatest(F.lit(0).cast("long"), us("ready_at") - us("created_at")) / 1000).alias("elapsed_ms"))


@_c.query("""SELECT DISTINCT '{"file_size":' || file_size || ',"status":"' || status || '","version_number":' || version_number || '}' AS body FROM manuscript_versions""")
def x19_canonical_json(spark, d):
    return table(spark, d, "manuscript_versions").select(X.canonical_json("version_number", "status", "file_size").alias("body")).distinct()


@_c.query("SELECT doc_id, coalesce(((length(text) - length(replace(text, 'the ', ''))) / 4)::INTEGER, 0) AS n FROM documents")
def x20_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(X.occurrences("text", F.lit("the ")), F.lit(0)).alias("n"))


@_c.query("SELECT left(sha256(doc_id::VARCHAR), 12) AS doc_hash, '<redacted:' || length(text) || ' chars>' AS body FROM documents")
def x21_redaction(spark, d):
    return table(spark, d, "documents").select(X.short_hash("doc_id").alias("doc_hash"), X.redacted("text").alias("body"))


@_c.query("""
SELECT id, len(evidence_ids)::INTEGER AS n, array_to_string(list_sort(evidence_ids[1:2]), ',') AS first_two, coalesce(list_contains(evidence_ids, id), false) AS has_own
FROM (SELECT DISTINCT id, evidence_ids FROM entity_resolution_candidates WHERE evidence_ids IS NOT NULL)""")
def x22_arrays(spark, d):
    rows = table(spark, d, "entity_resolution_candidates").where("evidence_ids is not null").select("id", "evidence_ids").distinct()
    return rows.select("id", F.size("evidence_ids").alias("n"), F.array_join(F.array_sort(F.slice("evidence_ids", 1, 2)), ",").alias("first_two"), F.array_contains("evidence_ids", F.col("id")).alias("has_own"))
