"""P, W and A22: structuring of the documents, held against SQL that parses the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators.relational import numbered_within, recent
from foliant.operators.structure import NO_CHAPTERS, Chunking, chunk_statistics, document_blocks, overlap_study, publish, structured
from foliant.plans.registry import Catalogue
from foliant.plans.scalars import _ROMAN_SQL
from foliant.refs import normal_word
from foliant.shared import Workspace
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql

def _parts(spark, d):
    return structured(table(spark, d, "documents"), "doc_id", "text", "file_kind", Chunking())


#: White space and word characters as Python's expressions have them, inside brackets.
_S, _W = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}", r"\p{L}\p{N}_"
_CHAPTER_LINE = rf"(?i)(?:chapter[{_S}]+(?:\p{{Nd}}+|[ivxlcdm]+)|prologue|epilogue)\.?(?:(?:[{_S}]*[:\-–—][{_S}]*|[{_S}]+)[^{_S}][^\n]*)?"
_MARKDOWN_LINE = rf"#{{1,6}}[{_S}]+([^\n]+?)(?:[{_S}]+#+)?"
_ROMAN_LINE = rf"(?i)([ivxlcdm]+)\.[{_S}]+[^{_S}][^\n]*"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"


#: From documents to blocks, chapters and scenes.
_STEPS = rf"""
d AS (SELECT doc_id, coalesce(lower(trim(file_kind)) = 'md', false) AS md, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM {{documents}} WHERE text IS NOT NULL),
l AS (SELECT doc_id, md, u.i AS n, ls[u.i] AS raw, {_stripped('ls[u.i]')} AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN md AND regexp_full_match(line, '{_MARKDOWN_LINE}') THEN 'heading'
  WHEN regexp_full_match(line, '\*[{_S}]*\*[{_S}]*\*|---') OR (line = '#' AND NOT md) THEN 'break' WHEN NOT md AND regexp_full_match(line, '{_CHAPTER_LINE}') THEN 'heading' ELSE 'body' END AS given FROM l),
g AS (SELECT *, sum(CASE WHEN given = 'body' AND before = 'body' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM (SELECT *, lag(given) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k)),
blk AS (SELECT doc_id, any_value(md) AS md, row_number() OVER (PARTITION BY doc_id ORDER BY min(n)) AS b, min(n) AS line, any_value(given) AS given,
  CASE WHEN any_value(given) = 'body' THEN {_stripped(f"string_agg(regexp_replace(raw, '[{_S}]+$', ''), chr(10) ORDER BY n)")}
    WHEN any_value(given) = 'heading' AND any_value(md) THEN {_stripped(f"regexp_extract(any_value(line), '^{_MARKDOWN_LINE}$', 1)")} ELSE any_value(line) END AS text
  FROM g WHERE given <> 'blank' GROUP BY doc_id, g),
sized AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY b) AS upto FROM blk),
cand AS (SELECT doc_id, b, 'number' AS p, try_cast(text AS HUGEINT) AS v, upto, length(text) AS own FROM sized WHERE NOT md AND regexp_full_match(text, '\p{{Nd}}+')
  UNION ALL SELECT doc_id, b, 'roman', {_ROMAN_SQL.format('r')}, upto, own FROM (SELECT *, regexp_extract(text, '^{_ROMAN_LINE}$', 1) AS r, length(text) AS own FROM sized WHERE NOT md AND regexp_full_match(text, '{_ROMAN_LINE}'))),
prev AS (SELECT *, lag(v) OVER w AS pv, upto - own - lag(upto) OVER w AS gap FROM cand WINDOW w AS (PARTITION BY doc_id, p ORDER BY b)),
isl AS (SELECT *, sum(CASE WHEN v = pv + 1 AND v <> 1 AND gap >= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, p ORDER BY b) AS island FROM prev),
num AS (SELECT DISTINCT doc_id, b FROM (SELECT *, count(*) OVER i AS size, min(v) OVER i AS low FROM isl WINDOW i AS (PARTITION BY doc_id, p, island)) WHERE size >= 3 AND low = 1),
keyed AS (SELECT blk.*, num.b IS NOT NULL AS numbered, CASE WHEN md OR (given <> 'heading' AND num.b IS NULL) THEN NULL
  WHEN regexp_matches(text, '(?i)^chapter[{_S}]+(\p{{Nd}}+|[ivxlcdm]+)(?:[^{_W}]|\z)') THEN 'chapter ' || upper(regexp_extract(text, '(?i)^chapter[{_S}]+(\p{{Nd}}+|[ivxlcdm]+)', 1))
  WHEN regexp_matches(text, '(?i)^(prologue|epilogue)(?:[^{_W}]|\z)') THEN lower(regexp_extract(text, '(?i)^(prologue|epilogue)', 1))
  WHEN regexp_full_match(text, '\p{{Nd}}+') THEN 'number ' || coalesce(try_cast(text AS HUGEINT)::VARCHAR, text)
  WHEN regexp_full_match(text, '{_ROMAN_LINE}') THEN 'roman ' || {_ROMAN_SQL.format(f"regexp_extract(text, '^{_ROMAN_LINE}$', 1)")} END AS key
  FROM blk LEFT JOIN num USING (doc_id, b)),
typed AS (SELECT *, CASE WHEN key IS NOT NULL AND b <> max(b) OVER (PARTITION BY doc_id, key) THEN 'body' WHEN numbered THEN 'heading' ELSE given END AS kind FROM keyed),
headed AS (SELECT *, sum((kind = 'heading')::INTEGER) OVER (PARTITION BY doc_id ORDER BY b) AS c, count(*) FILTER (kind = 'heading') OVER (PARTITION BY doc_id) AS heads FROM typed),
placed AS (SELECT doc_id, b, line, text, greatest(c, 1) AS chapter, heads, CASE WHEN c = 0 AND heads > 0 THEN 'body' ELSE kind END AS kind FROM headed),
chapters_ AS (SELECT doc_id, chapter, max(text) FILTER (kind = 'heading') AS title, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY b) FILTER (kind <> 'heading'), '') AS text FROM placed GROUP BY doc_id, chapter),
inside AS (SELECT *, sum(length(text) + 2) OVER w - length(text) - 2 AS a, sum((kind = 'break')::INTEGER) OVER w AS island FROM placed WHERE kind <> 'heading' WINDOW w AS (PARTITION BY doc_id, chapter ORDER BY b)),
scenes_ AS (SELECT doc_id, chapter, island, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY island) AS scene, min(a) AS s0, max(a + length(text)) AS s1 FROM inside WHERE kind <> 'break' GROUP BY doc_id, chapter, island),
worded AS (SELECT s.*, substr(c.text, s0::INTEGER + 1, (s1 - s0)::INTEGER) AS text FROM scenes_ s JOIN chapters_ c USING (doc_id, chapter)),
ok AS (SELECT DISTINCT doc_id FROM worded WHERE regexp_matches(text, '[^{_S}]'))
"""


_BLOCKS = _STEPS.replace("{documents}", "documents")

#: Versions put together from their chapters, once under successive numbers and once under their ordinals, which come again with a redelivery.
_BOUND = """bound AS (SELECT v || ':' || k AS doc_id, 'txt' AS file_kind, string_agg(CASE k WHEN 'n' THEN n::VARCHAR ELSE 'Chapter ' || ordinal END || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY n) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY ordinal, loaded_at, id, t) AS n FROM (SELECT manuscript_version_id AS v, ordinal, loaded_at, id, coalesce(text, '') AS t FROM chapters)),
  (SELECT unnest(['n', 'c']) AS k) GROUP BY v, k)"""
_BOUND_BLOCKS = f"{_BOUND}, {_STEPS.replace('{documents}', 'bound')}"


def _chunks_sql(name: str = "", rule: Chunking = Chunking()) -> str:
    """Tokens of the scenes and the chain of their chunks by a rule; the names of both end in ``name``."""
    stop = f"(SELECT CASE WHEN x <= least({{0}} + {rule.most}, n) THEN x ELSE least({{0}} + {rule.most}, n) END FROM (SELECT list_min(list_filter(stops, lambda y: y >= least({{0}} + {rule.target}, n))) AS x))"
    return rf"""
tok{name} AS (SELECT doc_id, chapter, scene, s0, text, len(ends) AS n, ends, list_transform(list_zip(ends, tiles), lambda z: z[1] - length(regexp_replace(z[2], '^[{_S}]+', ''))) AS starts, list_append(stops, len(ends)) AS stops
  FROM (SELECT *, list_transform(range(1, len(tiles) + 1), lambda i: list_sum(list_transform(tiles[1:i], lambda t: length(t)))::BIGINT) AS ends,
    list_transform(range(1, len(pieces) + 1), lambda i: list_sum(list_transform(pieces[1:i], lambda t: len(regexp_extract_all(t, '[{_W}]+|[^{_W}{_S}]'))))::BIGINT) AS stops
    FROM (SELECT *, regexp_extract_all(text, '[{_S}]*(?:[{_W}]+|[^{_W}{_S}])') AS tiles,
      regexp_extract_all(text, '(?s)(?:.*?(?:\n[{_S}]*\n|[.!?]["''’”)]*(?:[{_S}]+|\z)))|.+') AS pieces FROM worded)) WHERE len(ends) > 0),
chain{name} AS (SELECT doc_id, chapter, scene, 1 AS chunk, 0::BIGINT AS first, {stop.format('0')}::BIGINT AS stop FROM tok{name}
  UNION ALL SELECT doc_id, chapter, scene, chunk + 1, stop - {rule.overlap}, {stop.format(f'(stop - {rule.overlap})')}::BIGINT FROM chain{name} JOIN tok{name} USING (doc_id, chapter, scene) WHERE stop < n),
chunks_{name} AS (SELECT doc_id, chapter, scene, chunk, s0 + starts[first + 1] AS start_offset, s0 + ends[stop] AS end_offset, stop - first AS n_tokens, stop, n,
  substr(text, starts[first + 1]::INTEGER + 1, (ends[stop] - starts[first + 1])::INTEGER) AS text FROM chain{name} JOIN tok{name} USING (doc_id, chapter, scene))
"""


def _bound_blocks(spark, d):
    rows = table(spark, d, "chapters").select(F.col("manuscript_version_id").alias("v"), "ordinal", "loaded_at", "id", F.coalesce("text", F.lit("")).alias("t"))
    whole = rows.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("ordinal", "loaded_at", "id", "t"))).alias("parts"))
    bind = lambda head: F.array_join(F.transform("parts", lambda c, i: F.concat(head(c, i).cast("string"), F.lit("\n\n"), c["t"])), "\n\n")
    forms = F.array(F.struct(F.lit("n").alias("k"), bind(lambda c, i: i + 1).alias("text")), F.struct(F.lit("c").alias("k"), bind(lambda c, i: F.concat(F.lit("Chapter "), c["ordinal"])).alias("text")))
    bound = whole.select("v", F.explode(forms).alias("f")).select(F.concat_ws(":", "v", "f.k").alias("doc_id"), "f.text", F.lit("txt").alias("file_kind"))
    return document_blocks(bound, "doc_id", "text", "file_kind")


def _blocks(spark, d):
    return document_blocks(table(spark, d, "documents"), "doc_id", "text", "file_kind")


@_c.query(f"WITH {_BLOCKS} SELECT doc_id, b::INTEGER AS block, line::INTEGER AS line, given AS kind, sha256(text) AS digest FROM blk")
def st_p1_blocks(spark, d):
    return _blocks(spark, d).select("doc_id", "block", "line", F.col("given").alias("kind"), F.sha2("text", 256).alias("digest"))


@_c.query(f"WITH {_BOUND_BLOCKS} SELECT doc_id, b::INTEGER AS block, line::INTEGER AS line FROM keyed WHERE numbered")
def w4_runs(spark, d):
    return _bound_blocks(spark, d).where("numbered").select("doc_id", "block", "line")


@_c.query(f"WITH {_BOUND_BLOCKS} SELECT doc_id, count(*) FILTER (numbered)::BIGINT AS numbered, count(*) FILTER (kind = 'heading')::BIGINT AS headings FROM typed GROUP BY doc_id")
def st_p2_numbered_headings(spark, d):
    return _bound_blocks(spark, d).groupBy("doc_id").agg(F.count_if("numbered").alias("numbered"), F.count_if(F.col("kind") == "heading").alias("headings"))


@_c.query(f"WITH {_BOUND_BLOCKS} SELECT doc_id, b::INTEGER AS block, line::INTEGER AS line, kind = 'heading' AS kept FROM typed WHERE given = 'heading' OR numbered")
def w3_last_of_duplicates(spark, d):
    return _bound_blocks(spark, d).where("given = 'heading' or numbered").select("doc_id", "block", "line", (F.col("kind") == "heading").alias("kept"))


@_c.query(f"WITH {_BOUND_BLOCKS} SELECT doc_id, count(*)::BIGINT AS demoted, min(line)::INTEGER AS first_line FROM typed WHERE (given = 'heading' OR numbered) AND kind = 'body' GROUP BY doc_id")
def st_p3_duplicate_headings(spark, d):
    return _bound_blocks(spark, d).where("(given = 'heading' or numbered) and kind = 'body'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("demoted"), F.min("line").alias("first_line"))


@_c.query(f"WITH {_BLOCKS} SELECT doc_id, count(*)::BIGINT AS chapters, count(title)::BIGINT AS titled, sum(length(text))::BIGINT AS n_chars FROM chapters_ SEMI JOIN ok USING (doc_id) GROUP BY doc_id")
def w2_chapter_split(spark, d):
    rows = _parts(spark, d).where("level = 'chapter'").groupBy("doc_id")
    return rows.agg(F.count(F.lit(1)).alias("chapters"), F.count("title").alias("titled"), F.sum(F.length("text")).alias("n_chars"))


@_c.query(f"WITH {_BLOCKS} SELECT doc_id, chapter::INTEGER AS chapter, title, length(text)::INTEGER AS n_chars, sha256(text) AS content_hash FROM chapters_ SEMI JOIN ok USING (doc_id)")
def st_p4_chapters(spark, d):
    return _parts(spark, d).where("level = 'chapter'").select("doc_id", "chapter", "title", F.length("text").alias("n_chars"), "content_hash")


@_c.query(f"WITH {_BLOCKS} SELECT doc_id, chapter::INTEGER AS chapter, scene::INTEGER AS scene, s0::BIGINT AS start_offset, s1::BIGINT AS end_offset FROM scenes_ SEMI JOIN ok USING (doc_id)")
def w5_scene_offsets(spark, d):
    return _parts(spark, d).where("level = 'scene'").select("doc_id", "chapter", "scene", "start_offset", "end_offset")


@_c.query(f"WITH {_BLOCKS} SELECT doc_id, chapter::INTEGER AS chapter, scene::INTEGER AS scene, s0::BIGINT AS start_offset, s1::BIGINT AS end_offset, sha256(text) AS content_hash FROM worded SEMI JOIN ok USING (doc_id)")
def st_p5_scenes(spark, d):
    return _parts(spark, d).where("level = 'scene'").select("doc_id", "chapter", "scene", "start_offset", "end_offset", "content_hash")


@_c.query(f"""WITH RECURSIVE {_BLOCKS}, {_chunks_sql()} SELECT doc_id, chapter::INTEGER AS chapter, scene::INTEGER AS scene, chunk::INTEGER AS chunk,
start_offset::BIGINT AS start_offset, end_offset::BIGINT AS end_offset, n_tokens::INTEGER AS n_tokens, sha256(text) AS content_hash FROM chunks_""")
def st_p6_chunks(spark, d):
    return _parts(spark, d).where("level = 'chunk'").select("doc_id", "chapter", "scene", "chunk", "start_offset", "end_offset", "n_tokens", "content_hash")


@_c.query(f"""WITH {_BLOCKS}, docs AS (SELECT doc_id, coalesce(lower(trim(file_kind)) = 'md', false) AS md FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, string_agg(line::VARCHAR, ',' ORDER BY b) FILTER (kind = 'heading') AS chapter_lines, count(*) FILTER (kind = 'body' AND (given = 'heading' OR numbered)) AS dropped, count(*) FILTER (kind = 'heading') AS heads FROM typed GROUP BY doc_id),
s AS (SELECT x.doc_id, string_agg(i.line::VARCHAR, ',' ORDER BY x.chapter, x.scene) AS scene_lines FROM scenes_ x JOIN scenes_ y ON y.doc_id = x.doc_id AND y.chapter = x.chapter AND y.scene = x.scene - 1
  JOIN inside i ON i.doc_id = x.doc_id AND i.chapter = x.chapter AND i.kind = 'break' AND i.island = y.island + 1 GROUP BY x.doc_id)
SELECT docs.doc_id, CASE WHEN o.doc_id IS NOT NULL THEN CASE WHEN md THEN 'markdown_heading' ELSE 'text_chapter_regex' END END AS detection,
CASE WHEN o.doc_id IS NOT NULL THEN concat_ws('; ', CASE WHEN dropped > 0 THEN 'Ignored ' || dropped || ' duplicate chapter markers before final occurrences' END, CASE WHEN heads = 0 THEN '{NO_CHAPTERS}' END) END AS warnings,
CASE WHEN o.doc_id IS NOT NULL THEN coalesce(chapter_lines, '') END AS chapter_lines, CASE WHEN o.doc_id IS NOT NULL THEN coalesce(scene_lines, '') END AS scene_lines,
CASE WHEN h.doc_id IS NULL THEN 'the manuscript has no readable text' WHEN o.doc_id IS NULL THEN 'the manuscript has no text to chunk' END AS error
FROM docs LEFT JOIN ok o USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)""")
def st_p7_metadata(spark, d):
    return _parts(spark, d).where("detection is not null or error is not null").selectExpr(
        "doc_id", "detection", "array_join(warnings, '; ') AS warnings", "array_join(chapter_lines, ',') AS chapter_lines", "array_join(scene_lines, ',') AS scene_lines", "error"
    )


@_c.query(f"""WITH RECURSIVE {_BLOCKS}, {_chunks_sql()} SELECT coalesce(nullif(lower(trim(source)), ''), 'none') AS version, count(*)::BIGINT AS n FROM chunks_ JOIN documents USING (doc_id) GROUP BY 1""")
def st_p8_published(spark, d):
    """Published by source, published again, and read back: the second run replaces the first."""
    root = Workspace(spark, "p8").root
    docs = table(spark, d, "documents").withColumn("version", F.coalesce(normal_word("source"), F.lit("none")))
    parts = structured(docs, "doc_id", "text", "file_kind").join(docs.select("doc_id", "version"), "doc_id").where("level <> 'error'")
    for _ in range(2):
        publish(parts, root, "version")
    return spark.read.parquet(f"{root}/chunks").groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@_c.query(f"""WITH RECURSIVE {_BLOCKS}, {_chunks_sql()}, c AS (SELECT doc_id, chapter, scene, count(*) AS k, sum(n_tokens) AS t, max(end_offset) - min(start_offset) AS v FROM chunks_ GROUP BY ALL),
n AS (SELECT sum(k)::BIGINT AS chunk_count, sum(t)::BIGINT AS chunk_tokens, sum(coalesce(v, 0))::BIGINT AS covered_chars, sum(s1 - s0)::BIGINT AS scene_chars, sum(len(regexp_extract_all(text, '[{_W}]+|[^{_W}{_S}]')))::BIGINT AS unique_tokens
  FROM worded SEMI JOIN ok USING (doc_id) LEFT JOIN c USING (doc_id, chapter, scene))
SELECT *, (SELECT count(DISTINCT doc_id) FROM headed SEMI JOIN ok USING (doc_id) WHERE heads = 0)::BIGINT AS fallback_documents, 0::BIGINT AS invariant_failures,
round(covered_chars / scene_chars, 6) AS coverage, round((chunk_tokens - unique_tokens) / unique_tokens, 6) AS duplicate_ratio FROM n""")
def a22_chunk_statistics(spark, d):
    return chunk_statistics(_parts(spark, d), "doc_id", Chunking().most)


_STUDY = {"apart": Chunking(overlap=0), "overlapping": Chunking()}


@_c.query(f"""WITH RECURSIVE {_BLOCKS}, {_chunks_sql('apart', _STUDY['apart'])}, {_chunks_sql('overlapping', _STUDY['overlapping'])},
probe AS (SELECT doc_id, chapter, scene, t.s0 + starts[stop - 39] AS a, t.s0 + ends[stop + 40] AS b FROM chunks_apart c JOIN tokapart t USING (doc_id, chapter, scene) WHERE stop < t.n AND stop BETWEEN 40 AND t.n - 40),
every AS (SELECT 'apart' AS rule, * FROM chunks_apart UNION ALL SELECT 'overlapping', * FROM chunks_overlapping),
met AS (SELECT r.rule, p.*, EXISTS (SELECT 1 FROM every e WHERE e.rule = r.rule AND e.doc_id = p.doc_id AND e.chapter = p.chapter AND e.scene = p.scene AND e.start_offset <= p.a AND e.end_offset >= p.b) AS covered
  FROM probe p, (SELECT unnest(['apart', 'overlapping']) AS rule) r),
c AS (SELECT rule, count(*)::BIGINT AS chunk_count, sum(n_tokens)::BIGINT AS chunk_tokens FROM every GROUP BY rule), m AS (SELECT rule, count(*)::BIGINT AS probes, count(*) FILTER (covered)::BIGINT AS covered FROM met GROUP BY rule),
o AS (SELECT count(DISTINCT doc_id)::BIGINT AS documents, count(DISTINCT doc_id) FILTER (heads = 0)::BIGINT AS fallback_documents FROM headed SEMI JOIN ok USING (doc_id)), t AS (SELECT sum(n)::BIGINT AS source_tokens FROM tokapart)
SELECT rule, documents, coalesce(probes, 0) AS probes, coalesce(covered, 0) AS covered, chunk_count, source_tokens, chunk_tokens, fallback_documents, round(coalesce(covered / probes, 1), 6) AS boundary_coverage,
round((chunk_tokens - source_tokens) / source_tokens, 6) AS duplicate_ratio FROM c LEFT JOIN m USING (rule), o, t""")
def v10_overlap_study(spark, d):
    return overlap_study(table(spark, d, "documents"), "doc_id", "text", "file_kind", _STUDY)


@_c.query("""SELECT id, manuscript_version_id, row_number() OVER (PARTITION BY manuscript_version_id ORDER BY ordinal, start_offset, id)::INTEGER AS dense_ordinal
FROM (SELECT DISTINCT id, manuscript_version_id, ordinal, start_offset FROM chunks)""")
def w7_dense_ordinal(spark, d):
    rows = table(spark, d, "chunks").select("id", "manuscript_version_id", "ordinal", "start_offset").distinct()
    found = numbered_within(rows, ["manuscript_version_id"], ["ordinal", "start_offset", "id"], name="n")
    return found.select("id", "manuscript_version_id", (F.col("n") + 1).cast("int").alias("dense_ordinal"))


_MENTION = "SELECT DISTINCT id, manuscript_version_id AS v, chapter_id, entity_type, start_offset FROM entity_mentions"


@_c.query(f"""SELECT id, coalesce(array_to_string(list(id) OVER (PARTITION BY v, entity_type ORDER BY chapter_id, start_offset, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS previous FROM ({_MENTION})""")
def w8_last3(spark, d):
    rows = table(spark, d, "entity_mentions").select("id", F.col("manuscript_version_id").alias("v"), "chapter_id", "entity_type", "start_offset").distinct()
    found = recent(rows, ["v", "entity_type"], ["chapter_id", "start_offset", "id"], 3, F.col("id"), "last")
    return found.select("id", F.array_join("last", ",").alias("previous"))


@_c.query(rf"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{X.TOKEN}')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, u.w::INTEGER AS token_window, least(800, n - u.w * 800)::INTEGER AS n_tokens FROM t, unnest(range(0, (n + 799) // 800)) AS u(w)""")
def w9_token_windows(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", X.token_count("text").alias("n")).where("n > 0")
    numbered = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 800).cast("int"))).alias("token_window"))
    return numbered.select("doc_id", "token_window", F.least(F.lit(800), F.col("n") - F.col("token_window") * 800).alias("n_tokens"))
