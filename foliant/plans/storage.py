"""S and D: files, sinks and model calls over the test tables.

Files and indexes are written to the shared folder and read back; models are stand-ins.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.operators import inference as N
from foliant.operators.models import Letters, embed_column
from foliant.plans.deliveries import CH
from foliant.plans.registry import Catalogue
from foliant.plans.resolution import _CA, _MN, candidates, chapters, mentions
from foliant.plans.structuring import _S, _W
from foliant.shared import Workspace
from foliant.sources import readers as R
from foliant.sources import sinks as W
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql


def _files(spark, d):
    """The documents as uploaded files."""
    docs = table(spark, d, "documents").where("text is not null")
    name = F.concat_ws(".", F.col("doc_id").cast("string"), "file_kind")
    content = F.encode("text", "UTF-8")
    return docs.select(name.alias("path"), name.alias("name"), F.lower("file_kind").alias("kind"), F.length(content).cast("long").alias("length"), content.alias("content"))


@_c.query(r"SELECT concat_ws('.', doc_id::VARCHAR, file_kind) AS path, sha256(regexp_replace(text, '^\x{FEFF}', '')) AS digest FROM documents WHERE text IS NOT NULL")
def s1_decoded(spark, d):
    rows = R.decoded(_files(spark, d)).where(F.col("error").isNull())
    return rows.select("path", F.sha2("text", 256).alias("digest"))


_NO_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]"


def _as_docx(batches):
    """Every text as a word processor file of one paragraph a line; lines that begin with 'Chapter' are headings by style."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    for batch in batches:
        files = []
        for text in batch.column(1).to_pylist():
            lines = [re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", x) for x in re.split("\r\n?|\n", text)]
            style = lambda x: '<w:pPr><w:pStyle w:val="H"/></w:pPr>' if x.startswith("Chapter") else ""
            body = "".join(f'<w:p>{style(x)}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>' for x in lines)
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("[Content_Types].xml", "<x/>")
                z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>".encode("utf-8", "replace"))
                z.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>')
            files.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["docx"] * len(files)), pa.array(files, pa.binary())], names=["path", "kind", "content"])


@_c.query(rf"""WITH l AS (SELECT doc_id, u.i, regexp_replace(regexp_replace(ls[u.i], '{_NO_XML}', '', 'g'), '^[{_S}]+|[{_S}]+$', '', 'g') AS t, starts_with(regexp_replace(ls[u.i], '{_NO_XML}', '', 'g'), 'Chapter') AS head
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i))
SELECT doc_id::VARCHAR AS path, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS position, CASE WHEN regexp_full_match(t, '\*[{_S}]*\*[{_S}]*\*|---') THEN 'break' WHEN head THEN 'heading' ELSE 'body' END AS kind, sha256(t) AS digest FROM l WHERE t <> ''""")
def s2_docx_blocks(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string"), "text")
    files = docs.mapInArrow(_as_docx, "path string, kind string, content binary")
    return R.docx_rows(files).where("error is null").select("path", "position", "kind", F.sha2("text", 256).alias("digest"))


@_c.query("SELECT concat_ws('.', doc_id::VARCHAR, file_kind) AS name, sha256(text) AS content_hash, CASE WHEN file_kind IS NULL THEN 'unsupported_type' WHEN text = '' THEN 'empty' WHEN strlen(text) > 20000 THEN 'too_large' END AS refused FROM documents WHERE text IS NOT NULL")
def s3_inspected(spark, d):
    return R.inspected(_files(spark, d), 20_000).select("name", "content_hash", "refused")


@_c.query("SELECT 'objects/' || project_id || '/' || version_number || '/' || original_filename AS path FROM manuscript_versions")
def s4_object_paths(spark, d):
    return table(spark, d, "manuscript_versions").select(W.object_path("objects/", F.col("project_id"), F.col("version_number"), F.col("original_filename")).alias("path"))


def _after_header(spark, d):
    """All documents' rows, written behind a header record and read back."""
    root = Workspace(spark, "s6").root
    rows = table(spark, d, "documents").select("doc_id", "title")
    lines = rows.select(F.to_json(F.struct(F.lit("row").alias("type"), "doc_id", "title")).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit('{"type": "metadata", "version": 1}').alias("value"))).write.text(f"{root}/shard")
    return R.read_jsonl_with_header(spark, f"{root}/shard", rows.schema)[1]


@_c.query("SELECT doc_id, title FROM documents")
def s6_rows_after_header(spark, d):
    return _after_header(spark, d)


@_c.query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def s7_written_rows(spark, d):
    root = Workspace(spark, "s7").root
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):  # the second write replaces the first
        W.write_jsonl(rows, f"{root}/rows")
    return R.read_jsonl(spark, f"{root}/rows", rows.schema)


def _index_rows(spark, d, model):
    e = table(spark, d, "embeddings")
    none = F.lit(None).cast("string")
    return e.select(F.lit("p").alias("project_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("version_id"), F.col("vec_id").cast("string").alias("chunk_id"), none.alias("chapter_id"), none.alias("scene_id"),
                    none.alias("text"), F.lit(0).cast("long").alias("start_offset"), F.lit(1).cast("long").alias("end_offset"), F.lit(model).alias("embedding_version"), "embedding")


@_c.query("SELECT 'v' || label AS version_id, count(*)::BIGINT AS n FROM embeddings GROUP BY 1")
def s8_index_counts(spark, d):
    path = f"{Workspace(spark, 's8').root}/index"
    W.create_index(spark, path)
    W.replace_in_index(_index_rows(spark, d, "m1"), path, "m1", 64)
    W.create_index(spark, path)
    return W.read_index(spark, path).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))


@_c.query("SELECT vec_id::VARCHAR AS chunk_id, CASE WHEN label < 3 THEN 'm2' ELSE 'm1' END AS embedding_version FROM embeddings WHERE label >= 3 OR vec_id % 2 = 0")
def s9_replaced_scope(spark, d):
    path = f"{Workspace(spark, 's9').root}/index"
    W.create_index(spark, path)
    W.replace_in_index(_index_rows(spark, d, "m1"), path, "m1", 64)
    some = _index_rows(spark, d, "m2").where("version_id in ('v0', 'v1', 'v2') and cast(chunk_id as long) % 2 = 0")
    W.replace_in_index(some, path, "m2", 64)
    return W.read_index(spark, path).select("chunk_id", "embedding_version")


@_c.query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def s16_kept_result(spark, d):
    root = Workspace(spark, "s16").root
    rows = table(spark, d, "events").select("event_id", "event_type")
    key = W.fingerprint(rows, "event_id", "event_type")
    build = lambda: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    W.kept_result(spark, root, key, build)
    return W.kept_result(spark, root, key, build)


def _chunks(spark, d):
    return table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), "text").distinct()


_LETTERS = "[" + ", ".join(f"length(text) - length(replace(text, '{chr(97 + i)}', ''))" for i in range(26)) + "]"


@_c.query(f"""SELECT id AS chunk_id, 26::INTEGER AS dimensions, round((CASE WHEN n > 0 THEN x[1] / n ELSE 0 END)::FLOAT::DOUBLE, 5) AS first, round((CASE WHEN n > 0 THEN x[5] / n ELSE 0 END)::FLOAT::DOUBLE, 5) AS fifth
FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS n FROM (SELECT DISTINCT id, {_LETTERS} AS x FROM chunks WHERE text IS NOT NULL))""")
def d1_embedded(spark, d):
    vectors = _chunks(spark, d).select("chunk_id", embed_column(F.col("text"), Letters).alias("v"))
    at = lambda i: F.round(F.col("v")[i].cast("double"), 5)
    return vectors.select("chunk_id", F.size("v").alias("dimensions"), at(0).alias("first"), at(4).alias("fifth"))


#: Capital words that do not begin a sentence, with where they stand.
_CAPITALS = r"""tile AS (SELECT chunk_id, text, u.i, t[u.i] AS t FROM (SELECT DISTINCT id AS chunk_id, text, regexp_extract_all(text, '[^\p{L}\p{Nl}\p{No}]*[\p{L}\p{Nl}\p{No}]+') AS t FROM chunks WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i)),
word AS (SELECT chunk_id, text, regexp_extract(t, '[\p{L}\p{Nl}\p{No}]+$') AS w, sum(length(t)) OVER (PARTITION BY chunk_id, text ORDER BY i) AS b FROM tile),
capital AS (SELECT chunk_id, text, w, (b - length(w))::INTEGER AS a, b::INTEGER AS b FROM word WHERE regexp_matches(w, '^\p{Lu}') AND b - length(w) > 1 AND substr(text, (b - length(w))::INTEGER, 1) = ' '
  AND substr(text, (b - length(w))::INTEGER - 1, 1) NOT IN ('.', '!', '?', '”', '"', '’', chr(39)))"""


@_c.query(f"""WITH {_CAPITALS}, cut AS (SELECT DISTINCT chunk_id, w, string_split(text, w) AS parts FROM capital)
SELECT DISTINCT chunk_id, w AS surface_text, 'character' AS entity_type, a AS start_offset, (a + length(w))::INTEGER AS end_offset, true AS found FROM (
  SELECT chunk_id, w, (list_sum(list_transform(parts[1:u.i], lambda p: length(p))) + (u.i - 1) * length(w))::INTEGER AS a FROM cut, unnest(range(1, len(parts))) AS u(i))""")
def d3_extracted(spark, d):
    return N.extracted_mentions(_chunks(spark, d), N.CapitalWords)


@_c.query(f"WITH {_CAPITALS} SELECT DISTINCT chunk_id, w AS surface_text, 'character' AS entity_type, a AS start_offset, b AS end_offset, true AS valid FROM capital")
def d4_model_spans(spark, d):
    return N.model_spans(_chunks(spark, d), N.CapitalWords)


@_c.query(f"""WITH {_MN}, {_CA}, m AS (SELECT id, max(surface_text) AS name FROM mn GROUP BY id)
SELECT DISTINCT ca.id, CASE WHEN lower(a.name) = lower(b.name) THEN 'merge' ELSE 'needs_review' END AS decision FROM ca JOIN m a ON a.id = ca.l JOIN m b ON b.id = ca.r""")
def d5_decided_pairs(spark, d):
    m = mentions(spark, d).groupBy("id").agg(F.max("surface_text").alias("name"))
    pairs = candidates(spark, d).join(m.toDF("l", "a"), "l").join(m.toDF("r", "b"), "r").select("id", F.col("l").alias("left_evidence"), F.col("r").alias("right_evidence"), F.concat_ws("\n", "a", "b", "l", "r").alias("prompt")).distinct()
    return N.decided_pairs(pairs, N.EqualNames).select("id", "decision")


@_c.query(rf"""WITH {CH}, tile AS (SELECT chapter_id, u.i, t[u.i] AS t FROM (SELECT chapter_id, regexp_extract_all(chapter_text, '[{_S}]*(?:[{_W}]+|[^{_W}{_S}])') AS t FROM ch WHERE chapter_text IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i)),
tok AS (SELECT chapter_id, i - 1 AS i, (i - 1) // 800 AS w, regexp_replace(t, '^[{_S}]+', '') AS t, sum(length(t)) OVER (PARTITION BY chapter_id ORDER BY i) AS b FROM tile),
many AS (SELECT *, min(i) OVER (PARTITION BY chapter_id, w, t) AS first FROM tok WHERE regexp_matches(t, '^\p{{Lu}}') QUALIFY count(*) OVER (PARTITION BY chapter_id, w, t) > 1)
SELECT chapter_id, (b - length(t))::INTEGER || '-' || b::INTEGER AS span, (b - length(t))::INTEGER AS start_offset, b::INTEGER AS end_offset, w || ':' || (dense_rank() OVER (PARTITION BY chapter_id, w ORDER BY first) - 1) AS cluster FROM many""")
def d6_coreference(spark, d):
    return N.coreference_memberships(chapters(spark, d), N.CapitalWords)
