import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.structure import parse_blocks
from foliant.plans import storage
from foliant.sources import readers as R
from foliant.sources import sinks as W
from foliant.streaming import incremental as I
from tests.helpers import frame, rows

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, styles="", extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def p(text, style="", tail=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r>{tail}</w:p>"


PAGE = '<w:r><w:br w:type="page"/></w:r>'
STYLES = '<w:style w:styleId="H"><w:name w:val="Heading 1"/></w:style>'


def test_docx_blocks():
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("One", "H") + p("text") + p("* * *") + p("more", tail=PAGE) + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}</w:tr></w:tbl>" + p("") + p("Two", "H") + p("end") + f"<w:p>{PAGE}</w:p>"
    blocks = R.docx_blocks(docx(body, STYLES))
    assert [(b.text, b.kind, b.page_break) for b in blocks] == [
        ("One", "heading", False), ("text", "body", False), ("* * *", "break", False), ("more", "body", True), ("a\tb", "body", False), ("Two", "heading", False), ("end", "body", True),
    ]
    m = parse_blocks(blocks)
    assert m.detection == "docx_heading_style" and [c.title for c in m.chapters] == ["One", "Two"] and len(m.chapters[0].scenes) == 3
    plain = parse_blocks(R.docx_blocks(docx(p("Chapter 1") + p("text"))))
    assert plain.detection == "docx_chapter_regex" and plain.chapters[0].title == "Chapter 1"


def test_docx_guards():
    with pytest.raises(ValueError):
        R.docx_blocks(b"no archive")
    with pytest.raises(ValueError):
        R.docx_blocks(docx("", extra=[("big", b"0" * 5000)]), most_bytes=1000)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.xml", "<x/>")
    with pytest.raises(ValueError):
        R.docx_blocks(out.getvalue())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Chapter 1\n\nText é".encode())
    (tmp_path / "b.MD").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(docx(p("Hello")))
    (tmp_path / "f.docx").write_bytes(b"junk")
    files = R.read_files(spark, str(tmp_path))
    state = {r.name: r.refused for r in R.inspected(files, 5000).collect()}
    assert state == {"a.txt": None, "c.txt": None, "d.exe": "unsupported_type", "e.docx": None, "f.docx": None}
    empty = frame(spark, "kind string, length long, content binary, mime string", [("md", 0, b"", "text/markdown"), ("md", 1, b"x", "image/png"), (None, 1, b"x", None)])
    assert [r.refused for r in R.inspected(empty, 5, "mime").collect()] == ["empty", "unsupported_content_type", "unsupported_type"]
    assert R.inspected(files, 1).where("refused = 'too_large'").count() == 4
    texts = {r.path.split("/")[-1]: (r.text, r.error) for r in R.decoded(files.where("kind = 'txt'")).collect()}
    assert texts == {"a.txt": ("Chapter 1\n\nText é", None), "c.txt": (None, "not_utf8")}
    found = {r.path.split("/")[-1]: (r.text, r.error) for r in R.docx_rows(files).collect()}
    assert found["e.docx"] == ("Hello", None) and found["f.docx"][1]


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("type", T.StringType())])
    (tmp_path / "x").write_text('{"type": "metadata", "n": 2}\n{"type": "query", "a": 1}\n{"type": "query", "a": 2}\n')
    head, body = R.read_jsonl_with_header(spark, str(tmp_path / "x"), schema)
    assert rows(body) == [(1, "query"), (2, "query")]
    (tmp_path / "y").write_text('{"a": 1}\n{"a": "no number"}\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "y"), schema).collect()
    with pytest.raises(ValueError):
        R.read_jsonl_with_header(spark, str(tmp_path / "y"), schema)
    W.write_jsonl(body, str(tmp_path / "z"))
    assert rows(R.read_jsonl(spark, str(tmp_path / "z"), schema)) == rows(body)


def chunk(project, version, chunk_id, vector, model="m1"):
    return (project, version, chunk_id, None, None, "text", 0, 4, model, vector)


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert W.create_index(spark, path) and not W.create_index(spark, path)
    table = lambda *r: spark.createDataFrame(list(r), T.StructType([T.StructField(f.name, f.dataType) for f in W.INDEX_SCHEMA]))
    W.replace_in_index(table(chunk("p", "v", "1", [1.0, 0.0]), chunk("p", "w", "2", [1.0, 0.0])), path, "m1", 2)
    W.replace_in_index(table(chunk("p", "v", "3", [0.0, 1.0])), path, "m1", 2)
    assert rows(W.read_index(spark, path).select("version_id", "chunk_id")) == [("v", "3"), ("w", "2")]
    for bad in (chunk("p", "v", "4", [1.0]), chunk("p", "v", "4", [1.0, float("inf")]), chunk("p", "v", "4", [1.0, 1.0], "m0"), chunk("p", "v", "4", None), chunk(None, "v", "4", [1.0, 0.0])):
        with pytest.raises(ValueError):
            W.replace_in_index(table(bad), path, "m1", 2)
    with pytest.raises(ValueError):
        W.replace_in_index(table(chunk("p", "v", "4", [1.0, 0.0])).withColumn("extra", F.lit(1)), path, "m1", 2)
    assert W.read_index(spark, path).count() == 2


def test_fingerprints_and_kept_results(spark, tmp_path):
    a = frame(spark, "x int, y string", [(1, "a"), (2, None)])
    assert W.fingerprint(a, "x", "y") == W.fingerprint(a.orderBy(F.desc("x")), "y", "x") != W.fingerprint(a.limit(1), "x", "y")
    assert W.fingerprint(a.where("false"), "x") == W.fingerprint(a.where("x > 5"), "x")
    calls = []

    def build():
        calls.append(1)
        return a

    for _ in range(2):
        assert W.kept_result(spark, str(tmp_path), "k", build).count() == 2
    assert len(calls) == 1
    path = frame(spark, "p string, n string", [("p", "x\\y/name.txt")]).select(W.object_path("root/", F.col("p"), F.lit(3), F.col("n"))).first()[0]
    assert path == "root/p/3/name.txt"
    assert W.delete_object(spark, str(tmp_path / "k")) and not W.exists(spark, str(tmp_path / "k"))


def test_ingestion_reads_each_file_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    df = frame(spark, "k int, v string", [(1, "a"), (2, "b"), (2, "b")])
    df.coalesce(1).write.parquet(source)
    I.ingest(spark, source, df.schema, target, progress, ["k"], 1)
    frame(spark, "k int, v string", [(2, "late"), (3, "c")]).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        I.ingest(spark, source, df.schema, target, progress, ["k"], 1)
    assert rows(spark.read.parquet(target).select("k", "v")) == [(1, "a"), (2, "b"), (3, "c")]


def test_fences(spark):
    results = frame(spark, "owner string, version int", [("a", 1), ("a", 3), ("b", 2), ("c", 1)])
    published = frame(spark, "owner string, version int", [("a", 2), ("b", 2)])
    assert rows(I.accepted(results, published, "owner", "version")) == [("a", 3), ("c", 1)]
    attempts = frame(spark, "job_id int, attempt int, x string", [(1, 1, "old"), (1, 2, "new")])
    assert rows(I.of_current_attempt(attempts, frame(spark, "job_id int, attempt int", [(1, 2)]))) == [(1, 2, "new")]
    done = []
    assert I.publish_if_unchanged(lambda: done.append(1), "s", lambda: "s") and not I.publish_if_unchanged(lambda: done.append(2), "s", lambda: "t")
    assert done == [1] and I.stop_all(spark, "none") == 0


def test_all_documents_are_read_after_the_header(spark, tmp_path):
    docs = frame(spark, "doc_id long, title string", [(i, None if i == 3 else f"t{i}") for i in range(5)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(storage.queries()["s6_rows_after_header"](spark, str(tmp_path)).orderBy("doc_id")) == rows(docs.orderBy("doc_id"))


def test_documents_with_several_marks_are_decoded(spark, tmp_path):
    given = [(i, "txt", "\ufeff" * i + "a") for i in range(5)]
    frame(spark, "doc_id long, file_kind string, text string", given).write.parquet(str(tmp_path / "documents.parquet"))
    expected = sorted((f"{i}.txt", hashlib.sha256(t.removeprefix("\ufeff").encode()).hexdigest()) for i, _, t in given)
    assert sorted(map(tuple, storage.queries()["s1_decoded"](spark, str(tmp_path)).collect())) == expected
