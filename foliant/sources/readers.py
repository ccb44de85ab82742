"""Readers: text and word processor files, JSON lines, and tables picked by key."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators.structure import SCENE_BREAK, Block

UPLOAD_LIMIT = 50 * 1024 * 1024
ARCHIVE_ENTRIES = 10_000
ARCHIVE_BYTES = 200 * 1024 * 1024
# Accepted file kinds and their content types.
KINDS = {
    "txt": ("text/plain",),
    "md": ("text/markdown", "text/plain"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, kind, length, content)`` of all files below a folder.

    Spark's file source leaves out files without bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), "length", "content")


def inspected(files: DataFrame, limit: int = UPLOAD_LIMIT, content_type: str | None = None) -> DataFrame:
    """Files with ``content_hash`` and ``refused``: the first reason against a file, null if there is none."""
    refused = F.when(~F.coalesce("kind", F.lit("")).isin(*KINDS), "unsupported_type")
    if content_type:
        allowed = F.lit(False)
        for kind, types in KINDS.items():
            allowed = allowed | ((F.col("kind") == kind) & F.col(content_type).isin(*types))
        refused = refused.when(~F.coalesce(allowed, F.lit(False)), "unsupported_content_type")
    refused = refused.when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large")
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("refused", refused)


def decoded(files: DataFrame) -> DataFrame:
    """``(path, kind, text, error)``: strict UTF-8 without a byte order mark; other bytes give an error and no text."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", "")
    return files.select("path", "kind", F.when(ok, text).alias("text"), F.when(~ok, "not_utf8").alias("error"))


def docx_blocks(data: bytes, most_bytes: int = ARCHIVE_BYTES) -> list[Block]:
    """Blocks of a word processor file; archives with too many entries, too much content or missing parts are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = z.infolist()
            names = {e.filename for e in entries}
            if len(entries) > ARCHIVE_ENTRIES or sum(e.file_size for e in entries) > most_bytes:
                raise ValueError("the archive is larger than allowed")
            if not {"[Content_Types].xml", "word/document.xml"} <= names:
                raise ValueError("the archive is no document")
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            styles = {}
            if "word/styles.xml" in names:
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    label = s.find(f"{_W}name")
                    styles[s.get(f"{_W}styleId")] = label.get(f"{_W}val") if label is not None else ""
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("the archive cannot be read") from e
    blocks: list[Block] = []
    for item in body if body is not None else ():
        if item.tag == f"{_W}p":
            text = _text(item).strip()
            properties = item.find(f"{_W}pPr")
            style = properties.find(f"{_W}pStyle") if properties is not None else None
            name = styles.get(style.get(f"{_W}val"), "") if style is not None else ""
            ends = (properties is not None and properties.find(f"{_W}sectPr") is not None) or any(b.get(f"{_W}type") == "page" for b in item.iter(f"{_W}br"))
            if text:
                kind = "break" if SCENE_BREAK.fullmatch(text) else "heading" if name.casefold().startswith("heading ") else "body"
                blocks.append(Block(text, kind, None, ends))
            elif ends and blocks:
                blocks[-1] = blocks[-1]._replace(page_break=True)
        elif item.tag == f"{_W}tbl":
            rows = ["\t".join("\n".join(_text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) for row in item.findall(f"{_W}tr")]
            text = "\n".join(r for r in rows if r.strip())
            if text:
                blocks.append(Block(text))
    return blocks


def _text(paragraph: ElementTree.Element) -> str:
    out = []
    for node in paragraph.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr") and node.get(f"{_W}type") != "page":
            out.append("\n")
    return "".join(out)


def docx_rows(files: DataFrame) -> DataFrame:
    """``(path, position, kind, text, page_break, error)``: the blocks of word processor files, or one error row per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, b.kind, b.text, b.page_break, None) for i, b in enumerate(docx_blocks(bytes(content)))]
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "position", "kind", "text", "page_break", "error"]).astype({"position": "Int32", "page_break": "boolean"})

    return files.where("kind = 'docx'").select("path", "content").mapInPandas(run, "path string, position int, kind string, text string, page_break boolean, error string")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a stated schema; a line that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_with_header(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The one header line (``type`` = metadata) as raw JSON, and the other lines under ``schema``."""
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    header = lines.where(kind == "metadata")
    if header.count() != 1:
        raise ValueError("exactly one metadata line is needed")
    rows = lines.where(F.coalesce(kind, F.lit("")) != "metadata").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return header, rows
