import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from foliant import refs
from foliant.functions import text as X
from tests.helpers import frame


def value(spark, column, **given):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in given.items()) or "x int"
    row = tuple(given.values()) or (1,)
    return frame(spark, schema, [row]).select(column.alias("v")).first().v


def test_tokens(spark):
    assert value(spark, X.tokens("t"), t="Don't stop—naïve_x 3½!") == ["Don", "'", "t", "stop", "—", "naïve_x", "3½", "!"]
    assert value(spark, X.token_count("t"), t=None) == 0
    assert value(spark, X.token_count("t"), t=" 　\x85\n") == 0


@pytest.mark.parametrize("line,kind", [
    ("Chapter 4", "chapter"), ("CHAPTER iv: The end", "chapter"), ("Prologue", "chapter"), ("chapter", "body"), ("* * *", "break"), ("---", "break"), ("## Title ##", "markdown"),
    ("12", "number"), ("iv. A title", "roman"), ("", "blank"), ("Just text", "body"),
])
def test_line_kinds(spark, line, kind):
    assert value(spark, X.line_kind("t"), t=line) == kind


@pytest.mark.parametrize("numeral,n", [("IV", 4), ("xiv", 14), ("MCMXCIV", 1994), ("IIX", 8), ("IC", 99)])
def test_roman(spark, numeral, n):
    assert value(spark, X.roman_value("t"), t=numeral) == n


def test_chapter_keys(spark):
    keys = {h: value(spark, X.chapter_key("t"), t=h) for h in ("Chapter iv - x", "chapter 007", "Epilogue.", "007", "ix. Title", "Chapters 4", "text")}
    assert keys == {"Chapter iv - x": "chapter:IV", "chapter 007": "chapter:007", "Epilogue.": "epilogue", "007": "number:7", "ix. Title": "roman:9", "Chapters 4": None, "text": None}


def test_digests(spark):
    space = uuid.uuid4()
    assert value(spark, X.uuid5("s", "n"), s=str(space), n="né") == str(uuid.uuid5(space, "né"))
    assert value(spark, X.sha256("t"), t="é") == hashlib.sha256("é".encode()).hexdigest()
    df = frame(spark, "n string, s string", [(f"name {i}", str(uuid.UUID(int=i))) for i in range(200)])
    assert df.where(X.uuid5("s", "n") != X.uuid5_reference("n", "s")).count() == 0


def test_names(spark):
    assert value(spark, X.normalized_name("t"), t=" Mr.  O'Neil ") == "mr o neil"
    assert value(spark, X.name_words("t"), t="Mrs. Anna Anna Bëll Ծառ") == ["anna", "bëll", "ծառ"]
    df = frame(spark, "t string", [("Straße ﬁn",), (None,), ("",)])
    assert [r.v for r in df.select(X.normalized_name("t").alias("v")).collect()] == ["strasse fin", None, ""]


def test_spans(spark):
    text = "a😀bcd"
    assert value(spark, X.span_matches("t", F.lit(1), F.lit(3), F.lit("😀b")), t=text) is True
    assert value(spark, X.span_matches("t", F.lit(1), F.lit(9), F.lit("😀bcd")), t=text) is False
    assert value(spark, X.span_matches("t", F.lit(None).cast("int"), F.lit(3), F.lit("x")), t=text) is False
    assert value(spark, X.excerpt("t", F.lit(2), F.lit(3), 1), t=text) == "😀bc"
    assert value(spark, X.excerpt("t", F.lit(0), F.lit(1), 900), t=text) == text


def test_small_functions(spark):
    assert value(spark, X.preview("t", 5), t="  a \n\t b  c d") == "a b c"
    assert value(spark, X.without_prefix("t", "in "), t="in May") == "May"
    assert [value(spark, X.is_predicate("t"), t=t) for t in ("eye_color", "has_eyes", "Eye", None)] == [True, False, False, False]
    assert value(spark, X.occurrences("t", F.lit("aa")), t="aaaa b aa") == 3 and value(spark, X.occurrences("t", F.lit("")), t="x") == 0
    assert value(spark, X.redacted("t"), t="abc") == "<redacted:3 chars>"
    assert value(spark, X.all_finite("v"), v=[1.0, float("nan")]) is False and value(spark, X.all_finite("v"), v=[1.0]) is True
    assert value(spark, X.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678)
    assert value(spark, X.cosine("a", "b"), a=[0.0], b=[1.0]) is None
    assert value(spark, X.canonical_json("b", "a"), a="x", b=1) == '{"a":"x","b":1}'


def test_references(spark):
    plain = "02f4bfea-d3fa-41fd-bb3a-cab783a55425"
    for said in (plain, f" {plain.upper()}", f"{{{plain}}}", f"urn:uuid:{plain}", plain.replace("-", ""), f"{plain} "):
        assert value(spark, refs.normal_ref("t"), t=said) == plain
    assert value(spark, refs.normal_ref("t"), t=" {} ") is None and value(spark, refs.normal_ref("t"), t="Own-Id ") == "own-id"
    assert value(spark, refs.normal_digest("t"), t=" SHA256:ABC") == "abc" and value(spark, refs.normal_digest("t"), t=" ") is None
    assert value(spark, refs.normal_word("t"), t=" Merge\t") == "merge"
