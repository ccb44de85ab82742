"""Identifiers and digests as they are written in dirty references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_NORMAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def normal_ref(c) -> Column:
    """A reference in the notation of ids: no blanks or braces, lower case; empty means null.

    UUIDs may also come as ``urn:uuid:…`` or without dashes; both become the dashed form.  What is in it already is only
    looked at once.
    """
    given = _col(c)
    bare = F.regexp_replace(F.lower(F.regexp_replace(given, r"[\s\p{Z}{}()\"']+", "")), "^urn:uuid:", "")
    plain = F.regexp_replace(bare, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(given.rlike(_NORMAL), given).when(F.length(plain) > 0, plain)


def normal_digest(c) -> Column:
    """A SHA-256 in lower-case hex without prefix and blanks; empty means null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(_col(c), r"[\s\p{Z}]+", "")), "^(sha-?256:|0x)", "")
    return F.when(F.length(bare) > 0, bare)


def normal_word(c) -> Column:
    """An enumeration value without surrounding blanks, in lower case; empty means null."""
    bare = F.lower(F.regexp_replace(_col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(F.length(bare) > 0, bare)
