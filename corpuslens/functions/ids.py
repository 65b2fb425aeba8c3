"""Content-derived identifiers, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name spaces of chunk and section ids.
CHUNK_SPACE = "8e6e7d2c-3a3f-4b4d-9b8d-3f4d9c0e0001"
SECTION_SPACE = "8e6e7d2c-3a3f-4b4d-9b8d-3f4d9c0e0002"


def uuid5(space: str, name: Column) -> Column:
    """Version 5 UUID of a name; null if the name is null."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(spec_id: Column, clause: Column, content: Column) -> Column:
    """Id of a chunk: equal content in a clause of a document gives an equal id."""
    return uuid5(CHUNK_SPACE, F.concat(spec_id, F.lit("|"), clause, F.lit("|"), F.left(F.sha2(content, 256), F.lit(16))))


def parent_section_id(spec_id: Column, clause: Column, title: Column) -> Column:
    return uuid5(SECTION_SPACE, F.concat(spec_id, F.lit("|"), clause, F.lit("|"), title))
