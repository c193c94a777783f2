"""Random draws that depend only on keys, so a lost task redraws the same numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def hash_number(*parts) -> Column:
    """A 32-bit number from the md5 of the parts joined with '|'."""
    joined = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def hash_index(size: Column | int, *parts) -> Column:
    """An index in [0, size)."""
    limit = size if isinstance(size, Column) else F.lit(size)
    return F.pmod(hash_number(*parts), limit.cast("long"))


def hash_order(*parts) -> Column:
    """A shuffling key."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))
