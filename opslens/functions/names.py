"""Identifiers, patterns and statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens.functions.expr import _col

__all__ = [
    "contains_ci",
    "escape_like",
    "extract_statement",
    "like_ci",
    "name_part",
    "quote_literal",
    "quotename",
    "safe_name",
    "swapped_guid_hex",
]

# Characters a file name must not hold.
ILLEGAL_FILE_CHARS = '\\/:*?"<>|'

# A GUID, and the byte order in which an agent program name prints it.
GUID = "^(..)(..)(..)(..)-(..)(..)-(..)(..)-(....)-(.{12})$"
GUID_SWAPPED = "$4$3$2$1$6$5$8$7$9$10"


def quotename(c: Column | str) -> Column:
    return F.concat(F.lit("["), F.replace(_col(c), F.lit("]"), F.lit("]]")), F.lit("]"))


def quote_literal(c: Column | str) -> Column:
    return F.concat(F.lit("N'"), F.replace(_col(c), F.lit("'"), F.lit("''")), F.lit("'"))


def name_part(c: Column | str, n: int) -> Column:
    """n-th dot-separated part counted from the right, NULL when absent."""
    return F.try_element_at(F.split(_col(c), r"\."), F.lit(-n))


def safe_name(c: Column | str) -> Column:
    return F.rtrim(F.translate(_col(c), ILLEGAL_FILE_CHARS, ""))


def contains_ci(c: Column | str, needle: str) -> Column:
    """The text occurs in the column, ignoring case; ``%`` and ``_`` in it are wildcards."""
    if "%" in needle or "_" in needle:
        return like_ci(c, f"%{needle}%")
    return F.lower(_col(c)).contains(needle.lower())


def like_ci(c: Column | str, pattern: str) -> Column:
    return F.lower(_col(c)).like(pattern.lower())


def escape_like(pattern: str) -> str:
    """Keep ``%`` as the only wildcard."""
    return pattern.replace("\\", "\\\\").replace("_", "\\_")


def extract_statement(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Statement inside a batch, from byte offsets of two-byte characters; end -1 is open."""
    text, start, end = _col(text), _col(start), _col(end)
    stop = F.when(end == -1, F.length(F.rtrim(text)) * 2).otherwise(end)
    first = F.floor(start / 2) + 1
    size = F.greatest(F.floor((stop - start) / 2) + 1, F.lit(0))
    return F.substring(text, first.cast("int"), size.cast("int"))


def swapped_guid_hex(guid: Column | str) -> Column:
    """32 hex digits of a GUID in the byte order agent program names use; never NULL."""
    swapped = F.regexp_replace(F.upper(_col(guid)), GUID, GUID_SWAPPED)
    return F.coalesce(swapped, F.lit("?"))
