"""Checks of zip archives from their directory alone: nothing is inflated.

A member that inflates to more than it claims isn't seen here; as members may not
share bytes, an archive never inflates to more than ``MAX_RATIO`` times its own size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.sources.files import suffix

#: Suffixes that are archives, those that need a member, and the member.
ARCHIVES = (".docx", ".pptx", ".xlsx", ".epub")
OFFICE = (".docx", ".pptx", ".xlsx")
REQUIRED = "[Content_Types].xml"
MAX_INFLATED = 500 * 1024 * 1024
#: Deflate can't give more bytes than so many for each byte that it takes.
MAX_RATIO = 1032
#: Fixed values of the format: marks of the end record, its 64-bit form and locator, a directory entry and a member; the longest comment.
END, END64, LOCATOR, ENTRY, MEMBER = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX_COMMENT = 0xFFFF
FULL, FULL16 = 0xFFFFFFFF, 0xFFFF


class Damaged(ValueError):
    """The bytes aren't a whole archive."""


class Member(NamedTuple):
    name: str
    packed: int
    inflated: int
    method: int
    locked: bool
    offset: int


def _directory(content: bytes) -> tuple[int, int, int, int]:
    """Where the directory lies, its length and count of entries, and how many bytes lie before the archive."""
    at = content.rfind(END, max(0, len(content) - MAX_COMMENT - 22))
    while at >= 0 and (at + 22 > len(content) or at + 22 + struct.unpack_from("<H", content, at + 20)[0] != len(content)):
        at = content.rfind(END, max(0, len(content) - MAX_COMMENT - 22), at)
    if at < 0:
        raise Damaged("no end record")
    disk, first, here, count, length, offset, _ = struct.unpack_from("<4H2LH", content, at + 4)
    stop = at
    if FULL16 in (count, here) or FULL in (length, offset):
        if at >= 20 and content[at - 20 : at - 16] == LOCATOR:
            place = struct.unpack_from("<Q", content, at - 12)[0]
            # The 64-bit record stands just before its locator, also where bytes were put before the archive.
            stop = at - 20 - 56 if content[at - 76 : at - 72] == END64 and at >= 76 else place
            if stop + 56 > at or content[stop : stop + 4] != END64:
                raise Damaged("no 64-bit end record")
            disk, first, here, count, length, offset = struct.unpack_from("<2L4Q", content, stop + 16)
    if disk or first or here != count:
        raise Damaged("in several parts")
    before = stop - length - offset
    if before < 0:
        raise Damaged("directory out of bounds")
    return offset + before, length, count, before


def _wide(extra: bytes, sizes: list[int]) -> list[int]:
    """Sizes (inflated, packed, offset), those too large for 32 bits from the entry's 64-bit field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            field, taken = extra[at + 4 : at + 4 + length], 0
            for k, size in enumerate(sizes):
                if size == FULL:
                    if taken + 8 > len(field):
                        raise Damaged("short 64-bit field")
                    sizes[k] = struct.unpack_from("<Q", field, taken)[0]
                    taken += 8
            break
        at += 4 + length
    return sizes


def members(content: bytes) -> Iterator[Member]:
    """Members by the directory; Damaged if it, or a member that it names, isn't where it should be."""
    at, length, count, before = _directory(content)
    end, spans = at + length, []
    for _ in range(count):
        if at + 46 > end or content[at : at + 4] != ENTRY:
            raise Damaged("broken directory")
        flags, method, _, _, _, packed, inflated, n_name, n_extra, n_comment = struct.unpack_from("<4H3L3H", content, at + 8)
        offset = struct.unpack_from("<L", content, at + 42)[0]
        name = content[at + 46 : at + 46 + n_name]
        inflated, packed, offset = _wide(content[at + 46 + n_name : at + 46 + n_name + n_extra], [inflated, packed, offset])
        at += 46 + n_name + n_extra + n_comment
        start = offset + before
        if at > end or start + 30 + packed > end - length or content[start : start + 4] != MEMBER:
            raise Damaged("member out of bounds")
        spans.append((start, start + 30 + packed))
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), packed, inflated, method, bool(flags & 1), offset)
    if at != end:
        raise Damaged("broken directory")
    spans.sort()
    # Members that share bytes let a small archive inflate to any size.
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise Damaged("members overlap")


def judge(content: bytes | None, of: str | None, limit: int = MAX_INFLATED) -> tuple[int | None, int | None, str | None]:
    """(members, inflated bytes, error) of one file; folders don't count as members, and files that are no archives have none of these.

    The error is the first of: damaged, no content types, locked, dishonest (a member claims more than its method can
    give, or other than its bytes if it is stored), too large.
    """
    if of not in ARCHIVES:
        return None, None, None
    try:
        found = list(members(content or b""))
    except Damaged:
        return None, None, "damaged"
    files = [m for m in found if not m.name.endswith("/")]
    total = sum(m.inflated for m in files)
    error = None
    if of in OFFICE and not any(m.name == REQUIRED for m in found):
        error = "no content types"
    elif any(m.locked for m in files):
        error = "locked"
    elif any(m.inflated != m.packed if m.method == 0 else m.inflated > m.packed * MAX_RATIO + MAX_RATIO for m in files):
        error = "dishonest"
    elif total > limit:
        error = "too large"
    return len(files), min(total, 2**63 - 1), error


_RESULT = StructType([StructField("n_members", LongType()), StructField("inflated", LongType()), StructField("error", StringType())])


def archive_check(content: Column, of: Column, limit: int = MAX_INFLATED) -> Column:
    """Struct (n_members, inflated, error) of files with that suffix, as ``judge`` gives it."""

    @F.pandas_udf(_RESULT)
    def check(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = [judge(c, k, limit) for c, k in zip(contents, kinds, strict=True)]
        return pd.DataFrame({"n_members": pd.array([r[0] for r in rows], "Int64"), "inflated": pd.array([r[1] for r in rows], "Int64"), "error": [r[2] for r in rows]})

    return check(content, of)


def checked_archives(files: DataFrame, limit: int = MAX_INFLATED) -> DataFrame:
    """Files (path, content) without their content, with n_members, inflated and error; nulls in all three for files that are no archives."""
    kept = [f"`{c}`" for c in files.columns if c not in ("content", "n_members", "inflated", "error")]
    return files.select(*kept, archive_check(F.col("content"), suffix(F.col("path")), limit).alias("_found")).select(*kept, "_found.*")
