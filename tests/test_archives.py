"""Archives: real ones, damaged ones, 64-bit ones, and those that claim other sizes than they have."""

import io
import struct
import zipfile

import pytest

from tessera.sources.archives import REQUIRED, checked_archives, judge


def archive(*files: tuple[str, bytes], method: int = zipfile.ZIP_DEFLATED, comment: bytes = b"", wide: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as member:
                member.write(data)
        z.comment = comment
    return out.getvalue()


GOOD = archive((REQUIRED, b"<a/>"), ("word/", b""), ("word/x.xml", b"x" * 5000), method=zipfile.ZIP_DEFLATED)


def wide_end(content: bytes) -> bytes:
    """The archive with a 64-bit end record, its 32-bit one filled."""
    at = content.rfind(b"PK\x05\x06")
    _, _, here, count, length, offset, _ = struct.unpack_from("<4H2LH", content, at + 4)
    record = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, here, count, length, offset)
    return content[:at] + record + struct.pack("<4sLQL", b"PK\x06\x07", 0, at, 1) + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def claiming(content: bytes, inflated: int) -> bytes:
    """The archive whose first directory entry claims another inflated size."""
    at = content.find(b"PK\x01\x02")
    return content[: at + 24] + struct.pack("<L", inflated) + content[at + 28 :]


@pytest.mark.parametrize(
    ("content", "of", "found"),
    [
        (GOOD, ".docx", (2, 5004, None)), (GOOD, ".txt", (None, None, None)), (GOOD, None, (None, None, None)), (wide_end(GOOD), ".docx", (2, 5004, None)), (b"front" + GOOD, ".xlsx", (2, 5004, None)), (b"front" + wide_end(GOOD), ".xlsx", (2, 5004, None)),
        (archive((REQUIRED, b"1"), comment=b"PK\x05\x06 in a comment" + b"z" * 60_000), ".pptx", (1, 1, None)), (archive((REQUIRED, b"1" * 99), ("b", b"22"), wide=True), ".pptx", (2, 101, None)),
        (archive(("mimetype", b"e"), method=zipfile.ZIP_STORED), ".epub", (1, 1, None)), (archive(("mimetype", b"e")), ".docx", (1, 1, "no content types")), (archive(), ".epub", (0, 0, None)), (archive(), ".docx", (0, 0, "no content types")),
        (b"", ".docx", (None, None, "damaged")), (None, ".docx", (None, None, "damaged")), (GOOD[:-5], ".docx", (None, None, "damaged")), (GOOD[20:], ".docx", (None, None, "damaged")), (GOOD[:200] + GOOD[230:], ".docx", (None, None, "damaged")), (b"PK\x05\x06", ".docx", (None, None, "damaged")),
        (claiming(GOOD, 100_000_000), ".docx", (2, 100_005_000, "dishonest")), (claiming(archive(("a", b"abc"), method=zipfile.ZIP_STORED), 2), ".epub", (1, 2, "dishonest")), (archive(("a", b"\0" * 2_000_000)), ".epub", (1, 2_000_000, "too large")),
    ],
)
def test_verdicts(content, of, found):
    assert judge(content, of, limit=1_000_000) == found


def test_every_cut_and_every_flipped_byte_of_the_directory_has_a_verdict():
    for k in range(len(GOOD)):
        assert judge(GOOD[:k], ".docx")[2] == "damaged"
    for k in range(GOOD.find(b"PK\x01\x02"), len(GOOD)):
        judge(GOOD[:k] + bytes([GOOD[k] ^ 0xFF]) + GOOD[k + 1 :], ".docx")


def test_members_that_share_bytes_are_refused():
    one = archive(("a", b"x" * 10_000))
    at, end = one.find(b"PK\x01\x02"), one.rfind(b"PK\x05\x06")
    twice = one[:end] + one[at:end] + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 2, 2, 2 * (end - at), at, 0)
    assert judge(twice, ".epub") == (None, None, "damaged")


def test_as_a_column(spark):
    files = spark.createDataFrame([("a/B.DOCX", bytearray(GOOD), 1), ("b.docx", None, 2), ("c.txt", bytearray(b"t"), 3)], "path string, content binary, error long")
    assert {r.path: (r.n_members, r.inflated, r.error) for r in checked_archives(files).collect()} == {"a/B.DOCX": (2, 5004, None), "b.docx": (None, None, "damaged"), "c.txt": (None, None, None)}
    assert checked_archives(files.limit(0)).count() == 0
