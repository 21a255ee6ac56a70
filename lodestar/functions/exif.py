"""Photo metadata from the head of image files: a reader of TIFF structures and a column function."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats.
SCAN_BYTES, JPEG_SEGMENTS, MOST_ENTRIES, MOST_TEXT = 1 << 20, 40, 500, 64
TIFF_HEADS = (b"II*\0", b"MM\0*")
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TAKEN, DIGITISED, CHANGED, EXIF_BLOCK, GPS_BLOCK = 0x9003, 0x9004, 0x0132, 0x8769, 0x8825
MARKERS = {b"Exif\0\0": 6, b"eXIf": 4, b"EXIF": 8}
HEIC_HEADS = (b"MM\0*\0\0\0\x08", b"II*\0\x08\0\0\0")
DATE = re.compile(r"(\d{4}):(\d\d):(\d\d)[ T](\d\d):(\d\d):(\d\d)")
FIRST_YEAR = 1990
END_MARKERS = (0xD9, 0xDA)

#: Directories that entries of the main one lead to.
_INNER = {EXIF_BLOCK: "exif", GPS_BLOCK: "gps"}
#: Where a photo's date may stand, the best first.
_DATES = (("exif", TAKEN), ("exif", DIGITISED), ("main", CHANGED))


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of the segments of a JPEG file up to its picture, JPEG_SEGMENTS at most."""
    at = 2
    for _ in range(JPEG_SEGMENTS):
        lead, marker, size = struct.unpack_from(">BBH", data.ljust(at + 4, b"\0"), at)
        if lead != 0xFF or marker in END_MARKERS or size < 2:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def tiff_of(data: bytes) -> bytes | None:
    """The TIFF block inside a photo, wherever its format keeps it."""
    if data.startswith(b"\xff\xd8"):
        return next((body[6:] for marker, body in jpeg_segments(data) if marker == 0xE1 and body.startswith(b"Exif\0\0")), None)
    head = data[:SCAN_BYTES]
    if head[:4] in TIFF_HEADS:
        return head
    named = (head[m.start() + skip :].removeprefix(b"Exif\0\0") for name, skip in MARKERS.items() for m in re.finditer(re.escape(name), head))
    bare = (head[head.find(h) :] for h in HEIC_HEADS if h in head)
    return next((block for block in named if block[:4] in TIFF_HEADS), None) or next(bare, None)


def tiff_entries(block: bytes) -> dict[tuple[str, int], tuple[int, bytes]]:
    """(directory, tag) to (count, bytes of the value) for the main directory and those it leads to, in one pass.

    What lies outside the block is left out: a broken entry or directory costs only what it holds. Values are cut to
    what any of their readers looks at.
    """
    order = {b"II": "little", b"MM": "big"}.get(block[:2])
    whole = lambda at, size: int.from_bytes(block[at : at + size], order) if 0 <= at <= len(block) - size else None
    found: dict[tuple[str, int], tuple[int, bytes]] = {}
    todo = [("main", whole(4, 4))] if order and whole(2, 2) == 42 else []
    for name, start in todo:
        n = whole(start, 2) if start is not None else None
        for at in range(start + 2, start + 2 + 12 * min(n, MOST_ENTRIES), 12) if n else ():
            tag, kind, count, value = whole(at, 2), whole(at + 2, 2), whole(at + 4, 4), whole(at + 8, 4)
            if value is None:
                break
            size = SIZES.get(kind, 1) * count
            place = at + 8 if size <= 4 else value
            found[name, tag] = (count, block[place : place + min(size, MOST_TEXT)])
            if name == "main" and tag in _INNER:
                todo.append((_INNER[tag], value))
    return found


def moment(raw: bytes) -> float | None:
    """Seconds of a date as photos write it, counted as UTC; none if it is no date or not of the time of such photos."""
    m = DATE.search(raw.partition(b"\0")[0].decode("ascii", "ignore"))
    try:
        when = datetime(*map(int, m.groups()), tzinfo=UTC) if m else None
    except ValueError:
        when = None
    return when.timestamp() if when and FIRST_YEAR <= when.year <= datetime.now(UTC).year + 1 else None


def degrees(found: dict, order: str, value: int, side: int, most: float) -> float | None:
    """Signed degrees from the three fractions of a position's entry and the letter of its side."""
    count, raw = found.get(("gps", value), (0, b""))
    if ("gps", side) not in found or count < 3 or len(raw) < 24:
        return None
    parts = struct.unpack(f"{order}6I", raw[:24])
    total = sum((top / bottom if bottom else 0.0) / 60**k for k, (top, bottom) in enumerate(zip(parts[::2], parts[1::2], strict=True)))
    signed = -total if found["gps", side][1][:1].upper() in (b"S", b"W") else total
    return signed if abs(signed) <= most else None


def photo_info(data: bytes | None) -> tuple[float | None, float | None, float | None] | None:
    """(taken, lat, lon) of a photo's bytes, or None if there is neither a date nor a position.

    Dates count as UTC; the taken date comes first, then the digitised, then the file's.
    """
    block = tiff_of(data or b"") or b""
    found, order = tiff_entries(block), "<" if block.startswith(b"II") else ">"
    dates = (moment(found[key][1]) for key in _DATES if key in found)
    taken = next((d for d in dates if d is not None), None)
    lat, lon = degrees(found, order, 2, 1, 90), degrees(found, order, 4, 3, 180)
    if lat is None or lon is None:
        lat = lon = None
    return None if taken is None and lat is None else (taken, lat, lon)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("taken", "lat", "lon")]))
def exif_info(content: pd.Series) -> pd.DataFrame:
    """Column function over BINARY: all three null where there is nothing."""
    return pd.DataFrame([photo_info(c) or (None, None, None) for c in content], columns=["taken", "lat", "lon"], dtype="float64")
