"""Width and height of image files out of their headers: a few bytes are read, no pixel is decoded."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from . import files

#: Bytes at a position of a file; fewer at its end.
Reader = Callable[[int, int], bytes]
HEAD = 32

# The markers of JPEG frames (their header has the size), and those that stand alone, without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ALONE = {0x01, *range(0xD0, 0xD8)}


def _jpeg(read: Reader) -> tuple[int, int] | None:
    """The size in the first frame header: from one segment to the next by their lengths, whose contents are skipped."""
    at = 2
    while True:
        head = read(at, 10)
        if len(head) < 4 or head[0] != 0xFF:
            return None
        kind = head[1]
        if kind == 0xFF:  # a fill byte
            at += 1
        elif kind in ALONE:
            at += 2
        elif kind in FRAMES:
            return struct.unpack(">HH", head[5:9])[::-1] if len(head) >= 9 else None
        elif kind in (0xD9, 0xDA):  # the end, or pixels before any frame
            return None
        else:
            length = struct.unpack(">H", head[2:4])[0]
            if length < 2:
                return None
            at += 2 + length


def _webp(head: bytes) -> tuple[int, int] | None:
    kind = head[12:16]
    if kind == b"VP8 " and len(head) >= 30 and head[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L" and len(head) >= 25 and head[20] == 0x2F:
        bits = struct.unpack("<I", head[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(head) >= 30:
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    return None


def _of(head: bytes, read: Reader) -> tuple[int, int] | None:
    if head.startswith(b"\x89PNG\r\n\x1a\n") and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        if struct.unpack("<I", head[14:18])[0] == 12:  # the oldest header
            return struct.unpack("<HH", head[18:22])
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)  # a negative height is that of rows from top to bottom
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _webp(head)
    if head[:2] == b"\xff\xd8":
        return _jpeg(read)
    return None


def size(read: Reader) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, WebP or JPEG file; None for others, and for what is cut off or has no area."""
    found = _of(read(0, HEAD), read)
    return (int(found[0]), int(found[1])) if found and found[0] > 0 and found[1] > 0 else None


def size_of_bytes(data: bytes) -> tuple[int, int] | None:
    return size(lambda at, n: data[at : at + n])


def size_of_file(path: str) -> tuple[int, int] | None:
    """By range requests of the file's store; None also where there is no such file."""
    try:
        with files.opened(path) as f:
            return size(lambda at, n: f.read_at(n, at))
    except OSError:
        return None


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("image_path").to_pylist()
        found = [size_of_file(p) if p else None for p in paths]
        yield pa.RecordBatch.from_arrays([batch.column("image_path"), pa.array([f and f[0] for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.int32())], ["image_path", "image_width", "image_height"])


def sizes(paths: DataFrame) -> DataFrame:
    """(image_path, image_width, image_height) of the distinct, non-empty paths of a column image_path; unreadable files are left out."""
    ship(paths.sparkSession)
    some = paths.select("image_path").where("image_path is not null and image_path != ''").distinct()
    return some.mapInArrow(_sizes, "image_path string, image_width int, image_height int").where("image_width is not null")


def with_sizes(gt: DataFrame, root: str) -> DataFrame:
    """``gt`` with the width and height that rows lack read from the image at their image_path, a relative one below ``root``."""
    lacking = F.col("width").isNull() | F.col("height").isNull()
    path = F.col("image_path")
    whole = F.when(F.coalesce(path, F.lit("")) == "", None).when(path.rlike("^(?:/|file:|[A-Za-z][A-Za-z0-9+.-]*://)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    known = sizes(gt.where(lacking).select(whole.alias("image_path"))).withColumnsRenamed({"image_path": "_path", "image_width": "_w", "image_height": "_h"})
    joined = gt.join(known, lacking & (whole == F.col("_path")), "left")
    return joined.withColumns({"width": F.when(lacking, F.col("_w")).otherwise(F.col("width")), "height": F.when(lacking, F.col("_h")).otherwise(F.col("height"))}).drop("_path", "_w", "_h")
