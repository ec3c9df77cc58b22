"""What JPEG and PNG files say about themselves, read from their bytes inside tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import ENDINGS

#: Numbers of directory entries, and bytes a value of each type.
MODEL, WHEN, EXIF, GPS, TAKEN, LAT_REF, LAT, LON_REF, LON = 0x0110, 0x0132, 0x8769, 0x8825, 0x9003, 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
WHEN_FORMS = ["%Y:%m:%d %H:%M:%S", "%Y-%m-%d %H:%M:%S"]
FACTS = "captured_at string, gps_lat double, gps_lon double, camera_model string, width int, height int"


def segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of a JPEG's segments up to its picture data; a cut or broken file ends early."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:  # padding
            at += 1
            continue
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        yield marker, raw[at + 4 : at + 2 + size]
        if marker == 0xDA or size < 2:
            return
        at += 2 + size


class Directories:
    """The directories of a TIFF block; entries that point outside it are left out."""

    def __init__(self, block: bytes):
        self.block = block
        self.order = {b"II": "<", b"MM": ">"}.get(block[:2], "")
        good = self.order and len(block) >= 8 and struct.unpack(self.order + "H", block[2:4])[0] == 42
        self.first = self.read(struct.unpack(self.order + "I", block[4:8])[0]) if good else {}

    def read(self, at: int) -> dict[int, list | str]:
        out: dict[int, list | str] = {}
        if at + 2 > len(self.block):
            return out
        for i in range(struct.unpack_from(self.order + "H", self.block, at)[0]):
            place = at + 2 + 12 * i
            if place + 12 > len(self.block):
                break
            tag, kind, n = struct.unpack_from(self.order + "HHI", self.block, place)
            size = SIZES.get(kind, 0) * n
            start = place + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.block, place + 8)[0]
            if size and start + size <= len(self.block):
                out[tag] = self.value(kind, n, start)
        return out

    def value(self, kind: int, n: int, at: int) -> list | str:
        if kind == 2:
            return self.block[at : at + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            parts = struct.unpack_from(self.order + ("II" if kind == 5 else "ii") * n, self.block, at)
            return [p / q if q else None for p, q in zip(parts[::2], parts[1::2], strict=True)]
        return list(struct.unpack_from(self.order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * n, self.block, at))

    def below(self, tag: int) -> dict[int, list | str]:
        """The directory that an entry of the first one points to."""
        at = self.first.get(tag)
        return self.read(at[0]) if isinstance(at, list) and at else {}


def when(text) -> str | None:
    for form in WHEN_FORMS:
        try:
            return datetime.strptime(text, form).isoformat()
        except (TypeError, ValueError):
            continue
    return None


def degrees(parts, ref) -> float | None:
    """Signed degrees from degrees, minutes and seconds."""
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if ref in ("S", "W") else value


def facts(raw: bytes) -> tuple:
    """(captured_at, gps_lat, gps_lon, camera_model, width, height); what is missing or broken is null."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return (None, None, None, None, *struct.unpack(">II", raw[16:24]))
    taken = lat = lon = model = width = height = None
    if raw[:2] == b"\xff\xd8":
        for marker, body in segments(raw):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5 and width is None:
                height, width = struct.unpack(">HH", body[1:5])
            elif marker == 0xE1 and body[:6] == b"Exif\0\0" and taken is None and model is None and lat is None:
                tiff = Directories(body[6:])
                gps, own = tiff.below(GPS), tiff.below(EXIF)
                taken = when(own.get(TAKEN) or tiff.first.get(TAKEN) or tiff.first.get(WHEN))
                model = tiff.first.get(MODEL) if isinstance(tiff.first.get(MODEL), str) else None
                lat, lon = degrees(gps.get(LAT), gps.get(LAT_REF)), degrees(gps.get(LON), gps.get(LON_REF))
    return taken, lat, lon, model or None, width, height


def with_facts(images: DataFrame, content: str = "content") -> DataFrame:
    """Images with the facts of their bytes in place of the bytes."""
    others = [c for c in images.columns if c != content]
    kept = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            found = [facts(x.as_py() or b"") for x in batch.column(content)]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], [*others, *(x.split()[0] for x in FACTS.split(", "))])

    return images.select(*others, content).mapInArrow(run, ", ".join([kept, FACTS] if kept else [FACTS]))


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(id, file_path, file_name, file_hash, fallback_captured_at and the facts) of all images below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.rlike("path", F.lit(ENDINGS)))
    digest = F.sha2("content", 256)
    rows = rows.select(F.concat(F.lit("media_"), digest).alias("id"), F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), digest.alias("file_hash"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("fallback_captured_at"), "content")
    return with_facts(rows)
