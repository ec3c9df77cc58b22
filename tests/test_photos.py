"""Facts of images from bytes that are built here, entry by entry."""

import struct

import pytest

from kronoleaf.sources import photos


def tiff(order, first, exif=(), gps=()):
    """A TIFF block of three directories; entries are (tag, type, values)."""
    e = {"<": b"II", ">": b"MM"}[order]

    def packed(kind, values):
        if kind == 2:
            return values.encode() + b"\0", len(values.encode()) + 1
        form = {3: "H", 4: "I", 5: "II", 10: "ii"}[kind]
        return b"".join(struct.pack(order + form, *(v if isinstance(v, tuple) else (v,))) for v in values), len(values)

    def directory(entries, at):
        heads, data, free = b"", b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, values in entries:
            raw, n = packed(kind, values)
            if len(raw) <= 4:
                heads += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
            else:
                heads += struct.pack(order + "HHII", tag, kind, n, free + len(data))
                data += raw
        return struct.pack(order + "H", len(entries)) + heads + b"\0\0\0\0" + data

    links = [(0x8769, 4, [0])] * bool(exif) + [(0x8825, 4, [0])] * bool(gps)
    size = len(directory([*first, *links], 8))
    own = directory(exif, 8 + size) if exif else b""
    links = ([(0x8769, 4, [8 + size])] if exif else []) + ([(0x8825, 4, [8 + size + len(own)])] if gps else [])
    return e + struct.pack(order + "HI", 42, 8) + directory([*first, *links], 8) + own + (directory(gps, 8 + size + len(own)) if gps else b"")


def jpeg(block=None, size=(640, 480)):
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    if block is not None:
        out += b"\xff\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    return out + b"\xff\xc4" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">HBHHB", 8, 8, size[1], size[0], 1) + b"\xff\xda\0\2" + b"\xff\xe1data\xff\xd9"


def place(lat, lat_ref, lon, lon_ref):
    return [(1, 2, lat_ref), (2, 5, lat), (3, 2, lon_ref), (4, 5, lon)]


FULL = [(0x010F, 2, "Maker"), (0x0110, 2, "Cam A"), (0x0132, 2, "2023:02:03 04:05:06")]


@pytest.mark.parametrize("order", ["<", ">"])
def test_whole(order):
    gps = place([(35, 1), (30, 1), (3600, 100)], "N", [(139, 1), (15, 1), (0, 1)], "E")
    got = photos.facts(jpeg(tiff(order, FULL, [(0x9003, 2, "2024:01:02 03:04:05")], gps)))
    assert got == ("2024-01-02T03:04:05", 35.51, 139.25, "Cam A", 640, 480)


def test_signs_and_fallbacks():
    gps = place([(1, 2), (0, 1), (0, 1)], "S", [(10, 1), (30, 1), (0, 1)], "W")
    assert photos.facts(jpeg(tiff("<", FULL, gps=gps), (1, 2))) == ("2023-02-03T04:05:06", -0.5, -10.5, "Cam A", 1, 2)
    assert photos.facts(jpeg(tiff(">", [(0x0132, 2, "2023-02-03 04:05:06")])))[0] == "2023-02-03T04:05:06"


def test_broken():
    zero = place([(1, 0), (0, 1), (0, 1)], "N", [(10, 1), (30, 1)], "E")
    assert photos.facts(jpeg(tiff("<", [(0x0132, 2, "yesterday"), (0x0110, 3, [7])], gps=zero))) == (None, None, None, None, 640, 480)
    whole = jpeg(tiff("<", FULL, [(0x9003, 2, "2024:01:02 03:04:05")], place([(35, 1), (30, 1), (0, 1)], "N", [(1, 1), (2, 1), (3, 1)], "E")))
    for n in range(len(whole)):
        photos.facts(whole[:n])  # however a file is cut, it is read without an error
    assert photos.facts(b"") == (None,) * 6 == photos.facts(b"GIF89a") == photos.facts(b"\xff\xd8\xff\xe1\0\0")
    assert photos.facts(jpeg(b"II*\0" + struct.pack("<I", 8) + b"\xff\xff" + bytes(40)))[4:] == (640, 480)


def test_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.JPG").write_bytes(jpeg(tiff("<", FULL)))
    (tmp_path / "y.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 30, 20) + bytes(9))
    (tmp_path / "z.txt").write_bytes(b"no image")
    got = {r.file_name: (r.captured_at, r.camera_model, r.width, r.height) for r in photos.photos(spark, str(tmp_path)).collect()}
    assert got == {"x.JPG": ("2023-02-03T04:05:06", "Cam A", 640, 480), "y.png": (None, None, 30, 20)}
