"""Sizes from image headers, screens from images, and images out of nested columns."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stepwise.functions import geometry as G
from stepwise.operators import regions
from stepwise.sources import jsonl, pictures


def png(width, height, color=2):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    channels = {0: 1, 2: 3, 6: 4}[color]
    rows = zlib.compress((b"\0" + b"\x7f" * channels * width) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def jpeg(width, height, parts=3, extra=70_000):
    comment = b"".join(b"\xff\xfe" + struct.pack(">H", 2 + n) + b"\xff" * n for n in (extra // 2, extra // 2))
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * parts, 8, height, width, parts) + b"\1\x11\0" * parts
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + comment + b"\xff\xc4\0\x04\0\0" + frame + b"\xff\xd9"


def webp(width, height, kind):
    if kind == b"VP8X":
        body = b"\x10\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    elif kind == b"VP8L":
        body = b"\x2f" + (width - 1 | height - 1 << 14).to_bytes(4, "little") + b"\0" * 8
    else:
        body = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height) + b"\0" * 4
    data = b"WEBP" + kind + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(data)) + data


IMAGES = [(png(30, 50), (30, 50, "RGB")), (png(7, 9, 6), (7, 9, "RGBA")), (png(3, 2, 0), (3, 2, "L")), (jpeg(640, 480), (640, 480, "RGB")), (jpeg(5, 6, 1), (5, 6, "L")),
          (webp(1080, 2400, b"VP8X"), (1080, 2400, "RGBA")), (webp(100, 20, b"VP8L"), (100, 20, "RGB")), (webp(64, 65, b"VP8 "), (64, 65, "RGB"))]


def test_headers():
    for data, want in IMAGES:
        assert pictures.header(data)[1:] == want
    for data in (None, b"", b"no image", IMAGES[0][0][:20], b"\xff\xd8\xff"):
        assert pictures.header(data) is None


def test_screens_come_from_images(spark, tmp_path):
    (tmp_path / "shots").mkdir()
    (tmp_path / "shots" / "a.png").write_bytes(png(200, 400))
    (tmp_path / "b.jpg").write_bytes(jpeg(100, 100))
    (tmp_path / "c.txt").write_text("no image")
    element = "array<struct<bbox:struct<x1:double,y1:double,x2:double,y2:double,coordinate_space:string>,text:string,ui_type:string,index:int>>"
    box = [((0.25, 0.25, 0.5, 0.5, "normalized_1"), "Home", "TEXT", 0)]
    rows = [(1, "shots/a.png", None), (2, "b.jpg", (5, 6)), (3, "c.txt", None), (4, None, None), (5, "lost.png", None), (6, str(tmp_path / "shots" / "a.png"), None), (7, "shots/a.png", None)]
    steps = spark.createDataFrame([(*r, "go", box) for r in rows], f"n int, screenshot_before string, screen_size struct<width:int,height:int>, task string, ui_elements {element}")
    got = pictures.with_screen_size(spark, steps, str(tmp_path))
    assert got.columns == steps.columns
    sizes = {r["n"]: r["screen_size"] and tuple(r["screen_size"]) for r in got.collect()}
    assert sizes == {1: (200, 400), 2: (5, 6), 3: None, 4: None, 5: None, 6: (200, 400), 7: (200, 400)}
    point = G.to_pixel(G.point(F.lit(0.3), F.lit(0.3)), F.col("screen_size"), F.lit("normalized_1"))
    found = {r["n"]: r["region"] for r in regions.with_region(regions.with_pixel_boxes(got), point, "region").collect()}
    assert {n for n, r in found.items() if r} == {1, 2, 6, 7} and found[1]["kind"] == regions.PADDED and found[1]["x1"] == 44.0


@pytest.mark.parametrize("write", [False, True])
def test_images_leave_nested_columns(spark, tmp_path, write):
    image = "struct<bytes:binary,path:string>"
    kind = f"id int, shot {image}, steps array<struct<n:int, before:{image}, more:map<string,{image}>>>, plain struct<bytes:int,path:string>"
    a, b, c = IMAGES[0][0], IMAGES[3][0], b"unknown"
    rows = [
        (1, (a, "x.png"), [(1, (b, None), {"left": (a, None), "right": None}), (2, None, None)], (1, "p")),
        (2, None, None, None),
        (3, (c, None), [(3, (a, None), {})], None),
        (4, (None, "there.png"), [], None),
    ]
    df = spark.createDataFrame(rows, kind).repartition(3)
    folder = f"{tmp_path}/images" if write else None
    out = pictures.portable_images(df, folder)
    jsonl.write_jsonl(out, str(tmp_path / "rows"))
    got = {r["id"]: r.asDict(recursive=True) for r in out.collect()}
    assert "bytes" not in str(out.schema["shot"].dataType) and got[1]["plain"] == {"bytes": 1, "path": "p"}
    first, inner = got[1]["shot"], got[1]["steps"][0]
    assert (first["size"], first["mode"]) == ([30, 50], "RGB") and inner["before"]["size"] == [640, 480] and inner["more"]["left"]["size"] == [30, 50] and inner["more"]["right"] is None
    assert got[2]["shot"] is None and got[2]["steps"] is None and got[3]["shot"]["size"] is None and got[1]["steps"][1]["before"] is None
    if not write:
        assert first["type"] == pictures.UNWRITTEN
        return
    files = {p.name for p in (tmp_path / "images").iterdir()}
    assert got[4]["shot"]["path"] == "there.png" and len(files) == 5 and not any(f.startswith(".") for f in files)
    for said, data in ((first, a), (inner["before"], b), (inner["more"]["left"], a), (got[3]["shot"], c)):
        assert open(said["path"], "rb").read() == data
    assert first["path"].endswith("_shot.png") and inner["before"]["path"].endswith("_before.jpg") and inner["more"]["left"]["path"].endswith("_left.png")
