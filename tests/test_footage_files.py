"""Listing, ranged headers, segments and developed frames on real files."""

import os
import random

import numpy as np
import pytest

from rushes.operators import metadata, mosaic
from rushes.sources import developed, headers, segments, tiff
from rushes.sources.listing import FolderReader, scan_files


def pack(values, bits, width=None):
    if bits == 8:
        return bytes(values)
    if bits == 16:
        return np.array(values, "<u2").tobytes()
    whole = int("".join(f"{v:0{bits}b}" for v in values).ljust(-(-len(values) * bits // 8) * 8, "0"), 2)
    return whole.to_bytes(-(-len(values) * bits // 8), "big")


def frame_file(width, height, bits, tile=None, strips=1, cut=0, seed=0, **extra):
    """(file, samples by row) of an uncompressed frame; what lies beyond the image in tiles is 7."""
    draw = random.Random(seed)
    image = [[draw.randrange(1 << bits) for _ in range(width)] for _ in range(height)]
    at = lambda y, x: image[y][x] if y < height and x < width else 7
    if tile:
        tw, th = tile
        parts = [[at(y, x) for y in range(y0, y0 + th) for x in range(x0, x0 + tw)] for y0 in range(0, height, th) for x0 in range(0, width, tw)]
    else:
        rows = -(-height // strips)
        parts = [[v for row in image[y0 : y0 + rows] for v in row] for y0 in range(0, height, rows)]
    data, places = b"", []
    for p in parts:
        places.append((8 + len(data), len(pack(p, bits))))
        data += pack(p, bits)
    tags = {254: (tiff.LONG, [0]), 256: (tiff.LONG, [width]), 257: (tiff.LONG, [height]), 258: (tiff.SHORT, [bits]), 259: (tiff.SHORT, [1]), 33422: (tiff.BYTE, [0, 1, 1, 2])}
    a, b = (324, 325) if tile else (273, 279)
    tags |= {a: (tiff.LONG, [p for p, _ in places]), b: (tiff.LONG, [n for _, n in places])}
    if tile:
        tags |= {322: (tiff.SHORT, [tile[0]]), 323: (tiff.SHORT, [tile[1]])}
    whole = tiff.file_bytes(tags | extra, image=data)
    return (whole[: len(whole) - cut] if cut else whole), image


def test_listing(spark, tmp_path):
    """Two levels of folders, empty files and folders, names that don't match; a folder of the root is one task's."""
    for name in ("a/x/1.dng", "a/x/2.dng", "a/y/3.dng", "b/4.dng", "b/._4.dng", "5.dng", "6.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "a/x/2.dng" else b"xx")
    (tmp_path / "empty").mkdir()
    rows = {r.path[len(str(tmp_path)) + 1 :]: r for r in scan_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/x/1.dng", "a/x/2.dng", "a/y/3.dng", "b/4.dng", "b/._4.dng", "5.dng"}
    assert rows["a/x/2.dng"].size == 0 and rows["b/4.dng"].size == 2 and rows["5.dng"].mtime is not None
    assert len(FolderReader(str(tmp_path), "*").partitions()) == 4
    assert scan_files(spark, f"file:{tmp_path}/a", "1*").count() == 1


def test_ranged_headers(spark, tmp_path):
    """A directory behind a megabyte of image data costs a few blocks; broken files are told of and cost no more."""
    big, _ = frame_file(1024, 512, 16)
    assert len(big) > 1 << 20
    small, _ = frame_file(16, 12, 12, tile=(8, 8))
    files = {
        "big.dng": big, "small.dng": small, "cut.dng": big[:-40], "empty.dng": b"", "text.dng": b"no picture at all",
        "lies.dng": tiff.file_bytes({256: (tiff.LONG, [4]), 257: (tiff.LONG, [4])})[:4] + (1 << 30).to_bytes(4, "little") + bytes(100),
    }
    huge = bytearray(small)
    at = huge.index(b"\x44\x01\x04\x00")  # the tile offsets say that there are 2**30 of them
    huge[at + 4 : at + 8] = (1 << 30).to_bytes(4, "little")
    files["huge.dng"] = bytes(huge)
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    listing = scan_files(spark, str(tmp_path)).union(spark.createDataFrame([("/not/there.dng", 0, None), (None, 0, None)], "path string, size long, mtime timestamp"))
    got = {os.path.basename(r.path or "null"): r for r in headers.read_headers(listing).collect()}
    assert len(got) == 9
    assert {n for n, r in got.items() if r.status == "None"} == {"big.dng", "small.dng"}
    assert (got["big.dng"].width, got["big.dng"].height, got["big.dng"].offsets) == (1024, 512, [8])
    assert got["big.dng"].bytes_read <= 3 * tiff.BLOCK and all(r.bytes_read <= 3 * tiff.BLOCK for r in got.values())
    assert len(got["small.dng"].offsets) == 4 and got["small.dng"].tiled


def test_header_tags(spark):
    """Types that vary between cameras, tags below a preview, both byte orders."""
    for order in "<>":
        extra = {50721: (tiff.SIGNED_RATIONAL, [(i - 4, 3) for i in range(9)]), 50965: (tiff.SIGNED_RATIONAL, [(1, 0)] * 9), 50728: (tiff.SHORT, [1, 2, 3]), 50729: (tiff.RATIONAL, [(1, 4), (3, 8)]), 50719: (tiff.RATIONAL, [(17, 2), (9, 1)]), 50720: (tiff.LONG, [10, 12]), 50829: (tiff.SHORT, [1, 2, 3, 4]), 50712: (tiff.SHORT, list(range(300))), 51044: (tiff.RATIONAL, [(25, 1)]), 50708: (tiff.TEXT, "A cam")}
        image = {254: (tiff.LONG, [0]), 256: (tiff.SHORT, [64]), 257: (tiff.LONG, [32]), 258: (tiff.SHORT, [10]), 50714: (tiff.RATIONAL, [(129, 2)]), 50717: (tiff.SHORT, [1000]), 33422: (tiff.SHORT, [2, 1, 1, 0])}
        for data in (tiff.file_bytes(image | extra, order), tiff.file_bytes(image, order, {**extra, 254: (tiff.LONG, [1]), 256: (tiff.SHORT, [5]), 257: (tiff.SHORT, [5])})):
            r = headers.ingest_headers(spark.createDataFrame([("p", bytearray(data))], "path string, content binary")).first()
            assert (r.status, r.width, r.height, r.bits, r.cfa, r.black_level, r.white_level) == ("None", 64, 32, 10, [2, 1, 1, 0], 64.5, 1000.0)
            assert r.color_matrix1 == pytest.approx([(i - 4) / 3 for i in range(9)]) and r.forward_matrix2 == [0.0] * 9 and r.color_matrix2 is None
            assert (r.neutral, r.white_xy, r.crop_origin, r.crop_size, r.active_area) == ([1, 2, 3], [0.25, 0.375], [8, 9], [10, 12], [1, 2, 3, 4])
            assert (len(r.linearisation), r.rate_num, r.rate_den, r.model, r.timecode) == (300, 25, 1, "A cam", None)


def test_segments(spark, tmp_path):
    """Strips and tiles of all depths: what ranged reads give is the image, without padding, and what the long form gives."""
    want, broken = {}, set()
    for i, (bits, tile, strips) in enumerate([(8, None, 1), (10, None, 3), (12, (8, 4), 1), (14, (8, 8), 1), (16, (4, 4), 1), (12, None, 2), (16, None, 3)]):
        data, image = frame_file(16, 12, bits, tile, strips, seed=i)
        (tmp_path / f"{i}.dng").write_bytes(data)
        want[f"{i}.dng"] = image
    for name, data in {"none.dng": frame_file(16, 12, 12)[0].replace(b"\x11\x01\x04\x00", b"\x11\x00\x04\x00"), "odd.dng": frame_file(16, 12, 11)[0]}.items():
        (tmp_path / name).write_bytes(data)
        broken.add(name)
    ragged, image = frame_file(13, 11, 16, (4, 4))
    (tmp_path / "ragged.dng").write_bytes(ragged)
    want["ragged.dng"] = image
    meta = headers.read_headers(scan_files(spark, str(tmp_path)))
    assert {os.path.basename(r.path): r.support for r in metadata.support_status(meta).where("support <> 'None'").collect()} == {"none.dng": "BadImageData", "odd.dng": "NotImplemented"}
    places = segments.segment_places(meta)
    found = segments.read_segments(places)
    assert {r.status for r in found.collect()} == {"None"} and found.count() == places.count()
    got = {}
    for r in segments.segment_pixels(found).collect():
        got.setdefault(os.path.basename(r.path), {})[r.y, r.x] = r.v
    assert set(got) == set(want)
    for name, image in want.items():
        assert got[name] == {(y, x): v for y, row in enumerate(image) for x, v in enumerate(row)}
    # the long form of the tiled one
    tiles = [(0, k, [v for v in t]) for k, t in enumerate(np.array([[want["ragged.dng"][y][x] if y < 11 and x < 13 else 7 for y in range(y0, y0 + 4) for x in range(x0, x0 + 4)] for y0 in range(0, 11, 4) for x0 in range(0, 13, 4)]).tolist())]
    long = mosaic.assemble_tiles(spark.createDataFrame(tiles, "frame int, tile int, samples array<int>"), 4, 4, 13, 11)
    assert {(r.y, r.x): r.v for r in long.collect()} == got["ragged.dng"]
    # files that vanish or shrink between the header and the read
    os.remove(tmp_path / "0.dng")
    (tmp_path / "1.dng").write_bytes(b"II*\0")
    assert {os.path.basename(r.path) for r in segments.read_segments(places.cache()).where("status <> 'None' and samples is null").collect()} <= {"0.dng", "1.dng"}


def test_developed_frames(spark, tmp_path):
    """Whole files, the same after a second write; a killed write leaves no frame and what it left can be cleared."""
    rows = [(f, y, x, y / 8, x / 8, f / 4 if f else None) for f in range(4) for y in range(5 + f) for x in range(6)]
    rgb = spark.createDataFrame(rows, "frame long, y long, x long, r double, g double, b double").repartition(5)
    out = str(tmp_path / "out")
    developed.write_developed(rgb, out)
    first = {f: (tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(out))}
    assert list(first) == ["0.tif", "1.tif", "2.tif", "3.tif"]
    developed.write_developed(rgb, out)
    assert {f: (tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(out))} == first
    ranges = tiff.Ranges(lambda at, n: first["2.tif"][at : at + n])
    _, image = tiff.directories(ranges)
    (at,), (n,), (w,), (h,) = (image.values(t) for t in (273, 279, 256, 257))
    assert (w, h, n) == (6, 7, 126)
    assert first["2.tif"][at : at + n] == bytes(int(min(1, max(0, v)) * 255) for y in range(7) for x in range(6) for v in (y / 8, x / 8, 0.5))
    # a frame with a hole ends its task before the frame is moved
    with pytest.raises(Exception, match="whole rectangle"):
        developed.write_developed(rgb.where("not (frame = 3 and y = 2 and x = 2)").withColumn("frame", rgb["frame"] + 10), out)
    assert "13.tif" not in os.listdir(out)
    assert developed.clean_developed(out) >= 1 and not [f for f in os.listdir(out) if f.startswith(".")]
