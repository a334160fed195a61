"""TIFF directories by byte ranges: a reader that fetches only what tags need, and a writer of small headers."""

import struct
from collections.abc import Callable

# Field types with their bytes and codes, and the tags that are read.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
BYTE, TEXT, SHORT, LONG, RATIONAL, SIGNED_RATIONAL = 1, 2, 3, 4, 5, 10
SUBFILE_TYPE, SUB_IFDS = 254, 330
#: Tags of the image's own directory.
IMAGE_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "tile_w": 322, "tile_h": 323, "cfa_dims": 33421, "cfa": 33422, "black_level": 50714, "white_level": 50717}
#: Tags of the file's first directory.
FILE_TAGS = {
    "orientation": 274, "linearisation": 50712, "model": 50708, "scale": 50718, "crop_origin": 50719, "crop_size": 50720, "color_matrix1": 50721, "color_matrix2": 50722, "neutral": 50728, "white_xy": 50729,
    "baseline_exposure": 50730, "illuminant1": 50778, "illuminant2": 50779, "active_area": 50829, "forward_matrix1": 50964, "forward_matrix2": 50965, "timecode": 51043,
}
RATE, TILE_OFFSETS, TILE_BYTES, STRIP_OFFSETS, STRIP_BYTES = 51044, 324, 325, 273, 279
BLOCK = 4096
#: A header that asks for more bytes than this is taken for a broken file.
MOST_BYTES = 4 << 20


class Ranges:
    """Bytes of one file, fetched in blocks as they are asked for; counts what was fetched."""

    def __init__(self, fetch: Callable[[int, int], bytes], most: int = MOST_BYTES):
        self.fetch, self.most, self.read, self.blocks = fetch, most, 0, {}

    def __call__(self, at: int, n: int) -> bytes:
        if n > self.most:
            raise ValueError("a field beyond any header")
        first, last = at // BLOCK, (at + max(n, 1) - 1) // BLOCK
        missing = [b for b in range(first, last + 1) if b not in self.blocks]
        if missing:
            # one request from the first missing block to the last
            low, high = missing[0], missing[-1]
            if self.read + (high - low + 1) * BLOCK > self.most:
                raise ValueError("more bytes than any header has")
            data = self.fetch(low * BLOCK, (high - low + 1) * BLOCK)
            self.read += len(data)
            for b in range(low, high + 1):
                self.blocks[b] = data[(b - low) * BLOCK : (b - low + 1) * BLOCK]
        data = b"".join([self.blocks[b] for b in range(first, last + 1)])[at - first * BLOCK :][:n]
        if len(data) < n:
            raise ValueError("the file ends within a field")
        return data


class Directory:
    """One directory: the entries' places first, values only when they are asked for."""

    def __init__(self, ranges: Ranges, at: int, order: str):
        self.ranges, self.order = ranges, order
        (count,) = struct.unpack(order + "H", ranges(at, 2))
        data = ranges(at + 2, 12 * count)
        self.entries = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, 12 * k)
            if kind in TYPE_SIZES:
                self.entries[tag] = kind, n, data[12 * k + 8 : 12 * k + 12]

    def __contains__(self, tag: int) -> bool:
        return tag in self.entries

    def values(self, tag: int) -> tuple:
        """A tag's values, fractions as (numerator, denominator); () without the tag."""
        if tag not in self.entries:
            return ()
        kind, n, data = self.entries[tag]
        size = n * TYPE_SIZES[kind]
        if size > 4:
            (place,) = struct.unpack(self.order + "I", data)
            data = self.ranges(place, size)
        if kind == TEXT:
            return (data[:n].split(b"\0")[0].decode("latin-1"),)
        if kind in (RATIONAL, SIGNED_RATIONAL):
            pairs = struct.unpack_from(f"{self.order}{2 * n}{'I' if kind == RATIONAL else 'i'}", data)
            return tuple(zip(pairs[::2], pairs[1::2]))
        return struct.unpack_from(f"{self.order}{n}{TYPE_CODES[kind]}", data)


def number(value):
    """A plain number, or a fraction; a zero denominator gives 0."""
    if isinstance(value, tuple):
        return value[0] / value[1] if value[1] else 0.0
    return value


def directories(ranges: Ranges) -> tuple[Directory, Directory]:
    """The file's first directory and the image's. Below a preview the image is the last directory that is not marked as another preview."""
    head = ranges(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("no TIFF header")
    first = image = Directory(ranges, struct.unpack_from(order + "I", head, 4)[0], order)
    if (first.values(SUBFILE_TYPE) or (0,))[0] != 0:
        for at in first.values(SUB_IFDS):
            sub = Directory(ranges, at, order)
            if (sub.values(SUBFILE_TYPE) or (0,))[0] == 0:
                image = sub
    return first, image


def tags_of(ranges: Ranges) -> dict:
    """Every tag of IMAGE_TAGS and FILE_TAGS by name as a list of numbers or texts, the frame rate, and the places of strips or tiles.

    ValueError for what is no TIFF or ends too early. A tag in whatever type it was
    written gives numbers; tags are looked for in their own directory, then in the other.
    """
    first, image = directories(ranges)
    out = {}
    for names, own, other in ((IMAGE_TAGS, image, first), (FILE_TAGS, first, image)):
        for name, tag in names.items():
            out[name] = [number(v) for v in (own if tag in own else other).values(tag)]
    rate = (first if RATE in first else image).values(RATE)
    out["rate"] = rate[0] if rate and isinstance(rate[0], tuple) else None
    out["tiled"] = TILE_OFFSETS in image
    places = (TILE_OFFSETS, TILE_BYTES) if out["tiled"] else (STRIP_OFFSETS, STRIP_BYTES)
    out["offsets"], out["byte_counts"] = (list(image.values(t)) for t in places)
    return out


def packed(kind: int, values, order: str) -> bytes:
    if kind == TEXT:
        return values.encode("latin-1") + b"\0"
    if kind in (RATIONAL, SIGNED_RATIONAL):
        return b"".join(struct.pack(order + ("II" if kind == RATIONAL else "ii"), *v) for v in values)
    return struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values)


def directory_bytes(entries: dict[int, tuple], at: int, order: str) -> bytes:
    """A directory that stands at a place: tag -> (type, values); values that don't fit follow it."""
    body, extra = struct.pack(order + "H", len(entries)), b""
    tail = at + 2 + 12 * len(entries) + 4
    for tag, (kind, values) in sorted(entries.items()):
        data = packed(kind, values, order)
        count = len(data) // TYPE_SIZES[kind]
        if len(data) > 4:
            place, extra = struct.pack(order + "I", tail + len(extra)), extra + data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        body += struct.pack(order + "HHI", tag, kind, count) + place
    return body + struct.pack(order + "I", 0) + extra


def file_bytes(entries: dict[int, tuple], order: str = "<", preview: dict[int, tuple] | None = None, image: bytes = b"") -> bytes:
    """A file: image data, then the directories. With preview, its tags stand in the first directory and the image's in one below it."""
    body = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 42)
    at = 8 + len(image) + len(image) % 2
    image = image.ljust(at - 8, b"\0")
    if preview is None:
        return body + struct.pack(order + "I", at) + image + directory_bytes(entries, at, order)
    below = directory_bytes(entries, at, order)
    below += b"\0" * (len(below) % 2)
    top = at + len(below)
    return body + struct.pack(order + "I", top) + image + below + directory_bytes({**preview, SUB_IFDS: (LONG, [at])}, top, order)
