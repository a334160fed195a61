"""Headers of footage files as tables: TIFF tags by byte ranges, JPEG frame headers."""

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushes.sources.listing import file_system, scan_files
from rushes.sources.tiff import MOST_BYTES, Ranges, tags_of

__all__ = ["META", "compression_census", "frame_header", "ingest_headers", "read_headers", "scan_files"]

#: Columns of one value: the first of their tag.
ONE = {"width": "long", "height": "long", "bits": "long", "compression": "long", "photometric": "long", "orientation": "long", "tile_w": "long", "tile_h": "long", "illuminant1": "long", "illuminant2": "long", "black_level": "double", "white_level": "double", "baseline_exposure": "double"}
#: Columns of all values of their tag, which must be so many (0: any number); else null.
ALL = {"cfa": ("int", 0), "cfa_dims": ("int", 0), "linearisation": ("int", 0), "timecode": ("int", 0), "color_matrix1": ("double", 9), "color_matrix2": ("double", 9), "forward_matrix1": ("double", 9), "forward_matrix2": ("double", 9), "neutral": ("double", 3), "white_xy": ("double", 2), "scale": ("double", 2), "crop_origin": ("long", 2), "crop_size": ("long", 2), "active_area": ("long", 4)}
META = "path string, status string, bytes_read long, " + ", ".join([f"{n} {t}" for n, t in ONE.items()] + [f"{n} array<{t}>" for n, (t, _) in ALL.items()]) + ", model string, rate_num long, rate_den long, tiled boolean, offsets array<long>, byte_counts array<long>"
KINDS = {"long": int, "int": int, "double": float}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
#: META for Arrow.
FIELDS = pa.schema([(n, pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t]) for n, t in (c.split() for c in META.split(", "))])


def header_row(path: str, ranges: Ranges) -> dict:
    """The columns of META for one file; status BadFile for one that is no TIFF, ends too early or has no image size."""
    row = dict.fromkeys(FIELDS.names) | {"path": path, "status": "BadFile"}
    try:
        tags = tags_of(ranges)
        for name, kind in ONE.items():
            row[name] = KINDS[kind](tags[name][0]) if tags[name] else None
        for name, (kind, size) in ALL.items():
            values = [KINDS[kind](v) for v in tags[name]]
            row[name] = values if size in (0, len(values)) else None
        row["timecode"] = row["timecode"] or None
        row["model"] = tags["model"][0] if tags["model"] else ""
        row["rate_num"], row["rate_den"] = tags["rate"] or (None, None)
        row |= {k: tags[k] for k in ("tiled", "offsets", "byte_counts")}
        row["status"] = "None" if row["width"] and row["height"] else "BadFile"
    except (ValueError, TypeError, IndexError, OverflowError, struct.error):
        row = dict.fromkeys(row) | {"path": path, "status": "BadFile"}
    return row | {"bytes_read": ranges.read}


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=FIELDS)


def ingest_headers(files: DataFrame) -> DataFrame:
    """One row of META for each (path, content), for contents that are at hand; null or unreadable content gives status BadFile.

    Content may be the head of a file, if its directories and their values stand there.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = []
            for path, content in zip(rows.column(0).to_pylist(), rows.column(1)):
                data = memoryview(content.as_buffer()) if content.is_valid else b""
                found.append(header_row(path, Ranges(lambda at, n, data=data: bytes(data[at : at + n]))))
            yield _rows(found)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(parse, META)


def read_headers(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """One row of META for each path of a listing (scan_files), by byte ranges: directory offsets are followed, image data is not read.

    A file costs the 4096-byte blocks its tags lie in, most bytes at the utmost; one
    that asks for more, is missing or cannot be read has status BadFile. A store that Arrow
    doesn't know fails the job: for such, read with Spark and use ingest_headers.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = []
            for path in rows.column(0).to_pylist():
                ranges = Ranges(lambda at, n: b"", most)
                if path is not None:
                    system, inner = file_system(path)
                    try:
                        with system.open_input_file(inner) as file:
                            size = file.size()
                            ranges.fetch = lambda at, n: file.read_at(max(0, min(n, size - at)), at) if at < size else b""
                            found.append(header_row(path, ranges))
                        continue
                    except OSError:
                        pass
                found.append({"path": path, "status": "BadFile", "bytes_read": ranges.read})
            yield _rows(found)

    return files.select("path").mapInArrow(parse, META)


def frame_header(data: bytes | None) -> dict:
    """process, precision, components of a JPEG's first frame header; all null where it is not sound."""
    nothing = {"process": None, "precision": None, "components": None}
    if data is None or data[:2] != b"\xff\xd8":
        return nothing
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        (size,) = struct.unpack_from(">H", data, at + 2)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(data):
                return nothing
            precision, height, width, parts = struct.unpack_from(">BHHB", data, at + 4)
            sound = 2 <= precision <= 16 and height and width and size == 3 * parts + 8
            return {"process": marker - 0xC0, "precision": precision, "components": parts} if sound else nothing
        at += 2 + size
    return nothing


def compression_census(segments: DataFrame) -> DataFrame:
    """lossy, precision, components, n over the first segments of clips. segments: compression, bits, head (first bytes).

    Only JPEG of 12 or 16 bits can be lossy: at that precision and by another process than the lossless one.
    """

    @F.pandas_udf("process int, precision int, components int")
    def header(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([frame_header(h) for h in heads], columns=["process", "precision", "components"]).astype("Int32")

    jpeg = (F.col("compression") == 7) & F.col("bits").isin(12, 16)
    read = segments.withColumn("h", header(F.when(F.col("compression") == 7, F.col("head"))))
    lossy = F.coalesce(jpeg & F.col("h.precision").isin(12, 16) & (F.col("h.process") != 3), F.lit(False))
    return read.groupBy(lossy.alias("lossy"), F.col("h.precision").alias("precision"), F.col("h.components").alias("components")).agg(F.count("*").alias("n"))
