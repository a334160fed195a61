"""Image data of footage files by strips and tiles: one row and one ranged read for each, decoded in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushes.operators.metadata import support_status
from rushes.sources.listing import file_system

PLACES = "path string, segment int, offset long, bytes long, bits int, segment_w long, y long, x long, rows long, columns long"
DECODED = "path string, segment int, status string, y long, x long, rows long, columns long, samples array<int>"


def unpacked(data: bytes, bits: int) -> np.ndarray:
    """Samples of 8, 16 (low byte first) or 10, 12, 14 bits (highest bit first, without padding between rows)."""
    if bits == 8:
        return np.frombuffer(data, np.uint8)
    if bits == 16:
        return np.frombuffer(data[: len(data) // 2 * 2], "<u2")
    n = len(data) * 8 // bits
    at = np.arange(n) * bits
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint32)
    first = at >> 3
    window = raw[first] << 16 | raw[first + 1] << 8 | raw[first + 2]
    return (window >> (24 - bits - (at & 7)).astype(np.uint32)) & np.uint32((1 << bits) - 1)


def segment_places(meta: DataFrame) -> DataFrame:
    """A row (PLACES) for each strip or tile of the uncompressed frames of read_headers that can be decoded: where it lies in the file and in the image.

    rows and columns are what shows; segment_w is the width of its rows in the file. Strips split the image's
    rows evenly, the last one takes what is left.
    """
    good = support_status(meta).where("support = 'None' and compression = 1")
    each = good.select("path", "bits", "width", "height", "tiled", "tile_w", "tile_h", F.size("offsets").alias("n"), F.posexplode(F.arrays_zip("offsets", "byte_counts")).alias("segment", "s"))
    across = F.ceil(F.col("width") / F.col("tile_w"))
    strip = F.ceil(F.col("height") / F.col("n"))
    y = F.when(F.col("tiled"), F.floor(F.col("segment") / across) * F.col("tile_h")).otherwise(F.col("segment") * strip)
    x = F.when(F.col("tiled"), F.col("segment") % across * F.col("tile_w")).otherwise(0)
    h, w = (F.when(F.col("tiled"), F.col(t)).otherwise(o) for t, o in (("tile_h", strip), ("tile_w", F.col("width"))))
    out = each.select("path", "segment", "s.offsets", "s.byte_counts", F.col("bits").cast("int").alias("bits"), w.cast("long").alias("segment_w"), y.cast("long").alias("y"), x.cast("long").alias("x"), F.least(h, F.col("height") - y).cast("long").alias("rows"), F.least(w, F.col("width") - x).cast("long").alias("columns"))
    return out.withColumnsRenamed({"offsets": "offset", "byte_counts": "bytes"})


def read_segments(places: DataFrame, parts: int | None = None) -> DataFrame:
    """DECODED rows: the samples of each segment that show, row by row, without padding.

    Segments are dealt to tasks one by one, so a frame's may be read by many. A segment
    that cannot be read, or is too short, has status BadImageData and no samples.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                samples, status = None, "BadImageData"
                try:
                    system, inner = file_system(r["path"])
                    with system.open_input_file(inner) as file:
                        data = file.read_at(r["bytes"], r["offset"]) if r["offset"] < file.size() else b""
                    need = -(-r["segment_w"] * r["rows"] * r["bits"] // 8)
                    if len(data) >= need:
                        flat = unpacked(data, r["bits"])[: r["segment_w"] * r["rows"]]
                        samples, status = flat.reshape(r["rows"], r["segment_w"])[:, : r["columns"]].ravel().astype(np.int32), "None"
                except OSError:
                    pass
                one = {k: [r[k]] for k in ("path", "segment", "y", "x", "rows", "columns")} | {"status": [status], "samples": [samples]}
                kinds = {"path": pa.string(), "segment": pa.int32(), "status": pa.string(), "samples": pa.list_(pa.int32())}
                names = [c.split()[0] for c in DECODED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(one[n], kinds.get(n, pa.int64())) for n in names], names=names)

    count = parts or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(count, "path", "segment").mapInArrow(run, DECODED)


def segment_pixels(segments: DataFrame) -> DataFrame:
    """path, y, x, v of decoded segments in long form, for the mosaic operators."""
    each = segments.where("status = 'None'").select("path", F.col("y").alias("_y"), F.col("x").alias("_x"), "columns", F.posexplode("samples").alias("i", "v"))
    return each.select("path", (F.col("_y") + F.floor(F.col("i") / F.col("columns"))).alias("y"), (F.col("_x") + F.col("i") % F.col("columns")).alias("x"), "v")
