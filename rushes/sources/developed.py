"""Developed frames as files: a sink with one commit for each frame."""

import os
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rushes.operators.develop import quantise_8bit
from rushes.sources import tiff
from rushes.sources.listing import file_system


class FrameWriter(DataSourceArrowWriter):
    """Writes each frame under a name of its own task, then moves it to its place: a frame is there whole or not at all.

    A task that runs again, or beside another one like it, moves the same bytes to the same place.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        open_ = None
        for batch in iterator:
            table = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("frame", "y", "x", "r8", "g8", "b8", "width", "height")}
            frame = table["frame"]
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(frame[1:] != frame[:-1]) + 1, len(frame)].tolist())):
                if a == b:
                    continue
                if open_ is None or open_.frame != frame[a]:
                    if open_ is not None:
                        open_.finish()
                    open_ = FrameFile(system, folder, frame[a], int(table["width"][a]), int(table["height"][a]))
                open_.add({c: v[a:b] for c, v in table.items()})
        if open_ is not None:
            open_.finish()
        return WriterCommitMessage()


class FrameFile:
    """One frame as a TIFF file: directory first, then its 8-bit rows in one strip, written as they come."""

    def __init__(self, system, folder, frame, width: int, height: int):
        self.system, self.frame, self.left = system, frame, width * height
        name = re.sub(r"[^0-9A-Za-z_-]", "_", str(frame))
        self.place, self.work = f"{folder}/{name}.tif", f"{folder}/.{name}.{uuid.uuid4().hex}"
        tags = {256: (tiff.LONG, [width]), 257: (tiff.LONG, [height]), 258: (tiff.SHORT, [8, 8, 8]), 259: (tiff.SHORT, [1]), 262: (tiff.SHORT, [2]), 277: (tiff.SHORT, [3]), 278: (tiff.LONG, [height]), 273: (tiff.LONG, [0]), 279: (tiff.LONG, [3 * width * height])}
        begin = 8 + len(tiff.directory_bytes(tags, 8, "<"))
        self.file = system.open_output_stream(self.work)
        self.file.write(b"II*\0\x08\0\0\0" + tiff.directory_bytes({**tags, 273: (tiff.LONG, [begin])}, 8, "<"))

    def add(self, rows):
        self.left -= len(rows["y"])
        self.file.write(np.column_stack([rows[c] for c in ("r8", "g8", "b8")]).astype(np.uint8).tobytes())

    def finish(self):
        self.file.close()
        if self.left:
            raise ValueError("a frame is no whole rectangle of samples")
        self.system.move(self.work, self.place)


class DevelopedFrames(DataSource):
    @classmethod
    def name(cls):
        return "developed_frames"

    def writer(self, schema, overwrite):
        return FrameWriter(self.options["path"])


def write_developed(rgb: DataFrame, path: str) -> None:
    """One TIFF file <frame>.tif of 8-bit samples for each frame of rgb (frame, y, x, r, g, b); null channels are black.

    A frame's rows reach one task in order, which writes them as they come. Frames that are
    there already are replaced by the same or a newer whole file. What a killed task leaves
    begins with a dot; clean_developed removes it when no write is running.
    """
    spark = rgb.sparkSession
    spark.dataSource.register(DevelopedFrames)
    rows = quantise_8bit(rgb.fillna(0.0, ["r", "g", "b"])).select("frame", "y", "x", "r8", "g8", "b8")
    sizes = rows.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    # both sides are parted by frame, so samples are shuffled once
    sized = rows.repartition("frame").join(sizes, "frame")
    sized.sortWithinPartitions("frame", "y", "x").write.format("developed_frames").option("path", path).mode("append").save()


def clean_developed(path: str) -> int:
    """Removes what killed tasks left; how many files that were."""
    from pyarrow import fs

    system, folder = file_system(path)
    left = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if os.path.basename(f.path).startswith(".")]
    for f in left:
        system.delete_file(f)
    return len(left)
