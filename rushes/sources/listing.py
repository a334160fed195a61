"""Listings of footage folders as a Spark data source: path, size and time, no content."""

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(path: str):
    """(file system, path in it) of a path as Spark writes it: plain, file:/..., or a store's address that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    """The driver lists the root alone. A task lists one folder of the root with all that is below it, and one the root's own files."""

    def __init__(self, root: str, glob: str):
        self.root, self.glob = root, glob

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.root)
        below = system.get_file_info(fs.FileSelector(root))
        return [Folder(self.root, False)] + [Folder(self.root.rstrip("/") + "/" + f.base_name, True) for f in sorted(below, key=lambda f: f.path) if f.type == fs.FileType.Directory]

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import fs

        system, inner = file_system(partition.path)
        open_ = [(inner, partition.path)]
        while open_:
            at, name = open_.pop()
            found = sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.path)
            if partition.deep:
                open_ += [(f.path, f"{name}/{f.base_name}") for f in found if f.type == fs.FileType.Directory]
            files = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.glob)]
            if files:
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{f.base_name}" for f in files]), pa.array([f.size for f in files], pa.int64()), pa.array([f.mtime for f in files], pa.timestamp("us", "UTC"))], names=["path", "size", "mtime"])


class FootageFiles(DataSource):
    """spark.read.format("footage_files").option("glob", "*.dng").load(root)"""

    @classmethod
    def name(cls):
        return "footage_files"

    def schema(self):
        return "path string, size long, mtime timestamp"

    def reader(self, schema):
        return FolderReader(self.options["path"], self.options.get("glob", "*"))


def scan_files(spark: SparkSession, root: str, glob: str = "*.dng") -> DataFrame:
    """path, size, mtime of the files below a folder whose names match; empty files too, nothing is opened.

    Each folder of the root is listed by a task of its own, folder by folder, so a task holds one folder's names.
    """
    spark.dataSource.register(FootageFiles)
    return spark.read.format("footage_files").option("glob", glob).load(root)
