"""A folder of documents as a data source for batch and streaming reads: spark.read.format("documents").load(path)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import TYPES, _parse, kind_of

UNITS = "doc_id string, page int, text string, source string, source_type string, file_hash string, error string"

#: Bytes of files that one task reads, unless the option partitionBytes says otherwise; a file is never split.
PARTITION_BYTES = 32 << 20


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is a local or mounted one, which all executors need to see."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool) -> list[tuple[int, str, int]]:
    """(nanoseconds of the last change, path, bytes) of the files of a known type below a folder, or of the one file `path`."""
    system, inside = place(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.mtime_ns or 0, info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(inside, recursive=recursive))
    return [(f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and kind_of(f.path) in TYPES]


class Reading:
    """Partitions and rows, for batches and streams alike."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.on_error = options.get("onError", "row")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        if self.on_error not in ("row", "raise"):
            raise ValueError("onError is row or raise")

    def files(self) -> list[tuple[int, str, int]]:
        return listed(self.path, self.recursive)

    def parted(self, files: list[tuple[int, str, int]]) -> list[Files]:
        """Files by path, in runs of about `most` bytes."""
        runs: list[list[str]] = []
        size = self.most
        for _, path, n in sorted(files, key=lambda f: f[1]):
            if size + n > self.most and (size or not runs):
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [Files(tuple(r)) for r in runs]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = place(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                raw = stream.read()
            units, error = _parse(path, raw)
            if error and self.on_error == "raise":
                raise ValueError(f"{path}: {error}")
            doc_id = None if error else hashlib.sha256("\n".join(t for _, t in units).encode()).hexdigest()[:16]
            own = path.rsplit("/", 1)[-1], kind_of(path), hashlib.sha256(raw).hexdigest()[:16], error
            for page, text in units or [(1, "")]:
                yield (doc_id, page, text, *own)


class BatchReader(Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.parted(self.files())


class StreamReader(Reading, DataSourceStreamReader):
    """Offsets are the last change and path of the newest file taken; a file that comes with an older time than that is not seen."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        changed, path, _ = max(self.files(), default=(-1, "", 0))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        return self.parted([f for f in self.files() if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass


class DocumentFolder(DataSource):
    """Units of the documents in a folder, as `files.units` has them.

    Options: recursive (true), onError (`row`: a bad file is a row with its
    error; `raise`: it ends the job), partitionBytes.  A folder's files of
    other types are passed over; a single file of one is an error.  Rows come
    in the order of the paths.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return UNITS

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes `documents` a format of the session."""
    spark.dataSource.register(DocumentFolder)
