"""Folders of files as a data source: a listing and its contents, read in parallel partitions, in batches or as a stream of new versions."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.files import SUPPORTED

FORMAT = "tessera_files"
SCHEMA = "path string, size long, version string, modified timestamp, sha256 string, content binary"
#: Bytes of files that one partition reads about, and bytes of a file that are read at a time.
PARTITION_BYTES, PIECE = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Found:
    """A file of a listing. A version is told by its time and size, as stores without versions do."""

    path: str
    size: int
    modified: int

    @property
    def version(self) -> str:
        return f"{self.modified}-{self.size}"


class Adapter:
    """Access to the files under a folder of any store that Arrow reads: list them, read one with a rolling digest, and describe one."""

    def __init__(self, root: str, suffixes: Sequence[str] = SUPPORTED):
        self.root, self.suffixes = root, tuple(s.lower() for s in suffixes)
        self.store, self.base = fs.FileSystem.from_uri(root)

    def iter_files(self) -> Iterator[Found]:
        """Files with a wanted suffix that aren't empty, in order of their paths; folders and their marker objects are passed over, and a missing folder has none."""
        found = self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True, recursive=True))
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.size and f.extension and f".{f.extension.lower()}" in self.suffixes:
                yield Found(f.path, f.size, f.mtime_ns)

    def download(self, path: str) -> tuple[bytes, str]:
        """Content and sha-256, computed as pieces come in."""
        digest, pieces = hashlib.sha256(), []
        with self.store.open_input_stream(path) as f:
            while piece := f.read(PIECE):
                digest.update(piece)
                pieces.append(piece)
        return b"".join(pieces), digest.hexdigest()

    def metadata(self, file: Found) -> dict[str, str | int]:
        """What a synced document keeps of its file: its place within the root, name, size and version."""
        inside = file.path[len(self.base) :].lstrip("/")
        return {"root": self.root, "key": inside, "name": inside.rsplit("/", 1)[-1], "size": file.size, "version": file.version}


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    files: list[Found]


def partitions(files: Sequence[Found], most: int = PARTITION_BYTES) -> list[Files]:
    """Files in their order, packed to about that many bytes; a larger file is alone."""
    packed: list[list[Found]] = []
    size = most
    for f in files:
        if size + f.size > most and (size or not packed):
            packed.append([])
            size = 0
        packed[-1].append(f)
        size += f.size
    return [Files(p) for p in packed]


def rows(adapter: Adapter, files: Sequence[Found], content: bool) -> Iterator[tuple]:
    for f in files:
        body, digest = adapter.download(f.path) if content else (None, None)
        yield f.path, f.size, f.version, datetime.datetime.fromtimestamp(f.modified // 1000 / 1e6, datetime.timezone.utc), digest, body


class _Options:
    def __init__(self, options: dict[str, str]):
        suffixes = options.get("suffixes")
        self.root = options["path"]
        self.suffixes = tuple(suffixes.split(",")) if suffixes else SUPPORTED
        self.content = options.get("content", "true").lower() == "true"
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def adapter(self) -> Adapter:
        return Adapter(self.root, self.suffixes)


class BatchReader(DataSourceReader):
    """All files of the listing as it is now."""

    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Files]:
        return partitions(list(self.options.adapter().iter_files()), self.options.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(self.options.adapter(), partition.files, self.options.content)


class StreamReader(DataSourceStreamReader):
    """Files as versions of them appear. The offset is the time and path of the newest version seen.

    A file that changes again before its batch is read comes with the later batch only. A version whose time lies before the
    offset is not seen, so files must be given the time at which they are put there, as stores do.
    """

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        newest = max(((f.modified, f.path) for f in self.options.adapter().iter_files()), default=(-1, ""))
        return {"modified": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        fresh = [f for f in self.options.adapter().iter_files() if low < (f.modified, f.path) <= high]
        return partitions(fresh, self.options.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(self.options.adapter(), partition.files, self.options.content)



class FileListing(DataSource):
    """``spark.read.format("tessera_files").load(folder)`` after ``register``. Options: suffixes (comma-separated), content (false leaves contents and digests out), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(_Options(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileListing)
