"""A Spark data source for raw bytes as files named by their content: ``raw/<source>/<hh>/<sha256>.<ext>`` below a root.

Writing takes rows (path, content), the path below the root. A task writes each file under a temporary name of its own and
renames it, so that a file is either whole or not there, whatever fails; a name that is there already is left as it is,
as it stands for the same bytes. The driver learns how many files and bytes each task wrote, nothing more; it deletes
what failed attempts have left. The root is any path that pyarrow's file systems know (a mounted folder, HDFS, S3).

Reading gives the same rows. A partition is all folders of one name <hh>, and its task lists them, so that neither the number of
partitions nor what the driver holds grows with the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "raw_files"
#: Names of folders that writing makes, and the bytes of a batch of files.
PREFIXES = tuple(f"{k:02x}" for k in range(256))
BATCH = 16 << 20


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class RawFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.root)
        own, files, size, made = f"{root}/_writing/{self.job}", 0, 0, set()
        fs.create_dir(own, recursive=True)
        for batch in iterator:
            paths = [f"{root}/{p}" for p in batch.column("path").to_pylist()]
            there = {i.path for i in fs.get_file_info(paths) if i.type != pafs.FileType.NotFound}
            for path, content in zip(paths, batch.column("content"), strict=True):
                if path in there:
                    continue
                folder, name = path.rsplit("/", 1)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                temporary = f"{own}/{uuid.uuid4().hex}"
                content = content.as_buffer()
                with fs.open_output_stream(temporary) as out:
                    out.write(content)
                fs.move(temporary, path)
                files, size = files + 1, size + content.size
        return Written(files, size)

    def tidy(self) -> None:
        fs, root = file_system(self.root)
        if fs.get_file_info(f"{root}/_writing/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_writing/{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        self.tidy()

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are there stay: each is whole, and the next run of the job would write the same."""
        self.tidy()


@dataclass
class Folders(InputPartition):
    """The folders of one name, or those of no usual name; all their files, or those with a few hashes."""

    prefix: str | None
    hashes: tuple[str, ...] | None = None


class RawFilesReader(DataSourceReader):
    def __init__(self, root: str, hashes: list[str] | None):
        self.root, self.hashes = root.rstrip("/"), hashes

    def partitions(self) -> list[Folders]:
        fs, root = file_system(self.root)
        if fs.get_file_info(f"{root}/raw").type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no raw files below {self.root}")
        if self.hashes is None:
            return [Folders(p) for p in (*PREFIXES, None)]
        return [Folders(p, tuple(h for h in self.hashes if h[:2] == p)) for p in sorted({h[:2] for h in self.hashes})]

    def files(self, fs: pafs.FileSystem, raw: str, partition: Folders) -> Iterator[pafs.FileInfo]:
        missing = set(partition.hashes or ())
        for source in fs.get_file_info(pafs.FileSelector(raw)):
            if source.type != pafs.FileType.Directory:
                continue
            folders = [f"{source.path}/{partition.prefix}"]
            if partition.prefix is None:
                folders = [i.path for i in fs.get_file_info(pafs.FileSelector(source.path)) if i.type == pafs.FileType.Directory and i.base_name not in PREFIXES]
            for folder in folders:
                for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                    if i.type == pafs.FileType.File and "." in i.base_name[1:] and not i.base_name.startswith("."):
                        named = i.base_name.split(".", 1)[0]
                        if partition.hashes is None or named in partition.hashes:
                            missing.discard(named)
                            yield i
        if missing:
            raise FileNotFoundError(f"no raw file of {', '.join(sorted(missing))}")

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.root)
        paths, contents, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        for i in self.files(fs, f"{root}/raw", partition):
            with fs.open_input_stream(i.path) as stream:
                content = stream.read()
            paths.append("/".join(i.path.rsplit("/", 4)[1:]))
            contents.append(content)
            size += len(content)
            if size >= BATCH:
                yield batch()
                paths, contents, size = [], [], 0
        if paths:
            yield batch()


class RawFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> RawFilesWriter:
        return RawFilesWriter(self.options["path"])

    def reader(self, schema) -> RawFilesReader:
        hashes = self.options.get("hashes")
        return RawFilesReader(self.options["path"], None if hashes is None else json.loads(hashes))
