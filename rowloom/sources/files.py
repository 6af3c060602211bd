"""File trees and archives as tables, through a Spark data source; documents, listings and inline texts."""

from __future__ import annotations

import os
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowloom.plans.options import CompareError, UsageError
from rowloom.sources import encoding

SCHEMA = "path string, size bigint, mtime timestamp, content binary"
ENTRY_BYTES, ARCHIVE_BYTES, ENTRIES = 64 << 20, 256 << 20, 2_000_000
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz")
LISTING = 2000


class _Files(InputPartition):
    def __init__(self, files: list):
        super().__init__(0)
        self.files = files


class TreeSource(DataSource):
    """``spark.read.format("rowloom_tree").load(path)``: regular files below a folder or in an archive.

    Links are skipped. Options: ``content`` (true), ``prune`` (names of folders not to enter, by commas), ``slices``,
    ``entry_bytes`` and ``archive_bytes`` (limits for archives).
    """

    @classmethod
    def name(cls) -> str:
        return "rowloom_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a URI or of a local path."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    try:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise UsageError(f"can't walk {path}: {e}") from e


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.prune = {p for p in options.get("prune", "").split(",") if p}
        self.slices = int(options.get("slices", "8"))
        self.entry_bytes = int(options.get("entry_bytes", ENTRY_BYTES))
        self.archive_bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))

    def partitions(self):
        store, root = store_of(self.path)
        kind = store.get_file_info(root).type
        if kind == fs.FileType.File:
            if not root.lower().endswith(ARCHIVES):
                raise UsageError(f"{self.path} is neither a folder nor an archive")
            return [_Files([])]
        if kind != fs.FileType.Directory:
            raise UsageError(f"no folder {self.path}")
        local = isinstance(store, fs.LocalFileSystem)
        found, folders = [], [root]
        while folders:
            for e in store.get_file_info(fs.FileSelector(folders.pop())):
                if local and os.path.islink(e.path):
                    continue
                if e.type == fs.FileType.Directory and e.base_name not in self.prune:
                    folders.append(e.path)
                elif e.type == fs.FileType.File:
                    found.append((e.path, e.size, (e.mtime_ns or 0) // 1000))
        found.sort()
        n = max(1, min(self.slices, len(found)))
        return [_Files(found[i::n]) for i in range(n)]

    def read(self, partition) -> Iterator[tuple]:
        store, root = store_of(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            with store.open_input_file(root) as raw:
                yield from archive_entries(root, self.entry_bytes, self.archive_bytes, self.content, raw)
            return
        for path, size, mtime in partition.files:
            data = None
            if self.content:
                with store.open_input_stream(path) as h:
                    data = h.read()
            yield path[len(root) :].lstrip("/"), size, datetime.fromtimestamp(mtime / 1e6, timezone.utc), data


def archive_entries(path: str, entry_bytes: int = ENTRY_BYTES, archive_bytes: int = ARCHIVE_BYTES, content: bool = True, raw=None) -> Iterator[tuple]:
    """(path, size, mtime, content) of an archive's regular files, within limits on what they unpack to; ``raw``: the open file."""
    total = 0

    def check(name: str, size: int) -> None:
        nonlocal total
        total += size
        if size > entry_bytes:
            raise CompareError(f"{name} unpacks to more than {entry_bytes} bytes")
        if total > archive_bytes:
            raise CompareError(f"{path} unpacks to more than {archive_bytes} bytes")

    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(raw or path) as z:
            for e in z.infolist():
                if not e.is_dir():
                    check(e.filename, e.file_size)
                    yield e.filename, e.file_size, datetime(*e.date_time, tzinfo=timezone.utc), z.read(e) if content else None
    else:
        with tarfile.open(None if raw else path, fileobj=raw) as t:
            for e in t:
                if e.isfile():
                    check(e.name, e.size)
                    yield e.name.removeprefix("./"), e.size, datetime.fromtimestamp(e.mtime, timezone.utc), t.extractfile(e).read() if content else None


def read_tree(spark: SparkSession, path: str, content: bool = True, **options) -> DataFrame:
    """(path, size, mtime, content) of a folder or archive."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("rowloom_tree").options(content=str(content).lower(), **options).load(path)


def write_tree(files: DataFrame, folder: str) -> int:
    """Write ``files`` (path, content) below ``folder``, each task its own, and return how many; a path that leaves the folder
    is an error. A file is written under another name and then renamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise UsageError(f"{path} is outside the folder")
                at = f"{root}/{path}"
                store.create_dir(os.path.dirname(at), recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as h:
                    h.write(data or b"")
                store.move(part, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_document(spark: SparkSession, path: str, name: str = "", enc: str = "", max_line: int = 64 << 20, pre: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name, text) of a file in any known encoding; binary data and over-long lines are errors. ``pre`` prepares the rows, and
    runs where they are."""
    if os.path.isdir(path.removeprefix("file://")):
        raise CompareError(f"{path} is a folder")
    files = spark.read.format("binaryFile").load(path)
    text = encoding.decode_column(F.col("content"), enc)
    out = files.select(F.lit(name or path).alias("name"), text.alias("text"))
    longest = F.aggregate(F.transform(F.split("text", "\r\n|\r|\n"), F.length), F.lit(0), lambda a, b: F.greatest(a, b))
    bad = F.when(F.col("text").isNull(), F.raise_error(F.lit("binary content"))).when(longest > max_line, F.raise_error(F.lit("a line is too long")))
    out = out.select("name", F.coalesce(bad.cast("string"), "text").alias("text"))
    return out.transform(pre) if pre else out


def read_lines(spark: SparkSession, path: str, max_line: int = 64 << 20) -> DataFrame:
    """(line) of UTF-8 files of any length, read in splits, no file in one cell; lines end at LF, CRLF or CR, and one of more than
    ``max_line`` bytes is an error."""
    rows = spark.read.text(path)
    long = F.when(F.octet_length("value") > max_line, F.raise_error(F.lit("a line is too long")))
    return rows.select(F.coalesce(long.cast("string"), "value").alias("line"))


def inline(spark: SparkSession, old: str | None, new: str | None, pre: Callable[[str], str] | None = None) -> DataFrame:
    """(old, new) of pasted texts; an absent side is an empty document; ``pre`` prepares each text on the driver."""
    run = lambda t: pre(t or "") if pre else (t or "")
    return spark.createDataFrame([(run(old), run(new))], "old string, new string")


def write_archive(files: DataFrame, path: str) -> int:
    """Write ``files`` (path, content) to one zip archive, in path order, and return how many; one task, as it is one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        n = 0
        with store.open_output_stream(f"{at}.part") as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for b in batches:
                    for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                        z.writestr(zipfile.ZipInfo(name), data or b"", zipfile.ZIP_DEFLATED)
                        n += 1
        store.move(f"{at}.part", at)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("path", "content").orderBy("path").coalesce(1).mapInArrow(run, "n long").first()[0]


def list_folder(spark: SparkSession, path: str, most: int = LISTING) -> DataFrame:
    """(name, path, directory, size) of a folder's first entries in name order; ``~`` is the home folder."""
    store, root = store_of(path if "://" in path else os.path.expanduser(path))
    found = sorted(store.get_file_info(fs.FileSelector(root)), key=lambda e: e.base_name)[:most]
    rows = [(e.base_name, e.path, e.type == fs.FileType.Directory, 0 if e.type == fs.FileType.Directory else e.size) for e in found]
    return spark.createDataFrame(rows, "name string, path string, directory boolean, size bigint")


def path_info(path: str) -> tuple[str, bool]:
    full = os.path.abspath(os.path.expanduser(path))
    return full, os.path.isdir(full)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
