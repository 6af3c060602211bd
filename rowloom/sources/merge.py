"""Three-way merge of table files in any known encoding; the result has the profile of the base file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.threeway import TableMerge
from rowloom.plans.options import TableOptions, UsageError
from rowloom.sources import delimited, encoding, files, scratch


def profile_of(spark: SparkSession, path: str, enc: str = "") -> encoding.Profile:
    """Encoding, byte order mark and line ending of a file, from its first 8 KiB alone."""
    sample = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, encoding.SAMPLE)).first()
    if sample is None:
        raise UsageError(f"no file {path}")
    return encoding.profile(bytes(sample[0]), enc)


def as_utf8(spark: SparkSession, path: str, profile: encoding.Profile) -> str:
    """The path itself if the file is UTF-8 without a mark, else that of a copy in the shared folder that is; the suffix, by
    which a delimiter is told, stays."""
    if profile.encoding == "utf-8" and not profile.bom:
        return path
    name = path.rstrip("/").rsplit("/", 1)[-1].lower().removesuffix(".gz")
    text = spark.read.format("binaryFile").load(path).select(encoding.decode_column(F.col("content"), profile.encoding).alias("text"))
    at = scratch.path(spark, name)
    text.select(F.regexp_replace("text", "\\r?\\n$", "").alias("text")).write.text(at)
    return at


def csv_line(cells: list, delimiter: str) -> str:
    """A record in RFC 4180 text, quoted where it must be."""
    special = {delimiter, '"', "\n", "\r"}
    quote = lambda c: '"' + c.replace('"', '""') + '"' if special & set(c) else c
    return delimiter.join(quote(c or "") for c in cells)


def write_profiled(rows: DataFrame, folder: str, delimiter: str, profile: encoding.Profile, header: bool = True) -> int:
    """Write ``rows`` as delimited text below ``folder``, a file for each partition in the rows' order, as bytes of the profile;
    every file has the mark and the header. A character that the encoding lacks is an error. Returns the number of rows."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = files.store_of(folder)
        store.create_dir(root, recursive=True)
        at, n, out = f"{root}/part-{TaskContext.get().partitionId():05d}", 0, None
        for b in batches:
            lines = [csv_line(list(r.values()), delimiter) for r in b.to_pylist()]
            if out is None and lines:
                out = store.open_output_stream(f"{root}/.{TaskContext.get().partitionId()}-{TaskContext.get().attemptNumber()}")
                out.write(encoding.restore([csv_line(names, delimiter)] if header else [], profile))
            if lines:
                out.write(encoding.restore(lines, encoding.Profile(profile.encoding, False, profile.line_ending, True)))
            n += len(lines)
        if out is not None:
            out.close()
            store.move(f"{root}/.{TaskContext.get().partitionId()}-{TaskContext.get().attemptNumber()}", at)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])
    return text.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class FileMerge:
    """A three-way comparison of files, and how its result is written."""

    merge: TableMerge
    profile: encoding.Profile
    delimiter: str
    has_header: bool

    def write(self, folder: str, choices: DataFrame | None = None, allow_unresolved: bool = False) -> int:
        return write_profiled(self.merge.merge(choices, allow_unresolved), folder, self.delimiter, self.profile, self.has_header)


def compare_files(spark: SparkSession, base: str, left: str, right: str, options: TableOptions, enc: str = "", **how) -> FileMerge:
    """Compare three table files, each read in its own encoding; ``how`` goes to ``delimited.resolve``."""
    tables, first, profile = [], None, None
    for path in (base, left, right):
        p = profile_of(spark, path, enc)
        i = delimited.resolve(spark, as_utf8(spark, path, p), **how)
        first, profile = first or i, profile or p
        tables.append(delimited.read_table(spark, i))
    return FileMerge(TableMerge(*tables, options), profile, first.delimiter, first.has_header)
