"""WARC archives in per-record zstandard frames behind a dictionary frame: writer and reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one zstandard frame for each record,
all compressed with it. Equal payloads of ``REVISIT`` bytes or more are stored once: the row with the largest id is the
response, the others are revisit records that name it. Archives roll over at ``ROLL`` bytes and are written under a
temporary name and renamed, in an order that is the same in every attempt of a task, so a repeated task leaves the
same files. Pages whose payload has no copies are archived where they are read: a bit map of the others' ids tells which.
The reader streams an archive, one frame in memory at a time, and checks the frame's magic, the version line,
the header fields, Content-Length against the bytes there are, the closing blank lines, the payload's digest, and that there
is a response of the id, digest and length that a revisit names.

Defined cases: null html is an empty payload; empty tables give no archive and an empty result; rows with one page_id and
equal payloads are interchangeable, the first of them counts as the one with the largest id; a null page_id is written as
``null``, comes before all ids, and reads back as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import sieve, store

REVISIT = 1000
ROLL = 16 << 20
DICT_BYTES, DICT_FROM, LEVEL = 1 << 16, 1 << 20, 3
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def record_bytes(page_id, url: str, kind: str, refers_to, payload: bytes, digest: str, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own but names size and digest of the one it stands for."""
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    block = payload if kind == "response" else b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(s: str | None) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c) & 255) for c in (s or ""))


def train(samples: list[bytes]) -> bytes:
    """A dictionary from an archive's first records; their bytes themselves where there are too few to train on."""
    if sum(map(len, samples)) >= 8 * DICT_BYTES:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICT_BYTES] or b"WARC/1.1"


def load(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark writes it; a store that only Spark's file systems reach is refused."""
    try:
        return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ArchiveError(f"archives can't be kept under {uri}: {e}") from e


def write_archives(folder: str, task: int, records: Iterator[bytes], roll: int = ROLL) -> Iterator[tuple[str, int]]:
    """Write records to ``folder`` (a URI); yields (file, records) of each archive."""
    files, root = opened(folder)
    files.create_dir(root, recursive=True)
    number, held, size = 0, [], 0

    def flush() -> tuple[str, int]:
        name = f"part-{task:05d}-{number:05d}.warc.zst"
        first, seen = [], 0
        for r in held:
            if seen >= DICT_FROM:
                break
            first.append(r)
            seen += len(r)
        raw = train(first)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=load(raw))
        with files.open_output_stream(f"{root}/.{name}") as out:
            out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
            for r in held:
                out.write(packer.compress(r))
        files.move(f"{root}/.{name}", f"{root}/{name}")
        return f"{folder}/{name}", len(held)

    for r in records:
        held.append(r)
        size += len(r)
        if size >= roll:
            yield flush()
            number, held, size = number + 1, [], 0
    if held:
        yield flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive; ``stream`` has read(n)."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise ArchiveError("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ArchiveError("the dictionary frame is cut short")
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    words = load(raw)
    rest = b""
    while True:
        rest = rest or stream.read(1 << 16)
        if not rest:
            return
        while len(rest) < 4 and (more := stream.read(1 << 16)):
            rest += more
        if len(rest) < 4 or struct.unpack("<I", rest[:4])[0] != FRAME_MAGIC:
            raise ArchiveError("no zstandard frame where a record should begin")
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        out = []
        while True:
            try:
                out.append(one.decompress(rest))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a damaged frame: {e}") from e
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(1 << 16)
            if not rest:
                raise ArchiveError("the last frame is cut short")
        yield parse(b"".join(out))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, found, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ArchiveError(f"a bad header line: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ArchiveError(f"{need} is missing")
    n = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if n < 0 or len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length does not match the record")
    return fields, body[:n]


def _number(urn: str):
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def describe(fields: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD; a response's length and digest are those of the bytes that were read."""
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
        raise ArchiveError("a payload does not match its digest")
    refers = _number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return _number(fields["warc-record-id"]), size, digest, kind, refers


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, kind, refers_to), html null for revisits; payloads are moved once, by id and
    digest, never by digest alone, so that a payload many pages share is not gathered."""
    html = F.coalesce("html", F.lit(""))
    p = store.columns(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"))
    p = p.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    ids = p.groupBy("digest", "size", "page_id").agg(F.count("*").alias("m"))
    top = ids.filter(F.col("size") >= REVISIT).groupBy("digest").agg(F.max("page_id").alias("top"), F.sum("m").alias("copies")).filter("copies > 1")
    named = store.keep(
        ids.join(top, "digest").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "top", F.col("m").alias("rows")), "warc-copies"
    )
    found = sieve.broadcast(p.sparkSession, named.filter("__id is not null").select(F.col("__id").alias("key")))
    some = p.filter("page_id is not null").withColumn("id", F.col("page_id").cast("long"))
    rest = sieve.rows_in(some, found, False, "id").drop("id")
    p = sieve.rows_in(some, found, True, "id").drop("id").unionByName(p.filter("page_id is null"))
    on = p["page_id"].eqNullSafe(F.col("__id")) & (p["digest"] == F.col("__digest"))
    j = p.join(named.withColumn("copy", F.lit(True)), on, "left")
    # only rows that repeat the id of a response are put in order
    repeated = F.coalesce(F.col("page_id").eqNullSafe(F.col("top")) & F.col("copy") & (F.col("rows") > 1), F.lit(False))
    first = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    single = F.col("copy").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    j = j.filter(~repeated).withColumn("kind", F.when(single, "response").otherwise("revisit")).unionByName(
        j.filter(repeated).withColumn("kind", F.when(first == 1, "response").otherwise("revisit"))
    )
    j = j.select(
        "page_id", "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "digest", "size", "kind",
        F.when(F.col("kind") == "revisit", F.col("top")).alias("refers_to"),
    )
    return j.unionByName(rest.withColumns({"kind": F.lit("response"), "refers_to": F.lit(None).cast("long")}))


def write(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Archive all ``pages`` (page_id, url, html) under ``folder``, by default in the shared folder: (file, records)."""
    spark = pages.sparkSession
    folder = store.qualified(spark, folder or store.new_path(spark, "warc"))
    opened(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    for r in b.slice(at, 256).to_pylist():
                        yield record_bytes(r["page_id"], r["url"], r["kind"], r["refers_to"], (r["html"] or "").encode(), r["digest"], r["size"])

        done = list(write_archives(folder, TaskContext.get().partitionId(), records(), roll))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "records"])

    rows = plan_records(pages).sortWithinPartitions("page_id", "digest", "kind", "url")
    return store.keep(rows.mapInArrow(run, "file string, records long"), "warc-files")


def read(files: DataFrame) -> DataFrame:
    """All records of the archives named in ``files`` (file, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for name in b.column("file").to_pylist():
                found, root = opened(name)
                rows = []
                with found.open_input_stream(root) as stream:
                    for fields, block in read_records(stream):
                        rows.append(describe(fields, block))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = store.keep(files.select("file").repartition(store.width(files.sparkSession), F.xxhash64("file")).mapInArrow(run, RECORD), "warc-rows")
    there = rows.filter("record_type = 'response'").select(*[F.col(c).alias(f"__{c}") for c in ("page_id", "payload_digest", "payload_bytes")]).distinct()
    there = there.withColumn("__found", F.lit(True))
    again = rows.filter("record_type <> 'response'")
    on = again["refers_to"].eqNullSafe(there["__page_id"]) & (again["payload_digest"] == there["__payload_digest"]) & (again["payload_bytes"] == there["__payload_bytes"])
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of "), F.coalesce(F.col("payload_digest"), F.lit("null")))).cast("long")
    again = again.join(there, on, "left").withColumn("payload_bytes", F.when(F.col("__found"), F.col("payload_bytes")).otherwise(missing))
    return rows.filter("record_type = 'response'").unionByName(again.select(*rows.columns))
