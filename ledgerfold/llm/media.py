"""Operator 9: media columns through a Spark data source of our own.

``write_archives`` stores each payload losslessly as an 8-bit greyscale PNG, 64
samples wide, and packs the images into archives: tar files with an index of
member offsets beside them (16 bytes a member).  The data source ``media_archive``
plans byte ranges over the archives of a folder; each task finds by binary search
in the index the members that begin in its range, reads them by offset, retries
each member independently, and streams Arrow batches of bounded size.

Defined results: a null text is empty; an empty payload is one row of zeros; equal
payloads give equal stored forms, features and digests, since nothing else enters
an image; repeated identifiers give repeated rows; a null identifier is kept; an
empty table gives empty archives and no rows; further columns are ignored; a very
long text is one member, stored whole; members keep their rows' order, so there are
no ties.  A
member that cannot be read after ``attempts`` tries gives a row with its error and
null content; the other members of the archive are not affected.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerfold.llm.common import open_binary, publish, python_ready, shared_path, table, text_of, worker_task

WIDTH = 64
RANGE_BYTES = 16 << 20
#: An archive is closed at this size and the next one begun.
ARCHIVE_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
PNG = b"\x89PNG\r\n\x1a\n"
ENTRY = struct.Struct("<QQ")

MEDIA_SCHEMA = "archive string, offset bigint, name string, media binary, error string"


# --- the image -----------------------------------------------------------------


def padded(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """A greyscale image of the padded payload; its own length stands in a
    private chunk."""
    data = padded(payload)
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)  # filter type 0 before each row
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return b"".join((
        PNG, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        _chunk(b"lfLn", struct.pack(">Q", len(payload))),
        _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)), _chunk(b"IEND", b"")))


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(samples, unpadded length); raises ``ValueError`` for a damaged image."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, size, length, height = 8, [], None, None, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            _, height = struct.unpack_from(">II", body)
        elif kind == b"lfLn":
            (length,) = struct.unpack(">Q", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes(), length if length is not None else height * WIDTH


def features(samples: bytes) -> str:
    """Mean, deviation, entropy, range and a 64-bit column profile of the image."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    deviation = max(float(counts @ (values * values)) / len(x) - mean * mean, 0.0) ** 0.5
    p = counts[counts > 0] / len(x)
    columns = x.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns > np.roll(columns, -1)).tobytes().hex()
    seen = np.flatnonzero(counts)
    return (f"mean={mean:.4f};sd={deviation:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};"
            f"min={seen[0]};max={seen[-1]};columns={bits}")


# --- archives ------------------------------------------------------------------


def _tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    head[0 : len(name)] = name.encode("ascii")
    head[100:108], head[108:116], head[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    head[124:136] = b"%011o\0" % size
    head[136:148], head[148:156], head[156:157] = b"00000000000\0", b"        ", b"0"
    head[257:265] = b"ustar\x0000"
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def parse_tar_header(head: bytes) -> tuple[str, int]:
    if len(head) != 512 or head[257:262] != b"ustar":
        raise ValueError("no member header here")
    want = int(head[148:156].rstrip(b"\0 "), 8)
    if sum(head[:148]) + 8 * 32 + sum(head[156:]) != want:
        raise ValueError("damaged member header")
    return head[:100].rstrip(b"\0").decode("ascii"), int(head[124:135], 8)


class ArchiveWriter:
    """Writes numbered archives ``<stem>-0000.tar`` and ``.idx`` of bounded size."""

    def __init__(self, stem: str, attempt: int, archive_bytes: int = ARCHIVE_BYTES):
        self.stem, self.attempt, self.limit, self.number, self.out = stem, attempt, archive_bytes, 0, None
        self.done: list[tuple[str, int, int]] = []

    def _open(self):
        self.final = f"{self.stem}-{self.number:04d}.tar"
        self.out = open_binary(f"{self.final}.{self.attempt}.tmp", "wb")
        self.at, self.index = 0, bytearray()

    def add(self, name: str, media: bytes):
        if self.out is None:
            self._open()
        self.index += ENTRY.pack(self.at, len(media))
        rest = -len(media) % 512
        for part in (_tar_header(name, len(media)), media, bytes(rest)):
            self.out.write(part)
        self.at += 512 + len(media) + rest
        if self.at >= self.limit:
            self.close()

    def close(self):
        if self.out is None:
            return
        self.out.write(bytes(1024))
        self.out.close()
        index = f"{self.final.removesuffix('.tar')}.idx"
        with open_binary(f"{index}.{self.attempt}.tmp", "wb") as out:
            out.write(bytes(self.index))
        publish(f"{index}.{self.attempt}.tmp", index)
        publish(f"{self.final}.{self.attempt}.tmp", self.final)
        self.done.append((self.final, self.at, len(self.index) // ENTRY.size))
        self.number, self.out = self.number + 1, None


def write_archives(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every text; returns ``archive, bytes, members``, one row a file."""
    spark = docs.sparkSession
    python_ready(spark)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        writer, n = ArchiveWriter(f"{path}/part-{context.partitionId():06d}", context.taskAttemptId(), archive_bytes), 0
        for batch in batches:
            for identifier, text in zip(batch.column(0), batch.column(1), strict=True):
                # The name carries the identifier and a number that is unique in the task.
                writer.add(f"{identifier.as_py() if identifier.is_valid else 'null'}/{n}.png", encode_png(text.as_buffer().to_pybytes()))
                n += 1
        writer.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("archive", "bytes", "members"), x, strict=True)) for x in writer.done],
            pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())]))

    rows = docs.select(docs[id_column].cast("bigint").alias("id"), text_of(text_column).alias("text"))
    done = rows.mapInArrow(worker_task(run), "archive string, bytes bigint, members bigint").collect()
    return spark.createDataFrame(done or [], "archive string, bytes bigint, members bigint")


def _archives(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the finished archives of a folder, by name."""
    if path.startswith("file:") or "://" not in path:
        folder = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        names = sorted(x for x in os.listdir(folder) if x.endswith(".tar")) if os.path.isdir(folder) else []
        return [(f"{path}/{x}", os.path.getsize(f"{folder}/{x}")) for x in names]
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f"{path}/{x.base_name}", x.size) for x in found if x.base_name.endswith(".tar"))


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self):
        return [
            ByteRange(archive, start, min(start + self.range_bytes, size))
            for archive, size in _archives(self.path)
            for start in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.archive:
            return
        with open_binary(f"{partition.archive.removesuffix('.tar')}.idx", "rb") as source:
            index = np.frombuffer(source.read(), "<u8").reshape(-1, 2)
        first, last = np.searchsorted(index[:, 0], [partition.start, partition.end])
        held, size, self.source = [], 0, None
        for offset, length in index[first:last].tolist():
            held.append(self._member(partition.archive, offset, length))
            size += len(held[-1][3] or b"")
            if size >= BATCH_BYTES or len(held) >= 4096:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)
        self._close()

    def _close(self):
        if self.source is not None:
            self.source.close()
        self.source = None

    def _member(self, archive: str, offset: int, length: int) -> tuple:
        """One member by its offset; after an error the archive is opened anew."""
        error = ""
        for attempt in range(self.attempts):
            try:
                if self.source is None:
                    self.source = open_binary(archive, "rb")
                self.source.seek(offset)
                name, size = parse_tar_header(self.source.read(512))
                media = self.source.read(size)
                if size != length or len(media) != size:
                    raise ValueError("short member")
                return archive, offset, name, media, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                self._close()
                time.sleep(0.05 * attempt)
        return archive, offset, None, None, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    names = ("archive", "offset", "name", "media", "error")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("path", folder).load()``"""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return MEDIA_SCHEMA

    def reader(self, schema):
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    python_ready(spark)
    spark.dataSource.register(MediaArchiveSource)
    reader = spark.read.format("media_archive").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def media_features(media: DataFrame) -> DataFrame:
    """Content and features of the members read; an unreadable or damaged one has
    its error and nulls."""
    fields = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("error", pa.string())]
    schema = pa.schema(fields)

    def one(name, content, error):
        if error:
            return {"error": error}
        head = name.split("/")[0]
        row = {"doc_id": None if head == "null" else int(head), "media_bytes": len(content),
               "media_sha256": hashlib.sha256(content).hexdigest()}
        try:
            samples, length = decode_png(content)
        except (ValueError, struct.error, zlib.error) as e:
            return row | {"error": f"{type(e).__name__}: {e}"}
        return row | {"n_bytes": length, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(),
                      "tail_crc32": zlib.crc32(samples[-WIDTH:]), "feature": features(samples)}

    def run(batches):
        for batch in batches:
            rows = [one(n.as_py(), m.as_py(), e.as_py()) for n, m, e in zip(*(batch.column(c) for c in ("name", "media", "error")), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = ("doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
           "media_bytes bigint, media_sha256 string, feature string, error string")
    return media.select("name", "media", "error").mapInArrow(worker_task(run), ddl)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as an image, read back and described."""
    path = shared_path(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), path)
    return media_features(read_archives(spark, path))


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE: dict[str, str] = {}
