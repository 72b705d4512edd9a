"""Media columns: archives of media members behind a custom Spark data source.

``media_archive`` writes rows (member_id, n_bytes, media) to archives in one folder and reads them back.
An archive holds the members one after another, then a directory (one Arrow stream: member_id, n_bytes,
offset, length, crc32), then a fixed footer that gives the directory's place. Planning looks at archive sizes
only and splits each archive into byte ranges; a reader takes the members that begin in its range, streams
them as Arrow batches of bounded size, and retries each member on its own from its offset. Archives get
their final names in the commit, so a lost or repeated task leaves nothing that a reader sees.

The media form is an 8-bit grey PNG, 576 samples wide: the payload's bytes are its samples, row by row.

Defined cases: null text: empty, hence one row of 576 times 255; null or repeated ids are members of their
own; an empty table writes no member and reads back empty; extra columns are ignored. Equal texts give equal
bytes everywhere.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import fresh_path, texts

WIDTH = 576
FOOTER = struct.Struct("<8sQQ")
MAGIC = b"FLARCHV1"
BATCH_BYTES = 4 << 20
SCHEMA = "member_id long, n_bytes long, media binary"
DIRECTORY = pa.schema([("member_id", pa.int64()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


# ---------------------------------------------------------------- media form


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``WIDTH``."""
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a grey 8-bit image whose lines are unfiltered."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, height = 8, [], 0
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r} part")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and a 16-bin histogram in thousandths of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(share @ (np.arange(256) - mean) ** 2))
    seen = share[share > 0]
    bins = (share.reshape(16, 16).sum(1) * 1000).round().astype(int)
    return f"{mean:.3f};{deviation:.3f};{-(seen @ np.log2(seen)):.4f};" + ",".join(map(str, bins))


# ---------------------------------------------------------------- data source


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.folder)
        name, entries, at, sink = f"{uuid.uuid4().hex}.arc", [], 0, None
        for batch in iterator:
            for member, n_bytes, media in zip(*(batch.column(i) for i in range(3)), strict=True):
                if sink is None:
                    fs.create_dir(f"{folder}/_open", recursive=True)
                    sink = fs.open_output_stream(f"{folder}/_open/{name}")
                body = media.as_py()
                sink.write(body)
                entries.append((member.as_py(), n_bytes.as_py(), at, len(body), zlib.crc32(body)))
                at += len(body)
        if sink is None:
            return Written(None)
        table = io.BytesIO()
        with pa.ipc.new_stream(table, DIRECTORY) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*entries, strict=True)], schema=DIRECTORY))
        sink.write(table.getvalue())
        sink.write(FOOTER.pack(MAGIC, at, len(table.getvalue())))
        sink.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{folder}/_open/{m.file}", f"{folder}/{m.file}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.folder)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{folder}/_open/{m.file}")


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int):
        self.folder, self.range_bytes, self.attempts = folder, range_bytes, attempts

    def partitions(self) -> list[Range]:
        fs, folder = filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [
            Range(f.path, low, min(low + self.range_bytes, f.size))
            for f in sorted(found, key=lambda f: f.path)
            if f.path.endswith(".arc")
            for low in range(0, f.size, self.range_bytes)
        ] or [Range("", 0, 0)]

    def member(self, fs: pafs.FileSystem, file: str, offset: int, length: int, crc: int) -> bytes:
        """One member by its offset; opens the archive anew for each further attempt."""
        problem: Exception | None = None
        for _ in range(self.attempts):
            try:
                with fs.open_input_file(file) as f:
                    body = f.read_at(length, offset)
                if len(body) == length and zlib.crc32(body) == crc:
                    return body
                problem = OSError(f"{file} at {offset}: checksum does not match")
            except OSError as e:
                problem = e
        raise problem or OSError(f"{file}: no attempt allowed")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(partition.file) as f:
            size = f.size()
            magic, start, length = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.file} is no archive")
            directory = pa.ipc.open_stream(f.read_at(length, start)).read_all()
            offsets = directory["offset"].to_numpy()
            # an empty member shares its offset with the next one, so ranges are cut by where members begin
            low, high = np.searchsorted(offsets, [partition.low, partition.high])
            rows = directory.slice(low, high - low).to_pydict()
            held: list[tuple[int, int, bytes]] = []
            held_bytes = 0
            for member, n_bytes, offset, length, crc in zip(*(rows[c] for c in DIRECTORY.names), strict=True):
                try:
                    body = f.read_at(length, offset)
                except OSError:
                    body = b""
                if len(body) != length or zlib.crc32(body) != crc:
                    body = self.member(fs, partition.file, offset, length, crc)
                held.append((member, n_bytes, body))
                held_bytes += length
                if held_bytes >= BATCH_BYTES:
                    yield self.batch(held)
                    held, held_bytes = [], 0
            if held:
                yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["member_id", "n_bytes", "media"]
        )


class MediaArchive(DataSource):
    """Options: ``path``, ``range_bytes`` (16 MiB), ``attempts`` for each member (3)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)), int(self.options.get("attempts", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


# ---------------------------------------------------------------- operator


def store_documents(docs: DataFrame, path: str) -> None:
    """Encode each text and write it as a member of an archive below ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                media = encode_png(pad(raw))
                rows.append((doc, len(raw), media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield ArchiveReader.batch(rows)
                    rows, held = [], 0
            if rows:
                yield ArchiveReader.batch(rows)

    register(docs.sparkSession)
    texts(docs).mapInArrow(encode, SCHEMA).write.format("media_archive").mode("append").save(path)


def describe_media(members: DataFrame) -> DataFrame:
    """Decode stored members and describe what was read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in schema.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = media.as_py()
                payload = decode_png(stored)
                rows.append(
                    (doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names)

    return members.select("member_id", "n_bytes", "media").mapInArrow(describe, schema)


def media_documents(docs: DataFrame) -> DataFrame:
    """Store every text as media in the shared folder, read the stored bytes back and describe them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "media")
    store_documents(docs, path)
    return describe_media(spark.read.format("media_archive").load(path))
