"""Media columns: payloads stored as images in archives, read back by a Spark data source.

The writer makes ZIP archives of PNG images, one member a row, in a folder
that all executors share.  The reader plans byte ranges over the archives; a
task reads its archive's directory, takes the members that begin in its range,
fetches them a batch's bytes at a time, and hands them on in Arrow batches.  A
member that such a read did not bring whole, by its checksum, is fetched again
by its own offset, independently of the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm.batches import texts_in_chunks
from tidemark.llm.scratch import shared_dir

FORMAT = "tidemark_media"
WIDTH = 64
SCHEMA = "key bigint, n_bytes bigint, media binary"
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_archives-"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """``text`` and bytes 0 up to a positive multiple of the width."""
    return text + bytes(-len(text) % WIDTH or (WIDTH if not text else 0))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, ``WIDTH`` a row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row after its filter byte, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image that :func:`to_png` made."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data = 8, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].ravel()


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, mean step between samples, and the share of each sixteenth of the range."""
    x = samples.astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    share = np.bincount(samples >> 4, minlength=16) / n
    mean = total / n
    spread = max(0.0, squares / n - mean * mean) ** 0.5
    step = float(np.abs(np.diff(x)).sum()) / max(1, n - 1)
    return f"mean={mean:.4f};std={spread:.4f};step={step:.4f};hist=" + ",".join(f"{s:.4f}" for s in share)


@dataclass
class Archives(WriterCommitMessage):
    """What a task has written: names and sizes."""

    made: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    """The members of an archive that begin in [start, end)."""

    archive: str
    start: int
    end: int


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


class MediaWriter(DataSourceArrowWriter):
    """Archives of a write count once its manifest names them: appending keeps those named before, overwriting drops them."""

    def __init__(self, path: str, archive_bytes: int, overwrite: bool):
        self.path, self.archive_bytes, self.overwrite = path, archive_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        files, root = _files(self.path)
        made, out, archive, name = [], None, None, ""

        def close() -> None:
            archive.close()
            size = out.tell()
            out.close()
            made.append((name, size))

        for batch in iterator:
            for key, payload, n in zip(batch["key"].to_pylist(), batch["media"], batch["n_bytes"].to_pylist()):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"  # of a task that runs twice only the committed archives count
                    out = files.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{len(archive.filelist):08d}.png")
                info.comment = json.dumps([key, n]).encode()
                archive.writestr(info, payload.as_py())
                if out.tell() >= self.archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Archives(made)

    def commit(self, messages: list[Archives]) -> None:
        """Writes a manifest of its own beside those of other writes, and renames it when it is whole."""
        files, root = _files(self.path)
        before = manifests(files, root) if self.overwrite else []
        gone = archives(files, root) if self.overwrite else []
        name = f"{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{root}/_writing-{name}") as f:
            f.write(json.dumps(sorted(a for m in messages if m for a in m.made)).encode())
        files.move(f"{root}/_writing-{name}", f"{root}/{MANIFEST}{name}")
        for old in before:
            files.delete_file(old)
        _delete(files, root, gone)

    def abort(self, messages: list[Archives]) -> None:
        files, root = _files(self.path)
        _delete(files, root, [a for m in messages if m for a in m.made])


def manifests(files: pa.fs.FileSystem, root: str) -> list[str]:
    """The paths of the manifests, one of each write."""
    found = files.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST))


def archives(files: pa.fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Names and sizes that the manifests have; none where there is no manifest."""
    out = []
    for path in manifests(files, root):
        with files.open_input_file(path) as f:
            out += [(name, size) for name, size in json.loads(f.read())]
    return sorted(out)


def _delete(files: pa.fs.FileSystem, root: str, made: list[tuple[str, int]]) -> None:
    for name, _ in made:
        if files.get_file_info(f"{root}/{name}").type == pa.fs.FileType.File:
            files.delete_file(f"{root}/{name}")


def members(archive: zipfile.ZipFile, start: int, end: int) -> list[zipfile.ZipInfo]:
    return sorted((m for m in archive.infolist() if start <= m.header_offset < end), key=lambda m: m.header_offset)


def directory(open_file, partition: ByteRange, attempts: int) -> list[zipfile.ZipInfo]:
    """The members of a range by the archive's directory, which is read anew after a failure."""
    for left in reversed(range(attempts)):
        try:
            with open_file() as f:
                return members(zipfile.ZipFile(f), partition.start, partition.end)
        except (OSError, zipfile.BadZipFile):
            if not left:
                raise
    raise ValueError("attempts must be positive")


def cut(block: bytes, at: int, member: zipfile.ZipInfo) -> bytes:
    """A member's bytes out of ``block``, in which its header begins at ``at``; OSError if they are not whole."""
    names = struct.unpack("<HH", block[at + 26 : at + 30]) if len(block) >= at + 30 else (0, 0)
    data = block[at + 30 + sum(names) : at + 30 + sum(names) + member.compress_size]
    if block[at : at + 4] != b"PK\x03\x04" or len(data) != member.compress_size or zlib.crc32(data) != member.CRC:
        raise OSError(f"member {member.filename} at {member.header_offset} is not whole")
    return data


def fetch(open_file, member: zipfile.ZipInfo, attempts: int) -> bytes:
    """One member by its offset, from a newly opened file at each attempt."""
    for left in reversed(range(attempts)):
        try:
            with open_file() as f:
                f.seek(member.header_offset)
                names = struct.unpack("<HH", f.read(30)[26:30])
                f.seek(member.header_offset)
                return cut(f.read(30 + sum(names) + member.compress_size), 0, member)
        except (OSError, struct.error):
            if not left:
                raise
    raise ValueError("attempts must be positive")


class MediaReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, attempts: int):
        self.path, self.split_bytes, self.attempts = path, split_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        ranges = [ByteRange(name, start, min(size, start + self.split_bytes)) for name, size in archives(*_files(self.path)) for start in range(0, size, self.split_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = _files(self.path)
        open_file = lambda: files.open_input_file(f"{root}/{partition.archive}")
        mine = directory(open_file, partition, self.attempts)
        rows, held = [], 0
        for run in self._runs(mine):
            first, last = run[0], run[-1]
            try:
                with open_file() as f:
                    f.seek(first.header_offset)  # a header's extra field is as long as the directory's, or empty
                    block = f.read(last.header_offset + 30 + len(last.filename) + len(last.extra) + last.compress_size + 64 - first.header_offset)
            except OSError:
                block = b""  # then each member is fetched by itself
            for member in run:
                try:
                    media = cut(block, member.header_offset - first.header_offset, member)
                except OSError:
                    media = fetch(open_file, member, self.attempts)
                rows.append((*json.loads(member.comment), media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _runs(mine: list[zipfile.ZipInfo]) -> Iterator[list[zipfile.ZipInfo]]:
        """Members to fetch in one read, about a batch's bytes."""
        run, held = [], 0
        for member in mine:
            run.append(member)
            held += member.compress_size
            if held >= BATCH_BYTES:
                yield run
                run, held = [], 0
        if run:
            yield run

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        keys, sizes, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])


class MediaSource(DataSource):
    """Options: path; archiveBytes (of an archive at most, writing); splitBytes (of a task, reading); attempts (a member)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), int(self.options.get("attempts", 3)))

    def writer(self, schema: StructType, overwrite: bool) -> MediaWriter:
        files, root = _files(self.options["path"])
        files.create_dir(root, recursive=True)
        return MediaWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)), overwrite)


def _as_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, payloads in texts_in_chunks(batches, "payload"):
        texts = [t or b"" for t in payloads]
        media = [to_png(padded(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([part["key"], pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for key, n, media in zip(batch["key"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist()):
            samples = from_png(media)
            payload = samples.tobytes()
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)


DESCRIBED = "key bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def store_media(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", mode: str = "append") -> DataFrame:
    """Store each text as an image in archives below ``path``; the stored rows (key, n_bytes, media) as a source, those stored there before included unless ``mode`` is overwrite.

    A text is its UTF-8 bytes, followed by bytes 0 up to a positive multiple
    of 64; null counts as empty and a null key stays null.  Keys are integers;
    a key that can't be cast to one is an error.  Rows are stored
    one by one, so ties, repeated rows and very long texts need nothing
    special; an empty table makes an archive folder without archives.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaSource)
    payload = docs.select(F.col(key).cast("bigint").alias("key"), F.encode(F.col(text), "UTF-8").alias("payload"))
    payload.mapInArrow(_as_media, SCHEMA).write.format(FORMAT).mode(mode).option("path", path).save()
    return spark.read.format(FORMAT).load(path)


def describe_media(media: DataFrame) -> DataFrame:
    """Digests and a feature string of each stored image, from its stored bytes."""
    return media.mapInArrow(_described, DESCRIBED)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """:func:`store_media` into a shared folder, then :func:`describe_media`; the key keeps its name."""
    stored = store_media(docs, path or f"{shared_dir(docs.sparkSession)}/media", key, text)
    return describe_media(stored).withColumnRenamed("key", key)
