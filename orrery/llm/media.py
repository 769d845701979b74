"""Media columns: payloads in archives, read by a custom data source.

Archives are plain ZIP files, in one folder with a manifest that says where each one's directory lies. The driver plans from the
manifest alone: a partition is a byte range of one archive's directory, one of as many as the archive has `split_bytes` of
payload. An executor reads its part of the directory, finds the first entry that begins in it, and streams the members of its
entries by their offsets, batch by batch, through Arrow. A member that can't be read is tried again by itself; if it stays
unreadable it comes back as a row with an error while the others go on, and so does an archive or a part of a directory.

Folders are addressed by URI and opened by pyarrow's file systems, so executors and driver need share no local folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import own_folder

#: Pixels of a row; payloads are padded with spaces to whole rows.
WIDTH = 192
MANIFEST = "manifest.json"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """At least one row, the last one filled with spaces."""
    rows = max(1, -(-len(raw) // WIDTH))
    return raw.ljust(rows * WIDTH, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raw: bytes) -> bytes:
    """The padded payload as an 8-bit grey image, losslessly; a text chunk tells the bytes before padding."""
    payload = padded(raw)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Comment\0bytes=%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> tuple[bytes, int]:
    """(payload, bytes before padding) of what encode_png made; ValueError if it is damaged."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts = 8, {}
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), int(parts[b"tEXt"].rpartition(b"=")[2])


def feature(payload: bytes) -> str:
    """Average hash: the image in 8 x 8 cells, one bit each for brighter than the mean; then mean and height."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    edges = np.linspace(0, len(rows), 9).astype(int)
    columns = np.add.reduceat(rows.astype(np.int64), range(0, WIDTH, WIDTH // 8), axis=1)
    sums = np.stack([columns[a : max(b, a + 1)].sum(axis=0) / max(b - a, 1) if a < len(rows) else np.zeros(8) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    bits = np.packbits((sums > sums.mean()).ravel()).tobytes().hex()
    return f"ahash={bits};mean={rows.mean():.4f};rows={len(rows)}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Archive:
    """An archive's name, and its directory's place and size in bytes; the payload lies before."""

    name: str
    at: int
    size: int


@dataclass
class _Written(WriterCommitMessage):
    archive: Archive | None


def directory(file: pa.NativeFile) -> tuple[int, int]:
    """Place and size of a ZIP file's directory, from the record at its end."""
    end = file.size()
    for tail in (1 << 10, 1 << 17):
        file.seek(max(0, end - tail))
        held = file.read(tail)
        at = held.rfind(b"PK\5\6")
        if at >= 0 or tail >= end:
            break
    if at < 0 or len(held) < at + 22:
        raise OSError("no directory at the end")
    size, start = struct.unpack("<II", held[at + 12 : at + 20])
    if 0xFFFFFFFF in (size, start) or struct.unpack("<H", held[at + 10 : at + 12])[0] == 0xFFFF:
        wide = held.rfind(b"PK\6\6", 0, at)
        if wide < 0 or len(held) < wide + 56:
            raise OSError("no large directory at the end")
        size, start = struct.unpack("<QQ", held[wide + 40 : wide + 56])
    return start, size


class _ArchiveWriter(DataSourceArrowWriter):
    """One archive for each task; only those of successful tasks get into the manifest."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _open(self.uri)
        store.create_dir(folder, recursive=True)
        name, members = f"part-{uuid.uuid4().hex}.zip", 0
        with store.open_output_stream(f"{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:  # type: ignore[arg-type]
            for batch in iterator:
                for key, body in zip(batch.column(0), batch.column(1), strict=True):
                    id_ = key.as_py()
                    archive.writestr(f"{members}/{'' if id_ is None else id_}.png", body.as_py())
                    members += 1
        if not members:
            store.delete_file(f"{folder}/{name}")
            return _Written(None)
        with store.open_input_file(f"{folder}/{name}") as file:
            return _Written(Archive(name, *directory(file)))

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        store, folder = _open(self.uri)
        store.create_dir(folder, recursive=True)
        found = sorted((a.name, a.at, a.size) for m in messages if isinstance(m, _Written) and (a := m.archive))
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(found).encode())

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        """Archives without a manifest are never read."""


@dataclass
class _Range(InputPartition):
    """Entries that begin in bytes lo to hi of an archive."""

    archive: Archive | None
    lo: int
    hi: int


@dataclass(frozen=True)
class Entry:
    """A member as the directory has it: offset of its header, stored size, size, check sum, method, name."""

    offset: int
    stored: int
    size: int
    crc: int
    method: int
    name: bytes


def entry(held: bytes, at: int) -> tuple[Entry, int] | None:
    """The directory entry at a place, and where the next one begins; None if there is no whole entry."""
    if held[at : at + 4] != b"PK\1\2" or len(held) < at + 46:
        return None
    method, crc, stored, size, names, extras, comment, offset = struct.unpack("<H4xIIIHHH8xI", held[at + 10 : at + 46])
    end = at + 46 + names + extras + comment
    if len(held) < end:
        return None
    extra, wide = held[at + 46 + names : at + 46 + names + extras], []
    while len(extra) >= 4:
        kind, length = struct.unpack("<HH", extra[:4])
        if kind == 1:
            wide = [int.from_bytes(extra[k : k + 8], "little") for k in range(4, 4 + length - 7, 8)]
        extra = extra[4 + length :]
    take = lambda x: wide.pop(0) if x == 0xFFFFFFFF and wide else x
    size, stored, offset = take(size), take(stored), take(offset)
    return Entry(offset, stored, size, crc, method, held[at + 46 : at + 46 + names]), end


def _stands(file: pa.NativeFile, found: Entry) -> bool:
    """Whether the archive has a member of this name at this offset."""
    file.seek(found.offset)
    return file.read(30 + len(found.name))[:4] == b"PK\3\4" and (file.seek(found.offset + 30), file.read(len(found.name)))[1] == found.name


def entries(file: pa.NativeFile, archive: Archive, lo: int, hi: int) -> Iterator[Entry]:
    """Entries that begin in [lo, hi) of the file, a part of the directory; they are read as they are asked for.

    A part may begin within an entry: the first signature from there on whose entry names a member that the archive has
    at its offset is an entry. OSError where the directory is damaged.
    """
    end, held, base = archive.at + archive.size, b"", lo

    def more(at: int) -> bytes:
        """What is held from `at` on, with a megabyte or so of what follows."""
        nonlocal base
        kept = held[at - base :]
        base = at
        file.seek(at + len(kept))
        wanted = min(1 << 20, end - at - len(kept))
        fresh = file.read(wanted)
        if len(fresh) < wanted:
            raise OSError(f"directory ends at byte {at + len(kept) + len(fresh)}")
        return kept + fresh

    at, held = lo, more(lo)
    if lo > archive.at:
        while at < hi:
            k = held.find(b"PK\1\2", at - base)
            if k < 0:
                at = base + max(0, len(held) - 3)
                if at + 3 >= end:
                    return
                held = more(at)
                continue
            at = base + k
            if len(held) - k < 1 << 18 and base + len(held) < end:
                held = more(at)
            one = entry(held, at - base)
            if one and _stands(file, one[0]):
                break
            at += 1
    while at < min(hi, end):
        if len(held) - (at - base) < 1 << 18 and base + len(held) < end:
            held = more(at)
        one = entry(held, at - base)
        if one is None:
            raise OSError(f"directory damaged at byte {at}")
        yield one[0]
        at = base + one[1]


def read_member(file: pa.NativeFile, found: Entry, tries: int = 3, pause: float = 0.2) -> bytes:
    """A member by the offset of its header; tried again when the read fails or the check sum differs."""
    for n in range(tries):
        try:
            file.seek(found.offset)
            header = file.read(30)
            if header[:4] != b"PK\x03\x04" or len(header) < 30:
                raise OSError("no member at this offset")
            file.seek(found.offset + 30 + sum(struct.unpack("<HH", header[26:30])))
            body = file.read(found.stored)
            if found.method == zipfile.ZIP_DEFLATED:
                body = zlib.decompress(body, -15)
            elif found.method != zipfile.ZIP_STORED:
                raise OSError(f"method {found.method} is unknown")
            if len(body) != found.size or zlib.crc32(body) != found.crc:
                raise OSError("member differs from its check sum")
            return body
        except (OSError, zlib.error) as e:
            if n + 1 == tries:
                raise OSError(str(e)) from e
            time.sleep(pause * (n + 1))
    raise AssertionError


class _ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, split: int) -> None:
        self.uri, self.split = uri, split

    def partitions(self) -> Sequence[InputPartition]:
        store, folder = _open(self.uri)
        with store.open_input_file(f"{folder}/{MANIFEST}") as file:
            archives = [Archive(*a) for a in json.loads(file.read())]
        found: list[InputPartition] = []
        for a in archives:
            parts = max(1, -(-a.at // self.split))
            cuts = [a.at + a.size * k // parts for k in range(parts + 1)]
            found += [_Range(a, lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if lo < hi]
        return found or [_Range(None, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Range)
        if partition.archive is None:
            return
        rows: list[tuple[str, int | None, str | None, bytes | None, str | None]] = []
        size = 0
        for row in self._rows(partition.archive, partition.lo, partition.hi):
            rows.append(row)
            size += len(row[3] or b"") + 100
            if size >= 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, archive: Archive, lo: int, hi: int) -> Iterator[tuple[str, int | None, str | None, bytes | None, str | None]]:
        store, folder = _open(self.uri)
        try:
            with store.open_input_file(f"{folder}/{archive.name}") as file, store.open_input_file(f"{folder}/{archive.name}") as listing:
                for found in entries(listing, archive, lo, hi):
                    try:
                        body, error = read_member(file, found), None
                    except OSError as e:
                        body, error = None, str(e)
                    yield archive.name, found.offset, found.name.decode(errors="replace"), body, error
        except OSError as e:
            yield archive.name, None, None, None, f"entries from byte {lo} to {hi}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=["archive", "offset", "name", "media", "error"])


_TYPES = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(uri): archive, offset, name, media, error. Writing: (name, media).

    A part of an archive that can't be read is a row with the archive and the error alone."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], int(self.options.get("split_bytes", 16 << 20)))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system: a plain path is in the cluster's default one, which workers don't know."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    full = held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString()  # type: ignore[union-attr]
    return re.sub("^file:/+", "file:///", full)


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> str:
    """Write each row's text as an image into archives of a new folder of the shared one; gives the folder's URI."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    uri = qualified(spark, f"{own_folder(spark)}/media-{uuid.uuid4().hex}")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                made = [encode_png((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["name", "media"])

    rows = docs.select(F.col(key).cast("string").alias("name"), F.col(text).alias("text")).mapInArrow(images, "name string, media binary")
    rows.write.format("media_archives").mode("append").save(uri)
    return uri


def load(spark: SparkSession, uri: str, split_bytes: int = 16 << 20) -> DataFrame:
    """Rows of the archives in a folder."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("split_bytes", str(split_bytes)).load(uri)


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error) of loaded rows.

    A member that couldn't be read or decoded has its error and nulls elsewhere; a part of an archive that couldn't be read is one row
    with its error and no id.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(name: str | None, image: bytes | None, error: str | None) -> tuple:
        id_ = (name or "").partition("/")[2].removesuffix(".png") or None
        if image is None:
            return (id_, *[None] * 7, error)
        try:
            payload, n = decode_png(image)
        except (ValueError, KeyError, zlib.error, struct.error) as e:
            return (id_, *[None] * 7, f"{type(e).__name__}: {e}")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return (id_, n, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(image), sha(image), feature(payload), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*r) for r in zip(*[batch.column(c).to_pylist() for c in ("name", "media", "error")], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("name", "media", "error").mapInArrow(run, schema)


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store the texts of `docs`, read them back and describe them: one row for each row.

    Null text is empty and has one padded row of pixels. Equal texts, of any length, have equal values; repeated rows give repeated
    rows. A null id stays null. Other columns are not read; an empty table gives an empty one.
    """
    found = features(load(docs.sparkSession, store(docs, text, key)))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
