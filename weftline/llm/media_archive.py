"""Media columns: payloads in archives, read back by a Spark data source.

A payload becomes an 8-bit grey PNG, and a task's PNGs become stored members of ZIP archives in the shared folder. A table
beside them names the archives of tasks that finished; what lost tasks left is never read. The data source plans byte
ranges over those archives; a range's task reads the archive's directory, takes the members that begin in its range,
streams them as Arrow batches, and fetches each of them again by its own offset if it can't be read or its checksum fails.

Defined results: a null text is an empty payload, padded like any other; equal texts give equal bytes and features;
repeated rows are members of their own; a null id stays null; a very long text is one member, held whole by the task that
writes or reads it; columns other than the id and the text are ignored, whatever their names; an empty table gives no
archive and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared as S

#: Samples in a row of an image; a payload is padded with PAD up to a positive multiple of it.
ROW, PAD = 576, b"\xff"
#: Members and bytes after which an archive is closed; bytes of a planned range; bytes of a batch; tries of a member.
ARCHIVE_MEMBERS, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 60_000, 64 << 20, 16 << 20, 8 << 20, 4
#: Partitions that the ranges are dealt to, at most.
PARTITIONS = 50_000

_LOCAL, _CENTRAL, _END = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % ROW if data else ROW)


def to_png(payload: bytes) -> bytes:
    """The payload as the samples of a grey image ROW wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", media, at + 8)
        elif kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filter that this codec does not write")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and which of 16 equal stretches are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    share = n / len(x)
    mean = float((share * np.arange(256)).sum())
    spread = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    entropy = float(-(share[n > 0] * np.log2(share[n > 0])).sum())
    parts = x.reshape(16, -1).mean(1) > mean
    return f"{mean:.5f},{spread:.5f},{entropy:.5f},{int(np.packbits(parts).view('>u2')[0]):04x}"


class Archive:
    """A ZIP of stored members, written front to back."""

    def __init__(self, out):
        self.out, self.size, self.entries = out, 0, []

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        self.entries.append((name, crc, len(data), self.size))
        self._put(struct.pack(_LOCAL, b"PK\x03\x04", 20, 0, 0, 0, 0x21, crc, len(data), len(data), len(name), 0) + name + data)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        start = self.size
        for name, crc, size, offset in self.entries:
            self._put(struct.pack(_CENTRAL, b"PK\x01\x02", 20, 20, 0, 0, 0, 0x21, crc, size, size, len(name), 0, 0, 0, 0, 0, offset) + name)
        self._put(struct.pack(_END, b"PK\x05\x06", 0, 0, len(self.entries), len(self.entries), self.size - start, start, 0))
        self.out.close()


def directory(src, size: int) -> list[tuple[str, int, int, int]]:
    """Name, checksum, size and offset of every member."""
    src.seek(size - struct.calcsize(_END))
    mark, _, _, n, _, length, start, _ = struct.unpack(_END, src.read(struct.calcsize(_END)))
    if mark != b"PK\x05\x06":
        raise ValueError("no archive directory")
    src.seek(start)
    data, at, out = src.read(length), 0, []
    for _ in range(n):
        head = struct.unpack_from(_CENTRAL, data, at)
        at += struct.calcsize(_CENTRAL)
        out.append((data[at : at + head[10]].decode(), head[7], head[8], head[16]))
        at += head[10] + head[11] + head[12]
    return out


class Members:
    """Reads members of one archive by their offsets through one open file, which is opened anew only after a failure."""

    def __init__(self, system, path: str):
        self.system, self.path, self.src = system, path, None

    def read(self, name: str, crc: int, size: int, offset: int, tries: int = TRIES) -> bytes:
        """A member's bytes from its own offset, tried anew on its own."""
        for left in reversed(range(tries)):
            try:
                self.src = self.src or self.system.open_input_file(self.path)
                self.src.seek(offset)
                head = struct.unpack(_LOCAL, self.src.read(struct.calcsize(_LOCAL)))
                self.src.seek(offset + struct.calcsize(_LOCAL) + head[9] + head[10])
                data = self.src.read(size)
                if head[0] != b"PK\x03\x04" or zlib.crc32(data) != crc:
                    raise OSError(f"{self.path}: {name} at {offset} is damaged")
                return data
            except (OSError, struct.error) as error:
                self.close()
                if not left:
                    raise OSError(f"{self.path}: {name} at {offset} can't be read") from error
                time.sleep(0.05 * 2 ** (tries - left))
        raise AssertionError

    def close(self) -> None:
        src, self.src = self.src, None
        if src is not None:
            src.close()


class ByteRanges(InputPartition):
    """Ranges of archives, each its archive, the archive's size, and the first byte and the one after the last."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.step = options["manifest"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[ByteRanges]:
        """Ranges of step bytes; of many, neighbours share a partition. The manifest's two columns, a row an archive, are read."""
        import pyarrow.dataset as ds

        system, path = fs.FileSystem.from_uri(self.manifest)
        found = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]
        rows = ds.dataset(found, filesystem=system).to_table(["archive", "bytes"]).to_pylist() if found else []
        ranges = [(r["archive"], r["bytes"], a, a + self.step) for r in rows for a in range(0, r["bytes"], self.step)]
        each = -(-len(ranges) // PARTITIONS) or 1
        return [ByteRanges(ranges[k : k + each]) for k in range(0, len(ranges), each)] or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for archive, length, start, end in partition.ranges:
            system, path = fs.FileSystem.from_uri(archive)
            with system.open_input_file(path) as src:
                own = [x for x in directory(src, length) if start <= x[3] < end]
            reader = Members(system, path)
            names, offsets, media, held = [], [], [], 0
            for name, crc, size, offset in own:
                names.append(name), offsets.append(offset), media.append(reader.read(name, crc, size, offset))
                held += size
                if held >= BATCH_BYTES:
                    yield self._batch(names, offsets, media)
                    names, offsets, media, held = [], [], [], 0
            reader.close()
            if names:
                yield self._batch(names, offsets, media)

    @staticmethod
    def _batch(names, offsets, media) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], ["member", "offset", "media"])


class ArchiveSource(DataSource):
    """format("weftline_archive"): option manifest, the table of archives."""

    @classmethod
    def name(cls) -> str:
        return "weftline_archive"

    def schema(self) -> str:
        return "member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write every text as a member of archives under root; the place of the table that names the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        out, name, done = None, "", []
        for block in S.blocks(batches, "text"):
            for key, text in zip(block.column("id").to_pylist(), block.column("text"), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = Archive(system.open_output_stream(f"{base}/{name}"))
                out.add(json.dumps([len(out.entries), key]).encode(), to_png(padded(text.as_buffer().to_pybytes() if text.is_valid else b"")))
                if len(out.entries) >= ARCHIVE_MEMBERS or out.size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{root}/{name}", out.size, len(out.entries)))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{root}/{name}", out.size, len(out.entries)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "bytes", "members"])

    manifest = f"{root}-manifest"
    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "archive string, bytes long, members long").write.parquet(manifest)
    return manifest


def load(spark: SparkSession, manifest: str) -> DataFrame:
    """member, offset and media of every member of the named archives."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("manifest", manifest).load()


def features(media: DataFrame, id_name: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Sizes, digests and the feature of every stored image, from its stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            rows = []
            for name, png in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
                png = png.as_py()
                payload = from_png(png)
                rows.append((json.loads(name)[1], len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload)))
            if rows:
                kind = pa.int64() if id_type in ("bigint", "int") else pa.string()
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *map(pa.array, cols[1:])], [id_name, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = "long" if id_type in ("bigint", "int") else "string"
    return media.select("member", "media").mapInArrow(run, f"`{id_name}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4(spark, sf_dir: str) -> DataFrame:
    return features(load(spark, store(S.documents(spark, sf_dir), S.scratch(spark, "media"))))
