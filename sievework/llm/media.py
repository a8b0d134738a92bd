"""Media columns: a Spark data source over archives of media members.

`write_archives` stores each text as an 8-bit PCM WAV member of ZIP archives in a shared folder.  `MediaArchives`
is a Python data source (format "media_archive"): the driver plans byte ranges over the archives from their sizes
alone, a task reads the archive's own directory, takes the members whose offset lies in its range, and streams
them in Arrow batches.  Each member is read by its offset and retried on its own.

Defined cases: a null text is stored as an empty one; a payload is padded to a positive multiple of 64 bytes, so an
empty text gives 64 zero bytes; a null id stays null; equal rows give one member each; an empty table gives one
empty set of archives and no rows; rows that tie in id and text are members of their own; a text of any length is one
member, which one task holds whole with its payload; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievework.llm.shared import new_folder, text_slices

BLOCK = 64
#: An archive is closed beyond this many bytes; a partition covers this many; a batch holds about this many.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20
SCHEMA = "doc_id long, n_bytes long, archive string, offset long, media binary, error string"


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % BLOCK or (0 if payload else BLOCK))


def to_wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV file whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def feature(payload: bytes) -> str:
    """Integer statistics of the samples: sum, energy about the middle, crossings of the middle, 8-bin histogram."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    up = x >= 0
    bins = np.bincount((x + 128) >> 5, minlength=8)
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(up[1:] != up[:-1])};bins={'/'.join(map(str, bins))}"


class _Writer:
    """Archives of one task attempt.  Names are unique to it, so a lost or repeated attempt never overwrites another."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.zip: zipfile.ZipFile | None = None

    def add(self, doc_id: int | None, payload: bytes) -> Iterator[tuple[str, int, int]]:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
            self.zip, self.members = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0
        info = zipfile.ZipInfo(f"{self.members:08d}.wav")
        info.compress_type = zipfile.ZIP_DEFLATED
        info.comment = json.dumps([doc_id, len(payload)]).encode()
        self.zip.writestr(info, to_wav(pad(payload)), compresslevel=1)
        self.members += 1
        if self.out.tell() >= ARCHIVE_BYTES:
            yield self.close()

    def close(self) -> tuple[str, int, int]:
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        self.zip = None
        return self.name, size, self.members


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Store every row's text; returns the folder of the manifest, which lists the archives of committed attempts only."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = _Writer(f"{folder}/archives"), []
        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                done += writer.add(doc_id, (text or "").encode())
        if writer.zip is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "size", "members"), x, strict=True)) for x in done], schema=pa.schema([("archive", pa.string()), ("size", pa.int64()), ("members", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(task, "archive string, size long, members long").write.parquet(f"{folder}/manifest")
    return folder


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))
        self.keep_bad = options.get("onError", "fail") == "null"

    def partitions(self) -> list[ByteRange]:
        filesystem, path = fs.FileSystem.from_uri(self.folder)
        manifest = ds.dataset(f"{path}/manifest", filesystem=filesystem, format="parquet", exclude_invalid_files=True).to_table(["archive", "size"])
        plan = [ByteRange(a, s, s + self.range_bytes) for a, size in zip(*(manifest[c].to_pylist() for c in ("archive", "size")), strict=True) for s in range(0, size, self.range_bytes)]
        return plan or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        filesystem, path = fs.FileSystem.from_uri(self.folder)
        name = f"{path}/archives/{partition.archive}"
        with filesystem.open_input_file(name) as f, zipfile.ZipFile(f) as z:
            members = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
        rows, held = [], 0
        shared: list = []
        try:
            for info in members:
                media, error = self.member(filesystem, name, info, shared)
                doc_id, n_bytes = json.loads(info.comment)
                rows.append({"doc_id": doc_id, "n_bytes": n_bytes, "archive": partition.archive, "offset": info.header_offset, "media": media, "error": error})
                held += len(media or b"")
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            for x in shared:
                x.close()
        if rows:
            yield self.batch(rows)

    def member(self, filesystem: fs.FileSystem, name: str, info: zipfile.ZipInfo, shared: list) -> tuple[bytes | None, str | None]:
        """One member by its offset.  After a failure the archive is opened anew and only this member is read again."""
        said = ""
        for _ in range(self.attempts):
            try:
                if not shared:
                    shared.append(f := filesystem.open_input_file(name))
                    shared.insert(0, zipfile.ZipFile(f))
                return shared[0].read(info), None
            except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                said = f"{type(e).__name__}: {e}"
                for x in shared:
                    x.close()
                shared.clear()
        if not self.keep_bad:
            raise OSError(f"{name}, member at {info.header_offset}: {said}")
        return None, said

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


class MediaArchives(DataSource):
    """spark.read.format("media_archive").load(folder); options rangeBytes, attempts, onError (fail or null)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of a media column; a member that could not be read has nulls."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                row = {"doc_id": doc_id, "n_bytes": n_bytes}
                if media is not None:
                    payload = from_wav(media)
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:])}
                    row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "media"))
    return media_features(read_archives(spark, folder))
