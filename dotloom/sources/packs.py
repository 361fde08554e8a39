"""Packs: many small documents in few files, as a Python Data Source with a reader and a writer.

An export of a corpus has one record for each document, but a file (let alone a folder) for each would be millions.  A
pack is a folder of part files, one for each partition that is written.  A part holds the bytes of its records one after
the other, then a table of their names and offsets, then where the table begins.  Records are dealt to parts by a hash
of their name, so that one document is found by reading one table and one slice.  A manifest, written when all tasks are
done, names the parts that count: what a lost or repeated task left behind is never read.

``fetch`` gives one document as bytes, ``spark.read.format("pack")`` all of them.  Paths may be of any file system that
Arrow opens (file, hdfs, s3).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

SCHEMA = "name string, text string"
MANIFEST = "manifest.json"
_TAIL = struct.Struct("<QQ")  # where the table begins, and how long it is
#: Bytes of records that a reader hands on at a time.
BATCH = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def bucket_of(name: str, buckets: int) -> int:
    return zlib.crc32(name.encode()) % buckets


def manifest_of(path: str) -> dict:
    system, folder = _open(path)
    with system.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def _table(f: pa.NativeFile) -> list[list]:
    """[name, offset, length] of every record of an open part."""
    size = f.size()
    start, length = _TAIL.unpack(f.read_at(_TAIL.size, size - _TAIL.size))
    return json.loads(f.read_at(length, start))


@dataclass
class Part(WriterCommitMessage):
    file: str
    buckets: list[int]
    records: int
    bytes: int


class PackWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.buckets, self.overwrite = options["path"], int(options.get("buckets", "1")), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        file = f"part-{uuid.uuid4().hex}.pack"
        table, at, used = [], 0, set()
        with system.open_output_stream(f"{folder}/{file}") as out:
            for batch in iterator:
                names, texts = batch.column("name").to_pylist(), batch.column("text").to_pylist()
                for name, text in zip(names, texts):
                    body = (text or "").encode()
                    out.write(body)
                    table.append([name or "", at, len(body)])
                    used.add(bucket_of(name or "", self.buckets))
                    at += len(body)
            listed = json.dumps(table, ensure_ascii=False).encode()
            out.write(listed)
            out.write(_TAIL.pack(at, len(listed)))
        return Part(file, sorted(used), len(table), at)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        parts = [vars(m) for m in messages if m is not None and m.records]
        known: dict = {"buckets": self.buckets, "parts": []}
        if not self.overwrite and system.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            known = manifest_of(self.path)
            if known["buckets"] != self.buckets:
                raise ValueError(f"the pack has {known['buckets']} buckets")
        known["parts"] += parts
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(known).encode())

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/{m.file}")


@dataclass
class PackPartition(InputPartition):
    file: str


class PackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"], options.get("name")

    def partitions(self) -> list[InputPartition]:
        known = manifest_of(self.path)
        wanted = None if self.name is None else bucket_of(self.name, known["buckets"])
        parts = [PackPartition(p["file"]) for p in known["parts"] if wanted is None or wanted in p["buckets"]]
        return parts or [PackPartition("")]

    def read(self, partition: PackPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("text", pa.string())])
        if not partition.file:
            return
        system, folder = _open(self.path)
        with system.open_input_file(f"{folder}/{partition.file}") as f:
            names, texts, held = [], [], 0
            for name, start, length in _table(f):
                if self.name is not None and name != self.name:
                    continue
                names.append(name)
                texts.append(f.read_at(length, start).decode())
                held += length
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=schema)
                    names, texts, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=schema)


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackReader:
        return PackReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PackWriter:
        return PackWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``pack`` known to a session, and this package to its executors."""
    ship(spark)
    spark.dataSource.register(PackSource)


def write_pack(docs: DataFrame, path: str, parts: int, mode: str = "overwrite") -> None:
    """Write ``docs`` (name, text) as a pack of at most ``parts`` files, dealt by the hash of the name.

    Null names and texts are empty.  Repeated names are records of their own.  A task that runs again leaves a file
    that no manifest names.
    """
    register(docs.sparkSession)
    rows = docs.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionById(parts, (F.crc32("name") % parts).cast("int"))
    dealt.write.format("pack").option("buckets", str(parts)).mode(mode).save(path)


def read_pack(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All documents of a pack (name, text), or those of one name, from the only part that can hold them."""
    register(spark)
    reader = spark.read.format("pack")
    return (reader if name is None else reader.option("name", name)).load(path)


def fetch(path: str, name: str) -> bytes | None:
    """The bytes of one document of a pack, without Spark: one table and one slice are read; None where there is none."""
    known = manifest_of(path)
    system, folder = _open(path)
    for p in known["parts"]:
        if bucket_of(name, known["buckets"]) in p["buckets"]:
            with system.open_input_file(f"{folder}/{p['file']}") as f:
                for own, start, length in _table(f):
                    if own == name:
                        return f.read_at(length, start)
    return None
