"""Hashes of files and of columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.hashes import crc32_hex
from idloom.functions.scalars import algorithm_name

CHUNK = 1 << 20


def column_hashes(c: Column, algorithms: tuple[str, ...] = ("crc32", "md5", "sha1", "sha256")) -> list[Column]:
    """Hash columns of a text or binary column; null stays null. blake3 has no
    built-in form and is an error."""
    if not algorithms:
        raise ValueError("At least one hash algorithm is required")
    b = c.cast("binary")
    known = {"crc32": crc32_hex(b), "md5": F.md5(b), "sha1": F.sha1(b), "sha256": F.sha2(b, 256)}
    out = []
    for a in dict.fromkeys(map(algorithm_name, algorithms)):
        if a not in known:
            raise ValueError(f"{a} needs a package that is not installed")
        out.append(known[a].alias(a))
    return out


class _Crc32:
    def __init__(self):
        self.value = 0

    def update(self, data: bytes) -> None:
        self.value = zlib.crc32(data, self.value)

    def hexdigest(self) -> str:
        return f"{self.value:08x}"


def new_hasher(algorithm: str):
    a = algorithm_name(algorithm)
    if a == "blake3":
        try:
            import blake3
        except ImportError:
            raise ValueError("blake3 needs a package that is not installed") from None
        return blake3.blake3()
    return _Crc32() if a == "crc32" else hashlib.new(a)


def stream_hashes(stream, algorithms: tuple[str, ...], chunk: int = CHUNK) -> tuple[int, dict[str, str]]:
    """(size, hashes) of a stream in one pass, a chunk in memory at a time."""
    if chunk <= 0:
        raise ValueError("The chunk size must be positive")
    if not algorithms:
        raise ValueError("At least one hash algorithm is required")
    hs = {a: new_hasher(a) for a in dict.fromkeys(map(algorithm_name, algorithms))}
    size = 0
    while data := stream.read(chunk):
        size += len(data)
        for h in hs.values():
            h.update(data)
    return size, {a: h.hexdigest() for a, h in hs.items()}


def _opened(path: str):
    """A stream of a file on any file system the path names."""
    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _source(spark: SparkSession, path: str, recursive: bool) -> tuple[DataFrame, DataFrame]:
    """(files with contents, paths of empty files); the scan leaves out empty
    files, so they are taken from its listing, which the driver holds anyway."""
    src = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = [(re.sub(r"^file:/+", "file:/", unquote(f)),) for f in src.inputFiles()]
    listed = spark.createDataFrame(named, "path string")
    return src, listed.join(src.select("path"), "path", "left_anti")


def input_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the files below a folder, by path; contents are not read."""
    src, empty = _source(spark, path, recursive)
    return src.select("path", "length").unionByName(empty.withColumn("length", F.lit(0).cast("long"))).orderBy("path")


def file_hashes(spark: SparkSession, path: str, algorithms: tuple[str, ...] = ("crc32", "md5", "sha1", "sha256"), recursive: bool = True, stream_over: int = 256 << 20) -> DataFrame:
    """(path, size_bytes, hashes): small files by built-in functions over their
    contents, files over ``stream_over`` bytes read in chunks where they lie."""
    names = list(dict.fromkeys(map(algorithm_name, algorithms)))
    src, empty = _source(spark, path, recursive)
    none = empty.select("path", F.lit(0).cast("long").alias("size_bytes"), *column_hashes(F.lit(""), tuple(names)))
    small = src.where(F.col("length") <= stream_over).select("path", F.col("length").alias("size_bytes"), *column_hashes(F.col("content"), tuple(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with _opened(p) as f:
                    size, hs = stream_hashes(f, tuple(names))
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([size]), *[pa.array([hs[a]]) for a in names]], names=["path", "size_bytes", *names])

    large = src.where(F.col("length") > stream_over).select("path").mapInArrow(run, "path string, size_bytes long, " + ", ".join(f"{a} string" for a in names))
    return small.unionByName(none).unionByName(large)
