"""Table functions for SQL: members of archives, and rows of catalogues.

``register(spark)`` makes ``archive_entries(payload, name)`` and
``parse_dat(text, filename)`` known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from idloom.sources import archives, dat

ENTRIES = "path string, depth int, is_empty_directory boolean, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, error string"
DAT_ROWS = "place long, " + ", ".join(f"{f} string" for f in dat.FIELDS) + ", error string"


class ArchiveEntries:
    """All members of an archive, nested ones too; nothing for a null payload."""

    def eval(self, payload: bytes, name: str) -> Iterator[tuple]:
        if payload is None:
            return
        for path, depth, e, h in archives.walk(bytes(payload), name):
            h = h or {}
            yield path, depth, e.is_empty_directory, None if e.payload is None else len(e.payload), h.get("crc32"), h.get("md5"), h.get("sha1"), h.get("sha256"), e.error


class ParseDat:
    """All rows of a catalogue with their place in it; one row with the error of a bad one."""

    def eval(self, text: str, filename: str) -> Iterator[tuple]:
        try:
            for place, row in enumerate(dat.parse_dat(text, filename)):
                yield place, *(row[f] for f in dat.FIELDS), None
        except dat.DatError as e:
            yield None, *(None for _ in dat.FIELDS), str(e)


def register(spark: SparkSession) -> None:
    spark.udtf.register("archive_entries", udtf(ArchiveEntries, returnType=ENTRIES))
    spark.udtf.register("parse_dat", udtf(ParseDat, returnType=DAT_ROWS))
