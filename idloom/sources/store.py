"""Where tables are kept: versioned snapshots in a folder, databases by JDBC, and a
remote service by requests.

A snapshot is whole once its mark is there, which is made by one rename after all
data; readers take the newest whole one, so a write that breaks is never seen.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.sources.crawl_source import Gate, fetch

# -- snapshots -----------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM, which knows every scheme the session does."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions, in order."""
    fs, p = _files(spark, folder)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n[5:]) for n in names if n.startswith("mark-") and n[5:].isdigit())


def version(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v{n}")


def mark(spark: SparkSession, folder: str, n: int) -> None:
    """Make version ``n`` whole; again is no error."""
    fs, making = _files(spark, f"{folder}/making-{n}")
    done = _files(spark, f"{folder}/mark-{n}")[1]
    fs.create(making, True).close()
    if not fs.exists(done) and not fs.rename(making, done):
        raise OSError(f"could not mark version {n}")


def drop_versions(spark: SparkSession, folder: str, numbers: list[int]) -> None:
    for n in numbers:
        for path in (f"{folder}/mark-{n}", f"{folder}/v{n}"):
            fs, p = _files(spark, path)
            fs.delete(p, True)


class Store:
    """Tables by name below ``root``, each with its versions; the last ``keep`` stay."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)

    def write(self, name: str, df: DataFrame) -> int:
        """The number of the version that ``df`` became."""
        folder = f"{self.root}/{name}"
        seen = versions(self.spark, folder)
        n = seen[-1] + 1 if seen else 0
        df.write.mode("overwrite").parquet(f"{folder}/v{n}")
        mark(self.spark, folder, n)
        drop_versions(self.spark, folder, [*seen, n][: -self.keep])
        return n

    def read(self, name: str) -> DataFrame:
        folder = f"{self.root}/{name}"
        seen = versions(self.spark, folder)
        if not seen:
            raise LookupError(f"there is no table {name}")
        return version(self.spark, folder, seen[-1])

    def names(self) -> list[str]:
        fs, p = _files(self.spark, self.root)
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if versions(self.spark, f"{self.root}/{n}"))


# -- databases -----------------------------------------------------------------------


def read_database(spark: SparkSession, url: str, name: str, id_column: str | None = None, rows_per_task: int = 1_000_000, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a database; by ranges of ``id_column``, if given, in as many tasks
    as its rows ask for. Filters and columns are left to the database."""
    read = lambda **o: spark.read.format("jdbc").options(**(properties or {}), url=url, **o).load()
    if id_column is None:
        return read(dbtable=name)
    low, high, n = read(query=f"select min({id_column}) as a, max({id_column}) as b, count(*) as n from {name}").first()
    if not n:
        return read(dbtable=name)
    return read(dbtable=name, partitionColumn=id_column, lowerBound=low, upperBound=high, numPartitions=max(1, ceil(n / rows_per_task)))


def write_database(df: DataFrame, url: str, name: str, mode: str = "append", rows_per_batch: int = 5_000, connections: int = 8, properties: dict[str, str] | None = None) -> None:
    """Rows into a table of a database, over at most so many connections."""
    df.coalesce(connections).write.format("jdbc").options(**(properties or {})).option("url", url).option("dbtable", name).option("batchsize", rows_per_batch).mode(mode).save()


# -- a remote service ----------------------------------------------------------------

ANSWERS = "place long, answer string, error string"


def _call(module: str) -> Callable:
    name, _, fn = module.partition(":")
    return getattr(importlib.import_module(name), fn)


def sent(requests: DataFrame, module: str, connections: int = 4, retries: int = 5, least_wait: float = 0.0) -> DataFrame:
    """(place, answer, error) of requests (place, kind, body), ``body`` as JSON.

    ``module`` names ``module:function`` for ``(kind, body) -> (status, headers,
    body)``. Busy answers are tried again; what fails is a row with its error, so
    that a batch can be sent again from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, gate = _call(module), Gate(least_wait)
        for b in batches:
            out = []
            for place, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    got = fetch(lambda k=kind, x=body: call(k, json.loads(x)), retries, gate=gate)
                    out.append((place, got.decode() if isinstance(got, bytes) else str(got), None))
                except (OSError, ValueError) as e:
                    out.append((place, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["place", "answer", "error"])

    return requests.select(F.col("place").cast("long"), "kind", "body").repartition(connections).mapInArrow(run, ANSWERS)


def requests_of(rows: DataFrame, kind: str, place: str = "id") -> DataFrame:
    """Rows as requests: every other column is a field of the body, nulls left out."""
    return rows.select(F.col(place).cast("long").alias("place"), F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in rows.columns if c != place])).alias("body"))


def found_by_hash(queries: DataFrame, module: str, **how) -> DataFrame:
    """(place, file_id, error) of queries (id, algorithm, value, size?) to a service
    that answers ``{"found": ..., "file": {"id": ...}}``."""
    got = sent(requests_of(queries, "find_file_by_hash"), module, **how)
    file_id = F.when(F.get_json_object("answer", "$.found") == "true", F.get_json_object("answer", "$.file.id").try_cast("long"))
    return got.select("place", file_id.alias("file_id"), "error")
