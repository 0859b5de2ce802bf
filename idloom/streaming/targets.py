"""Where an import's results go: a store of tables here, or a remote service.

A target takes batches of observations, metadata and members; it can stand behind
``foreachBatch``, as a batch that is applied again adds nothing.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.operators import containment, identity
from idloom.session import Scratch
from idloom.sources.store import Store, requests_of, sent

FILES = "id long, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string"
META = "id long, file_id long, metadata_type string, name string, value string, notes string, added_at timestamp"
MEMBERS = "id long, parent_file_id long, child_file_id long, archive_path string"
KEY = ["file_id", "metadata_type", "name", "value", "notes"]


class Target(ABC):
    """Each method gives a report: one row for what it was given, with a status or an error."""

    @abstractmethod
    def upsert(self, observations: DataFrame, entries: Column) -> DataFrame:
        """Cleaned observations as identities with their metadata: (seq, status, error)."""

    @abstractmethod
    def add_metadata(self, rows: DataFrame) -> DataFrame:
        """(file_id, metadata_type, name, value, notes)"""

    @abstractmethod
    def add_members(self, rows: DataFrame) -> DataFrame:
        """(parent_file_id, child_file_id, archive_path)"""


class StoreTarget(Target):
    """Tables ``files``, ``metadata``, ``members`` and ``conflicts`` of a store, a new
    version each time one changes."""

    def __init__(self, spark: SparkSession, store: Store, now: Column | None = None):
        self.spark, self.store, self.now = spark, store, F.current_timestamp() if now is None else now
        known = store.names()
        conflicts = "id long, " + ", ".join(f"{k} {'long' if k.endswith(('file_id', 'size_bytes')) else 'string'}" for k in identity.CONFLICT_KEY)
        for name, kind in (("files", FILES), ("metadata", META), ("members", MEMBERS), ("conflicts", conflicts)):
            if name not in known:
                store.write(name, spark.createDataFrame([], kind))

    def upsert(self, observations: DataFrame, entries: Column) -> DataFrame:
        files, meta, logged = (self.store.read(n) for n in ("files", "metadata", "conflicts"))
        scratch = Scratch(self.spark)
        observed = scratch.save(observations, "observed")
        done = identity.consolidate(files, meta, observed, entries)
        report = scratch.save(done.report, "report")
        after = scratch.save(done.files, "files")
        taken = observed.join(report.where("status not in ('error', 'conflict')").select("seq"), "seq")
        rows = identity.probe(taken.withColumn("e", F.explode(entries)), after).select("file_id", "e.*")
        new = scratch.save(self._fresh(meta, rows), "metadata")
        more = scratch.save(identity.log_conflicts(logged, done.conflicts), "conflicts")
        self.store.write("files", after)
        self.store.write("metadata", meta.unionByName(new))
        self.store.write("conflicts", logged.unionByName(more.select(*logged.columns)))
        return report

    def _fresh(self, meta: DataFrame, rows: DataFrame) -> DataFrame:
        plain = rows.withColumn("notes", F.coalesce("notes", F.lit("")))
        known = meta.withColumn("notes", F.coalesce("notes", F.lit("")))
        fresh = identity.append_missing(known, plain.select(*KEY), KEY)
        return fresh.withColumns({"notes": F.nullif("notes", F.lit("")), "added_at": self.now}).select("id", *KEY, "added_at")

    def add_metadata(self, rows: DataFrame) -> DataFrame:
        meta = self.store.read("metadata")
        new = Scratch(self.spark).save(self._fresh(meta, rows), "metadata")
        self.store.write("metadata", meta.unionByName(new))
        return new

    def add_members(self, rows: DataFrame) -> DataFrame:
        members = self.store.read("members")
        new = Scratch(self.spark).save(containment.add_members(members, rows).select("id", "parent_file_id", "child_file_id", "archive_path"), "members")
        self.store.write("members", members.unionByName(new))
        return new


class ServiceTarget(Target):
    """A remote service: a request a row, sent by ``module:function`` (see ``store.sent``)."""

    def __init__(self, module: str, **how):
        self.module, self.how = module, how

    def upsert(self, observations: DataFrame, entries: Column) -> DataFrame:
        good = observations.where("error is null").withColumn("metadata", entries)
        got = sent(requests_of(good.drop("error"), "upsert_file", "seq"), self.module, **self.how)
        flag = lambda n: F.get_json_object("answer", f"$.{n}") == "true"
        status = F.when(F.col("error").isNotNull(), "error").when(flag("created"), "created").when(flag("enriched"), "enriched").otherwise("unchanged")
        bad = observations.where("error is not null").select("seq", F.lit("error").alias("status"), "error")
        return got.select(F.col("place").alias("seq"), status.alias("status"), "error").unionByName(bad)

    def _send(self, rows: DataFrame, kind: str) -> DataFrame:
        placed = Scratch(rows.sparkSession).save(rows.withColumn("place", F.monotonically_increasing_id()), "requests")
        return sent(requests_of(placed, kind, "place"), self.module, **self.how)

    def add_metadata(self, rows: DataFrame) -> DataFrame:
        return self._send(rows, "add_file_metadata")

    def add_members(self, rows: DataFrame) -> DataFrame:
        return self._send(rows, "add_archive_member")
