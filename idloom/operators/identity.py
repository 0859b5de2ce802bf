"""Exact identities: finding, consolidating, enriching, and their conflicts.

An identity is (size_bytes, crc32, md5, sha1); sha256 and blake3 are enrichment.
State is given and returned as DataFrames; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.hashes import OPTIONAL, REQUIRED, clean_hash
from idloom.functions.scalars import identity_error
from idloom.operators.joins import hot_hashes, lookup, numbered
from idloom.session import Scratch

KEY = ["size_bytes", *REQUIRED]


def cleaned(observations: DataFrame, order: str = "obs_id") -> DataFrame:
    """(seq, size_bytes, hashes, error, and the other columns) of observations."""
    have = set(observations.columns)
    hashes = {a: clean_hash(F.col(a)) if a in have else F.lit(None).cast("string") for a in (*REQUIRED, *OPTIONAL)}
    rest = [F.col(c) for c in observations.columns if c not in (*hashes, "size_bytes", order)]
    df = observations.select(F.col(order).cast("long").alias("seq"), F.col("size_bytes").cast("long").alias("size_bytes"), *[h.alias(a) for a, h in hashes.items()], *rest)
    return df.withColumn("error", identity_error(F.col("size_bytes"), {a: F.col(a) for a in hashes}))


def probe(observations: DataFrame, files: DataFrame) -> DataFrame:
    """Observations with ``file_id`` of the stored identity, null if there is none."""
    stored = files.groupBy(*KEY).agg(F.min("id").alias("file_id"))
    return lookup(observations, stored, KEY)


def overlap_classes(files: DataFrame) -> DataFrame:
    """(size_bytes, algorithm, value, file_id, first_file_id, n_files): files that
    share the size and one required hash with a file of another identity.

    One row for each file and shared value, with the oldest file that has it, in
    place of all pairs, so a value that many files share costs a row each.
    """
    ids = files.groupBy(*KEY).agg(F.min("id").alias("file_id"))
    each = ids.select("size_bytes", "file_id", F.explode(F.create_map(*[x for a in REQUIRED for x in (F.lit(a), F.col(a))])).alias("algorithm", "value")).where("value is not null")
    groups = each.groupBy("size_bytes", "algorithm", "value").agg(F.min("file_id").alias("first_file_id"), F.count(F.lit(1)).alias("n_files")).where("n_files > 1")
    return each.join(groups, ["size_bytes", "algorithm", "value"])


#: Kinds of conflicts, and the words of a note.
MISMATCH, OVERLAP = "optional_hash_mismatch", "required_hash_overlap"
NOTE = ("Distinct required identity tuples share exact size and ", "; stored as separate UFID records")
#: What makes a conflict the same as one that is logged already.
CONFLICT_KEY = ["file_id", "related_file_id", "conflict_type", "algorithm", "existing_value", "incoming_value", "incoming_size_bytes", *[f"incoming_{a}" for a in REQUIRED], "notes"]


class Imported:
    """What an import gives: one report row an observation, all files after it,
    and the conflicts it logs. Files and conflicts are computed when asked for."""

    def __init__(self, report: DataFrame, files: Callable[[], tuple[DataFrame, DataFrame]], mismatches: Callable[[DataFrame], DataFrame]):
        self.report, self._files, self._mismatches = report, files, mismatches

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        return self._files()

    @property
    def files(self) -> DataFrame:
        return self._both[0].unionByName(self._both[1])

    @property
    def created(self) -> DataFrame:
        return self._both[1]

    @property
    def mismatches(self) -> DataFrame:
        return self._mismatches(self.created)

    @property
    def overlaps(self) -> DataFrame:
        return overlap_conflicts(self.files, self.created)

    @property
    def conflicts(self) -> DataFrame:
        """Rejected optional hashes, and required hashes that new files share with older ones."""
        return self.mismatches.unionByName(self.overlaps)


def consolidate(files: DataFrame, meta: DataFrame, observations: DataFrame, entries: Column) -> Imported:
    """Apply cleaned observations in the order of ``seq`` to stored files.

    The first observation of a new identity creates it. An optional hash is
    stored by the first observation that has it and contradicts no optional hash
    stored by then; one that contradicts is rejected as a conflict and gives
    nothing, neither its other hash nor metadata. An accepted observation of a
    known identity is enriched if it fills an optional hash or brings a metadata
    row (``entries``: array of metadata_type, name, value, notes) not yet there,
    else unchanged. Rows with an error are reported with it.

    No group is gathered: an identity's two optional hashes are set at most once
    each, so aggregates with map-side combine find who sets them: first by
    identity, then among the rows that have an optional hash only.
    """
    scratch = Scratch(files.sparkSession)
    good = observations.where("error is null").withColumn("entries", entries)
    hot = hot_hashes(good, KEY)
    stored = files.groupBy(*KEY).agg(F.min("id").alias("file_id"), *[F.max_by(o, "id").alias(f"old_{o}") for o in OPTIONAL])
    # written between the steps, so that neither is computed again by the next
    base = scratch.save(lookup(good, stored, KEY, hot=hot), "base")
    s, b = OPTIONAL
    fits = lambda known: F.coalesce(F.col(s) == known[s], F.lit(True)) & F.coalesce(F.col(b) == known[b], F.lit(True))
    fills = lambda known: (F.col(s).isNotNull() & known[s].isNull()) | (F.col(b).isNotNull() & known[b].isNull())
    old = {o: F.col(f"old_{o}") for o in OPTIONAL}
    setter = F.struct("seq", s, b)
    first = base.groupBy(*KEY).agg(F.min("seq").alias("first_seq"), F.min(F.when(fits(old) & fills(old), setter)).alias("one"))
    # a second one may fill the hash that the first left open
    cur = {o: F.coalesce(old[o], F.col("one")[o]) for o in OPTIONAL}
    given = lookup(base.where(F.coalesce(s, b).isNotNull()), first.where("one is not null"), KEY, "inner", hot)
    second = given.where((F.col("seq") > F.col("one")["seq"]) & fits(cur) & fills(cur)).groupBy(*KEY).agg(F.min(setter).alias("two"))
    full = scratch.save(lookup(base, first.join(second, KEY, "left"), KEY, hot=hot), "full")
    at = {o: F.coalesce(old[o], F.when(F.col("one")["seq"] < F.col("seq"), F.col("one")[o]), F.when(F.col("two")["seq"] < F.col("seq"), F.col("two")[o])) for o in OPTIONAL}
    clash = {o: F.coalesce(F.col(o) != at[o], F.lit(False)) for o in OPTIONAL}
    full = full.withColumns({f"at_{o}": at[o] for o in OPTIONAL} | {"rejected": clash[s] | clash[b]})
    new = F.col("file_id").isNull() & (F.col("seq") == F.col("first_seq"))
    filled = (F.col("seq") == F.col("one")["seq"]) | (F.col("seq") == F.col("two")["seq"])
    rows = full.where("not rejected").select(*KEY, "file_id", "seq", F.explode("entries").alias("e")).select(*KEY, "file_id", "seq", "e.*").withColumn("notes", F.coalesce("notes", F.lit("")))
    firsts = rows.groupBy(*KEY, "metadata_type", "name", "value", "notes").agg(F.min("seq").alias("seq"), F.first("file_id").alias("file_id"))
    known = meta.select("file_id", "metadata_type", "name", "value", F.coalesce("notes", F.lit("")).alias("notes"))
    fresh = firsts.join(known, ["file_id", "metadata_type", "name", "value", "notes"], "left_anti").select("seq").distinct().withColumn("fresh", F.lit(True))
    judged = full.join(fresh, "seq", "left")
    status = F.when(F.col("rejected"), "conflict").when(new, "created").when(F.coalesce(filled, F.lit(False)) | F.col("fresh").isNotNull(), "enriched").otherwise("unchanged")
    ok = judged.select("seq", status.alias("status"), F.lit(None).cast("string").alias("error"))
    report = ok.unionByName(observations.where("error is not null").select("seq", F.lit("error").alias("status"), "error"))

    def after() -> tuple[DataFrame, DataFrame]:
        ends = full.groupBy(*KEY).agg(F.min("file_id").alias("file_id"), F.min("first_seq").alias("first_seq"), *[F.max(F.coalesce(old[o], F.col("one")[o], F.col("two")[o])).alias(o) for o in OPTIONAL])
        top = files.agg(F.max("id")).first()[0] or 0
        created = numbered(ends.where("file_id is null"), [F.col("first_seq")], "id", top + 1).select("id", *KEY, *OPTIONAL)
        seen = ends.where("file_id is not null").select(F.col("file_id").alias("id"), *[F.col(o).alias(f"new_{o}") for o in OPTIONAL])
        return files.join(seen, "id", "left").select("id", *KEY, *[F.coalesce(o, f"new_{o}").alias(o) for o in OPTIONAL]), created

    def mismatches(created: DataFrame) -> DataFrame:
        each = F.explode(F.array_compact(F.array(*[F.when(clash[o], F.struct(F.lit(o).alias("algorithm"), F.col(f"at_{o}").alias("existing_value"), F.col(o).alias("incoming_value"))) for o in OPTIONAL])))
        rejected = full.where("rejected").select("seq", "file_id", *KEY, each.alias("c")).select("seq", "file_id", *KEY, "c.*")
        named = lookup(rejected, created.select(*KEY, F.col("id").alias("new_id")), KEY, hot=hot)
        return named.select("seq", F.coalesce("file_id", "new_id").alias("file_id"), F.lit(None).cast("long").alias("related_file_id"), F.lit(MISMATCH).alias("conflict_type"), "algorithm", "existing_value", "incoming_value", *_incoming(), F.lit(None).cast("string").alias("notes"))

    return Imported(report, after, mismatches)


def _incoming() -> list[Column]:
    return [F.col(k).alias(f"incoming_{k}") for k in KEY]


def overlap_conflicts(files: DataFrame, created: DataFrame) -> DataFrame:
    """Conflicts of new files that share the size and one required hash with older
    ones: (seq, and the columns of ``CONFLICT_KEY``), seq being null.

    All files with that size and hash are one class, and each new file gives one
    row, against the oldest of its class, in place of a row for each older file:
    ``conflicts_of`` opens the classes of one file.
    """
    parts = F.explode(F.create_map(*[x for a in REQUIRED for x in (F.lit(a), F.col(a))])).alias("algorithm", "incoming_value")
    oldest = files.select("id", "size_bytes", parts).where("incoming_value is not null").groupBy("size_bytes", "algorithm", "incoming_value").agg(F.min("id").alias("file_id"))
    mine = created.select(F.col("id").alias("related_file_id"), "size_bytes", *_incoming(), parts)
    rows = lookup(mine, oldest, ["size_bytes", "algorithm", "incoming_value"], "inner").where("file_id < related_file_id")
    note = F.concat(F.lit(NOTE[0]), "algorithm", F.lit(NOTE[1]))
    return rows.select(F.lit(None).cast("long").alias("seq"), "file_id", "related_file_id", F.lit(OVERLAP).alias("conflict_type"), "algorithm", F.col("incoming_value").alias("existing_value"), "incoming_value", *[f"incoming_{k}" for k in KEY], note.alias("notes"))


def log_conflicts(logged: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicts not logged yet, one for each ``CONFLICT_KEY``, with ids that follow on."""
    return append_missing(logged, conflicts.select(*CONFLICT_KEY), CONFLICT_KEY)


def conflicts_of(logged: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    """A file's conflicts from either side: its mismatches, and one overlap for each
    file that shares the size and a required hash, if the newer of both logged one.

    The log has a row for each new file of a class; ``files`` has who else is in it.
    """
    parts = F.explode(F.create_map(*[x for a in REQUIRED for x in (F.lit(a), F.col(a))])).alias("algorithm", "value")
    each = files.select("id", *KEY, parts).where("value is not null")
    cls = ["size_bytes", "algorithm", "value"]
    me = F.broadcast(each.where(F.col("id") == file_id).select(*cls, *[F.col(a).alias(f"my_{a}") for a in REQUIRED]))
    newer = F.col("id") > file_id
    mates = each.where(F.col("id") != file_id).join(me, cls)
    pairs = mates.select(F.least("id", F.lit(file_id)).alias("file_id"), F.greatest("id", F.lit(file_id)).alias("related_file_id"), F.lit(OVERLAP).alias("conflict_type"), "algorithm", F.col("value").alias("existing_value"), F.col("value").alias("incoming_value"), F.col("size_bytes").alias("incoming_size_bytes"), *[F.when(newer, F.col(a)).otherwise(F.col(f"my_{a}")).alias(f"incoming_{a}") for a in REQUIRED])
    pairs = pairs.withColumn("notes", F.concat(F.lit(NOTE[0]), "algorithm", F.lit(NOTE[1])))
    seen = logged.where(F.col("conflict_type") == OVERLAP).select("related_file_id", "algorithm").distinct()
    other = logged.where((F.col("conflict_type") != OVERLAP) & ((F.col("file_id") == file_id) | (F.col("related_file_id") == file_id)))
    return other.select(*CONFLICT_KEY).unionByName(pairs.join(seen, ["related_file_id", "algorithm"], "left_semi").select(*CONFLICT_KEY)).orderBy("file_id", "related_file_id", "algorithm")


def conflict_counts(logged: DataFrame) -> DataFrame:
    """(file_id, n_conflicts): logged rows a file stands in, on either side."""
    sides = logged.select(F.explode(F.array_distinct(F.array("file_id", "related_file_id"))).alias("file_id")).where("file_id is not null")
    return sides.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_conflicts"))


def append_missing(state: DataFrame, incoming: DataFrame, key: list[str], id_column: str = "id") -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``state``, one for each key, with
    ids that follow on; null is equal to null."""
    marks = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(key)]
    ks = [f"_k{i}" for i in range(len(key))]
    fresh = incoming.select("*", *marks).dropDuplicates(ks).join(state.select(*marks).distinct(), ks, "left_anti").drop(*ks)
    top = state.agg(F.max(id_column)).first()[0] or 0
    return numbered(fresh.drop(id_column) if id_column in fresh.columns else fresh, [F.col(k) for k in key], id_column, top + 1)


def drop_cascade(gone: DataFrame, id_column: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Tables without the rows that point, by any of their columns, to what is gone."""
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone.select(F.col(id_column).alias(c)).distinct(), c, "left_anti")
        out[name] = df
    return out
