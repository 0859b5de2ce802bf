"""Where files come from: ancestors in the containment graph and their sources."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.hashes import strip
from idloom.operators.identity import append_missing
from idloom.operators.joins import lookup, numbered
from idloom.operators.search import first_values
from idloom.session import Scratch, count_rows

MOST_DEPTH = 128
RECORD_FIELDS = ["ia_identifier", "ia_item_url", "ia_file_url", "ia_file_name", "ia_file_source", "ia_file_format"]
#: Where a source's reference is found, by preference.
REFERENCES = ("ia_file_url", "ia_item_url", "dat_filename")
SOURCE_REFERENCES = {"internet_archive": ("ia_file_url", "ia_item_url", "ia_identifier"), "logiqx_dat": ("dat_filename", "dat_source_name")}
SOURCE_LABELS = {"internet_archive": "Internet Archive", "logiqx_dat": "Logiqx DAT"}


#: Files a task takes, and rows of files and edges that all tasks may take together:
#: each task has all edges (16 bytes an edge).
TASK_FILES = 50_000
LOCAL_ROWS = 20_000_000


def _climb(most_depth: int, top_only: bool):
    """All levels above a share of the files, with all edges at hand; with ``top_only``
    one row a file: of the highest level with a target the one of least rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        kind, a, b = (t.column(c).to_numpy() for c in ("kind", "a", "b"))
        child, parent = a[kind == 0], b[kind == 0]
        order = np.argsort(child, kind="stable")
        child, parent = child[order], parent[order]
        mine, (target, rank) = a[kind == 1], (a[kind == 2], b[kind == 2])
        order = np.argsort(target, kind="stable")
        target, rank = target[order], rank[order]

        def ranks(at: np.ndarray) -> np.ndarray:
            """Rank of each target, -1 for what is none."""
            if not len(target):
                return np.full(len(at), -1, np.int64)
            i = np.minimum(np.searchsorted(target, at), len(target) - 1)
            return np.where(target[i] == at, rank[i], -1)

        # a part of the files at a time, so that a level's pairs stay few
        for s in range(0, len(mine), 50_000):
            file = at = np.sort(mine[s : s + 50_000])
            names, best, best_depth = file, np.full(len(file), -1, np.int64), np.zeros(len(file), np.int32)
            for depth in range(most_depth + 1):
                if top_only:
                    r = ranks(at)
                    hit = np.flatnonzero(r >= 0)
                    hit = hit[np.lexsort((r[hit], file[hit]))]
                    hit = hit[np.concatenate([[True], file[hit][1:] != file[hit][:-1]])] if len(hit) else hit
                    i = np.searchsorted(names, file[hit])
                    best[i], best_depth[i] = at[hit], depth
                else:
                    for k in range(0, len(file), 100_000):
                        f, x = file[k : k + 100_000], at[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(x), pa.array(np.full(len(f), depth, np.int32))], names=["file_id", "ancestor_id", "depth"])
                lo, hi = np.searchsorted(child, at, "left"), np.searchsorted(child, at, "right")
                n = hi - lo
                if not n.sum():
                    break
                file = np.repeat(file, n)
                at = parent[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                order = np.lexsort((at, file))
                file, at = file[order], at[order]
                new = np.concatenate([[True], (file[1:] != file[:-1]) | (at[1:] != at[:-1])])
                file, at = file[new], at[new]
            if top_only and len(got := np.flatnonzero(best >= 0)):
                yield pa.RecordBatch.from_arrays([pa.array(names[got]), pa.array(best[got]), pa.array(best_depth[got])], names=["file_id", "ancestor_id", "depth"])

    return run


def _links_up(scratch: Scratch, members: DataFrame) -> DataFrame:
    return scratch.save(members.where("child_file_id is not null and parent_file_id is not null").select(F.col("child_file_id").cast("long").alias("ancestor_id"), F.col("parent_file_id").cast("long").alias("up")).distinct(), "up")


def _ids(files: DataFrame) -> DataFrame:
    return files.where("id is not null").select(F.col("id").cast("long").alias("file_id")).distinct()


def _placed(ids: DataFrame, everywhere: list[DataFrame], n_files: int, local_rows: int) -> DataFrame | None:
    """A share of the files a task, as many tasks as they ask for, with the rows that
    all tasks need; None if that were more than ``local_rows`` rows."""
    tasks = max(1, -(-n_files // TASK_FILES))
    if n_files + tasks * sum(map(count_rows, everywhere)) > local_rows:
        return None
    placed = ids.select(F.pmod(F.xxhash64("file_id"), F.lit(tasks)).cast("int").alias("task"), F.lit(1).alias("kind"), F.col("file_id").alias("a"), F.col("file_id").alias("b"))
    for kind, rows in zip((0, 2), everywhere):
        a, b = rows.columns
        placed = placed.unionByName(rows.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")))
    return placed.repartitionById(tasks, F.col("task")).select("kind", "a", "b")


def ancestors(files: DataFrame, members: DataFrame, most_depth: int = MOST_DEPTH, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(file_id, ancestor_id, depth): all ancestors of files (``id``), each depth
    at which one is reached once; depth 0 is the file. Depths are path lengths,
    so in a circle they go on to ``most_depth``.

    Where the edges fit a task and all tasks together take ``local_rows`` rows at
    most, tasks take a share of the files and all edges; beyond, each level is one
    distributed join.
    """
    scratch = Scratch(files.sparkSession)
    up, ids = _links_up(scratch, members), _ids(files)
    placed = _placed(ids, [up], count_rows(ids), local_rows)
    if placed is not None:
        return placed.mapInArrow(_climb(most_depth, False), LEVELS)
    level = scratch.save(ids.select("file_id", F.col("file_id").alias("ancestor_id"), F.lit(0).alias("depth")), "level")
    out = level
    for _ in range(most_depth):
        level = scratch.save(lookup_up(level, up).select("file_id", F.col("up").alias("ancestor_id"), (F.col("depth") + 1).alias("depth")).distinct(), "level")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


LEVELS = "file_id long, ancestor_id long, depth int"


def lookup_up(level: DataFrame, up: DataFrame) -> DataFrame:
    """A level joined with the edges up; an archive that many files are in is hot, and
    its few parents are gathered to one row that is broadcast (``lookup``)."""
    gathered = up.groupBy("ancestor_id").agg(F.collect_set("up").alias("ups"))
    return lookup(level, gathered, ["ancestor_id"], "inner").select("file_id", "depth", F.explode("ups").alias("up"))


def top_ancestors(files: DataFrame, members: DataFrame, targets: DataFrame, most_depth: int = MOST_DEPTH, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(file_id, ancestor_id): of a file's ancestors (itself among them) that are
    targets (id, rank) the highest, of several there the one of least rank.

    As ``ancestors``, but a task keeps one ancestor a file while it climbs, so no
    level leaves it.
    """
    scratch = Scratch(files.sparkSession)
    targets = scratch.save(targets.select(F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank")), "targets")
    up, ids = _links_up(scratch, members), _ids(files)
    placed = _placed(ids, [up, targets], count_rows(ids), local_rows)
    if placed is not None:
        return placed.mapInArrow(_climb(most_depth, True), LEVELS).select("file_id", "ancestor_id")
    good = lookup(ancestors(files, members, most_depth, local_rows), targets.withColumnRenamed("id", "ancestor_id"), ["ancestor_id"], "inner")
    return good.groupBy("file_id").agg(F.min_by("ancestor_id", F.struct(-F.col("depth"), F.col("rank"))).alias("ancestor_id"))


def record_origin(files: DataFrame, members: DataFrame, meta: DataFrame) -> DataFrame:
    """(file_id, source_file_id, the record fields): the crawled record of the
    top-most ancestor that has an identifier or an item's address."""
    known = Scratch(files.sparkSession).save(first_values(meta, RECORD_FIELDS).where("ia_identifier is not null or ia_item_url is not null").withColumnRenamed("file_id", "source_file_id"), "records")
    top = top_ancestors(files, members, known.select(F.col("source_file_id").alias("id"), F.col("source_file_id").alias("rank"))).withColumnRenamed("ancestor_id", "source_file_id")
    return lookup(top, known, ["source_file_id"], "inner").select("file_id", "source_file_id", *RECORD_FIELDS)


def source_rows(meta: DataFrame) -> DataFrame:
    """(file_id, source_value, external_reference) of the files' ``source`` rows;
    a file's reference is its first value of the preferred names."""
    refs = first_values(meta, list(REFERENCES))
    own = meta.where("name = 'source'").select("file_id", strip(F.col("value")).alias("source_value")).where("source_value <> ''").distinct()
    return own.join(refs, "file_id", "left").select("file_id", "source_value", F.coalesce(*REFERENCES, F.lit("")).alias("external_reference"))


def source_label(c):
    out = F.lit(None).cast("string")
    for k, v in SOURCE_LABELS.items():
        out = F.when(c == k, v).otherwise(out)
    return F.coalesce(out, c)


def top_source(files: DataFrame, members: DataFrame, meta: DataFrame) -> DataFrame:
    """(file_id, source_file_id, source_value, external_reference): the source of
    the top-most ancestor that has one; the least value, then the least file, of
    several at that depth."""
    least = source_rows(meta).groupBy("file_id").agg(F.min(F.struct("source_value", "external_reference")).alias("s")).select(F.col("file_id").alias("source_file_id"), "s.*")
    ranked = Scratch(files.sparkSession).save(numbered(least, [F.col("source_value"), F.col("source_file_id")], "rank"), "sources")
    top = top_ancestors(files, members, ranked.select(F.col("source_file_id").alias("id"), "rank")).withColumnRenamed("ancestor_id", "source_file_id")
    return lookup(top, ranked.drop("rank"), ["source_file_id"], "inner").select("file_id", "source_file_id", "source_value", "external_reference")


def source_entries(meta: DataFrame) -> DataFrame:
    """(file_id, source_value, label, external_reference) as an import stores them:
    the reference names depend on the source."""
    names = sorted({n for v in SOURCE_REFERENCES.values() for n in v})
    cleanv = meta.withColumn("value", F.nullif(strip(F.col("value")), F.lit(""))).where("value is not null")
    refs = first_values(cleanv, names)
    own = cleanv.where("name = 'source'").select("file_id", F.col("value").alias("source_value")).distinct()
    ref = F.lit(None).cast("string")
    for s, ns in SOURCE_REFERENCES.items():
        ref = F.when(F.col("source_value") == s, F.coalesce(*ns)).otherwise(ref)
    return own.join(refs, "file_id", "left").select("file_id", "source_value", source_label(F.col("source_value")).alias("label"), F.coalesce(ref, F.lit("")).alias("external_reference"))


@dataclass
class Sources:
    """Sources by name with a description, and which file has which, with a reference."""

    sources: DataFrame
    file_sources: DataFrame


def add_sources(stored: Sources, meta: DataFrame) -> Sources:
    """The sources that metadata rows name, added to the stored ones.

    A source is stored once by its name; a missing description is filled in. A
    file, source and reference are stored once.
    """
    entries = source_entries(meta)
    named = entries.groupBy(F.col("source_value").alias("name")).agg(F.min("label").alias("label"))
    known = stored.sources.join(named, "name", "left").select("id", "name", F.coalesce("description", "label").alias("description"))
    fresh = append_missing(stored.sources, named.select("name", F.col("label").alias("description")), ["name"])
    sources = known.unionByName(fresh.select("id", "name", "description"))
    links = entries.join(sources.select(F.col("name").alias("source_value"), F.col("id").alias("source_id")), "source_value").select("file_id", "source_id", "external_reference")
    key = ["file_id", "source_id", "external_reference"]
    return Sources(sources, stored.file_sources.select(*key).unionByName(links.join(stored.file_sources, key, "left_anti").distinct()))


def source_catalog(sources: DataFrame, meta: DataFrame) -> DataFrame:
    """All different source values: stored ones and those in metadata."""
    own = meta.where("name = 'source'").select(strip(F.col("value")).alias("source_value"))
    return sources.select(strip(F.col("name")).alias("source_value")).unionByName(own).where("source_value <> ''").distinct()


def resolved_sources(stored: Sources, meta: DataFrame) -> DataFrame:
    """(file_id, source_value, external_reference) of stored links and of metadata."""
    named = stored.sources.select(F.col("id").alias("source_id"), strip(F.col("name")).alias("source_value")).where("source_value <> ''")
    links = stored.file_sources.join(named, "source_id").select("file_id", "source_value", "external_reference")
    return links.unionByName(source_rows(meta)).distinct()
