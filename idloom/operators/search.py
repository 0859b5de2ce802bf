"""Looking files up, searching and paging them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.scalars import ALGORITHMS, algorithm_name, contains
from idloom.operators.joins import lookup

PAGE_MOST = 200
#: Order in which a lookup prefers hashes.
PREFERENCE = ("sha256", "blake3", "sha1", "md5", "crc32")


def files_by_hash(files: DataFrame, algorithm: str, value: str, size: int | None = None) -> DataFrame:
    """Files with a hash, newest first. Stored hashes are lower case, so the
    filter is on the plain column and reaches the scan."""
    hit = files.where(F.col(algorithm_name(algorithm)) == value.lower())
    return (hit if size is None else hit.where(F.col("size_bytes") == size)).orderBy(F.col("id").desc())


def newest_by_hash(files: DataFrame, algorithm: str, value: str, size: int | None = None) -> DataFrame:
    """The newest file with a hash, or none."""
    return files_by_hash(files, algorithm, value, size).limit(1)


def count_by_hash(queries: DataFrame, files: DataFrame, algorithm: str) -> DataFrame:
    """Queries with a hash that files have: how many, and the newest of them."""
    name = algorithm_name(algorithm)
    known = files.groupBy(name).agg(F.count(F.lit(1)).alias("n_files"), F.max("id").alias("newest_id"))
    return lookup(queries, known, [name], "inner")


def hash_rows(df: DataFrame, *keep: Column) -> DataFrame:
    """One row for each hash that is given: keep..., algorithm, value."""
    have = [a for a in ALGORITHMS if a in df.columns]
    pairs = F.create_map(*[x for a in have for x in (F.lit(a), F.col(a))])
    return df.select(*keep, F.explode(pairs).alias("algorithm", "value")).where("value is not null")


def lookup_hashes(queries: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, algorithm, file_id): for each query row the newest file of the first
    hash, in the order of preference, that finds any.

    Files are reduced to their newest id a hash value first, so a value that
    many files share joins as one row.
    """
    newest = hash_rows(files, F.col("id")).groupBy("algorithm", "value").agg(F.max("id").alias("file_id"))
    asked = hash_rows(queries, F.col(key).alias("key"))
    hits = lookup(asked, newest, ["algorithm", "value"], "inner")
    rank = F.coalesce(*[F.when(F.col("algorithm") == a, i) for i, a in enumerate(PREFERENCE)])
    return hits.groupBy("key").agg(F.min_by(F.struct("algorithm", "file_id"), rank).alias("h")).select(F.col("key").alias(key), "h.algorithm", "h.file_id")


def first_values(meta: DataFrame, names: list[str]) -> DataFrame:
    """(file_id, one column a name): a file's first value of each name, by time and id."""
    wanted = meta.where(F.col("name").isin(names))
    return wanted.groupBy("file_id").agg(*[F.min_by("value", F.when(F.col("name") == n, F.struct("added_at", "id"))).alias(n) for n in names])


def derived_fields(meta: DataFrame) -> DataFrame:
    """(file_id, display_name, description, content_type); a file type stands in
    for an empty content type."""
    v = first_values(meta, ["filename", "description", "content_type", "filetype"])
    return v.select("file_id", F.col("filename").alias("display_name"), "description", F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.col("filetype")).alias("content_type"))


def file_records(files: DataFrame, meta: DataFrame, members: DataFrame) -> DataFrame:
    """Files with their derived fields and how much belongs to them."""
    n_meta = meta.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("n_metadata"))
    n_members = members.groupBy(F.col("parent_file_id").alias("id")).agg(F.count(F.lit(1)).alias("n_members"))
    d = derived_fields(meta).withColumnRenamed("file_id", "id")
    return files.join(d, "id", "left").join(n_meta, "id", "left").join(n_members, "id", "left").fillna(0, ["n_metadata", "n_members"])


def file_page(page: DataFrame, meta: DataFrame, members: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """The files of one page with nested metadata (by time, id), members (by path,
    id) and conflicts (by id, from either side), as aggregates in one plan. Only
    for pages: nested lists of whole tables would make rows without a bound; use
    ``file_records`` there."""
    ids = F.broadcast(page.select("id"))
    m = meta.join(ids.withColumnRenamed("id", "file_id"), "file_id").groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("added_at", F.col("id").alias("meta_id"), "metadata_type", "name", "value", "notes"))).alias("metadata"))
    a = members.join(ids.withColumnRenamed("id", "parent_file_id"), "parent_file_id").groupBy(F.col("parent_file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("archive_path", F.col("id").alias("member_id"), "child_file_id"))).alias("archive_members"))
    hashes = F.create_map(*[x for h in ALGORITHMS for x in (F.lit(h), F.col(h))]).alias("hashes")
    out = page.select("*", hashes).join(derived_fields(meta.join(ids.withColumnRenamed("id", "file_id"), "file_id")).withColumnRenamed("file_id", "id"), "id", "left").join(m, "id", "left").join(a, "id", "left")
    if conflicts is None:
        return out
    whole = F.struct(F.col("id").alias("conflict_id"), *[c for c in conflicts.columns if c != "id"])
    sides = conflicts.select(F.explode(F.array_distinct(F.array("file_id", "related_file_id"))).alias("side"), whole.alias("c")).withColumnRenamed("side", "id")
    c = sides.join(ids, "id").groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("identity_conflicts"))
    return out.join(c, "id", "left")


def matching_ids(files: DataFrame, meta: DataFrame, members: DataFrame, query: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Ids of files that have the query in one of their columns, metadata, member
    paths or conflicts: a union of ids in place of a disjunction of subqueries."""
    parts = [
        files.where(contains(query, *map(F.col, ("id", "size_bytes", *ALGORITHMS)))).select("id"),
        meta.where(contains(query, *map(F.col, ("metadata_type", "name", "value", "notes")))).select(F.col("file_id").alias("id")),
        members.where(contains(query, F.col("archive_path"))).select(F.col("parent_file_id").alias("id")),
    ]
    if conflicts is not None:
        hit = conflicts.where(contains(query, *map(F.col, ("conflict_type", "algorithm", "existing_value", "incoming_value", "notes"))))
        parts += [hit.select(F.col(c).alias("id")) for c in ("file_id", "related_file_id")]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    return ids.where("id is not null").distinct()


def search_files(files: DataFrame, meta: DataFrame, members: DataFrame, query: str | None, conflicts: DataFrame | None = None) -> DataFrame:
    return files if not query else files.join(matching_ids(files, meta, members, query, conflicts), "id", "left_semi")


def list_files(files: DataFrame, meta: DataFrame, members: DataFrame, limit: int = PAGE_MOST, offset: int = 0, query: str | None = None, sort: str = "id", direction: str = "desc") -> DataFrame:
    """One page of files: sorted by id, size, name or a hash (a missing one as
    an empty text), then by id, newest first."""
    key = (sort or "id").strip().lower()
    if key not in ("id", "name", "size", *ALGORITHMS):
        raise ValueError("sort must be one of: " + ", ".join(sorted(("id", "name", "size", *ALGORITHMS))))
    if (direction := (direction or "desc").strip().lower()) not in ("asc", "desc"):
        raise ValueError("direction must be asc or desc")
    rows = search_files(files, meta, members, query)
    if key == "name":
        rows = rows.join(first_values(meta, ["filename"]).withColumnRenamed("file_id", "id"), "id", "left")
        by = F.lower(F.coalesce("filename", F.lit("")))
    else:
        by = {"id": F.col("id"), "size": F.col("size_bytes")}.get(key)
        by = F.coalesce(F.col(key), F.lit("")) if by is None else by
    return rows.orderBy(by.asc() if direction == "asc" else by.desc(), F.col("id").desc()).offset(max(offset, 0)).limit(min(max(limit, 1), PAGE_MOST))


def page_envelope(count: int, total: int, offset: int) -> dict[str, int | None]:
    """What goes with a page: its size, all rows, and where the next one starts."""
    end = offset + count
    return {"count": count, "total_count": total, "next_offset": end if end < total else None}
