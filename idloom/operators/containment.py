"""Containment rows: members, empty directories, and appending new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.scalars import archive_path, parent_directories
from idloom.operators.identity import append_missing


def list_members(members: DataFrame, parent_file_id: int) -> DataFrame:
    """Members of one archive by path (rows without one first), then id."""
    return members.where(F.col("parent_file_id") == parent_file_id).orderBy(F.col("archive_path").asc_nulls_first(), "id")


def empty_directories(members: DataFrame) -> DataFrame:
    """(parent_file_id, directory): directories of an archive that are above no
    file and no other directory's file; a directory is a row without a child."""
    rows = members.where("archive_path is not null and parent_file_id is not null").select("parent_file_id", "child_file_id", archive_path(F.col("archive_path")).alias("path"))
    dirs = rows.where("child_file_id is null").select("parent_file_id", F.col("path").alias("directory")).distinct()
    used = rows.where("child_file_id is not null").select("parent_file_id", F.explode(parent_directories(F.col("path"))).alias("directory")).distinct()
    return dirs.join(used, ["parent_file_id", "directory"], "left_anti")


def add_members(members: DataFrame, incoming: DataFrame) -> DataFrame:
    """New rows of ``incoming`` with ids: a row needs a parent, and a child or a
    path; the same parent, child and path (null equal to null) is stored once."""
    ok = incoming.where("parent_file_id is not null and (child_file_id is not null or archive_path <> '')")
    return append_missing(members, ok.select("parent_file_id", "child_file_id", "archive_path"), ["parent_file_id", "child_file_id", "archive_path"])
