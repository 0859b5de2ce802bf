"""Joins and numbering that do not break on hot keys or large inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.session import Scratch

#: A key is hot from this share of the rows on, so there are at most 64 of them.
HOT_SHARE = 1 / 64
#: Keys a sketch tracks: enough to be sure of all that hold ``HOT_SHARE``.
TRACKED = 4096
#: Parts into which the rows of a hot key are spread.
SPREAD = 16


def hot_hashes(df: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of keys that hold more than ``HOT_SHARE`` of the rows, and 1,000 at least.

    One pass with a sketch of fixed size a task; nothing is shuffled but the
    sketches.  It tracks so many keys that none of these can be missed; a key
    that is named in vain costs no right result.
    """
    got = df.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {int(1 / HOT_SHARE)}, {TRACKED})").alias("top")).first()
    return [r["item"] for r in got["top"] or [] if r["count"] > max(1000, got["n"] * HOT_SHARE)]


def lookup(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "left", hot: list[int] | None = None) -> DataFrame:
    """``big`` joined with a table that has at most one row a key.

    Rows of hot keys (``hot_hashes``, taken from ``big`` unless given) stay where
    they are: the at most 64 matching rows of the other side are broadcast to
    them. All other rows are joined by shuffle. A null key matches nothing.
    """
    hot = hot_hashes(big, keys) if hot is None else hot
    if not hot:
        return big.join(unique, keys, how)
    kinds = dict(big.dtypes)
    is_hot = F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys]).isin(hot)
    warm = big.where(is_hot).join(F.broadcast(unique.where(is_hot)), keys, how)
    return warm.unionByName(big.where(~is_hot).join(unique, keys, how))


def spread_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables that may both have many rows a key.

    Rows of ``a`` with a hot key (``hot_hashes`` of either side) are spread over
    ``SPREAD`` parts by their other columns, and those of ``b`` repeated for each
    part, so that no task has all pairs of a key. Key types must be the same.
    """
    hot = sorted({*hot_hashes(a, keys), *hot_hashes(b, keys)})
    if not hot:
        return a.join(b, keys)
    mark = F.xxhash64(*keys).isin(hot)
    parts = F.when(mark, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    spread = a.withColumn("_part", F.when(mark, F.pmod(F.xxhash64(*a.columns), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int"))
    return spread.join(b.withColumn("_part", F.explode(parts)), [*keys, "_part"]).drop("_part")


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Dense numbers in the order given, without one task seeing all rows.

    Rows are ranged and sorted by partition; the partitions' counts (one a
    partition) give each its first number.
    """
    from pyspark.sql import Window as W

    scratch = Scratch(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.save(ranged.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "numbered")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("m"))
    first = sizes.select("_p", "m", (F.sum("n").over(W.orderBy("_p")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(first), "_p").withColumn(name, F.lit(start) + F.col("before") + F.col("_m") - F.col("m")).drop("_p", "_m", "m", "before")
