"""Per-key results when few keys hold most rows: aggregate before moving rows.

Each side of a join is first reduced to one compact state a key (with map-side
combine, so a hot key costs one row a task, not one a record); the states are
joined and counts multiplied or sums scaled, then rolled up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.operators.joins import lookup, spread_join
from idloom.session import count_rows


def key_states(df: DataFrame, key: str | Column, by: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """One state for each key (and ``by``): key, by..., n, and the sums asked for."""
    key = F.col(key) if isinstance(key, str) else key
    by = by or {}
    rows = df.select(key.alias("key"), *[c.alias(n) for n, c in by.items()], *[c.alias(f"v_{n}") for n, c in (sums or {}).items()])
    return rows.groupBy("key", *by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v_{n}").alias(n) for n in sums or {}])


def _spread_join(a: DataFrame, b: DataFrame, many_a: bool, many_b: bool) -> DataFrame:
    """States joined by key.  A key with many states on one side is hot there: if the
    other side has one state a key, that is broadcast (``lookup``); if both may
    have many, the first side's are spread and the other's repeated for each part."""
    if not many_a and not many_b:
        return a.join(b, "key")
    if not (many_a and many_b):
        return lookup(a, b, ["key"], "inner") if many_a else lookup(b, a, ["key"], "inner")
    return spread_join(a, b, ["key"])


def eager_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_by: dict[str, Column] | None = None, right_by: dict[str, Column] | None = None, left_sums: dict[str, Column] | None = None, right_sums: dict[str, Column] | None = None, how: str = "inner") -> DataFrame:
    """What ``left JOIN right ON left_key = right_key GROUP BY left_by, right_by`` gives.

    ``pairs`` is the number of joined rows, ``left_n`` and ``right_n`` the rows
    of either side before joining; a left sum is multiplied by the matching
    right count and the other way round.  With ``how="full"`` keys of one side
    stay, the other side counting 0.  A null key joins nothing and, in a full
    join, is left out.  Without ``left_by`` and ``right_by`` the result has one
    row for each key (``key``).  With ``left_by`` or ``right_by`` a hot key has many
    states; they are spread over tasks.  Names in the tables do not clash: only
    the expressions given are carried.
    """
    left_by, right_by, left_sums, right_sums = left_by or {}, right_by or {}, left_sums or {}, right_sums or {}
    a = key_states(left.where(F.col(left_key).isNotNull()), left_key, left_by, left_sums).withColumnRenamed("n", "left_n")
    b = key_states(right.where(F.col(right_key).isNotNull()), right_key, right_by, right_sums).withColumnRenamed("n", "right_n")
    j = (a.join(b, "key", "full") if how == "full" else _spread_join(a, b, bool(left_by), bool(right_by))).fillna(0, ["left_n", "right_n"])
    j = j.select("key", *left_by, *right_by, "left_n", "right_n", (F.col("left_n") * F.col("right_n")).alias("pairs"), *[(F.col(n) * F.col("right_n")).alias(n) for n in left_sums], *[(F.col(n) * F.col("left_n")).alias(n) for n in right_sums])
    groups = [*left_by, *right_by]
    if not groups:
        return j
    return j.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("left_n", "right_n", "pairs", *left_sums, *right_sums)])


def heavy_keys(df: DataFrame, first: str, second: str, share: float = 0.03) -> DataFrame:
    """(field, file_id, n_rows, share): ids that hold at least ``share`` of all
    rows in either field.  Null is no id; an empty table has none."""
    total = count_rows(df)
    states = eager_join(df, df, first, second, how="full")
    fields = F.array(F.struct(F.lit(first).alias("field"), F.col("left_n").alias("n")), F.struct(F.lit(second).alias("field"), F.col("right_n").alias("n")))
    rows = states.select("key", F.explode(fields).alias("x")).select(F.col("x.field").alias("field"), F.col("key").alias("file_id"), F.col("x.n").alias("n_rows"))
    return rows.where((F.col("n_rows") > 0) & (F.col("n_rows") >= F.lit(share) * F.lit(total))).withColumn("share", F.col("n_rows") / F.lit(max(total, 1)))


def distinct_partners(df: DataFrame, key: str, partner: str) -> DataFrame:
    """(key, n_rows, n_partners): rows and different non-null partners of a key.

    Two combining steps, by (key, partner) and by key, so that a hot key's
    partners are spread over all tasks.  A null key is left out.
    """
    pairs = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col(partner).alias("partner")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("partner").alias("n_partners"))
