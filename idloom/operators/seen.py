"""Membership over a stream of keys with cascades of quotient filters.

A key becomes a 64-bit hash.  Its top bits choose a bucket (one task), the next
bits are the quotient and the rest, cut to ``remainder_bits`` past the fullest
filter's quotient, the remainder.  A bucket's filter stores remainders only, in
runs sorted by quotient, with three metadata bits a slot; it grows by merging
sorted filters, small ones into larger ones.

Memory of a task: about ``remainder_bits + 3`` bits a slot at a load of at most
0.75, for the keys of its bucket only; buckets are added as the input grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.hashes import clean_hash, is_hex
from idloom.session import Scratch, count_rows, partitions

KEY_PARTS = ("size_bytes", "crc32", "md5", "sha1")
MAX_LOAD = 0.75


class QuotientFilter:
    """A static quotient filter over ``bits``-bit fingerprints, built sorted.

    ``occupied`` marks quotients that have a run, ``continuation`` the slots
    that go on with the run of the slot before, ``shifted`` the slots that lie
    right of their quotient.  Slots run past the last quotient, not around.
    """

    def __init__(self, fingerprints: np.ndarray, bits: int):
        fps = fingerprints.astype(np.uint64, copy=False)
        n = len(fps)
        self.n, self.bits = n, bits
        self.q_bits = min(bits - 1, max(1, ceil(log2(max(n, 1) / MAX_LOAD + 1))))
        self.r_bits = bits - self.q_bits
        quotient = (fps >> np.uint64(self.r_bits)).astype(np.int64)
        order = np.arange(n, dtype=np.int64)
        slot = order + np.maximum.accumulate(quotient - order) if n else order
        slots = max(1 << self.q_bits, int(slot[-1]) + 1 if n else 0)
        slots += -slots % 64
        kind = np.uint32 if self.r_bits <= 32 else np.uint64
        self.remainders = np.zeros(slots, kind)
        self.remainders[slot] = (fps & np.uint64((1 << self.r_bits) - 1)).astype(kind)
        occupied, used, continuation, shifted = (np.zeros(slots, bool) for _ in range(4))
        occupied[quotient] = True
        used[slot] = True
        if n:
            continuation[slot[1:]] = quotient[1:] == quotient[:-1]
        shifted[slot] = slot != quotient
        self.occupied, self.continuation, self.shifted = map(self._pack, (occupied, continuation, shifted))
        self.starts = self._pack(used & ~continuation)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.occupied), dtype=np.int64)])
        self.start_rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.starts), dtype=np.int64)])

    @staticmethod
    def _pack(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, bitorder="little").view(np.uint64)

    @staticmethod
    def _unpack(words: np.ndarray) -> np.ndarray:
        return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)

    @staticmethod
    def _bit(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def _used(self) -> np.ndarray:
        """A slot is used if it starts or continues a run."""
        return self._unpack(self.starts | self.continuation)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints again, sorted: the k-th run belongs to the k-th occupied quotient."""
        used = np.flatnonzero(self._used())
        run = np.cumsum(self._unpack(self.starts)[used]) - 1
        quotient = np.flatnonzero(self._unpack(self.occupied))[run].astype(np.uint64)
        return (quotient << np.uint64(self.r_bits)) | self.remainders[used].astype(np.uint64)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        fps = fingerprints.astype(np.uint64, copy=False)
        found = np.zeros(len(fps), bool)
        if not self.n or not len(fps):
            return found
        q = (fps >> np.uint64(self.r_bits)).astype(np.int64)
        ask = np.flatnonzero(self._bit(self.occupied, q))
        q, r = q[ask], (fps[ask] & np.uint64((1 << self.r_bits) - 1)).astype(self.remainders.dtype)
        low = (np.uint64(1) << (q & 63).astype(np.uint64)) - np.uint64(1)
        k = self.rank[q >> 6] + np.bitwise_count(self.occupied[q >> 6] & low)
        at = self._select_start(k)
        while len(ask):
            here = self.remainders[at]
            found[ask[here == r]] = True
            nxt = at + 1
            inside = nxt < len(self.remainders)
            go = (here < r) & inside
            go[go] = self._bit(self.continuation, nxt[go])
            ask, r, at = ask[go], r[go], nxt[go]
        return found

    def _select_start(self, k: np.ndarray) -> np.ndarray:
        """Slot of the k-th run start: the word by rank, then the bit inside it."""
        word = np.searchsorted(self.start_rank, k, side="right") - 1
        left, w = k - self.start_rank[word], self.starts[word].copy()
        for _ in range(int(left.max()) if len(left) else 0):
            drop = left > 0
            w[drop] &= w[drop] - np.uint64(1)
            left -= drop
        lowest = w & (~w + np.uint64(1))
        return (word << 6) + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)

    def merged(self, other: "QuotientFilter") -> "QuotientFilter":
        a, b = self.fingerprints(), other.fingerprints()
        out = np.insert(a, np.searchsorted(a, b), b)
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        return QuotientFilter(out[keep], self.bits)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.remainders, self.occupied, self.continuation, self.shifted, self.starts, self.rank, self.start_rank))


class Cascade:
    """Filters of falling size; a new batch is merged with all that are not larger."""

    def __init__(self, bits: int):
        self.bits, self.filters = bits, []

    def contains(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), bool)
        for f in self.filters:
            rest = np.flatnonzero(~out)
            out[rest] = f.contains(fps[rest])
        return out

    def add(self, sorted_fps: np.ndarray) -> None:
        new = QuotientFilter(sorted_fps, self.bits)
        while self.filters and self.filters[-1].n <= 2 * new.n:
            new = new.merged(self.filters.pop())
        self.filters.append(new)


def complete_key(prefix: str = "") -> tuple[list[Column], Column]:
    """The cleaned parts of an identity key and whether all of them are usable."""
    crc, md5, sha1 = (clean_hash(F.col(prefix + c)) for c in KEY_PARTS[1:])
    size = F.col(prefix + "size_bytes")
    ok = F.coalesce((size >= 0) & is_hex(crc, 8) & is_hex(md5, 32) & is_hex(sha1, 40), F.lit(False))
    return [size, crc, md5, sha1], ok


def _fingerprints(df: DataFrame, order: Column, is_row: int) -> DataFrame:
    parts, ok = complete_key()
    return df.where(ok).select(F.xxhash64(*parts).alias("fp"), F.lit(is_row).cast("byte").alias("kind"), order.cast("long").alias("obs_id"))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    return fp, t.column("kind").to_numpy(), t.column("obs_id").to_numpy()


OUT = pa.schema([("bucket", pa.int32()), ("fp", pa.int64()), ("kind", pa.int8()), ("obs_id", pa.int64())])
OPEN_BASE, OPEN, SEEN = 0, 1, 2


def _local_filter(bucket_bits: int, chunk_rows: int):
    """Within a chunk only the first row of a key stays open; the others are
    seen already, whatever comes from elsewhere.  So a popular key sends one
    row a chunk to its bucket; decided rows go to buckets by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, chunk_rows):
            fp, kind, obs = _arrays(t)
            order = np.lexsort((obs, kind, fp))
            fp, kind, obs = fp[order], kind[order].copy(), obs[order]
            again = np.zeros(len(fp), bool)
            again[1:] = fp[1:] == fp[:-1]
            keep = ~(again & (kind == OPEN_BASE))
            kind[again] = SEEN
            fp, kind, obs = fp[keep], kind[keep], obs[keep]
            by = np.where(kind == SEEN, obs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), fp)
            bucket = (by >> np.uint64(64 - bucket_bits)).astype(np.int32) if bucket_bits else np.zeros(len(by), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(fp.view(np.int64)), pa.array(kind.astype(np.int8)), pa.array(obs)], schema=OUT)

    return run


def _bucket_filter(bucket_bits: int, fp_bits: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(fp_bits)
        for t in _chunks(batches, batch_rows):
            fp, kind, obs = _arrays(t)
            done = kind == SEEN
            open_fp = (fp[~done] << np.uint64(bucket_bits)) >> np.uint64(64 - fp_bits)
            values, first, back = np.unique(open_fp, return_index=True, return_inverse=True)
            known = cascade.contains(values)
            seen = np.ones(len(fp), bool)
            seen[~done] = known[back] | (np.arange(len(open_fp)) != first[back])
            if not known.all():
                cascade.add(values[~known])
            rows = kind != OPEN_BASE
            yield pa.RecordBatch.from_arrays([pa.array(obs[rows]), pa.array(seen[rows])], names=["obs_id", "seen"])

    return run


def seen_before(observations: DataFrame, stored: DataFrame, remainder_bits: int = 32, keys_per_bucket: int = 1_000_000, chunk_rows: int = 400_000, batch_rows: int = 131_072) -> DataFrame:
    """(obs_id, seen) for each observation with a complete key: was its key in
    ``stored`` or in an observation with a smaller ``obs_id``?

    A false "seen" is possible, at about ``keys * 2**-(bits)`` for all
    fingerprint bits (see ``false_seen_rate``); a false "new" is not.  Rows with
    incomplete keys or a null obs_id are left out and count for nothing; equal
    obs_ids are taken in either order.  Empty tables give an empty result.
    """
    spark = observations.sparkSession
    bucket_bits, fp_bits = layout(count_rows(observations) + count_rows(stored), partitions(spark), remainder_bits, keys_per_bucket)
    rows = _fingerprints(observations.where(F.col("obs_id").isNotNull()), F.col("obs_id"), OPEN).unionAll(_fingerprints(stored, F.lit(-1), OPEN_BASE))
    local = rows.mapInArrow(_local_filter(bucket_bits, chunk_rows), "bucket int, fp long, kind byte, obs_id long")
    placed = local.repartitionById(1 << bucket_bits, F.col("bucket")).select("fp", F.when(F.col("kind") == OPEN_BASE, 0).otherwise(1).alias("late"), "kind", "obs_id")
    return placed.sortWithinPartitions("late", "obs_id").drop("late").mapInArrow(_bucket_filter(bucket_bits, fp_bits, batch_rows), "obs_id long, seen boolean")


def layout(rows: int, least: int, remainder_bits: int, keys_per_bucket: int) -> tuple[int, int]:
    """Bits that choose the bucket, and bits of the fingerprint inside one."""
    bucket_bits = max(0, ceil(log2(max(1, least, ceil(rows / keys_per_bucket)))))
    per_bucket = max(2, rows >> bucket_bits)
    return bucket_bits, min(64 - bucket_bits, ceil(log2(per_bucket / MAX_LOAD)) + remainder_bits)


def false_seen_rate(keys: float, total_bits: int) -> float:
    """Chance that a new key meets the fingerprint of one of ``keys`` others."""
    return -float(np.expm1(keys * np.log1p(-(2.0**-total_bits)))) if total_bits else 1.0


def exact_seen(observations: DataFrame, stored: DataFrame) -> DataFrame:
    """The same by whole keys, for measuring errors: (obs_id, seen)."""
    parts, ok = complete_key()
    names = [f"k{i}" for i in range(4)]
    cut = lambda d, extra: d.where(ok).select(*[p.alias(n) for p, n in zip(parts, names)], *extra)
    obs = cut(observations.where(F.col("obs_id").isNotNull()), [F.col("obs_id"), F.lit(False).alias("stored")])
    old = cut(stored, [F.lit(None).cast("long").alias("obs_id"), F.lit(True).alias("stored")])
    keys = obs.unionAll(old).groupBy(*names).agg(F.max("stored").alias("in_base"), F.min("obs_id").alias("first_id"))
    return obs.drop("stored").join(keys, names).select("obs_id", (F.col("in_base") | (F.col("obs_id") > F.col("first_id"))).alias("seen"))


def _distinct_keys(df: DataFrame) -> int:
    parts, ok = complete_key()
    return count_rows(df.where(ok).select(*[p.alias(f"k{i}") for i, p in enumerate(parts)]).distinct())


def error_report(observations: DataFrame, stored: DataFrame, remainder_bits: tuple[int, ...] = (4, 8, 12, 32)) -> DataFrame:
    """Wrong answers by remainder length: counted against whole keys, and derived.

    Only a new key can get a wrong answer, so both rates are by new key.  It
    meets all different stored keys and, on average, half of the other new ones.
    """
    spark = observations.sparkSession
    rows = count_rows(observations) + count_rows(stored)
    # compared with several filters, so written once
    exact = Scratch(spark).save(exact_seen(observations, stored), "exact")
    old, new = _distinct_keys(stored), count_rows(exact.where(~F.col("seen")))
    parts = []
    for r in remainder_bits:
        bucket_bits, fp_bits = layout(rows, partitions(spark), r, 1_000_000)
        total = bucket_bits + fp_bits
        both = seen_before(observations, stored, remainder_bits=r).withColumnRenamed("seen", "said").join(exact, "obs_id")
        false = F.count_if(F.col("said") & ~F.col("seen"))
        parts.append(
            both.agg(
                F.lit(r).alias("remainder_bits"),
                F.lit(total).alias("fingerprint_bits"),
                F.count("*").alias("answers"),
                F.lit(old).cast("long").alias("stored_keys"),
                F.count_if(~F.col("seen")).alias("new_keys"),
                false.alias("false_seen"),
                F.count_if(~F.col("said") & F.col("seen")).alias("false_new"),
                F.coalesce(false / F.nullif(F.count_if(~F.col("seen")), F.lit(0)), F.lit(0.0)).alias("measured_rate_new"),
                F.lit(false_seen_rate(old + max(0, new - 1) / 2, total)).alias("derived_rate_new"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
