"""A mixture of documents with target shares by source.

Documents are gathered by membership pattern (the sources they belong to) into
token sums.  A min-cost flow routes tokens from patterns to source quotas; a
pattern's second, third, ... use costs more each time, so repetition is spread
before it is deepened.  A seeded order of the documents then picks which of a
pattern are used how often: the pattern's repeated token line is cut at the
flows, and a document is used once for each of its starts inside a source's cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from idloom.functions.hashes import strip
from idloom.llm.tokens import TOKENIZER, with_tokens

MAX_PATTERNS = 20_000
#: Bits of a hash that name a bucket of the token line.
BUCKET_BITS = 12


class Flow:
    """Min-cost flow by successive shortest paths (edges may not cost less than 0)."""

    def __init__(self, nodes: int):
        self.to, self.room, self.cost, self.out = [], [], [], [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        import heapq

        n, pot, total = len(self.out), [0] * len(self.out), 0
        while True:
            dist, via, heap = [None] * n, [-1] * n, [(0, s)]
            dist[s] = 0
            while heap:
                d, v = heapq.heappop(heap)
                if d > dist[v]:
                    continue
                for e in self.out[v]:
                    if self.room[e] > 0:
                        w, nd = self.to[e], d + self.cost[e] + pot[v] - pot[self.to[e]]
                        if dist[w] is None or nd < dist[w]:
                            dist[w], via[w] = nd, e
                            heapq.heappush(heap, (nd, w))
            if dist[t] is None:
                return total
            for v in range(n):
                pot[v] += dist[v] if dist[v] is not None else dist[t]
            push, v = None, t
            while v != s:
                push = self.room[via[v]] if push is None else min(push, self.room[via[v]])
                v = self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.room[via[v]] -= push
                self.room[via[v] ^ 1] += push
                v = self.to[via[v] ^ 1]
            total += push


@dataclass
class Route:
    """Tokens each pattern gives each source, and what each source gets of its quota."""

    flows: dict[tuple[str, str], int]
    quota: dict[str, int]
    got: dict[str, int]


def route(pattern_tokens: dict[tuple[str, ...], int], targets: list[tuple[str, float, int]], total: int) -> Route:
    """Shares are taken as the decimal numbers they are written as; a quota is
    the least whole number of tokens that reaches its share of ``total``."""
    quota = {s: ceil(Fraction(repr(float(share))) * total) for s, share, _ in targets}
    repeats = {s: max(0, int(r)) for s, _, r in targets}
    patterns = [p for p in pattern_tokens if pattern_tokens[p] > 0 and any(s in quota for s in p)]
    at = {s: 1 + len(patterns) + i for i, s in enumerate(quota)}
    sink = 1 + len(patterns) + len(quota)
    g, arcs, ends = Flow(sink + 1), {}, {}
    for i, p in enumerate(patterns, 1):
        mine = [s for s in p if s in quota]
        for k in range(max(repeats[s] for s in mine)):
            g.edge(0, i, pattern_tokens[p], 2 * k + 1)
        for s in mine:
            arcs[p, s] = g.edge(i, at[s], pattern_tokens[p] * repeats[s], 0)
    for s in quota:
        ends[s] = g.edge(at[s], sink, quota[s], 0)
    g.run(0, sink)
    flows = {(p, s): g.room[e ^ 1] for (p, s), e in arcs.items() if g.room[e ^ 1]}
    return Route(flows, quota, {s: g.room[e ^ 1] for s, e in ends.items()})


def source_name(c):
    return F.lower(strip(c))


def prepared(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, pattern, tokens): a document's pattern is its source, trimmed and
    lower-cased; without a source it has none and counts in the total only."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif(source_name(F.col("source")), F.lit("")).alias("pattern"), "text")
    return with_tokens(docs, tokenizer)


def pooled(documents: DataFrame, tokenizer: str = TOKENIZER, sep: str = "|") -> DataFrame:
    """(doc_id, pattern, tokens) of different texts: copies are one document, with
    the least id, and belong to all sources that have one.

    Texts are compared by hash where they are read; only hashes and names move.
    A pattern has at most as many names as there are sources.
    """
    name = F.nullif(source_name(F.col("source")), F.lit(""))
    docs = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"), F.sha2("text", 256).alias("same"), "text")
    each = with_tokens(docs, tokenizer).groupBy("same", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    return each.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.nullif(F.array_join(F.array_sort(F.collect_set("source")), sep), F.lit("")).alias("pattern"), F.max("tokens").alias("tokens")).select("doc_id", "pattern", "tokens")


def mixture_check(docs: DataFrame, targets: list[tuple[str, float, int]], seed: int = 7) -> DataFrame:
    """(source, routed_tokens, within_a_document, within_repeats): whether a source's
    tokens are those routed to it up to one document, and no document is used too often."""
    r, _, _ = plan(docs, targets)
    longest = docs.agg(F.coalesce(F.max("tokens"), F.lit(0))).first()[0]
    used = mixture(docs, targets, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most"))
    rows = docs.sparkSession.createDataFrame([(s, r.got[s], rep) for s, _, rep in targets], "source string, routed_tokens long, max_repeats int")
    j = rows.join(used, "source", "left").fillna(0, ["tokens", "most"])
    return j.select("source", "routed_tokens", (F.abs(F.col("tokens") - F.col("routed_tokens")) <= longest).alias("within_a_document"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"))


def targets_of(targets: DataFrame, most: int = 10_000) -> list[tuple[str, float, int]]:
    rows = targets.select(source_name(F.col("source")), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null and target_share is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return sorted({r[0]: (r[0], r[1], 1 if r[2] is None else r[2]) for r in rows}.values())


def plan(docs: DataFrame, targets: list[tuple[str, float, int]], sep: str = "|") -> tuple[Route, dict[str, int], int]:
    """The routing for documents (doc_id, pattern, tokens), pattern tokens, total.

    A pattern of several sources joins their names by ``sep``.  Patterns without a
    target source count in the total only and are summed as one.
    """
    names = F.array(*[F.lit(s) for s, _, _ in targets]).cast("array<string>")
    target = F.when(F.arrays_overlap(F.split("pattern", re.escape(sep)), names), F.col("pattern"))
    rows = docs.groupBy(target.alias("pattern")).agg(F.sum("tokens").alias("t")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many membership patterns")
    sums = {r[0]: int(r[1] or 0) for r in rows}
    total = sum(sums.values())
    r = route({tuple(p.split(sep)): t for p, t in sums.items() if p is not None}, targets, total)
    return r, {p: t for p, t in sums.items() if p is not None}, total


def shortages(docs: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """One row for each target source: what it asks for, can give and gets."""
    r, sums, total = plan(docs, targets)
    rows = [(s, float(share), rep, r.quota[s], r.got[s], r.quota[s] - r.got[s]) for s, share, rep in targets]
    return docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, quota_tokens long, routed_tokens long, missing_tokens long")


def mixture(docs: DataFrame, targets: list[tuple[str, float, int]], seed: int = 7, sep: str = "|") -> DataFrame:
    """(doc_id, source, copies, tokens): how often each document is used for a source.

    The order inside a pattern is by a seeded hash; its token line is summed by
    hash bucket first (a bounded table), then inside buckets, so no task orders
    a whole source.  A source misses or passes its flow by less than a document.
    """
    spark = docs.sparkSession
    r, sums, _ = plan(docs, targets)
    cuts: dict[str, list[tuple[str, int, int]]] = {}
    for (p, s), f in sorted(r.flows.items()):
        name = sep.join(p)
        a = cuts[name][-1][2] if name in cuts else 0
        cuts.setdefault(name, []).append((s, a, a + f))
    kind = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("line", T.LongType()), T.StructField("source", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    # one row for each pattern and source of the bounded routing
    cut = spark.createDataFrame([(p, sums[p], s, a, b) for p, c in cuts.items() for s, a, b in c], kind)
    h = F.xxhash64(F.lit(seed), "doc_id")
    placed = docs.where("pattern is not null and tokens > 0").select("doc_id", "pattern", "tokens", h.alias("h"), F.shiftright(h, 64 - BUCKET_BITS).cast("int").alias("bucket"))
    size = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    before = size.select("pattern", "bucket", (F.sum("t").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(W.partitionBy("pattern", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    on_line = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["pattern", "bucket"])
    pos = F.col("before") + F.col("inside")
    j = on_line.withColumn("pos", pos).join(F.broadcast(cut), "pattern")
    # starts at pos, pos + line, ... below b, less those below a
    copies = F.expr("greatest(0L, (b - pos + line - 1) div line) - greatest(0L, (a - pos + line - 1) div line)")
    return j.select("doc_id", "source", copies.cast("long").alias("copies"), "tokens").where("copies > 0")


def report(docs: DataFrame, targets: list[tuple[str, float, int]], seed: int = 7) -> DataFrame:
    """Shares reached, counted on the mixture itself."""
    spark = docs.sparkSession
    r, sums, _ = plan(docs, targets)
    used = mixture(docs, targets, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    rows = spark.createDataFrame([(s, float(share), rep, r.quota[s]) for s, share, rep in targets], "source string, target_share double, max_repeats int, quota_tokens long")
    j = rows.join(used, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    return j.withColumn("reached_share", F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy(F.lit(1))), F.lit(0)))
