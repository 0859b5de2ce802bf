import itertools
import random

from idloom.llm import mixing as mx
from idloom.llm.tokens import with_tokens

DOCS = "doc_id long, pattern string, tokens long"


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(40):
        supply = {("a",): r.randrange(1, 8), ("a", "b"): r.randrange(1, 8), ("b",): r.randrange(1, 8)}
        targets = [("a", r.choice([0.2, 0.5, 0.8]), r.randrange(1, 4)), ("b", r.choice([0.2, 0.5]), r.randrange(1, 4))]
        total = sum(supply.values())
        route = mx.route(supply, targets, total)
        rep = {s: k for s, _, k in targets}
        caps = [(p, s, supply[p] * rep[s]) for p in supply for s in p]
        best = 0
        for f in itertools.product(*[range(c + 1) for _, _, c in caps]):
            per = {s: sum(x for x, (_, t, _) in zip(f, caps) if t == s) for s in rep}
            use = {p: sum(x for x, (q, _, _) in zip(f, caps) if q == p) for p in supply}
            if all(per[s] <= route.quota[s] for s in per) and all(use[p] <= supply[p] * max(rep[s] for s in p) for p in supply):
                best = max(best, sum(per.values()))
            if best == sum(route.quota.values()):
                break
        assert sum(route.got.values()) == best


def test_shares_and_repeats(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["big"] * 8 + ["small", "other", None]), r.randrange(1, 60)) for i in range(3000)] + [(90_000, "big", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = [("big", 0.5, 1), ("gone", 0.1, 3), ("small", 0.4, 3)]
    short = {x.source: x for x in mx.shortages(docs, targets).collect()}
    small = sum(t for _, p, t in rows if p == "small")
    total = sum(t for _, _, t in rows)
    assert short["small"].routed_tokens == min(3 * small, -(-total * 4 // 10)) and short["gone"].routed_tokens == 0
    used = mx.mixture(docs, targets).collect()
    assert len({(u.doc_id, u.source) for u in used}) == len(used)
    assert max(u.copies for u in used if u.source == "small") <= 3 and {u.copies for u in used if u.source == "big"} == {1}
    rep = {x.source: x for x in mx.report(docs, targets).collect()}
    for s in ("big", "small"):
        assert abs(rep[s].tokens - short[s].routed_tokens) < 60
    assert rep["gone"].tokens == 0 and abs(sum(x.reached_share for x in rep.values()) - 1) < 1e-9
    again = {(u.doc_id, u.copies) for u in mx.mixture(docs, targets).collect()}
    assert again == {(u.doc_id, u.copies) for u in used} != {(u.doc_id, u.copies) for u in mx.mixture(docs, targets, seed=8).collect()}


def test_overlapping_patterns(spark):
    rows = [(i, "a|b", 10) for i in range(100)] + [(i, "a", 10) for i in range(100, 120)]
    used = mx.mixture(spark.createDataFrame(rows, DOCS), [("a", 0.5, 1), ("b", 0.5, 1)]).collect()
    assert sum(u.tokens * u.copies for u in used if u.source == "a") == 600 and sum(u.tokens * u.copies for u in used if u.source == "b") == 600
    assert max(u.copies for u in used) == 1 and len({u.doc_id for u in used}) == 120


def test_many_sources_without_target(spark):
    n = mx.MAX_PATTERNS + 5
    docs = spark.range(n).selectExpr("id doc_id", "concat('dirt', id) pattern", "1L tokens").unionByName(spark.createDataFrame([(n, "a", n), (n + 1, "dirt0|b", 5), (n + 2, None, 2)], DOCS))
    short = {x.source: x for x in mx.shortages(docs, [("a", 0.5, 1), ("b", 0.5, 1)]).collect()}
    assert short["a"].quota_tokens == -(-(2 * n + 7) // 2) and short["a"].routed_tokens == n and short["b"].routed_tokens == 5
    assert mx.shortages(docs, []).collect() == []


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, " Readme ", "Hello world"), (2, None, None), (3, "x", "")], "doc_id long, source string, text string")
    assert [(r.doc_id, r.pattern, r.tokens) for r in mx.prepared(df).orderBy("doc_id").collect()] == [(1, "readme", 2), (2, None, 0), (3, "x", 0)]
    for path in ("/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/piece_bpe_32k.model"):
        assert with_tokens(df.select("doc_id", "text"), path).where("doc_id = 1").first().tokens in (2, 3)
    none = mx.prepared(df.limit(0))
    assert mx.mixture(none, [("a", 1.0, 2)]).collect() == [] and mx.shortages(none, [("a", 1.0, 2)]).first().missing_tokens == 0
    assert mx.targets_of(spark.createDataFrame([(" A", 0.5, None)], "source string, target_share double, max_repeats int")) == [("a", 0.5, 1)]


def test_copies_belong_to_all_their_sources(spark):
    rows = [(1, "one two three", " A"), (2, "one two three", "b "), (3, "one two three", "a"), (4, "four", None), (5, None, "a"), (6, "", "b"), (7, "five six", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.pattern, r.tokens) for r in mx.pooled(df).collect()}
    assert set(got) == {1, 4, 6, 7} and got[1][0] == "a|b" and got[4][0] is None and got[7][0] is None and got[6] == ("b", 0)
    docs = spark.createDataFrame([(i, "a|b", 10) for i in range(10)] + [(100 + i, "a", 10) for i in range(5)], "doc_id long, pattern string, tokens long")
    rows = {r.source: r for r in mx.shortages(docs, [("a", 0.4, 1), ("b", 0.6, 1)]).collect()}
    # b can only have what both have, so a takes its own
    assert rows["b"].routed_tokens == 90 and rows["a"].routed_tokens == 60
    check = mx.mixture_check(docs, [("a", 0.4, 1), ("b", 0.6, 1)]).collect()
    assert all(r.within_a_document and r.within_repeats for r in check)
