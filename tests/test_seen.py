import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idloom.operators import seen


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20 - 1), max_size=300), st.lists(st.integers(0, 2**20 - 1), max_size=100))
def test_filter_is_exact_on_fingerprints(keys, asked):
    fps = np.unique(np.array(keys, np.uint64))
    f = seen.QuotientFilter(fps, 20)
    assert f.fingerprints().tolist() == fps.tolist()
    got = f.contains(np.array(asked + keys, np.uint64))
    assert got.tolist() == [k in set(keys) for k in asked + keys]


def test_crowded_quotient_and_merge():
    a = np.arange(0, 400, 2, dtype=np.uint64)
    b = np.arange(1, 700, 3, dtype=np.uint64) | np.uint64(1 << 25)
    m = seen.QuotientFilter(a, 26).merged(seen.QuotientFilter(b, 26))
    assert m.fingerprints().tolist() == sorted({*a.tolist(), *b.tolist()})
    assert m.contains(a).all() and m.contains(b).all() and not m.contains(np.array([1, 3], np.uint64)).any()


def _brute(obs, stored):
    def key(r):
        size, *hs = r
        hs = [h.strip().lower() if h is not None else "" for h in hs]
        ok = size is not None and size >= 0 and all(len(h) == n and not set(h) - set("0123456789abcdef") for h, n in zip(hs, (8, 32, 40)))
        return (size, *hs) if ok else None

    have = {key(r) for r in stored} - {None}
    out = {}
    for i, *r in sorted((x for x in obs if x[0] is not None), key=lambda x: x[0]):
        k = key(r)
        if k is not None:
            out[i] = k in have
            have.add(k)
    return out


OBS = "obs_id long, size_bytes long, crc32 string, md5 string, sha1 string, extra string"
FILE = "id long, size_bytes long, crc32 string, md5 string, sha1 string"


def _case(n, seed, hot):
    r = random.Random(seed)
    h = lambda k: (k, f"{k:08x}", f"{k:032x}", f"{k:040x}")
    obs = []
    for i in range(n):
        size, c, m, s = h(7 if r.random() < hot else r.randrange(n))
        if r.random() < 0.1:
            c = None
        if r.random() < 0.1:
            m = f"\t{m.upper()} "
        if r.random() < 0.05:
            size = r.choice([None, -1])
        if r.random() < 0.05:
            s = s[:-1] + "g"
        obs.append((i, size, c, m, s))
    obs.append((None, *h(3)))
    r.shuffle(obs)
    stored = [(i, *h(i * 3)) for i in range(n // 5)]
    return obs, stored


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_seen_matches_sequential_model(spark, hot):
    obs, stored = _case(3000, 5, hot)
    o = spark.createDataFrame([(*x, "clash") for x in obs], OBS).repartition(5)
    f = spark.createDataFrame(stored, FILE)
    got = seen.seen_before(o, f, keys_per_bucket=500, chunk_rows=400, batch_rows=64).collect()
    assert len(got) == len({r[0] for r in got})
    assert {r[0]: r[1] for r in got} == _brute(obs, [x[1:] for x in stored])
    assert {r[0]: r[1] for r in seen.exact_seen(o, f).collect()} == _brute(obs, [x[1:] for x in stored])


def test_empty_tables(spark):
    o, f = spark.createDataFrame([], OBS), spark.createDataFrame([], FILE)
    assert seen.seen_before(o, f).collect() == []
    one = spark.createDataFrame([(1, 0, "0" * 8, "0" * 32, "0" * 40, None)], OBS)
    assert [tuple(r) for r in seen.seen_before(one, f).collect()] == [(1, False)]


def test_errors_follow_the_derived_rate(spark):
    n = 4000
    h = lambda k: (k, f"{k:08x}", f"{k:032x}", f"{k:040x}")
    o = spark.createDataFrame([(i, *h(i % 3000), None) for i in range(n)], OBS)
    f = spark.createDataFrame([(i, *h(10_000 + i)) for i in range(2000)] + [(9999, *h(10_000))], FILE)
    rows = {r.remainder_bits: r for r in seen.error_report(o, f, (1, 6, 32)).collect()}
    assert rows[32].false_seen == 0 and all(r.false_new == 0 and (r.new_keys, r.stored_keys) == (3000, 2000) for r in rows.values())
    for r in (rows[1], rows[6]):
        want = r.derived_rate_new * r.new_keys
        assert abs(r.false_seen - want) <= 5 * want**0.5 + 1 and r.measured_rate_new == r.false_seen / r.new_keys
    assert rows[1].false_seen > rows[6].false_seen > 0
