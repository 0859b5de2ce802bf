import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idloom.llm import leakage as lk
from idloom.llm.fmindex import FMIndex, WaveletMatrix, suffix_array


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=120), st.integers(1, 9))
def test_index_counts_and_locates_like_scanning(words, sample):
    sym = np.array([*words, 0], np.int64)
    ix = FMIndex(sym, 5, sample)
    phrases = sorted({tuple(words[i : i + k]) for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words) and 0 not in words[i : i + k]} | {(5, 5, 5)})
    table = np.zeros((len(phrases), 3), np.int64)
    for r, p in enumerate(phrases):
        table[r, : len(p)] = p
    lo, hi = ix.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p]
        assert sorted(ix.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order_of_long_repeats():
    sym = np.array(([1, 2] * 300 + [0]) * 3, np.int64)
    sa = suffix_array(sym)
    assert sorted(sa.tolist()) == list(range(len(sym)))
    unique = [(0, i) if s == 0 else (1, int(s)) for i, s in enumerate(sym)]
    for a, b in zip(sa, sa[1:]):
        assert unique[a:] < unique[b:]


def test_wavelet_rank():
    r = np.random.default_rng(1)
    seq = r.integers(0, 13, 500)
    w = WaveletMatrix(seq, 4)
    c, i = r.integers(0, 13, 200), r.integers(0, 501, 200)
    assert w.rank(c, i).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(c, i)]


def _texts(seed=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    names = iter(f"Name{i}-{i % 7}" for i in range(10_000))
    sentence = lambda: [x for _ in range(20) for x in ([r.choice(vocab)] if r.random() > 0.2 else [next(names)])]
    items = [[w for _ in range(5) for w in sentence()] for _ in range(12)]
    filler = lambda n: [r.choice(vocab) for _ in range(n)]
    docs, want = [], set()

    def put(parts, item=None):
        i = len(docs)
        text = " ".join(filler(30)) + "\n\n> " + "\n> ".join(parts) + "\n" + " ".join(filler(20))
        docs.append((i, text))
        if item is not None:
            want.add((i, item))

    for n, it in enumerate(items):
        join = lambda ws: " ".join(ws)
        put([join(it)], n)
        put([join(it).upper().replace(" ", ", ")], n)
        put([join(it[: len(it) * 6 // 10]).replace("-", "")], n)
        put([join(it[:40]), join(filler(15)), join(it[60:])], n)
        noisy = [w if k % 13 else r.choice(vocab) for k, w in enumerate(it)]
        put([join(noisy)], n)
        put([join([w for k, w in enumerate(it) if k % 14])], n)
        put([join(it[: len(it) * 3 // 10])])
        put([join(it[::-1])])
        put([join([w if k % 4 else r.choice(vocab) for k, w in enumerate(it)])])
        put([join(filler(150))])
    return [(n, " ".join(it)) for n, it in enumerate(items)], docs, want


def test_leaks_are_found_and_quotes_are_not(spark):
    items, docs, want = _texts()
    extra = [(9000, None), (9001, ""), (None, items[0][1]), (9002, "x " * 50_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs + extra], "doc_id long, text string, item_id int").repartition(3)
    e = spark.createDataFrame([(*x, "c") for x in items] + [(99, None, "c"), (98, "...", "c")], "item_id long, text string, doc_id string")
    for chars, block in ((4_000_000, 5000), (3000, 5)):
        got = lk.find_leaks(d, e, shard_chars=chars, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(docs)
    for r in got:
        a, b = r.spans[0].first, r.spans[-1].last
        assert 0 <= a < b <= len(text[r.doc_id]) and text[r.doc_id][a].isalnum()
    spans = lk.removal_spans(lk.find_leaks(d, e)).collect()
    assert {r.doc_id for r in spans} == {x for x, _ in want}


def test_items_that_share_their_text_are_found(spark):
    r = random.Random(6)
    text = [f"v{r.randrange(90)}" for _ in range(60)]
    other = [f"o{r.randrange(90)}" for _ in range(60)]
    near = lambda n: " ".join([*other[:30], f"name{n}", *other[31:]])
    items = [(n, " ".join(text)) for n in range(4)] + [(10 + n, near(n)) for n in range(5)]
    docs = [(0, "Before. " + " ".join(text).upper() + " after"), (1, " ".join(text[:40])), (2, "x " + near(2)), (3, " ".join(text[:12])), (4, " ".join(other[:40]))]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, n) for d in (0, 1) for n in range(4)} | {(d, 10 + n) for d in (2, 4) for n in range(5)}
    for block in (5000, 3):
        got = lk.find_leaks(d, e, block=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert lk.find_leaks(d, e).collect() == []
    assert lk.find_leaks(d.union(spark.createDataFrame([(1, "a")], d.schema)), e.limit(0)).collect() == []


def test_many_equal_and_templated_items(spark):
    r = random.Random(8)
    word = lambda: f"q{r.randrange(300)}"
    same = [[word() for _ in range(40)] for _ in range(2)]
    frame = [word() for _ in range(50)]
    # fifty items that differ in three words of a common frame
    filled = [[*frame[:10], f"a{n}", *frame[10:25], f"b{n}", *frame[25:40], f"c{n}", *frame[40:]] for n in range(50)]
    items = [(n, " ".join(same[0])) for n in range(3)] + [(100 + n, " ".join(same[1])) for n in range(50)] + [(200 + n, " ".join(f)) for n, f in enumerate(filled)]
    docs = [(0, " ".join(same[0])), (1, "one " + " ".join(same[1][:25])), (2, " ".join(filled[7])), (3, " ".join(frame[:12]))]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(0, n) for n in range(3)} | {(1, 100 + n) for n in range(50)} | {(2, 200 + n) for n in range(50)}
    for block in (5000, 7):
        assert {(x.doc_id, x.item_id) for x in lk.find_leaks(d, e, block=block).collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(20, 120), st.integers(3, 400))
def test_texts_that_carry_an_item_have_the_seeds_it_needs(seed, n, vocab):
    r = random.Random(seed)
    passages = [np.array([r.randrange(1, vocab) for _ in range(n)], np.int64) for _ in range(6)]
    items = lk.Items([[i] for i in range(6)], passages)
    seeds = [[(int(items.owner_place[o]), items.phrases[p, : items.lengths[p]].tolist()) for p in range(len(items.lengths)) for o in range(items.owner_start[p], items.owner_start[p + 1]) if items.owner_item[o] == i] for i in range(6)]
    for i, words in enumerate(passages):
        carry = -(-n // 2)
        cut = r.randrange(carry + 1)
        a = r.randrange(n - carry + 1)
        b = r.randrange(a + cut, n - (carry - cut) + 1)
        kept = list(range(a, a + cut)) + list(range(b, b + carry - cut))
        gone = set(r.sample(kept, int(0.1 * carry)))
        text = []
        for k in kept:
            text += [0] * (k == b) + [0 if k in gone else int(words[k])]
        here = {tuple(text[s : s + w]) for s in range(len(text)) for w in range(1, 7)}
        assert sum(tuple(p) in here for _, p in seeds[i]) >= items.needed[i] or items.needed[i] == 1


def test_long_texts_take_memory_by_their_length():
    r = np.random.default_rng(3)
    item = r.integers(1, 50, 300)
    text = r.integers(1, 50, 400_000)
    text[150_000:150_180] = item[:180]
    [(total, changed, spans)] = lk.carried([(item, text, lk.word_pairs(item), lk.word_pairs(text))])
    assert 180 <= total <= 200 and changed <= 0.1 * total and spans[0][0] <= 150_000 and spans[-1][1] >= 150_180
    text = r.integers(1, 50, 5000)
    assert lk.carried([(item, text, lk.word_pairs(item), lk.word_pairs(text))])[0][0] < 150


def test_items_have_a_bound(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        lk.find_leaks(d, d.withColumnRenamed("doc_id", "item_id"), most_chars=3)
