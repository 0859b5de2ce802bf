"""Evaluation passages inside training texts, by an FM-index a shard.

From every place of an item the shortest phrase that few items have is searched
backwards in the index of each shard of texts.  Texts in which phrases from
enough places of one item occur are aligned with it word by word; the carried
passages are the spans to remove.  Each shard is read, indexed and searched in
one task, so no text is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm.fmindex import FMIndex

#: Hyphens and apostrophes inside a word do not count.
JOINERS = "-'\u2019\u2010\u2011\xad"
WORD = re.compile(r"[^\W_]+")
WORD_OR_END = re.compile(r"[^\W_]+|\0")
MARKED = re.compile(rf"[^\W_]+(?:[{JOINERS}]+[^\W_]+)*")
#: A phrase is a seed if at most so many items have it; its length is bounded.
#: Where more items share the longest phrase, the shortest one that no others have
#: is a seed of them all.
SEED_ITEMS, SEED_WORDS = 2, 6
#: Pairs of a hit and an item that are taken at once.
HIT_PAIRS = 4_000_000
#: A text is aligned once the seeds of as many places occur as every text that carries
#: an item must have (see ``_needed``), and at most those of this share of all places.
SEED_SHARE = 0.15
#: Characters of all items together, as they are sent to every executor.
MAX_ITEM_CHARS = 100_000_000
#: Items' lengths that an alignment can stretch over: its words, and added ones
#: until they cost more than all words are worth.
SPAN = 4
#: Candidates weighed at once, and cells of the tables that align them at once.
AT_ONCE, CELLS = 2_000, 400_000
#: Every so many suffix positions are kept.
SAMPLED = 4
#: Tenths that an equal word is worth, and what changed, lost and added words cost.
MATCH, CHANGED, LOST, ADDED = 10, -20, -15, -4


def normal(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def words(text: str) -> list[str]:
    text = normal(text).lower()
    for j in JOINERS:
        text = text.replace(j, "")
    return WORD.findall(text)


MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One number for the words at each place of several arrays; never 0.

    Equal words give equal numbers.  Where different ones do as well, a seed is
    longer or a text is weighed in vain; no result depends on it.
    """
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return np.maximum(out, np.uint64(1))


def word_pairs(sym: np.ndarray) -> np.ndarray:
    """A number for the two words from each place on; 0 if one of them is no word."""
    if len(sym) < 2:
        return np.zeros(0, np.uint64)
    return np.where((sym[:-1] > 0) & (sym[1:] > 0), _mixed([sym[:-1], sym[1:]]), np.uint64(0))


class Items:
    """A block of passages: words by id, and seed phrases.

    ``ids`` has for each passage the items whose text it is.
    """

    def __init__(self, ids: list[list[int]], passages: list[np.ndarray], least_share: float = 0.5, most_changed: float = 0.1):
        self.ids, self.words = ids, passages
        self.pairs = [word_pairs(w) for w in passages]
        size = np.array([len(w) for w in passages], np.int64)
        flat = np.concatenate(passages)
        item = np.repeat(np.arange(len(passages)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        left = size[item] - place
        ahead = np.concatenate([flat, np.zeros(SEED_WORDS, flat.dtype)])
        # how many passages have the phrase of each length from each place on
        keys, owners = np.zeros((SEED_WORDS + 1, len(flat)), np.uint64), np.zeros((SEED_WORDS + 1, len(flat)), np.int64)
        for k in range(1, SEED_WORDS + 1):
            keys[k] = _mixed([ahead[i : i + len(flat)] for i in range(k)])
            at = np.flatnonzero(left >= k)
            if not len(at):
                break
            at = at[np.lexsort((item[at], keys[k, at]))]
            new = np.ones(len(at), bool)
            new[1:] = keys[k, at[1:]] != keys[k, at[:-1]]
            other = new.copy()
            other[1:] |= item[at[1:]] != item[at[:-1]]
            group = np.cumsum(new) - 1
            owners[k, at] = np.bincount(group, weights=other).astype(np.int64)[group]
        longest = np.minimum(SEED_WORDS, left)
        # a few last words that many items have say nothing
        whole = (longest == SEED_WORDS) | (size[item] <= SEED_WORDS)
        least = np.maximum(SEED_ITEMS, np.where(whole, owners[longest, np.arange(len(flat))], 0))
        seed = np.zeros(len(flat), np.int64)
        for k in range(SEED_WORDS, 0, -1):
            seed[(longest >= k) & (owners[k] <= least)] = k
        at = np.flatnonzero(seed)
        at = at[np.lexsort((at, keys[seed[at], at], seed[at]))]
        key, k = keys[seed[at], at], seed[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (k[1:] != k[:-1])
        head = np.flatnonzero(new)
        self.lengths = k[head]
        self.phrases = np.where(np.arange(SEED_WORDS) < self.lengths[:, None], ahead[at[head][:, None] + np.arange(SEED_WORDS)], 0)
        self.owner_start = np.concatenate([head, [len(at)]]).astype(np.int64)
        self.owner_item, self.owner_place = item[at], place[at]
        self.needed = np.array([self._needed(seed[item == n], least_share, most_changed) for n in range(len(passages))], np.int64)

    @staticmethod
    def _needed(seed: np.ndarray, least_share: float, most_changed: float) -> int:
        """Places whose seeds occur in every text that carries the passage.

        Of the words to carry, each end of two passages cuts off less than the
        longest seed, and a changed word spoils the seeds that have it; the worst
        changes are taken.  Words put in between spoil seeds as well and are not
        counted as changes: so never more than ``SEED_SHARE`` of all places.
        """
        n = len(seed)
        carry = ceil(least_share * n)
        spoils = np.zeros(n + 1, np.int64)
        np.add.at(spoils, np.arange(n), 1)
        np.add.at(spoils, np.arange(n) + np.maximum(seed, 1), -1)
        worst = np.sort(np.cumsum(spoils[:-1]))[::-1][: int(most_changed * carry + 1e-9)].sum()
        sure = carry - int((seed == 0).sum()) - 2 * (int(seed.max(initial=1)) - 1) - int(worst)
        return max(1, min(int(SEED_SHARE * n), sure))


def hit_bands(item: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(item places in equal word pairs, by band of the distance in words; width of a band).

    ``item`` and ``text`` are numbers of ``word_pairs``, ``n`` the item's words.
    Words of one passage keep their distance up to what is changed, lost or
    added.  Memory grows with the text, not with text times item.
    """
    half = max(16, n // 8)
    order = np.argsort(item, kind="stable")
    known, at = item[order], np.flatnonzero(text)
    flags = np.zeros(((len(text) + n) // half + 3, n), bool)
    if not len(known):
        return flags, half
    lo = np.searchsorted(known, text[at])
    found = known[np.minimum(lo, len(known) - 1)] == text[at]
    at, lo = at[found], lo[found]
    count = np.searchsorted(known, text[at], "right") - lo
    part = (np.cumsum(count) - count) // HIT_PAIRS
    for s in np.split(np.arange(len(at)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(at) and part[-1] else [slice(None)]:
        j = np.repeat(at[s], count[s])
        i = order[np.repeat(lo[s] - np.cumsum(count[s]) + count[s], count[s]) + np.arange(len(j))]
        band = (j - i + n) // half
        flags[band, i] = flags[band, i + 1] = True
    return flags, half


def in_runs(flags: np.ndarray) -> int:
    """Most item words that can stand, in equal pairs, in two passages of the text:
    bands overlap by all but one, and the two fullest count."""
    two = flags.copy()
    two[1:] |= flags[:-1]
    three = two.copy()
    three[2:] |= flags[:-2]
    two, near = two.sum(axis=1), int(three.sum(axis=1).max())
    far = np.maximum.accumulate(two)[:-2]
    return min(int(flags.any(axis=0).sum()), max(near, int((two[2:] + far).max()) if len(far) else 0))


def least_in_runs(carry: float, most_changed: float) -> float:
    """Words in equal pairs that ``carry`` words have at least: changes and the ends
    of two passages leave one stretch more than there are, each with a single word at most."""
    return (1 - 2 * most_changed) * carry - 2


def _windows(flags: np.ndarray, half: int, n: int, m: int) -> list[tuple[int, int]]:
    """Ranges of the text that hold all alignments with three words in equal pairs.

    A passage lies within the item's length beside its pairs.  An alignment's
    added words cost more than it is worth before it is ``SPAN`` items long, so
    long ranges are cut into blocks that overlap by so much.
    """
    near = flags.copy()
    near[1:] |= flags[:-1]
    out: list[list[int]] = []
    for b in np.flatnonzero(near.sum(axis=1) > 2).tolist():
        first, last = max(0, (b - 1) * half - 2 * n), min(m, (b + 1) * half + n)
        if out and first <= out[-1][1]:
            out[-1][1] = max(last, out[-1][1])
        elif first < last:
            out.append([first, last])
    step = SPAN * n
    return [(s, min(b, s + 2 * step)) for a, b in out for s in range(a, max(a + 1, b - step), step)]


def _locals(jobs: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]) -> list[list[tuple[int, int]]]:
    """For each (item, text, windows) the equal words (place in item, place in text)
    of the best local alignment inside a window; many are aligned at once."""
    out: list[list[tuple[int, int]]] = [[] for _ in jobs]
    most = [0] * len(jobs)
    todo = sorted(((len(a), last - first, k, first, last) for k, (a, _, ws) in enumerate(jobs) for first, last in ws), reverse=True)
    while todo:
        n, m, size = todo[0][0], todo[0][1], 0
        while size < len(todo) and (m := max(m, todo[size][1])) * (n + 1) * (size + 1) <= CELLS:
            size += 1
        part, todo = todo[: max(1, size)], todo[max(1, size) :]
        items, texts = [jobs[k][0] for _, _, k, _, _ in part], [jobs[k][1][first:last] for _, _, k, first, last in part]
        h = _scores(items, texts)
        for x, (_, _, k, first, _) in enumerate(part):
            mine = h[: len(items[x]) + 1, x, : len(texts[x]) + 1]
            if (top := int(mine.max())) > most[k]:
                most[k], out[k] = top, [(i, j + first) for i, j in _way(items[x], texts[x], mine)]
    return out


def _scores(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Scores of local alignments: [item words, alignment, text words]."""
    n, m = max(map(len, items)), max(map(len, texts))
    a, b = np.full((n, len(items), 1), -1, np.int32), np.full((len(items), m), -2, np.int32)
    for k, (x, y) in enumerate(zip(items, texts)):
        a[: len(x), k, 0], b[k, : len(y)] = x, y
    kind = np.int16 if MATCH * n - ADDED * m - LOST < 1 << 15 else np.int32
    h = np.zeros((n + 1, len(items), m + 1), kind)
    slope = (-ADDED * np.arange(m)).astype(kind)
    row, lost, same = np.empty(b.shape, kind), np.empty(b.shape, kind), np.empty(b.shape, bool)
    for i in range(n):
        np.equal(b, a[i], out=same)
        np.multiply(same, kind(MATCH - CHANGED), out=row)
        row += h[i, :, :-1]
        row += kind(CHANGED)
        np.add(h[i, :, 1:], kind(LOST), out=lost)
        np.maximum(row, lost, out=row)
        np.maximum(row, kind(0), out=row)
        row += slope
        np.maximum.accumulate(row, axis=1, out=row)
        np.subtract(row, slope, out=h[i + 1, :, 1:])
    return h


def _way(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
    i, j = map(int, divmod(int(h.argmax()), h.shape[1]))
    out = []
    while i > 0 and j > 0 and (here := h[i, j]) > 0:
        same = a[i - 1] == b[j - 1]
        if here == h[i - 1, j - 1] + (MATCH if same else CHANGED):
            i, j = i - 1, j - 1
            if same:
                out.append((i, j))
        elif here == h[i, j - 1] + ADDED:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def _two_passages(pairs: list[tuple[int, int]], price: float) -> list[list[tuple[int, int]]]:
    """The at most two stretches of an alignment that are worth most: one for an
    equal word, less ``price`` for an item word lost inside a stretch."""
    none = (0.0, -1, -1)
    one: tuple = none
    best_one: tuple = none
    two: tuple = (0.0, none, -1, -1)
    best_two: tuple = two
    for k, (i, _) in enumerate(pairs):
        gap = price * (i - pairs[k - 1][0] - 1) if k else 0.0
        two = max((two[0] - gap + 1, two[1], two[2], k) if two[3] == k - 1 and k else (-1.0, none, k, k), (best_one[0] + 1, best_one, k, k), key=lambda x: x[0])
        best_two = max(best_two, two, key=lambda x: x[0])
        one = (one[0] - gap + 1, one[1], k) if k and one[2] == k - 1 and one[0] > gap else (1.0, k, k)
        best_one = max(best_one, one, key=lambda x: x[0])
    first, a, b = best_two[1], best_two[2], best_two[3]
    out = [pairs[first[1] : first[2] + 1]] if first[1] >= 0 else []
    return [*out, pairs[a : b + 1]]


def _weigh(ways: list, n: int, least_share: float, most_changed: float) -> tuple[bool, int, int, list[tuple[int, int]]]:
    """Whether the best of the ways (passages as equal words) carries enough, its
    words of the item and how many of them are not equal, and its ranges in the text."""

    def count(way: list) -> tuple[int, int]:
        total = sum(p[-1][0] - p[0][0] + 1 for p in way)
        return total, total - sum(map(len, way))

    total, changed, way = max(((*count(w), w) for w in ways), key=lambda x: (x[1] <= most_changed * x[0], x[0] - 3 * x[1]))
    return changed <= most_changed * total and total >= least_share * n, total, changed, [(p[0][1], p[-1][1] + 1) for p in way]


def carried(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], least_share: float = 0.5, most_changed: float = 0.1) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """For each item and text: item words that one or two passages of the text
    carry in order, how many of them are not equal, and the passages as word ranges.
    Each comes with the numbers of its ``word_pairs``.

    The two passages are the best two stretches of the best alignment, or the
    best alignment and the best one before or after it, whichever leaves the
    most equal words after a tenth is allowed for.  A text without enough equal
    word pairs carries 0.
    """
    jobs = []
    for item, text, item_pairs, text_pairs in pairs:
        n, m = len(item), len(text)
        flags, half = hit_bands(item_pairs, text_pairs, n)
        enough = in_runs(flags) >= least_in_runs(least_share * n, most_changed)
        jobs.append((item, text, (_windows(flags, half, n, m) if n > 2 else [(0, m)]) if enough else []))
    out, open_, more = [(0, 0, [])] * len(pairs), {}, []
    for k, ((item, text, item_pairs, text_pairs), best) in enumerate(zip(pairs, _locals(jobs))):
        if not best:
            continue
        n, ways = len(item), [[best]]
        ok, *out[k] = _weigh(ways, n, least_share, most_changed)
        # stretches of an alignment that is too short as a whole are too short as well
        if not ok and out[k][0] >= least_share * n:
            ways += [_two_passages(best, price) for price in (2.0, 4.0, 9.0)]
            ok, *out[k] = _weigh(ways, n, least_share, most_changed)
        if ok:
            continue
        (i0, j0), (i1, j1) = best[0], best[-1]
        missing = least_in_runs(least_share * n - (i1 + 1 - i0), most_changed) - 1
        for i, j, before in ((i0, j0, True), (i1 + 1, j1 + 1, False)):
            a, b = (item[:i], text[:j]) if before else (item[i:], text[j:])
            if len(a) < max(2, missing) or len(b) < 2:
                continue
            flags, half = hit_bands(item_pairs[: i - 1] if before else item_pairs[i:], text_pairs[: j - 1] if before else text_pairs[j:], len(a))
            if in_runs(flags) >= max(3, missing):
                open_[k] = ways
                more.append(((a, b, _windows(flags, half, len(a), len(b))), k, best, 0 if before else i, 0 if before else j, before))
    for (_, k, best, i, j, before), found in zip(more, _locals([x[0] for x in more])):
        if other := [(x + i, y + j) for x, y in found]:
            open_[k].append([other, best] if before else [best, other])
    for k, ways in open_.items():
        out[k] = _weigh(ways, len(pairs[k][0]), least_share, most_changed)[1:]
    return [tuple(x) for x in out]


OUT = "doc_id long, item_id long, item_words int, carried_words int, changed_words int, share double, spans array<struct<first:int,last:int,words:int>>"


def symbols_of(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word ids of all texts, 0 for other words and after each text; where each text starts)."""
    low = normal("\0".join(t.replace("\0", " ") for t in texts) + "\0").lower()
    for j in JOINERS:
        low = low.replace(j, "")
    found = WORD_OR_END.findall(low)
    sym = np.fromiter(map(vocabulary.get, found, repeat(0)), np.int64, len(found))
    ends = np.flatnonzero(sym < 0)
    sym[ends] = 0
    return sym, np.concatenate([[0], ends[:-1] + 1])


def _shard(vocabulary: dict[str, int], blocks: list, least_share: float, most_changed: float, shard_chars: int):
    from idloom.llm.batches import text_chunks

    def search(items: Items, index: FMIndex, sym: np.ndarray, text_pairs: np.ndarray, starts: np.ndarray, ids: list[int], texts: list[str]) -> Iterator[tuple]:
        lo, hi = index.search(items.phrases, items.lengths)
        counts = hi - lo
        hit = np.flatnonzero(counts)
        if not len(hit):
            return
        phrase = np.repeat(hit, counts[hit])
        run = np.arange(len(phrase)) - np.repeat(np.cumsum(counts[hit]) - counts[hit], counts[hit])
        doc = np.searchsorted(starts, index.locate(lo[phrase] + run), side="right") - 1
        # slices of whole texts, so that phrases of many items take bounded memory
        owners = items.owner_start[phrase + 1] - items.owner_start[phrase]
        order = np.argsort(doc, kind="stable")
        doc, phrase, owners = doc[order], phrase[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        part = (np.cumsum(owners) - owners)[first] // HIT_PAIRS
        cuts = first[1:][part[1:] != part[:-1]]
        for d, f, o in zip(np.split(doc, cuts), np.split(phrase, cuts), np.split(owners, cuts)):
            yield from weigh(items, d, f, o, sym, text_pairs, starts, ids, texts)

    def weigh(items: Items, doc, phrase, owners, sym, text_pairs, starts, ids: list[int], texts: list[str]) -> Iterator[tuple]:
        # one (text, item, place in item) for each owner of a phrase
        rep = np.repeat(np.arange(len(phrase)), owners)
        own = items.owner_start[phrase[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(owners) - owners, owners)
        longest = max(len(w) for w in items.words) + 1
        key = np.sort((doc[rep] * len(items.ids) + items.owner_item[own]) * longest + items.owner_place[own])
        pair = key[np.concatenate([[True], key[1:] != key[:-1]])] // longest
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        places, pairs = np.diff(np.concatenate([head, [len(pair)]])), pair[head]
        ok = places >= items.needed[pairs % len(items.ids)]
        for s in range(0, int(ok.sum()), AT_ONCE):
            todo = []
            for d, i in (divmod(p, len(items.ids)) for p in pairs[ok][s : s + AT_ONCE].tolist()):
                end = starts[d + 1] if d + 1 < len(starts) else len(sym)
                todo.append((d, i, items.words[i], sym[starts[d] : end - 1], items.pairs[i], text_pairs[starts[d] : max(starts[d], end - 2)]))
            for (d, i, item, text, _, _), (total, changed, spans) in zip(todo, carried([t[2:] for t in todo], least_share, most_changed)):
                if total < least_share * len(item) or changed > most_changed * total:
                    continue
                marks = [m.span() for m in MARKED.finditer(texts[d])]
                if len(marks) != len(text):
                    marks = [m.span() for m in MARKED.finditer(normal(texts[d]))]
                for item_id in items.ids[i]:
                    yield ids[d], item_id, len(item), total, changed, total / len(item), [{"first": marks[x][0], "last": marks[y - 1][1], "words": y - x} for x, y in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("carried_words", pa.int32()), ("changed_words", pa.int32()), ("share", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("words", pa.int32())])))])
        known = {**vocabulary, "\0": -1}
        for ids, texts in text_chunks(batches, shard_chars):
            sym, starts = symbols_of(texts, known)
            # one index for all blocks of items
            index, text_pairs = FMIndex(sym, len(vocabulary), SAMPLED), word_pairs(sym)
            for b in blocks:
                rows = list(search(b.value if hasattr(b, "value") else b, index, sym, text_pairs, starts, ids, texts))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def passages_of(rows: list[tuple[int, str]]) -> tuple[dict[str, int], list[list[int]], list[np.ndarray]]:
    """(vocabulary, items of each passage, its words by id); items of the same words are one passage."""
    same = defaultdict(list)
    for i, text in rows:
        same[tuple(words(text))].append(i)
    same.pop((), None)
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in same for w in s}), 1)}
    return vocabulary, list(same.values()), [np.array([vocabulary[w] for w in s], np.int64) for s in same]


def find_leaks(documents: DataFrame, items: DataFrame, least_share: float = 0.5, most_changed: float = 0.1, shard_chars: int = 4_000_000, block: int = 5_000, most_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, carried_words, changed_words, share, spans):
    texts that carry at least ``least_share`` of an item's words in one or two
    passages in the item's order, at most ``most_changed`` of them changed or
    lost; case, punctuation and spacing do not matter.  ``spans`` are the
    passages as character ranges of the text, with their words.

    All items are searched in all texts: each shard of texts is indexed once and
    blocks of ``block`` passages are searched in it one after another.  The items
    go to all executors and are bounded by ``most_chars`` characters; more are an
    error.  Null ids, null or empty texts carry nothing; repeated rows are each
    reported; empty tables give an empty result.
    """
    spark = documents.sparkSession
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    if chars > most_chars:
        raise ValueError(f"the items have {chars} characters, more than {most_chars}")
    vocabulary, ids, passages = passages_of([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()])
    if not passages:
        return spark.createDataFrame([], OUT)
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = [spark.sparkContext.broadcast(Items(ids[s : s + block], passages[s : s + block], least_share, most_changed)) for s in range(0, len(passages), block)]
    return docs.mapInArrow(_shard(vocabulary, blocks, least_share, most_changed, shard_chars), OUT)


def removal_spans(leaks: DataFrame) -> DataFrame:
    """(doc_id, first, last): character ranges to remove; ranges of one text that
    overlap or touch are merged, within the text's own few spans."""
    each = leaks.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    start = F.array(F.struct(F.col("s")[0]["first"].alias("first"), F.col("s")[0]["last"].alias("last")))

    def merge(acc, x):
        end = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))))
        return F.when(x["first"] <= end["last"], joined).otherwise(F.concat(acc, F.array(F.struct(x["first"].alias("first"), x["last"].alias("last")))))

    return each.select("doc_id", F.explode(F.aggregate("s", start, merge)).alias("m")).select("doc_id", "m.first", "m.last")
