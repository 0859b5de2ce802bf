"""Text that was decoded with a wrong character encoding, found and restored.

Adjacent character pairs of the whole corpus are counted into a table of fixed
size, larger where it would fill up.  A pair is worth its share of the corpus'
mutual information; pairs worth little are improbable, and those with a
replacement character or a C1 control are worth nothing, however many there are.
In a text the improbable runs are the maximum-scoring segments over its pairs,
and only inside those are inverse mappings tried: a run, or the stretch from one
run to another, is encoded as it was shown and decoded as it may have been
written.  A run is restored if the new text's pairs are worth clearly more than
the old ones'; one that keeps a replacement character or control is garbled for good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the tables of pairs, from the least on, and of that of characters.
PAIR_BITS, CHAR_BITS = (20, 22, 24), 17
#: Chance that an unseen pair looks like a seen one from which on tables are larger.
MOST_MIXED = 0.01
#: Encodings a text may have been shown in, and written in.
SHOWN = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "iso8859-15", "cp1250", "cp932", "gbk")
WRITTEN = ("utf-8", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp932", "euc_jp")
#: Encodings of several bytes a character may only have been written as UTF-8.
WIDE_SHOWN = ("cp932", "gbk")
#: Worth below which a pair is improbable, and worth that no pair needs to pass
#: (natural logarithms of the share of mutual information in a million).
IMPROBABLE, FULL = 7.0, 8.0
#: What a pair of plain ASCII inside a run costs.
BRIDGE = 3.0
#: Worth by which a mapping must be better, and what valid UTF-8 counts for itself.
LEAST_GAIN, UTF8_BONUS = 5.0, 6.0
#: The same for a piece that is one character only, which has no inner pair.
LEAST_GAIN_ALONE = 9.0
#: Mutual information that a pair has at least, so that frequent ones keep worth.
LEAST_PMI = 0.5
#: What a capital right after a small letter, or two scripts in one word, lack.
CASE_BREAK, SCRIPT_BREAK = 8.0, 8.0
LAYERS = 3

BAD = LOST = re.compile("[�\x80-\x84\x86-\x9f]")
NOT_ASCII = re.compile("[^\x00-\x7f]")
CHUNK = re.compile("[^ /\n\t]+")
BEYOND_ASCII = re.compile("[^\x00-\x7f]+")


def _folds() -> np.ndarray:
    out = np.arange(0x10000, dtype=np.uint32)
    for cp in range(0x10000):
        if not 0xD800 <= cp < 0xE000 and len(low := chr(cp).lower()) == 1:
            out[cp] = ord(low)
    out[48:58] = 48
    out[:32] = 32
    out[[47, 92]] = 32
    return out


FOLD = _folds()


def _fold(cp: np.ndarray) -> np.ndarray:
    """Cases are one, digits are one, and so are blanks, separators and line ends."""
    return np.where(cp < len(FOLD), FOLD[np.minimum(cp, len(FOLD) - 1)], cp)


def _pair_keys(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two slots a pair: its count is at most the less of both."""
    x = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
    return [((x * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_counts(texts: DataFrame, bits: int = PAIR_BITS[0]) -> DataFrame:
    """(kind, slot, n, once): characters (kind 0) and pairs (kinds 1 and 2, one for
    each hash) counted by slot of tables of fixed size, whatever the corpus: ``n``
    over all texts, ``once`` with copies of a text counted once."""
    pair_bits = bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, 1 << bits), np.int64) for bits in (CHAR_BITS, pair_bits, pair_bits)]
        for b in batches:
            split = [t or "" for t in b.column(0).to_pylist()]
            cp = _fold(_points("\n".join(split) + "\n"))
            copies = np.repeat(b.column(1).to_numpy(), np.fromiter(map(len, split), np.int64, len(split)) + 1)
            before = np.concatenate([[10], cp[:-1]]).astype(np.uint32)
            before[0] = _fold(before[:1])[0]
            for table, key in zip(tables, (cp & ((1 << CHAR_BITS) - 1), *_pair_keys(before, cp, pair_bits))):
                np.add.at(table[0], key, copies)
                np.add.at(table[1], key, 1)
        for kind, (n, once) in enumerate(tables):
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(once[at])], names=["kind", "slot", "n", "once"])

    copies = texts.groupBy(F.col(texts.columns[0]).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return copies.mapInArrow(run, "kind byte, slot int, n long, once long").groupBy("kind", "slot").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))


@lru_cache(maxsize=100_000)
def _break(a: str, b: str) -> float:
    if not (a.isalpha() and b.isalpha()):
        return 0.0
    x, y = ((c >= "\u0250") + (c >= "\u0400") + (c >= "\u0530") + (c >= "\u1e00") for c in (a, b))
    if x != y and {x, y} != {0, 4}:
        return SCRIPT_BREAK
    return CASE_BREAK if a.islower() and b.isupper() else 0.0


class Model:
    """The worth of pairs, and texts restored by it; ``once`` is the model with
    copies of a text counted once, as many make a garbled one probable."""

    def __init__(self, kind=(), slot=(), n=(), once=None, bits: int = PAIR_BITS[0]):
        self.once = Model(kind, slot, once, bits=bits) if once is not None else None
        kind, slot, n = np.asarray(kind, np.int8), np.asarray(slot, np.int64), np.asarray(n, np.float64)
        self.bits, self.tables = bits, []
        for k, size in enumerate((CHAR_BITS, bits, bits)):
            self.tables.append(np.zeros(1 << size, np.float32))
            self.tables[k][slot[kind == k]] = n[kind == k]
        self.total = float(n[kind == 1].sum()) or 1.0

    def mixed(self) -> float:
        """Chance that a pair that never occurred finds both its slots taken."""
        return float(np.prod([np.count_nonzero(t) / len(t) for t in self.tables[1:]]))

    @classmethod
    def of(cls, texts: DataFrame) -> "Model":
        """The counts of at most 2 * 2**bits + 2**CHAR_BITS slots come to the driver,
        as Arrow; counted again with larger tables while too many slots are taken."""
        for bits in PAIR_BITS:
            got = pair_counts(texts, bits).toArrow()
            model = cls(*(got.column(c).to_numpy() for c in ("kind", "slot", "n", "once")), bits=bits)
            if model.mixed() <= MOST_MIXED:
                return model
        raise ValueError(f"too many different pairs of characters: {model.mixed():.3f} of unseen ones look like seen ones")

    def __getstate__(self):
        used = [np.flatnonzero(t) for t in self.tables]
        return self.total, [(len(t), at, t[at]) for t, at in zip(self.tables, used)], self.once, self.bits

    def __setstate__(self, state):
        self.total, self.tables, self.once, self.bits = state[0], [], state[2], state[3]
        for size, at, n in state[1]:
            self.tables.append(np.zeros(size, np.float32))
            self.tables[-1][at] = n

    @lru_cache(maxsize=200_000)  # noqa: B019 - one model lives as long as its worker
    def worth(self, a: str, b: str) -> float:
        """Share of the pair in the corpus' mutual information: log(1 + n PMI / million)."""
        if LOST.match(a) or LOST.match(b):
            return 0.0
        p = _fold(np.array([ord(a), ord(b)], np.uint32))
        n = min(float(t[k[0]]) for t, k in zip(self.tables[1:], _pair_keys(p[:1], p[1:], self.bits)))
        if not n:
            return 0.0
        na, nb = (float(self.tables[0][int(c) & ((1 << CHAR_BITS) - 1)]) for c in p)
        pmi = np.log(n * self.total / max(na * nb, 1.0))
        return float(np.log1p(n * max(pmi, LEAST_PMI) / self.total * 1e6))

    def lack(self, text: str) -> tuple[float, list[float]]:
        """What pairs with a character beyond ASCII lack to full worth, and each pair's weight for runs."""
        t = " " + text + " "
        total, weights = 0.0, []
        for a, b in zip(t, t[1:]):
            if a < "\x80" and b < "\x80":
                weights.append(-BRIDGE)
                continue
            w = self.worth(a, b)
            total += max(0.0, FULL - w) + _break(a, b)
            weights.append(IMPROBABLE - w)
        return total, weights

    def runs(self, text: str, weights: list[float]) -> list[tuple[int, int]]:
        """Maximum-scoring segments of the pair weights, as character ranges."""
        out: list[tuple[int, int]] = []
        stack: list[tuple[int, int, float, float]] = []
        acc = 0.0
        for i, w in enumerate(weights):
            if w > 0:
                seg = (i, i + 1, acc, acc + w)
                while True:
                    j = len(stack) - 1
                    while j >= 0 and stack[j][2] >= seg[2]:
                        j -= 1
                    if j < 0 or stack[j][3] >= seg[3]:
                        stack.append(seg)
                        break
                    seg = (stack[j][0], seg[1], stack[j][2], seg[3])
                    del stack[j:]
            acc += w
        for a, b, _, _ in stack:
            # pair i lies between characters i - 1 and i of the text
            first, last = max(0, a - 1), min(len(text), b)
            while first < last and text[first] < "\x80" and text[first].isalnum():
                first += 1
            if any(c >= "\x80" for c in text[first:last]):
                out.append((first, last))
        return out

    @lru_cache(maxsize=100_000)  # noqa: B019
    def restore(self, chunk: str) -> tuple[str, bool]:
        """The chunk with its runs restored, and whether it was garbled."""
        text, garbled = chunk, self.lost(chunk)
        for _ in range(LAYERS):
            new = self._once(text) or (self.once and self.once._once(text)) or (self.once or self)._probable(text)
            if new is None:
                break
            text, garbled = new, True
        return text, garbled

    def lost(self, text: str) -> bool:
        """Whether an improbable run has a character that stands for something lost."""
        if not BAD.search(text):
            return False
        return any(BAD.search(text, a, b) for a, b in self.runs(text, self.lack(text)[1]))

    def _once(self, text: str) -> str | None:
        if not NOT_ASCII.search(text):
            return None
        lack, weights = self.lack(text)
        runs = self.runs(text, weights)
        if not runs:
            return None
        spans = []
        for a, b in runs:
            # the characters its pairs touch: a trail byte may be plain
            spans += [(x, y) for x in (a, a - 1) for y in (b, b + 1) if 0 <= x < y <= len(text)]
        # from the first run to the last, of the text and of each part between backslashes
        edges = [0, *(i + 1 for i, c in enumerate(text) if c == "\\"), len(text) + 1]
        for first, last in [(0, len(text)), *zip(edges, (e - 1 for e in edges[1:]))]:
            inside = [(a, b) for a, b in runs if first <= a and b <= last]
            if len(inside) > 1:
                a, b = inside[0][0], inside[-1][1]
                spans += [(x, y) for x in (a, max(first, a - 1)) for y in (b, min(last, b + 1))]
        best, best_gain = None, LEAST_GAIN if len(text) > 1 else LEAST_GAIN_ALONE
        for a, b in dict.fromkeys(spans):
            for y, utf8 in candidates(text[a:b]):
                new = text[:a] + y + text[b:]
                gain = lack - self.lack(new)[0] + (UTF8_BONUS if utf8 else 0.0)
                if gain > best_gain:
                    best, best_gain = new, gain
        return best

    def _probable(self, text: str) -> str | None:
        """The text with its runs beyond ASCII read as UTF-8, whatever their pairs are worth.

        A garbled word may be so frequent that its own pairs are probable: where
        the run says by itself that it is garbled, its pairs count as unseen.
        """
        best, best_gain, lack = None, LEAST_GAIN, None
        for m in BEYOND_ASCII.finditer(text):
            a, b = m.span()
            for y in utf8_readings(m.group()):
                new = text[:a] + y + text[b:]
                old = lack = self.lack(text)[0] if lack is None else lack
                if _letters_again(text[a - 1 : a], m.group(), y, text[b : b + 1]):
                    t = " " + text + " "
                    old += sum(min(FULL, self.worth(t[i], t[i + 1])) for i in range(a, b + 1))
                gain = old - self.lack(new)[0] + UTF8_BONUS
                if gain > best_gain:
                    best, best_gain = new, gain
        return best


@lru_cache(maxsize=100_000)
def utf8_readings(run: str) -> list[str]:
    """Different texts that the bytes of a whole run are in UTF-8."""
    out = []
    for shown in SHOWN:
        if len(run) < 2 and shown not in WIDE_SHOWN:
            continue
        raw = _bytes(run, shown)
        if raw is None or raw.isascii():
            continue
        try:
            y = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if y != run and not BAD.search(y) and y.isprintable() and y not in out:
            out.append(y)
    return out


def _letters_again(before: str, run: str, new: str, after: str) -> bool:
    """Whether a run with signs in it becomes letters of one script, Latin or (two at
    least) Cyrillic, that fit the letters beside it."""
    if run.isalpha() or not new.isalpha():
        return False
    latin = all("\xc0" <= c <= "\u017f" for c in new)
    if not latin and (len(new) < 2 or not all("\u0400" <= c <= "\u04ff" for c in new)):
        return False
    return not any(_break(x, y) for x, y in zip(before + new, (before + new)[1:] + after) if y)


def _bytes(text: str, enc: str) -> bytes | None:
    """Bytes the text was shown from; C1 controls stand for themselves."""
    try:
        return text.encode(enc)
    except UnicodeEncodeError:
        if enc not in ("cp1252", "cp1251", "cp1250") or not re.search("[\x80-\x9f]", text):
            return None
    try:
        return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode(enc) for c in text)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=100_000)
def candidates(run: str) -> list[tuple[str, bool]]:
    """Different texts the run may have been, and whether UTF-8 says so."""
    out: dict[str, bool] = {}
    # a short or monotonous run of box and block signs is drawing
    drawn = all("\u2500" <= c <= "\u25ff" for c in run) and (len(run) < 4 or len(set(run)) < 3)
    for shown in SHOWN:
        raw = _bytes(run, shown)
        if raw is None or raw.isascii():
            continue
        for written in WRITTEN:
            if written == shown or (written != "utf-8" and (drawn or shown in WIDE_SHOWN)):
                continue
            try:
                y = raw.decode(written)
            except UnicodeDecodeError:
                continue
            if y != run and not BAD.search(y) and all(c.isprintable() or c in "\xa0\u3000\xad" for c in y):
                out[y] = out.get(y, False) or written == "utf-8"
    return list(out.items())


def rows_of(table: DataFrame, name: str, row_id: str, text: str) -> DataFrame:
    return table.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.char_length(c)


OUT = "table_name string, row_id long, text string, restored string, recovered boolean"


def find_garbled(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """(table_name, row_id, text, restored, recovered) of rows (table_name,
    row_id, text) that are garbled, wholly or in part.

    ``recovered`` is false where characters are lost for good; ``restored`` then
    has what could be put right.  Null ids and texts are left out, empty and
    plain ASCII texts are never garbled, repeated rows are each reported.
    """
    model = model or Model.of(rows.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ids, texts = (c.to_pylist() for c in b.columns)
            out = []
            for name, i, t in zip(names, ids, texts):
                hit, parts, at = False, [], 0
                for m in CHUNK.finditer(t):
                    c = m.group()
                    if c.isascii():
                        continue
                    new, garbled = model.restore(c)
                    if garbled:
                        hit = True
                        parts += [t[at : m.start()], new]
                        at = m.end()
                if hit:
                    new = "".join(parts) + t[at:]
                    out.append((name, i, t, new, not BAD.search(new)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["table_name", "row_id", "text", "restored", "recovered"])

    return rows.where(_beyond_ascii(F.col("text"))).mapInArrow(run, OUT)
