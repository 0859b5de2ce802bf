"""Languages of texts and of their segments by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a letter trigram is the product
of its letters' vectors, each permuted by its place, and a text or a language is
the sum of its trigrams' vectors.  Texts are compared with language prototypes
by cosine.

As sums are linear, a text's product with a prototype is the sum of its
trigrams' products with it: these are computed once for each trigram, and a
text's vector is never built.  Trigram vectors being nearly orthogonal, the
square of its length is the sum of its squared trigram counts, which is
estimated from counts of hashed trigrams.

A text far from all prototypes has no language.  The confidence of a language
is the share of right answers among held-out texts at that distance between the
best and the second language, less where the best cosine itself is untypical.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from idloom.functions.hashes import strip

LANGS = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: Codes and names of the languages, English and own.
LABELS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish castilian espanol español castellano",
    "fr": "fr fra fre french francais français",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch flemish nederlands",
    "pt": "pt por portuguese portugues português",
    "ru": "ru rus russian русский",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßабвгдежзийклмнопрстуфхцчшщъыьэюяё"
SYMBOLS = len(LETTERS) + 1
TABLE = 0x600


def label_code(c: Column) -> Column:
    """The language a label names, in any usual code or spelling, with or without a region; else null."""
    pairs = [x for code, names in LABELS.items() for n in names.split() for x in (F.lit(n), F.lit(code))]
    v = F.lower(strip(c))
    head = F.regexp_extract(v, r"^([\p{L}]+)(?:[-_ .(].*)?$", 1)
    return F.try_element_at(F.create_map(*pairs), head)


def _tables() -> np.ndarray:
    """Symbol of each code point below TABLE: 0 for what is no letter of ours."""
    at = {ch: i for i, ch in enumerate(LETTERS, 1)}
    out = np.zeros(TABLE, np.int64)
    for cp in range(TABLE):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        low = ch.lower()[:1]
        out[cp] = at.get(low) or at.get(unicodedata.normalize("NFD", low)[:1], 0)
    return out


SYMBOL_OF = _tables()


def letter_vectors(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), size=(SYMBOLS, dim))


def trigram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    a, rest = np.divmod(grams, SYMBOLS * SYMBOLS)
    b, c = np.divmod(rest, SYMBOLS)
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


class Stream:
    """Texts of a chunk as one stream of symbols, cut into units (sentences and lines).

    Letter runs beside a digit or underscore, or right after a dot, slash or
    backslash, are names, hashes and suffixes: no prose.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n "
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n_docs = len(texts)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        sym = np.where(cp < TABLE, SYMBOL_OF[np.minimum(cp, TABLE - 1)], 0)
        letter = sym > 0
        first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        if letter[0]:
            first = np.concatenate([[0], first])
        last = np.flatnonzero(letter[:-1] & ~letter[1:])
        prev = np.where(first > 0, cp[first - 1], 32)
        after = cp[last + 1]
        digit = lambda x: ((x >= 48) & (x <= 57)) | (x == 95)
        bad = digit(prev) | digit(after) | (prev == 46) | (prev == 47) | (prev == 92)
        mark = np.zeros(len(cp) + 1, np.int8)
        np.add.at(mark, first[bad], 1)
        np.add.at(mark, last[bad] + 1, -1)
        sym[np.cumsum(mark[:-1]) > 0] = 0
        first, last = first[~bad], last[~bad]
        # a unit ends at a line end, or at . ! ? ; : before white space
        white = (cp == 32) | (cp == 10) | (cp == 9) | (cp == 13)
        stop = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 59)
        ends = (cp == 10) | (stop & np.concatenate([white[1:], [True]]))
        unit_of = np.cumsum(ends) - ends
        self.n_units = int(unit_of[-1]) + 1
        self.word_unit = unit_of[first]
        self.letters = np.bincount(self.word_unit, weights=last - first + 1, minlength=self.n_units)
        self.words = np.bincount(self.word_unit, minlength=self.n_units)
        cut = np.concatenate([[0], np.flatnonzero(ends) + 1])[: self.n_units]
        self.unit_start = cut
        self.unit_end = np.concatenate([cut[1:], [len(cp)]])
        self.unit_doc = np.minimum(np.searchsorted(starts, cut, side="right") - 1, self.n_docs - 1)
        self.doc_start = starts
        # one blank between words, none else
        keep = (sym > 0) | np.concatenate([[True], sym[:-1] > 0])
        s, u = sym[keep], unit_of[keep]
        self.grams = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int64)
        self.gram_unit = u[1:-1] if len(s) > 2 else np.zeros(0, np.int64)


#: A unit is prose from so many words and letters on; headings and table lines have fewer.
MIN_WORDS, MIN_LETTERS = 5, 16
NEIGHBOUR = 0.25


#: Slots of a unit's table of hashed trigrams, for its length.
SLOTS = 256
SLOT_OF = np.random.default_rng(17).integers(0, SLOTS, SYMBOLS**3, dtype=np.uint8)
#: Of the cosines of sample units, the low share below which none is typical, and
#: the part of the very lowest (one in a thousand) below which a unit has no language.
TYPICAL, LOWEST, FLOOR = 0.01, 0.001, 0.35


def squared_lengths(grams: np.ndarray, unit: np.ndarray, n_units: int) -> np.ndarray:
    """Sums of squared trigram counts of each unit, by counts of slots: what
    different trigrams of one slot add on average is taken off again."""
    c = np.bincount(unit * SLOTS + SLOT_OF[grams], minlength=n_units * SLOTS).reshape(n_units, SLOTS)
    n = c.sum(axis=1, dtype=np.float64)
    f2 = np.einsum("ij,ij->i", c, c, dtype=np.float64)
    return np.maximum((SLOTS * f2 - n * n) / (SLOTS - 1), n)


class Profiles:
    """Products of known trigrams with the prototypes, small enough to send along."""

    def __init__(self, counts: np.ndarray, grams: np.ndarray, dim: int = 4096, seed: int = 11):
        """``counts``: languages x trigrams; ``grams``: the trigrams' numbers."""
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        weight = np.sqrt(share)
        letters = letter_vectors(dim, seed)
        proto = np.zeros((len(counts), dim))
        for s in range(0, len(grams), 4096):
            proto += weight[:, s : s + 4096] @ trigram_vectors(grams[s : s + 4096], letters).astype(np.float32)
        proto -= proto.mean(axis=0)
        proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        score = np.concatenate([trigram_vectors(grams[s : s + 4096], letters).astype(np.float32) @ proto.T.astype(np.float32) for s in range(0, len(grams), 4096)] or [np.zeros((0, len(counts)))])
        self.row = np.zeros(SYMBOLS**3, np.int32)
        self.row[grams] = np.arange(1, len(grams) + 1)
        self.score = np.concatenate([np.zeros((1, len(counts))), score / np.sqrt(dim)]).astype(np.float32)
        self.floor, self.typical = 0.0, 0.0
        #: distances of the two best cosines, and the share of right answers there
        self.right = (np.array([0.0, 1.0]), np.array([1 / len(LANGS), 1.0]))

    def units(self, st: Stream) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each unit with each language, and whether the unit is prose.

        A unit's score takes in a part of its neighbours' in the same text.
        """
        total, square = self._sums(st.grams, st.gram_unit, st.n_units)
        prose = (st.words >= MIN_WORDS) & (st.letters >= MIN_LETTERS)
        total[~prose] = 0
        same = st.unit_doc[1:] == st.unit_doc[:-1]
        mixed = total.copy()
        mixed[1:][same] += NEIGHBOUR * total[:-1][same]
        mixed[:-1][same] += NEIGHBOUR * total[1:][same]
        square = np.where(prose, square, 0.0)
        length = square.copy()
        length[1:][same] += NEIGHBOUR**2 * square[:-1][same]
        length[:-1][same] += NEIGHBOUR**2 * square[1:][same]
        return mixed / np.sqrt(np.maximum(length, 1.0))[:, None], prose

    def _sums(self, grams: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
        """Products of each unit's vector with the prototypes, and its squared length."""
        rows = self.row[grams]
        total = np.zeros((n_units, self.score.shape[1]))
        for k in range(self.score.shape[1]):
            total[:, k] = np.bincount(unit, weights=self.score[rows, k], minlength=n_units)
        return total, squared_lengths(grams, unit, n_units)

    def language(self, score: np.ndarray, prose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units with a language, which, confidence): prose not below the floor."""
        top = np.sort(score, axis=1)
        u = np.flatnonzero(prose & (top[:, -1] >= self.floor))
        best, second = top[u, -1], top[u, -2]
        sure = np.interp(best - second, *self.right) * np.clip(best / max(self.typical, 1e-9), 0, 1)
        return u, score[u].argmax(axis=1), sure

    def whole(self, st: Stream, score: np.ndarray, prose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with each text that has no prose unit as one unit of its short ones."""
        with_prose = np.zeros(st.n_docs, bool)
        with_prose[st.unit_doc[prose]] = True
        short = ~with_prose[st.unit_doc] & (st.letters > 0)
        if not short.any():
            return score, prose
        use = short[st.gram_unit]
        total, square = self._sums(st.grams[use], st.unit_doc[st.gram_unit[use]], st.n_docs)
        total /= np.sqrt(np.maximum(square, 1.0))[:, None]
        # without a known trigram nothing is known
        short &= (total.max(axis=1) > 0)[st.unit_doc]
        return np.where(short[:, None], total[st.unit_doc], score), prose | short


#: Characters of the sample a language, as a multiple of the texts asked for.
SAMPLE_CHARS = 20_000


def sample_of(documents: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts a language, whole ones, by a hash of id
    and text; copies count once.

    Of each language the lowest hashes are kept, at most twice as many texts and,
    from the second text on, ``SAMPLE_CHARS`` characters a text asked for, so that
    every run draws the same texts.
    """
    h = F.xxhash64(F.lit("sample"), "doc_id", "text")
    labelled = documents.where("doc_id is not null and text is not null").select("doc_id", label_code(F.col("lang")).alias("code"), "text", h.alias("h")).where("code is not null")
    sizes = dict(labelled.groupBy("code").agg(F.count_distinct("h")).collect())
    share = F.coalesce(*[F.when(F.col("code") == c, F.lit(min(1.0, per_language / n))) for c, n in sizes.items()]) if sizes else F.lit(0.0)
    draw = F.pmod("h", F.lit(1_000_000)) / 1e6
    drawn = labelled.where(draw < share).dropDuplicates(["code", "h"])
    w = W.partitionBy("code").orderBy("h")
    kept = drawn.select("code", "h", F.row_number().over(w).alias("k"), F.sum(F.char_length("text")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("chars"), "text")
    rows = kept.where((F.col("k") == 1) | ((F.col("k") <= 2 * per_language) & (F.col("chars") <= SAMPLE_CHARS * per_language))).orderBy("code", "h").select("code", "text").collect()
    return [(r[0], r[1]) for r in rows]


def fit(sample: list[tuple[str, str]], rounds: int = 2, dim: int = 4096, seed: int = 11, calibrate: bool = False) -> Profiles:
    """Prototypes from labelled texts; then units are relabelled by them and the
    prototypes made again, as labels may be wrong and texts mixed.  With
    ``calibrate`` every fifth text is held out once to measure the confidence."""
    profiles, st, score, prose = _fitted(sample, rounds, dim, seed)
    if prose.any():
        tops = score[prose].max(axis=1)
        profiles.typical, profiles.floor = float(np.quantile(tops, TYPICAL)), FLOOR * max(0.0, float(np.quantile(tops, LOWEST)))
    if calibrate:
        held = [x for i, x in enumerate(sample) if i % 5 == 0]
        part = _fitted([x for i, x in enumerate(sample) if i % 5], min(rounds, 1), dim, seed)[0]
        profiles.right = _right_share(part, held)
    return profiles


def _fitted(sample: list[tuple[str, str]], rounds: int, dim: int, seed: int) -> tuple[Profiles, Stream, np.ndarray, np.ndarray]:
    st = Stream([t for _, t in sample] or [""])
    grams, col = np.unique(st.grams, return_inverse=True)
    code = np.array([LANGS.index(c) for c, _ in sample] or [0])
    unit_lang = code[st.unit_doc] if sample else np.zeros(st.n_units, np.int64)
    prose = (st.words >= MIN_WORDS) & (st.letters >= MIN_LETTERS)
    for _ in range(rounds + 1):
        counts = np.zeros((len(LANGS), len(grams)))
        use = prose[st.gram_unit]
        np.add.at(counts, (unit_lang[st.gram_unit[use]], col[use]), 1)
        profiles = Profiles(counts, grams, dim, seed)
        score, prose = profiles.units(st)
        unit_lang = score.argmax(axis=1)
    return profiles, st, score, prose


def _right_share(profiles: Profiles, held: list[tuple[str, str]], bins: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Share of right answers by the distance of the two best cosines, rising, over
    units of held-out texts whose label their whole text confirms."""
    st = Stream([t for _, t in held] or [""])
    score, prose = profiles.units(st)
    code = np.array([LANGS.index(c) for c, _ in held] or [0])
    whole = np.stack([np.bincount(st.unit_doc, weights=np.where(prose, score[:, k], 0), minlength=st.n_docs) for k in range(len(LANGS))], axis=1)
    u = np.flatnonzero(prose & (whole.argmax(axis=1) == code)[st.unit_doc])
    x0, y0 = [0.0], [1 / len(LANGS)]
    if held and len(u):
        top = np.sort(score[u], axis=1)
        x, ok = top[:, -1] - top[:, -2], score[u].argmax(axis=1) == code[st.unit_doc[u]]
        order = np.argsort(x, kind="stable")
        for part in np.array_split(order, min(bins, len(order))):
            x0.append(float(x[part].mean()))
            y0.append((float(ok[part].sum()) + 0.5) / (len(part) + 1))
    return np.maximum.accumulate(np.array(x0)), np.maximum.accumulate(np.array(y0))


def segments(profiles: Profiles, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """Runs of prose units of one language: place in the text, letters, confidence.
    Units below the floor have no language and end no run."""
    st = Stream(texts)
    score, prose = profiles.whole(st, *profiles.units(st))
    u, lang, sure = profiles.language(score, prose)
    doc = st.unit_doc[u]
    new = np.ones(len(u), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    letters = st.letters[u]
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights=letters, minlength=len(head)) if len(u) else np.zeros(0)
    conf = np.bincount(run, weights=letters * sure, minlength=len(head)) / np.maximum(total, 1) if len(u) else np.zeros(0)
    tail = np.concatenate([head[1:] - 1, [len(u) - 1]]) if len(u) else np.zeros(0, np.int64)
    base = st.doc_start[doc[head]] if len(u) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(ids, object)[doc[head]] if len(u) else [], pa.int64()),
            pa.array([LANGS[k] for k in lang[head]] if len(u) else [], pa.string()),
            pa.array((st.unit_start[u[head]] - base).astype(np.int32) if len(u) else [], pa.int32()),
            pa.array((st.unit_end[u[tail]] - base).astype(np.int32) if len(u) else [], pa.int32()),
            pa.array(total.astype(np.int64), pa.int64()),
            pa.array(conf, pa.float64()),
        ],
        names=["doc_id", "lang", "first", "last", "letters", "confidence"],
    )


def language_segments(documents: DataFrame, profiles: Profiles, chunk_chars: int = 1_500_000) -> DataFrame:
    """(doc_id, lang, first, last, letters, confidence): segments of one language
    with their place in the text and the letters of their prose."""
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from idloom.llm.batches import text_chunks

        for ids, texts in text_chunks(batches, chunk_chars):
            yield segments(profiles, ids, texts)

    return docs.mapInArrow(run, "doc_id long, lang string, first int, last int, letters long, confidence double")


def document_languages(documents: DataFrame, profiles: Profiles, chunk_chars: int = 1_500_000) -> DataFrame:
    """(doc_id, label, langs): a text's languages with share and confidence, the
    largest first, made in the task that reads it; a text without letters, or one
    far from all languages, has none.

    Null ids are left out, a null text counts as empty, repeated rows stay rows.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), label_code(F.col("lang")).alias("label"))
    kind = "array<struct<lang:string,share:double,confidence:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, labels = (c.to_pylist() for c in b.columns)
            at, n = 0, 0
            for i, t in enumerate(texts):
                n += len(t)
                if n >= chunk_chars or i + 1 == len(texts):
                    yield one(ids[at : i + 1], texts[at : i + 1], labels[at : i + 1])
                    at, n = i + 1, 0

    def one(ids: list, texts: list, labels: list) -> pa.RecordBatch:
        s = segments(profiles, list(range(len(ids))), texts)
        row, letters, conf = (s.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "letters", "confidence"))
        lang = np.array([LANGS.index(x) for x in s.column("lang").to_pylist()], np.int64)
        key = row.astype(np.int64) * len(LANGS) + lang
        size = len(ids) * len(LANGS)
        total = np.bincount(key, weights=letters, minlength=size).reshape(-1, len(LANGS))
        sure = np.bincount(key, weights=letters * conf, minlength=size).reshape(-1, len(LANGS)) / np.maximum(total, 1)
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1)
        out = [[{"lang": LANGS[k], "share": float(share[r, k]), "confidence": float(sure[r, k])} for k in np.argsort(-share[r], kind="stable") if share[r, k] > 0] for r in range(len(ids))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())])))], names=["doc_id", "label", "langs"])

    return docs.mapInArrow(run, f"doc_id long, label string, langs {kind}")


def mislabelled(languages: DataFrame, least: float = 0.1) -> DataFrame:
    """(doc_id, lang, share, confidence): documents whose label is missing, names
    no language or one the text is not in, and texts in several languages; one
    row for each language with at least ``least`` of the prose."""
    real = F.filter("langs", lambda x: x["share"] >= least)
    rows = languages.withColumn("real", real).where((F.size("real") > 1) | ((F.size("real") == 1) & ~F.coalesce(F.col("label") == F.col("real")[0]["lang"], F.lit(False))))
    return rows.select("doc_id", F.explode("real").alias("x")).select("doc_id", "x.lang", "x.share", "x.confidence")
