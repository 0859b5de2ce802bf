import random

import numpy as np
from pyspark.sql import functions as F

from idloom.llm import langid as l

SENTENCES = {
    "de": "Der Katalog enthält mehrere Zeichnungen des Gehäuses|Die Prüfsumme wurde nicht mit dem Original verglichen|Niemand hat diesen Ordner bisher geöffnet und überprüft|Das alte Programm überschreibt die fehlenden Bilder ohne Warnung",
    "en": "The catalogue contains several drawings of the case|Nobody has checked this folder since the last run|The old program replaces the missing pictures without any warning|Please compare the file before you delete anything else",
    "es": "El catálogo contiene varios dibujos de la caja original|Nadie ha comprobado todavía esta carpeta desde la última pasada|El antiguo programa sobrescribe las imágenes sin ninguna advertencia|La copia de seguridad necesita el controlador de la tarjeta",
    "fr": "Le catalogue contient plusieurs dessins du boîtier d'origine|Personne n'a encore vérifié ce dossier depuis le dernier passage|L'ancien programme remplace les images sans le moindre avertissement|La sauvegarde nécessite le pilote de la carte son",
    "it": "Il catalogo contiene diversi disegni della scatola originale|Nessuno ha ancora controllato questa cartella dopo l'ultima verifica|Il vecchio programma sostituisce le immagini senza alcun avviso|La copia di sicurezza richiede il driver della scheda audio",
    "nl": "De catalogus bevat meerdere tekeningen van de oorspronkelijke behuizing|Niemand heeft deze map sinds de laatste ronde nagekeken|Het oude programma vervangt de ontbrekende beelden zonder waarschuwing|De reservekopie vereist het stuurprogramma van de geluidskaart",
    "pt": "O catálogo contém vários desenhos da caixa original|Ninguém verificou ainda esta pasta desde a última passagem|O antigo programa substitui as imagens sem qualquer aviso|A cópia de segurança precisa do controlador da placa de som",
    "ru": "Каталог содержит несколько рисунков корпуса и старый список|Никто ещё не проверял эту папку со времени последнего обхода|Старый установщик заменяет недостающие образы без предупреждения|Резервная копия включает драйвер звуковой платы",
}


def _text(r, lang, n=6):
    return ". ".join(r.choice(SENTENCES[lang].split("|")) for _ in range(n)) + "."


def _docs(seed=3, n=400):
    r = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        a, b = r.sample(l.LANGS, 2)
        k = r.random()
        text, langs = (_text(r, a) + "\n\n" + _text(r, b), {a, b}) if k < 0.15 else (_text(r, a), {a})
        label = r.choice([a, a.upper(), l.LABELS[a].split()[1], f"{a}-XX", l.LABELS[a].split()[3 if len(l.LABELS[a].split()) > 3 else 2]])
        if k > 0.9:
            label = r.choice([None, "", "xx", "und", b])
        if r.random() < 0.3:
            text = "# Title\n\n  x080.zip  2620331  19d9eea4\n  a324.zip  4543313  dcbb141e\n" + text
        rows.append((i, text, label, 5, "c"))
        if k < 0.15 or k > 0.9:
            want[i] = langs
    return rows, want


SCHEMA = "doc_id long, text string, lang string, share int, label string"


def test_labels_and_mixed_texts(spark):
    rows, want = _docs()
    df = spark.createDataFrame(rows + [(1000, None, "en", 0, ""), (1001, "", None, 0, ""), (1002, "==--== 12", "de", 0, ""), (None, rows[0][1], None, 0, "")], SCHEMA)
    profiles = l.fit(l.sample_of(df, 60))
    got = {}
    for r in l.mislabelled(l.document_languages(df, profiles)).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
        assert 0 < r.share <= 1 and 0 <= r.confidence <= 1
    assert len(set(got) ^ set(want)) <= 2 and sum(got.get(i) == w for i, w in want.items()) >= 0.98 * len(want)
    plain = {r.doc_id: r.langs for r in l.document_languages(df, profiles).collect()}
    assert plain[1000] == plain[1001] == plain[1002] == [] and None not in plain and len(plain) == 403
    segs = l.language_segments(df.where("doc_id < 50"), profiles).collect()
    text = {i: t for i, t, *_ in rows}
    for s in segs:
        assert 0 <= s.first < s.last <= len(text[s.doc_id]) + 1 and s.letters > 0


def test_texts_of_short_lines_have_a_language(spark):
    r = random.Random(4)
    p = l.fit([(lang, _text(r, lang)) for lang in l.LANGS for _ in range(20)])
    rows = []
    for i, lang in enumerate(l.LANGS):
        w = [w for s in SENTENCES[lang].split("|") for w in s.split()]
        rows.append((i, "\n".join(" ".join(w[k : k + 3]) for k in range(0, len(w), 3)), None, 0, ""))
    df = spark.createDataFrame([*rows, (100, "12 34\n--", None, 0, "")], SCHEMA)
    got = {x.doc_id: x.lang for x in l.mislabelled(l.document_languages(df, p)).collect()}
    assert got == dict(enumerate(l.LANGS))
    segs = l.language_segments(df, p).collect()
    assert {s.doc_id: s.lang for s in segs} == got and len(segs) == len(got)


def test_sample_has_whole_texts_and_all_languages(spark):
    r = random.Random(8)
    long = _text(r, "fr", 600)
    rows = [(7, _text(r, "en", 3), "en", 0, "")] * 2000 + [(8, long, "fr", 0, "")] + [(10 + i, _text(r, "de"), "de", 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = l.sample_of(df, 30)
    assert len(long) > 20_000 and ("fr", long) in got
    assert sum(c == "en" for c, _ in got) == 1 and 10 <= sum(c == "de" for c, _ in got) <= 60
    assert got == l.sample_of(df.repartition(7), 30)


def test_held_out_accuracy(spark):
    r = random.Random(9)
    train = [(lang, _text(r, lang)) for lang in l.LANGS for _ in range(20)]
    wrong = [(r.choice(l.LANGS), t) for _, t in train[::9]]
    p = l.fit(train + wrong)
    test = [(lang, s) for lang in l.LANGS for s in SENTENCES[lang].split("|")]
    segs = l.segments(p, list(range(len(test))), [t for _, t in test]).to_pylist()
    assert [s["lang"] for s in segs] == [lang for lang, _ in test]


def test_codes(spark):
    rows = [("en_GB", "en"), ("ENG", "en"), (" German ", "de"), ("pt-BR", "pt"), ("ru-RU", "ru"), ("dut", "nl"), ("Español", "es"), ("Dutch (Belgium)", "nl"), ("xx", None), ("N/A", None), ("", None), (None, None), ("english2", None)]
    df = spark.createDataFrame(rows, "lang string, want string").withColumn("got", l.label_code(F.col("lang")))
    for r in df.collect():
        assert r.got == r.want, r


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    p = l.fit(l.sample_of(df, 10))
    assert l.document_languages(df, p).collect() == [] and l.language_segments(df, p).collect() == []
    one = spark.createDataFrame([(1, "Some text without any profile at all.", None, 0, "")], SCHEMA)
    assert l.document_languages(one, p).count() == 1


def test_length_is_near_the_bundled_vectors():
    r = np.random.default_rng(1)
    for n, kinds in ((20, 500), (300, 200), (3000, 900)):
        grams = r.integers(0, kinds, n)
        want = float((np.bincount(grams) ** 2).sum())
        [got] = l.squared_lengths(grams, np.zeros(n, np.int64), 1)
        assert n <= got and abs(got - want) <= 0.2 * want
        vectors = l.trigram_vectors(grams, l.letter_vectors(4096, 3)).astype(np.int64).sum(axis=0)
        assert abs((vectors**2).sum() / 4096 - want) <= 0.3 * want
    assert l.squared_lengths(np.zeros(0, np.int64), np.zeros(0, np.int64), 2).tolist() == [0, 0]


def test_texts_far_from_all_languages_have_none():
    r = random.Random(5)
    p = l.fit([(lang, _text(r, lang)) for lang in l.LANGS for _ in range(40)], calibrate=True)
    texts = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。", _text(r, "it")]
    got = l.segments(p, list(range(4)), texts).to_pylist()
    known = [s for s in got if s["doc_id"] == 3]
    assert {s["lang"] for s in known} == {"it"} and min(s["confidence"] for s in known) > 0.8
    assert all(s["confidence"] < 0.4 for s in got if s["doc_id"] < 3) and not any(s["doc_id"] == 2 for s in got)


def test_confidence_is_the_share_of_right_answers():
    r = random.Random(6)
    noisy = lambda lang: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and r.random() < 0.35 else c for c in _text(r, lang))
    p = l.fit([(lang, noisy(lang)) for lang in l.LANGS for _ in range(60)], calibrate=True)
    test = [(lang, noisy(lang)) for lang in l.LANGS for _ in range(30)]
    segs = l.segments(p, list(range(len(test))), [t for _, t in test]).to_pylist()
    right = sum(s["letters"] for s in segs if s["lang"] == test[s["doc_id"]][0]) / sum(s["letters"] for s in segs)
    said = sum(s["letters"] * s["confidence"] for s in segs) / sum(s["letters"] for s in segs)
    assert abs(right - said) < 0.1
    assert (np.diff(p.right[1]) >= 0).all()
