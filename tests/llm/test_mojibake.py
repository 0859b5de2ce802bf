import random

import pytest

from idloom.llm import mojibake as m

WORDS = "Größe Übersicht für schön Äpfel Prüfung Boîte à disquettes Été élève déjà naïve façade Configuración pequeña año canción Coleção não estação situação perché città più Музыка Драйверы Снимки экрана файлов папка Документы копия 写真 画面写真 説明書 設定ファイル データ 音楽 取扱説明 plain text words file disk".split()
CODES = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp437"), ("cp1252", "cp437"), ("cp932", "cp437"), ("euc_jp", "cp1252")]
SOUND = ["MAÇÃ", "Ã rã", "½ octave ♪", "├── disk2", "░▒▓ intro ▓▒░", "9\xa0123", "√2 Tafeln", "©", "naïve—rôle", "“quoted”", "Ångström"]


def _corpus(seed=1, n=6000):
    r = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        t = " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 6)))
        if r.random() < 0.06:
            written, shown = r.choice(CODES)
            try:
                bad = t.encode(written).decode(shown)
            except UnicodeError:
                bad = t
            if bad != t:
                want[i] = t
                t = bad
        elif r.random() < 0.05:
            t = r.choice(SOUND)
        rows.append(("t", i, t))
    return rows, want


def test_found_and_restored(spark):
    rows, want = _corpus()
    df = spark.createDataFrame(rows + [("t", None, "x"), ("t", -1, None), ("t", -2, ""), ("t", -3, "lost � here"), ("t", -4, "é" * 100_000)], "table_name string, row_id long, text string")
    got = {r.row_id: r for r in m.find_garbled(m.rows_of(df, "t", "row_id", "text")).collect()}
    assert -3 in got and not got[-3].recovered
    assert not {-1, -2, -4, None} & set(got)
    found = set(got) - {-3}
    texts = dict((i, t) for _, i, t in rows)
    assert len(found & set(want)) >= 0.97 * len(want), [texts[i] for i in set(want) - found][:20]
    assert len(found - set(want)) <= 0.01 * len(found), [texts[i] for i in found - set(want)][:20]
    right = sum(got[i].restored == want[i] for i in found & set(want))
    assert right >= 0.9 * len(want)


def test_repeated_garbled_texts_are_found(spark):
    rows, _ = _corpus()
    n = len(rows)
    garbled = "BoÃ®te Ã\xa0 disquettes"
    df = spark.createDataFrame(rows + [("t", n + i, garbled) for i in range(n // 12)] + [("t", 2 * n + i, f"BoÃ®te {i}.img") for i in range(n // 12)], "table_name string, row_id long, text string")
    got = {r.row_id: r.restored for r in m.find_garbled(m.rows_of(df, "t", "row_id", "text")).collect()}
    assert {got.get(n + i) for i in range(n // 12)} == {"Boîte à disquettes"}
    assert all(got.get(2 * n + i) == f"Boîte {i}.img" for i in range(n // 12))


def test_frequent_sound_texts_stay(spark):
    # bytes of these are UTF-8 in some encoding as well
    sound = ["её", "так", "weiß“", "«étude»", "CAFÉ»", "ﾂｱ"]
    df = spark.createDataFrame([("t", i, sound[i % len(sound)]) for i in range(1200)], "table_name string, row_id long, text string")
    assert m.find_garbled(m.rows_of(df, "t", "row_id", "text")).collect() == []


def test_empty(spark):
    df = spark.createDataFrame([], "row_id long, text string")
    assert m.find_garbled(m.rows_of(df, "t", "row_id", "text")).collect() == []


def test_runs_are_maximum_scoring_segments():
    model = m.Model([])
    w = [-1.0, 2.0, -0.5, 2.0, -9.0, 1.0, -1.0]
    assert model.runs("ÃÃÃÃÃÃÃ", w) == [(0, 4), (4, 6)]


@pytest.mark.parametrize("written,shown", CODES)
def test_candidates_have_the_original(written, shown):
    for word in ("Größe", "Музыка", "写真"):
        try:
            bad = word.encode(written).decode(shown)
        except UnicodeError:
            continue
        if bad != word and not m.BAD.search(bad):
            assert word in dict(m.candidates(bad))


def test_tables_grow_with_the_pairs(spark):
    r = random.Random(3)
    rows = [("t", i, "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(60))) for i in range(4000)] + [("t", -1, "Größe der Datei")]
    df = m.rows_of(spark.createDataFrame(rows, "table_name string, row_id long, text string"), "t", "row_id", "text")
    small = m.Model(*(m.pair_counts(df.select("text")).toArrow().column(c).to_numpy() for c in ("kind", "slot", "n", "once")))
    model = m.Model.of(df.select("text"))
    assert small.mixed() > m.MOST_MIXED >= model.mixed() and model.bits > small.bits
    # measured: pairs that never occur and yet find both slots taken
    pairs = [(chr(0x5000 + r.randrange(20_000)), chr(0xAC00 + r.randrange(11_000))) for _ in range(4000)]
    hits = sum(model.worth(a, b) > 0 for a, b in pairs)
    assert abs(hits / len(pairs) - model.mixed()) <= 0.02
    import pickle

    again = pickle.loads(pickle.dumps(model))
    assert again.bits == model.bits and again.worth("G", "r") == model.worth("G", "r")


def test_lost_characters_are_improbable_however_frequent(spark):
    rows = [("t", i, "caf� au lait") for i in range(3000)] + [("t", 9000, "caf\x81"), ("t", 9001, "plain"), ("t", 9002, "Größe")]
    df = m.rows_of(spark.createDataFrame(rows, "table_name string, row_id long, text string"), "t", "row_id", "text")
    got = {r.row_id: r.recovered for r in m.find_garbled(df).collect()}
    assert set(got) == {*range(3000), 9000} and not any(got.values())


def test_mappings_start_and_end_at_runs():
    one = m.Model()
    text = "plain-Ã¼ber\\ordner\\fÃ¼r"
    runs = one.runs(text, one.lack(text)[1])
    assert runs and all(any(c >= "\x80" for c in text[a:b]) and not (text[a] < "\x80" and text[a].isalnum()) for a, b in runs)
    assert {i for i, c in enumerate(text) if c >= "\x80"} <= {i for a, b in runs for i in range(a, b)}
