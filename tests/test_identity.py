import random

import pytest
from pyspark.sql import functions as F

from idloom.functions import scalars
from idloom.operators import alerts as al
from idloom.operators import containment, identity, provenance, search

FILES = "id long, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string"
META = "id long, file_id long, metadata_type string, name string, value string, notes string, added_at timestamp"
OBS = "obs_id long, display_name string, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string"


def key(k):
    return k, f"{k:08x}", f"{k:032x}", f"{k:040x}"


def opt(x):
    return None if x is None else f"{x:064x}"


def _model(stored, obs):
    """One observation at a time."""
    state = {k: list(v) for k, v in stored.items()}
    names, out = set(), {}
    for i, name, k, s, b in obs:
        if k not in state:
            state[k] = [s, b]
            names.add((k, name))
            out[i] = "created"
            continue
        cur = state[k]
        if any(n is not None and c is not None and n != c for n, c in zip((s, b), cur)):
            out[i] = "conflict"
            continue
        new = any(n is not None and c is None for n, c in zip((s, b), cur)) or (k, name) not in names
        names.add((k, name))
        state[k] = [c if c is not None else n for n, c in zip((s, b), cur)]
        out[i] = "enriched" if new else "unchanged"
    return out, state


def _run(spark, stored, obs):
    files = spark.createDataFrame([(i + 1, *key(k), opt(s), opt(b)) for i, (k, (s, b)) in enumerate(stored.items())], FILES)
    df = spark.createDataFrame([(i, n, *key(k), opt(s), opt(b)) for i, n, k, s, b in obs], OBS)
    none = F.lit(None).cast("string")
    entries = scalars.metadata_entries(F.col("display_name"), none, none, F.lit(None).cast("array<struct<metadata_type:string,name:string,value:string,notes:string>>"))
    return identity.consolidate(files, spark.createDataFrame([], META), identity.cleaned(df), entries)


def test_rejected_observation_gives_nothing(spark):
    a, b, x, y = 10, 11, 12, 13
    obs = [(1, "n", 1, a, None), (2, "n", 1, b, x), (3, "n", 1, None, y)]
    got = _run(spark, {}, obs)
    assert {r.seq: r.status for r in got.report.collect()} == {1: "created", 2: "conflict", 3: "enriched"}
    f = got.files.first()
    assert (f.sha256, f.blake3) == (opt(a), opt(y))
    c = got.conflicts.collect()
    assert [(r.algorithm, r.existing_value, r.incoming_value, r.file_id) for r in c] == [("sha256", opt(a), opt(b), f.id)]


@pytest.mark.parametrize("seed", range(3))
def test_import_equals_one_at_a_time(spark, seed):
    r = random.Random(seed)
    pick = lambda: r.choice([None, None, 1, 1, 2])
    stored = {k: (pick(), pick()) for k in range(4)}
    obs = [(i, r.choice("ab"), r.choice([0, 0, 0, *range(12)]), pick(), pick()) for i in range(250)]
    got = _run(spark, stored, obs)
    want, state = _model(stored, obs)
    assert {x.seq: x.status for x in got.report.collect()} == want
    rows = got.files.collect()
    assert {x.size_bytes: (x.sha256, x.blake3) for x in rows} == {k: (opt(s), opt(b)) for k, (s, b) in state.items()}
    assert sorted(x.id for x in rows) == list(range(1, len(state) + 1))


def test_errors_and_empty(spark):
    obs = spark.createDataFrame([(1, "n", None, "0" * 8, "0" * 32, "0" * 40, None, None), (2, "n", 1, "g" * 8, "0" * 32, "0" * 40, None, None), (3, None, 1, None, "", "0" * 40, None, None), (4, "n", -1, "0" * 8, "0" * 32, "0" * 40, "12", None)], OBS)
    got = {r.seq: r.error for r in identity.cleaned(obs).collect()}
    assert got == {1: "Exact file size is required", 2: "crc32 must contain only hexadecimal characters", 3: "Required hashes are missing: crc32, md5", 4: "Exact file size must be a non-negative integer"}
    empty = _run(spark, {}, [])
    assert empty.report.collect() == [] and empty.files.collect() == [] and empty.conflicts.collect() == []


def test_overlaps(spark):
    rows = [(1, 5, "a", "b", "c"), (2, 5, "a", "b", "d"), (3, 6, "a", "b", "c"), (4, 5, "x", "y", "z")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], FILES)
    got = {(r.algorithm, r.file_id, r.first_file_id, r.n_files) for r in identity.overlap_classes(df).collect()}
    assert got == {("crc32", 1, 1, 2), ("crc32", 2, 1, 2), ("md5", 1, 1, 2), ("md5", 2, 1, 2)}


def test_append_missing_is_null_safe(spark):
    state = spark.createDataFrame([(1, 7, None), (2, 7, "p")], "id long, parent_file_id long, archive_path string")
    new = spark.createDataFrame([(7, None), (7, "p"), (7, "q"), (7, "q"), (8, None)], "parent_file_id long, archive_path string")
    got = sorted(map(tuple, identity.append_missing(state, new, ["parent_file_id", "archive_path"]).select("id", "parent_file_id", "archive_path").collect()), key=str)
    assert sorted(r[1:] for r in got) == [(7, "q"), (8, None)] or {r[1:] for r in got} == {(7, "q"), (8, None)}
    assert {r[0] for r in got} == {3, 4}


def test_empty_directories(spark):
    rows = [(1, None, "empty-folder/"), (1, None, "docs\\"), (1, 5, "docs/readme.txt"), (2, None, "docs"), (2, 6, "/a/b/c"), (2, None, "a/b"), (2, None, "a/b/x"), (3, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, parent_file_id long, child_file_id long, archive_path string")
    assert {tuple(r) for r in containment.empty_directories(df).collect()} == {(1, "empty-folder"), (2, "docs"), (2, "a/b/x")}


def test_ancestors_local_and_distributed_agree(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (10, 11), (11, 10), (11, 4), (5, None)]
    m = spark.createDataFrame([(i, p, c, "x") for i, (p, c) in enumerate(edges)], "id long, parent_file_id long, child_file_id long, archive_path string")
    f = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 10, 99)], "id long")
    a = {tuple(r) for r in provenance.ancestors(f, m, 9).collect()}
    b = {tuple(r) for r in provenance.ancestors(f, m, 9, local_rows=0).collect()}
    assert a == b and (4, 1, 2) in a and (4, 1, 3) in a and (99, 99, 0) in a and (4, 10, 8) in a and max(r[2] for r in a) == 9
    meta = spark.createDataFrame([(1, 1, "text", "ia_identifier", "top", None, None), (2, 3, "text", "ia_identifier", "low", None, None), (3, 2, "text", "source", "s ", None, None)], META)
    got = {r.file_id: (r.source_file_id, r.ia_identifier) for r in provenance.record_origin(f.where("id < 5"), m.where("id < 4"), meta).collect()}
    assert got == {1: (1, "top"), 2: (1, "top"), 3: (1, "top"), 4: (1, "top")}
    top = {r.file_id: (r.source_file_id, r.source_value) for r in provenance.top_source(f.where("id < 5"), m.where("id < 4"), meta).collect()}
    assert top == {2: (2, "s"), 3: (2, "s"), 4: (2, "s")}


def test_alert_life(spark):
    files = spark.createDataFrame([(i, *key(i), None, None) for i in (1, 2, 3)], FILES)
    k1, k2 = key(1), key(2)
    raw = [(7, "A", "d", 1, None, k1[2], None, None), (7, "B", "d", None, None, None, k2[3], "dat"), (8, "A", "d", 1, None, k1[2], None, None), (8, "none", "d", None, None, None, None, None), (8, "bad", "d", None, "zz", None, None, None), (8, "size", "d", 9, None, k1[2], None, None)]
    inc = al.normalized(spark.createDataFrame(raw, "user_id long, name string, description string, size_bytes long, crc32 string, md5 string, sha1 string, source_type string"))
    none = spark.createDataFrame([], "id long, fingerprint string, " + ", ".join(f"{c} {'long' if c == 'size_bytes' else 'string'}" for c in al.FIELDS))
    links = spark.createDataFrame([], "user_id long, alert_id long")
    alerts, links, report = al.import_alerts(none, links, inc)
    got = {r.user_id: (r.received, r.valid, r.created, r.skipped, r.errors) for r in report.collect()}
    assert got == {7: (2, 2, 2, 0, 0), 8: (4, 2, 2, 0, 2)}
    assert alerts.count() == 3 and links.count() == 4
    again = al.import_alerts(alerts, links, inc)[2]
    assert {r.user_id: (r.created, r.skipped) for r in again.collect()} == {7: (0, 2), 8: (0, 2)}
    stored = spark.createDataFrame([], "user_id long, alert_id long, file_id long, " + ", ".join(f"matched_{h} int" for h in scalars.ALGORITHMS) + ", size_matched int, found_at timestamp")
    t1, t2 = (F.lit(f"2020-01-0{i} 00:00:00").cast("timestamp") for i in (1, 2))
    stored, rep = al.scan(alerts, links, files, stored, t1)
    assert {r.user_id: (r.matched, r.created) for r in rep.collect()} == {7: (2, 2), 8: (1, 1)}
    stored, rep = al.scan(alerts, links, files, stored, t2)
    assert {r.user_id: (r.matched, r.created) for r in rep.collect()} == {7: (2, 0), 8: (1, 0)}
    assert stored.select("found_at").distinct().count() == 1
    rows = {(r.user_id, r.source_key): (r.label, r.alert_count, r.hit_count) for r in al.alert_sources(alerts, links, stored).collect()}
    assert rows == {(7, "manual"): ("Manual", 1, 1), (7, "dat|"): ("dat", 1, 1), (8, "manual"): ("Manual", 2, 1)}
    meta = spark.createDataFrame([(1, 1, "text", "filename", "one.bin", None, None)], META)
    members = spark.createDataFrame([], "id long, parent_file_id long, child_file_id long, archive_path string")
    full = {(r.user_id, r.file_id): (r.display_name, r.matched_algorithms) for r in al.match_rows(stored, alerts, files, meta, members).collect()}
    assert full == {(7, 1): ("one.bin", ["md5"]), (7, 2): (None, ["sha1"]), (8, 1): ("one.bin", ["md5"])}
    assert al.match_rows(stored, alerts, files, meta, members, query="ONE.b", with_sources=False).count() == 2
    a, left, m = al.clear(alerts, links, stored, spark.createDataFrame([(7,)], "user_id long"))
    assert (a.count(), left.count(), m.count()) == (2, 2, 1)


def test_fingerprint_is_canonical_json(spark):
    import hashlib
    import json

    rows = [("n", "dé日\U0001f600\"\\\n", 5, "0" * 8), ("plain", "x/y", None, "1" * 8)]
    df = al.normalized(spark.createDataFrame(rows, "name string, description string, size_bytes long, crc32 string"))
    for r in df.collect():
        body = {"name": r.name, "description": r.description, "size_bytes": r.size_bytes, "hashes": {a: (r.crc32 if a == "crc32" else None) for a in scalars.ALGORITHMS}, "source_type": None, "source_name": None, "source_detail": None}
        assert r.fingerprint == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_pages(spark):
    files = spark.createDataFrame([(1, 30, "a", "m", "s", None, None), (2, 10, "b", "m", "s", "z", None), (3, 20, "c", "m", "s", "a", None)], FILES)
    meta = spark.createDataFrame([(i, i, "text", "filename", n, None, None) for i, n in ((1, "beta"), (2, "Alpha"), (3, "gamma"))], META)
    members = spark.createDataFrame([(1, 1, 2, "dir/file")], "id long, parent_file_id long, child_file_id long, archive_path string")
    ids = lambda **k: [r.id for r in search.list_files(files, meta, members, **k).collect()]
    assert ids(sort="name", direction="asc", limit=2) == [2, 1] and ids(sort="name", direction="asc", limit=2, offset=2) == [3]
    assert ids(sort="size") == [1, 3, 2] and ids(sort="sha256", direction="asc") == [1, 3, 2]
    assert ids(query="DIR/") == [1] and ids(query="a_pha") == [2] and ids(limit=0) == [3]
    assert search.page_envelope(2, 3, 0) == {"count": 2, "total_count": 3, "next_offset": 2}
    assert search.page_envelope(1, 3, 2)["next_offset"] is None
    with pytest.raises(ValueError):
        search.list_files(files, meta, members, sort="nope")
    assert [r.id for r in search.files_by_hash(files, "MD-5", "M").collect()] == [3, 2, 1]
    page = {r.id: r for r in search.file_page(files, meta, members).collect()}
    assert page[1].archive_members[0].archive_path == "dir/file" and page[2].metadata[0].value == "Alpha" and page[3].hashes["sha256"] == "a"


def test_conflicts_of_classes_equal_pairs(spark):
    r = random.Random(5)
    rows = [(i + 1, r.choice([1, 2]), f"{r.randrange(3):08x}", f"{r.randrange(4):032x}", f"{i:040x}", None, None) for i in range(60)]
    files = spark.createDataFrame(rows, FILES)
    created = files.where("id > 20")
    none = spark.createDataFrame([], "id long, " + ", ".join(f"{k} {'long' if k.endswith(('file_id', 'size_bytes')) else 'string'}" for k in identity.CONFLICT_KEY))
    logged = identity.log_conflicts(none, identity.overlap_conflicts(files, created)).cache()
    assert identity.log_conflicts(logged, identity.overlap_conflicts(files, created)).count() == 0
    pairs = {(a[0], b[0], n) for a in rows for b in rows if a[0] < b[0] and b[0] > 20 and a[1] == b[1] for n, k in (("crc32", 2), ("md5", 3)) if a[k] == b[k]}
    for f in (1, 5, 21, 60):
        got = [(x.file_id, x.related_file_id, x.algorithm) for x in identity.conflicts_of(logged, files, f).collect()]
        assert sorted(got) == sorted(p for p in pairs if f in p[:2])
    assert identity.conflict_counts(logged).agg(F.sum("n_conflicts")).first()[0] == 2 * logged.count()
    logged.unpersist()


def test_sources_are_stored_once(spark):
    meta = spark.createDataFrame([(1, 7, "text", "source", " logiqx_dat ", None, None), (2, 7, "text", "dat_filename", "a.dat", None, None), (3, 7, "text", "source", "logiqx_dat", None, None), (4, 8, "text", "source", "own", None, None), (5, 8, "text", "source", " ", None, None), (6, 9, "text", "source", None, None, None)], META)
    stored = provenance.Sources(spark.createDataFrame([(3, "own", None)], "id long, name string, description string"), spark.createDataFrame([(8, 3, "")], "file_id long, source_id long, external_reference string"))
    got = provenance.add_sources(stored, meta)
    assert {tuple(r) for r in got.sources.collect()} == {(3, "own", "own"), (4, "logiqx_dat", "Logiqx DAT")}
    assert {tuple(r) for r in got.file_sources.collect()} == {(8, 3, ""), (7, 4, "a.dat")}
    assert {r[0] for r in provenance.source_catalog(got.sources, meta).collect()} == {"own", "logiqx_dat"}
    assert {tuple(r) for r in provenance.resolved_sources(got, meta).collect()} == {(8, "own", ""), (7, "logiqx_dat", "a.dat")}


def test_names_of_a_crawl(spark):
    df = spark.createDataFrame([(" Collection: \"abc\" ",), ("collection:a b",), ("collection:",), ("title:x",), (None,)], "q string")
    got = [r[0] for r in df.select(scalars.collection_of(F.col("q"))).collect()]
    assert got == ["abc", None, None, None, None]
    names = spark.createDataFrame([("x_META.xml", None), ("a/files.xml", None), ("b.zip", "Metadata"), ("b.zip", None), (None, None)], "n string, f string")
    assert [r[0] for r in names.select(scalars.is_artifact(F.col("n"), F.col("f"))).collect()] == [True, True, True, False, False]
    parts = spark.createDataFrame([("con",), (" a. ",), ("..",), ("x<y>|z",), ("n" * 300,), ("",)], "c string")
    assert [r[0] for r in parts.select(scalars.safe_component(F.col("c"))).collect()] == ["_con", "a", "_", "x_y__z", "n" * 180, "_"]
    assert scalars.key_values(["a=1", " b =x=y", "a=2"]) == {"a": "2", "b": "x=y"}
    for bad in ("novalue", " =x"):
        with pytest.raises(ValueError):
            scalars.key_values([bad])
    assert scalars.url_with("u?a=1", {"b": "x y"}) == "u?a=1&b=x+y" and scalars.url_with("u") == "u"
    with pytest.raises(ValueError):
        scalars.record_rows(df.withColumn("j", F.lit("{}")).withColumnRenamed("q", "name"), "j", [], "name")


def test_match_records_and_pages(spark):
    alerts = al.normalized(spark.createDataFrame([(1, "n", "d", 5, "0" * 8, None, None)], "id long, name string, description string, size_bytes long, crc32 string, md5 string, sha1 string"))
    files = spark.createDataFrame([(9, 5, "0" * 8, "1" * 32, "2" * 40, None, None)], FILES)
    meta = spark.createDataFrame([(1, 9, "text", "ia_identifier", "it", None, None), (2, 9, "text", "source", "internet_archive", None, None), (3, 9, "text", "filename", "f.bin", None, None)], META)
    members = spark.createDataFrame([], "id long, parent_file_id long, child_file_id long, archive_path string")
    links = spark.createDataFrame([(4, 1)], "user_id long, alert_id long")
    none = spark.createDataFrame([], "user_id long, alert_id long, file_id long, " + ", ".join(f"matched_{h} int" for h in scalars.ALGORITHMS) + ", size_matched int, found_at timestamp")
    stored, _ = al.scan(alerts, links, files, none, F.lit("2024-01-01").cast("timestamp"))
    r = al.match_records(al.match_page(al.match_rows(stored, alerts, files, meta, members))).first()
    assert r.alert.hashes["crc32"] == "0" * 8 and r.file.display_name == "f.bin" and r.matched_algorithms == ["crc32"] and r.size_matched
    assert r.file.source.label == "Internet Archive" and r.file.record.item_url.endswith("/details/it")
    bare = al.match_records(al.match_rows(stored, alerts, files, meta.limit(0), members)).first()
    assert bare.file.source is None and bare.file.record is None and bare.file.display_name is None
    assert al.match_page(al.match_rows(stored, alerts, files, meta, members), 200, 1).count() == 0
    assert "fingerprint" not in al.alert_records(alerts).columns and al.given_values([" a", "", "a", "b"]) == ["a", "b"]


@pytest.mark.parametrize("local", [0, 10**7])
def test_top_ancestors(spark, local):
    r = random.Random(2)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(40)]
    m = spark.createDataFrame([(i, p, c, None) for i, (p, c) in enumerate(edges)], "id long, parent_file_id long, child_file_id long, archive_path string")
    f = spark.createDataFrame([(i,) for i in range(32)] + [(None,), (3,)], "id long")
    rank = {i: r.randrange(1000) for i in range(0, 32, 3)}
    targets = spark.createDataFrame(list(rank.items()), "id long, rank long")
    want = {}
    for i in range(32):
        level, best = {i}, None
        for depth in range(8):
            hits = [(rank[x], x) for x in level if x in rank]
            best = min(hits)[1] if hits else best
            level = {p for p, c in edges if c in level}
        if best is not None:
            want[i] = best
    assert dict(map(tuple, provenance.top_ancestors(f, m, targets, 7, local).collect())) == want
