import bz2
import gzip
import hashlib
import io
import json
import lzma
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from idloom.functions import scalars
from idloom.sources import archives, crawl_source, dat, hashing


def _entries(*args):
    return list(archives.entries(*args))


def _zip(members, nested=None):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, data in members:
            z.writestr(n, data)
    return buf.getvalue()


def _tar(members, mode="w"):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode=mode) as t:
        for n, data in members:
            info = tarfile.TarInfo(n)
            if data is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def test_hashes(spark, tmp_path):
    data = [b"", b"hello", bytes(range(256)) * 999]
    for i, d in enumerate(data):
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / f"f{i}.bin").write_bytes(d)
    want = {f"f{i}.bin": (len(d), f"{zlib.crc32(d):08x}", hashlib.md5(d).hexdigest(), hashlib.sha1(d).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in enumerate(data)}
    for over in (1 << 28, 10):
        got = {r.path.rpartition("/")[2]: (r.size_bytes, r.crc32, r.md5, r.sha1, r.sha256) for r in hashing.file_hashes(spark, str(tmp_path), stream_over=over).collect()}
        assert got == want
    assert [r.path.rpartition("/")[2] for r in hashing.input_files(spark, str(tmp_path)).collect()] == sorted(want)
    df = spark.createDataFrame([("é",), (None,)], "t string").select(*hashing.column_hashes(F.col("t"), ("SHA-1", "sha1", "crc32")))
    assert df.columns == ["sha1", "crc32"] and df.collect()[1].sha1 is None
    for bad in ((), ("nope",), ("blake3",)):
        with pytest.raises(ValueError):
            hashing.column_hashes(F.col("t"), bad)
    with pytest.raises(ValueError):
        hashing.stream_hashes(io.BytesIO(b""), ("md5",), 0)
    assert hashing.stream_hashes(io.BytesIO(data[2]), ("md5", "crc32"), 100)[1]["crc32"] == want["f2.bin"][1]


def test_archive_kinds():
    members = [("docs/readme.txt", b"r"), ("empty-folder/", b""), ("docs/", b"")]
    got = _entries(_zip(members), "a.bin")
    assert [(e.path, e.is_empty_directory, e.payload) for e in got] == [("empty-folder", True, None), ("docs/readme.txt", False, b"r")]
    for mode in ("w", "w:gz", "w:bz2", "w:xz"):
        got = _entries(_tar([("d/e", None), ("x/y.txt", b"1"), ("x", None)], mode), None)
        assert [(e.path, e.is_empty_directory) for e in got] == [("d/e", True), ("x/y.txt", False)]
    for suffix, pack in ((".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (".lzma", lambda b: lzma.compress(b, lzma.FORMAT_ALONE))):
        assert [(e.path, e.payload) for e in _entries(pack(b"p"), f"folder/payload.bin{suffix}")] == [("payload.bin", b"p")]
    import zstandard

    assert _entries(zstandard.compress(b"p"), "a.zst")[0].payload == b"p"
    assert _entries(zstandard.compress(_tar([("a", b"1")])), "a.tar.zst")[0].path == "a"
    assert _entries(gzip.compress(b"x"), "a.warc.gz") == [] == _entries(gzip.compress(b"x"), "a.cdx.gz")
    assert _entries(b"plain", "a.txt") == [] and _entries(b"", "") == []
    assert _entries(b"broken", "a.zip")[0].error and _entries(b"broken", "a.gz")[0].error
    whole = bytearray(_zip([("a", b"A" * 50), ("b", b"B")]))
    whole[45] ^= 255
    got = _entries(bytes(whole), "a.zip")
    assert got[0].error and got[0].path == "a" and got[1].payload == b"B"
    locked = bytearray(_zip([("a", b"A")]))
    locked[locked.find(b"PK\x01\x02") + 8] |= 1
    assert "Encrypted" in _entries(bytes(locked), None)[0].error


def test_nested_members_as_rows(spark):
    inner = _zip([("deep.txt", b"d")])
    outer = _zip([("archives/inner.zip", inner), ("x.txt", b"x")])
    df = spark.createDataFrame([(1, outer, "o.zip", "clash"), (2, b"no", "n.txt", ""), (3, None, "z.zip", "")], "id long, payload binary, name string, path string")
    got = {r.path: (r.id, r.depth, r.size_bytes, r.sha1) for r in archives.archive_members(df).collect()}
    assert set(got) == {"archives/inner.zip", "x.txt", "archives/inner.zip!/deep.txt"}
    assert got["archives/inner.zip!/deep.txt"] == (1, 2, 1, hashlib.sha1(b"d").hexdigest())
    assert archives.archive_members(df, nested=False).count() == 2
    assert archives.archive_members(df.limit(0)).collect() == []


def test_listing():
    text = "Listing archive: a.7z\n\n--\nPath = a.7z\nType = 7z\nPhysical Size = 99\n\n----------\nPath = dir\nFolder = +\nSize = 0\n\nPath = dir\\f.txt\nFolder = -\nSize = 12\nEncrypted = -\n\nPath = s.bin\nSize = 3\nEncrypted = +\n"
    assert [(m["path"], m["is_directory"], m["encrypted"], m["size"]) for m in archives.listing_members(text)] == [("dir", True, False, 0), ("dir/f.txt", False, False, 12), ("s.bin", False, True, 3)]


XML = '﻿<?xml version="1.0"?><datafile xmlns="urn:x"><header><description>D</description></header><game name="g1"><rom name="r1" size="1" crc="AA"/><machine><disk name="d1" sha1="BB"/></machine><rom name="none" size="2"/></game><software><description>S</description><rom md5="CC"/></software></datafile>'


def test_dat_forms(spark):
    rows = dat.parse_dat(XML, "file.dat")
    assert [(r["name"], r["source_detail"], r["crc32"], r["sha1"], r["md5"]) for r in rows] == [("g1", "r1", "AA", None, None), ("g1", "d1", None, "BB", None), ("D", "d1", None, "BB", None), ("S", None, None, None, "CC")]
    assert rows[0]["source_name"] == "D"
    classic = 'clrmamepro ( name "My \\"set\\"" )\ngame ( name "G" rom ( name path\\grass(hp).tc size 5 crc 1234abcd ) part ( disk ( md5 ff ) ) )\n'
    rows = dat.parse_dat(classic)
    assert [(r["name"], r["source_detail"], r["size_bytes"], r["crc32"], r["md5"], r["source_name"]) for r in rows] == [("G", "path\\grass(hp).tc", "5", "1234abcd", None, 'My "set"'), ("G", "disk", None, None, "ff", 'My "set"')]
    for bad in (None, "", "  ", "<x", "<datafile/>", "game ( name", "game )", "( x )", "game ( rom ( ) )"):
        with pytest.raises(dat.DatError):
            dat.parse_dat(bad)
    df = spark.createDataFrame([(XML, "a", "clash"), (None, "b", ""), ("game (", None, "")], "text string, filename string, name string")
    got = dat.dat_rows(df).collect()
    assert len(got) == 6 and sum(r.error is not None for r in got) == 2
    assert dat.dat_rows(df.limit(0)).collect() == []


def test_scalars(spark):
    one = lambda c, v, t="string": spark.createDataFrame([(v,)], f"v {t}").select(c(F.col("v")).alias("x")).first().x
    assert one(scalars.normalized_hashes, {"SHA-1": " AB ", "md5": "", "foo": "1", "CRC32": None}, "map<string,string>") == {"sha1": "ab"}
    for t, n in (("100k", 102400), ("2M", 2 << 20), ("60G", 60 << 30), ("1.5GiB", 3 << 29), ("7", 7), ("7 bytes", 7), ("8kb", 8192)):
        assert scalars.size_limit(t) == n == one(scalars.size_limit_column, t)
    assert one(scalars.size_limit_column, "x") is None
    for bad in ("", "-1", "5x", "k"):
        with pytest.raises(ValueError):
            scalars.size_limit(bad)
    for name, suffix, arch in (("a.TAR.GZ", ".tar.gz", True), ("X.ZIP", ".ZIP", False), ("x.zip", ".zip", True), ("a.warc.gz", "", False), ("dir.zip/file", "", False), (".gz", "", False), ("a.b.7z", ".7z", True), ("", "", False)):
        assert one(scalars.archive_suffix, name) == suffix, name
        assert one(scalars.is_archive_name, name) == arch, name
    assert one(scalars.decompressed_name, "folder/payload.bin.GZ") == "payload.bin" and one(scalars.decompressed_name, ".gz") == "decompressed"
    assert one(scalars.archive_path, "\\a\\b/") == "a/b" and one(scalars.archive_path, "//") == "//"
    assert one(scalars.parent_directories, "a/b/c") == ["a", "a/b"] and one(scalars.parent_directories, "a") == []
    assert one(scalars.quoted, "a b/c+d~é*%") == "a%20b/c%2Bd~%C3%A9%2A%25"
    assert one(scalars.json_list, '["a", 1]') == ["a", "1"] and one(scalars.json_list, "{") == [] and one(scalars.json_list, None) == []
    assert one(scalars.json_object, "nope") == {} and one(scalars.json_object, '{"a": {"b": 1}}') == {"a": '{"b":1}'}
    assert one(scalars.optional_size, " 12 ") == 12 and one(scalars.optional_size, "-1") is None and one(scalars.optional_size, "x") is None
    assert one(lambda c: scalars.safe_path(F.lit("it:em"), c), "../a/./b?.txt") == "it_em/a/b_.txt"
    assert one(lambda c: scalars.contains("a\\b%", c), "xa\\bz") is True and one(lambda c: scalars.contains("q", c), None) is False
    with pytest.raises(ValueError):
        scalars.algorithm_name("md4")


def test_record_rows(spark):
    rec = {"name": "skip", "tags": ["x", 2, True], "n": 5, "f": 1.5, "b": True, "o": {"k": [1]}, "l": [[1]], "e": [], "z": None, "t": "txt"}
    df = spark.createDataFrame([(1, json.dumps(rec), "c"), (2, "bad", ""), (3, None, ""), (4, "[1]", "")], "id long, j string, key string")
    got = {(r.metadata_type, r.name, r.value) for r in scalars.record_rows(df, "j", ["name"], "id").collect()}
    p = scalars.RECORD_PREFIX
    assert {("number", p + "n", "5"), ("text", p + "t", "txt"), ("json", p + "b", "true"), ("json", p + "o", '{"k":[1]}'), ("json", p + "l", "[[1]]"), ("json", p + "e", "[]"), ("json", p + "z", "null"), ("number", p + "f", "1.5")} <= got
    assert not any(r[1] == p + "name" for r in got)


def test_item_files_and_search(spark):
    rec = {"metadata": {"collection": ["a", "b"]}, "files": [{"name": "f", "size": "12", "md5": "AB"}, {"size": 1}, {"name": "g", "size": "x"}]}
    df = spark.createDataFrame([("i", json.dumps(rec)), ("j", "bad"), ("k", '{"metadata": {"collection": "c"}}')], "identifier string, metadata_json string")
    assert {(r.identifier, r.name, r.size_bytes, r.md5) for r in crawl_source.item_files(df).collect()} == {("i", "f", 12, "ab"), ("i", "g", None, None)}
    assert {tuple(r) for r in crawl_source.collections(df).collect()} == {("i", "a"), ("i", "b"), ("k", "c")}
    calls = []

    def search(q, cursor, count):
        calls.append((q, cursor, count))
        n = int(cursor or 0)
        return {"items": [{"identifier": f"x{n}"}], "cursor": str(n + 1) if n < 2 else None}

    assert [i[0]["identifier"] for i, _ in crawl_source.pages(search, "q", count=5)] == ["x0", "x1", "x2"] and calls[0] == ("q", None, 100)
    waits, answers = [], iter([(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")])
    assert crawl_source.fetch(lambda: next(answers), sleep=waits.append) == b"ok" and waits == [1.0, 7.0]
    with pytest.raises(OSError):
        crawl_source.fetch(lambda: (404, {}, b""))
    assert crawl_source.backoff_seconds(10) == 60.0
    now = [0.0]
    gate = crawl_source.Gate(2.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    gate.wait()
    gate.wait()
    assert now[0] == 2.0


def test_content_types_and_sniffing(spark):
    import mimetypes

    from pyspark.sql import functions as F

    from idloom.functions import scalars

    names = ["a.txt", "b.tar.gz", "C.PDF", "d", ".zip", "dir/e.json", "f.unknown", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalars.content_type(F.col("n"))).collect()]
    assert got == [mimetypes.guess_type(n)[0] for n in names]
    assert archives.is_archive(_zip([("a", b"1")])) and archives.is_archive(_tar([("a", b"1")]), "x.bin") and archives.is_archive(b"x", "x.gz")
    assert not archives.is_archive(b"plain", "x.txt") and not archives.is_archive(_zip([("a", b"1")]), "x.warc.gz")
    paths = spark.createDataFrame([("i/d", "a\\b/../c.txt"), ("i", "../.."), ("con", "x")], "i string, n string")
    assert [r[0] for r in paths.select(scalars.safe_path(F.col("i"), F.col("n"))).collect()] == ["i/d/a/b/c.txt", None, "_con/x"]
    ends = spark.sql("select timestamp'2024-01-01 00:00:00' as t").select(scalars.expiry(F.col("t"), 90)).first()[0]
    assert ends == "2024-01-01T00:01:30"
