import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from idloom.operators import ingest
from tests.test_identity import FILES, META

MEMBERS = "id long, parent_file_id long, child_file_id long, archive_path string"


def _zip(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, d in members:
            z.writestr(n, d)
    return buf.getvalue()


def test_add_and_look_up_inputs(spark):
    inner = _zip([("deep.txt", b"deep"), ("empty/", b"")])
    broken = bytearray(_zip([("bad.bin", b"B" * 60)]))
    broken[45] ^= 255
    outer = _zip([("in/inner.zip", inner), ("same.txt", b"deep"), ("broken.zip", bytes(broken))])
    inputs = spark.createDataFrame([(1, "o.zip", outer), (2, "plain.txt", b"deep"), (3, "none", None)], "id long, name string, payload binary")
    files, meta, members = spark.createDataFrame([], FILES), spark.createDataFrame([], META), spark.createDataFrame([], MEMBERS)
    got = ingest.add_inputs(files, meta, members, inputs)
    by_sha = {r.sha1: r.id for r in got.files.collect()}
    sha = lambda b: by_sha[hashlib.sha1(bytes(b)).hexdigest()]
    assert len(by_sha) == 4
    status = {(r.input_id, r.path): r.status for r in got.report.collect()}
    assert status[1, ""] == "created" and status[1, "in/inner.zip!/deep.txt"] == "created" and status[1, "same.txt"] == "enriched" and status[2, ""] == "enriched" and len(status) == 6
    links = {(r.parent_file_id, r.child_file_id, r.archive_path) for r in got.members.collect()}
    assert links == {(sha(outer), sha(inner), "in/inner.zip"), (sha(outer), sha(b"deep"), "same.txt"), (sha(outer), sha(broken), "broken.zip"), (sha(inner), sha(b"deep"), "deep.txt"), (sha(inner), None, "empty")}
    rows = [(r.file_id, r.name, r.value) for r in got.metadata.collect()]
    assert {(sha(b"deep"), "filename", n) for n in ("deep.txt", "same.txt", "plain.txt")} <= set(rows)
    assert [r[0] for r in rows if r[1] == "archive_error"] == [sha(broken)]
    again = ingest.add_inputs(got.files, got.metadata.selectExpr("id", "file_id", "metadata_type", "name", "value", "notes", "cast(null as timestamp) as added_at"), got.members, inputs)
    assert {r.status for r in again.report.collect()} == {"unchanged"} and again.members.count() == 0 and again.metadata.count() == 0
    found = {r.id: r.file_id for r in ingest.lookup_inputs(got.files, inputs).collect()}
    assert found == {1: sha(outer), 2: sha(b"deep")}


def test_no_inputs(spark):
    empty = spark.createDataFrame([], "id long, name string, payload binary")
    got = ingest.add_inputs(spark.createDataFrame([], FILES), spark.createDataFrame([], META), spark.createDataFrame([], MEMBERS), empty)
    assert got.files.collect() == got.report.collect() == got.members.collect() == got.metadata.collect() == []


def test_split_records(spark):
    df = spark.createDataFrame([("i", "a", 1, "0" * 8, "0" * 32, "0" * 40), ("i", "b", None, "0" * 8, None, "zz")], "identifier string, name string, size_bytes long, crc32 string, md5 string, sha1 string")
    done, queued = ingest.split_records(df)
    assert [r.name for r in done.collect()] == ["a"] and queued.first().missing == ["size", "md5", "sha1"]


QUEUE = "item_identifier string, name string, source string, format string, size_bytes long, md5 string, sha1 string, crc32 string, url string, status string, ufid_file_id long, downloaded_path string, metadata_json string, needs_downloaded_identity int, identity_metadata_status string, identity_metadata_missing string, attempts int, error string, first_seen_at timestamp, updated_at timestamp"
ITEMS = "identifier string, query string, title string, mediatype string, status string, metadata_json string, attempts int, error string, first_seen_at timestamp, updated_at timestamp"


def test_items_are_read_into_the_queue(spark):
    import json

    whole = {"name": "w.zip", "size": "3", "crc32": "a" * 8, "md5": "b" * 32, "sha1": "C" * 40, "format": "Metadata"}
    record = json.dumps({"files": [whole, {"name": "part.bin", "size": "9"}, {"name": ""}]})
    now = F.lit("2024-05-01").cast("timestamp")
    items = spark.createDataFrame([("i", "q", None, None, "discovered", None, 0, None, None, None), ("j", "q", None, None, "discovered", None, 1, None, None, None)], ITEMS)
    records = spark.createDataFrame([("i", record, None), ("j", None, "gone")], "identifier string, metadata_json string, error string")
    files = spark.createDataFrame([], "id long, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string")
    meta = spark.createDataFrame([], "id long, file_id long, metadata_type string, name string, value string, notes string, added_at timestamp")
    got = ingest.process_items(files, meta, items, spark.createDataFrame([], QUEUE), records, now)
    assert {r.identifier: (r.status, r.error, r.attempts) for r in got.items.collect()} == {"i": ("metadata_done", None, 0), "j": ("metadata_failed", "gone", 2)}
    q = {r.name: r for r in got.queue.collect()}
    assert set(q) == {"w.zip", "part.bin"} and q["w.zip"].ufid_file_id == 1 and q["w.zip"].needs_downloaded_identity == 0
    assert q["part.bin"].ufid_file_id is None and q["part.bin"].identity_metadata_missing == '["crc32","md5","sha1"]'
    assert [(r.id, r.sha1) for r in got.imported.files.collect()] == [(1, "c" * 40)]
    entries = spark.createDataFrame([("i", "w.zip", None, "Metadata", 3, None, None, None, None)], "identifier string, name string, source string, format string, size_bytes long, md5 string, sha1 string, crc32 string, mtime long").select(F.explode(ingest.declared_entries()).alias("e")).select("e.*")
    assert {(r.name, r.value) for r in entries.collect()} >= {("tag", "IA Artefacts"), ("ia_declared_size", "3"), ("source", "internet_archive")}


def test_downloads_end_in_the_store_or_say_why_not(spark):
    import zlib

    now = F.lit("2024-05-01").cast("timestamp")
    body = _zip([("in.txt", b"inside")])
    row = lambda n, sha1: ("i", n, "original", None, None, None, sha1, None, "u", "downloading", None, None, None, 1, "incomplete", None, 0, None, None, None)
    queue = spark.createDataFrame([row("ok.zip", hashlib.sha1(body).hexdigest().upper()), row("bad.bin", "0" * 40), row("lost.bin", None), row("other", None)], QUEUE)
    downloads = spark.createDataFrame([("i", "ok.zip", body, None), ("i", "bad.bin", b"x", None), ("i", "lost.bin", None, None)], "item_identifier string, name string, payload binary, error string")
    files = spark.createDataFrame([], "id long, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string")
    meta = spark.createDataFrame([], "id long, file_id long, metadata_type string, name string, value string, notes string, added_at timestamp")
    members = spark.createDataFrame([], "id long, parent_file_id long, child_file_id long, archive_path string")
    got = ingest.process_downloads(files, meta, members, queue, downloads, now)
    q = {r.name: (r.status, r.error, r.attempts, r.size_bytes) for r in got.queue.collect()}
    assert q["ok.zip"] == ("done", None, 0, len(body)) and q["other"] == ("downloading", None, 0, None)
    assert q["bad.bin"] == ("failed", "declared sha1 mismatch for i/bad.bin", 1, None) and q["lost.bin"][1] == "nothing was downloaded"
    assert {r.crc32 for r in got.added.files.collect()} == {f"{zlib.crc32(b):08x}" for b in (body, b"inside")}
    assert [r.archive_path for r in got.added.members.collect()] == ["in.txt"]
    assert ingest.process_downloads(files, meta, members, queue, downloads.where("name = 'bad.bin'"), now, verify=False).queue.where("status = 'done'").count() == 1


def test_catalogue_files_are_imported(spark):
    row = lambda n, k: f'rom ( name {n} size {k} crc {k:08x} md5 {k:032x} sha1 {k:040x} )'
    texts = spark.createDataFrame([(f'clrmamepro ( name "L" )\ngame ( name g\n{row("a", 1)}\n{row("b", 2)}\n{row("c", 1)}\nrom ( name d size 3 crc 00000003 ) )', "x.dat"), ("broken (", "y.dat"), (None, "z.dat")], "text string, filename string")
    files = spark.createDataFrame([(7, 2, f"{2:08x}", f"{2:032x}", f"{2:040x}", None, None)], "id long, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string")
    meta = spark.createDataFrame([], "id long, file_id long, metadata_type string, name string, value string, notes string, added_at timestamp")
    got = ingest.import_catalogues(files, meta, texts)
    assert tuple(ingest.import_counts(got).first()) == (4, 3, 1, 2, 0, 1, 1)
    assert {r.id for r in got.files.collect()} == {7, 8}
