import os

from pyspark.sql import functions as F

from idloom.functions import scalars, tables
from idloom.operators import identity, ingest
from idloom.sources.store import Store
from idloom.streaming import targets
from tests.test_identity import OBS, key, opt


def _observed(spark, rows):
    return identity.cleaned(spark.createDataFrame([(i, n, *key(k), opt(s), None) for i, n, k, s in rows] + [(99, "bad", None, None, None, None, None, None)], OBS))


def _entries():
    none = F.lit(None).cast("string")
    return scalars.metadata_entries(F.col("display_name"), none, none, F.lit(None).cast(ingest.ENTRIES))


def test_store_target(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"))
    t = targets.StoreTarget(spark, kept, F.lit("2024-01-01").cast("timestamp"))
    got = t.upsert(_observed(spark, [(1, "a", 1, 5), (2, "b", 2, None), (3, "c", 1, 6)]), _entries())
    assert {r.seq: r.status for r in got.collect()} == {1: "created", 2: "created", 3: "conflict", 99: "error"}
    again = t.upsert(_observed(spark, [(1, "a", 1, 5), (2, "b", 2, None), (3, "c", 1, 6)]), _entries())
    assert {r.seq: r.status for r in again.collect()} == {1: "unchanged", 2: "unchanged", 3: "conflict", 99: "error"}
    assert kept.read("files").count() == 2 and kept.read("conflicts").count() == 1
    assert {(r.file_id, r.name, r.value) for r in kept.read("metadata").collect()} == {(1, "filename", "a"), (2, "filename", "b")}
    rows = spark.createDataFrame([(1, "text", "note", "x", None), (1, "text", "filename", "a", None)], "file_id long, metadata_type string, name string, value string, notes string")
    assert t.add_metadata(rows).count() == 1 and t.add_metadata(rows).count() == 0 and kept.read("metadata").count() == 3
    m = spark.createDataFrame([(1, 2, "p"), (1, None, None), (None, 2, "x")], "parent_file_id long, child_file_id long, archive_path string")
    assert t.add_members(m).count() == 1 and t.add_members(m).count() == 0 and kept.read("members").count() == 1
    assert targets.StoreTarget(spark, kept).store.read("files").count() == 2


def test_service_target(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fake_search.py"))
    t = targets.ServiceTarget("fake_search:service", connections=2)
    got = t.upsert(_observed(spark, [(1, "a", 1, None), (2, "b", 2, None)]), _entries())
    assert {r.seq: (r.status, r.error) for r in got.collect()} == {1: ("created", None), 2: ("created", None), 99: ("error", "Required hashes are missing: crc32, md5, sha1")}
    m = spark.createDataFrame([(1, 2, "p")], "parent_file_id long, child_file_id long, archive_path string")
    assert t.add_members(m).first().answer == '{"archive_path": "p", "child_file_id": 2, "parent_file_id": 1}'


def test_table_functions(spark):
    tables.register(spark)
    xml = "<datafile><game name='g'><rom name='r' size='1' crc='00000000'/></game></datafile>"
    rows = spark.createDataFrame([(xml, "f"), ("", "g"), (None, "h")], "t string, n string")
    rows.createOrReplaceTempView("catalogues_here")
    got = {(r.n, r.place, r.name, r.error) for r in spark.sql("select c.n, d.* from catalogues_here c, lateral parse_dat(c.t, c.n) d").collect()}
    assert got == {("f", 0, "g", None), ("g", None, None, "DAT file is empty"), ("h", None, None, "DAT file is empty")}
    assert spark.sql("select * from archive_entries(cast(null as binary), 'x')").collect() == []
