import os

import pytest
from pyspark.sql import functions as F

from idloom.functions import requests as rq
from idloom.functions import scalars
from idloom.session import shared_dir
from idloom.sources import store


def test_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "root"))
    assert s.names() == []
    with pytest.raises(LookupError):
        s.read("t")
    for n in range(4):
        assert s.write("t", spark.range(n)) == n
    assert s.read("t").count() == 3 and s.names() == ["t"]
    assert store.versions(spark, str(tmp_path / "root" / "t")) == [2, 3]
    # data without a mark is not seen
    spark.range(50).write.parquet(str(tmp_path / "root" / "t" / "v4"))
    assert s.read("t").count() == 3 and s.write("t", spark.range(7)) == 4 and s.read("t").count() == 7


def test_database(spark):
    url = "jdbc:derby:memory:records;create=true"
    df = spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    store.write_database(df, url, "FILES", "overwrite")
    got = store.read_database(spark, url, "FILES", "ID", rows_per_task=30)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert store.read_database(spark, url, "FILES").where("ID = 5").first().NAME == "n5"
    store.write_database(df.limit(0), url, "EMPTY_ONE", "overwrite")
    assert store.read_database(spark, url, "EMPTY_ONE", "ID").collect() == []


def test_remote_service(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fake_search.py"))
    q = spark.createDataFrame([(1, "md5", "a"), (2, "md5", "none"), (3, "md5", "broken")], "id long, algorithm string, value string")
    got = {r.place: (r.file_id, r.error) for r in store.found_by_hash(q, "fake_search:service", retries=0).collect()}
    assert got == {1: (7, None), 2: (None, None), 3: (None, "HTTP 500")}
    rows = spark.createDataFrame([(1, 5, None, "p")], "id long, parent_file_id long, child_file_id long, archive_path string")
    assert store.sent(store.requests_of(rows, "add_archive_member"), "fake_search:service").first().answer == '{"archive_path": "p", "parent_file_id": 5}'


def test_values_of_requests():
    assert rq.query_number({"n": ["7", "8"]}, "n") == 7 and rq.query_number({}, "n", 5) == 5 and rq.query_number({"n": [""]}, "n") is None
    for bad in ({"n": ["x"]}, {"n": ["-1"]}):
        with pytest.raises(ValueError):
            rq.query_number(bad, "n")
    with pytest.raises(ValueError):
        rq.query_number({"n": [""]}, "n", 3)
    assert (rq.page_limit(0), rq.page_limit(999), rq.payload_size("5"), rq.positive_id(3, "id")) == (1, 200, 5, 3)
    for f, args in ((rq.payload_size, (True,)), (rq.payload_size, (-1,)), (rq.payload_size, (None,)), (rq.positive_id, (0, "id")), (rq.positive_id, ("x", "id")), (rq.metadata_payload, (["x"],))):
        with pytest.raises(ValueError):
            f(*args)
    assert rq.metadata_payload({"a": 1}) == {"a": "1"} and rq.metadata_payload([{"name": "a"}]) == [{"name": "a"}]


def test_iso_text(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05' as a, timestamp'2024-01-02 03:04:05.000070' as b, cast(null as timestamp) as c")
    assert tuple(df.select(*[scalars.iso_text(F.col(x)) for x in "abc"]).first()) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000070", None)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        shared_dir(Session())
