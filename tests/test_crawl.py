import os
from datetime import datetime

from pyspark.sql import functions as F

from idloom.sources.crawl_source import SearchSource
from idloom.streaming import crawl

ITEM = "identifier string, query string, title string, mediatype string, status string, metadata_json string, attempts int, error string, first_seen_at timestamp, updated_at timestamp"
FILE = "item_identifier string, name string, source string, size_bytes long, status string, attempts int, ufid_file_id long, error string, downloaded_path string, first_seen_at timestamp, updated_at timestamp"
T = [datetime(2024, 1, d) for d in range(1, 9)]


def test_merge_items_keeps_status(spark):
    old = spark.createDataFrame([("a", "q", "old", "texts", "done", "{}", 2, None, T[0], T[1])], ITEM)
    new = spark.createDataFrame([("a", "q2", None, "audio", "x", None, 0, None, T[2], T[3]), ("a", "q1", "mid", None, "x", None, 0, None, T[2], T[2]), ("b", "q", "B", None, "x", None, 0, None, T[4], T[4])], ITEM)
    got = {r.identifier: (r.query, r.title, r.mediatype, r.status, r.attempts, r.metadata_json, r.first_seen_at) for r in crawl.merge_items(old, new).collect()}
    assert got == {"a": ("q2", "old", "audio", "done", 2, "{}", T[0]), "b": ("q", "B", None, "discovered", 0, None, T[4])}
    assert crawl.merge_items(old, new.limit(0)).count() == 1


def test_merge_files_and_queue(spark):
    old = spark.createDataFrame([("i", "f", "original", 1, "failed", 3, 77, "err", None, T[0], T[1])], FILE)
    new = spark.createDataFrame([("i", "f", "derivative", 2, "x", 0, None, None, None, T[2], T[2]), ("i", "g.zip", None, None, "x", 0, 5, None, None, T[3], T[3])], FILE)
    m = crawl.merge_files(old, new)
    got = {r.name: (r.source, r.size_bytes, r.status, r.attempts, r.ufid_file_id, r.first_seen_at) for r in m.collect()}
    assert got == {"f": ("derivative", 2, "failed", 3, 77, T[0]), "g.zip": (None, None, "pending", 0, 5, T[3])}
    assert [r.name for r in crawl.open_files(m).collect()] == ["g.zip"]
    assert [r.name for r in crawl.open_files(m, True).collect()] == ["f", "g.zip"] and crawl.open_files(m, True, 1).count() == 1
    r = {x.name: (x.s, x.d) for x in m.select("name", crawl.skip_reason(True, 1).alias("s"), crawl.defer_reason(2, 5).alias("d")).collect()}
    assert r == {"f": ("failed", "not a clearly supported archive"), "g.zip": ("not original", "below the least size")}


def test_depths_growth_and_checkpoints(spark):
    roots = spark.createDataFrame([("A",)], "collection string")
    links = spark.createDataFrame([("a", "B"), ("b", "c"), ("a", "C"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert {tuple(r) for r in crawl.collection_depths(roots, links).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert crawl.collection_depths(roots, links, 1).count() == 3 and crawl.collection_depths(roots, links, most=2).count() == 2
    old = spark.createDataFrame([("k", "c1", False, 5), ("z", None, True, 9)], "crawl_key string, cursor string, completed boolean, imported long")
    new = spark.createDataFrame([("k", None, True, None)], old.schema)
    nxt = crawl.next_checkpoint(old, new)
    assert {tuple(r) for r in nxt.collect()} == {("k", None, True, 5), ("z", None, True, 9)}
    totals = spark.createDataFrame([("k", 6), ("z", 9)], "crawl_key string, total long")
    assert [r.crawl_key for r in crawl.grown(nxt, totals).collect()] == ["k"]


def test_paged_search_as_batch_and_stream(spark, tmp_path):
    here = os.path.dirname(__file__)
    spark.sparkContext.addPyFile(os.path.join(here, "fake_search.py"))
    spark.dataSource.register(SearchSource)
    rows = spark.read.format("paged_search").option("module", "fake_search:search").option("query", "q").load()
    assert sorted(r.identifier for r in rows.collect()) == ["q0", "q1", "q2", "same", "same", "same"]


def test_stream_of_discoveries_is_idempotent(spark, tmp_path):
    src, state, cp = (str(tmp_path / n) for n in ("src", "state", "cp"))
    batch = lambda rows: spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(src)
    batch([("a", "q", "one", None, "x", None, 0, None, T[0], T[0]), ("b", "q", None, None, "x", None, 0, None, T[0], T[0])])
    stream = lambda: spark.readStream.schema(ITEM).parquet(src)
    crawl.run_stream(spark, stream(), state, cp)
    batch([("a", "q", "two", None, "x", None, 0, None, T[1], T[1])])
    crawl.run_stream(spark, stream(), state, cp)
    crawl.run_stream(spark, stream(), state, cp)
    got = {r.identifier: (r.title, r.status) for r in crawl.read_state(spark, state).collect()}
    assert got == {"a": ("two", "discovered"), "b": (None, "discovered")}
    assert crawl.latest(spark.createDataFrame([], ITEM), ["identifier"]).collect() == [] and F is not None


def test_item_files_of_odd_records(spark):
    from idloom.sources import crawl_source as cs

    rows = [("a", '{"files": [{"name": "x", "size": " 12 ", "md5": " AB "}, "text", null, 5, {"name": ""}, {"name": null}, {"name": 0}, {"name": 7, "size": "many"}, {"size": 1}, {"name": "  "}, [{"name": "no"}]]}'), ("b", '{"files": {"name": "x"}}'), ("c", "not json"), ("d", None), ("e", '["files"]'), ("f", "{}")]
    df = spark.createDataFrame(rows, "identifier string, metadata_json string")
    got = {(r.identifier, r.name, r.size_bytes, r.md5) for r in cs.item_files(df).collect()}
    assert got == {("a", "x", 12, "ab"), ("a", "7", None, None), ("a", "  ", None, None)}
    queued = {r.name: r for r in cs.queue_rows(cs.item_files(df), F.lit(T[0])).collect()}
    assert queued["x"].url.endswith("/download/a/x") and queued["x"].identity_metadata_missing == '["crc32","md5","sha1"]' and queued["x"].needs_downloaded_identity == 1
    kinds = spark.createDataFrame([("a", '{"metadata": {"collection": "one"}}'), ("b", '{"metadata": {"collection": ["x", "", null, 3]}}'), ("c", '{"metadata": {"collection": null}}'), ("d", '{"metadata": 5}'), ("e", None)], df.schema)
    assert {tuple(r) for r in cs.collections(kinds).collect()} == {("a", "one"), ("b", "x"), ("b", "3")}


def test_requests_wait_and_are_tried_again():
    from idloom.sources import crawl_source as cs

    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    answers = iter([(503, {"Retry-After": "7"}, b""), OSError("broken"), (429, {}, b""), (200, {}, b"ok")])

    def call():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert cs.fetch(call, sleep=sleep, gate=cs.Gate(0.5, lambda: clock[0], sleep)) == b"ok"
    assert slept == [7.0, 2.0, 4.0]
    for bad in ([(404, {}, b"")], [(503, {}, b"")] * 2):
        it = iter(bad)
        try:
            cs.fetch(lambda: next(it), retries=1, sleep=lambda s: None)
            raise AssertionError("no error")
        except OSError:
            pass
    assert cs.retry_after_seconds("Thu, 01 Jan 1970 00:01:00 GMT", now=lambda: 20.0) == 40.0
    assert cs.retry_after_seconds("soon") is None and cs.retry_after_seconds(None) is None


def test_records_are_fetched_or_say_why_not(spark):
    from idloom.sources import crawl_source as cs

    ids = spark.createDataFrame([("a",), ("gone",), ("bad",), ("odd",), (None,)], "identifier string")
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fake_search.py"))
    got = {r.identifier: (r.metadata_json, r.error) for r in cs.fetched_records(ids, "fake_search:record", least_wait=0).collect()}
    assert got["a"] == ('{"metadata": {"identifier": "a"}}', None)
    assert got["gone"] == (None, "item not found: gone") and got["bad"] == (None, "no rights") and got["odd"][1].startswith("unexpected")


def test_a_batch_run_again_and_a_write_that_breaks(spark, tmp_path, monkeypatch):
    src, state, cp = (str(tmp_path / n) for n in ("src", "state", "cp"))
    put = lambda i, t: spark.createDataFrame([(i, "q", t, None, "x", None, 0, None, T[0], T[0])], ITEM).coalesce(1).write.mode("append").parquet(src)
    run = lambda: crawl.run_stream(spark, spark.readStream.schema(ITEM).parquet(src), state, cp, 2)
    rows = lambda: {(r.identifier, r.title) for r in crawl.read_state(spark, state).collect()}
    assert crawl.read_state(spark, state) is None
    put("a", "one")
    run()
    put("b", "two")
    # the write of the second version breaks before its mark is made
    whole = crawl.store.mark

    def broken(*args):
        raise OSError("disk full")

    monkeypatch.setattr(crawl.store, "mark", broken)
    try:
        run()
        raise AssertionError("no error")
    except Exception as e:
        assert "disk full" in str(e)
    assert rows() == {("a", "one")}
    monkeypatch.setattr(crawl.store, "mark", whole)
    run()
    assert rows() == {("a", "one"), ("b", "two")}
    # as if the stream's checkpoint had been lost after the last batch: the batch runs again
    for part in ("commits",):
        last = max(os.listdir(f"{cp}/{part}"), key=lambda n: (n.isdigit(), n))
        os.remove(f"{cp}/{part}/{last}")
        crc = f"{cp}/{part}/.{last}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    run()
    assert rows() == {("a", "one"), ("b", "two")}
    put("c", "three")
    run()
    assert rows() == {("a", "one"), ("b", "two"), ("c", "three")}
    assert len([n for n in os.listdir(state) if n.startswith("v")]) == 2
    # a damaged version is an error, never an empty state
    newest = f"{state}/v{crawl.store.versions(spark, state)[-1]}"
    for n in os.listdir(newest):
        os.remove(f"{newest}/{n}")
    try:
        crawl.read_state(spark, state).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert not isinstance(e, AssertionError)


def test_marks_and_getters(spark):
    now = F.lit(T[5])
    items = spark.createDataFrame([("a", "q", None, "Collection", "discovered", None, 0, None, T[0], T[0]), ("b", "q", None, "texts", "metadata_failed", None, 2, "old", T[1], T[1])], ITEM)
    marks = spark.createDataFrame([("a", "metadata_done", None, "{}", 0), ("b", "metadata_failed", "again", None, 1), ("z", "done", None, None, 0)], "identifier string, status string, error string, metadata_json string, more_attempts int")
    got = {r.identifier: (r.status, r.error, r.metadata_json, r.attempts, r.updated_at) for r in crawl.mark_items(items, marks, now).collect()}
    assert got == {"a": ("metadata_done", None, "{}", 0, T[5]), "b": ("metadata_failed", "again", None, 3, T[5])}
    after = crawl.mark_items(items, marks, now)
    assert [r.identifier for r in crawl.scanned_items(after).collect()] == ["a"] == [r.identifier for r in crawl.collection_items(items).collect()]
    assert crawl.get_item(after, "b").first().attempts == 3 and crawl.get_item(after, "z").first() is None
    files = spark.createDataFrame([("i", "f", "original", 1, "failed", 3, None, "err", None, T[0], T[1]), ("i", "g", "original", 1, "done", 0, 5, None, "/p", T[0], T[1])], FILE)
    ids = crawl.record_identities(files, spark.createDataFrame([("i", "f", 8)], "item_identifier string, name string, ufid_file_id long"), now)
    assert {r.name: (r.status, r.ufid_file_id, r.error) for r in ids.collect()} == {"f": ("pending", 8, None), "g": ("done", 5, None)}
    marked = crawl.mark_files(files, spark.createDataFrame([("i", "g", "failed", None, "lost", 1)], "item_identifier string, name string, status string, ufid_file_id long, error string, more_attempts int"), now)
    assert tuple(crawl.get_file(marked, "i", "g").first()) == ("i", "g", "failed", 1, 5, "lost")
    assert crawl.mark_files(files, marked.limit(0).select("item_identifier", "name", "status"), now).exceptAll(files).count() == 0


def test_events_and_aliases(spark):
    rows = spark.createDataFrame([("i", "f", 3, None)], "item_identifier string, name string, n int, m string")
    ev = crawl.events(rows, "info", F.lit("done"), {"n": F.col("n"), "m": F.col("m")}, F.lit(T[0]))
    assert ev.first().details_json == '{"m":null,"n":3}' and ev.first().file_name == "f"
    assert crawl.progress_lines(ev).first()[0] == '{"level":"info","m":null,"message":"done","n":"3"}'
    assert crawl.progress_lines(ev, False).first()[0] == "[info] done (m= n=3)"
    assert crawl.events(rows, "info", F.lit("x"), None, F.lit(T[0])).first().details_json is None
    cp = spark.createDataFrame([("own", "collection:c", "cur", False), ("collection::d", "collection:d", None, True), ("t", "title:x", None, True)], "crawl_key string, query string, cursor string, completed boolean")
    assert {(r.crawl_key, r.cursor, r.completed) for r in crawl.with_aliases(cp).collect()} == {("own", "cur", False), ("collection::c", "cur", False), ("collection::d", None, True), ("t", None, True)}


def test_a_search_is_crawled_to_its_end(spark, tmp_path):
    spark.dataSource.register(SearchSource)
    module = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fake_search.py") + ":search"
    state, cp = str(tmp_path / "state"), str(tmp_path / "cp")
    rows = crawl.crawl(spark, module, "collection:q", state, cp, F.lit(T[0]), {"least_wait": "0"})
    first = {r.crawl_key: (r.completed, r.imported) for r in rows.collect()}
    items = {r.identifier for r in crawl.read_state(spark, state).collect()}
    assert items and set(first) == {"collection:q", "collection::q"} and all(v == (True, len(items)) for v in first.values())
    assert crawl.to_read(crawl.read_state(spark, state)).count() == len(items)
    assert crawl.remaining(None, 1, 1) is None and crawl.remaining(5, 2, 1) == 2 and crawl.remaining(2, 5, 0) == 0
    odd = spark.createDataFrame([(" a ", "", "x"), ("", "t", "m"), (None, None, None)], "identifier string, title string, mediatype string")
    assert [(r.identifier, r.title) for r in crawl.discovered(odd, "q", F.lit(T[0])).collect()] == [("a", None)]
