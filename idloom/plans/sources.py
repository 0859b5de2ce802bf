"""Queries of the sources and of what is left of the inventory, with equal SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import scalars, tables
from idloom.operators import accounts, containment, ingest
from idloom.operators import alerts as al
from idloom.plans import catalog as c
from idloom.plans import records as r
from idloom.session import Scratch, table
from idloom.sources import archives, hashing
from idloom.sources.store import Store
from idloom.streaming import crawl, targets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- files -----------------------------------------------------------------------------


def _nation_files(spark: SparkSession, d: str) -> str:
    """A folder with one text file a nation, in folders by region."""
    root = f"{Scratch(spark).root}/nations"
    table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").repartition(1).write.partitionBy("n_regionkey", "n_nationkey").text(root)
    return root


def _nation():
    return F.regexp_extract("path", r"n_nationkey=([0-9]+)/", 1).cast("int").alias("n_nationkey")


@query("SELECT n_nationkey, (strlen(n_name) + 1)::BIGINT AS length FROM nation")
def a4_listing(spark, d):
    """Files below a folder, at any depth."""
    files = hashing.input_files(spark, _nation_files(spark, d))
    return files.where(F.col("path").endswith(".txt")).select(_nation(), "length")


@query("SELECT n_nationkey, (strlen(n_name) + 1)::BIGINT AS size_bytes, md5(n_name || chr(10)) AS md5, sha1(n_name || chr(10)) AS sha1, sha256(n_name || chr(10)) AS sha256 FROM nation")
def a5_file_hashes(spark, d):
    """Hashes of all files of a folder, those over eight bytes read as streams."""
    hashed = hashing.file_hashes(spark, _nation_files(spark, d), ("md5", "sha1", "sha256"), stream_over=8)
    return hashed.where(F.col("path").endswith(".txt")).select(_nation(), "size_bytes", "md5", "sha1", "sha256")


# -- archives --------------------------------------------------------------------------


def _packed(spark: SparkSession, d: str, each: int, pack: Callable[[int, list], bytes], name: str) -> DataFrame:
    """Documents packed by ``each`` ids: (id, name, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, docs in zip(*(x.to_pylist() for x in b.columns)):
                files = [(f"d{i}/{x['doc_id']}.txt", x["text"].encode()) for x in sorted(docs, key=lambda x: x["doc_id"])]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([f"{i}{name}"]), pa.array([pack(i, files)], pa.binary())], names=["id", "name", "payload"])

    docs = table(spark, d, "documents").where("text is not null").groupBy(F.expr(f"doc_id div {each}").alias("id")).agg(F.collect_list(F.struct("doc_id", "text")).alias("docs"))
    return docs.mapInArrow(run, "id long, name string, payload binary")


def _zip(i: int, files: list) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, body in files:
            z.writestr(path, body)
    return out.getvalue()


def _tar(i: int, files: list) -> bytes:
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for path, body in files:
            info = tarfile.TarInfo(path)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        empty = tarfile.TarInfo(f"none{i}")
        empty.type = tarfile.DIRTYPE
        t.addfile(empty)
    return out.getvalue()


def _gz(i: int, files: list) -> bytes:
    import gzip

    return gzip.compress(files[0][1], mtime=0)


def _nested(i: int, files: list) -> bytes:
    return _tar(i, [(f"in/{i}.zip", _zip(i, files))])


_DOC = "SELECT 'd' || (doc_id // {n}) || '/' || doc_id || '.txt' AS path, false AS is_empty_directory, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL"


@query(_DOC.format(n=50) + " UNION ALL SELECT DISTINCT 'none' || (doc_id // 50), true, NULL, NULL FROM documents WHERE text IS NOT NULL")
def a11_tarred_documents(spark, d):
    """All documents in compressed TAR archives of fifty, with an empty folder each."""
    return archives.archive_members(_packed(spark, d, 50, _tar, ".tar.gz")).select("path", "is_empty_directory", "md5", "sha1")


@query("SELECT doc_id AS id, doc_id || '.txt' AS path, strlen(text)::BIGINT AS size_bytes, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def a12_compressed_documents(spark, d):
    """Each document as one compressed file."""
    return archives.archive_members(_packed(spark, d, 1, _gz, ".txt.gz")).select("id", "path", "size_bytes", "md5")


@query("SELECT doc_id // 50 AS id, 'in/' || (doc_id // 50) || '.zip!/d' || (doc_id // 50) || '/' || doc_id || '.txt' AS path, 2 AS depth, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def a14_nested_documents(spark, d):
    """Documents in ZIP archives inside TAR archives."""
    return archives.archive_members(_packed(spark, d, 50, _nested, ".tgz")).where("depth = 2").select("id", "path", "depth", "md5")


@query("SELECT id // 500 AS id, 'f/' || id AS path, id % 7 = 0 AS is_directory, id % 5 = 0 AND id % 7 <> 0 AS encrypted, size_bytes AS size FROM ufid_file")
def a16_listings(spark, d):
    """All files as technical listings of five hundred, read again."""
    f = table(spark, d, "ufid_file")
    block = F.concat(F.lit("Path = f\\"), F.col("id").cast("string"), F.lit("\nSize = "), F.col("size_bytes").cast("string"), F.when(F.expr("id % 7 = 0"), "\nFolder = +").otherwise("\nFolder = -"), F.when(F.expr("id % 5 = 0 and id % 7 <> 0"), "\nEncrypted = +\n").otherwise("\nEncrypted = -\n"))
    texts = f.groupBy(F.expr("id div 500").alias("id")).agg(F.concat(F.lit("Path = all.7z\nType = 7z\nPhysical Size = 9\n\n----------\n"), F.array_join(F.collect_list(block), "\n")).alias("text"))
    return archives.listed_members(texts)


@query("SELECT 'd' || (doc_id // 100) || '/' || doc_id || '.txt' AS archive_path, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def h12_archive_imports(spark, d):
    """Documents in ZIP archives of a hundred, added with their members: links and files."""
    empty = lambda k: spark.createDataFrame([], k)
    files = empty("id long, size_bytes long, crc32 string, md5 string, sha1 string, sha256 string, blake3 string")
    meta = empty("id long, file_id long, metadata_type string, name string, value string, notes string, added_at timestamp")
    got = ingest.add_inputs(files, meta, empty("id long, parent_file_id long, child_file_id long, archive_path string"), _packed(spark, d, 100, _zip, ".zip"))
    return got.members.join(got.files.select(F.col("id").alias("child_file_id"), "md5", "sha1"), "child_file_id").select("archive_path", "md5", "sha1")


@query("SELECT d.doc_id AS id, 'sha256' AS algorithm, m.file_id FROM documents d JOIN (SELECT sha256(text) AS h, max(doc_id) AS file_id FROM documents GROUP BY 1) m ON m.h = sha256(d.text)")
def h16_known_inputs(spark, d):
    """Documents looked up among files made of them: the newest copy of each."""
    docs = table(spark, d, "documents").where("text is not null")
    files = docs.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size_bytes"), *hashing.column_hashes(F.col("text")))
    inputs = docs.select(F.col("doc_id").alias("id"), F.lit("x.txt").alias("name"), F.col("text").cast("binary").alias("payload"))
    return ingest.lookup_inputs(files, inputs)


# -- members, queue, checkpoints -------------------------------------------------------

_BIGGEST = "(SELECT parent_file_id FROM ufid_archive_member WHERE parent_file_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, parent_file_id LIMIT 1 OFFSET 5)"


@query(f"SELECT id, parent_file_id, child_file_id, archive_path FROM ufid_archive_member WHERE parent_file_id = {_BIGGEST}")
def b5_members(spark, d):
    """Members of the sixth largest archive."""
    m = table(spark, d, "ufid_archive_member")
    n = F.count(F.lit(1)).alias("n")
    top = m.where("parent_file_id is not null").groupBy("parent_file_id").agg(n).orderBy(F.col("n").desc(), "parent_file_id").offset(5).limit(1).first()
    return containment.list_members(m, top[0] if top else -1).select("id", "parent_file_id", "child_file_id", "archive_path")


@query(f"WITH {r._LATEST_FILES} SELECT item_identifier, name, status FROM lf WHERE status IN ('pending', 'downloading') ORDER BY first_seen_at, item_identifier, name LIMIT 50")
def f7_queue(spark, d):
    """The first fifty files of the queue."""
    return crawl.open_files(r._queue(spark, d), limit=50).select("item_identifier", "name", "status")


@query("SELECT source_value, CASE source_value WHEN 'internet_archive' THEN 'Internet Archive' WHEN 'logiqx_dat' THEN 'Logiqx DAT' ELSE source_value END AS label, coalesce(hit_count, 0)::BIGINT AS hit_count FROM (SELECT DISTINCT source_value FROM src) LEFT JOIN (SELECT source_value, count(*) AS hit_count FROM m JOIN s USING (file_id) WHERE alert_id % 5 = 2 GROUP BY 1) USING (source_value)".join([f"WITH RECURSIVE {c._MATCH}, {c._UP}, x(file_id, ancestor_id) AS (SELECT DISTINCT file_id, file_id FROM m UNION SELECT x.file_id, up.p FROM x JOIN up ON up.c = x.ancestor_id), {c._SOURCE}, s AS (SELECT DISTINCT x.file_id, source_value FROM x JOIN src ON src.file_id = x.ancestor_id) ", ""]))
def c8_file_sources(spark, d):
    """All sources with one user's hits, none as 0."""
    _, _, stored = c._stored(spark, d)
    return al.file_sources(stored, *c._t(spark, d, "ufid_archive_member", "ufid_file_meta"), 2)


_COUNTS = "n AS (SELECT query AS crawl_key, count(DISTINCT identifier) AS total FROM ia_ingest_item WHERE query IS NOT NULL GROUP BY 1)"


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ia_ingest_item").where("query is not null").groupBy(F.col("query").alias("crawl_key")).agg(F.count_distinct("identifier").alias("total"))


@query(f"WITH {_COUNTS} SELECT crawl_key, CASE WHEN total % 2 = 0 THEN 'next' END AS cursor, total % 2 = 1 AS completed, CASE WHEN total % 3 = 0 THEN total ELSE total - 1 END AS imported FROM n")
def j1_checkpoints(spark, d):
    """Checkpoints of all searches after another page; some say how many items came."""
    t = _totals(spark, d)
    old = t.select("crawl_key", F.lit("first").alias("cursor"), F.lit(False).alias("completed"), (F.col("total") - 1).alias("imported"))
    new = t.select("crawl_key", F.when(F.col("total") % 2 == 0, "next").alias("cursor"), (F.col("total") % 2 == 1).alias("completed"), F.when(F.col("total") % 3 == 0, F.col("total")).alias("imported"))
    return crawl.next_checkpoint(old, new)


@query(f"WITH {_COUNTS} SELECT crawl_key, total - 1 AS imported, total FROM n WHERE total % 2 = 1")
def j10_grown(spark, d):
    """Searches that came to their end and find more items now."""
    t = _totals(spark, d)
    done = t.select("crawl_key", (F.col("total") % 2 == 1).alias("completed"), (F.col("total") - 1).alias("imported"))
    return crawl.grown(done, t)


# -- names and sizes -------------------------------------------------------------------

_PART = "CASE WHEN v = '' THEN '_' WHEN lower(v) IN (" + ", ".join(f"'{x}'" for x in scalars.RESERVED) + ") THEN '_' || v ELSE v END"


@query(f"SELECT item_identifier, name, substr({_PART}, 1, 180) AS component FROM (SELECT DISTINCT item_identifier, name, trim(regexp_replace(name, '[\\x00-\\x1f<>:\"|?*]', '_', 'g'), ' .') AS v FROM ia_ingest_file WHERE name IS NOT NULL)")
def i26_safe_names(spark, d):
    f = table(spark, d, "ia_ingest_file").where("name is not null")
    return f.select("item_identifier", "name", scalars.safe_component(F.col("name")).alias("component")).distinct()


@query("SELECT DISTINCT name, CASE WHEN b = '' THEN 'decompressed' ELSE b END AS inner_name FROM (SELECT name, regexp_extract(regexp_replace(name, '(?i)(" + "|".join(x.replace(".", "\\.") for x in scalars.SINGLE_SUFFIXES) + ")$', ''), '([^/]*)/*$', 1) AS b FROM ia_ingest_file WHERE name IS NOT NULL)")
def i17_inner_names(spark, d):
    f = table(spark, d, "ia_ingest_file").where("name is not null")
    return f.select("name", scalars.decompressed_name(F.col("name")).alias("inner_name")).distinct()


@query("SELECT obs_id, CASE WHEN size_bytes >= 0 THEN floor(CAST(size_bytes % 1000 AS DOUBLE) * CASE obs_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024.0 WHEN 2 THEN 1048576.0 ELSE 1073741824.0 END)::BIGINT ELSE -1 END AS bytes FROM file_observation")
def i20_size_limits(spark, d):
    """Sizes written with units, as bytes; what is no size is -1 here."""
    unit = F.element_at(F.array(F.lit(""), F.lit(" K"), F.lit("MiB"), F.lit("gb ")), (F.pmod("obs_id", F.lit(4)) + 1).cast("int"))
    text = F.when(F.col("size_bytes") >= 0, F.concat((F.col("size_bytes") % 1000).cast("string"), unit)).otherwise("-1k")
    return table(spark, d, "file_observation").select("obs_id", F.coalesce(scalars.size_limit_column(text).cast("long"), F.lit(-1)).alias("bytes"))


@query(f"SELECT obs_id, {', '.join(f"nullif(lower(trim({h}, {c._WS})), '') AS {h}" for h in ('crc32', 'md5', 'sha1'))} FROM file_observation")
def i1_normalized_hashes(spark, d):
    """Hashes given as a map under odd names, with blanks and an unknown one."""
    m = F.create_map(F.lit("CRC-32"), F.col("crc32"), F.lit("MD5"), F.col("md5"), F.lit("sha-1"), F.col("sha1"), F.lit("whirlpool"), F.lit("x"), F.lit("sha256"), F.lit(" "))
    got = scalars.normalized_hashes(m)
    return table(spark, d, "file_observation").select("obs_id", *[F.try_element_at(got, F.lit(h)).alias(h) for h in ("crc32", "md5", "sha1")])


# -- accounts --------------------------------------------------------------------------

_USERS = "u AS (SELECT c_custkey::BIGINT AS id, lower(trim(c_name)) AS username, c_nationkey % 3 <> 0 AS is_active, CASE WHEN c_nationkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' END AS registered_at, CASE WHEN c_nationkey % 5 <> 0 THEN TIMESTAMP '2024-01-02' END AS activated_at, lower(c_mktsegment) AS segment FROM customer)"


def _users(spark: SparkSession, d: str) -> DataFrame:
    n, day = F.col("c_nationkey"), lambda x: F.lit(x).cast("timestamp")
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), accounts.user_name(F.col("c_name")).alias("username"), (n % 3 != 0).alias("is_active"), F.when(n % 4 != 0, day("2024-01-01")).alias("registered_at"), F.when(n % 5 != 0, day("2024-01-02")).alias("activated_at"))


@query(
    f"""WITH {_USERS}, r AS (SELECT o_custkey AS user_id, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1)
 SELECT id, username, CASE WHEN activated_at IS NOT NULL AND NOT is_active THEN 'inactive' WHEN registered_at IS NULL THEN 'invited' WHEN NOT is_active THEN 'pending_activation' ELSE 'active' END AS user_status, CASE WHEN id % 3 = 0 THEN 'admin,reader' WHEN id % 3 = 1 THEN 'curator' ELSE '' END AS roles, last AS last_request FROM u LEFT JOIN r ON r.user_id = u.id"""
)
def c16_users(spark, d):
    """Customers as accounts, with roles, and their orders as requests."""
    users = _users(spark, d)
    roles = users.where("id % 3 < 2").select(F.col("id").alias("user_id"), F.explode(F.when(F.expr("id % 3 = 0"), F.array(F.lit("reader"), F.lit(" Admin "), F.lit("reader"), F.lit("owner"))).otherwise(F.array(F.lit("curator")))).alias("role"))
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("requested_at"))
    return accounts.list_users(users, roles, requests).select("id", "username", "user_status", F.array_join("roles", ",").alias("roles"), F.col("removal_request.status").alias("last_request"))


@query(f"WITH {_USERS} SELECT o_orderkey AS token_hash, u.username FROM orders JOIN u ON u.id = o_custkey WHERE is_active AND o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1996-01-01'")
def l_live_sessions(spark, d):
    """Orders as sessions: open ones of active accounts."""
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").cast("long").alias("user_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"), F.col("o_orderdate").alias("expires_at"))
    return accounts.live_sessions(s, _users(spark, d), F.lit("1996-01-01").cast("timestamp")).select("token_hash", "username")


# -- extension points ------------------------------------------------------------------


@query("SELECT doc_id // 50 AS archive, 'd' || (doc_id // 50) || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size_bytes, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def k_archive_entries(spark, d):
    """Members of packed documents by the table function, in SQL."""
    tables.register(spark)
    _packed(spark, d, 50, _zip, ".zip").createOrReplaceTempView("packed_documents")
    return spark.sql("select p.id as archive, e.path, e.size_bytes, e.sha1 from packed_documents p, lateral archive_entries(p.payload, p.name) e")


@query(f"WITH {c._IMPORT} SELECT (SELECT count(*) FROM s WHERE status = 'created') AS created, (SELECT count(*) FROM s WHERE status = 'error') AS errors, 0::BIGINT AS again")
def k_store_target(spark, d):
    """All observations put into a store that has the files, then once more: nothing is new."""
    kept = Store(spark, f"{Scratch(spark).root}/target")
    kept.write("files", table(spark, d, "ufid_file").select("id", "size_bytes", "crc32", "md5", "sha1", "sha256", "blake3"))
    target = targets.StoreTarget(spark, kept, F.lit("2030-01-01").cast("timestamp"))
    none = F.lit(None).cast("string")
    entries = scalars.metadata_entries(F.col("display_name"), none, none, F.lit(None).cast(ingest.ENTRIES))
    observed = c._observed(spark, d)
    first, second = target.upsert(observed, entries), target.upsert(observed, entries)
    n = first.agg(F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "error").alias("errors"))
    return n.crossJoin(F.broadcast(second.agg(F.count_if(F.col("status").isin("created", "enriched")).alias("again"))))
