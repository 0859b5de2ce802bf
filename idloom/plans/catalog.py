"""Queries of the file-identity operators over the tables, with equal SQL.

Names begin with the operator's number in the inventory. Watch lists are made
from all observations: each is an alert of the user ``obs_id % 5``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import scalars
from idloom.functions.hashes import WHITE
from idloom.operators import alerts as al
from idloom.operators import containment, identity, provenance, search
from idloom.session import Scratch, table
from idloom.sources import archives, crawl_source, dat, hashing
from idloom.streaming import crawl

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WS = "'" + "".join(WHITE).replace("'", "''") + "'"
_CLEAN = ", ".join(f"nullif(lower(trim({c}, {_WS})), '') AS {c}" for c in ("crc32", "md5", "sha1"))
_OBS = f"o AS (SELECT obs_id, display_name, size_bytes, {_CLEAN}, source FROM file_observation)"
_OK = "size_bytes >= 0 AND coalesce(regexp_full_match(crc32, '[0-9a-f]{8}') AND regexp_full_match(md5, '[0-9a-f]{32}') AND regexp_full_match(sha1, '[0-9a-f]{40}'), false)"
_FILE_KEYS = "k AS (SELECT size_bytes, crc32, md5, sha1, min(id) AS file_id FROM ufid_file GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned observations, written once: lookups read them several times."""
    return Scratch(spark).save(identity.cleaned(table(spark, d, "file_observation")), "observed")


# -- A: sources --------------------------------------------------------------------


@query("SELECT doc_id, strlen(text)::BIGINT AS size_bytes, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def a3_text_hashes(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), *hashing.column_hashes(F.col("text"), ("md5", "sha1", "sha256")))


_BYTES = "list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT))"
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i))"


@query(f"WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab), b AS (SELECT doc_id, {_BYTES} AS bytes FROM documents) SELECT doc_id, printf('%08x', xor(list_reduce(bytes, lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]), 4294967295), 4294967295)) AS crc32 FROM b, t")
def a3_text_crc32(spark, d):
    return table(spark, d, "documents").select("doc_id", *hashing.column_hashes(F.col("text"), ("crc32",)))


@query("SELECT 'set ' || (id // 1000) AS name, 'file ' || id AS source_detail, size_bytes, crc32, md5, sha1, sha256 FROM ufid_file")
def a7_xml_catalogues(spark, d):
    """All files written as XML catalogues of a thousand rows and read again."""
    row = F.format_string('<rom name="file %d" size="%d" crc="%s" md5="%s" sha1="%s"%s/>', "id", "size_bytes", "crc32", "md5", "sha1", F.coalesce(F.concat(F.lit(' sha256="'), "sha256", F.lit('"')), F.lit("")))
    sets = table(spark, d, "ufid_file").select(F.expr("id div 1000").alias("s"), row.alias("r")).groupBy("s").agg(F.concat_ws("", F.collect_list("r")).alias("rows"))
    text = F.concat(F.lit('<?xml version="1.0"?><datafile><header><name>all</name></header><game name="set '), F.col("s").cast("string"), F.lit('">'), "rows", F.lit("</game></datafile>"))
    rows = dat.dat_rows(sets.select(text.alias("text"), F.concat(F.lit("f"), F.col("s").cast("string")).alias("filename")))
    return rows.select("name", "source_detail", F.col("size_bytes").cast("long").alias("size_bytes"), "crc32", "md5", "sha1", "sha256")


@query("SELECT 'set (' || (id // 1000) || ')' AS name, 'a\"b (' || id || ').bin' AS source_detail, size_bytes, crc32, md5, sha1 FROM ufid_file")
def a8_classic_catalogues(spark, d):
    """The same in the classic form, with quotes and parentheses in names."""
    row = F.format_string('rom ( name "a\\"b (%d).bin" size %d crc %s md5 %s sha1 %s )', "id", "size_bytes", "crc32", "md5", "sha1")
    sets = table(spark, d, "ufid_file").select(F.expr("id div 1000").alias("s"), row.alias("r")).groupBy("s").agg(F.concat_ws("\n", F.collect_list("r")).alias("rows"))
    text = F.concat(F.lit('clrmamepro (\n name "all"\n)\ngame (\n name "set ('), F.col("s").cast("string"), F.lit(')"\n'), "rows", F.lit("\n)\n"))
    rows = dat.dat_rows(sets.select(text.alias("text"), F.lit("f").alias("filename")))
    return rows.select("name", "source_detail", F.col("size_bytes").cast("long").alias("size_bytes"), "crc32", "md5", "sha1")


@query("SELECT 'd' || (doc_id // 50) || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size_bytes, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def a10_zipped_documents(spark, d):
    """All documents packed into ZIP archives of fifty and read back, hashed."""
    from collections.abc import Iterator

    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for b in batches:
            for s, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    for x in docs:
                        z.writestr(f"d{s}/{x['doc_id']}.txt", x["text"])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([buf.getvalue()], pa.binary()), pa.array(["x.zip"])], names=["id", "payload", "name"])

    groups = table(spark, d, "documents").where("text is not null").groupBy(F.expr("doc_id div 50").alias("id")).agg(F.collect_list(F.struct("doc_id", "text")).alias("docs"))
    packed = groups.mapInArrow(pack, "id long, payload binary, name string")
    return archives.archive_members(packed).select("path", "size_bytes", "md5", "sha1")


_RECORD = "r AS (SELECT identifier, try_cast(metadata_json AS JSON) AS j FROM ia_ingest_item)"
_TRUE_NAME = "CASE json_type(f, '$.name') WHEN 'VARCHAR' THEN f ->> '$.name' <> '' WHEN 'NULL' THEN false ELSE f ->> '$.name' NOT IN ('0', '0.0', 'false') END"


@query(
    f"""WITH {_RECORD}, e AS (SELECT identifier, unnest(json_extract(j, '$.files[*]')) AS f FROM r WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.files') = 'ARRAY')
 SELECT identifier, f ->> '$.name' AS name, nullif(f ->> '$.source', '') AS source, nullif(f ->> '$.format', '') AS format, try_cast(trim(f ->> '$.size') AS BIGINT) AS size_bytes, """
    + ", ".join(f"nullif(lower(trim(f ->> '$.{h}', {_WS})), '') AS {h}" for h in ("md5", "sha1", "crc32"))
    + f", try_cast(trim(f ->> '$.mtime') AS BIGINT) AS mtime FROM e WHERE json_type(f) = 'OBJECT' AND {_TRUE_NAME}"
)
def a20_item_files(spark, d):
    return crawl_source.item_files(table(spark, d, "ia_ingest_item")).drop("raw")


@query(
    f"""WITH {_RECORD}, c AS (SELECT identifier, j -> '$.metadata.collection' AS c FROM r WHERE json_type(j) = 'OBJECT')
 SELECT DISTINCT identifier, x ->> '$' AS collection FROM (SELECT identifier, unnest(CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END) AS x, json_type(c) AS t FROM c) WHERE x ->> '$' IS NOT NULL AND (t <> 'ARRAY' OR x ->> '$' NOT IN ('', '0', 'false'))"""
)
def a20_collections(spark, d):
    return crawl_source.collections(table(spark, d, "ia_ingest_item")).distinct()


# -- B, C, D, F: lookups, joins, aggregates, pages ----------------------------------


_TOP_MD5 = "(SELECT md5 FROM ufid_file GROUP BY md5 ORDER BY count(*) DESC, md5 LIMIT 1)"


def _top_md5(spark: SparkSession, d: str) -> str:
    n = F.count(F.lit(1))
    return table(spark, d, "ufid_file").groupBy("md5").agg(n.alias("n")).orderBy(F.col("n").desc(), "md5").first()[0]


@query(f"SELECT id, size_bytes, md5 FROM ufid_file WHERE md5 = {_TOP_MD5}")
def b1_files_by_hash(spark, d):
    """The files of the md5 that most files have."""
    return search.files_by_hash(table(spark, d, "ufid_file"), "MD5", _top_md5(spark, d).upper()).select("id", "size_bytes", "md5")


@query(f"SELECT max(id) AS id FROM ufid_file WHERE md5 = {_TOP_MD5}")
def b2_newest_by_hash(spark, d):
    return search.newest_by_hash(table(spark, d, "ufid_file"), "md5", _top_md5(spark, d)).select("id")


@query(f"WITH {_OBS} SELECT o.obs_id, count(f.id) AS n_files, max(f.id) AS newest_id FROM o JOIN ufid_file f ON f.sha1 = o.sha1 GROUP BY o.obs_id")
def b1_observed_sha1(spark, d):
    """For each observation all files with its sha1: how many, and the newest."""
    obs = identity.cleaned(table(spark, d, "file_observation")).select(F.col("seq").alias("obs_id"), "sha1")
    return search.count_by_hash(obs, table(spark, d, "ufid_file"), "sha1").select("obs_id", "n_files", "newest_id")


@query(
    f"""WITH {_OBS}, p AS (SELECT obs_id, 3 AS rank, 'sha1' AS algorithm, sha1 AS value FROM o UNION ALL SELECT obs_id, 4, 'md5', md5 FROM o UNION ALL SELECT obs_id, 5, 'crc32', crc32 FROM o),
 f AS (SELECT 'sha1' AS algorithm, sha1 AS value, max(id) AS file_id FROM ufid_file GROUP BY ALL UNION ALL SELECT 'md5', md5, max(id) FROM ufid_file GROUP BY ALL UNION ALL SELECT 'crc32', crc32, max(id) FROM ufid_file GROUP BY ALL)
 SELECT obs_id, arg_min(algorithm, rank) AS algorithm, arg_min(file_id, rank) AS file_id FROM p JOIN f USING (algorithm, value) GROUP BY obs_id"""
)
def b3_lookup(spark, d):
    obs = _observed(spark, d).select(F.col("seq").alias("obs_id"), "crc32", "md5", "sha1")
    return search.lookup_hashes(obs, table(spark, d, "ufid_file"), "obs_id")


_FIRST = "arg_min(value, (added_at, id)) FILTER (name = '{n}' AND value IS NOT NULL)"
_DERIVED = "SELECT file_id, " + ", ".join(f"arg_min(value, (added_at, id)) FILTER (name = '{n}') AS {n}" for n in ("filename", "description", "content_type", "filetype")) + " FROM ufid_file_meta WHERE name IN ('filename', 'description', 'content_type', 'filetype') GROUP BY file_id"


@query(
    f"""WITH v AS ({_DERIVED}), m AS (SELECT file_id, count(*) AS n FROM ufid_file_meta GROUP BY 1), a AS (SELECT parent_file_id, count(*) AS n FROM ufid_archive_member GROUP BY 1)
 SELECT f.id, f.size_bytes, v.filename AS display_name, v.description, coalesce(nullif(v.content_type, ''), v.filetype) AS content_type, coalesce(m.n, 0) AS n_metadata, coalesce(a.n, 0) AS n_members
 FROM ufid_file f LEFT JOIN v ON v.file_id = f.id LEFT JOIN m ON m.file_id = f.id LEFT JOIN a ON a.parent_file_id = f.id"""
)
def b4_file_records(spark, d):
    return search.file_records(*_t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")).select("id", "size_bytes", "display_name", "description", "content_type", "n_metadata", "n_members")


_LIKE = " OR ".join
_SEARCH = """SELECT id FROM ufid_file f WHERE id::VARCHAR ILIKE {q} OR size_bytes::VARCHAR ILIKE {q} OR crc32 ILIKE {q} OR md5 ILIKE {q} OR sha1 ILIKE {q} OR sha256 ILIKE {q} OR blake3 ILIKE {q}
 OR id IN (SELECT file_id FROM ufid_file_meta WHERE metadata_type ILIKE {q} OR name ILIKE {q} OR value ILIKE {q} OR notes ILIKE {q})
 OR id IN (SELECT parent_file_id FROM ufid_archive_member WHERE archive_path ILIKE {q})"""


@query(_SEARCH.format(q="'%manual_7%'"))
def b7_search(spark, d):
    """The wildcard in the query is live."""
    f, m, a = _t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")
    return search.search_files(f, m, a, "manual_7").select("id")


@query(f"SELECT count(*) AS n FROM ({_SEARCH.format(q=chr(39) + '%scan%' + chr(39))})")
def d1_count_files(spark, d):
    f, m, a = _t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")
    return search.search_files(f, m, a, "scan").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_OBS}, {_FILE_KEYS} SELECT obs_id, file_id FROM o LEFT JOIN k USING (size_bytes, crc32, md5, sha1) WHERE {_OK}")
def c1_probe(spark, d):
    good = _observed(spark, d).where("error is null").select(F.col("seq").alias("obs_id"), *identity.KEY)
    return identity.probe(good, table(spark, d, "ufid_file")).select("obs_id", "file_id")


@query(
    f"""WITH {_FILE_KEYS}, e AS (SELECT size_bytes, file_id, 'crc32' AS algorithm, crc32 AS value FROM k UNION ALL SELECT size_bytes, file_id, 'md5', md5 FROM k UNION ALL SELECT size_bytes, file_id, 'sha1', sha1 FROM k),
 g AS (SELECT size_bytes, algorithm, value, min(file_id) AS first_file_id, count(*) AS n_files FROM e GROUP BY ALL HAVING count(*) > 1) SELECT size_bytes, algorithm, value, file_id, first_file_id, n_files FROM e JOIN g USING (size_bytes, algorithm, value)"""
)
def c2_overlaps(spark, d):
    return identity.overlap_classes(table(spark, d, "ufid_file"))


def _alerts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, links): every observation with a usable hash as an alert."""
    obs = _observed(spark, d)
    ok = {a: F.when(scalars.is_hex(F.col(a), n), F.col(a)) for a, n in (("crc32", 8), ("md5", 32), ("sha1", 40))}
    a = obs.select(F.col("seq").alias("id"), F.coalesce("display_name", F.lit("?")).alias("name"), F.coalesce("source", F.lit("?")).alias("description"), F.when(F.col("size_bytes") >= 0, F.col("size_bytes")).alias("size_bytes"), *[c.alias(n) for n, c in ok.items()], F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("blake3"), F.when(F.col("source").isNotNull(), "observation").alias("source_type"), F.col("source").alias("source_name"), F.lit(None).cast("string").alias("source_detail"))
    a = a.where("coalesce(crc32, md5, sha1) is not null")
    return a, a.select(F.pmod("id", F.lit(5)).alias("user_id"), F.col("id").alias("alert_id"))


_HEX = ", ".join(f"CASE WHEN regexp_full_match({c}, '[0-9a-f]{{{n}}}') THEN {c} END AS {c}" for c, n in (("crc32", 8), ("md5", 32), ("sha1", 40)))
_ALERTS = f"{_OBS}, a AS (SELECT * FROM (SELECT obs_id AS id, CASE WHEN size_bytes >= 0 THEN size_bytes END AS size_bytes, {_HEX}, source FROM o) WHERE coalesce(crc32, md5, sha1) IS NOT NULL)"
_MATCH = (
    _ALERTS
    + ", p AS ("
    + " UNION ALL ".join(f"SELECT a.id AS alert_id, f.id AS file_id, '{h}' AS algorithm, (a.size_bytes IS NOT NULL)::INT AS sized FROM a JOIN ufid_file f ON f.{h} = a.{h} AND (a.size_bytes IS NULL OR a.size_bytes = f.size_bytes)" for h in ("crc32", "md5", "sha1"))
    + "), m AS (SELECT alert_id, file_id, max((algorithm = 'crc32')::INT) AS matched_crc32, max((algorithm = 'md5')::INT) AS matched_md5, max((algorithm = 'sha1')::INT) AS matched_sha1, max(sized) AS size_matched FROM p GROUP BY ALL)"
)


@query(f"WITH {_MATCH} SELECT * FROM m")
def c4_matches(spark, d):
    a, _ = _alerts(spark, d)
    return al.matches(a, table(spark, d, "ufid_file")).drop("matched_sha256", "matched_blake3")


@query(f"WITH {_MATCH} SELECT alert_id % 5 AS user_id, count(*) AS matched, count(*) FILTER (f.sha256 IS NULL) AS created FROM m JOIN ufid_file f ON f.id = m.file_id GROUP BY 1")
def h11_scan_report(spark, d):
    """A scan after one that was made when only the files with sha256 were known."""
    a, links = _alerts(spark, d)
    files, now = table(spark, d, "ufid_file"), F.lit("2030-01-01 00:00:00").cast("timestamp")
    old, _ = al.scan(a, links, files.where("sha256 is not null"), _no_matches(spark), F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return al.scan(a, links, files, old, now)[1]


def _no_matches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "user_id long, alert_id long, file_id long, " + ", ".join(f"matched_{h} int" for h in scalars.ALGORITHMS) + ", size_matched int, found_at timestamp")


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, links = _alerts(spark, d)
    found, _ = al.scan(a, links, table(spark, d, "ufid_file"), _no_matches(spark), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return a, links, Scratch(spark).save(found, "matches")


_KEYED = "CASE WHEN source IS NULL OR source = '' THEN CASE WHEN source IS NULL THEN 'manual' ELSE 'observation|' END ELSE 'observation|' || source END"


@query(
    f"""WITH {_MATCH}, h AS (SELECT alert_id, count(*) AS n FROM m GROUP BY 1)
 SELECT a.id % 5 AS user_id, {_KEYED} AS source_key, CASE WHEN source IS NULL THEN 'Manual' ELSE coalesce(nullif(source, ''), 'observation') END AS label, count(*) AS alert_count, coalesce(sum(h.n), 0)::BIGINT AS hit_count
 FROM a LEFT JOIN h ON h.alert_id = a.id GROUP BY ALL"""
)
def d5_alert_sources(spark, d):
    a, links, stored = _stored(spark, d)
    return al.alert_sources(a, links, stored)


_UP = "up AS (SELECT DISTINCT child_file_id AS c, parent_file_id AS p FROM ufid_archive_member WHERE child_file_id IS NOT NULL AND parent_file_id IS NOT NULL)"
_ANC = _UP + ", x(file_id, ancestor_id, depth) AS (SELECT id, id, 0 FROM ufid_file UNION SELECT x.file_id, up.p, depth + 1 FROM x JOIN up ON up.c = x.ancestor_id WHERE depth < 128)"
_SOURCE = f"""src AS (SELECT DISTINCT file_id, trim(value, {_WS}) AS source_value FROM ufid_file_meta WHERE name = 'source' AND trim(value, {_WS}) <> ''),
 ref AS (SELECT file_id, """ + ", ".join(f"arg_min(value, (added_at, id)) FILTER (name = '{n}') AS {n}" for n in provenance.REFERENCES) + " FROM ufid_file_meta WHERE name IN ('ia_file_url', 'ia_item_url', 'dat_filename') GROUP BY file_id)"


@query(f"WITH RECURSIVE {_ANC} SELECT file_id, ancestor_id, depth FROM x")
def c13_ancestors(spark, d):
    f, m = _t(spark, d, "ufid_file", "ufid_archive_member")
    return provenance.ancestors(f, m)


@query(
    f"""WITH RECURSIVE {_ANC}, v AS (SELECT file_id, """
    + ", ".join(f"arg_min(value, (added_at, id)) FILTER (name = '{n}') AS {n}" for n in provenance.RECORD_FIELDS)
    + """ FROM ufid_file_meta WHERE name IN ("""
    + ", ".join(f"'{n}'" for n in provenance.RECORD_FIELDS)
    + """) GROUP BY file_id), g AS (SELECT x.*, v.* EXCLUDE (file_id), row_number() OVER (PARTITION BY x.file_id ORDER BY depth DESC, x.ancestor_id) AS r FROM x JOIN v ON v.file_id = x.ancestor_id WHERE ia_identifier IS NOT NULL OR ia_item_url IS NOT NULL)
 SELECT file_id, ancestor_id AS source_file_id, """
    + ", ".join(provenance.RECORD_FIELDS)
    + " FROM g WHERE r = 1"
)
def e1_record_origin(spark, d):
    return provenance.record_origin(*_t(spark, d, "ufid_file", "ufid_archive_member", "ufid_file_meta"))


@query(
    f"""WITH RECURSIVE {_ANC}, {_SOURCE}, g AS (SELECT x.file_id, x.ancestor_id, source_value, coalesce(ia_file_url, ia_item_url, dat_filename, '') AS external_reference, row_number() OVER (PARTITION BY x.file_id ORDER BY depth DESC, source_value, x.ancestor_id) AS r
 FROM x JOIN src ON src.file_id = x.ancestor_id LEFT JOIN ref ON ref.file_id = x.ancestor_id) SELECT file_id, ancestor_id AS source_file_id, source_value, external_reference FROM g WHERE r = 1"""
)
def e2_top_source(spark, d):
    return provenance.top_source(*_t(spark, d, "ufid_file", "ufid_archive_member", "ufid_file_meta"))


@query(f"WITH {_SOURCE} SELECT file_id, source_value, coalesce(ia_file_url, ia_item_url, dat_filename, '') AS external_reference FROM src LEFT JOIN ref USING (file_id)")
def e3_source_rows(spark, d):
    return provenance.source_rows(table(spark, d, "ufid_file_meta"))


@query(
    f"""WITH RECURSIVE {_MATCH}, {_UP}, x(file_id, ancestor_id) AS (SELECT DISTINCT file_id, file_id FROM m UNION SELECT x.file_id, up.p FROM x JOIN up ON up.c = x.ancestor_id), {_SOURCE},
 s AS (SELECT DISTINCT x.file_id, source_value FROM x JOIN src ON src.file_id = x.ancestor_id) SELECT alert_id % 5 AS user_id, source_value, count(*) AS hit_count FROM m JOIN s USING (file_id) GROUP BY ALL"""
)
def d6_file_source_hits(spark, d):
    _, _, stored = _stored(spark, d)
    return al.file_source_hits(stored, *_t(spark, d, "ufid_archive_member", "ufid_file_meta"))


@query("SELECT 'item' AS kind, status, count(*) AS n FROM ia_ingest_item GROUP BY ALL UNION ALL SELECT 'file', status, count(*) FROM ia_ingest_file GROUP BY ALL")
def d7_status_counts(spark, d):
    i, f = _t(spark, d, "ia_ingest_item", "ia_ingest_file")
    return crawl.status_counts(i).withColumn("kind", F.lit("item")).unionByName(crawl.status_counts(f).withColumn("kind", F.lit("file")))


@query("SELECT id, size_bytes FROM ufid_file ORDER BY size_bytes DESC, id DESC LIMIT 200 OFFSET 200")
def f1_page_by_size(spark, d):
    f, m, a = _t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")
    return search.list_files(f, m, a, 200, 200, None, "size", "desc").select("id", "size_bytes")


@query("SELECT id, sha256 FROM ufid_file ORDER BY coalesce(sha256, ''), id DESC LIMIT 200")
def f2_page_by_optional_hash(spark, d):
    f, m, a = _t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")
    return search.list_files(f, m, a, 10_000, 0, None, "sha256", "asc").select("id", "sha256")


# -- G, H: sets and maintenance -----------------------------------------------------

_PATHS = """r AS (SELECT parent_file_id, child_file_id, CASE WHEN trim(replace(archive_path, '\\', '/'), '/') = '' THEN archive_path ELSE trim(replace(archive_path, '\\', '/'), '/') END AS path FROM ufid_archive_member WHERE archive_path IS NOT NULL AND parent_file_id IS NOT NULL)"""


@query(
    f"""WITH {_PATHS}, b AS (SELECT parent_file_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM r WHERE child_file_id IS NOT NULL),
 u AS (SELECT DISTINCT parent_file_id, array_to_string(parts[1:i], '/') AS directory FROM (SELECT parent_file_id, parts, unnest(range(1, len(parts))) AS i FROM b WHERE len(parts) > 1))
 SELECT DISTINCT parent_file_id, path AS directory FROM r WHERE child_file_id IS NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.parent_file_id = r.parent_file_id AND u.directory = r.path)"""
)
def g4_empty_directories(spark, d):
    return containment.empty_directories(table(spark, d, "ufid_archive_member"))


_IMPORT = f"""{_OBS}, {_FILE_KEYS}, g AS (SELECT o.*, k.file_id, min(obs_id) OVER (PARTITION BY o.size_bytes, o.crc32, o.md5, o.sha1) AS first_id FROM o LEFT JOIN k USING (size_bytes, crc32, md5, sha1) WHERE {_OK.replace('size_bytes', 'o.size_bytes', 1)}),
 e AS (SELECT obs_id, size_bytes, crc32, md5, sha1, file_id, 'filename' AS name, display_name AS value FROM g WHERE display_name <> '' UNION ALL SELECT obs_id, size_bytes, crc32, md5, sha1, file_id, 'source', source FROM g WHERE source IS NOT NULL),
 n AS (SELECT min(obs_id) AS obs_id FROM e WHERE NOT EXISTS (SELECT 1 FROM ufid_file_meta m WHERE m.file_id = e.file_id AND m.metadata_type = 'text' AND m.name = e.name AND m.value = e.value AND coalesce(m.notes, '') = '') GROUP BY size_bytes, crc32, md5, sha1, name, value),
 s AS (SELECT obs_id, CASE WHEN file_id IS NULL AND obs_id = first_id THEN 'created' WHEN obs_id IN (SELECT obs_id FROM n) THEN 'enriched' ELSE 'unchanged' END AS status FROM g UNION ALL SELECT obs_id, 'error' FROM o WHERE NOT coalesce({_OK}, false))"""


def _import(spark: SparkSession, d: str) -> identity.Imported:
    source = F.when(F.col("source").isNotNull(), F.array(F.struct(F.lit("text").alias("metadata_type"), F.lit("source").alias("name"), F.col("source").alias("value"), F.lit(None).cast("string").alias("notes"))))
    none = F.lit(None).cast("string")
    entries = scalars.metadata_entries(F.col("display_name"), none, none, source)
    return identity.consolidate(*_t(spark, d, "ufid_file", "ufid_file_meta"), _observed(spark, d), entries)


@query(f"WITH {_IMPORT} SELECT obs_id, status FROM s")
def h1_import(spark, d):
    return _import(spark, d).report.select(F.col("seq").alias("obs_id"), "status")


@query(f"WITH {_IMPORT} SELECT count(*) AS received, count(*) FILTER (status <> 'error') AS valid, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'enriched') AS enriched, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'error') AS errors FROM s")
def d8_import_report(spark, d):
    s = F.col("status")
    return _import(spark, d).report.agg(F.count(F.lit(1)).alias("received"), F.count_if(s != "error").alias("valid"), *[F.count_if(s == x).alias(n) for x, n in (("created", "created"), ("enriched", "enriched"), ("unchanged", "unchanged"), ("error", "errors"))])


@query(
    f"""WITH {_OBS}, {_FILE_KEYS}, g AS (SELECT size_bytes, crc32, md5, sha1, min(obs_id) AS first_id FROM o WHERE {_OK} GROUP BY ALL), c AS (SELECT g.* FROM g ANTI JOIN k USING (size_bytes, crc32, md5, sha1))
 SELECT id, size_bytes, crc32, md5, sha1 FROM ufid_file UNION ALL SELECT (SELECT max(id) FROM ufid_file) + row_number() OVER (ORDER BY first_id), size_bytes, crc32, md5, sha1 FROM c"""
)
def h1_files_after_import(spark, d):
    return _import(spark, d).files.select("id", *identity.KEY)


@query(
    f"""WITH {_OBS}, {_FILE_KEYS}, n AS (SELECT DISTINCT k.file_id, 'text' AS metadata_type, 'filename' AS name, display_name AS value FROM o JOIN k USING (size_bytes, crc32, md5, sha1) WHERE {_OK} AND display_name <> '')
 SELECT file_id, metadata_type, name, value FROM n WHERE NOT EXISTS (SELECT 1 FROM ufid_file_meta m WHERE m.file_id = n.file_id AND m.metadata_type = n.metadata_type AND m.name = n.name AND m.value = n.value AND coalesce(m.notes, '') = '')"""
)
def h4_new_metadata(spark, d):
    good = _observed(spark, d).where("error is null and display_name <> ''")
    rows = identity.probe(good, table(spark, d, "ufid_file")).where("file_id is not null").select("file_id", F.lit("text").alias("metadata_type"), F.lit("filename").alias("name"), F.col("display_name").alias("value"), F.lit("").alias("notes"))
    stored = table(spark, d, "ufid_file_meta").withColumn("notes", F.coalesce("notes", F.lit("")))
    return identity.append_missing(stored, rows, ["file_id", "metadata_type", "name", "value", "notes"]).select("file_id", "metadata_type", "name", "value")


@query(
    """WITH n AS (SELECT DISTINCT child_file_id AS parent_file_id, parent_file_id AS child_file_id, archive_path FROM ufid_archive_member WHERE child_file_id IS NOT NULL AND (parent_file_id IS NOT NULL OR archive_path <> ''))
 SELECT parent_file_id, child_file_id, archive_path FROM n WHERE NOT EXISTS (SELECT 1 FROM ufid_archive_member m WHERE m.parent_file_id IS NOT DISTINCT FROM n.parent_file_id AND m.child_file_id IS NOT DISTINCT FROM n.child_file_id AND m.archive_path IS NOT DISTINCT FROM n.archive_path)"""
)
def h6_new_members(spark, d):
    """All edges turned round, as members to add."""
    m = table(spark, d, "ufid_archive_member")
    turned = m.select(F.col("child_file_id").alias("parent_file_id"), F.col("parent_file_id").alias("child_file_id"), "archive_path")
    return containment.add_members(m, turned).select("parent_file_id", "child_file_id", "archive_path")


@query(
    f"""WITH {_OBS}, w AS (SELECT obs_id % 5 AS user_id, nullif(trim(display_name, {_WS}), '') AS name, nullif(trim(source, {_WS}), '') AS description, CASE WHEN size_bytes >= 0 THEN size_bytes END AS size_bytes, crc32, md5, sha1 FROM o),
 v AS (SELECT *, coalesce(crc32, md5, sha1) IS NOT NULL AND coalesce(regexp_full_match(crc32, '[0-9a-f]{{8}}'), true) AND coalesce(regexp_full_match(md5, '[0-9a-f]{{32}}'), true) AND coalesce(regexp_full_match(sha1, '[0-9a-f]{{40}}'), true) AND name IS NOT NULL AND description IS NOT NULL AS ok FROM w)
 SELECT user_id, count(*) AS received, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS errors, count(DISTINCT (name, description, size_bytes, crc32, md5, sha1)) FILTER (ok) AS created, count(*) FILTER (ok) - count(DISTINCT (name, description, size_bytes, crc32, md5, sha1)) FILTER (ok) AS skipped FROM v GROUP BY user_id"""
)
def h9_alert_import(spark, d):
    obs = table(spark, d, "file_observation").select(F.pmod("obs_id", F.lit(5)).alias("user_id"), F.col("display_name").alias("name"), F.col("source").alias("description"), "size_bytes", "crc32", "md5", "sha1")
    none = spark.createDataFrame([], "id long, fingerprint string, " + ", ".join(f"{c} {'long' if c == 'size_bytes' else 'string'}" for c in al.FIELDS))
    return al.import_alerts(none, spark.createDataFrame([], "user_id long, alert_id long"), al.normalized(obs))[2]


@query(f"WITH {_MATCH}, l AS (SELECT id FROM a WHERE id % 5 NOT IN (0, 3)) SELECT (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM l) AS alerts, (SELECT count(*) FROM m WHERE alert_id % 5 NOT IN (0, 3)) AS matches")
def h10_clear(spark, d):
    a, links, stored = _stored(spark, d)
    users = spark.createDataFrame([(0,), (3,)], "user_id long")
    left = al.clear(a, links, stored, users)
    n = [x.agg(F.count(F.lit(1)).alias("n")).first()[0] for x in left]
    return spark.createDataFrame([(n[1], n[0], n[2])], "links long, alerts long, matches long")


@query(
    """WITH gone AS (SELECT id FROM ufid_file WHERE sha256 IS NULL) SELECT 'meta' AS name, count(*) AS n FROM ufid_file_meta WHERE file_id NOT IN (SELECT id FROM gone) OR file_id IS NULL
 UNION ALL SELECT 'member', count(*) FROM ufid_archive_member WHERE (parent_file_id IS NULL OR parent_file_id NOT IN (SELECT id FROM gone)) AND (child_file_id IS NULL OR child_file_id NOT IN (SELECT id FROM gone))"""
)
def h18_cascade(spark, d):
    """What is left of the dependants after the files without sha256 are deleted."""
    f, m, a = _t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")
    left = identity.drop_cascade(f.where("sha256 is null"), "id", {"meta": (m, ["file_id"]), "member": (a, ["parent_file_id", "child_file_id"])})
    return left["meta"].agg(F.lit("meta").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(left["member"].agg(F.lit("member").alias("name"), F.count(F.lit(1)).alias("n")))


# -- I: scalar functions --------------------------------------------------------------


@query(
    f"""WITH {_OBS} SELECT obs_id, CASE WHEN crc32 IS NULL OR md5 IS NULL OR sha1 IS NULL THEN 'Required hashes are missing: ' || array_to_string(list_filter([CASE WHEN crc32 IS NULL THEN 'crc32' END, CASE WHEN md5 IS NULL THEN 'md5' END, CASE WHEN sha1 IS NULL THEN 'sha1' END], lambda x: x IS NOT NULL), ', ')
 WHEN size_bytes IS NULL THEN 'Exact file size is required' WHEN size_bytes < 0 THEN 'Exact file size must be a non-negative integer' """
    + " ".join(f"WHEN length({a}) <> {n} THEN '{a} must be exactly {n} hexadecimal characters' WHEN NOT regexp_full_match({a}, '[0-9a-f]+') THEN '{a} must contain only hexadecimal characters'" for a, n in (("crc32", 8), ("md5", 32), ("sha1", 40)))
    + " END AS error FROM o"
)
def i2_identity_errors(spark, d):
    return identity.cleaned(table(spark, d, "file_observation")).select(F.col("seq").alias("obs_id"), "error")


_M = "WITH p AS (SELECT id, CASE WHEN trim(replace(archive_path, '\\', '/'), '/') = '' THEN archive_path ELSE trim(replace(archive_path, '\\', '/'), '/') END AS path FROM ufid_archive_member WHERE archive_path IS NOT NULL)"


@query(_M + ", q AS (SELECT id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p) SELECT id, path, len(parts) - 1 AS n_parents, CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '/') END AS parent FROM q WHERE len(parts) > 0")
def i15_paths(spark, d):
    m = table(spark, d, "ufid_archive_member").where("archive_path is not null").select("id", scalars.archive_path(F.col("archive_path")).alias("path"))
    up = scalars.parent_directories(F.col("path"))
    return m.where(F.regexp_replace("path", "/", "") != "").select("id", "path", F.size(up).cast("long").alias("n_parents"), F.try_element_at(up, F.lit(-1)).alias("parent"))


_SUFFIX = "CASE WHEN lower(name) LIKE '%.cdx.gz' OR lower(name) LIKE '%.warc.gz' THEN '' " + " ".join(f"WHEN lower(name) LIKE '%{s}' THEN '{s}'" for s in sorted(scalars.COMPOUND_SUFFIXES, key=len, reverse=True)) + " ELSE regexp_extract(regexp_extract(regexp_replace(name, '/+$', ''), '([^/]*)$', 1), '^\\.*[^.].*?(\\.[^.]+)$', 1) END"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"SELECT DISTINCT name, {_SUFFIX} AS suffix, {_SUFFIX} IN {_IN(scalars.CONTAINER_SUFFIXES + scalars.OTHER_SUFFIXES + scalars.SINGLE_SUFFIXES)} AS is_archive, {_SUFFIX} IN {_IN(scalars.CONTAINER_SUFFIXES)} AS is_container FROM ia_ingest_file WHERE name IS NOT NULL")
def i16_suffixes(spark, d):
    n = F.col("name")
    return table(spark, d, "ia_ingest_file").where("name is not null").select("name", scalars.archive_suffix(n).alias("suffix"), scalars.is_archive_name(n).alias("is_archive"), scalars.is_container_name(n).alias("is_container")).distinct()


_BAD = ", ".join(f"CASE WHEN NOT coalesce(regexp_full_match(lower(trim({a}, {_WS})), '[0-9a-f]{{{n}}}'), false) THEN '{a}' END" for a, n in (("crc32", 8), ("md5", 32), ("sha1", 40)))


@query(f"SELECT item_identifier, name, epoch_us(updated_at) AS updated_us, array_to_string(list_filter([CASE WHEN NOT coalesce(size_bytes >= 0, false) THEN 'size' END, {_BAD}], lambda x: x IS NOT NULL), ',') AS missing FROM ia_ingest_file")
def i19_missing_identity(spark, d):
    return crawl.declared_identity(table(spark, d, "ia_ingest_file")).select("item_identifier", "name", F.unix_micros("updated_at").alias("updated_us"), F.array_join("missing", ",").alias("missing"))


@query("SELECT item_identifier, name, epoch_us(updated_at) AS updated_us, len(CASE WHEN json_valid(identity_metadata_missing) AND json_type(identity_metadata_missing) = 'ARRAY' THEN from_json(identity_metadata_missing, '[\"VARCHAR\"]') ELSE [] END)::BIGINT AS n_missing FROM ia_ingest_file")
def i28_json_lists(spark, d):
    return table(spark, d, "ia_ingest_file").select("item_identifier", "name", F.unix_micros("updated_at").alias("updated_us"), F.size(scalars.json_list(F.col("identity_metadata_missing"))).cast("long").alias("n_missing"))


@query("SELECT DISTINCT item_identifier, name, replace(url_encode(name), '%2F', '/') AS quoted FROM ia_ingest_file WHERE name IS NOT NULL")
def i25_quoted_names(spark, d):
    return table(spark, d, "ia_ingest_file").where("name is not null").select("item_identifier", "name", scalars.quoted(F.col("name")).alias("quoted")).distinct()


_SKIP = ["name", "source", "format", "size", "md5", "sha1", "crc32", "mtime"]


def _ascii_sql(x: str) -> str:
    unit = "CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c)) ELSE printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {unit}), '')"


@query(
    f"""WITH o AS (SELECT item_identifier, name AS file_name, try_cast(metadata_json AS JSON) AS j FROM ia_ingest_file), f AS (SELECT item_identifier, file_name, e.key, e.value AS v FROM o, json_each(o.j) e WHERE json_type(j) = 'OBJECT' AND e.key NOT IN ({', '.join(f"'{x}'" for x in _SKIP)})),
 x AS (SELECT item_identifier, file_name, key, unnest(CASE WHEN json_type(v) = 'ARRAY' AND v::VARCHAR <> '[]' AND len(list_filter(json_extract(v, '$[*]'), lambda y: json_type(y) IN ('OBJECT', 'ARRAY'))) = 0 THEN json_extract(v, '$[*]') ELSE [v] END) AS x FROM f),
 t AS (SELECT *, CASE json_type(x) WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE 'json' END AS metadata_type FROM x)
 SELECT item_identifier, file_name, metadata_type, '{scalars.RECORD_PREFIX}' || key AS name, CASE metadata_type WHEN 'text' THEN x ->> '$' WHEN 'number' THEN x::VARCHAR ELSE array_to_string(list_sort(string_split({_ascii_sql('x::VARCHAR')}, '')), '') END AS value FROM t"""
)
def i21_record_rows(spark, d):
    """JSON values by their sorted letters, as SQL does not sort keys."""
    records = table(spark, d, "ia_ingest_file").where("metadata_json is not null").withColumnRenamed("name", "file_name")
    rows = scalars.record_rows(records, "metadata_json", _SKIP, "item_identifier", "file_name")
    letters = F.array_join(F.array_sort(F.filter(F.split("value", ""), lambda x: x != "")), "")
    return rows.withColumn("value", F.when(F.col("metadata_type") == "json", letters).otherwise(F.col("value")))


_FINGERPRINT = "'{\"description\":' || to_json(description)::VARCHAR || ',\"hashes\":{\"blake3\":null,\"crc32\":' || coalesce(to_json(crc32)::VARCHAR, 'null') || ',\"md5\":' || coalesce(to_json(md5)::VARCHAR, 'null') || ',\"sha1\":' || coalesce(to_json(sha1)::VARCHAR, 'null') || ',\"sha256\":null},\"name\":' || to_json(name)::VARCHAR || ',\"size_bytes\":' || coalesce(size_bytes::VARCHAR, 'null') || ',\"source_detail\":null,\"source_name\":null,\"source_type\":null}'"


@query(
    f"""WITH {_OBS}, w AS (SELECT obs_id, nullif(trim(display_name, {_WS}), '') AS name, nullif(trim(source, {_WS}), '') AS description, CASE WHEN size_bytes >= 0 THEN size_bytes END AS size_bytes, crc32, md5, sha1 FROM o),
 v AS (SELECT *, CASE WHEN coalesce(crc32, md5, sha1) IS NULL THEN 'at least one supported hash is required' """
    + " ".join(f"WHEN NOT regexp_full_match({a}, '[0-9a-f]{{{n}}}') THEN '{a} must be exactly {n} hexadecimal characters'" for a, n in (("crc32", 8), ("md5", 32), ("sha1", 40)))
    + f" WHEN name IS NULL THEN 'name is required' WHEN description IS NULL THEN 'description is required' END AS error FROM w) SELECT obs_id, CASE WHEN error IS NULL THEN sha256({_ascii_sql(_FINGERPRINT)}) END AS fingerprint, error FROM v"
)
def i8_fingerprints(spark, d):
    a = al.normalized(table(spark, d, "file_observation").select("obs_id", F.col("display_name").alias("name"), F.col("source").alias("description"), "size_bytes", "crc32", "md5", "sha1"))
    return a.select("obs_id", "fingerprint", "error")


# -- J: crawl state --------------------------------------------------------------------


#: Rows before are taken as the state, the others as what a later crawl saw.
_THEN = "2024-02-01 00:00:00"


def _then_and_now(spark: SparkSession, d: str, name: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, name)
    late = F.col("updated_at") >= F.lit(_THEN).cast("timestamp")
    return crawl.latest(rows.where(~late), key), rows.where(late)


def _micros(*names: str) -> list:
    return [F.unix_micros(n).alias(n.replace("_at", "_us")) for n in names]


@query(
    """WITH w AS (SELECT *, updated_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AS late FROM ia_ingest_item), s AS (SELECT * EXCLUDE (first_seen_at), min(first_seen_at) OVER (PARTITION BY identifier, late) AS first_seen_at, row_number() OVER (PARTITION BY identifier, late ORDER BY updated_at DESC) AS r FROM w),
 old AS (SELECT * FROM s WHERE NOT late AND r = 1), new AS (SELECT * FROM s WHERE late AND r = 1)
 SELECT coalesce(old.identifier, new.identifier) AS identifier, coalesce(new.query, old.query) AS query, coalesce(new.title, old.title) AS title, coalesce(new.mediatype, old.mediatype) AS mediatype, coalesce(old.status, 'discovered') AS status, coalesce(old.attempts, 0) AS attempts, old.error, epoch_us(coalesce(old.first_seen_at, new.first_seen_at)) AS first_seen_us, epoch_us(coalesce(new.updated_at, old.updated_at)) AS updated_us FROM old FULL JOIN new ON old.identifier = new.identifier"""
)
def j2_latest_items(spark, d):
    """Late rows merged as discoveries into the items known before."""
    merged = crawl.merge_items(*_then_and_now(spark, d, "ia_ingest_item", ["identifier"]))
    return merged.select("identifier", "query", "title", "mediatype", "status", "attempts", "error", *_micros("first_seen_at", "updated_at"))


@query(
    """WITH w AS (SELECT *, updated_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AS late FROM ia_ingest_file), s AS (SELECT * EXCLUDE (first_seen_at, ufid_file_id), min(first_seen_at) OVER p AS first_seen_at, arg_max(ufid_file_id, (updated_at, ufid_file_id)) FILTER (ufid_file_id IS NOT NULL) OVER p AS ufid_file_id, row_number() OVER (PARTITION BY item_identifier, name, late ORDER BY updated_at DESC) AS r FROM w WINDOW p AS (PARTITION BY item_identifier, name, late)),
 old AS (SELECT * FROM s WHERE NOT late AND r = 1), new AS (SELECT * FROM s WHERE late AND r = 1)
 SELECT coalesce(old.item_identifier, new.item_identifier) AS item_identifier, coalesce(old.name, new.name) AS name, CASE WHEN new.updated_at IS NULL THEN old.size_bytes ELSE new.size_bytes END AS size_bytes, coalesce(old.status, 'pending') AS status, coalesce(old.attempts, 0) AS attempts, coalesce(new.ufid_file_id, old.ufid_file_id) AS ufid_file_id, epoch_us(coalesce(old.first_seen_at, new.first_seen_at)) AS first_seen_us, epoch_us(coalesce(new.updated_at, old.updated_at)) AS updated_us FROM old FULL JOIN new ON old.item_identifier = new.item_identifier AND old.name = new.name"""
)
def j3_latest_files(spark, d):
    """Late rows merged into the queue as it was before."""
    merged = crawl.merge_files(*_then_and_now(spark, d, "ia_ingest_file", ["item_identifier", "name"]))
    return merged.select("item_identifier", "name", "size_bytes", "status", "attempts", "ufid_file_id", *_micros("first_seen_at", "updated_at"))


@query("SELECT item_identifier, name, status, epoch_us(first_seen_at) AS first_seen_us, epoch_us(updated_at) AS updated_us FROM ia_ingest_file WHERE status IN ('pending', 'downloading', 'failed', 'skipped')")
def j4_open_files(spark, d):
    return crawl.open_files(table(spark, d, "ia_ingest_file"), retry_failed=True).select("item_identifier", "name", "status", F.unix_micros("first_seen_at").alias("first_seen_us"), F.unix_micros("updated_at").alias("updated_us"))


@query(
    f"""SELECT item_identifier, name, epoch_us(updated_at) AS updated_us, CASE WHEN status IN ('done', 'failed') THEN status WHEN source IS DISTINCT FROM 'original' THEN 'not original' WHEN size_bytes > 10000000 THEN 'size ' || size_bytes || ' exceeds max 10000000' END AS skip,
 CASE WHEN coalesce(size_bytes < 1000, true) THEN 'below the least size' WHEN size_bytes > 10000000 THEN 'above the greatest size' WHEN NOT coalesce({_SUFFIX} IN {_IN(scalars.CONTAINER_SUFFIXES)}, false) THEN 'not a clearly supported archive' END AS defer FROM ia_ingest_file"""
)
def b18_skip_and_defer(spark, d):
    f = table(spark, d, "ia_ingest_file")
    return f.select("item_identifier", "name", F.unix_micros("updated_at").alias("updated_us"), crawl.skip_reason(True, 10_000_000).alias("skip"), crawl.defer_reason(1000, 10_000_000).alias("defer"))


@query(
    """WITH j AS (SELECT i.item_identifier, i.name, i.updated_at, i.crc32 AS c0, i.md5 AS m0, i.sha1 AS s0, f.crc32, f.md5, f.sha1 FROM ia_ingest_file i JOIN ufid_file f ON f.id = i.ufid_file_id)
 SELECT item_identifier, name, CASE WHEN lower(trim(s0)) <> sha1 AND trim(s0) <> '' THEN 'sha1' WHEN lower(trim(m0)) <> md5 AND trim(m0) <> '' THEN 'md5' ELSE 'crc32' END AS mismatch FROM j WHERE (lower(trim(s0)) <> sha1 AND trim(s0) <> '') OR (lower(trim(m0)) <> md5 AND trim(m0) <> '') OR (lower(trim(c0)) <> crc32 AND trim(c0) <> '')"""
)
def i24_fixity(spark, d):
    return crawl.fixity(*_t(spark, d, "ia_ingest_file", "ufid_file"))


@query(
    """WITH RECURSIVE c AS (SELECT DISTINCT identifier, lower(title) AS title, lower(mediatype) AS mediatype FROM ia_ingest_item WHERE mediatype IS NOT NULL), e AS (SELECT DISTINCT lower(query) AS p, c.mediatype AS c FROM c JOIN ia_ingest_item USING (identifier)),
 r(x, depth) AS (SELECT DISTINCT lower(query), 0 FROM ia_ingest_item UNION SELECT e.c, depth + 1 FROM r JOIN e ON e.p = r.x WHERE depth < 16) SELECT x AS collection, min(depth) AS depth FROM r WHERE x IS NOT NULL GROUP BY x"""
)
def j9_collection_depths(spark, d):
    """Queries as roots, the media types of their items as collections below them."""
    i = table(spark, d, "ia_ingest_item")
    return crawl.collection_depths(i.where("query is not null").select(F.col("query").alias("collection")), i.where("mediatype is not null").select(F.col("query").alias("parent"), F.col("mediatype").alias("child")))
