"""Queries of conflicts, catalogues, match listings and the crawl's steps, with equal SQL.

As in ``catalog``, watch lists are made from all observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from idloom.functions import scalars
from idloom.operators import alerts as al
from idloom.operators import identity, ingest, provenance, search
from idloom.plans import catalog as c
from idloom.session import Scratch, table
from idloom.sources import crawl_source
from idloom.sources.store import Store
from idloom.streaming import crawl

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2030-01-01 00:00:00"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


# -- conflicts -----------------------------------------------------------------------

_AFTER = f"""{c._OBS}, {c._FILE_KEYS}, g AS (SELECT size_bytes, crc32, md5, sha1, min(obs_id) AS first_id FROM o WHERE {c._OK} GROUP BY ALL), n AS (SELECT g.* FROM g ANTI JOIN k USING (size_bytes, crc32, md5, sha1)),
 new AS (SELECT (SELECT max(id) FROM ufid_file) + row_number() OVER (ORDER BY first_id) AS id, size_bytes, crc32, md5, sha1 FROM n), every AS (SELECT id, size_bytes, crc32, md5, sha1 FROM ufid_file UNION ALL SELECT * FROM new),
 e AS (SELECT id, size_bytes, 'crc32' AS algorithm, crc32 AS v FROM every UNION ALL SELECT id, size_bytes, 'md5', md5 FROM every UNION ALL SELECT id, size_bytes, 'sha1', sha1 FROM every),
 oldest AS (SELECT size_bytes, algorithm, v, min(id) AS file_id FROM e GROUP BY ALL),
 x AS (SELECT oldest.file_id, e.id AS related_file_id, 'required_hash_overlap' AS conflict_type, e.algorithm, e.v AS existing_value, e.v AS incoming_value, new.size_bytes AS incoming_size_bytes, new.crc32 AS incoming_crc32, new.md5 AS incoming_md5, new.sha1 AS incoming_sha1, 'Distinct required identity tuples share exact size and ' || e.algorithm || '; stored as separate UFID records' AS notes FROM new JOIN e ON e.id = new.id JOIN oldest ON oldest.size_bytes = e.size_bytes AND oldest.algorithm = e.algorithm AND oldest.v = e.v WHERE oldest.file_id < e.id)"""


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return c._import(spark, d).overlaps


@query(f"WITH {_AFTER} SELECT * FROM x")
def h2_overlap_conflicts(spark, d):
    """Conflicts an import of all observations logs: each new file against the oldest of its class."""
    return _overlaps(spark, d).drop("seq")


@query(f"WITH {_AFTER} SELECT (SELECT count(*) FROM x) AS logged, count(*) AS again FROM x WHERE false")
def h3_conflicts_once(spark, d):
    """Rows logged by an import, and by the same import once more."""
    spark_rows = Scratch(spark).save(_overlaps(spark, d), "overlaps")
    none = spark.createDataFrame([], "id long, " + ", ".join(f"{k} {'long' if k.endswith(('file_id', 'size_bytes')) else 'string'}" for k in identity.CONFLICT_KEY))
    logged = Scratch(spark).save(identity.log_conflicts(none, spark_rows), "logged")
    again = identity.log_conflicts(logged, spark_rows)
    n = F.count(F.lit(1))
    return logged.agg(n.alias("logged")).crossJoin(F.broadcast(again.agg(n.alias("again"))))


@query(f"WITH {_AFTER} SELECT file_id, count(*) AS n_conflicts FROM (SELECT file_id FROM x UNION ALL SELECT related_file_id FROM x) GROUP BY file_id")
def b6_conflicts(spark, d):
    """Logged conflicts of every file, from either side."""
    return identity.conflict_counts(_overlaps(spark, d))


_TOP_CLASS = "(SELECT max(related_file_id) FROM x WHERE (file_id, algorithm, incoming_value) = (SELECT (file_id, algorithm, incoming_value) FROM x GROUP BY file_id, algorithm, incoming_value ORDER BY count(*) DESC, file_id, algorithm LIMIT 1))"


@query(
    f"""WITH {_AFTER}, me AS (SELECT {_TOP_CLASS} AS id), p AS (SELECT a.id AS file_id, b.id AS related_file_id, a.algorithm, a.v FROM e a JOIN e b ON a.size_bytes = b.size_bytes AND a.algorithm = b.algorithm AND a.v = b.v AND a.id < b.id JOIN new ON new.id = b.id JOIN me ON me.id IN (a.id, b.id))
 SELECT file_id, related_file_id, algorithm, v AS incoming_value FROM p"""
)
def b6_file_conflicts(spark, d):
    """One file against every other of its classes: the last of the largest class."""
    done = c._import(spark, d)
    logged = Scratch(spark).save(done.overlaps.drop("seq"), "overlaps")
    cls = ["file_id", "algorithm", "incoming_value"]
    top = logged.groupBy(*cls).agg(F.count(F.lit(1)).alias("n"), F.max("related_file_id").alias("last")).orderBy(F.col("n").desc(), "file_id", "algorithm").first()
    return identity.conflicts_of(logged, done.files, top["last"] if top else -1).select("file_id", "related_file_id", "algorithm", "incoming_value")


@query(
    f"""WITH {_AFTER}, f AS (SELECT id FROM ufid_file ORDER BY size_bytes DESC, id DESC LIMIT 50), s AS (SELECT file_id AS id FROM x UNION ALL SELECT related_file_id FROM x)
 SELECT f.id, (SELECT count(*) FROM ufid_file_meta m WHERE m.file_id = f.id) AS n_metadata, (SELECT count(*) FROM ufid_archive_member a WHERE a.parent_file_id = f.id) AS n_members, (SELECT count(*) FROM s WHERE s.id = f.id) AS n_conflicts, (SELECT arg_min(m.id, (added_at, m.id)) FROM ufid_file_meta m WHERE m.file_id = f.id) AS first_metadata FROM f"""
)
def b4_file_page(spark, d):
    """A page of files with everything nested, counted."""
    files, meta, members = c._t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member")
    conflicts = _overlaps(spark, d).withColumn("id", F.monotonically_increasing_id()).drop("seq")
    page = search.file_page(search.list_files(files, meta, members, 50, 0, None, "size", "desc"), meta, members, conflicts)
    n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    size = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long")
    return page.select("id", size("metadata").alias("n_metadata"), size("archive_members").alias("n_members"), size("identity_conflicts").alias("n_conflicts"), F.try_element_at("metadata", F.lit(1))["meta_id"].alias("first_metadata"))


# -- sources -------------------------------------------------------------------------

_ENTRIES = f"""m AS (SELECT file_id, name, nullif(trim(value, {c._WS}), '') AS value, added_at, id FROM ufid_file_meta), own AS (SELECT DISTINCT file_id, value AS source_value FROM m WHERE name = 'source' AND value IS NOT NULL),
 ref AS (SELECT file_id, """ + ", ".join(f"arg_min(value, (added_at, id)) FILTER (name = '{n}' AND value IS NOT NULL) AS {n}" for n in sorted({n for v in provenance.SOURCE_REFERENCES.values() for n in v})) + """ FROM m WHERE value IS NOT NULL GROUP BY file_id),
 entry AS (SELECT file_id, source_value, CASE source_value WHEN 'internet_archive' THEN 'Internet Archive' WHEN 'logiqx_dat' THEN 'Logiqx DAT' ELSE source_value END AS label, coalesce(CASE source_value WHEN 'internet_archive' THEN coalesce(ia_file_url, ia_item_url, ia_identifier) WHEN 'logiqx_dat' THEN coalesce(dat_filename, dat_source_name) END, '') AS external_reference FROM own LEFT JOIN ref USING (file_id))"""


def _no_sources(spark: SparkSession) -> provenance.Sources:
    return provenance.Sources(spark.createDataFrame([(1, "logiqx_dat", None)], "id long, name string, description string"), spark.createDataFrame([], "file_id long, source_id long, external_reference string"))


@query(f"WITH {_ENTRIES} SELECT file_id, source_value AS name, label AS description, external_reference FROM entry")
def h5_file_sources(spark, d):
    """Links of files to sources after all metadata is taken in; one source had no description."""
    got = provenance.add_sources(_no_sources(spark), table(spark, d, "ufid_file_meta"))
    return got.file_sources.join(got.sources.withColumnRenamed("id", "source_id"), "source_id").select("file_id", "name", "description", "external_reference")


@query(f"SELECT 'logiqx_dat' AS source_value UNION SELECT trim(value, {c._WS}) FROM ufid_file_meta WHERE name = 'source' AND trim(value, {c._WS}) <> ''")
def g2_source_catalog(spark, d):
    return provenance.source_catalog(_no_sources(spark).sources, table(spark, d, "ufid_file_meta"))


@query(f"WITH {_ENTRIES}, {c._SOURCE} SELECT file_id, source_value, external_reference FROM entry UNION SELECT file_id, source_value, coalesce(ia_file_url, ia_item_url, dat_filename, '') FROM src LEFT JOIN ref r2 USING (file_id)".replace("ref AS (SELECT file_id, arg_min(value, (added_at, id)) FILTER (name = 'ia_file_url')", "r2 AS (SELECT file_id, arg_min(value, (added_at, id)) FILTER (name = 'ia_file_url')").replace("LEFT JOIN ref r2", "LEFT JOIN r2"))
def g3_resolved_sources(spark, d):
    meta = table(spark, d, "ufid_file_meta")
    return provenance.resolved_sources(provenance.add_sources(_no_sources(spark), meta), meta)


# -- catalogues ----------------------------------------------------------------------


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "file_observation")
    return obs.select(F.col("obs_id").alias("seq"), F.col("source").alias("name"), F.col("size_bytes").cast("string").alias("size_bytes"), "crc32", "md5", "sha1", F.lit(None).cast("string").alias("source_type"), F.lit("All of them").alias("source_name"), F.col("display_name").alias("source_detail"), F.concat(F.lit("list-"), F.pmod("obs_id", F.lit(3)), F.lit(".dat")).alias("filename"))


_DAT = f"""d AS (SELECT obs_id AS seq, CASE WHEN size_bytes >= 0 THEN size_bytes END AS size_bytes, {', '.join(f"lower(trim({h}, {c._WS})) AS {h}" for h in ('crc32', 'md5', 'sha1'))}, coalesce(nullif(trim(source, {c._WS}), ''), 'All of them') AS set_name, nullif(trim(display_name, {c._WS}), '') AS shown, 'list-' || obs_id % 3 || '.dat' AS filename FROM file_observation),
 ok AS (SELECT *, coalesce(shown, set_name) AS entry FROM d WHERE {c._OK}), {c._FILE_KEYS}, g AS (SELECT ok.*, k.file_id, min(seq) OVER (PARTITION BY ok.size_bytes, ok.crc32, ok.md5, ok.sha1) AS first_id FROM ok LEFT JOIN k USING (size_bytes, crc32, md5, sha1)),
 e AS (SELECT g.*, unnest([{{'n': 'filename', 'v': entry}}, {{'n': 'description', 'v': set_name}}, {{'n': 'source', 'v': 'logiqx_dat'}}, {{'n': 'dat_source_type', 'v': 'logiqx-dat'}}, {{'n': 'dat_source_name', 'v': 'All of them'}}, {{'n': 'dat_set_name', 'v': set_name}}, {{'n': 'dat_entry_name', 'v': entry}}, {{'n': 'dat_filename', 'v': filename}}]) AS x FROM g),
 n AS (SELECT min(seq) AS seq FROM e WHERE NOT EXISTS (SELECT 1 FROM ufid_file_meta m WHERE m.file_id = e.file_id AND m.metadata_type = 'text' AND m.name = x.n AND m.value = x.v AND coalesce(m.notes, '') = '') GROUP BY size_bytes, crc32, md5, sha1, x.n, x.v),
 s AS (SELECT seq, CASE WHEN file_id IS NULL AND seq = first_id THEN 'created' WHEN seq IN (SELECT seq FROM n) THEN 'enriched' ELSE 'unchanged' END AS status FROM g UNION ALL SELECT seq, 'error' FROM d WHERE seq NOT IN (SELECT seq FROM ok))"""


@query(f"WITH {_DAT} SELECT seq, status FROM s")
def h7_dat_import(spark, d):
    """All observations as rows of three catalogues, imported as identities."""
    files, meta = c._t(spark, d, "ufid_file", "ufid_file_meta")
    return ingest.import_catalogue(files, meta, _catalogue(spark, d)).report.select("seq", "status")


@query(f"WITH {_DAT}, t AS (SELECT count(*) AS received, count(*) FILTER (status <> 'error') AS valid, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'enriched') AS enriched, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'error') AS errors FROM s) SELECT received, valid, created, enriched, unchanged, errors AS skipped, errors FROM t")
def h7_dat_counts(spark, d):
    files, meta = c._t(spark, d, "ufid_file", "ufid_file_meta")
    return ingest.import_counts(ingest.import_catalogue(files, meta, _catalogue(spark, d)))


_FIRST_ERROR = f"""CASE WHEN crc32 IS NULL OR md5 IS NULL OR sha1 IS NULL THEN 'Required hashes are missing: ' || array_to_string(list_filter([CASE WHEN crc32 IS NULL THEN 'crc32' END, CASE WHEN md5 IS NULL THEN 'md5' END, CASE WHEN sha1 IS NULL THEN 'sha1' END], lambda x: x IS NOT NULL), ', ')
 WHEN size_bytes IS NULL THEN 'Exact file size is required' """ + " ".join(f"WHEN length({a}) <> {n} THEN '{a} must be exactly {n} hexadecimal characters' WHEN NOT regexp_full_match({a}, '[0-9a-f]+') THEN '{a} must contain only hexadecimal characters'" for a, n in (("crc32", 8), ("md5", 32), ("sha1", 40))) + " END"


@query(f"WITH {_DAT} SELECT seq, coalesce(shown, CASE WHEN set_name = 'All of them' THEN '' ELSE set_name END) AS name, set_name, coalesce(shown, set_name) AS entry_name, {_FIRST_ERROR} AS error FROM d")
def i5_dat_identities(spark, d):
    """Rows of catalogues as identities: names, and why one is none; a blank hash is a wrong one."""
    rows = ingest.catalogue_observations(_catalogue(spark, d))
    n = ingest.catalogue_names()
    return rows.select("seq", n["record"].alias("name"), n["set"].alias("set_name"), n["entry"].alias("entry_name"), "error")


@query(
    f"""WITH f AS (SELECT id, size_bytes, crc32, md5, sha1, sha256, 'list ' || lpad(CAST(id // 1000 AS VARCHAR), 6, '0') AS list FROM ufid_file), k AS (SELECT min(id) AS id FROM f WHERE sha256 IS NOT NULL GROUP BY size_bytes, crc32, md5, sha1),
 r AS (SELECT f.*, min(CASE WHEN sha256 IS NOT NULL THEN id END) OVER p AS stored, row_number() OVER (PARTITION BY size_bytes, crc32, md5, sha1, sha256 IS NULL ORDER BY list, id) AS nth FROM f WINDOW p AS (PARTITION BY size_bytes, crc32, md5, sha1))
 SELECT count(*) AS received, count(*) FILTER (stored IS NULL AND nth = 1) AS created, (SELECT count(*) FROM k) + count(*) FILTER (stored IS NULL AND nth = 1) AS files_after FROM r"""
)
def a29_dat_files(spark, d):
    """All files as classic catalogues, read and imported where those with sha256 are known."""
    files, meta = c._t(spark, d, "ufid_file", "ufid_file_meta")
    row = F.format_string('rom ( name "file %d" size %d crc %s md5 %s sha1 %s )', "id", "size_bytes", "crc32", "md5", "sha1")
    number = F.lpad(F.expr("id div 1000").cast("string"), 6, "0")
    sets = files.select(number.alias("s"), F.struct("id", row.alias("r")).alias("r")).groupBy("s").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("r")), lambda x: x["r"])).alias("rows"))
    texts = sets.select(F.concat(F.lit('clrmamepro ( name "all" )\ngame ( name "set"\n'), "rows", F.lit("\n)")).alias("text"), F.concat(F.lit("list "), "s").alias("filename"))
    done = ingest.import_catalogues(files.where("sha256 is not null"), meta, texts)
    n = ingest.import_counts(done).select("received", "created")
    return n.crossJoin(F.broadcast(done.files.agg(F.count_distinct(*identity.KEY).alias("files_after"))))


# -- alerts and matches --------------------------------------------------------------

_FULL = c._ALERTS.replace("CASE WHEN size_bytes >= 0 THEN size_bytes END AS size_bytes", "coalesce(display_name, '?') AS name, coalesce(source, '?') AS description, CASE WHEN size_bytes >= 0 THEN size_bytes END AS size_bytes")
_ALERT_HAS = " OR ".join(f"coalesce(CAST(a.{x} AS VARCHAR) ILIKE '%b4%', false)" for x in ("id", "size_bytes", "name", "description", "crc32", "md5", "sha1", "source"))


@query(f"WITH {_FULL} SELECT count(*) AS n FROM a WHERE id % 5 = 2 AND ({_ALERT_HAS})")
def d2_count_alerts(spark, d):
    """Alerts of one user that a query finds in any column."""
    a, links = c._alerts(spark, d)
    return al.count_alerts(a, links, 2, "b4")


@query(f"WITH {_FULL} SELECT id, name, description, size_bytes, crc32, md5, sha1 FROM a WHERE id % 5 = 2 AND ({_ALERT_HAS}) ORDER BY id DESC LIMIT 200")
def f3_alert_page(spark, d):
    a, links = c._alerts(spark, d)
    page = al.list_alerts(a, links, 2, "b4")
    return al.alert_records(page).select("id", "name", "description", "size_bytes", *[F.col("hashes")[h].alias(h) for h in ("crc32", "md5", "sha1")])


_MATCHED = c._MATCH.replace(c._ALERTS, _FULL)
_HAS = " OR ".join(f"coalesce(CAST({x} AS VARCHAR) ILIKE '%scan%', false)" for x in ("a.id", "f.id", "a.size_bytes", "f.size_bytes", "a.name", "a.description", "a.crc32", "a.md5", "a.sha1", "a.source", "f.crc32", "f.md5", "f.sha1", "f.sha256", "f.blake3")) + " OR (a.source IS NOT NULL AND 'observation' ILIKE '%scan%')"
_META_HAS = "f.id IN (SELECT file_id FROM ufid_file_meta WHERE name ILIKE '%scan%' OR value ILIKE '%scan%' OR notes ILIKE '%scan%')"


@query(f"WITH {_MATCHED} SELECT count(*) AS n FROM m JOIN a ON a.id = m.alert_id JOIN ufid_file f ON f.id = m.file_id WHERE a.id % 5 = 1 AND ({_HAS} OR {_META_HAS})")
def d3_count_matches(spark, d):
    """Matches of one user that a query finds; provenance is not computed for it."""
    a, _, stored = c._stored(spark, d)
    rows = al.match_rows(stored.where("user_id = 1"), a, *c._t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member"), query="scan", with_sources=False)
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_MATCHED}, {c._UP}, {c._SOURCE}, mine AS (SELECT m.* FROM m JOIN a ON a.id = m.alert_id WHERE a.id % 5 = 1 AND a.source IS NULL), x(file_id, ancestor_id) AS (SELECT DISTINCT file_id, file_id FROM mine UNION SELECT x.file_id, up.p FROM x JOIN up ON up.c = x.ancestor_id) SELECT count(*) AS n FROM mine WHERE file_id IN (SELECT x.file_id FROM x JOIN src ON src.file_id = x.ancestor_id WHERE source_value IN ('internet_archive', 'logiqx_dat'))")
def c10_matches_by_source(spark, d):
    """One user's matches of alerts put in by hand whose file, or one above it, has one of two sources."""
    a, _, stored = c._stored(spark, d)
    rows = al.match_rows(stored.where("user_id = 1"), a, *c._t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member"), source_keys=[" manual", "manual", ""], sources=["internet_archive", " logiqx_dat "], with_sources=False)
    return rows.agg(F.count(F.lit(1)).alias("n"))


_TOP = f"""top AS (SELECT file_id, source_value, external_reference, ancestor_id FROM (SELECT anc.file_id, anc.ancestor_id, source_value, coalesce(ia_file_url, ia_item_url, dat_filename, '') AS external_reference, row_number() OVER (PARTITION BY anc.file_id ORDER BY depth DESC, source_value, anc.ancestor_id) AS r FROM anc JOIN src ON src.file_id = anc.ancestor_id LEFT JOIN ref ON ref.file_id = anc.ancestor_id) WHERE r = 1),
 v AS (SELECT file_id, {', '.join(f"arg_min(value, (added_at, id)) FILTER (name = '{n}') AS {n}" for n in provenance.RECORD_FIELDS)} FROM ufid_file_meta WHERE name IN ({', '.join(f"'{n}'" for n in provenance.RECORD_FIELDS)}) GROUP BY file_id),
 rec AS (SELECT file_id, ancestor_id, ia_identifier, ia_item_url FROM (SELECT anc.file_id, anc.ancestor_id, v.ia_identifier, v.ia_item_url, row_number() OVER (PARTITION BY anc.file_id ORDER BY depth DESC, anc.ancestor_id) AS r FROM anc JOIN v ON v.file_id = anc.ancestor_id WHERE v.ia_identifier IS NOT NULL OR v.ia_item_url IS NOT NULL) WHERE r = 1),
 shown AS (SELECT file_id, arg_min(value, (added_at, id)) FILTER (name = 'filename') AS filename, arg_min(value, (added_at, id)) FILTER (name = 'content_type') AS content_type FROM ufid_file_meta WHERE name IN ('filename', 'content_type') GROUP BY file_id)"""


@query(
    f"""WITH RECURSIVE {_MATCHED}, {c._UP}, {c._SOURCE}, mine AS (SELECT * FROM m WHERE alert_id % 5 = 1), anc(file_id, ancestor_id, depth) AS (SELECT DISTINCT file_id, file_id, 0 FROM mine UNION SELECT anc.file_id, up.p, depth + 1 FROM anc JOIN up ON up.c = anc.ancestor_id WHERE depth < 128), {_TOP}
 SELECT alert_id, mine.file_id, nullif(filename, '') AS display_name, content_type, array_to_string(list_filter([CASE WHEN matched_crc32 = 1 THEN 'crc32' END, CASE WHEN matched_md5 = 1 THEN 'md5' END, CASE WHEN matched_sha1 = 1 THEN 'sha1' END], lambda x: x IS NOT NULL), ',') AS matched, size_matched = 1 AS size_matched, source_value, CASE source_value WHEN 'internet_archive' THEN 'Internet Archive' WHEN 'logiqx_dat' THEN 'Logiqx DAT' ELSE source_value END AS label, external_reference, ia_identifier AS identifier, coalesce(nullif(ia_item_url, ''), 'https://archive.org/details/' || ia_identifier) AS item_url
 FROM mine LEFT JOIN shown ON shown.file_id = mine.file_id LEFT JOIN top ON top.file_id = mine.file_id LEFT JOIN rec ON rec.file_id = mine.file_id ORDER BY alert_id DESC, mine.file_id DESC LIMIT 200 OFFSET 20"""
)
def f4_match_page(spark, d):
    """A page of one user's matches as nested records, the latest first."""
    a, _, stored = c._stored(spark, d)
    rows = al.match_rows(stored.where("user_id = 1"), a, *c._t(spark, d, "ufid_file", "ufid_file_meta", "ufid_archive_member"))
    r = al.match_records(al.match_page(rows, 200, 20))
    return r.select(F.col("alert.id").alias("alert_id"), F.col("file.id").alias("file_id"), "file.display_name", "file.content_type", F.array_join("matched_algorithms", ",").alias("matched"), "size_matched", "file.source.source_value", "file.source.label", "file.source.external_reference", "file.record.identifier", "file.record.item_url")


# -- names ---------------------------------------------------------------------------


@query("SELECT DISTINCT query, CASE WHEN lower(query) LIKE 'collection:%' THEN substr(query, 12) END AS collection, 'collection::' || substr(query, 12) AS crawl_key, query AS again FROM ia_ingest_item WHERE query IS NOT NULL")
def i29_collections(spark, d):
    """Which collection a search is for, its key, and the search for it."""
    name = scalars.collection_of(F.col("query"))
    return table(spark, d, "ia_ingest_item").where("query is not null").select("query", name.alias("collection"), scalars.collection_key(name).alias("crawl_key"), scalars.collection_query(name).alias("again")).distinct()


_ARTIFACT = "coalesce(format = 'Metadata', false) OR coalesce(" + " OR ".join([f"lower(regexp_extract(name, '([^/]*)/*$', 1)) IN {c._IN(scalars.ARTIFACT_NAMES)}", *[f"ends_with(lower(regexp_extract(name, '([^/]*)/*$', 1)), '{s}')" for s in scalars.ARTIFACT_SUFFIXES]]) + ", false)"
_QUOTE = "replace(replace(url_encode({x}), '+', '%20'), '%2F', '{s}')"
_URL = f"'https://archive.org/download/' || {_QUOTE.format(x='{i}', s='%2F')} || '/' || {_QUOTE.format(x='{n}', s='/')}"


@query(f"SELECT DISTINCT item_identifier, name, {_ARTIFACT} AS is_artifact, {_URL.format(i='item_identifier', n='name')} AS url FROM ia_ingest_file WHERE name IS NOT NULL")
def i23_artifacts(spark, d):
    f = table(spark, d, "ia_ingest_file").where("name is not null")
    return f.select("item_identifier", "name", scalars.is_artifact(F.col("name"), F.col("format")).alias("is_artifact"), scalars.file_url(F.col("item_identifier"), F.col("name")).alias("url")).distinct()


# -- the crawl's steps ---------------------------------------------------------------

_LATEST_FILES = "lf AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY item_identifier, name ORDER BY updated_at DESC) AS r FROM ia_ingest_file) WHERE r = 1)"
_LATEST_ITEMS = "li AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY updated_at DESC) AS r FROM ia_ingest_item) WHERE r = 1)"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ia_ingest_file")
    return rows.groupBy("item_identifier", "name").agg(F.max_by(F.struct(*[x for x in rows.columns if x not in ("item_identifier", "name")]), "updated_at").alias("r")).select("item_identifier", "name", "r.*").select(*rows.columns)


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ia_ingest_item")
    return rows.groupBy("identifier").agg(F.max_by(F.struct(*[x for x in rows.columns if x != "identifier"]), "updated_at").alias("r")).select("identifier", "r.*").select(*rows.columns)


_SUF = c._SUFFIX
_ARCHIVE = f"{_SUF} IN {c._IN(scalars.CONTAINER_SUFFIXES + scalars.OTHER_SUFFIXES + scalars.SINGLE_SUFFIXES)}"
_OUTER = "(" + " OR ".join([f"lower(name) LIKE '%{s}'" for s in scalars.OUTER_SUFFIXES] + [f"lower(coalesce(format, '')) LIKE '%{w}%'" for w in scalars.OUTER_FORMATS]) + f") AND NOT ({_ARCHIVE.replace('(name', '(lower(name)').replace('lower(lower(name))', 'lower(name)')})"
_NEEDS = f"(needs_downloaded_identity <> 0 OR ufid_file_id IS NULL OR ({_ARCHIVE} AND {_SUF} NOT IN {c._IN(scalars.SINGLE_SUFFIXES)}) OR ({_OUTER}))"
_ACTIONS = f"""act AS (SELECT *, CASE WHEN status = 'failed' THEN NULL WHEN source IS DISTINCT FROM 'original' THEN 'not original' WHEN size_bytes > 50000000 THEN 'size ' || size_bytes || ' exceeds max 50000000' END AS skip,
  CASE WHEN coalesce(size_bytes < 1000, true) THEN 'below the least size' WHEN NOT coalesce({_SUF} IN {c._IN(scalars.CONTAINER_SUFFIXES)}, false) THEN 'not a clearly supported archive' END AS wait FROM lf WHERE status IN ('pending', 'downloading', 'skipped', 'failed')),
 ac AS (SELECT *, CASE WHEN status = 'failed' AND source IS DISTINCT FROM 'original' THEN 'skip' WHEN skip IS NOT NULL OR (status = 'failed' AND size_bytes > 50000000) THEN 'skip' WHEN NOT {_NEEDS} THEN 'done' WHEN wait IS NOT NULL THEN 'defer' ELSE 'fetch' END AS action FROM act)"""


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return crawl.queue_actions(_queue(spark, d), True, 50_000_000, True, 1000)


@query(f"WITH {_LATEST_FILES}, {_ACTIONS} SELECT item_identifier, name, action FROM ac")
def j12_queue_actions(spark, d):
    """What happens to each open file next."""
    return _actions(spark, d).select("item_identifier", "name", "action")


@query(f"WITH {_LATEST_FILES}, {_ACTIONS} SELECT count(*) FILTER (action = 'skip') AS skipped_files, count(*) FILTER (action = 'done') AS known_files, count(*) FILTER (action = 'defer') AS deferred_files, count(*) FILTER (action = 'fetch') AS fetched_files, coalesce(sum(size_bytes) FILTER (action = 'fetch'), 0)::BIGINT AS fetched_bytes FROM ac")
def d9_counters(spark, d):
    return crawl.crawl_counters(_actions(spark, d))


@query(f"WITH {_LATEST_FILES}, {_ACTIONS} SELECT lf.item_identifier, lf.name, CASE action WHEN 'skip' THEN 'skipped' WHEN 'done' THEN 'done' ELSE lf.status END AS status, CASE WHEN action IN ('skip', 'done') THEN epoch_us(TIMESTAMPTZ '{NOW}+00') ELSE epoch_us(lf.updated_at) END AS updated_us FROM lf LEFT JOIN ac ON ac.item_identifier = lf.item_identifier AND ac.name = lf.name")
def j12_queue_after(spark, d):
    """The queue after files are skipped or done without a download."""
    after = crawl.mark_files(_queue(spark, d), crawl.action_updates(_actions(spark, d)), _now())
    return after.select("item_identifier", "name", "status", F.unix_micros("updated_at").alias("updated_us"))


@query(f"WITH {_LATEST_FILES} SELECT item_identifier, name, CASE WHEN ufid_file_id IS NOT NULL AND status IN ('failed', 'skipped') THEN 'pending' ELSE status END AS status, ufid_file_id, CASE WHEN ufid_file_id IS NULL THEN error END AS error, attempts FROM lf")
def j5_identities_recorded(spark, d):
    """Files whose identity is known wait again if they failed or were skipped."""
    q = _queue(spark, d)
    after = crawl.record_identities(q.withColumn("ufid_file_id", F.lit(None).cast("long")), q.where("ufid_file_id is not null"), _now())
    return after.select("item_identifier", "name", "status", "ufid_file_id", "error", "attempts")


@query(f"WITH {_LATEST_ITEMS} SELECT identifier, CASE WHEN status IN ('pending', 'failed') THEN 'metadata_failed' ELSE status END AS status, CASE WHEN status IN ('pending', 'failed') THEN 'no answer' ELSE error END AS error, (attempts + (status IN ('pending', 'failed'))::INT)::INT AS attempts FROM li")
def j5_items_marked(spark, d):
    i = _items(spark, d)
    marks = i.where("status in ('pending', 'failed')").select("identifier", F.lit("metadata_failed").alias("status"), F.lit("no answer").alias("error"), F.lit(1).alias("more_attempts"))
    return crawl.mark_items(i, marks, _now()).select("identifier", "status", "error", "attempts")


@query(f"WITH {_LATEST_ITEMS} SELECT identifier, 'scanned' AS kind FROM li WHERE status IN ('done', 'metadata_done') UNION ALL SELECT identifier, 'collection' FROM li WHERE lower(mediatype) = 'collection'")
def j6_item_lists(spark, d):
    i = _items(spark, d)
    return crawl.scanned_items(i).select("identifier", F.lit("scanned").alias("kind")).unionByName(crawl.collection_items(i).select("identifier", F.lit("collection").alias("kind")))


@query(f"WITH {_LATEST_FILES} SELECT item_identifier, name, status, attempts, ufid_file_id, error FROM lf WHERE (item_identifier, name) = (SELECT (item_identifier, name) FROM lf ORDER BY item_identifier, name LIMIT 1)")
def j6_file_state(spark, d):
    q = _queue(spark, d)
    first = q.orderBy("item_identifier", "name").first()
    return crawl.get_file(q, first.item_identifier, first.name) if first else crawl.get_file(q, "", "")


_J = f"""{_LATEST_ITEMS}, r AS (SELECT identifier, try_cast(metadata_json AS JSON) AS j FROM li), fe AS (SELECT identifier, unnest(json_extract(j, '$.files[*]')) AS f FROM r WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.files') = 'ARRAY'),
 ff AS (SELECT identifier, f ->> '$.name' AS name, nullif(f ->> '$.format', '') AS format, try_cast(trim(f ->> '$.size') AS BIGINT) AS size_bytes, {', '.join(f"nullif(lower(trim(f ->> '$.{h}', {c._WS})), '') AS {h}" for h in ('md5', 'sha1', 'crc32'))} FROM fe WHERE json_type(f) = 'OBJECT' AND {c._TRUE_NAME})"""


@query(
    f"""WITH {_J} SELECT DISTINCT identifier AS item_identifier, name, {_URL.format(i='identifier', n='name')} AS url, array_to_string(list_filter([CASE WHEN NOT coalesce(size_bytes >= 0, false) THEN 'size' END, {', '.join(f"CASE WHEN NOT coalesce(regexp_full_match({h}, '[0-9a-f]{{{n}}}'), false) THEN '{h}' END" for h, n in (('crc32', 8), ('md5', 32), ('sha1', 40)))}], lambda x: x IS NOT NULL), ',') AS missing FROM ff"""
)
def j11_item_queue(spark, d):
    """Files of all records as rows of the queue: address, and what their identity lacks."""
    rows = crawl_source.queue_rows(crawl_source.item_files(_items(spark, d)), _now())
    return rows.select("item_identifier", "name", "url", F.array_join(F.from_json("identity_metadata_missing", "array<string>"), ",").alias("missing")).distinct()


@query("SELECT DISTINCT query AS crawl_key, false AS completed FROM ia_ingest_item WHERE query IS NOT NULL UNION SELECT DISTINCT 'collection::' || substr(query, 12), false FROM ia_ingest_item WHERE lower(query) LIKE 'collection:%'")
def j14_checkpoint_aliases(spark, d):
    """Checkpoints of all searches, with those of the collections they are for."""
    i = table(spark, d, "ia_ingest_item").where("query is not null").select("query").distinct()
    rows = i.select(F.col("query").alias("crawl_key"), "query", F.lit(None).cast("string").alias("cursor"), F.lit(False).alias("completed"))
    return crawl.with_aliases(rows).select("crawl_key", "completed")


@query(f"""WITH {_LATEST_FILES} SELECT 'error' AS level, item_identifier, name AS file_name, 'File ingest failed: ' || coalesce(error, '') AS message, '{{"attempts":' || attempts || ',"size_bytes":' || coalesce(size_bytes::VARCHAR, 'null') || '}}' AS details_json FROM lf WHERE status = 'failed'""")
def a27_events(spark, d):
    failed = _queue(spark, d).where("status = 'failed'")
    return crawl.events(failed, "error", F.concat(F.lit("File ingest failed: "), F.coalesce("error", F.lit(""))), {"size_bytes": F.col("size_bytes"), "attempts": F.col("attempts")}, _now()).drop("created_at")


@query(f"""WITH {_LATEST_FILES} SELECT '[error] File ingest failed (attempts=' || attempts || ' size_bytes=' || coalesce(size_bytes::VARCHAR, '') || ')' AS value FROM lf WHERE status = 'failed'""")
def a28_progress(spark, d):
    failed = _queue(spark, d).where("status = 'failed'")
    rows = crawl.events(failed, "error", F.lit("File ingest failed"), {"size_bytes": F.col("size_bytes"), "attempts": F.col("attempts")}, _now())
    return crawl.progress_lines(rows, as_json=False)


@query(f"WITH {_LATEST_FILES} SELECT item_identifier, name, {_NEEDS} AS needed FROM lf")
def b20_needs_analysis(spark, d):
    return _queue(spark, d).select("item_identifier", "name", crawl.needs_analysis().alias("needed"))


@query("SELECT id, size_bytes, crc32, md5, sha1, sha256, blake3 FROM ufid_file")
def a24_snapshot(spark, d):
    """All files written as two versions of a table and read again."""
    kept = Store(spark, f"{Scratch(spark).root}/store")
    files = table(spark, d, "ufid_file").select("id", "size_bytes", "crc32", "md5", "sha1", "sha256", "blake3")
    kept.write("files", files.limit(0))
    kept.write("files", files)
    return kept.read("files")


@query("SELECT item_identifier, name, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(updated_at) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(updated_at) % 1000000)::VARCHAR, 6, '0') END AS updated FROM ia_ingest_file")
def i33_iso_times(spark, d):
    return table(spark, d, "ia_ingest_file").select("item_identifier", "name", scalars.iso_text(F.col("updated_at")).alias("updated"))


_LABELLED = f"WITH {c._MATCH}, h AS (SELECT alert_id, count(*) AS n FROM m WHERE alert_id % 5 = 3 GROUP BY 1), s AS (SELECT {c._KEYED} AS source_key, CASE WHEN source IS NULL THEN 'Manual' ELSE coalesce(nullif(source, ''), 'observation') END AS label, count(*) AS alert_count, coalesce(sum(h.n), 0)::BIGINT AS hit_count FROM a LEFT JOIN h ON h.alert_id = a.id WHERE a.id % 5 = 3 GROUP BY ALL)"


@query(_LABELLED + " SELECT source_key, label, alert_count, hit_count, row_number() OVER (ORDER BY CASE WHEN source_key = 'manual' THEN 0 ELSE 1 END, lower(label), source_key)::INT AS place FROM s")
def f5_ordered_sources(spark, d):
    """One user's alert sources with their place in the list."""
    a, links, stored = c._stored(spark, d)
    mine = al.alert_sources(a, links.where("user_id = 3"), stored.where("user_id = 3")).drop("user_id")
    order = Window.orderBy(F.when(F.col("source_key") == "manual", 0).otherwise(1), F.lower("label"), "source_key")
    # one row a source
    return al.ordered_sources(mine).withColumn("place", F.row_number().over(order))
