"""Queries of the core data-preparation operators, with SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.hashes import WHITE
from idloom.operators import hierarchy, seen, shred, skew, wide
from idloom.session import count_rows, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circles(hierarchy.links_of(table(spark, d, "ufid_archive_member"))).select(F.col("node").alias("file_id"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "ufid_archive_member"))


def p1_depths(spark: SparkSession, d: str) -> DataFrame:
    return p1_hierarchy(spark, d).drop("full_path")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "ufid_archive_member"))


def p1_subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.subtree_sizes(table(spark, d, "ufid_archive_member"))


def p1_circles(spark: SparkSession, d: str) -> DataFrame:
    """Files of circles, and which circle: its least file."""
    return hierarchy.circles(hierarchy.links_of(table(spark, d, "ufid_archive_member"))).select(F.col("node").alias("file_id"), F.col("circle").alias("circle_id"))


def p1_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as of ``p1_subtree_sizes``, with an eighth of the rows at most left to
    single tasks, so that small tables go through distributed rounds as well."""
    members = table(spark, d, "ufid_archive_member")
    return hierarchy.subtree_sizes(members, min(hierarchy.LOCAL_EDGES, count_rows(members) // 8))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "file_observation"), table(spark, d, "ufid_file")).where("seen").select("obs_id")


def p2_seen(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "file_observation"), table(spark, d, "ufid_file"))


def p2_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(table(spark, d, "file_observation"), table(spark, d, "ufid_file"))


def p2_error_check(spark: SparkSession, d: str) -> DataFrame:
    """The error rates without figures that depend on the hash: whether false answers
    are as many as derived, within six deviations."""
    r = p2_error_rates(spark, d)
    expected = F.col("derived_rate_new") * F.col("new_keys")
    return r.select("remainder_bits", "answers", "stored_keys", "new_keys", "false_new", (F.abs(F.col("false_seen") - expected) <= 6 * F.sqrt(expected) + 1).alias("as_derived"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "ufid_archive_member"), "parent_file_id", "child_file_id").select("field", "file_id")


def p4_members_per_archive(spark: SparkSession, d: str) -> DataFrame:
    return skew.distinct_partners(table(spark, d, "ufid_archive_member"), "parent_file_id", "child_file_id").select(F.col("key").alias("parent_file_id"), "n_rows", F.col("n_partners").alias("n_files"))


def p4_archives_per_file(spark: SparkSession, d: str) -> DataFrame:
    return skew.distinct_partners(table(spark, d, "ufid_archive_member"), "child_file_id", "parent_file_id").select(F.col("key").alias("child_file_id"), "n_rows", F.col("n_partners").alias("n_archives"))


def p4_second_level(spark: SparkSession, d: str) -> DataFrame:
    """Rows two levels below each archive and the bytes of those files."""
    m, f = table(spark, d, "ufid_archive_member"), table(spark, d, "ufid_file")
    inner = skew.eager_join(m, f, "child_file_id", "id", left_by={"archive": F.col("parent_file_id")}, right_sums={"bytes": F.col("size_bytes").cast("decimal(38,0)")})
    out = skew.eager_join(m, inner, "child_file_id", "archive", left_by={"parent_file_id": F.col("parent_file_id")}, right_sums={"n_rows": F.col("pairs"), "n_bytes": F.col("bytes").cast("decimal(38,0)")})
    return out.select("parent_file_id", F.col("n_rows").cast("long"), F.col("n_bytes").cast("string").alias("n_bytes"))


_RECORDS = {"ia_ingest_item": ("item", "identifier", ["identifier"]), "ia_ingest_file": ("file", "item_identifier", ["item_identifier", "name"])}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [shred.file_objects(table(spark, d, t), *how).select(F.lit(t).alias("table_name"), "identifier", "file_path") for t, how in _RECORDS.items()]
    return parts[0].unionByName(parts[1])


def _flat(spark: SparkSession, d: str, element: str, tables: list[str]) -> DataFrame:
    """One element's rows of the tables named, in one shape; their own fields as
    JSON, by pointer in the order of the pointers."""
    parts = []
    for t in tables:
        rows = shred.shred(table(spark, d, t), *_RECORDS[t], asked=(element,), only=True)
        fields = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
        parts.append(rows.select(F.lit(t).alias("table_name"), "row_id", "parent_element", "parent_row_id", "identifier", "name", "file_path", fields.alias("fields")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    how = _RECORDS["ia_ingest_item"]
    records = table(spark, d, "ia_ingest_item")
    plan = shred.plan_of(records, "item", ("item",))
    return shred.flat_table(shred.shred(records, *how, asked=("item",), only=True, plan=plan), plan, "item")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "file", list(_RECORDS))


def p5_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "review", ["ia_ingest_item"])


def p5_replies(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "reply", ["ia_ingest_item"])


def _columns(spark: SparkSession, d: str, *kinds: str) -> list[tuple[str, str]]:
    return [c for c in wide.wide_columns(table(spark, d, "wide_column")) if not kinds or c[1] in kinds]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.cell_issues(wide.pivot_wide(table(spark, d, "ufid_file_meta"), _columns(spark, d, "number", "date")))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.pivot_wide(table(spark, d, "ufid_file_meta"), _columns(spark, d)).drop("issues")


_WS = "'" + "".join(WHITE).replace("'", "''") + "'"
_KEY = "size_bytes, " + ", ".join(f"lower(trim({c}, {_WS})) AS {c}" for c in ("crc32", "md5", "sha1"))
_WHOLE = "size_bytes >= 0 AND regexp_full_match(crc32, '[0-9a-f]{8}') AND regexp_full_match(md5, '[0-9a-f]{32}') AND regexp_full_match(sha1, '[0-9a-f]{40}')"
_SEEN = f"""WITH o AS (SELECT * FROM (SELECT obs_id, {_KEY} FROM file_observation) WHERE {_WHOLE}),
 f AS (SELECT DISTINCT size_bytes, crc32, md5, sha1 FROM (SELECT {_KEY} FROM ufid_file) WHERE {_WHOLE}),
 k AS (SELECT size_bytes, crc32, md5, sha1, min(obs_id) AS first_id FROM o GROUP BY ALL),
 s AS (SELECT o.obs_id, f.md5 IS NOT NULL OR o.obs_id > k.first_id AS seen FROM o JOIN k USING (size_bytes, crc32, md5, sha1) LEFT JOIN f USING (size_bytes, crc32, md5, sha1))
"""
_PARTNERS = "SELECT {a}, count(*) AS n_rows, count(DISTINCT {b}) AS {n} FROM ufid_archive_member WHERE {a} IS NOT NULL GROUP BY {a}"

_EDGES = "SELECT DISTINCT parent_file_id AS p, child_file_id AS c FROM ufid_archive_member WHERE parent_file_id IS NOT NULL AND child_file_id IS NOT NULL"
_REACH = f"WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), r(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM r JOIN e ON r.b = e.p)"
_CLASSES = ", scc AS (SELECT x.a AS node, min(x.b) AS circle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"

SQL = {
    "p1_found": _REACH + " SELECT a AS file_id FROM r WHERE a = b",
    "p1_descendants": _REACH + _CLASSES + " SELECT DISTINCT coalesce(p.circle, a) AS file_id, coalesce(q.circle, b) AS member_id FROM r LEFT JOIN scc p ON p.node = a LEFT JOIN scc q ON q.node = b WHERE coalesce(p.circle, a) <> coalesce(q.circle, b)",
    "p1_circles": _REACH + _CLASSES + " SELECT node AS file_id, circle AS circle_id FROM scc",
    "p1_subtree_sizes": _REACH + " SELECT a AS file_id, count(*) AS n_members FROM r GROUP BY a",
    "p1_rounds": _REACH + " SELECT a AS file_id, count(*) AS n_members FROM r GROUP BY a",
    "p1_depths": _REACH
    + """, ring AS MATERIALIZED (SELECT a FROM r WHERE a = b), g AS MATERIALIZED (SELECT * FROM e WHERE c NOT IN (SELECT a FROM ring)),
 n AS (SELECT p AS node FROM e UNION SELECT c FROM e), w(node, depth, root) AS (SELECT node, 0, node FROM n WHERE node NOT IN (SELECT c FROM g) UNION SELECT g.c, depth + 1, root FROM w JOIN g ON w.node = g.p),
 b AS (SELECT node, min((depth, root)) AS m FROM w GROUP BY node)
SELECT node AS file_id, node IN (SELECT a FROM ring) AS in_circle, CASE WHEN node NOT IN (SELECT a FROM ring) THEN m[1] END AS depth, CASE WHEN node NOT IN (SELECT a FROM ring) THEN m[2] END AS root_file_id FROM b""",
    "p1_hierarchy": _REACH
    + """, ring AS MATERIALIZED (SELECT a FROM r WHERE a = b), pe AS MATERIALIZED (SELECT DISTINCT parent_file_id AS p, child_file_id AS c, coalesce(archive_path, '') AS path FROM ufid_archive_member WHERE parent_file_id IS NOT NULL AND child_file_id IS NOT NULL), g AS MATERIALIZED (SELECT * FROM pe WHERE c NOT IN (SELECT a FROM ring)),
 n AS (SELECT p AS node FROM e UNION SELECT c FROM e), w(node, depth, root) AS (SELECT node, 0, node FROM n WHERE node NOT IN (SELECT c FROM g) UNION SELECT g.c, depth + 1, root FROM w JOIN g ON w.node = g.p),
 b AS MATERIALIZED (SELECT node, min((depth, root)) AS m FROM w GROUP BY node),
 s AS MATERIALIZED (SELECT g.c, g.p, min(path) AS path FROM g JOIN b x ON x.node = g.p JOIN b y ON y.node = g.c WHERE y.m[1] = x.m[1] + 1 AND y.m[2] = x.m[2] GROUP BY ALL),
 f(node, full_path) AS (SELECT node, '' FROM b WHERE m[1] = 0 UNION SELECT s.c, CASE WHEN b.m[1] = 0 THEN s.path ELSE full_path || '!/' || s.path END FROM f JOIN s ON s.p = f.node JOIN b ON b.node = f.node)
SELECT node AS file_id, node IN (SELECT a FROM ring) AS in_circle, CASE WHEN node NOT IN (SELECT a FROM ring) THEN any_value(m[1]) END AS depth, CASE WHEN node NOT IN (SELECT a FROM ring) THEN any_value(m[2]) END AS root_file_id, CASE WHEN node NOT IN (SELECT a FROM ring) THEN min(full_path) END AS full_path FROM b JOIN f USING (node) GROUP BY node""",
    "p2_found": _SEEN + "SELECT obs_id FROM s WHERE seen",
    "p2_seen": _SEEN + "SELECT obs_id, seen FROM s",
    "p2_error_check": _SEEN + "SELECT unnest([4, 8, 12, 32])::INT AS remainder_bits, (SELECT count(*) FROM s) AS answers, (SELECT count(*) FROM f) AS stored_keys, (SELECT count(*) FROM s WHERE NOT seen) AS new_keys, 0::BIGINT AS false_new, true AS as_derived",
    "p4_found": "WITH t AS (SELECT count(*) AS n FROM ufid_archive_member), "
    + " UNION ALL ".join(f"{a}SELECT '{c}' AS field, {c} AS file_id FROM ufid_archive_member WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 0.03 * (SELECT n FROM t)" for a, c in (("x AS (", "parent_file_id"), ("", "child_file_id")))
    + ") SELECT * FROM x",
    "p4_members_per_archive": _PARTNERS.format(a="parent_file_id", b="child_file_id", n="n_files"),
    "p4_archives_per_file": _PARTNERS.format(a="child_file_id", b="parent_file_id", n="n_archives"),
    "p4_second_level": """SELECT a.parent_file_id, count(*) AS n_rows, CAST(sum(f.size_bytes::HUGEINT) AS VARCHAR) AS n_bytes
 FROM ufid_archive_member a JOIN ufid_archive_member b ON a.child_file_id = b.parent_file_id JOIN ufid_file f ON f.id = b.child_file_id WHERE a.parent_file_id IS NOT NULL GROUP BY a.parent_file_id""",
}



def _opened(x: str) -> str:
    """The list or object inside a JSON string, else the value: one wrapping."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND json_type(({x} ->> '$')::JSON) IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN ({x} ->> '$')::JSON ELSE {x} END"


_STEP = "'/' || replace(replace({k}, '~', '~0'), '/', '~1')"
_NAMED = "CASE WHEN json_type({o}, '$.name') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN {o} ->> '$.name' END"
#: Objects of a collection: of a list, one with a name, or of a map; (step, name, object).
_ENTRIES = f"""SELECT CASE WHEN t = 'OBJECT' AND own IS NOT NULL THEN '' ELSE {_STEP.format(k='k')} END AS step, CASE WHEN t = 'OBJECT' AND own IS NOT NULL THEN own WHEN t = 'OBJECT' AND json_type(x, '$.name') IS NULL THEN k ELSE {_NAMED.format(o='x')} END AS name, x
  FROM (SELECT json_type(c) AS t, {_NAMED.format(o='c')} AS own) JOIN (SELECT key AS k, {_opened('value')} AS x FROM json_each(c) UNION ALL SELECT '', c WHERE json_type(c) = 'OBJECT') ON json_type(x) = 'OBJECT' AND (CASE WHEN t = 'OBJECT' AND own IS NOT NULL THEN k = '' ELSE t IN ('OBJECT', 'ARRAY') AND k <> '' END)"""
_RECORDS_SQL = f"""raw AS (SELECT 'ia_ingest_item' AS table_name, 'item' AS element, identifier, identifier || '|' || md5(metadata_json) AS rid, try_cast(metadata_json AS JSON) AS o FROM ia_ingest_item UNION SELECT 'ia_ingest_file', 'file', item_identifier, coalesce(item_identifier, '') || '|' || coalesce(name, '') || '|' || md5(metadata_json), try_cast(metadata_json AS JSON) FROM ia_ingest_file),
 r1 AS (SELECT * REPLACE ({_opened('o')} AS o) FROM raw), r2 AS (SELECT * REPLACE ({_opened('o')} AS o) FROM r1), rec AS MATERIALIZED (SELECT *, {_NAMED.format(o='o')} AS name FROM (SELECT * REPLACE ({_opened('o')} AS o) FROM r2) WHERE json_type(o) = 'OBJECT')"""
_NODES = f"""WITH RECURSIVE {_RECORDS_SQL},
 e(table_name, element, row_id, parent_element, parent_row_id, identifier, name, file_path, o) AS (SELECT table_name, element, rid, NULL::VARCHAR, NULL::VARCHAR, identifier, CASE WHEN element = 'file' THEN name END, CASE WHEN element = 'file' THEN name END, o FROM rec WHERE element = 'item' OR trim(name) <> ''
  UNION ALL SELECT * FROM (SELECT e.table_name, f.child AS element, e.row_id || '/' || f.field || n.step, e.element, e.row_id, e.identifier, n.name, CASE WHEN f.child = 'file' THEN CASE WHEN e.element = 'file' THEN e.file_path || '!/' || n.name ELSE n.name END END AS file_path, n.x
  FROM e JOIN (VALUES ('item', 'files', 'file'), ('file', 'files', 'file'), ('file', 'members', 'file'), ('file', 'contents', 'file'), ('item', 'reviews', 'review'), ('review', 'replies', 'reply'), ('reply', 'replies', 'reply')) f(parent, field, child) ON f.parent = e.element, LATERAL (SELECT {_opened("json_extract(e.o, '$.' || f.field)")} AS c) q, LATERAL ({_ENTRIES}) n) WHERE element <> 'file' OR trim(name) <> ''),
 nodes AS MATERIALIZED (SELECT * FROM e),
 v(table_name, row_id, element, depth, ptr, k, v) AS (SELECT table_name, row_id, element, 0, {_STEP.format(k='j.key')}, j.key, CASE WHEN json_type(j.value) = 'VARCHAR' AND left(j.value ->> '$', 1) IN ('{{', '[') THEN {_opened('j.value')} ELSE j.value END FROM nodes, json_each(nodes.o) j
  UNION ALL SELECT v.table_name, row_id, element, depth + 1, ptr || {_STEP.format(k='j.key')}, j.key, j.value FROM v, json_each(v.v) j WHERE json_type(v.v) = 'OBJECT' AND (depth > 0 OR (element, k) NOT IN (('item', 'files'), ('file', 'files'), ('file', 'members'), ('file', 'contents'), ('item', 'reviews'), ('review', 'replies'), ('reply', 'replies')))),
 w AS (SELECT *, json_type(v) AS t, depth = 0 AND (element, k) IN (('item', 'files'), ('file', 'files'), ('file', 'members'), ('file', 'contents'), ('item', 'reviews'), ('review', 'replies'), ('reply', 'replies')) AS held FROM v),
 fields AS MATERIALIZED (SELECT table_name, row_id, element, ptr, CASE t WHEN 'VARCHAR' THEN v ->> '$' WHEN 'OBJECT' THEN CASE WHEN held AND {_NAMED.format(o='v')} IS NOT NULL THEN NULL WHEN held THEN CASE WHEN len(list_filter(json_extract(v, '$.*'), lambda x: json_type(x) = 'OBJECT')) = 0 THEN v::VARCHAR ELSE (SELECT '[{{' || string_agg(to_json(j.key) || ':' || j.value, ',' ORDER BY j.rowid) || '}}]' FROM json_each(v) j WHERE json_type(j.value) <> 'OBJECT') END WHEN v::VARCHAR = '{{}}' THEN '{{}}' END
   WHEN 'ARRAY' THEN CASE WHEN len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) = 'OBJECT')) = 0 THEN v::VARCHAR WHEN len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) > 0 THEN to_json(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) <> 'OBJECT'))::VARCHAR END WHEN 'NULL' THEN NULL ELSE v::VARCHAR END AS value FROM w),
 flat AS (SELECT n.table_name, n.element, n.row_id, parent_element, parent_row_id, identifier, CASE WHEN n.element = 'file' THEN name ELSE {_NAMED.format(o='o')} END AS name, file_path, '{{' || coalesce(string_agg(to_json(ptr) || ':' || to_json(value), ',' ORDER BY ptr) FILTER (value IS NOT NULL), '') || '}}' AS fields FROM nodes n LEFT JOIN fields f ON f.row_id = n.row_id AND f.table_name = n.table_name AND f.element = n.element GROUP BY ALL)
"""
_FLAT = _NODES + "SELECT table_name, row_id, parent_element, parent_row_id, identifier, name, file_path, fields FROM flat WHERE element = "
SQL["p5_found"] = _NODES + "SELECT DISTINCT table_name, identifier, file_path FROM nodes WHERE element = 'file'"
SQL |= {"p5_files": _FLAT + "'file'", "p5_reviews": _FLAT + "'review'", "p5_replies": _FLAT + "'reply'"}
_ITEM = "created files item_size metadata/collection metadata/description metadata/identifier metadata/mediatype metadata/subject metadata/subject/main metadata/subject/more metadata/title".split()
SQL["p5_items"] = _NODES + "SELECT n.row_id, parent_element, parent_row_id, identifier, NULL::VARCHAR AS name, NULL::VARCHAR AS file_path, " + ", ".join(f"any_value(value) FILTER (ptr = '/{c}') AS \"f_{c}\"" for c in _ITEM) + " FROM nodes n LEFT JOIN fields f ON f.row_id = n.row_id AND f.element = 'item' WHERE n.element = 'item' GROUP BY ALL"

_NUMBER_SQL = r"""CASE WHEN regexp_full_match(v, '[+\-\x{2212}]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+|[0-9]{1,3}(''[0-9]{3})+|[0-9]{1,3}(\x{2019}[0-9]{3})+|[0-9]{1,3}( [0-9]{3})+|[0-9]{1,3}(\x{a0}[0-9]{3})+|[0-9]{1,3}(\x{202f}[0-9]{3})+|[0-9]{1,3}(\x{2009}[0-9]{3})+)?(\.[0-9]*)?([eE][+\-\x{2212}]?[0-9]+)?')
 AND regexp_matches(v, '^[^eE]*[0-9]') THEN try_cast(regexp_replace(replace(v, chr(8722), '-'), '[,''\x{2019} \x{a0}\x{202f}\x{2009}]', '', 'g') AS DOUBLE) END"""
_T = r"([t ]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*(z|utc|gmt|[ap]m|[+\-][0-9]{2}:?[0-9]{2})?)?"
_M = "(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(tember)?|sept|oct(ober)?|nov(ember)?|dec(ember)?)"
_MONTH_NO = "CAST((position(substr({x}, 1, 3) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 AS VARCHAR)"


def _day_sql(pattern: str, y: int, m: int, d: int, named: bool = False, swap: bool = False) -> str:
    part = lambda i: f"regexp_extract(w, '{pattern}', {i})"
    month, day = (_MONTH_NO.format(x=part(m)) if named else part(m)), part(d)
    cond = f"regexp_matches(w, '{pattern}')"
    if swap:
        a, b = f"CAST({part(d)} AS INT)", f"CAST({part(m)} AS INT)"
        month, day = f"CASE WHEN {b} > 12 THEN {part(d)} ELSE {part(m)} END", f"CASE WHEN {b} > 12 THEN {part(m)} ELSE {part(d)} END"
        cond += f" AND (TRY_CAST({part(d)} AS INT) > 12 OR TRY_CAST({part(m)} AS INT) > 12 OR TRY_CAST({part(d)} AS INT) = TRY_CAST({part(m)} AS INT))"
    return f"WHEN {cond} THEN {part(y)} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0')"


_DATE_SQL = (
    "TRY_CAST(CASE "
    + " ".join(
        [
            _day_sql(rf"^([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}}){_T}$", 1, 2, 3),
            _day_sql(r"^([0-9]{4})([0-9]{2})([0-9]{2})(t?[0-9]{6}z?)?$", 1, 2, 3),
            _day_sql(rf"^([0-9]{{1,2}})(?:st|nd|rd|th)?[- .]+{_M}\.?,?[- ]+([0-9]{{4}}){_T}$", 14, 2, 1, named=True),
            _day_sql(rf"^{_M}\.? +([0-9]{{1,2}})(?:st|nd|rd|th)?,? +([0-9]{{4}}){_T}$", 14, 1, 13, named=True),
            _day_sql(rf"^([0-9]{{4}})[- ]+{_M}[- ]+([0-9]{{1,2}}){_T}$", 1, 2, 14, named=True),
            _day_sql(rf"^([0-9]{{1,2}})\.\s?([0-9]{{1,2}})\.\s?([0-9]{{4}}){_T}$", 3, 2, 1),
            _day_sql(rf"^([0-9]{{1,2}})[-/]([0-9]{{1,2}})[-/]([0-9]{{4}}){_T}$", 3, 2, 1, swap=True),
        ]
    ).replace("'^", "'^")
    + " END AS DATE)"
)
_M_GROUPS = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|sept|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATE_SQL = _DATE_SQL.replace(_M, _M_GROUPS).replace(", 14)", ", 3)").replace(", 13)", ", 2)")
_CELLS = rf"""WITH r AS (SELECT file_id, regexp_replace(trim(lower(name), {_WS}), '[\s\x{{a0}}_\-]+', '_', 'g') AS attribute, translate(trim(value, {_WS}), '{wide.DIGITS}', '{wide.PLAIN}') AS v, lower(translate(trim(value, {_WS}), '{wide.DIGITS}', '{wide.PLAIN}')) AS w, trim(value, {_WS}) AS t FROM ufid_file_meta WHERE file_id IS NOT NULL),
 c AS (SELECT file_id, attribute, value_type, CASE WHEN value_type = 'number' THEN {_NUMBER_SQL} END AS num, CASE WHEN value_type = 'date' THEN {_DATE_SQL} END AS day, CASE WHEN value_type NOT IN ('number', 'date') THEN nullif(t, '') END AS txt FROM r JOIN wide_column USING (attribute)),
 s AS (SELECT file_id, attribute, any_value(value_type) AS value_type, CASE WHEN min(num) = max(num) THEN min(num) END AS num, CASE WHEN min(day) = max(day) THEN min(day) END AS day, CASE WHEN min(txt) = max(txt) THEN min(txt) END AS txt, count(num) + count(day) AS n FROM c GROUP BY file_id, attribute)
"""
SQL["p6_found"] = _CELLS + "SELECT file_id, attribute, CASE WHEN n = 0 THEN 'unreadable' ELSE 'conflict' END AS issue FROM s WHERE value_type IN ('number', 'date') AND num IS NULL AND day IS NULL"
_WIDE = {"number": "track_count page_count width_px height_px sector_count volume_number duration_seconds bitrate_kbps", "date": "release_date dumped_at modified_at scanned_on", "txt": "filename title creator publisher platform description comment content_type source ia_identifier ia_item_url alias"}
SQL["p6_wide"] = _CELLS + "SELECT file_id, " + ", ".join(f"any_value({ {'number': 'num', 'date': 'day'}.get(k, k)}) FILTER (attribute = '{a}') AS {a}" for k, v in _WIDE.items() for a in v.split()) + " FROM s GROUP BY file_id"

QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_depths, p1_descendants, p1_subtree_sizes, p1_circles, p1_rounds, p2_found, p2_seen, p2_error_rates, p2_error_check, p4_found, p4_members_per_archive, p4_archives_per_file, p4_second_level, p5_found, p5_items, p5_files, p5_reviews, p5_replies, p6_found, p6_wide)}
