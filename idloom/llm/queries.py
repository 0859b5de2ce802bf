"""Queries of the operators on training text, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.hashes import WHITE
from idloom.llm import langid, leakage, mixing, mojibake
from idloom.llm.tokens import TOKENIZER
from idloom.session import Scratch, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    members, meta = table(spark, d, "ufid_archive_member"), table(spark, d, "ufid_file_meta")
    return mojibake.rows_of(members, "ufid_archive_member", "id", "archive_path").unionByName(mojibake.rows_of(meta, "ufid_file_meta", "id", "value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(_texts(spark, d)).select("table_name", "row_id")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(_texts(spark, d))


def p3_lost(spark: SparkSession, d: str) -> DataFrame:
    """Garbled rows with characters that stand for something lost."""
    return mojibake.find_garbled(_texts(spark, d)).where(F.col("text").rlike(mojibake.LOST.pattern)).select("table_name", "row_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Passages to remove, merged where those of several items meet."""
    return leakage.removal_spans(_leaks(spark, d))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    leaked = _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("share").alias("largest_share"))
    return table(spark, d, "eval_item").select("item_id").join(leaked, "item_id", "left").fillna(0, ["n_documents"])


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry a whole item word for word, and the item."""
    one = (F.size("spans") == 1) & (F.col("spans")[0]["words"] == F.col("item_words"))
    return _leaks(spark, d).where((F.col("carried_words") == F.col("item_words")) & (F.col("changed_words") == 0) & one).select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, d: str):
    return mixing.prepared(table(spark, d, "documents")), mixing.targets_of(table(spark, d, "mix_target"))


def _kept(spark: SparkSession, d: str):
    """The same with token counts written once, for queries that need them again."""
    docs, targets = _mix(spark, d)
    return Scratch(spark).save(docs, "tokens"), targets


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shortages(*_mix(spark, d)).where("missing_tokens > 0").select("source")


def p8_shortages(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shortages(*_mix(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(*_kept(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_kept(spark, d))


def p8_mixture_check(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_check(*_kept(spark, d))


def p8_pooled(spark: SparkSession, d: str) -> DataFrame:
    """What sources get if copies of a text are one document of all their sources."""
    docs, targets = mixing.pooled(table(spark, d, "documents")), mixing.targets_of(table(spark, d, "mix_target"))
    return mixing.shortages(docs, targets)


#: Labelled texts a language for the prototypes.
SAMPLE = 300


def _languages(spark: SparkSession, d: str, calibrate: bool = True) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.document_languages(docs, langid.fit(langid.sample_of(docs, SAMPLE), calibrate=calibrate))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, d, calibrate=False)).select("doc_id", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "label", F.explode_outer("langs").alias("x")).select("doc_id", "label", "x.lang", "x.share", "x.confidence")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.language_segments(docs, langid.fit(langid.sample_of(docs, SAMPLE), calibrate=True))


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    """The language each document's label names, if any."""
    return table(spark, d, "documents").select("doc_id", langid.label_code(F.col("lang")).alias("label"))


_WS = "'" + "".join(WHITE).replace("'", "''") + "'"
_BLANK = r"\t-\r \x{85}\p{Z}"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+".replace("'", "''")
#: Tokens of each document: a run of blanks before a word is cut before its last
#: blank, then pieces of each word are merged, those of least rank first.
_TOKENS = rf"""WITH RECURSIVE ranks AS MATERIALIZED (SELECT from_base64(t) AS piece, r FROM read_csv('{TOKENIZER}', delim = ' ', header = false, quote = '', columns = {{'t': 'VARCHAR', 'r': 'INTEGER'}})),
 cut AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([{_BLANK}]+)([{_BLANK}][^{_BLANK}])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS part FROM documents),
 words AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(part, '{_SPLIT}')) AS word FROM cut),
 every AS MATERIALIZED (SELECT DISTINCT word, encode(word) AS b FROM words),
 bpe(word, pieces, more) AS (SELECT word, CASE WHEN r.r IS NOT NULL THEN [b] ELSE list_transform(range(octet_length(b)), lambda i: unhex(substr(hex(b), 2 * i + 1, 2))) END, r.r IS NULL FROM every LEFT JOIN ranks r ON r.piece = b
  UNION ALL SELECT word, pieces[1:m - 1] || [pieces[m] || pieces[m + 1]] || pieces[m + 2:], true FROM (SELECT word, any_value(pieces) AS pieces, arg_min(i, (r, i)) AS m FROM (SELECT word, pieces, unnest(range(1, len(pieces))) AS i FROM bpe WHERE more AND len(pieces) > 1) p JOIN ranks ON ranks.piece = pieces[i] || pieces[i + 1] GROUP BY word)),
 counts AS (SELECT word, min(len(pieces)) AS n FROM bpe GROUP BY word),
 tokens AS MATERIALIZED (SELECT doc_id, sum(n) AS tokens FROM words JOIN counts USING (word) GROUP BY doc_id),
 have AS (SELECT nullif(lower(trim(source, {_WS})), '') AS source, coalesce(sum(tokens), 0) AS tokens FROM documents LEFT JOIN tokens USING (doc_id) GROUP BY ALL),
 mix AS (SELECT lower(trim(t.source, {_WS})) AS source, target_share, coalesce(max_repeats, 1) AS max_repeats, ceil(CAST(CAST(target_share AS VARCHAR) AS DECIMAL(18, 12)) * (SELECT sum(tokens) FROM have)::DECIMAL(18, 0))::BIGINT AS quota, coalesce((SELECT tokens FROM have WHERE have.source = lower(trim(t.source, {_WS}))), 0)::BIGINT AS tokens FROM mix_target t),
 got AS (SELECT *, least(quota, max_repeats * tokens)::BIGINT AS routed FROM mix)
"""
_NAMED = " ".join(f"WHEN '{n}' THEN '{code}'" for code, names in langid.LABELS.items() for n in names.split())
_PLAIN = r"' ' || regexp_replace(trim(regexp_replace(lower(nfc_normalize({t})), '[' || chr(39) || '\-\x{{2019}}\x{{2010}}\x{{2011}}\x{{ad}}]', '', 'g')), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g') || ' '"

SQL: dict[str, str] = {
    "p3_lost": " UNION ALL ".join(f"SELECT '{t}' AS table_name, id AS row_id FROM {t} WHERE regexp_matches({c}, '[\\x{{fffd}}\\x{{80}}-\\x{{84}}\\x{{86}}-\\x{{9f}}]')" for t, c in (("ufid_archive_member", "archive_path"), ("ufid_file_meta", "value"))),
    "p7_whole": f"WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN.format(t='text')} AS t FROM documents), e AS MATERIALIZED (SELECT item_id, ' ' || trim({_PLAIN.format(t='text')}) || ' ' AS t FROM eval_item) SELECT DISTINCT doc_id, item_id FROM d JOIN e ON contains(d.t, e.t)",
    "p8_found": _TOKENS + "SELECT source FROM got WHERE quota > max_repeats * tokens",
    "p8_shortages": _TOKENS + "SELECT source, target_share, max_repeats, quota AS quota_tokens, routed AS routed_tokens, quota - routed AS missing_tokens FROM got",
    "p8_mixture_check": _TOKENS + "SELECT source, routed AS routed_tokens, true AS within_a_document, true AS within_repeats FROM got",
    "p9_labels": f"SELECT doc_id, CASE regexp_extract(lower(trim(lang, {_WS})), '^([\\p{{L}}]+)(?:[-_ .(].*)?$', 1) {_NAMED} END AS label FROM documents",
}
QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p3_lost, p7_found, p7_spans, p7_items, p7_whole, p8_found, p8_shortages, p8_mixture, p8_mixture_check, p8_report, p8_pooled, p9_found, p9_languages, p9_segments, p9_labels)}
