"""Watch lists: alerts on hashes, scans against known files, and their listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.hashes import HEX_LENGTHS, clean_hash, is_hex
from idloom.functions.scalars import ALGORITHMS, ascii_json, contains, optional_size, optional_text
from idloom.operators.identity import append_missing
from idloom.operators.joins import lookup, spread_join
from idloom.operators.provenance import source_label
from idloom.operators.search import PAGE_MOST, hash_rows
from idloom.session import Scratch

FIELDS = ("name", "description", "size_bytes", *ALGORITHMS, "source_type", "source_name", "source_detail")


def fingerprint() -> Column:
    """SHA-256 of the alert's fields as JSON with sorted keys, nulls kept and all
    beyond ASCII escaped as surrogate pairs, so equal alerts have equal ones."""
    hashes = F.struct(*[F.col(a) for a in sorted(ALGORITHMS)]).alias("hashes")
    body = F.struct(*[hashes if n == "hashes" else F.col(n) for n in sorted(("name", "description", "size_bytes", "hashes", "source_type", "source_name", "source_detail"))])
    return F.sha2(ascii_json(F.to_json(body, {"ignoreNullFields": "false"})), 256)


def normalized(alerts: DataFrame) -> DataFrame:
    """Cleaned alerts with ``fingerprint`` and ``error``: a name, a description and
    at least one well-formed hash are needed; a size is optional."""
    have = set(alerts.columns)
    text = lambda n: optional_text(F.col(n)) if n in have else F.lit(None).cast("string")
    cols = {n: text(n) for n in ("name", "description", "source_type", "source_name", "source_detail")}
    cols["size_bytes"] = optional_size(F.col("size_bytes")) if "size_bytes" in have else F.lit(None).cast("long")
    cols |= {a: clean_hash(F.col(a)) if a in have else F.lit(None).cast("string") for a in ALGORITHMS}
    df = alerts.select(*[F.col(c) for c in alerts.columns if c not in FIELDS], *[cols[n].alias(n) for n in FIELDS])
    err = F.when(F.coalesce(*ALGORITHMS).isNull(), "at least one supported hash is required")
    for a in ALGORITHMS:
        err = err.when(F.col(a).isNotNull() & ~is_hex(F.col(a), HEX_LENGTHS[a]), f"{a} must be exactly {HEX_LENGTHS[a]} hexadecimal characters")
    err = err.when(F.col("name").isNull(), "name is required").when(F.col("description").isNull(), "description is required")
    return df.withColumn("error", err).withColumn("fingerprint", F.when(F.col("error").isNull(), fingerprint()))


def import_alerts(alerts: DataFrame, links: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, links, report) after adding normalized alerts with ``user_id``.

    An alert is stored once for all users by its fingerprint and linked to each
    of them; the report counts received, valid, created (links), skipped and
    errors of each user.
    """
    # the cleaned alerts are read by several steps
    incoming = Scratch(incoming.sparkSession).save(incoming, "alerts")
    good = incoming.where("error is null")
    # with no column but the fields, an id is given to new ones
    new = append_missing(alerts, good.select("fingerprint", *FIELDS), ["fingerprint"])
    all_alerts = alerts.select("id", "fingerprint", *FIELDS).unionByName(new.select("id", "fingerprint", *FIELDS))
    wanted = lookup(good.select("user_id", "fingerprint").distinct(), all_alerts.select("fingerprint", F.col("id").alias("alert_id")), ["fingerprint"], "inner").select("user_id", "alert_id")
    fresh = wanted.join(links, ["user_id", "alert_id"], "left_anti")
    counts = incoming.groupBy("user_id").agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    made = fresh.groupBy("user_id").agg(F.count(F.lit(1)).alias("created"))
    report = counts.join(made, "user_id", "left").fillna(0, ["created"]).withColumn("skipped", F.col("valid") - F.col("created"))
    return all_alerts, links.select("user_id", "alert_id").unionByName(fresh), report


def matches(alerts: DataFrame, files: DataFrame) -> DataFrame:
    """(alert_id, file_id, matched_<algorithm>..., size_matched): alerts and files
    that share a hash, and the size if the alert gives one.

    Both sides give one row a hash and join once on (algorithm, value), files
    only with values that an alert asks for; flags are folded by alert and file.
    The result has a row for each alert and file, as a watch list needs.
    """
    asked = hash_rows(alerts, F.col("id").alias("alert_id"), F.col("size_bytes").alias("alert_size"))
    values = asked.select("algorithm", "value").distinct()
    known = hash_rows(files, F.col("id").alias("file_id"), F.col("size_bytes").alias("file_size")).join(values, ["algorithm", "value"], "left_semi")
    hit = spread_join(asked, known, ["algorithm", "value"]).where("alert_size is null or alert_size = file_size")
    flags = [F.max((F.col("algorithm") == a).cast("int")).alias(f"matched_{a}") for a in ALGORITHMS]
    return hit.groupBy("alert_id", "file_id").agg(*flags, F.max(F.col("alert_size").isNotNull().cast("int")).alias("size_matched"))


def matched_list(prefix: str = "matched_") -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"{prefix}{a}") == 1, F.lit(a)) for a in ALGORITHMS]))


def scan(alerts: DataFrame, links: DataFrame, files: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(stored matches after the scan, report): for each user's alerts new matches
    are added with ``found_at`` = now; known ones keep theirs and get new flags;
    none is removed. The report has matched and created by user."""
    found = links.join(matches(alerts, files), "alert_id")
    key = ["user_id", "alert_id", "file_id"]
    flags = [*(f"matched_{a}" for a in ALGORITHMS), "size_matched"]
    both = stored.select(*key, *[F.col(f).alias(f"old_{f}") for f in flags], "found_at").join(found.withColumn("hit", F.lit(True)), key, "full")
    after = both.select(*key, *[F.coalesce(f, f"old_{f}").alias(f) for f in flags], F.coalesce("found_at", now).alias("found_at"))
    report = both.where("hit").groupBy("user_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("found_at").isNull()).alias("created"))
    return after, report


def clear(alerts: DataFrame, links: DataFrame, stored: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, links, matches) after the users' lists are cleared: alerts no other user has go too."""
    left = links.join(users, "user_id", "left_anti")
    return alerts.join(left.select(F.col("alert_id").alias("id")).distinct(), "id", "left_semi"), left, stored.join(users, "user_id", "left_anti")


def source_key() -> Column:
    t, n = F.coalesce("source_type", F.lit("")), F.coalesce("source_name", F.lit(""))
    return F.when((t == "") & (n == ""), "manual").otherwise(F.concat(t, F.lit("|"), n))


def alert_label() -> Column:
    t, n = F.nullif("source_type", F.lit("")), F.nullif("source_name", F.lit(""))
    return F.when(t.isNull() & n.isNull(), "Manual").otherwise(F.coalesce(n, t, F.lit("Imported")))


def alert_sources(alerts: DataFrame, links: DataFrame, stored: DataFrame) -> DataFrame:
    """By user and source of their alerts: how many alerts, how many stored hits."""
    mine = links.join(alerts.select(F.col("id").alias("alert_id"), source_key().alias("source_key"), alert_label().alias("label")), "alert_id")
    hits = stored.groupBy("user_id", "alert_id").agg(F.count(F.lit(1)).alias("hits"))
    return mine.join(hits, ["user_id", "alert_id"], "left").groupBy("user_id", "source_key", "label").agg(F.count(F.lit(1)).alias("alert_count"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hit_count"))


def file_source_hits(stored: DataFrame, members: DataFrame, meta: DataFrame) -> DataFrame:
    """By user and source value: how many matches have it on the file or above it."""
    from idloom.operators.provenance import ancestors, source_rows

    files = stored.select(F.col("file_id").alias("id")).distinct()
    above = ancestors(files, members).select("file_id", "ancestor_id").distinct()
    sources = source_rows(meta).select(F.col("file_id").alias("ancestor_id"), "source_value")
    by_file = above.join(sources, "ancestor_id").select("file_id", "source_value").distinct()
    per_file = stored.groupBy("user_id", "file_id").agg(F.count(F.lit(1)).alias("n"))
    return per_file.join(by_file, "file_id").groupBy("user_id", "source_value").agg(F.sum("n").alias("hit_count"))


def file_sources(stored: DataFrame, members: DataFrame, meta: DataFrame, user_id: int) -> DataFrame:
    """All known source values with a user's hits, 0 where there are none."""
    from idloom.operators.provenance import source_rows

    catalog = source_rows(meta).select("source_value").distinct()
    hits = file_source_hits(stored.where(F.col("user_id") == user_id), members, meta)
    rows = catalog.join(hits.drop("user_id"), "source_value", "left").fillna(0, ["hit_count"])
    return rows.select("source_value", source_label(F.col("source_value")).alias("label"), "hit_count").orderBy(F.when(F.col("source_value") == "internet_archive", 0).otherwise(1), F.lower("source_value"))


def list_alerts(alerts: DataFrame, links: DataFrame, user_id: int, query: str | None = None, limit: int = PAGE_MOST, offset: int = 0) -> DataFrame:
    """One page of a user's alerts, the latest linked first."""
    order = [F.col("created_at").desc()] if "created_at" in links.columns else []
    return _mine(alerts, links, user_id, query).orderBy(*order, F.col("id").desc()).offset(max(offset, 0)).limit(min(max(limit, 1), PAGE_MOST))


def _mine(alerts: DataFrame, links: DataFrame, user_id: int, query: str | None) -> DataFrame:
    mine = links.where(F.col("user_id") == user_id).withColumnRenamed("alert_id", "id").join(alerts, "id")
    return mine.where(contains(query, F.col("id"), *map(F.col, FIELDS))) if query else mine


def count_alerts(alerts: DataFrame, links: DataFrame, user_id: int, query: str | None = None) -> DataFrame:
    """How many alerts of a user a query finds (``n``)."""
    return _mine(alerts, links, user_id, query).agg(F.count(F.lit(1)).alias("n"))


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts as they are shown: with a map of all hashes, without the fingerprint."""
    hashes = F.create_map(*[x for h in ALGORITHMS for x in (F.lit(h), F.col(h))]).alias("hashes")
    return alerts.select(*[c for c in alerts.columns if c != "fingerprint"], hashes)


def ordered_sources(sources: DataFrame) -> DataFrame:
    """Alert sources in their order: what was put in by hand first, then by label and key."""
    return sources.orderBy(F.when(F.col("source_key") == "manual", 0).otherwise(1), F.lower("label"), "source_key")


def given_values(values: list[str] | None) -> list[str]:
    """Values trimmed, without blanks and repeats, in the order given."""
    return list(dict.fromkeys(t for v in values or () if (t := str(v).strip())))


def match_page(rows: DataFrame, limit: int = PAGE_MOST, offset: int = 0) -> DataFrame:
    """One page of matches (``match_rows``), the latest found first."""
    order = [F.col(c).desc() for c in ("found_at", "alert_id", "file_id")]
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), PAGE_MOST))


def match_records(rows: DataFrame) -> DataFrame:
    """Matches as nested records: alert, file (with its source, null without one, and
    its crawled record, null without identifier and address), matched_algorithms,
    size_matched and found_at."""
    hashes = lambda p: F.create_map(*[x for h in ALGORITHMS for x in (F.lit(h), F.col(f"{p}_{h}"))]).alias("hashes")
    created = F.col("alert_created_at") if "alert_created_at" in rows.columns else F.lit(None).cast("timestamp")
    alert = F.struct(F.col("alert_id").alias("id"), *[F.col(f"alert_{c}").alias(c) for c in ("name", "description", "size_bytes")], hashes("alert"), *[F.col(f"alert_{c}").alias(c) for c in ("source_type", "source_name", "source_detail")], created.alias("created_at"))
    source = F.when(F.col("source_value") != "", F.struct("source_file_id", "source_value", source_label(F.col("source_value")).alias("label"), source_label(F.col("source_value")).alias("description"), "external_reference"))
    known = F.coalesce(F.nullif("ia_identifier", F.lit("")), F.nullif("ia_item_url", F.lit(""))).isNotNull()
    record = F.when(known, F.struct(F.col("record_file_id").alias("source_file_id"), F.col("ia_identifier").alias("identifier"), F.col("ia_item_url").alias("item_url"), *[F.col(f"ia_{c}").alias(c) for c in ("file_url", "file_name", "file_source", "file_format")]))
    file = F.struct(F.col("file_id").alias("id"), F.col("file_size_bytes").alias("size_bytes"), "display_name", "content_type", hashes("file"), source.alias("source"), record.alias("record"))
    return rows.select(alert.alias("alert"), file.alias("file"), "matched_algorithms", (F.col("size_matched") == 1).alias("size_matched"), "found_at")


def match_rows(stored: DataFrame, alerts: DataFrame, files: DataFrame, meta: DataFrame, members: DataFrame, query: str | None = None, source_keys: list[str] | None = None, sources: list[str] | None = None, with_sources: bool = True) -> DataFrame:
    """Stored matches with their alert, file, matched hashes and provenance.

    Provenance is joined only if it is asked for or filtered by, so counting
    does not pay for it.
    """
    from idloom.operators.provenance import ancestors, record_origin, source_rows, top_source
    from idloom.operators.search import first_values

    a = alerts.select(F.col("id").alias("alert_id"), *[F.col(c).alias(f"alert_{c}") for c in FIELDS], source_key().alias("source_key"))
    f = files.select(F.col("id").alias("file_id"), F.col("size_bytes").alias("file_size_bytes"), *[F.col(h).alias(f"file_{h}") for h in ALGORITHMS])
    rows = stored.join(a, "alert_id").join(f, "file_id")
    if query:
        hit = meta.where(contains(query, *map(F.col, ("name", "value", "notes")))).select("file_id").distinct().withColumn("meta_hit", F.lit(True))
        text = contains(query, F.col("alert_id"), F.col("file_id"), *[F.col(f"alert_{c}") for c in FIELDS], F.col("file_size_bytes"), *[F.col(f"file_{h}") for h in ALGORITHMS])
        rows = rows.join(hit, "file_id", "left").where(text | F.coalesce("meta_hit", F.lit(False))).drop("meta_hit")
    if given_values(source_keys):
        rows = rows.where(F.col("source_key").isin(given_values(source_keys)))
    ids = stored.select(F.col("file_id").alias("id")).distinct()
    if given_values(sources):
        named = source_rows(meta).where(F.col("source_value").isin(given_values(sources))).select(F.col("file_id").alias("ancestor_id")).distinct()
        rows = rows.join(ancestors(ids, members).join(named, "ancestor_id", "left_semi").select("file_id").distinct(), "file_id", "left_semi")
    rows = rows.withColumn("matched_algorithms", matched_list())
    if with_sources:
        named = first_values(meta, ["filename", "content_type"]).select("file_id", F.nullif("filename", F.lit("")).alias("display_name"), "content_type")
        origin = record_origin(ids, members, meta)
        item = F.coalesce(F.nullif("ia_item_url", F.lit("")), F.concat(F.lit(DETAILS), "ia_identifier"))
        origin = origin.withColumn("ia_item_url", item).withColumnRenamed("source_file_id", "record_file_id")
        rows = rows.join(named, "file_id", "left").join(origin, "file_id", "left").join(top_source(ids, members, meta), "file_id", "left")
    return rows


#: Fixed value: the address of an item's page, before its identifier.
DETAILS = "https://archive.org/details/"
