"""A resumable crawl as tables: discovered items, queued files, and their states.

State steps are pure functions from tables to tables; ``run_stream`` applies the
merges to a stream of discoveries in ``foreachBatch``, so a restart continues
from the stream's checkpoint and a batch run again gives the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.hashes import clean_hash, strip
from idloom.functions.scalars import collection_key, collection_of, is_container_name, missing_identity, wants_scan
from idloom.session import Scratch, partitions
from idloom.sources import store

ITEM_OPEN, ITEM_RETRY = ("discovered",), ("metadata_failed",)
FILE_OPEN, FILE_RETRY = ("pending", "downloading"), ("failed", "skipped")


def latest(rows: DataFrame, key: list[str], at: str = "updated_at") -> DataFrame:
    """The last row of each key: by time, of equal times the one with the greatest
    hash of the row, so that every run takes the same.

    ``first_seen_at`` becomes the earliest and a null file id is filled by the
    latest known one, as a queue that sees its rows one by one would have it.
    """
    rest = [c for c in rows.columns if c not in key]
    keep = F.max_by(F.struct(*rest), F.struct(F.col(at), F.xxhash64(*rest)))
    aggs = [keep.alias("r")]
    fixed = {}
    if "first_seen_at" in rest:
        aggs.append(F.min("first_seen_at").alias("_first"))
        fixed["first_seen_at"] = F.col("_first")
    if "ufid_file_id" in rest:
        aggs.append(F.max_by("ufid_file_id", F.when(F.col("ufid_file_id").isNotNull(), F.struct(F.col(at), F.col("ufid_file_id")))).alias("_file"))
        fixed["ufid_file_id"] = F.col("_file")
    return rows.groupBy(*key).agg(*aggs).select(*key, *[fixed.get(c, F.col(f"r.{c}")).alias(c) for c in rest])


def merge_items(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Discoveries merged by identifier: a new one starts as discovered, a known
    one keeps its status, attempts and metadata and gets the new title, query and
    kind (which a null does not take away)."""
    new = latest(seen, ["identifier"])
    s = state.alias("s").join(new.alias("n"), "identifier", "full")
    pick = []
    for c in state.columns:
        if c == "identifier":
            pick.append(F.col(c))
        elif c in ("query", "title", "mediatype", "updated_at"):
            pick.append(F.coalesce(f"n.{c}", f"s.{c}").alias(c))
        elif c == "status":
            pick.append(F.coalesce("s.status", F.lit("discovered")).alias(c))
        elif c == "attempts":
            pick.append(F.coalesce("s.attempts", F.lit(0)).alias(c))
        elif c == "first_seen_at":
            pick.append(F.coalesce("s.first_seen_at", "n.first_seen_at").alias(c))
        else:
            pick.append(F.col(f"s.{c}").alias(c))
    return s.select(*pick)


def merge_files(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Queued files merged by (item, name): descriptive columns are replaced, the
    status, attempts and first sight stay, a known file id is never lost."""
    key = ["item_identifier", "name"]
    j = state.alias("s").join(latest(seen, key).alias("n"), key, "full").withColumn("known", F.col("s.first_seen_at").isNotNull())
    pick = []
    for c in state.columns:
        if c in key:
            pick.append(F.col(c))
        elif c == "status":
            pick.append(F.coalesce("s.status", F.lit("pending")).alias(c))
        elif c in ("attempts",):
            pick.append(F.coalesce("s.attempts", F.lit(0)).alias(c))
        elif c in ("first_seen_at", "error", "downloaded_path"):
            pick.append(F.coalesce(f"s.{c}", f"n.{c}").alias(c) if c == "first_seen_at" else F.col(f"s.{c}").alias(c))
        elif c == "ufid_file_id":
            pick.append(F.coalesce("n.ufid_file_id", "s.ufid_file_id").alias(c))
        else:
            pick.append(F.when(F.col("n.updated_at").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return j.select(*pick)


def open_items(items: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    rows = items.where(F.col("status").isin(*ITEM_OPEN, *(ITEM_RETRY if retry_failed else ()))).orderBy("first_seen_at", "identifier")
    return rows if limit is None else rows.limit(max(0, limit))


def open_files(files: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    rows = files.where(F.col("status").isin(*FILE_OPEN, *(FILE_RETRY if retry_failed else ()))).orderBy("first_seen_at", "item_identifier", "name")
    return rows if limit is None else rows.limit(max(0, limit))


def queue_actions(files: DataFrame, original_only: bool = False, max_bytes: int | None = None, retry_failed: bool = False, min_size: int | None = None, max_size: int | None = None, deep: bool = False, archive_scan: bool = True) -> DataFrame:
    """What happens to each open file next: ``action`` (skip, done, defer or fetch) and ``reason``.

    A file done or failed before stays as it is; one that may not be taken is
    skipped; one whose identity is stored and that needs no scan is done; the
    others are fetched unless their download has to wait.
    """
    skip, wait = skip_reason(original_only, max_bytes, retry_failed), defer_reason(min_size, max_size, deep)
    action = F.when(skip.isNotNull(), "skip").when(~needs_analysis(archive_scan), "done").when(wait.isNotNull(), "defer").otherwise("fetch")
    return open_files(files, retry_failed).withColumn("action", action).withColumn("reason", F.when(F.col("action") == "skip", skip).when(F.col("action") == "defer", wait))


def action_updates(actions: DataFrame) -> DataFrame:
    """The marks that ``queue_actions`` ask for; files to defer or to fetch stay as they are."""
    rows = actions.where("action in ('skip', 'done')")
    status = F.when(F.col("action") == "done", "done").when(F.col("reason").isin("done", "failed"), F.col("status")).otherwise("skipped")
    error = F.when((F.col("action") == "skip") & F.col("reason").isin("done", "failed"), F.col("error")).otherwise(F.col("reason"))
    return rows.select("item_identifier", "name", status.alias("status"), error.alias("error"))


def crawl_counters(actions: DataFrame) -> DataFrame:
    """One row of counters over a queue's actions."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("skip", "skipped_files"), ("done", "known_files"), ("defer", "deferred_files"), ("fetch", "fetched_files"))], F.coalesce(F.sum(F.when(F.col("action") == "fetch", F.col("size_bytes"))), F.lit(0)).alias("fetched_bytes"))


# -- marks and getters ---------------------------------------------------------------


def _given(updates: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"u.{name}") if name in updates.columns else F.lit(None).cast(kind)


def mark_items(items: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Items after ``updates`` (identifier, status, error?, metadata_json?, more_attempts?):
    status and error are replaced, a record replaces the stored one if given.
    Identifiers that are not there change nothing; one update an identifier."""
    hit = F.col("u.status").isNotNull()
    j = items.alias("s").join(updates.alias("u"), "identifier", "left")
    new = {
        "status": F.when(hit, F.col("u.status")).otherwise(F.col("s.status")),
        "error": F.when(hit, _given(updates, "error", "string")).otherwise(F.col("s.error")),
        "metadata_json": F.coalesce(_given(updates, "metadata_json", "string"), "s.metadata_json"),
        "attempts": F.col("s.attempts") + F.coalesce(_given(updates, "more_attempts", "int"), F.lit(0)),
        "updated_at": F.when(hit, now).otherwise(F.col("s.updated_at")),
    }
    return j.select(*[F.col(c) if c == "identifier" else new.get(c, F.col(f"s.{c}")).alias(c) for c in items.columns])


def mark_files(files: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Files after ``updates`` (item_identifier, name, status, and ufid_file_id?,
    downloaded_path?, size_bytes?, error?, more_attempts?): status and error are
    replaced, the others only by what is given. One update a file."""
    key = ["item_identifier", "name"]
    hit = F.col("u.status").isNotNull()
    j = files.alias("s").join(updates.alias("u"), key, "left")
    new = {
        "status": F.when(hit, F.col("u.status")).otherwise(F.col("s.status")),
        "error": F.when(hit, _given(updates, "error", "string")).otherwise(F.col("s.error")),
        "attempts": F.col("s.attempts") + F.coalesce(_given(updates, "more_attempts", "int"), F.lit(0)),
        "updated_at": F.when(hit, now).otherwise(F.col("s.updated_at")),
    } | {c: F.coalesce(_given(updates, c, k), f"s.{c}") for c, k in (("ufid_file_id", "long"), ("downloaded_path", "string"), ("size_bytes", "long"))}
    return j.select(*[F.col(c) if c in key else new.get(c, F.col(f"s.{c}")).alias(c) for c in files.columns])


def record_identities(files: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Files after their stored identity is known (item_identifier, name,
    ufid_file_id): what failed or was skipped waits again, errors go."""
    status = F.when(F.col("status").isin(*FILE_RETRY), "pending").otherwise(F.col("status"))
    known = files.join(ids.select("item_identifier", "name", F.col("ufid_file_id").alias("new_id")), ["item_identifier", "name"], "left")
    hit = F.col("new_id").isNotNull()
    new = {"ufid_file_id": F.coalesce("new_id", "ufid_file_id"), "status": F.when(hit, status).otherwise(F.col("status")), "error": F.when(~hit, F.col("error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return known.select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


def get_item(items: DataFrame, identifier: str) -> DataFrame:
    return items.where(F.col("identifier") == identifier).select("identifier", "status", "attempts", "error")


def get_file(files: DataFrame, item_identifier: str, name: str) -> DataFrame:
    return files.where((F.col("item_identifier") == item_identifier) & (F.col("name") == name)).select("item_identifier", "name", "status", "attempts", "ufid_file_id", "error")


def scanned_items(items: DataFrame) -> DataFrame:
    """Items whose record has been read."""
    return items.where(F.col("status").isin("done", "metadata_done"))


def collection_items(items: DataFrame) -> DataFrame:
    """Items that are collections themselves, in the order they were seen."""
    return items.where(F.lower("mediatype") == "collection").orderBy("first_seen_at", "identifier")


def events(rows: DataFrame, level: str, message: Column, details: dict[str, Column] | None, now: Column) -> DataFrame:
    """Log rows (level, item_identifier, file_name, message, details_json, created_at)
    for queue rows; details are JSON with sorted keys, or null."""
    have = set(rows.columns)
    named = lambda *names: next((F.col(n) for n in names if n in have), F.lit(None).cast("string"))
    body = F.to_json(F.struct(*[details[k].alias(k) for k in sorted(details)]), {"ignoreNullFields": "false"}) if details else F.lit(None).cast("string")
    return rows.select(F.lit(level).alias("level"), named("item_identifier", "identifier").alias("item_identifier"), named("file_name", "name").alias("file_name"), message.alias("message"), body.alias("details_json"), now.alias("created_at"))


def progress_lines(rows: DataFrame, as_json: bool = True) -> DataFrame:
    """Log rows as lines of text (``value``): JSON objects, or level and message with details."""
    if as_json:
        details = F.from_json(F.coalesce("details_json", F.lit("{}")), "map<string,string>")
        own = F.create_map(F.lit("level"), F.col("level"), F.lit("message"), F.col("message"))
        return rows.select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, F.map_filter(details, lambda k, v: ~k.isin("level", "message"))))))).alias("value"))
    details = F.map_entries(F.from_json(F.coalesce("details_json", F.lit("{}")), "map<string,string>"))
    tail = F.array_join(F.transform(details, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))), " ")
    return rows.select(F.concat(F.lit("["), "level", F.lit("] "), "message", F.when(tail == "", "").otherwise(F.concat(F.lit(" ("), tail, F.lit(")")))).alias("value"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def declared_identity(files: DataFrame) -> DataFrame:
    """Files with the parts their declared identity lacks and the resulting state."""
    missing = missing_identity(F.col("size_bytes"), {a: F.col(a) for a in ("crc32", "md5", "sha1")})
    return files.withColumn("missing", missing).withColumn("identity_state", F.when(F.size("missing") == 0, "complete").otherwise("incomplete"))


def skip_reason(original_only: bool = False, max_bytes: int | None = None, retry_failed: bool = False):
    """Why a file is not processed: done or failed before, not original, too large; null if it is."""
    r = F.lit(None).cast("string")
    if max_bytes is not None:
        r = F.when(F.col("size_bytes") > max_bytes, F.concat(F.lit("size "), F.col("size_bytes"), F.lit(f" exceeds max {max_bytes}"))).otherwise(r)
    if original_only:
        r = F.when(~F.coalesce(F.col("source") == "original", F.lit(False)), "not original").otherwise(r)
    if not retry_failed:
        r = F.when(F.col("status").isin("done", "failed"), F.col("status")).otherwise(r)
    return r


def defer_reason(min_bytes: int | None = None, max_bytes: int | None = None, deep: bool = False):
    """Why a download waits: below the least size (an unknown size is), above the
    greatest (an unknown one is not), or no clear archive; null if it does not."""
    r = F.lit(None).cast("string") if deep else F.when(~F.coalesce(is_container_name(F.col("name")), F.lit(False)), "not a clearly supported archive")
    if max_bytes is not None:
        r = F.when(F.col("size_bytes") > max_bytes, "above the greatest size").otherwise(r)
    if min_bytes is not None:
        r = F.when(F.coalesce(F.col("size_bytes") < min_bytes, F.lit(True)), "below the least size").otherwise(r)
    return r


def needs_analysis(archive_scan: bool = True):
    """A file must be fetched if its identity is not known, or for a scan of an archive."""
    known = (F.coalesce(F.col("needs_downloaded_identity"), F.lit(0)) == 0) & F.col("ufid_file_id").isNotNull()
    return ~known | (wants_scan(F.col("name"), F.col("format")) & F.lit(archive_scan))


def fixity(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(item_identifier, name, mismatch): the strongest declared hash that the stored file contradicts."""
    from idloom.functions.scalars import fixity_mismatch

    s = stored.select(F.col("id").alias("ufid_file_id"), *[F.col(a).alias(f"actual_{a}") for a in ("crc32", "md5", "sha1")])
    j = files.join(s, "ufid_file_id")
    m = fixity_mismatch({a: F.col(a) for a in ("crc32", "md5", "sha1")}, {a: F.col(f"actual_{a}") for a in ("crc32", "md5", "sha1")})
    return j.select("item_identifier", "name", m.alias("mismatch")).where("mismatch is not null")


def collection_depths(roots: DataFrame, links: DataFrame, most_depth: int = 16, most: int | None = None) -> DataFrame:
    """(collection, depth): collections reached from the roots, each at its least
    depth, names compared in lower case; breadth first, up to ``most_depth``."""
    scratch = Scratch(roots.sparkSession)
    edges = scratch.save(links.select(F.lower("parent").alias("parent"), F.lower("child").alias("child")).distinct(), "edges")
    frontier = scratch.save(roots.select(F.lower("collection").alias("collection"), F.lit(0).alias("depth")).distinct(), "frontier")
    found = frontier
    for depth in range(1, most_depth + 1):
        nxt = frontier.join(edges, frontier.collection == edges.parent).select(F.col("child").alias("collection")).distinct()
        frontier = scratch.save(nxt.join(found.select("collection"), "collection", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.limit(1).count():
            break
        found = scratch.save(found.unionByName(frontier), "found")
    return found if most is None else found.orderBy("depth", "collection").limit(most)


def grown(checkpoints: DataFrame, totals: DataFrame) -> DataFrame:
    """Completed crawls whose collection has more items now than were imported."""
    return checkpoints.where("completed").join(totals, "crawl_key").where(F.col("total") > F.coalesce("imported", F.lit(0))).select("crawl_key", "imported", "total")


def next_checkpoint(old: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoints by key: cursor and completion are replaced, an imported count stays if none is given."""
    j = old.alias("o").join(new.alias("n"), "crawl_key", "full")
    has = F.col("n.completed").isNotNull()
    return j.select("crawl_key", F.when(has, F.col("n.cursor")).otherwise(F.col("o.cursor")).alias("cursor"), F.coalesce("n.completed", "o.completed").alias("completed"), F.coalesce("n.imported", "o.imported").alias("imported"))


def with_aliases(checkpoints: DataFrame, query: str = "query") -> DataFrame:
    """Checkpoints and, for searches for a collection, the same under the
    collection's own key, so that it is found whatever search came to it."""
    alias = collection_key(collection_of(F.col(query)))
    more = checkpoints.withColumn("crawl_key", F.when(alias != F.col("crawl_key"), alias)).where("crawl_key is not null")
    return checkpoints.unionByName(more).dropDuplicates(["crawl_key"])


def discovered(found: DataFrame, query: str, now: Column) -> DataFrame:
    """Rows of a paged search as discovered items; without an identifier there is none."""
    name = strip(F.col("identifier"))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    empty = lambda kind: F.lit(None).cast(kind)
    return found.where(name != "").select(name.alias("identifier"), F.lit(query).alias("query"), text("title").alias("title"), text("mediatype").alias("mediatype"), F.lit("discovered").alias("status"), empty("string").alias("metadata_json"), F.lit(0).alias("attempts"), empty("string").alias("error"), now.alias("first_seen_at"), now.alias("updated_at"))


def to_read(items: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Discovered items whose record is still to be read."""
    done = ("done", "metadata_done") + (() if retry_failed else ("metadata_failed", "failed"))
    return items.where(~F.col("status").isin(*done))


def remaining(most: int | None, processed: int, failed: int) -> int | None:
    """How many more a budget lets through; null is no bound."""
    return None if most is None else max(0, most - processed - failed)


def crawl(spark: SparkSession, module: str, query: str, state_dir: str, checkpoint: str, now: Column, options: dict[str, str] | None = None) -> DataFrame:
    """Page through a search, a page a batch, and merge what it finds into the state;
    goes on after the last page that was merged. Gives the checkpoint row: the key,
    the search, whether it came to its end, and how many items the state has of it."""
    source = spark.readStream.format("paged_search").options(module=module, query=query, **(options or {})).load()
    run_stream(spark, discovered(source, query, now), state_dir, checkpoint)
    state = read_state(spark, state_dir)
    found = state.where(F.col("query") == query).count() if state is not None else 0
    rows = spark.createDataFrame([(query, query, None, True, found)], "crawl_key string, query string, cursor string, completed boolean, imported long")
    return with_aliases(rows)


def run_stream(spark: SparkSession, source: DataFrame, state_dir: str, checkpoint: str, buckets: int | None = None, trigger: dict | None = None) -> None:
    """Merge a stream of discovered items into the state kept in ``state_dir``.

    Batch n reads the newest whole version before n and writes version n, in
    buckets by identifier; a version is whole once its mark is there, which is
    made by one rename after all data. A batch that broke, or that is run again,
    starts from the same version and gives the same. Versions before the one a
    batch read are dropped. A damaged state is an error, never an empty one.
    """
    n_parts = buckets or partitions(spark)

    def step(batch: DataFrame, n: int) -> None:
        seen = [v for v in store.versions(spark, state_dir) if v < n]
        old = store.version(spark, state_dir, seen[-1]) if seen else latest(batch, ["identifier"]).limit(0)
        path = f"{state_dir}/v{n}"
        merge_items(old, batch).repartition(n_parts, "identifier").write.mode("overwrite").parquet(path)
        store.mark(spark, state_dir, n)
        store.drop_versions(spark, state_dir, seen[:-1])

    source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def read_state(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """The newest whole version; None only if there is none yet."""
    seen = store.versions(spark, state_dir)
    return store.version(spark, state_dir, seen[-1]) if seen else None


def clean_declared(files: DataFrame) -> DataFrame:
    return files.withColumns({a: clean_hash(F.col(a)) for a in ("crc32", "md5", "sha1")})
