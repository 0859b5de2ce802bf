"""Adding inputs with the members of their archives, and crawled records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions import scalars
from idloom.functions.hashes import clean_hash, strip
from idloom.operators import containment, identity
from idloom.operators.joins import lookup, numbered
from idloom.operators.search import lookup_hashes
from idloom.session import Scratch
from idloom.sources import archives, crawl_source, hashing
from idloom.streaming import crawl

ENTRIES = "array<struct<metadata_type:string,name:string,value:string,notes:string>>"


@dataclass
class Added:
    """Files after the import, its report by path, new metadata rows (member
    errors among them), and new containment rows."""

    files: DataFrame
    report: DataFrame
    metadata: DataFrame
    members: DataFrame


def members_of(inputs: DataFrame) -> DataFrame:
    """(input_id, path, parent_path, name, hashes, error) of inputs (``id``,
    ``name``, ``payload``) and everything inside them; the input's path is empty."""
    own = inputs.select(F.col("id").alias("input_id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.col("name"), F.octet_length("payload").cast("long").alias("size_bytes"), *hashing.column_hashes(F.col("payload")), F.lit(None).cast("string").alias("error"), F.lit(False).alias("is_empty_directory"))
    inner = archives.archive_members(inputs)
    cut = F.regexp_extract("path", r"^(.*)!/", 1)
    last = F.regexp_extract("path", r"([^/]*)/*$", 1)
    return own.unionByName(inner.select(F.col("id").alias("input_id"), "path", cut.alias("parent_path"), last.alias("name"), "size_bytes", "crc32", "md5", "sha1", "sha256", "error", "is_empty_directory"))


def add_inputs(files: DataFrame, meta: DataFrame, members: DataFrame, inputs: DataFrame) -> Added:
    """Hash inputs and all nested members, consolidate them into ``files``, link
    members to their archives, and keep unreadable members as ``archive_error``
    metadata of the archive that holds them.

    Inputs are opened in the order of their id, members by path; an input's content
    type is guessed by its name. A null payload
    is no input. Members without bytes (empty directories, errors) are no files.
    """
    scratch = Scratch(files.sparkSession)
    rows = scratch.save(members_of(inputs.where("payload is not null")), "inputs")
    # a number for each file in one order, as an import is one after another
    real = numbered(rows.where("sha1 is not null"), [F.col("input_id"), F.col("path")], "obs_id")
    real = scratch.save(real.withColumnRenamed("name", "display_name").withColumn("blake3", F.lit(None).cast("string")), "observed")
    none = F.lit(None).cast("string")
    clean = identity.cleaned(real)
    kind = F.when(F.col("path") == "", scalars.content_type(F.col("display_name")))
    entries = scalars.metadata_entries(F.col("display_name"), none, kind, F.lit(None).cast(ENTRIES))
    done = identity.consolidate(files, meta, clean, entries)
    after = scratch.save(done.files, "files")
    ids = scratch.save(identity.probe(clean, after).select("input_id", "path", "file_id"), "ids")
    report = done.report.join(clean.select("seq", "input_id", "path"), "seq")
    parents = ids.select("input_id", F.col("path").alias("parent_path"), F.col("file_id").alias("parent_file_id"))
    inside = lookup(rows.where("parent_path is not null"), parents, ["input_id", "parent_path"], "inner")
    inside = inside.join(ids, ["input_id", "path"], "left")
    inner_path = F.when(F.col("parent_path") == "", F.col("path")).otherwise(F.expr("substring(path, length(parent_path) + 3)"))
    links = inside.where("error is null and (file_id is not null or is_empty_directory)").select("parent_file_id", F.col("file_id").alias("child_file_id"), inner_path.alias("archive_path"))
    errors = inside.where("error is not null").select(F.col("parent_file_id").alias("file_id"), F.lit("text").alias("metadata_type"), F.lit("archive_error").alias("name"), F.col("error").alias("value"), inner_path.alias("notes"))
    names = ids.join(rows.select("input_id", "path", "name"), ["input_id", "path"]).where("name <> ''").select("file_id", F.lit("text").alias("metadata_type"), F.lit("filename").alias("name"), F.col("name").alias("value"), F.lit(None).cast("string").alias("notes"))
    kinds = ids.join(rows.where("path = ''").select("input_id", "path", scalars.content_type(F.col("name")).alias("value")), ["input_id", "path"]).where("value is not null")
    names = names.unionByName(kinds.select("file_id", F.lit("text").alias("metadata_type"), F.lit("content_type").alias("name"), "value", F.lit(None).cast("string").alias("notes")))
    fresh = identity.append_missing(meta.select("id", "file_id", "metadata_type", "name", "value", "notes"), names.unionByName(errors), ["file_id", "metadata_type", "name", "value", "notes"])
    return Added(after, report, fresh, containment.add_members(members, links))


def lookup_inputs(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """(id, algorithm, file_id): stored files found for inputs by their hashes."""
    hashed = inputs.where("payload is not null").select("id", *hashing.column_hashes(F.col("payload")))
    return lookup_hashes(hashed, files, "id")


def split_records(files_of_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, queued): declared files whose identity can be stored at once,
    and those that have to be fetched, with what is missing."""
    parts = {a: F.col(a) for a in ("crc32", "md5", "sha1")}
    rows = files_of_items.withColumn("missing", scalars.missing_identity(F.col("size_bytes"), parts))
    return rows.where("size(missing) = 0").drop("missing"), rows.where("size(missing) > 0")


# -- catalogues ----------------------------------------------------------------------

#: What rows of a catalogue say when they do not, and its source's value.
DAT_TYPE, DAT_NAME, DAT_SOURCE = "logiqx-dat", "Logiqx DAT import", "logiqx_dat"


def _entry(name: str, value: Column, kind: str = "text") -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("metadata_type"), F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("string").alias("notes")))


def catalogue_names() -> dict[str, Column]:
    """Source, set and entry names of a catalogue's row, and the name it goes by."""
    text = lambda c: scalars.optional_text(F.col(c))
    source = F.coalesce(text("source_name"), F.lit(DAT_NAME))
    whole = F.coalesce(text("name"), source)
    return {"type": F.coalesce(text("source_type"), F.lit(DAT_TYPE)), "source": source, "set": whole, "entry": F.coalesce(text("source_detail"), whole), "record": F.coalesce(text("source_detail"), text("name"), F.lit(""))}


def catalogue_entries() -> Column:
    """Metadata of an identity that comes from a catalogue's row."""
    n = catalogue_names()
    rows = [("filename", n["entry"]), ("description", n["set"]), ("source", F.lit(DAT_SOURCE)), ("dat_source_type", n["type"]), ("dat_source_name", n["source"]), ("dat_set_name", n["set"]), ("dat_entry_name", n["entry"]), ("dat_filename", scalars.optional_text(F.col("filename")))]
    return F.array_compact(F.array(*[_entry(k, v) for k, v in rows]))


def catalogue_observations(rows: DataFrame) -> DataFrame:
    """Rows of catalogues (name, size_bytes, hashes, source_type, source_name,
    source_detail, filename, seq) as cleaned observations. A hash given as a blank
    text is given, and so an error."""
    hashes = {a: F.lower(strip(F.col(a))) if a in rows.columns else F.lit(None).cast("string") for a in scalars.ALGORITHMS}
    df = rows.select("seq", scalars.optional_size(F.col("size_bytes")).alias("size_bytes"), *[h.alias(a) for a, h in hashes.items()], *[c for c in rows.columns if c not in (*hashes, "seq", "size_bytes")])
    return df.withColumn("error", scalars.identity_error(F.col("size_bytes"), {a: F.col(a) for a in hashes}))


def import_catalogue(files: DataFrame, meta: DataFrame, rows: DataFrame) -> identity.Imported:
    """Identities of a catalogue's rows, applied in the order of ``seq``."""
    observed = Scratch(files.sparkSession).save(catalogue_observations(rows), "catalogue")
    return identity.consolidate(files, meta, observed, catalogue_entries())


def import_catalogues(files: DataFrame, meta: DataFrame, texts: DataFrame) -> identity.Imported:
    """Catalogue files (text, filename) read and imported, by name and place in the file.
    A file that cannot be read has no rows; see ``dat.dat_rows`` for its error."""
    from idloom.sources import dat

    rows = dat.dat_rows(texts).where("error is null").drop("error")
    return import_catalogue(files, meta, numbered(rows, [F.col("filename"), F.col("place")], "seq"))


def import_counts(imported: identity.Imported) -> DataFrame:
    """received, valid, created, enriched, unchanged, skipped and errors of an import."""
    n = {s: F.count_if(F.col("status") == s) for s in ("created", "enriched", "unchanged", "error", "conflict")}
    every = F.count(F.lit(1))
    return imported.report.agg(every.alias("received"), (every - n["error"]).alias("valid"), n["created"].alias("created"), n["enriched"].alias("enriched"), n["unchanged"].alias("unchanged"), (n["error"] + n["conflict"]).alias("skipped"), (n["error"] + n["conflict"]).alias("errors"))


# -- crawled items -------------------------------------------------------------------

#: The source of crawled files, and the tag of those the target makes itself.
CRAWL_SOURCE, ARTIFACT_TAG = "internet_archive", "IA Artefacts"
ITEM_PAGE = f"{scalars.BASE_URL}/details/"


def declared_entries() -> Column:
    """Metadata of a crawled file (columns of ``crawl_source.item_files``)."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = [
        _entry("filename", text("name")), _entry("source", F.lit(CRAWL_SOURCE)), _entry("ia_identifier", F.col("identifier")), _entry("ia_file_name", F.col("name")),
        _entry("ia_item_url", F.concat(F.lit(ITEM_PAGE), "identifier"), "url"), _entry("ia_file_url", scalars.file_url(F.col("identifier"), F.col("name")), "url"),
        _entry("tag", F.when(scalars.is_artifact(F.col("name"), F.col("format")), F.lit(ARTIFACT_TAG))),
        _entry("ia_file_source", text("source")), _entry("ia_file_format", text("format")), _entry("ia_declared_size", text("size_bytes")), _entry("ia_declared_mtime", text("mtime")),
        *[_entry(f"ia_declared_{h}", text(h)) for h in ("md5", "sha1", "crc32")],
    ]
    return F.array_compact(F.array(*rows))


@dataclass
class Crawled:
    """The queue after items are read, the items after it, and the import of the
    files whose declared identity is whole."""

    items: DataFrame
    queue: DataFrame
    imported: identity.Imported


def process_items(files: DataFrame, meta: DataFrame, items: DataFrame, queue: DataFrame, records: DataFrame, now: Column) -> Crawled:
    """Apply fetched records (identifier, metadata_json, error) to the items they are of.

    A record's files are merged into the queue; those with a whole declared
    identity are stored at once, by item and name, and the queue gets their ids.
    An item without a record is marked with its error and one more attempt.
    """
    scratch = Scratch(files.sparkSession)
    failed = F.col("error").isNotNull()
    marks = records.select("identifier", F.when(failed, "metadata_failed").otherwise("metadata_done").alias("status"), "error", "metadata_json", failed.cast("int").alias("more_attempts"))
    listed = scratch.save(crawl_source.item_files(records.where(~failed)).dropDuplicates(["identifier", "name"]), "listed")
    seen = crawl_source.queue_rows(listed, now)
    merged = crawl.merge_files(queue, seen.select(*queue.columns))
    whole = numbered(split_records(listed)[0], [F.col("identifier"), F.col("name")], "obs_id")
    clean = scratch.save(identity.cleaned(whole.withColumn("blake3", F.lit(None).cast("string"))), "declared")
    done = identity.consolidate(files, meta, clean, declared_entries())
    ids = identity.probe(clean.where("error is null"), done.files).select(F.col("identifier").alias("item_identifier"), "name", F.col("file_id").alias("ufid_file_id"))
    return Crawled(crawl.mark_items(items, marks, now), crawl.record_identities(merged, ids, now), done)


@dataclass
class Processed:
    """The queue after downloads, and what they added."""

    queue: DataFrame
    added: Added


def process_downloads(files: DataFrame, meta: DataFrame, members: DataFrame, queue: DataFrame, downloads: DataFrame, now: Column, verify: bool = True) -> Processed:
    """Apply downloads (item_identifier, name, payload, error) to queued files.

    A payload whose hashes contradict what the item declares fails, as a download
    that broke does; the others are hashed, stored with all members of archives,
    and done. Failed files keep the reason and count one more attempt.
    """
    scratch = Scratch(files.sparkSession)
    key = ["item_identifier", "name"]
    declared = queue.select(*key, *[clean_hash(F.col(h)).alias(f"said_{h}") for h in ("crc32", "md5", "sha1")])
    hashed = downloads.select(*key, "payload", "error", F.octet_length("payload").cast("long").alias("size_bytes"), *hashing.column_hashes(F.col("payload"), ("crc32", "md5", "sha1")))
    wrong = scalars.fixity_mismatch({h: F.col(f"said_{h}") for h in ("crc32", "md5", "sha1")}, {h: F.col(h) for h in ("crc32", "md5", "sha1")})
    reason = F.coalesce("error", F.when(F.col("payload").isNull(), F.lit("nothing was downloaded")), F.when(F.lit(verify) & wrong.isNotNull(), F.concat(F.lit("declared "), wrong, F.lit(" mismatch for "), "item_identifier", F.lit("/"), "name")))
    checked = hashed.join(declared, key).withColumn("reason", reason)
    checked = scratch.save(numbered(checked, [F.col(k) for k in key], "id"), "downloads")
    good = checked.where("reason is null")
    added = add_inputs(files, meta, members, good.select("id", "name", "payload"))
    ids = identity.probe(good.select(*key, *identity.KEY), added.files)
    done = ids.select(*key, F.lit("done").alias("status"), F.col("file_id").alias("ufid_file_id"), "size_bytes", F.lit(None).cast("string").alias("error"), F.lit(0).alias("more_attempts"))
    lost = checked.where("reason is not null").select(*key, F.lit("failed").alias("status"), F.lit(None).cast("long").alias("ufid_file_id"), F.lit(None).cast("long").alias("size_bytes"), F.col("reason").alias("error"), F.lit(1).alias("more_attempts"))
    return Processed(crawl.mark_files(queue, done.unionByName(lost), now), added)
