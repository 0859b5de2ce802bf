"""Crawl records as tables, and a paged search as a data source.

The search source pages by cursor through any function that gives pages, so it
is tested with a fake and needs no network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from idloom.functions.hashes import strip
from idloom.functions.scalars import file_url, missing_identity

LEAST_PAGE = 100
#: Answers that are worth another try.
RETRY_STATUS = (429, 500, 502, 503, 504)
FILE_TEXTS, FILE_HASHES = ("source", "format"), ("md5", "sha1", "crc32")


def _array(v: Column, path: str) -> Column:
    """The entries of a list in a variant, empty where there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def item_files(items: DataFrame, json_column: str = "metadata_json") -> DataFrame:
    """(identifier, name, source, format, size_bytes, md5, sha1, crc32, mtime, raw)
    of records with a list of files.

    An entry counts if it is an object whose name is there and not empty (or 0,
    or false); entries that do not count leave the others alone.  A record that
    is no JSON object, or whose files are no list, gives nothing.
    """
    rec = F.try_parse_json(F.col(json_column))
    entries = F.when(F.schema_of_variant(rec).startswith("OBJECT"), _array(rec, "$.files"))
    rows = items.select("identifier", F.explode(entries).alias("f")).where(F.schema_of_variant("f").startswith("OBJECT"))
    text = lambda n: F.nullif(F.try_variant_get("f", f"$.{n}", "string"), F.lit(""))
    whole = lambda n: strip(F.try_variant_get("f", f"$.{n}", "string")).try_cast("long")
    named = F.schema_of_variant(F.try_variant_get("f", "$.name", "variant"))
    truthy = text("name").isNotNull() & ~((named != "STRING") & text("name").isin("0", "0.0", "false"))
    hashes = [F.nullif(F.lower(strip(text(h))), F.lit("")).alias(h) for h in FILE_HASHES]
    return rows.where(truthy).select("identifier", text("name").alias("name"), *[text(n).alias(n) for n in FILE_TEXTS], whole("size").alias("size_bytes"), *hashes, whole("mtime").alias("mtime"), F.to_json("f").alias("raw"))


def collections(items: DataFrame, json_column: str = "metadata_json") -> DataFrame:
    """(identifier, collection): an item's collections, given as one value or a list of such that are not empty."""
    rec = F.try_parse_json(F.col(json_column))
    rec = F.when(F.schema_of_variant(rec).startswith("OBJECT"), rec)
    one = F.try_variant_get(rec, "$.metadata.collection", "variant")
    kind = F.schema_of_variant(one)
    listed = F.filter(F.transform(_array(one, "$"), lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull() & ~x.isin("", "0", "false"))
    return items.select("identifier", F.explode(F.when(kind.startswith("ARRAY"), listed).when(kind != "VOID", F.array(F.try_variant_get(one, "$", "string")))).alias("collection")).where("collection is not null")


def queue_rows(files: DataFrame, now: Column) -> DataFrame:
    """Files of items (``item_files``) as rows of the file queue, with their address
    and what their declared identity lacks."""
    missing = missing_identity(F.col("size_bytes"), {a: F.col(a) for a in FILE_HASHES})
    rows = files.withColumn("missing", missing)
    lacks = F.size("missing") > 0
    return rows.select(
        F.col("identifier").alias("item_identifier"), "name", "source", "format", "size_bytes", *FILE_HASHES,
        file_url(F.col("identifier"), F.col("name")).alias("url"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("ufid_file_id"), F.lit(None).cast("string").alias("downloaded_path"), F.col("raw").alias("metadata_json"),
        lacks.cast("int").alias("needs_downloaded_identity"), F.when(lacks, "incomplete").otherwise("complete").alias("identity_metadata_status"), F.to_json("missing").alias("identity_metadata_missing"),
        F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), now.alias("first_seen_at"), now.alias("updated_at"),
    )


def backoff_seconds(attempt: int, base: float = 1.0, most: float = 60.0) -> float:
    """Doubling waits with a greatest one; the first attempt is 0."""
    return min(most, base * 2 ** max(0, attempt))


def retry_after_seconds(header: str | None, now: Callable[[], float] = time.time) -> float | None:
    """Seconds to wait that an answer asks for, as a number or as a date; null if it says nothing of use."""
    text = (header or "").strip()
    try:
        return max(0.0, float(text)) if text else None
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - now())
    except (TypeError, ValueError):
        return None


class Gate:
    """Lets calls through no closer together than ``least`` seconds."""

    def __init__(self, least: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.least, self.clock, self.sleep, self.last = least, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and (left := self.last + self.least - now) > 0:
            self.sleep(left)
            now = self.clock()
        self.last = now


def fetch(call: Callable[[], tuple[int, dict, bytes]], retries: int = 5, sleep: Callable[[float], None] = time.sleep, gate: Gate | None = None) -> bytes:
    """Body of a request, tried again on busy answers and broken connections after
    the wait they ask for; no two tries are closer together than the gate lets them."""
    attempt = 0
    while True:
        if gate:
            gate.wait()
        wait = None
        try:
            status, headers, body = call()
        except (OSError, TimeoutError) as e:
            if attempt >= retries:
                raise OSError(f"request failed: {e}") from e
        else:
            if status < 400:
                return body
            if status not in RETRY_STATUS or attempt >= retries:
                raise OSError(f"HTTP {status}")
            wait = retry_after_seconds(headers.get("Retry-After"))
        sleep(backoff_seconds(attempt) if wait is None else wait)
        attempt += 1


class NotFound(LookupError):
    """There is no item of that identifier."""


def item_record(body: bytes | str, identifier: str) -> dict:
    """The record in an answer; an empty list says there is no such item, a field ``error`` what went wrong."""
    got = json.loads(body)
    if got == []:
        raise NotFound(f"item not found: {identifier}")
    if isinstance(got, dict) and "error" in got:
        raise ValueError(str(got["error"]))
    if not isinstance(got, dict):
        raise ValueError(f"unexpected kind of record: {type(got).__name__}")
    return got


RECORDS = "identifier string, metadata_json string, error string"


def fetched_records(identifiers: DataFrame, module: str, retries: int = 5, least_wait: float = 0.25, requests: int = 1) -> DataFrame:
    """(identifier, metadata_json, error) of items, fetched by ``module:function``,
    which gives (status, headers, body) for an identifier.

    At most ``requests`` tasks ask at once, each with ``least_wait`` seconds between
    its requests.  What cannot be fetched is a row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, gate = _search({"module": module}), Gate(least_wait)
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                try:
                    record = item_record(fetch(lambda i=i: ask(i), retries, gate=gate), i)
                    out.append((i, json.dumps(record, sort_keys=True), None))
                except (OSError, LookupError, ValueError) as e:
                    out.append((i, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["identifier", "metadata_json", "error"])

    return identifiers.where("identifier is not null").select("identifier").repartition(requests, "identifier").mapInArrow(run, RECORDS)


def pages(search: Callable[[str, str | None, int], dict], query: str, cursor: str | None = None, count: int = 1000) -> Iterator[tuple[list[dict], str | None]]:
    """(items, next cursor) of a search, page after page until there is no cursor."""
    while True:
        got = search(query, cursor, max(LEAST_PAGE, count))
        cursor = got.get("cursor")
        yield got.get("items") or [], cursor
        if not cursor:
            return


class SearchSource(DataSource):
    """``spark.read.format("paged_search")``: option ``module`` names
    ``module:function``, or ``file.py:function``, for ``search(query, cursor, count)``, ``query`` the query.
    Pages are at least ``least_wait`` seconds apart (0.25), and one that breaks is
    asked for again up to ``retries`` times (5)."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "identifier string, title string, mediatype string, raw string"

    def reader(self, schema) -> "SearchReader":
        return SearchReader(self.options)

    def simpleStreamReader(self, schema) -> "SearchStream":
        return SearchStream(self.options)


def _search(options) -> Callable:
    """The function that ``module`` names, as ``module:function`` or ``file.py:function``."""
    import importlib.util

    module, _, fn = options["module"].rpartition(":")
    if not module.endswith(".py"):
        return getattr(importlib.import_module(module), fn)
    spec = importlib.util.spec_from_file_location("paged_search_module", module)
    loaded = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(loaded)
    return getattr(loaded, fn)


def _paced(options) -> Callable:
    """The search with waits between pages and further tries for broken ones."""
    search, gate, retries = _search(options), Gate(float(options.get("least_wait", 0.25))), int(options.get("retries", 5))

    def ask(query: str, cursor: str | None, count: int) -> dict:
        for attempt in range(retries + 1):
            gate.wait()
            try:
                return search(query, cursor, count)
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(backoff_seconds(attempt))
        raise OSError("no answer")

    return ask


def _row(i: dict) -> tuple:
    return str(i.get("identifier")), i.get("title"), i.get("mediatype"), json.dumps(i, sort_keys=True)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        for items, _ in pages(_paced(self.options), self.options.get("query", "")):
            for i in items:
                yield _row(i)


class SearchStream(SimpleDataSourceStreamReader):
    """A page a batch; the offset is the cursor, so a restart goes on after it."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"cursor": "", "end": "false"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start.get("end") == "true":
            return iter([]), start
        items, cursor = next(pages(_paced(self.options), self.options.get("query", ""), start.get("cursor") or None))
        return iter([_row(i) for i in items]), {"cursor": cursor or "", "end": "false" if cursor else "true"}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end and at.get("end") != "true":
            rows, at = self.read(at)
            yield from rows
