"""Scalar functions on names, sizes, hashes, paths and JSON as column expressions."""

from __future__ import annotations

import mimetypes
import re
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.functions.hashes import HEX_LENGTHS, OPTIONAL, REQUIRED, clean_hash, is_hex, strip

ALGORITHMS = (*REQUIRED, *OPTIONAL)
#: Kinds of metadata rows.
METADATA_TYPES = ("text", "image", "url", "json", "number", "date", "binary", "other")
#: Suffixes of containers and of single compressed files.
CONTAINER_SUFFIXES = ".zip .zipx .jar .war .ear .apk .xpi .crx .tar .tgz .tar.gz .tbz2 .tar.bz2 .txz .tar.xz .tzst .tar.zst".split()
SINGLE_SUFFIXES = ".gz .bz2 .xz .lzma .zst .z .br".split()
OTHER_SUFFIXES = ".7z .rar .cab .arj .lha .lzh .cpio .rpm .deb .wim .swm .esd .chm .msi .nsis .iso .isz .udf .img .nrg .mdf .cdi .ccd .dmg .vhd .vhdx .chd .ecm".split()
EXCLUDED_SUFFIXES = (".cdx.gz", ".warc.gz")
COMPOUND_SUFFIXES = [s for s in CONTAINER_SUFFIXES if s.count(".") > 1]


# -- hashes and identity ---------------------------------------------------------


def algorithm_name(name: str) -> str:
    """The column of an algorithm, however it is written; an unknown one is an error."""
    n = name.lower().replace("-", "")
    if n not in ALGORITHMS:
        raise ValueError(f"Unsupported hash algorithm: {name}")
    return n


def normalized_hashes(m: Column) -> Column:
    """A map of hashes with known algorithms, cleaned values and no blanks."""
    named = F.transform_keys(m, lambda k, v: F.regexp_replace(F.lower(k), "-", ""))
    known = F.map_filter(named, lambda k, v: k.isin(list(ALGORITHMS)))
    return F.map_filter(F.transform_values(known, lambda k, v: clean_hash(v)), lambda k, v: v.isNotNull())


def identity_error(size: Column, hashes: dict[str, Column]) -> Column:
    """Why an observation is no identity: missing hashes first, then the size,
    then the first hash that is not of its form; null if it is one."""
    missing = F.concat_ws(", ", *[F.when(hashes[a].isNull(), F.lit(a)) for a in REQUIRED])
    checks = F.when(missing != "", F.concat(F.lit("Required hashes are missing: "), missing)).when(size.isNull(), "Exact file size is required").when(size < 0, "Exact file size must be a non-negative integer")
    for a in [x for x in ALGORITHMS if x in hashes]:
        n = HEX_LENGTHS[a]
        checks = checks.when(F.length(hashes[a]) != n, f"{a} must be exactly {n} hexadecimal characters").when(hashes[a].isNotNull() & ~is_hex(hashes[a], n), f"{a} must contain only hexadecimal characters")
    return checks


def missing_identity(size: Column, hashes: dict[str, Column]) -> Column:
    """Which parts of a declared identity are missing or unusable, in fixed order."""
    bad = [F.when(F.coalesce(size < 0, F.lit(True)), F.lit("size"))]
    bad += [F.when(~F.coalesce(is_hex(F.lower(strip(hashes[a])), HEX_LENGTHS[a]), F.lit(False)), F.lit(a)) for a in REQUIRED]
    return F.array_compact(F.array(*bad))


def fixity_mismatch(declared: dict[str, Column], actual: dict[str, Column]) -> Column:
    """The strongest declared hash that the actual one contradicts: sha1, md5, crc32."""
    return F.coalesce(*[F.when(clean_hash(declared[a]) != clean_hash(actual[a]), F.lit(a)) for a in ("sha1", "md5", "crc32")])


# -- text, numbers, sizes --------------------------------------------------------


def optional_text(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def optional_size(c: Column) -> Column:
    """A non-negative whole number written as text, else null."""
    n = strip(c.cast("string")).try_cast("long")
    return F.when(n >= 0, n)


SIZE_UNITS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}


def size_limit(text: str) -> int:
    """Bytes of a limit such as 100k, 2M, 1.5GiB (base 1024)."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgtp]?)(?:i?b|bytes?|i)?", str(text).strip().lower())
    if not m:
        raise ValueError("size must be a number optionally followed by K, M, G, T, or P")
    return int(float(m[1]) * 1024 ** SIZE_UNITS[m[2]])


def size_limit_column(c: Column) -> Column:
    pattern = r"^(\d+(?:\.\d+)?)\s*([kmgtp]?)(?:i?b|bytes?|i)?$"
    v = F.lower(strip(c))
    unit = F.create_map(*[x for k, p in SIZE_UNITS.items() for x in (F.lit(k), F.lit(float(1024**p)))])
    return F.when(v.rlike(pattern), F.floor(F.regexp_extract(v, pattern, 1).try_cast("double") * F.try_element_at(unit, F.regexp_extract(v, pattern, 2))))


def contains(query: str, *columns: Column) -> Column:
    """True if any column has the query inside, whatever the case; ``%`` and
    ``_`` of the query stay wildcards, and a backslash is itself."""
    like = "%" + query.replace("\\", "\\\\") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.cast("string").ilike(like), F.lit(False))
    return out


# -- paths and suffixes ----------------------------------------------------------


def archive_path(c: Column) -> Column:
    """Slashes forward, none at the ends; a path of slashes only stays."""
    p = F.btrim(F.translate(c, "\\", "/"), F.lit("/"))
    return F.when(p == "", c).otherwise(p)


def parent_directories(path: Column) -> Column:
    """All directories above a path, shortest first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def archive_suffix(name: Column) -> Column:
    """The suffix that says what archive a name may be; "" for excluded ones.

    Compound suffixes are found in any case; a simple suffix is given as
    written, so upper-case ones are not known as archives below.
    """
    low = F.lower(name)
    out = F.when(F.coalesce(*[F.when(low.endswith(s), F.lit(True)) for s in EXCLUDED_SUFFIXES], F.lit(False)), "")
    for s in sorted(COMPOUND_SUFFIXES, key=len, reverse=True):
        out = out.when(low.endswith(s), s)
    base = F.regexp_extract(F.regexp_replace(name, "/+$", ""), r"([^/]*)$", 1)
    return out.otherwise(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]+)$", 1))


def is_archive_name(name: Column) -> Column:
    return archive_suffix(name).isin(CONTAINER_SUFFIXES + OTHER_SUFFIXES + SINGLE_SUFFIXES)


def is_builtin_archive(name: Column) -> Column:
    return archive_suffix(name).isin(CONTAINER_SUFFIXES + SINGLE_SUFFIXES)


#: Containers that are looked into by outer tools only, by suffix or by words of their format.
OUTER_SUFFIXES = (".iso", ".isz", ".7z", ".rar", ".cab", ".dmg", ".img", ".chd", ".vhd", ".vhdx", ".hfs")
OUTER_FORMATS = ("iso", "7z", "rar", "disk image", "cd-rom", "cd image")


def is_outer_container(name: Column, format_: Column) -> Column:
    """A container the built-in readers do not open, by its suffix or format."""
    low, kind = F.lower(name), F.lower(F.coalesce(format_, F.lit("")))
    out = F.lit(False)
    for s in OUTER_SUFFIXES:
        out = out | low.endswith(s)
    for w in OUTER_FORMATS:
        out = out | kind.contains(w)
    return out & ~is_archive_name(low)


def wants_scan(name: Column, format_: Column) -> Column:
    """A file whose members are looked for: an archive of several files, or a container for outer tools."""
    return F.coalesce((is_archive_name(name) & ~is_single_compressed(name)) | is_outer_container(name, format_), F.lit(False))


def is_single_compressed(name: Column) -> Column:
    return archive_suffix(name).isin(SINGLE_SUFFIXES)


def is_container_name(name: Column) -> Column:
    """A container that the built-in readers open and that is not one compressed file."""
    return is_builtin_archive(name) & ~is_single_compressed(name)


def decompressed_name(name: Column) -> Column:
    """Name of what a single compressed file holds."""
    pattern = "(?i)(" + "|".join(re.escape(s) for s in SINGLE_SUFFIXES) + ")$"
    base = F.regexp_extract(F.regexp_replace(name, pattern, ""), r"([^/]*)/*$", 1)
    return F.when(base == "", "decompressed").otherwise(base)


def quoted(c: Column, keep_slash: bool = True) -> Column:
    """Percent-encoded as a path: letters, digits, - . _ ~ stay, and the slash if kept."""
    q = F.url_encode(c)
    for a, b in (("\\+", "%20"), ("%7E", "~"), ("\\*", "%2A"), *((("%2F", "/"),) if keep_slash else ())):
        q = F.regexp_replace(q, a, b)
    return q


#: Fixed value: names that some file systems keep for devices.
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)))


def safe_component(c: Column) -> Column:
    """One path component that no file system takes for something else, 180 characters at most."""
    v = F.btrim(F.regexp_replace(c, r'[\x00-\x1f<>:"|?*]', "_"), F.lit(" ."))
    v = F.when(v == "", "_").when(F.lower(v).isin(list(RESERVED)), F.concat(F.lit("_"), v)).otherwise(v)
    return F.substring(v, 1, 180)


def safe_path(identifier: Column, name: Column) -> Column:
    """Where a download may go: safe components below the item's own folder; null for
    a name without any."""
    parts = F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda x: ~x.isin("", ".", ".."))
    clean = F.transform(parts, safe_component)
    return F.when(F.size(clean) > 0, F.concat_ws("/", safe_component(identifier), F.array_join(clean, "/")))


def content_type(name: Column) -> Column:
    """The media type a name's suffix tells, by the standard library's table; an
    outer suffix of a compression is looked past."""
    low = F.lower(name)
    inner = F.regexp_replace(low, "(" + "|".join(re.escape(x) for x in sorted(mimetypes.encodings_map, key=len, reverse=True)) + ")$", "")
    pairs = [x for k, v in sorted(mimetypes.types_map.items()) for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(F.regexp_extract(inner, r"([^/]*)$", 1), r"^\.*[^.].*?(\.[^.]+)$", 1))


#: Where items are kept, and names of files a crawl target makes itself.
BASE_URL = "https://archive.org"
ARTIFACT_SUFFIXES = ("_files.xml", "_meta.sqlite", "_meta.xml", "_reviews.xml", "_itemimage.jpg", "_archive.torrent")
ARTIFACT_NAMES = ("files.xml", "meta.sqlite", "meta.xml", "archive.torrent")


def file_url(identifier: Column, name: Column) -> Column:
    """The address of an item's file."""
    return F.concat(F.lit(f"{BASE_URL}/download/"), quoted(identifier, keep_slash=False), F.lit("/"), quoted(name))


def url_with(url: str, parameters: dict[str, str | int] | None = None) -> str:
    """An address with query parameters, after those it has."""
    return f"{url}{'&' if '?' in url else '?'}{urlencode(parameters)}" if parameters else url


def is_artifact(name: Column, format_: Column) -> Column:
    """Whether a file was made by the crawl target: by its format, name or suffix."""
    base = F.lower(F.regexp_extract(F.regexp_replace(name, "/+$", ""), r"([^/]*)$", 1))
    by_name = base.isin(list(ARTIFACT_NAMES))
    for s in ARTIFACT_SUFFIXES:
        by_name = by_name | base.endswith(s)
    return F.coalesce(format_ == "Metadata", F.lit(False)) | F.coalesce(by_name, F.lit(False))


def key_values(items: list[str]) -> dict[str, str]:
    """KEY=VALUE texts as a dictionary; the last value of a key counts."""
    out = {}
    for item in items:
        key, sign, value = item.partition("=")
        if not sign:
            raise ValueError(f"Metadata must be KEY=VALUE: {item}")
        if not key.strip():
            raise ValueError(f"Metadata key cannot be empty: {item}")
        out[key.strip()] = value
    return out


# -- collections -------------------------------------------------------------------

#: Fixed value: how a search for a collection begins.
COLLECTION = "collection:"


def collection_query(identifier: Column) -> Column:
    return F.concat(F.lit(COLLECTION), strip(identifier))


def collection_of(query: Column) -> Column:
    """The collection a search is for; null if it is for something else."""
    q = strip(query)
    name = F.btrim(strip(F.substring(q, len(COLLECTION) + 1, 1 << 30)), F.lit('"'))
    return F.when(F.lower(q).startswith(COLLECTION) & (name != "") & ~name.rlike(r"[\s\x{85}\p{Z}]"), name)


def collection_key(identifier: Column) -> Column:
    """The key under which a collection's crawl is kept, whatever search began it."""
    return F.concat(F.lit("collection::"), strip(identifier))


# -- metadata and JSON -----------------------------------------------------------

ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("metadata_type", "name", "value", "notes")])


def metadata_entries(display_name: Column, description: Column, content_type: Column, extra: Column) -> Column:
    """An array of (metadata_type, name, value, notes): the three fields that are
    not empty as text rows, then the entries of ``extra`` with a value."""
    def plain(n: str, v: Column) -> Column:
        return F.when(v != "", F.struct(F.lit("text").alias("metadata_type"), F.lit(n).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("notes")))

    own = F.array_compact(F.array(plain("filename", display_name), plain("description", description), plain("content_type", content_type)))
    return F.concat(own, F.coalesce(F.filter(extra, lambda e: e["value"].isNotNull()), F.array().cast(T.ArrayType(ENTRY))))


def entry_error(metadata_type: Column, name: Column) -> Column:
    return F.when(~F.lower(metadata_type).isin(list(METADATA_TYPES)), "metadata_type must be one of: " + ", ".join(METADATA_TYPES)).when(F.coalesce(strip(name), F.lit("")) == "", "metadata name is required")


def json_object(c: Column) -> Column:
    """The members of a JSON object as texts; anything else is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def json_list(c: Column) -> Column:
    """The texts of a JSON list; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def expiry(now: Column, seconds: int) -> Column:
    """When what begins now is over, as ISO text."""
    return iso_text(now + F.make_interval(secs=F.lit(seconds)))


def iso_text(c: Column) -> Column:
    """A date or time as ISO text, with microseconds only where there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(c, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def ascii_json(c: Column) -> Column:
    """JSON text with all characters beyond ASCII as \\uXXXX of their UTF-16 units."""
    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), _utf16)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.array_join(units, ""))


def _utf16(ch: Column) -> Column:
    raw = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    return F.when(F.octet_length(ch) == 1, ch).when(F.length(raw) == 4, F.concat(F.lit("\\u"), raw)).otherwise(F.concat(F.lit("\\u"), F.substring(raw, 1, 4), F.lit("\\u"), F.substring(raw, 5, 4)))


def utc_timestamp(c: Column) -> Column:
    """A time with or without an offset; without one it is taken as UTC."""
    return strip(c).try_cast("timestamp")


#: Fixed value: the prefix of names taken over from a record.
RECORD_PREFIX = "org.archive-"


def record_rows(df: DataFrame, json_column: str, skip: list[str], *keep: str) -> DataFrame:
    """(keep..., metadata_type, name, value) for each field of a JSON record that
    is not skipped: a list of scalars gives a row an element, objects and other
    lists stay JSON with sorted keys and ASCII only, numbers stay numbers.

    A kept column must have another name than those made here.
    """
    if clash := {"metadata_type", "name", "value", "key", "v", "field"} & set(keep):
        raise ValueError(f"kept columns may not be called {', '.join(sorted(clash))}")
    v = F.try_parse_json(F.col(json_column))
    obj = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    base = df.select(*keep, obj.alias("v")).where("v is not null")
    fields = base.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*keep, "key", F.col("value").alias("field")).where(~F.col("key").isin(skip))
    kind = F.schema_of_variant("field")
    listed = kind.startswith("ARRAY") & ~kind.contains("OBJECT") & ~kind.startswith("ARRAY<ARRAY") & (kind != "ARRAY<VOID>") & ~kind.contains("VARIANT")
    items = F.when(listed, F.variant_get("field", "$", "array<variant>")).otherwise(F.array("field"))
    rows = fields.select(*keep, "key", F.explode(items).alias("x"))
    k = F.schema_of_variant("x")
    metadata_type = F.when(k == "STRING", "text").when(k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL"), "number").otherwise("json")
    value = F.when(k == "STRING", F.try_variant_get("x", "$", "string")).when(metadata_type == "json", ascii_json(F.to_json("x"))).otherwise(F.to_json("x"))
    return rows.select(*keep, metadata_type.alias("metadata_type"), F.concat(F.lit(RECORD_PREFIX), "key").alias("name"), value.alias("value"))
