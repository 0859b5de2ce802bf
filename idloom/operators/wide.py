"""Attribute-value rows into one typed row for each entity.

Cells are reduced first (count, readable values, least and greatest value, with
map-side combine), so an entity that holds a tenth of all rows sends a few cells
only.  Cells then go to hash buckets of entities; a task dictionary-encodes
entities and attributes, scatters values into one numpy array a type by row and
column index and emits Arrow tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idloom.functions.hashes import strip

#: Signs that may part groups of three digits.
GROUP = ",'\u2019 \xa0\u2009\u202f"
NUMBER = rf"^[+\-]?(?:\d+|\d{{1,3}}(?:([{GROUP}])\d{{3}})(?:\1\d{{3}})*)?(?:\.\d*)?(?:[eE][+\-]?\d+)?$"
#: Digits and signs of other widths and scripts, and what they stand for.
DIGITS = "".join(chr(z + i) for z in (0xFF10, 0x0660, 0x06F0, 0x0966) for i in range(10)) + "\uff0e\uff0c\uff0b\uff0d\u2212\uff0f\uff1a\uff45\uff25"
PLAIN = "0123456789" * 4 + ".,+--/:eE"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else "may" for m in MONTHS) + "|sept)"
TIME = r"(?:[t ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:z|utc|gmt|[ap]m|[+\-]\d{2}:?\d{2})?)?"
#: Written forms of a date: pattern, and which group holds year, month, day.
DATES = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){TIME}$", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})(?:t?\d{6}z?)?$", (1, 2, 3)),
    (rf"^(\d{{1,2}})(?:st|nd|rd|th)?[- .]+{MONTH}\.?,?[- ]+(\d{{4}}){TIME}$", (3, 2, 1)),
    (rf"^{MONTH}\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}){TIME}$", (3, 1, 2)),
    (rf"^(\d{{4}})[- ]+{MONTH}[- ]+(\d{{1,2}}){TIME}$", (1, 2, 3)),
    (rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}){TIME}$", (3, 2, 1)),
    (rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}){TIME}$", (3, 2, 1)),
)


def attribute_name(c: Column) -> Column:
    """Trimmed, lower-cased, runs of blanks, hyphens and underscores as one underscore."""
    return F.regexp_replace(strip(F.lower(c)), r"[\s\x{A0}_-]+", "_")


def read_number(c: Column) -> Column:
    """The value of one plain decimal numeral, else null."""
    v = F.translate(strip(c), DIGITS, PLAIN)
    ok = v.rlike(NUMBER) & v.rlike(r"^[^eE]*\d")
    plain = F.regexp_replace(v, f"[{GROUP}]", "")
    return F.when(ok, plain).try_cast("double")


def read_date(c: Column) -> Column:
    """The day a date names, else null.

    With the day and month both given as numbers and the year last, dots mean
    day first; with slashes or hyphens the order must follow from the numbers
    (one above 12, or both equal), else the text is not readable.
    """
    v = F.lower(F.translate(strip(c), DIGITS, PLAIN))
    names = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(str(i + 1)))])
    tries = []
    for pattern, (y, m, d) in DATES:
        part = [F.regexp_extract(v, pattern, i) for i in (y, m, d)]
        month, day = part[1], part[2]
        if MONTH in pattern:
            month = F.coalesce(names[F.substring(part[1], 1, 3)], F.lit("0"))
        ok = v.rlike(pattern)
        if pattern.startswith(r"^(\d{1,2})[-/]"):
            a, b = day.try_cast("int"), month.try_cast("int")
            month, day = F.when(b > 12, day).otherwise(month), F.when(b > 12, month).otherwise(day)
            ok = ok & ((a > 12) | (b > 12) | (a == b))
        tries.append(F.when(ok, F.concat_ws("-", part[0], F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))))
    return F.coalesce(*tries).try_cast("date")


def cell_states(eav: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row for each entity and wanted attribute that has rows."""
    kinds = dict(columns)
    index = {a: i for i, (a, _) in enumerate(columns)}
    lookup = F.create_map(*[x for a, i in index.items() for x in (F.lit(a), F.lit(i))]) if columns else F.create_map().cast("map<string,int>")
    rows = eav.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("entity"), F.try_element_at(lookup, attribute_name(F.col("name"))).alias("attr"), F.col("value").cast("string").alias("value")).where("attr is not null")
    of = lambda *k: [i for a, i in index.items() if kinds[a] in k]
    number = F.when(F.col("attr").isin(of("number")), read_number(F.col("value")))
    day = F.when(F.col("attr").isin(of("date")), F.datediff(read_date(F.col("value")), F.lit("1970-01-01").cast("date")))
    text = F.when(~F.col("attr").isin(of("number", "date")), F.nullif(strip(F.col("value")), F.lit("")))
    typed = rows.select("entity", "attr", F.coalesce(number, day.cast("double")).alias("num"), text.alias("txt"))
    nums = [F.min("num").alias("num_min"), F.max("num").alias("num_max")]
    if not of(*(k for k in kinds.values() if k not in ("number", "date"))):
        # without texts the aggregate keeps to fixed-width values and hashes
        return typed.groupBy("entity", "attr").agg(*nums).withColumns({c: F.lit(None).cast("string") for c in ("txt_min", "txt_max")})
    return typed.groupBy("entity", "attr").agg(*nums, F.min("txt").alias("txt_min"), F.max("txt").alias("txt_max"))


OK, CONFLICT, UNREADABLE = 1, 2, 3
ISSUES = {CONFLICT: "conflict", UNREADABLE: "unreadable"}
SPARK_TYPE = {"number": T.DoubleType(), "date": T.DateType()}


def _scatter(columns: list[tuple[str, str]], chunk_rows: int):
    names, kinds = [c for c, _ in columns], [k for _, k in columns]
    slot, width = [], {"number": 0, "date": 0, "text": 0}
    for k in kinds:
        group = k if k in ("number", "date") else "text"
        slot.append((group, width[group]))
        width[group] += 1
    group_of = np.array([list(width).index(g) for g, _ in slot], np.int8)
    at = np.array([i for _, i in slot], np.int64)

    def emit(t: pa.Table) -> pa.RecordBatch:
        entity, row = np.unique(t.column("entity").to_numpy(), return_inverse=True)
        attr = t.column("attr").to_numpy().astype(np.int64)
        lo, hi = (t.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("num_min", "num_max"))
        tlo, thi = (np.asarray(t.column(c).to_pandas(), dtype=object) for c in ("txt_min", "txt_max"))
        has_text = np.array([x is not None for x in tlo], bool)
        is_text = group_of[attr] == 2
        readable = np.where(is_text, has_text, ~np.isnan(lo))
        same = np.where(is_text, tlo == thi, lo == hi)
        state = np.where(~readable, UNREADABLE, np.where(same, OK, CONFLICT)).astype(np.int8)
        n = len(entity)
        status = np.zeros((n, len(names)), np.int8)
        status[row, attr] = state
        stores = (np.full((n, width["number"]), np.nan), np.full((n, width["date"]), np.nan), np.full((n, width["text"]), None, object))
        for g, store in enumerate(stores):
            use = (group_of[attr] == g) & (state == OK)
            store[row[use], at[attr[use]]] = (tlo if g == 2 else lo)[use]
        arrays = [pa.array(entity)]
        for g, i in slot:
            col = stores[list(width).index(g)][:, i]
            if g == "number":
                arrays.append(pa.array(col, mask=np.isnan(col)))
            elif g == "date":
                gone = np.isnan(col)
                arrays.append(pa.array(np.where(gone, 0, col).astype(np.int32), mask=gone).cast(pa.date32()))
            else:
                arrays.append(pa.array(col, type=pa.string()))
        r, c = np.nonzero(status > OK)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array([names[i] for i in c], pa.string()), pa.array([ISSUES[s] for s in status[r, c]], pa.string())], ["attribute", "issue"])
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), items))
        return pa.RecordBatch.from_arrays(arrays, names=_out_names(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= chunk_rows:
                e = held.column("entity").to_numpy()
                cut = int(np.searchsorted(e, e[-1], side="left"))
                if cut:
                    yield emit(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held.combine_chunks())

    return run


def _out_names(names: list[str]) -> list[str]:
    """Attribute names that clash with file_id or issues get an underscore."""
    return ["file_id", *[n + "_" if n in ("file_id", "issues") else n for n in names], "issues"]


def wide_columns(spec: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """The wanted columns, in name order; a column list is a schema, so it is bounded."""
    rows = spec.where("attribute is not null").select("attribute", "value_type").distinct().orderBy("attribute").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} wanted columns")
    return list({r[0]: r[1] or "text" for r in rows}.items())


def pivot_wide(eav: DataFrame, columns: list[tuple[str, str]], chunk_rows: int = 60_000) -> DataFrame:
    """One row for each entity that has a wanted attribute: file_id, the typed
    columns, and ``issues``: cells that have rows but not exactly one value
    (``conflict`` if readable ones differ, ``unreadable`` if none is readable).

    Numbers and days compare by value, texts after trimming.  A null value is a
    row that cannot be read; a null entity or name is left out; an empty table
    gives an empty result.  Other columns of the table are ignored.
    """
    cells = cell_states(eav, columns)
    fields = [T.StructField(n, t) for n, t in zip(_out_names([c for c, _ in columns]), [T.LongType(), *[SPARK_TYPE.get(k, T.StringType()) for _, k in columns], T.ArrayType(T.StructType([T.StructField("attribute", T.StringType()), T.StructField("issue", T.StringType())]))])]
    return cells.repartition("entity").sortWithinPartitions("entity").mapInArrow(_scatter(columns, chunk_rows), T.StructType(fields))


def cell_issues(wide: DataFrame) -> DataFrame:
    return wide.select("file_id", F.explode("issues").alias("i")).select("file_id", F.col("i.attribute").alias("attribute"), F.col("i.issue").alias("issue"))
