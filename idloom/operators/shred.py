"""Nested JSON records into related flat tables by shared inlining.

Two passes.  The first walks all records and gathers the schema graph: which
element stands under which, whether it may repeat there, with which scalar
fields.  From the graph follow the tables: an element that stands in a list or
map, under several parents or below itself gets a table of its own; any other is
inlined into the columns of its nearest table.  The second pass emits one row
for each element with a table, with its key and its parent's key.

The graph has element names and fields only, never data; its size is bounded by
``MAX_GRAPH`` and checked.

Nothing of a record is lost but JSON nulls: scalars and lists are fields of
their element, entries of a list that are no objects stay in the list's field,
and what stands where is told by JSON pointers (RFC 6901), so ``a.b`` and
``a_b`` or ``a/b`` never meet.  Records may nest to any depth.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that hold members of a file, and which fields hold the same element.
MEMBER_FIELDS = ("members", "contents", "files")
ELEMENTS = {"members": "file", "contents": "file", "files": "file", "reviews": "review", "replies": "reply"}
MAX_GRAPH = 100_000
SEP = "!/"


class _Bad(ValueError):
    pass


class Numeral(str):
    """A JSON number by its digits."""

    __slots__ = ()


def _refuse(name: str):
    raise _Bad(name)


_DECODER = json.JSONDecoder(parse_float=Numeral, parse_int=Numeral, parse_constant=_refuse, strict=True)
_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:"])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _json(text: str):
    """The value of a complete JSON text; ``_Bad`` if it is none."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep_json(text)
    except _Bad:
        raise
    except ValueError as e:
        raise _Bad(str(e)) from None


def _deep_json(text: str):
    """The same for texts nested too deeply for the recursive decoder."""
    stack, at, end = [], 0, len(text)
    key, want, value = None, "value", None
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise _Bad("no JSON")
        sign, number, word = m.groups()
        at = m.end()
        if want in ("key", "first key"):
            if sign == '"':
                key, at = _string(text, at)
                m = _TOKEN.match(text, at)
                if m is None or m[1] != ":":
                    raise _Bad("no colon")
                at, want = m.end(), "value"
                continue
            if sign != "}" or want == "key":
                raise _Bad("no key")
            value = stack.pop()[0]
        elif want == "next":
            inside = stack[-1][0]
            if sign == ",":
                want = "key" if isinstance(inside, dict) else "value"
                continue
            if sign != ("}" if isinstance(inside, dict) else "]"):
                raise _Bad("no end")
            value = stack.pop()[0]
        elif sign in ("{", "["):
            new = {} if sign == "{" else []
            _put(stack, key, new)
            stack.append((new,))
            want = "first key" if sign == "{" else "first value"
            continue
        elif sign == "]" and want == "first value":
            value = stack.pop()[0]
        elif sign == '"':
            value, at = _string(text, at)
            _put(stack, key, value)
        elif sign is not None:
            raise _Bad("no value")
        else:
            value = Numeral(number) if number is not None else _WORDS[word]
            _put(stack, key, value)
        if not stack:
            if text[at:].strip(" \t\r\n"):
                raise _Bad("more than one value")
            return value
        want = "next"


def _string(text: str, at: int) -> tuple[str, int]:
    try:
        return json.decoder.scanstring(text, at, True)
    except ValueError as e:
        raise _Bad(str(e)) from None


def _put(stack: list, key: str | None, value) -> None:
    if stack and isinstance(stack[-1][0], dict):
        stack[-1][0][key] = value
    elif stack:
        stack[-1][0].append(value)


def dumped(value) -> str:
    """A value as compact JSON, numbers by their digits, at any depth."""
    out, todo = [], [(False, value)]
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict) or isinstance(v, list):
            pairs = list(v.items()) if isinstance(v, dict) else [(None, x) for x in v]
            parts: list[tuple[bool, object]] = [(True, "{" if isinstance(v, dict) else "[")]
            for n, (k, x) in enumerate(pairs):
                lead = "," if n else ""
                parts += [(True, lead if k is None else f"{lead}{json.dumps(clean(k), ensure_ascii=False)}:"), (False, x)]
            parts.append((True, "}" if isinstance(v, dict) else "]"))
            todo.extend(reversed(parts))
        elif isinstance(v, Numeral) or not isinstance(v, str):
            out.append(str(v) if isinstance(v, Numeral) else json.dumps(v))
        else:
            out.append(json.dumps(clean(v), ensure_ascii=False))
    return "".join(out)


def parse(text: str | None):
    """A record's value, with JSON that sits in JSON strings opened; None if unusable."""
    if text is None:
        return None
    try:
        return opened(_json(text))
    except _Bad:
        return None


def opened(value):
    """The list or object inside a JSON string, however often wrapped, else the value as it is."""
    while type(value) is str and value.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        try:
            inner = _json(value)
        except _Bad:
            return value
        if not isinstance(inner, (list, dict)) and type(inner) is not str:
            return value
        value = inner
    return value


def clean(text: str) -> str:
    """Text that UTF-8 can hold: a lone surrogate becomes the replacement character."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def name_of(obj: dict):
    """A file object's own name, if it is a text or number, else None."""
    n = obj.get("name")
    return clean(n) if isinstance(n, str) else None


def step(part: str | int) -> str:
    """One step of a JSON pointer."""
    return "/" + (clean(part).replace("~", "~0").replace("/", "~1") if isinstance(part, str) else str(part))


def entries(value) -> tuple[list[tuple[str, str | None, dict]], list, bool]:
    """(objects with their step and name, entries that are none, whether it may
    hold several) of a collection: a list of objects, one object (if it has a
    name), or a map from name to object, where a ``name`` field of the object,
    even a null one, goes before the key."""
    value = opened(value)
    if isinstance(value, list):
        each = [opened(o) for o in value]
        return [(step(i), name_of(o), o) for i, o in enumerate(each) if isinstance(o, dict)], [o for o in each if not isinstance(o, dict)], True
    if not isinstance(value, dict):
        return [], [value], False
    if (own := name_of(value)) is not None:
        return [("", own, value)], [], False
    got, rest = [], {}
    for key, o in value.items():
        o = opened(o)
        if isinstance(o, dict):
            got.append((step(key), name_of(o) if "name" in o else clean(key), o))
        else:
            rest[key] = o
    return got, [rest] if rest or not got else [], True


# -- pass one: the schema graph ----------------------------------------------------


def parts_of(element: str, obj: dict) -> Iterator[tuple[str, str | None, list[tuple[str, str | None, dict]], str | None, bool]]:
    """(field, element below it, its objects with step and name, its own value as
    text, whether it may hold several) for each field of an object.

    Known collections hold their element; any other object or list of objects is
    an element named by its field.  A field without objects has a value only; a
    list's entries that are no objects are its value.  Nulls are left out.
    """
    for f, v in obj.items():
        if f in ELEMENTS and (f not in MEMBER_FIELDS or element == "file" or (element, f) == ("item", "files")):
            got, rest, many = entries(v)
            if got:
                yield f, ELEMENTS[f], got, dumped(rest) if rest else None, many
                continue
            # the keys of a map are data, and no part of the graph
            if isinstance(v := opened(v), dict):
                yield f, None, [], dumped(v), True
                continue
        v = opened(v) if isinstance(v, str) and v[:1] in ("{", "[") else v
        if isinstance(v, dict):
            if v:
                yield f, f, [("", None, v)], None, False
            else:
                yield f, None, [], "{}", False
        elif isinstance(v, list):
            got = [(step(i), None, o) for i, o in enumerate(v) if isinstance(o, dict)]
            rest = [o for o in v if not isinstance(o, dict)]
            yield f, f if got else None, got, dumped(rest) if rest or not got else None, True
        elif v is not None:
            yield f, None, [], clean(v) if isinstance(v, str) else "true" if v is True else "false", False


def _walk_graph(root: str, obj: dict, links: dict, fields: dict) -> None:
    stack = [(root, obj)]
    while stack:
        element, o = stack.pop()
        for f, child, got, value, many in parts_of(element, o):
            if value is not None:
                fields[element].add(f)
            if child is not None:
                key = (element, clean(child), f)
                links[key] = max(links[key], 2 if many else 1)
                stack.extend((clean(child), x) for _, _, x in got)


def schema_graph(records: DataFrame, root: str) -> tuple[dict[tuple[str, str, str], int], dict[str, set[str]]]:
    """Links (parent, child, field), 2 where the field may hold several and else 1,
    and the scalar fields of every element, over all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, fields = defaultdict(int), defaultdict(set)
        for b in batches:
            for text in b.column(0).to_pylist():
                v = parse(text)
                if isinstance(v, dict):
                    _walk_graph(root, v, links, fields)
        rows = [(p, c, clean(f), n) for (p, c, f), n in links.items()] + [(e, None, clean(f), 1) for e, fs in fields.items() for f in fs]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["parent", "child", "field", "n"])

    got = records.select("metadata_json").where("metadata_json is not null").mapInArrow(run, "parent string, child string, field string, n long").groupBy("parent", "child", "field").agg(F.max("n").alias("n")).limit(MAX_GRAPH + 1).collect()
    if len(got) > MAX_GRAPH:
        raise ValueError("the schema graph is too large; its names look like data")
    links = {(r[0], r[1], r[2]): r[3] for r in got if r[1] is not None}
    fields = defaultdict(set)
    for r in got:
        if r[1] is None:
            fields[r[0]].add(r[2])
    return links, dict(fields)


@dataclass
class Plan:
    """Elements with a table, and for each the pointers of its inlined columns."""

    root: str
    tables: set[str] = field(default_factory=set)
    columns: dict[str, list[str]] = field(default_factory=dict)


def inline_plan(root: str, links: dict[tuple[str, str, str], int], fields: dict[str, set[str]], asked: tuple[str, ...] = ()) -> Plan:
    """Tables by the graph; the elements ``asked`` for have one in any case."""
    parents, kids = defaultdict(set), defaultdict(set)
    for p, c, f in links:
        parents[c].add((p, f))
        kids[p].add((c, f))

    def below(e: str) -> set[str]:
        seen, todo = set(), [c for c, _ in kids[e]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(c for c, _ in kids[x])
        return seen

    plan = Plan(root, {root, *asked})
    for (_, c, _), n in links.items():
        if n > 1 or len(parents[c]) > 1 or c in below(c):
            plan.tables.add(c)
    for t in plan.tables:
        cols, todo = [], [("", t)]
        while todo:
            path, e = todo.pop()
            cols += [path + step(f) for f in fields.get(e, ())]
            todo += [(path + step(f), c) for c, f in kids[e] if c not in plan.tables]
        plan.columns[t] = sorted(cols)
    return plan


# -- pass two: rows ----------------------------------------------------------------


def _walk_rows(plan: Plan, key: str, obj: dict, only: set[str] | None, values: bool) -> Iterator[tuple[str, str, str | None, str | None, str | None, str | None, list]]:
    """(element, id, parent element, parent id, name, path, values) for each element with a table.

    An id is the record's key and the JSON pointer to the object, so it is the
    same in every run and needs no counter.
    """
    own = name_of(obj) if plan.root == "file" else None
    if plan.root == "file" and (own is None or not own.strip()):
        return
    stack = [(plan.root, key, None, None, own, own, obj)]
    while stack:
        element, rid, pe, pid, name, path, o = stack.pop()
        out: list[tuple[str, str]] = []
        wanted = only is None or element in only
        # the object and what is inlined below it, by pointer from here
        todo = [(element, "", o)]
        while todo:
            e, at, x = todo.pop()
            for f, child, got, value, _ in parts_of(e, x):
                here = at + step(f)
                if value is not None and wanted and values:
                    out.append((here, value))
                for s, nm, y in got:
                    if child not in plan.tables:
                        todo.append((child, here + s, y))
                    elif child == "file" and f in MEMBER_FIELDS:
                        if nm is not None and nm.strip():
                            stack.append((child, rid + here + s, element, rid, nm, nm if element != "file" else f"{path}{SEP}{nm}", y))
                    else:
                        stack.append((clean(child), rid + here + s, element, rid, name_of(y), path if child != "file" else None, y))
        if wanted:
            yield element, rid, pe, pid, name, path, out


ROWS = "element string, row_id string, parent_element string, parent_row_id string, identifier string, name string, file_path string, fields map<string,string>"


def shred(records: DataFrame, root: str, key: str, id_columns: list[str], copies: bool = False, asked: tuple[str, ...] = (), only: bool = False, values: bool = True, plan: Plan | None = None) -> DataFrame:
    """All rows of all tables: element, row_id, parent_element, parent_row_id,
    identifier, name, file_path, fields.

    ``key`` names the column with the outer identifier; ``id_columns`` make the
    row_id of a record, together with a hash of its text, so that copies of one
    record get one id and are taken once; with ``copies`` each is taken, which
    spares moving the texts.  Elements ``asked`` for have a table whatever the
    graph says, with ``only`` no others give rows; without ``values`` the fields
    are left empty.  Names are as the record has them; a file without a name (or
    with a blank one) goes with all below it.  Records that are null, not JSON or
    no object give nothing; an empty table gives an empty result.
    """
    plan = plan or plan_of(records, root, asked)
    keep = set(asked) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string())]
        names = ["element", "row_id", "parent_element", "parent_row_id", "identifier", "name", "file_path", "fields"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for outer, rid, text in zip(*(c.to_pylist() for c in b.columns)):
                v = parse(text)
                if not isinstance(v, dict):
                    continue
                for e, i, pe, pi, name, path, got in _walk_rows(plan, rid, v, keep, values):
                    rows.append((e, i, pe, pi, outer, name, path, got))
                    if len(rows) >= 5000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    rid = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_columns], F.md5("metadata_json"))
    rows = records.where("metadata_json is not null").select(F.col(key).cast("string").alias("outer"), rid.alias("rid") if values or not copies else F.lit("").alias("rid"), "metadata_json")
    return (rows if copies else rows.distinct()).mapInArrow(run, ROWS)


def plan_of(records: DataFrame, root: str, asked: tuple[str, ...] = ()) -> Plan:
    return inline_plan(root, *schema_graph(records, root), asked)


def flat_table(rows: DataFrame, plan: Plan, element: str) -> DataFrame:
    """One element's table: row_id, parent_element, parent_row_id, identifier,
    name, file_path and its inlined columns as ``f_<pointer>`` (text; objects and
    lists as JSON), without the pointer's first slash."""
    cols = plan.columns.get(element, [])
    return rows.where(F.col("element") == element).select("row_id", "parent_element", "parent_row_id", "identifier", "name", "file_path", *[F.try_element_at("fields", F.lit(c)).alias(f"f_{c[1:]}") for c in cols])


def file_objects(records: DataFrame, root: str, key: str, id_columns: list[str]) -> DataFrame:
    """(identifier, file_path) of the different file objects at any depth."""
    rows = shred(records, root, key, id_columns, copies=True, asked=("file",), only=True, values=False)
    return rows.where("file_path is not null").select("identifier", "file_path").distinct()
