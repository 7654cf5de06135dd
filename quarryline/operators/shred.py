"""Nested records to related flat tables by shared inlining.

``inline_plan`` analyses a schema as a graph: members that occur once are
inlined into their owner's table as columns named by their path; members that
repeat (arrays, maps) get tables of their own, whose foreign key is the
owner's key and whose own key adds the position or the map key. An element that
is given by value has one owner; only one that is told by its id can be shared.
Members that hold ids are declared (``Ref``), and the graph of these edges is
searched: an element with several edges to it, or one that reaches itself, is
kept in one table of its own and each edge to it becomes link rows; an element
with one edge stays a foreign key in its owner's table. ``shred`` builds the
tables from the plan, ``links`` the link rows.
"""

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ref:
    """Edge of the schema graph: a member that holds ids of ``target``; ``up`` if the element told is the owner of the telling one."""

    target: str
    up: bool = False


def shared_elements(edges: Iterable[tuple[str, str]]) -> set[str]:
    """Elements that several edges (from, to) reach, or that reach themselves."""
    edges = list(edges)
    after: dict[str, set[str]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(x: str) -> set[str]:
        seen, front = set(), set(after.get(x, ()))
        while front:
            seen |= front
            front = {z for y in front for z in after.get(y, ())} - seen
        return seen

    targets = [b for _, b in edges]
    return {x for x in targets if targets.count(x) > 1 or x in reached(x)}


@dataclass
class Table:
    """A flat table: key columns, inlined columns (name -> path), columns that make link rows and how its rows are reached."""

    name: str
    keys: list[str]
    source: str | None = None
    explode: str | None = None
    kind: str = "root"
    columns: dict[str, str] = field(default_factory=dict)
    links: dict[str, Ref] = field(default_factory=dict)


def inline_plan(schema: T.StructType, name: str, keys: list[str], refs: dict[str, Ref] | None = None, edges: Iterable[tuple[str, str]] = ()) -> list[Table]:
    """Tables of a schema, owners before owned.

    ``refs``: members that hold ids, by their dotted path, arrays and maps
    passed over. ``edges`` (from, to) are those of the other elements of the
    graph.
    """
    refs = refs or {}
    shared = shared_elements([*[(name, r.target) for r in refs.values()], *edges])
    root = Table(name, list(keys))
    tables = [root]
    found: set[str] = set()

    def column(table: Table, label: str, path: str, at: str) -> None:
        table.columns[label] = path
        if at in refs:
            found.add(at)
            if refs[at].target in shared:
                table.links[label] = refs[at]

    def walk(table: Table, struct: T.StructType, path: str, label: str, at: str) -> None:
        for f in struct.fields:
            p, n = f"{path}`{f.name}`", f"{label}{f.name}"
            if not at and n in root.keys:
                continue
            while n in table.keys:  # a member of the name of an owner's key
                n = f"item_{n}"
            if isinstance(f.dataType, T.StructType):
                walk(table, f.dataType, p + ".", n + "_", f"{at}{f.name}.")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                repeat(table, f.dataType, p, n, at + f.name)
            else:
                column(table, n, p, at + f.name)

    def repeat(owner: Table, kind: T.DataType, path: str, label: str, at: str) -> None:
        is_map = isinstance(kind, T.MapType)
        child = Table(f"{owner.name}_{label}", [*owner.keys, f"{label}_{'key' if is_map else 'pos'}"], owner.name, path, "map" if is_map else "array")
        tables.append(child)
        item = kind.valueType if is_map else kind.elementType
        if isinstance(item, T.StructType):
            walk(child, item, "`__v`.", "", at + ".")
        elif isinstance(item, (T.ArrayType, T.MapType)):
            repeat(child, item, "`__v`", "item", at)
        else:
            column(child, "value", "`__v`", at)

    walk(root, schema, "", "", "")
    if lost := set(refs) - found:
        raise ValueError(f"no member {', '.join(sorted(lost))} in {name}")
    return tables


def shred(df: DataFrame, name: str, keys: list[str]) -> dict[str, DataFrame]:
    """The tables of ``inline_plan`` over the rows of ``df``, lazily; null or empty repeats give no rows."""
    plan = inline_plan(df.schema, name, keys)
    nested: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for t in plan:
        if t.kind == "root":
            base = df
        else:
            own = nested[t.source]
            pos = t.keys[-1]
            if t.kind == "map":
                base = own.select(*t.keys[:-1], F.explode(F.col(t.explode)).alias(pos, "__v"))
            else:
                base = own.select(*t.keys[:-1], F.posexplode(F.col(t.explode)).alias(pos, "__v"))
        nested[t.name] = base
        out[t.name] = base.select(*t.keys, *[F.col(p).alias(n) for n, p in t.columns.items()])
    return out


def _values(tables: dict[str, Table], table: Table, path: str) -> Column:
    """All values of a member of a table for one row of the root, as an array without nulls."""

    def member(v: Column | None, path: str) -> Column:
        if v is None:
            return F.col(path)
        for part in path.split("`")[3::2]:  # after `__v`
            v = v[part]
        return v

    chain = [table]
    while chain[0].source:
        chain.insert(0, tables[chain[0].source])

    def values(v: Column | None, at: int) -> Column:
        if at == len(chain):
            return F.array(member(v, path))
        own = member(v, chain[at].explode)
        own = F.map_values(own) if chain[at].kind == "map" else own
        # Values of the last table are taken as they are, without an array for each.
        last = at + 1 == len(chain)
        return F.transform(own, lambda x: member(x, path)) if last else F.flatten(F.filter(F.transform(own, lambda x: values(x, at + 1)), lambda x: x.isNotNull()))

    got = values(None, 1)
    return F.filter(F.coalesce(got, F.array().cast("array<string>")), lambda x: x.isNotNull())


def links(df: DataFrame, name: str, scope: list[str], key: str, refs: dict[str, Ref]) -> DataFrame:
    """(*scope, owner, owned): distinct link rows over all edges to shared elements, in one pass over ``df``."""
    plan = {t.name: t for t in inline_plan(df.schema, name, [*scope, key], refs)}
    own = F.col(key)

    def row(up: bool):
        return lambda x: F.struct((x if up else own).alias("owner"), (own if up else x).alias("owned"))

    each = [F.transform(_values(plan, t, t.columns[c]), row(r.up)) for t in plan.values() for c, r in t.links.items()]
    if not each:
        return df.select(*scope, own.alias("owner"), own.alias("owned")).limit(0)
    return df.select(*scope, F.explode(F.concat(*each)).alias("__l")).select(*scope, "__l.owner", "__l.owned").where("owner is not null and owned is not null").distinct()


# ---------------------------------------------------------------- documents of blocks

_TEXT = "text: struct<initialAttributedTexts: struct<text: map<string,string>, attribs: map<string,string>>, segments: array<string>>"
BLOCK = (
    f"id string, version bigint, data struct<type: string, parent_id: string, children: array<string>, {_TEXT}, "
    "cell_set: map<string, struct<block_id: string, merge_info: struct<row_span: bigint, col_span: bigint>>>, cells: array<array<string>>, columns_id: array<string>, rows_id: array<string>>"
)
#: Edges between blocks: a block is told by four members, so it is shared, and it reaches itself.
BLOCK_REFS = {"data.parent_id": Ref("block", up=True), "data.children": Ref("block"), "data.cell_set.block_id": Ref("block"), "data.cells": Ref("block")}
META = "map<string, struct<title: string, owner: struct<open_id: string, dept: struct<name: string>>, members: array<struct<open_id: string, perm: struct<edit: boolean, share: array<struct<to: string>>>>>>>"


def first_blocks(responses: DataFrame) -> DataFrame:
    """(doc_token, block_id, raw, ord): the first block of each id of a document, in rising ord.

    Only responses with code 0 count; null block maps and null doc_tokens give
    no rows, a block that is JSON null is none. Of equal ords the earliest
    captured counts, then the smaller text.
    """
    r = responses.where("code = 0 and doc_token is not null and block_map is not null")
    b = r.select("doc_token", "ord", "captured_at", F.explode(F.from_json("block_map", "map<string,string>")).alias("block_id", "raw")).where("raw is not null")
    first = F.min(F.struct(F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"), "captured_at", "raw"))
    return b.groupBy("doc_token", "block_id").agg(first.alias("f")).select("doc_token", "block_id", "f.raw", "f.ord")


def block_rows(responses: DataFrame) -> DataFrame:
    """(doc_token, block_id, ord, id, version, data, plain): parsed first blocks; ``plain`` is a text given as one string."""
    b = first_blocks(responses)
    return b.select("doc_token", "block_id", "ord", F.from_json("raw", BLOCK).alias("b"), F.get_json_object("raw", "$.data.text.text").alias("plain")).select("doc_token", "block_id", "ord", "b.*", "plain")


def block_tables(responses: DataFrame) -> dict[str, DataFrame]:
    """All tables of the blocks: ``block`` and its repeated members, keyed by doc_token and block_id."""
    return shred(block_rows(responses), "block", ["doc_token", "block_id"])


def meta_rows(responses: DataFrame) -> DataFrame:
    """(doc_token, title, owner, members): the last meta of each document that tells a title, else the last; code 0 only."""
    m = responses.where("code = 0 and meta_map is not null").select("ord", "captured_at", F.explode(F.from_json("meta_map", META)).alias("doc_token", "m")).where("m is not null")
    rank = F.struct((F.coalesce(F.length("m.title"), F.lit(0)) > 0).alias("told"), F.coalesce("ord", F.lit(-1)).alias("ord"), "captured_at", F.to_json("m").alias("text"))
    return m.groupBy("doc_token").agg(F.max_by("m", rank).alias("m")).select("doc_token", "m.*")


def meta_tables(responses: DataFrame) -> dict[str, DataFrame]:
    """Tables of the documents' meta: ``document``, its members and their shares, keyed by doc_token."""
    return shred(meta_rows(responses), "document", ["doc_token"])


def _piece(c: Column) -> Column:
    """A segment given as a string or as an object with text."""
    return F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), c)).otherwise(c)


def text_pieces(responses: DataFrame) -> DataFrame:
    """(doc_token, block_id, piece_no, text): text pieces of all three layouts, in order of key or position, from 0."""
    b = block_rows(responses)
    keyed = F.transform(F.array_sort(F.map_entries("data.text.initialAttributedTexts.text"), lambda x, y: F.when(x["key"].cast("bigint") < y["key"].cast("bigint"), -1).when(x["key"].cast("bigint") > y["key"].cast("bigint"), 1).otherwise(0)), lambda e: e["value"])
    listed = F.transform("data.text.segments", _piece)
    pieces = F.coalesce(keyed, listed, F.when(F.col("plain").isNotNull(), F.array("plain")))
    return b.select("doc_token", "block_id", F.posexplode(pieces).alias("piece_no", "text"))


def block_links(responses: DataFrame) -> DataFrame:
    """(doc_token, parent_block_id, block_id): distinct links between blocks of a document, told by either side.

    Links to ids that are no blocks of the document and links from a block to
    itself are left out.
    """
    b = block_rows(responses).select("doc_token", "block_id", "data")
    told = links(b, "block", ["doc_token"], "block_id", BLOCK_REFS).select("doc_token", F.col("owner").alias("parent_block_id"), F.col("owned").alias("block_id"))
    told = told.where("parent_block_id <> block_id")
    ids = b.select("doc_token", "block_id")
    return told.join(ids, ["doc_token", "block_id"], "left_semi").join(ids.withColumnRenamed("block_id", "parent_block_id"), ["doc_token", "parent_block_id"], "left_semi").select("doc_token", "parent_block_id", "block_id")
