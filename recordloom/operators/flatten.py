"""Nested records to related flat tables (problem 4).

Method: structural-variant tables. A bottom-up tree automaton gives every JSON
value a state: a scalar has the state of its type, a list the state of the set
of its elements' states, an object the state of its sorted (key, state) pairs.
The state of an object is its structural variant. Objects at the same place
(the pointer with list positions taken out) form a supertype; its common keys
are those every variant there has. Each variant, the root's too, is routed to its
own typed subtype table; lists and their scalar elements go to typed element
tables. Every row keeps record, pointer and parent pointer, so that the records
(with text that stands for JSON opened) can be rebuilt from the tables.

Routing is one exchange by variant (``routed``), rebalanced by size: a variant
that holds a third of all rows is spread over many tasks, rare ones share one.
On disk a variant is a run of row groups, found by their statistics.

Reading is one pass in Arrow batches, a record at a time, so neither a large
record nor a hot namespace needs more than one record's values in memory.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.arrow import strings
from recordloom.functions.ids import canonical_uuid
from recordloom.functions.jsontext import NOTHING, allow_big_numbers, parse, unwrap

FIELDS = ("payload_json", "evidence_json", "tags_json")
#: Type names of the automaton's leaves.
LEAVES = {type(None): "null", bool: "bool", int: "int", float: "float", str: "text"}
_NODES = "record_id string, field string, pointers array<string>, parents array<int>, kinds array<string>, variants array<string>"


def _state(interned: dict, shape: tuple) -> str:
    """The state of a list (the set of its elements' states) or an object (its sorted key and state pairs): 16 hexadecimal digits."""
    got = interned.get(shape)
    if got is None:
        if len(interned) > 200_000:
            interned.clear()
        text = "\x1e".join(x if type(x) is str else f"{x[0]}\x1f{x[1]}" for x in shape)
        got = interned[shape] = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return got


def _object_state(interned: dict, shape: list) -> str:
    shape.sort()
    return _state(interned, ("{}", *shape))


def _list_state(interned: dict, states: set) -> str:
    return _state(interned, ("[]", *sorted(states)))


def _esc(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1") if "~" in key or "/" in key else key


def walk(root: Any, interned: dict) -> tuple[list[str], list[int], list[str], list[str | None]]:
    """Pointers, lengths of the parents' pointers, types and variants of all values that are rows."""
    pointers: list[str] = []
    parents: list[int] = []
    kinds: list[str] = []
    variants: list[str | None] = []
    leaves = LEAVES

    def visit_object(value: dict, ptr: str, up: int) -> str:
        shape = []
        for key, v in value.items():
            t = type(v)
            if t is str:
                head = v[:1]
                if head == "{" or head == "[" or head.isspace():
                    v = unwrap(v)
                    t = type(v)
            if t is dict:
                at = f"{ptr}/{_esc(key)}"
                pointers.append(at)
                parents.append(up)
                kinds.append("object")
                k = len(variants)
                variants.append(None)
                s = variants[k] = visit_object(v, at, len(at))
            elif t is list:
                s = visit_list(v, f"{ptr}/{_esc(key)}", up)
            else:
                s = leaves[t]
            shape.append((key, s))
        return _object_state(interned, shape)

    def visit_list(value: list, ptr: str, up: int) -> str:
        states = set()
        for i, v in enumerate(value):
            t = type(v)
            if t is str:
                head = v[:1]
                if head == "{" or head == "[" or head.isspace():
                    v = unwrap(v)
                    t = type(v)
            at = f"{ptr}/{i}"
            pointers.append(at)
            parents.append(up)
            if t is dict:
                kinds.append("object")
                k = len(variants)
                variants.append(None)
                s = variants[k] = visit_object(v, at, len(at))
            elif t is list:
                kinds.append("list")
                variants.append(None)
                s = visit_list(v, at, len(at))
            else:
                s = leaves[t]
                kinds.append(s)
                variants.append(None)
            states.add(s)
        return _list_state(interned, states)

    if type(root) is dict:
        visit_object(root, "", 0)
    elif type(root) is list:
        visit_list(root, "", 0)
    return pointers, parents, kinds, variants


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    allow_big_numbers()
    interned: dict = {}
    for batch in batches:
        ids = batch.column(0)
        for f, field in enumerate(FIELDS):
            # Small slices: Arrow lists of one field for a few hundred records at a time.
            column = batch.column(f + 1)
            for start in range(0, batch.num_rows, 512):
                offsets, ps, us, ks, vs = [0], [], [], [], []
                for text in column.slice(start, 512).to_pylist():
                    root = parse(text)
                    if root is not NOTHING:
                        try:
                            p, u, k, v = walk(root, interned)
                        except RecursionError:
                            sys.setrecursionlimit(1_000_000)
                            p, u, k, v = walk(root, interned)
                        ps += p
                        us += u
                        ks += k
                        vs += v
                    offsets.append(len(ps))
                if not ps:
                    continue
                off = pa.array(offsets, pa.int32())
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, 512), pa.array([field] * n, pa.string()), pa.ListArray.from_arrays(off, strings(ps)), pa.ListArray.from_arrays(off, pa.array(us, pa.int32())),
                        pa.ListArray.from_arrays(off, pa.array(ks, pa.string())), pa.ListArray.from_arrays(off, pa.array(vs, pa.string())),
                    ],
                    ["record_id", "field", "pointers", "parents", "kinds", "variants"],
                )


def one_delivery(records: DataFrame, *columns: str) -> DataFrame:
    """One row for each record id with the named columns of one of its rows.

    Rows of one record say the same, so any will do; the one with most columns
    filled is taken, ties by content. Grouping combines before the shuffle, so
    an id delivered a million times arrives once from each task.
    """
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    best = F.max(F.struct(filled.alias("filled"), *columns)).alias("b")
    return records.withColumn("record_id", canonical_uuid(F.col("id"))).where(F.col("record_id").isNotNull()).groupBy("record_id").agg(best).select("record_id", *[F.col(f"b.{c}").alias(c) for c in columns])


def nested_nodes(records: DataFrame) -> DataFrame:
    """record_id, field, pointer, parent_pointer, kind, variant for every value that is a row.

    A row is each value below the root that is an object or an element of a
    list. Null, empty and damaged JSON gives no row, nor does an empty table; a
    record delivered twice counts once; text that stands for JSON is read on;
    of a repeated key the last holds. Columns beside id and the three JSON
    columns are ignored. ``variant`` is null but for objects.
    """
    rows = one_delivery(records, *FIELDS).mapInArrow(_flatten, _NODES)
    each = rows.select("record_id", "field", F.explode(F.arrays_zip("pointers", "parents", "kinds", "variants")).alias("n"))
    return each.select("record_id", "field", F.col("n.pointers").alias("pointer"), F.substring(F.col("n.pointers"), F.lit(1), F.col("n.parents")).alias("parent_pointer"), F.col("n.kinds").alias("kind"), F.col("n.variants").alias("variant"))


def routed(rows: DataFrame) -> DataFrame:
    """Rows (with kind and variant) brought to their subtype table's tasks: objects by variant, everything else by its type."""
    return rows.withColumn("_subtype", F.coalesce("variant", "kind")).hint("rebalance", F.col("_subtype")).drop("_subtype")


_OBJECTS = "record_id string, field string, pointers array<string>, parents array<int>, places array<string>, variants array<string>, members array<map<string,string>>, types array<map<string,string>>"
_ELEMENTS = "record_id string, field string, pointers array<string>, parents array<int>, places array<string>, kinds array<string>, texts array<string>"


def _step(key: str) -> str:
    """A key in a place; a lone star, which marks list positions there, is written ~2."""
    return "~2" if key == "*" else _esc(key)


def _scalar(v: Any) -> str | None:
    return v if type(v) is str else None if v is None else json.dumps(v)


def table_rows(root: Any, interned: dict) -> tuple[list[tuple], list[tuple]]:
    """(objects, elements) that hold the whole value.

    objects: pointer, length of the parent's pointer, place, variant, [(key, text, type)] of the scalar members.
    elements: pointer, length of the parent's pointer, place, type, text; every list, every scalar in a list, and a scalar root.
    The root has no parent (null).
    """
    objects: list[Any] = []
    elements: list[tuple] = []

    def visit(v: Any, ptr: str, up: int | None, place: str, row: bool) -> str:
        t = type(v)
        if t is dict:
            k = len(objects)
            objects.append(None)
            shape, own = [], []
            for key, x in v.items():
                x = unwrap(x)
                if type(x) is dict or type(x) is list:
                    s = visit(x, f"{ptr}/{_esc(key)}", len(ptr), f"{place}/{_step(key)}", False)
                else:
                    s = LEAVES[type(x)]
                    own.append((key, _scalar(x), s))
                shape.append((key, s))
            variant = _object_state(interned, shape)
            objects[k] = (ptr, up, place, variant, own)
            return variant
        if t is list:
            elements.append((ptr, up, place, "list", None))
            inner = len(ptr) if row else up
            return _list_state(interned, {visit(unwrap(x), f"{ptr}/{i}", inner, f"{place}/*", True) for i, x in enumerate(v)})
        elements.append((ptr, up, place, LEAVES[t], _scalar(v)))
        return LEAVES[t]

    visit(root, "", None, "", True)
    return objects, elements


def _lists(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _tables(which: int):
    """Task body: the objects (0) or the elements (1) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_big_numbers()
        interned: dict = {}
        for batch in batches:
            for f, field in enumerate(FIELDS):
                for start in range(0, batch.num_rows, 512):
                    ids, column = batch.column(0).slice(start, 512), batch.column(f + 1).slice(start, 512)
                    offsets, rows = [0], []
                    for text in column.to_pylist():
                        root = parse(text)
                        if root is not NOTHING:
                            try:
                                rows += table_rows(root, interned)[which]
                            except RecursionError:
                                sys.setrecursionlimit(1_000_000)
                                rows += table_rows(root, interned)[which]
                        offsets.append(len(rows))
                    if not rows:
                        continue
                    ps, us, at, x, y = zip(*rows)
                    head = [ids, pa.array([field] * len(ids), pa.string()), _lists(offsets, strings(list(ps))), _lists(offsets, pa.array(us, pa.int32())), _lists(offsets, strings(list(at))), _lists(offsets, pa.array(x, pa.string()))]
                    if which:
                        yield pa.RecordBatch.from_arrays([*head, _lists(offsets, strings(list(y)))], ["record_id", "field", "pointers", "parents", "places", "kinds", "texts"])
                        continue
                    at = [0]
                    for own in y:
                        at.append(at[-1] + len(own))
                    keys, texts, kinds = (strings([m[i] for own in y for m in own]) for i in range(3))
                    maps = [_lists(offsets, pa.MapArray.from_arrays(pa.array(at, pa.int32()), keys, v)) for v in (texts, kinds)]
                    yield pa.RecordBatch.from_arrays([*head, *maps], ["record_id", "field", "pointers", "parents", "places", "variants", "members", "types"])

    return run


def _each(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    each = rows.select("record_id", "field", F.explode(F.arrays_zip("pointers", "parents", "places", *names)).alias("n"))
    return each.select("record_id", "field", F.col("n.pointers").alias("pointer"), F.substring(F.col("n.pointers"), F.lit(1), F.col("n.parents")).alias("parent_pointer"), F.col("n.places").alias("place"), *[F.col(f"n.{k}").alias(v) for k, v in names.items()])


def object_rows(records: DataFrame) -> DataFrame:
    """Every object, the root (pointer '', parent null) included: record_id, field, pointer, parent_pointer, place, variant, members (its scalars as text), types (their types)."""
    return _each(one_delivery(records, *FIELDS).mapInArrow(_tables(0), _OBJECTS), {"variants": "variant", "members": "members", "types": "types"})


def element_rows(records: DataFrame) -> DataFrame:
    """What the object rows do not hold: record_id, field, pointer, parent_pointer, place, kind, value (as text).

    A row is each list (value null; also an empty one, a member, the root),
    each scalar element of a list, and a scalar that is the whole column.
    ``parent_pointer`` is as in ``nested_nodes``; null at the root.
    """
    return _each(one_delivery(records, *FIELDS).mapInArrow(_tables(1), _ELEMENTS), {"kinds": "kind", "texts": "value"})


def variant_catalog(objects: DataFrame) -> DataFrame:
    """field, place, variant, n_objects, types, keys, common_keys: the supertypes and their variants.

    ``types`` gives the type of each scalar key, which is the same in all
    objects of a variant; ``common_keys`` holds the keys of every variant at the
    place.
    """
    v = objects.groupBy("field", "place", "variant").agg(F.count(F.lit(1)).alias("n_objects"), F.any_value("types").alias("types")).withColumn("keys", F.array_sort(F.map_keys("types")))
    per_key = v.select("field", "place", F.explode("keys").alias("key")).groupBy("field", "place", "key").agg(F.count(F.lit(1)).alias("n_with"))
    per_place = v.groupBy("field", "place").agg(F.count(F.lit(1)).alias("n_variants"))
    common = per_key.join(per_place, ["field", "place"]).where(F.col("n_with") == F.col("n_variants")).groupBy("field", "place").agg(F.array_sort(F.collect_list("key")).alias("common_keys"))
    return v.join(common, ["field", "place"], "left").withColumn("common_keys", F.coalesce("common_keys", F.array().cast("array<string>")))


# Column types of the automaton's leaves; whole numbers of any length a JSON text may hold fit a decimal or stay in ``members``.
_COLUMNS = {"bool": "boolean", "int": "decimal(38,0)", "float": "double", "text": "string"}


def typed_members(objects: DataFrame) -> DataFrame:
    """Object rows with their scalar members by type: a map for each of bool, int, float and text; numbers too long for their type are null there."""

    def typed(name: str, column: str) -> Column:
        own = F.map_filter("members", lambda k, v: F.element_at(F.col("types"), k) == name)
        return F.transform_values(own, lambda k, v: v.try_cast(column)).alias(name)

    return objects.select("*", *[typed(t, c) for t, c in _COLUMNS.items()])


def write_variant_tables(records: DataFrame, path: str) -> None:
    """The flat tables on disk: ``catalog``, ``subtypes`` and ``elements``.

    ``subtypes`` holds the subtype tables one behind the other, scalar members
    typed (``typed_members``); ``elements`` the lists and their scalars, by
    type. Rows keep record_id, field, pointer, parent_pointer (the link to the
    row they hang from). Together they hold every value of the records. Rows are
    sorted by variant in each file, so that a reader of one variant skips the
    row groups of all others.
    """
    from recordloom.session import materialize

    objects = materialize(object_rows(records), "objects")
    variant_catalog(objects).write.mode("overwrite").parquet(f"{path}/catalog")
    typed_members(objects).hint("rebalance", F.col("variant")).sortWithinPartitions("variant").write.mode("overwrite").parquet(f"{path}/subtypes")
    element_rows(records).hint("rebalance", F.col("kind")).sortWithinPartitions("kind").write.mode("overwrite").parquet(f"{path}/elements")


def subtype_table(path: str, spark, variant: str) -> DataFrame:
    """One variant's table: record_id, field, pointer, parent_pointer and a typed column for each of its scalar keys.

    A key named like one of the four link columns gets an underscore behind it.
    """
    types: dict[str, str] = {}
    for r in spark.read.parquet(f"{path}/catalog").where(F.col("variant") == variant).select("types").collect():  # one row for each place the variant stands at
        types |= r["types"]
    rows = spark.read.parquet(f"{path}/subtypes").where(F.col("variant") == variant)
    links = ["record_id", "field", "pointer", "parent_pointer"]
    cols = [(F.lit(None).cast("string") if t == "null" else F.col(t)[F.lit(k)]).alias(f"{k}_" if k in links else k) for k, t in sorted(types.items())]
    return rows.select(*links, *cols)


def element_table(path: str, spark, kind: str) -> DataFrame:
    """The elements of one type: record_id, field, pointer, parent_pointer and the typed value (lists and nulls: null)."""
    rows = spark.read.parquet(f"{path}/elements").where(F.col("kind") == kind)
    return rows.select("record_id", "field", "pointer", "parent_pointer", F.col("value").try_cast(_COLUMNS.get(kind, "string")).alias("value"))


def number_totals(subtypes: DataFrame) -> DataFrame:
    """field, place, key, type, n_values, total of every numeric key over all subtype tables."""
    parts = [subtypes.select("field", "place", F.explode(t).alias("key", "x"), F.lit(t).alias("type")).select("field", "place", "key", "type", F.col("x").cast("double").alias("x")) for t in ("int", "float")]
    return parts[0].unionByName(parts[1]).groupBy("field", "place", "key", "type").agg(F.count("x").alias("n_values"), F.sum("x").alias("total"))
