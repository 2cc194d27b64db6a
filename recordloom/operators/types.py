"""The type registry: catalog, lineage, payload validation, presentation by kind."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import jsonschema
from recordloom.functions.jsonpath import MISSING, address, canonical
from recordloom.functions.jsontext import NOTHING, parse

MOST_SHOWN = 5


class LineageFault(ValueError):
    """Types whose predecessors are unknown, circular, or lead to several current types."""


def catalog(spark: SparkSession, schemas: dict[str, dict]) -> DataFrame:
    """type_name, field, type, required, enum of every declared field."""
    rows = [(t, f, d["type"], d["required"], None if d["enum"] is None else canonical(d["enum"])) for t, s in sorted(schemas.items()) for f, d in sorted(jsonschema.fields(s).items())]
    return spark.createDataFrame(rows, "type_name string, field string, type string, required boolean, enum string")


def current_types(predecessors: dict[str, list[str]]) -> set[str]:
    """The one leaf of every connected group of types (a registry has tens of types)."""
    if any(p not in predecessors for ps in predecessors.values() for p in ps):
        raise LineageFault("a predecessor is not registered")
    successors: dict[str, list[str]] = {t: [s for s, ps in predecessors.items() if t in ps] for t in predecessors}
    open_ = {t: len(ps) for t, ps in predecessors.items()}
    ready = [t for t, n in open_.items() if n == 0]
    for t in ready:
        for s in successors[t]:
            open_[s] -= 1
            if open_[s] == 0:
                ready.append(s)
    if len(ready) < len(predecessors):
        raise LineageFault("types succeed one another in a circle")
    out, seen = set(), set()
    for t in predecessors:
        group, todo = set(), [t]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += successors[x] + predecessors[x]
        if t not in seen:
            leaves = [x for x in group if not successors[x]]
            if len(leaves) != 1:
                raise LineageFault(f"{sorted(leaves)} are all current")
            out.add(leaves[0])
            seen |= group
    return out


def payload_faults(view: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """id, n_faults, faults (the first five in order) of records whose payload breaks its type's schema.

    Types without a schema are refused as one fault; a missing payload too.
    """
    held = view.sparkSession.sparkContext.broadcast(json.dumps(schemas))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(type_name: pd.Series, payload: pd.Series) -> pd.Series:
        known = json.loads(held.value)
        out = []
        for t, p in zip(type_name, payload):
            value = parse(p)
            out.append([f"/: no type {t}"] if t not in known else ["/: no payload"] if value is NOTHING else sorted(jsonschema.faults(value, known[t])))
        return pd.Series(out)

    found = view.select("id", check("type_name", "payload").alias("f")).where(F.size("f") > 0)
    return found.select("id", F.size("f").alias("n_faults"), F.array_join(F.slice("f", 1, MOST_SHOWN), "; ").alias("faults"))


def project_fields(view: DataFrame, names: list[str]) -> DataFrame:
    """id, fields: a JSON object of the requested fields; what a record does not have is left out."""
    texts = [c for c in ("namespace", "type_name", "actor", "recorded_at", "observed_at", "valid_at", "supersedes") if c in view.columns]

    @F.pandas_udf(T.StringType())
    def pick(payload: pd.Series, env: pd.DataFrame) -> pd.Series:
        out = []
        for p, row in zip(payload, env.itertuples(index=False)):
            value = parse(p)
            envelope = {("type" if c == "type_name" else c): v for c, v in zip(texts, row) if v is not None}
            got = {n: x for n in names if (x := address(None if value is NOTHING else value, envelope, n.split("."))) is not MISSING}
            out.append(canonical(got))
        return pd.Series(out)

    return view.select("id", pick(F.col("payload"), F.struct(*texts)).alias("fields"))


def _has(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}").isNotNull()


def record_kind() -> Column:
    """role, process or step by a segment of the type's name, else by what the payload has, else other."""
    parts = F.split("type_name", r"\.")
    named = F.try_element_at(F.filter(parts, lambda s: s.isin("role", "process", "step")), F.lit(1))
    shape = F.when(_has("does") | (_has("gate") & _has("do")), "step").when(_has("purpose"), "process").when(_has("do") & _has("kind"), "role").otherwise("other")
    return F.coalesce(named, shape)
