"""The field filter: ``field=value`` flags over payload and envelope.

Flags are ANDed, comma-separated values ORed, a leading ``!`` negates the whole
flag, ``null`` asks for absence. A record without the field passes unless
``strict``. Conditions on plain envelope columns become Catalyst predicates; of
those, the ones on columns that all deliveries of a record spell alike go below
the grouping and reach the scan (``where_records``). The others share one Arrow
pass over the payloads that are left.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.jsonpath import MISSING, address, in_envelope, scalar_text
from recordloom.functions.jsontext import NOTHING, parse
from recordloom.operators import ledger

#: Envelope fields that are text columns of the ledger view.
_COLUMNS = {"id": "id", "namespace": "namespace", "type": "type_name", "actor": "actor", "recorded_at": "recorded_at", "observed_at": "observed_at", "valid_at": "valid_at", "supersedes": "supersedes"}


@dataclass(frozen=True)
class Condition:
    path: tuple[str, ...]
    negated: bool
    values: tuple[str | None, ...]


def parse_flag(flag: str) -> Condition:
    """ValueError for a missing ``=``, an empty name or value, or a negated list with null in it."""
    field, eq, raw = flag.partition("=")
    path = tuple(p.strip() for p in field.split("."))
    if not eq or not all(path):
        raise ValueError(f"{flag!r} is not field=value")
    negated = raw.startswith("!")
    values = tuple(None if v == "null" else v for v in (raw[1:] if negated else raw).split(","))
    if "" in values:
        raise ValueError(f"{flag!r} has an empty value")
    if negated and len(values) > 1 and None in values:
        raise ValueError(f"{flag!r} negates a list containing null")
    return Condition(path, negated, values)


def _has(actual: Any, want: str | None) -> bool:
    if isinstance(actual, list):
        return any(_has(x, want) for x in actual)
    if want is None:
        return actual is None
    if isinstance(actual, str):
        return actual == want
    return isinstance(actual, (bool, int, float)) and scalar_text(actual) == want


def holds(payload: Any, envelope: dict, c: Condition, strict: bool) -> bool:
    actual = address(payload, envelope, list(c.path))
    absent = actual is MISSING or actual is None
    if c.values == (None,):
        return absent != c.negated
    if absent:
        return not c.negated if None in c.values else not strict
    return any(_has(actual, v) for v in c.values) != c.negated


def _as_column(c: Condition, strict: bool) -> Column | None:
    """The condition on an explicitly named text column of the envelope, else None."""
    if c.path[0] != "record" or len(c.path) != 2 or c.path[1] not in _COLUMNS:
        return None
    col = F.col(_COLUMNS[c.path[1]])
    if c.values == (None,):
        return col.isNotNull() if c.negated else col.isNull()
    wanted = [v for v in c.values if v is not None]
    hit = col.isin(wanted)
    if None in c.values:
        return col.isNull() | hit
    known = ~hit if c.negated else hit
    return col.isNotNull() & known if strict else col.isNull() | known  # forms that a scan understands


def check_declared(flags: list[str], fields: set[str]) -> None:
    """Refuse a filter that names a field neither declared by a type in scope nor part of the envelope."""
    for flag in flags:
        path = list(parse_flag(flag).path)
        if path[0] == "record":
            ok = in_envelope(path[1:]) if len(path) > 1 else False
        elif path[0] == "payload":
            ok = len(path) > 1 and ".".join(path[1:]) in fields
        else:
            ok = ".".join(path) in fields or in_envelope(path)
        if not ok:
            raise ValueError(f"no type in scope declares {'.'.join(path)!r}")


def where(view: DataFrame, flags: list[str], strict: bool = False) -> DataFrame:
    """Rows of a ledger view (payload, evidence, tags as clean JSON text) that pass every flag."""
    rest: list[Condition] = []
    for c in map(parse_flag, flags):
        predicate = _as_column(c, strict)
        if predicate is None:
            rest.append(c)
        else:
            view = view.where(predicate)
    if not rest:
        return view
    texts = [c for c in (*_COLUMNS.values(), "evidence", "tags") if c in view.columns]

    @F.pandas_udf("boolean")
    def passes(payload: pd.Series, env: pd.DataFrame) -> pd.Series:
        names = {v: k for k, v in _COLUMNS.items()}
        out = []
        for p, row in zip(payload, env.itertuples(index=False)):
            value = parse(p)
            value = None if value is NOTHING else value
            envelope: dict[str, Any] = {"payload": value}
            for name, text in zip(texts, row):
                if name in ("evidence", "tags"):
                    got = parse(text)
                    envelope[name] = [] if got is NOTHING else got
                else:
                    envelope[names[name]] = text
            if envelope.get("supersedes") is None:
                envelope.pop("supersedes", None)
            out.append(all(holds(value, envelope, c, strict) for c in rest))
        return pd.Series(out, dtype=bool)

    return view.where(passes(F.col("payload"), F.struct(*texts)))


def where_records(records: DataFrame, flags: list[str], strict: bool = False) -> DataFrame:
    """The ledger view of the records that pass every flag; conditions on namespace, type and actor cut the deliveries in the scan."""
    only, rest = F.lit(True), []
    for flag in flags:
        c = parse_flag(flag)
        predicate = _as_column(c, strict)
        if predicate is not None and _COLUMNS[c.path[1]] in ledger.PLAIN:
            only = only & predicate
        else:
            rest.append(flag)
    if not rest:
        return ledger.ledger_view(records, (*_COLUMNS_OF_A_VIEW,), only)
    return where(ledger.ledger_view(records, (*_COLUMNS_OF_A_VIEW, "payload", *_needed(rest)), only), rest, strict)


_COLUMNS_OF_A_VIEW = tuple(c for c in _COLUMNS.values() if c != "id")


def _needed(flags: list[str]) -> tuple[str, ...]:
    """evidence and tags, where a condition may address them."""
    named = {p for f in flags for p in parse_flag(f).path[:2]}
    return tuple(c for c in ("evidence", "tags") if c in named)


def guard_pool(records_in_scope: int, requested: int, most: int = 10_000) -> int:
    """How many candidates a filtered search has to take: the whole scope, or ValueError where that is over ``most``."""
    if records_in_scope > most:
        raise ValueError(f"a filter over {records_in_scope} records needs a narrower scope than {most}")
    return max(records_in_scope, requested)
