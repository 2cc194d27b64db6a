"""Small bridges between Python lists and Arrow columns."""

from __future__ import annotations

import pyarrow as pa

from recordloom.functions.jsontext import utf8


def strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array([None if v is None else utf8(v) for v in values], pa.string())
