"""A small validator for JSON Schema (2020-12 core keywords), for payloads of registered types."""

from __future__ import annotations

import re
from typing import Any

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, name: str) -> bool:
    if name == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if name == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return isinstance(value, _TYPES[name])


def _equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) is not isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return a == b


def faults(value: Any, schema: Any, at: str = "") -> list[str]:
    """``pointer: what is wrong`` for every fault, unsorted."""
    if schema is True or schema == {}:
        return []
    here = at or "/"
    if schema is False:
        return [f"{here}: not allowed"]
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, n) for n in names):
            return [f"{here}: is not {'|'.join(names)}"]
    if "const" in schema and not _equal(value, schema["const"]):
        out.append(f"{here}: is not the constant")
    if "enum" in schema and not any(_equal(value, e) for e in schema["enum"]):
        out.append(f"{here}: is not one of the allowed values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{here}: is too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{here}: is too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{here}: does not match {schema['pattern']}")
    if _is(value, "number"):
        for key, bad in (("minimum", lambda v, m: v < m), ("maximum", lambda v, m: v > m), ("exclusiveMinimum", lambda v, m: v <= m), ("exclusiveMaximum", lambda v, m: v >= m)):
            if key in schema and bad(value, schema[key]):
                out.append(f"{here}: breaks {key} {schema[key]}")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{here}: has too few items")
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{here}: has too many items")
        if schema.get("uniqueItems") and any(_equal(a, b) for i, a in enumerate(value) for b in value[:i]):
            out.append(f"{here}: repeats an item")
        head = schema.get("prefixItems", [])
        for i, item in enumerate(value):
            sub = head[i] if i < len(head) else schema.get("items", True)
            out += faults(item, sub, f"{at}/{i}")
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                out.append(f"{here}: misses {name}")
        known = schema.get("properties", {})
        patterns = schema.get("patternProperties", {})
        for name, item in value.items():
            spot = f"{at}/{name.replace('~', '~0').replace('/', '~1')}"
            fits = [s for p, s in patterns.items() if re.search(p, name)]
            if name in known:
                fits.append(known[name])
            if not fits:
                fits = [schema.get("additionalProperties", True)]
            for s in fits:
                out += faults(item, s, spot)
    for sub in schema.get("allOf", []):
        out += faults(value, sub, at)
    if "anyOf" in schema and all(faults(value, s, at) for s in schema["anyOf"]):
        out.append(f"{here}: fits none of the alternatives")
    if "oneOf" in schema and sum(not faults(value, s, at) for s in schema["oneOf"]) != 1:
        out.append(f"{here}: does not fit exactly one alternative")
    if "not" in schema and not faults(value, schema["not"], at):
        out.append(f"{here}: fits what it must not")
    return out


def fields(schema: dict, prefix: str = "") -> dict[str, dict]:
    """Dotted field names a schema declares, through ``properties`` and ``items``, with type, enum and whether required."""
    out: dict[str, dict] = {}
    while "items" in schema and "properties" not in schema and isinstance(schema["items"], dict):
        schema = schema["items"]
    for name, sub in schema.get("properties", {}).items():
        kinds = sub.get("type") if isinstance(sub, dict) else None
        out[prefix + name] = {"type": "|".join(kinds) if isinstance(kinds, list) else kinds, "enum": sub.get("enum") if isinstance(sub, dict) else None, "required": name in schema.get("required", [])}
        if isinstance(sub, dict):
            out |= fields(sub, f"{prefix}{name}.")
    return out
