"""Addressing inside JSON: dotted paths, JSON pointers, canonical text."""

from __future__ import annotations

import json
from typing import Any


class MISSING:
    """What a path leads to where nothing stands."""


# The envelope's field names and the fields of its nested part.
ENVELOPE = {"id": (), "namespace": (), "type": (), "actor": (), "recorded_at": (), "observed_at": (), "valid_at": (), "payload": (), "evidence": ("kind", "reference", "sha256"), "tags": (), "supersedes": ()}


def walk_path(value: Any, path: list[str]) -> Any:
    """Follow a dotted path; of a list, the first element that has the rest of the path counts."""
    if not path:
        return value
    if isinstance(value, dict):
        return walk_path(value[path[0]], path[1:]) if path[0] in value else MISSING
    if isinstance(value, list):
        for item in value:
            got = walk_path(item, path)
            if got is not MISSING:
                return got
    return MISSING


def in_envelope(path: list[str]) -> bool:
    nested = ENVELOPE.get(path[0])
    return nested is not None and (len(path) == 1 or len(path) == 2 and path[1] in nested)


def address(payload: Any, envelope: dict, path: list[str]) -> Any:
    """``payload.x`` and ``record.x`` name their half; a bare name is the payload's first, then the envelope's."""
    if path[0] == "payload":
        return walk_path(payload, path[1:])
    if path[0] == "record":
        return walk_path(envelope, path[1:])
    got = walk_path(payload, path)
    if got is MISSING and in_envelope(path):
        got = walk_path(envelope, path)
    return got


def pointer(value: Any, ptr: str) -> Any:
    """RFC 6901."""
    if ptr == "":
        return value
    for step in ptr.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and step in value:
            value = value[step]
        elif isinstance(value, list) and step.isdigit() and (step == "0" or step[0] != "0") and int(step) < len(value):
            value = value[int(step)]
        else:
            return MISSING
    return value


def scalar_text(value: Any) -> str:
    """A bool or number as JSON prints it."""
    return json.dumps(value)


def canonical(value: Any) -> str:
    """Sorted keys, no spaces, raw UTF-8: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def leaves(value: Any) -> list[tuple[str, str]]:
    """(pointer, text) of all scalars but null, sorted."""
    out: list[tuple[str, str]] = []
    todo: list[tuple[str, Any]] = [("", value)]
    while todo:
        ptr, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{ptr}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{ptr}/{i}", x) for i, x in enumerate(v)]
        elif v is not None:
            out.append((ptr, v if isinstance(v, str) else scalar_text(v)))
    return sorted(out)
