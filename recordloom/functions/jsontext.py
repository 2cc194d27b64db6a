"""Reading JSON that is spaced, escaped, nested as text or damaged.

One rule for all operators: null or unparseable text holds nothing, and a
string whose whole content is an object or array stands for that value.
"""

from __future__ import annotations

import json
import sys
from typing import Any


class NOTHING:
    """What null and damaged text hold. A class, so that it stays itself when it travels to workers."""



def _reject(_: str) -> None:
    raise ValueError("not JSON")


_decode = json.JSONDecoder(parse_constant=_reject).decode


class _DeepDecoder(json.JSONDecoder):
    """Pure Python, for nesting the C scanner refuses."""

    def __init__(self) -> None:
        super().__init__(parse_constant=_reject)
        self.parse_object = json.decoder.JSONObject
        self.parse_array = json.decoder.JSONArray
        self.scan_once = json.scanner.py_make_scanner(self)


def _deep(text: str) -> Any:
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)
    return _DeepDecoder().decode(text)


def unwrap(value: Any) -> Any:
    """The object or array a string stands for, else the value itself."""
    while type(value) is str:
        head = value.lstrip(" \t\r\n")[:1]
        if head != "{" and head != "[":
            return value
        try:
            value = _decode(value)
        except RecursionError:
            try:
                value = _deep(value)
            except ValueError:
                return value
        except ValueError:
            return value
    return value


def parse(text: str | None) -> Any:
    """The JSON value of a column, unwrapped; NOTHING if null or damaged."""
    if text is None:
        return NOTHING
    try:
        value = _decode(text)
    except RecursionError:
        try:
            value = _deep(text)
        except ValueError:
            return NOTHING
    except ValueError:
        return NOTHING
    return unwrap(value) if type(value) is str else value


def allow_big_numbers() -> None:
    sys.set_int_max_str_digits(0)


def utf8(text: str) -> str:
    """Lone surrogates, which no UTF-8 column can hold, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
