"""Identifiers, instants and the few text normal forms the ledger needs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NIL_UUID = "00000000-0000-0000-0000-000000000000"
_PY_UUID = re.compile(r"^(?:urn:)?(?:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$")


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind (tabs and line ends too)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_key(c: Column) -> Column:
    """Lower case, no outer blanks; null where nothing is left."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def canonical_uuid(c: Column) -> Column:
    """Lower-case hyphenated UUID; other texts stay as cleaned keys; null for blank."""
    t = clean_key(c)
    hexed = F.regexp_replace(F.regexp_replace(t, r"^(urn:)?(uuid:)?\{?|\}?$", ""), "-", "")
    grouped = F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), grouped).otherwise(t)


def predecessor_uuid(c: Column) -> Column:
    """As canonical_uuid, but the all-zero UUID means none."""
    u = canonical_uuid(c)
    return F.when(u != NIL_UUID, u)


def py_canonical_uuid(text: str) -> str:
    t = text.strip().lower()
    m = _PY_UUID.match(t)
    return "-".join(m.groups()) if m else t


def instant(c: Column) -> Column:
    """RFC 3339 text (any offset and precision) as a timestamp in microseconds; null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(trimmed(c), r"(\.\d{6})\d+", "$1"))


def instant_micros(c: Column) -> Column:
    return F.unix_micros(instant(c))


def utc_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def point_id(store: str, record: Column) -> Column:
    """The name-based UUID (version 5) of a record in a store's namespace, by column functions alone."""
    bare = F.unhex(F.translate(record, "-", ""))
    h = F.sha1(F.concat(F.unhex(F.lit(store.replace("-", ""))), bare))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
