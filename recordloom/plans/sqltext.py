"""Pieces of the checking SQL: ids, readable JSON and instants as the column functions see them."""

from __future__ import annotations


def uuid_sql(c: str) -> str:
    t = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    h = f"replace(regexp_replace(regexp_replace({t}, '^(urn:)?(uuid:)?\\{{?', ''), '\\}}$', ''), '-', '')"
    return f"(CASE WHEN regexp_full_match({h}, '[0-9a-f]{{32}}') THEN substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) ELSE nullif({t}, '') END)"


def clean_sql(c: str) -> str:
    opened = f"(CASE WHEN json_valid({c}) AND json_type({c}) = 'VARCHAR' THEN ({c}::JSON)->>'$' WHEN json_valid({c}) THEN {c} END)"
    return f"(CASE WHEN json_valid({opened}) THEN {opened} END)"


def us_sql(c: str) -> str:
    return f"epoch_us(CAST(regexp_replace({c}, '(\\.\\d{{6}})\\d+', '\\1') AS TIMESTAMPTZ))"
