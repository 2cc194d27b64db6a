"""Context selection: gate, classify, order, budget.

Gate and classification are column expressions over the ledger view; the
selectors are a handful of small definitions, compiled into the plan. Only the
budget is sequential (the cost of a record depends on what was picked before),
and it runs over the ordered candidates; more than MOST_CANDIDATES are an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import instant
from recordloom.functions.jsonpath import MISSING, pointer
from recordloom.functions.jsontext import NOTHING, parse
from recordloom.session import materialize

MOST_CANDIDATES = 10_000
#: A tag that withdraws a record ends in this, whatever stands before the colon.
WITHDRAWN_TAG = "(?i)^[a-z]+:revoked$"
TIERS = ("required", "core", "relevant")


@dataclass(frozen=True)
class Selector:
    type_name: str
    strategies: tuple[str, ...] = ("recency",)  # of exact, tag, recency, fts, hybrid
    required_tags: tuple[str, ...] = ()
    core_tags: tuple[str, ...] = ()
    coordinate_pointers: dict[str, str] = field(default_factory=dict)
    coordinate_modes: dict[str, str] = field(default_factory=dict)  # set_or_wildcard, else exact
    kind_pointer: str | None = None
    rank_pointer: str | None = None
    expires_at_pointer: str | None = None


@dataclass(frozen=True)
class Request:
    at: str
    query: str = ""
    tags: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    coordinates: dict[str, Any] = field(default_factory=dict)
    include_superseded: bool = False


def json_tags(tags: Column) -> Column:
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def withdrawn(tags: Column) -> Column:
    return F.exists(tags, lambda t: t.rlike(WITHDRAWN_TAG))


def same(a: Any, b: Any) -> bool:
    """JSON equality: 1 is not true and not "1"."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b and type(a) is type(b)


def set_or_wildcard(actual: Any, wanted: Any) -> bool:
    """A record that names nothing fits everything; otherwise the two sides, one value or several, must share one."""
    if actual is MISSING or actual is None:
        return True
    held = actual if isinstance(actual, list) else [actual]
    asked = wanted if isinstance(wanted, list) else [wanted]
    return any(same(h, a) for h in held for a in asked)


def coordinates_match(payload: Any, s: Selector, r: Request) -> bool:
    for key, ptr in s.coordinate_pointers.items():
        if key not in r.coordinates:
            continue
        actual = pointer(payload, ptr)
        if s.coordinate_modes.get(key) == "set_or_wildcard":
            if not set_or_wildcard(actual, r.coordinates[key]):
                return False
        elif actual is MISSING or not same(actual, r.coordinates[key]):
            return False
    return True


def _coordinate_udf(selectors: list[Selector], request: Request):
    by_type = {s.type_name: s for s in selectors}

    @F.pandas_udf("boolean")
    def fits(payload: pd.Series, type_name: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(payload, type_name):
            s = by_type.get(t)
            value = parse(p)
            value = None if value is NOTHING else value
            ok = s is not None and coordinates_match(value, s, request)
            if ok and request.kinds:
                kind = pointer(value, s.kind_pointer) if s.kind_pointer else MISSING
                ok = isinstance(kind, str) and kind in request.kinds
            out.append(ok)
        return pd.Series(out, dtype=bool)

    return fits


def _per_type(selectors: list[Selector], make: Callable[[Selector], Column], default: Column) -> Column:
    out = default
    for s in selectors:
        out = F.when(F.col("type_name") == s.type_name, make(s)).otherwise(out)
    return out


def _pointer_text(ptr: str | None) -> Column:
    if not ptr:
        return F.lit(None).cast("string")
    path = "$" + "".join(f"['{p}']" for p in ptr.split("/")[1:])
    return F.get_json_object("payload", path)


def may_read(grants: list[tuple[str, str]]) -> Column:
    """The condition that some grant (namespace, type_name) covers a record; where refused records are not asked for, it can cut the scan."""
    granted = F.lit(False)
    for ns in sorted({g[0] for g in grants}):
        granted = granted | ((F.col("namespace") == ns) & F.col("type_name").isin(sorted(t for n, t in grants if n == ns)))
    return granted


def gate(view: DataFrame, grants: list[tuple[str, str]], selectors: list[Selector], request: Request) -> DataFrame:
    """The view (with ``superseded``) plus ``reason``: why a record is left out, null if it stays.

    In order: unauthorized, superseded, revoked, invalid_at_request_time,
    selector_mismatch (no selector), expired, selector_mismatch (coordinates or
    kind). ``grants``: (namespace, type_name) pairs that may be read.
    """
    selectors = list({s.type_name: s for s in selectors}.values())  # the last selector of a type wins
    granted = may_read(grants)
    at = instant(F.lit(request.at))
    tags = json_tags(F.col("tags"))
    expiry_tag = F.regexp_replace(F.try_element_at(F.filter(tags, lambda t: t.startswith("expires:")), F.lit(1)), "^expires:", "")
    expires = F.coalesce(_per_type(selectors, lambda s: _pointer_text(s.expires_at_pointer), F.lit(None).cast("string")), expiry_tag)
    gone = F.col("superseded") if not request.include_superseded else F.lit(False)
    reason = (
        F.when(~F.coalesce(granted, F.lit(False)), "unauthorized").when(gone, "superseded").when(F.lit(not request.include_superseded) & (withdrawn(tags) | F.col("revoked")), "revoked")
        .when(instant(F.coalesce("valid_at", "observed_at")) > at, "invalid_at_request_time").when(~F.col("type_name").isin([s.type_name for s in selectors]), "selector_mismatch")
        .when(instant(expires) < at, "expired")
    )
    if request.kinds or any(s.coordinate_pointers for s in selectors) and request.coordinates:
        first = view.withColumn("reason", reason)
        return first.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(~_coordinate_udf(selectors, request)(F.col("payload"), F.col("type_name")), "selector_mismatch"))
    return view.withColumn("reason", reason)


def classify(passed: DataFrame, selectors: list[Selector], request: Request, text_hits: DataFrame | None = None, semantic_hits: DataFrame | None = None) -> DataFrame:
    """Adds tier, strategies, score, search_rank and source; rows no strategy matches get tier null.

    Hits are (id, rank) pages. Required and core tags decide before any strategy.
    """
    for name, hits in (("t_rank", text_hits), ("v_rank", semantic_hits)):
        if hits is None:
            passed = passed.withColumn(name, F.lit(None).cast("int"))
        else:
            passed = passed.join(hits.groupBy("id").agg(F.min("rank").cast("int").alias(name)), "id", "left")
    tags = json_tags(F.col("tags"))
    any_of = lambda wanted: F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)
    needle = request.query.strip().lower()
    exact = F.lower("payload").contains(request.query.lower()) | F.exists(tags, lambda t: F.lower(t).contains(request.query.lower())) if needle else F.lit(False)
    test = {"exact": exact, "tag": any_of(request.tags), "recency": F.lit(True), "fts": F.col("t_rank").isNotNull(), "hybrid": F.col("v_rank").isNotNull()}
    none = F.array().cast("array<string>")

    def strategies(s: Selector) -> Column:
        return F.array_compact(F.array(*[F.when(test[x], F.lit(x)) for x in s.strategies])) if s.strategies else none

    required = _per_type(selectors, lambda s: any_of(s.required_tags), F.lit(False))
    core = _per_type(selectors, lambda s: any_of(s.core_tags), F.lit(False))
    matched = F.when(required | core, F.array(F.lit("tag"))).otherwise(_per_type(selectors, strategies, none))
    out = passed.withColumn("strategies", matched).withColumn("tier", F.when(required, "required").when(core, "core").when(F.size("strategies") > 0, "relevant"))
    out = out.withColumn("score", F.size("strategies")).withColumn("rank", _per_type(selectors, lambda s: _pointer_text(s.rank_pointer).cast("double"), F.lit(None).cast("double")))
    return out.withColumn("source", F.when(F.col("v_rank").isNotNull(), "vector").when(F.col("t_rank").isNotNull(), "fts")).withColumn("search_rank", F.coalesce("v_rank", "t_rank"))


def candidate_order() -> list[Column]:
    """Tier, source, search rank (none first), rank (ranked first, high first), score, observed_at text (newest first), id."""
    tier = F.when(F.col("tier") == "required", 0).when(F.col("tier") == "core", 1).otherwise(2)
    source = F.when(F.col("source") == "vector", 0).when(F.col("source") == "fts", 1).otherwise(2)
    unranked_score = F.when(F.col("rank").isNull(), F.col("score")).otherwise(0)
    return [tier.asc(), source.asc(), F.col("search_rank").asc_nulls_first(), F.col("rank").desc_nulls_last(), unranked_score.desc(), F.col("observed_at").desc_nulls_last(), F.col("id").asc()]


def page(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """All candidates in order; the first ``limit`` if one is asked for."""
    every = candidates.where(F.col("tier").isNotNull()).orderBy(*candidate_order())
    return every if limit is None else every.limit(limit)


def numbered(candidates: DataFrame, *columns: str) -> DataFrame:
    """position (from 1) and ``columns`` of every candidate: rank within the sort's partitions plus the partitions' offsets."""
    ordered = materialize(page(candidates).select(F.monotonically_increasing_id().alias("m"), *columns), "candidates").withColumn("part", F.shiftright("m", 33))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a partition
    at = F.col("base") + (F.col("m") - F.shiftleft("part", 33)) + 1
    return ordered.join(F.broadcast(offsets), "part").select(at.cast("int").alias("position"), *columns)


def reason_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("type_name", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Budget:
    total: int | None = None
    required_cap: int | None = None
    core_cap: int = 0
    relevant_floor: int = 0
    reserve: int = 0
    records: int | None = 30


class RequiredOverflow(ValueError):
    """The required records alone exceed the budget; there is no partial bundle."""


def fill_budget(candidates: list[dict], budget: Budget, render: Callable[[list[dict]], str], count: Callable[[str], int]) -> tuple[list[dict], list[tuple[str, str]]]:
    """(picked with tokens, [(id, reason)] left out) from an ordered page of candidates.

    Required records all go in or nothing does; core records fill up to their
    cap, leaving the floor the relevant ones could use; relevant records fill
    the rest. A record over the limit is skipped and smaller ones later may
    still fit. A record costs what it adds to the rendered text.
    """
    if len(candidates) > MOST_CANDIDATES:
        raise ValueError(f"a budget is filled from at most {MOST_CANDIDATES} candidates")
    content = max(0, budget.total - budget.reserve) if budget.total is not None else 1 << 62
    picked: list[dict] = []
    left: list[tuple[str, str]] = []
    size = 0

    def cost(more: list[dict]) -> int:
        return count(render(picked + more))

    def pick(c: dict, total: int) -> None:
        nonlocal size
        picked.append(c | {"tokens": max(0, total - size)})
        size += max(0, total - size)

    tier = {t: [c for c in candidates if c["tier"] == t] for t in TIERS}
    if budget.records is not None and len(tier["required"]) > budget.records:
        raise RequiredOverflow(f"{len(tier['required'])} required records, limit {budget.records}")
    for c in tier["required"]:
        pick(c, cost([c]))
    if size > min(content, content if budget.required_cap is None else budget.required_cap):
        raise RequiredOverflow(f"required records take {size} tokens")
    wanted = max(0, cost(tier["relevant"]) - size)
    floor = min(budget.relevant_floor, wanted, max(0, content - size))
    limits = {"core": (min(size + budget.core_cap, max(0, content - floor)), "core_cap"), "relevant": (content, "total_budget")}
    for name in ("core", "relevant"):
        limit, why = limits[name]
        for c in tier[name]:
            if budget.records is not None and len(picked) >= budget.records:
                left.append((c["id"], "record_budget"))
                continue
            total = cost([c])
            if total <= limit:
                pick(c, total)
            else:
                left.append((c["id"], why))
    return picked, left


def bundle_rows(candidates: list[dict], budget: Budget, render: Callable[[list[dict]], str], count: Callable[[str], int]) -> list[tuple]:
    """(position, id, tier, tokens, outcome): the picked records, then those left out with their reason.

    If the required records do not fit there is no bundle, only one row: no
    position, id or tokens, tier required, outcome required_overflow.
    """
    try:
        picked, left = fill_budget(candidates, budget, render, count)
    except RequiredOverflow:
        return [(None, None, "required", None, "required_overflow")]
    return [(i, p["id"], p["tier"], p["tokens"], "picked") for i, p in enumerate(picked)] + [(None, i, None, None, why) for i, why in left]


def bundle_digest(picked: list[dict]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(f"{p['id']} {p.get('record_sha256') or ''}" for p in picked).encode()).hexdigest()


def unmatched_coordinates(view: DataFrame, pointers: dict[str, str], wanted: dict[str, Any]) -> DataFrame:
    """key, declared, n_naming, n_matching: why a requested coordinate found nothing."""
    rows = []
    for key in sorted(wanted):
        ptr = pointers.get(key)
        if ptr is None:
            rows.append(view.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(False).alias("declared"), F.lit(0).cast("long").alias("n_naming"), F.lit(0).cast("long").alias("n_matching")))
            continue
        held = _pointer_text(ptr)
        values = wanted[key] if isinstance(wanted[key], list) else [wanted[key]]
        hit = held.isin([str(v) for v in values])
        rows.append(view.agg(F.count_if(held.isNotNull()).alias("n_naming"), F.count_if(hit).alias("n_matching")).select(F.lit(key).alias("key"), F.lit(True).alias("declared"), "n_naming", "n_matching"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def keep_first_source(candidates: DataFrame, preferred: str = "vector") -> DataFrame:
    """Without ``fill_remaining``: if the preferred source kept any hybrid-only candidate, the other source's hybrid-only ones go."""
    only = (F.size("strategies") == 1) & (F.col("strategies")[0] == "hybrid") & (F.col("tier") == "relevant")
    answered = candidates.where(only & (F.col("source") == preferred)).limit(1).select(F.lit(True).alias("answered"))
    flagged = candidates.withColumn("stood_in", F.coalesce(only & (F.col("source") != preferred), F.lit(False)))
    marked = flagged.join(F.broadcast(answered), F.col("stood_in"), "left")  # at most one row
    return marked.where(F.col("answered").isNull()).drop("stood_in", "answered")


def cardinality_faults(candidates: DataFrame, expect: dict[str, str]) -> DataFrame:
    """type_name, expected, n_found of each selector that found too few or too many; expect: type -> any, some or one."""
    want = candidates.sparkSession.createDataFrame(sorted(expect.items()), "type_name string, expected string")
    found = candidates.where(F.col("tier").isNotNull()).groupBy("type_name").agg(F.count(F.lit(1)).alias("n_found"))
    j = want.join(found, "type_name", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return j.where(((F.col("expected") == "some") & (F.col("n_found") < 1)) | ((F.col("expected") == "one") & (F.col("n_found") != 1)))


def strategies_used(classified: DataFrame) -> DataFrame:
    """strategies: the distinct strategies of all classified records, sorted; one row."""
    return classified.select(F.explode("strategies").alias("s")).agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("strategies"))  # a handful of names


def uncovered(selectors: list[Selector], embed_types: list[str]) -> list[str]:
    """Types whose selector asks the vector half but that are not embedded; no embed types means all are."""
    return sorted({s.type_name for s in selectors if "hybrid" in s.strategies} - set(embed_types)) if embed_types else []


def health(classified: DataFrame, expect: dict[str, str], findings: DataFrame, selectors: list[Selector], embed_types: list[str]) -> DataFrame:
    """n_uncovered, n_cardinality_faults, n_findings, ok: one row; all must be zero."""
    zero = F.lit(0).cast("long")
    parts = [cardinality_faults(classified, expect).agg(F.count(F.lit(1)).alias("c")).select("c", zero.alias("f")), findings.agg(F.count(F.lit(1)).alias("f")).select(zero.alias("c"), "f")]
    both = parts[0].unionByName(parts[1]).agg(F.sum("c").alias("n_cardinality_faults"), F.sum("f").alias("n_findings"))
    out = both.withColumn("n_uncovered", F.lit(len(uncovered(selectors, embed_types))).cast("long"))
    return out.withColumn("ok", F.col("n_uncovered") + F.col("n_cardinality_faults") + F.col("n_findings") == 0)


def tier_totals(picked: list[dict]) -> dict[str, int]:
    """Tokens by tier, and records by the source that found them."""
    out = {f"{t}_tokens": sum(p["tokens"] for p in picked if p["tier"] == t) for t in TIERS}
    return out | {f"{s}_records": sum(p.get("source") == s for p in picked) for s in ("vector", "fts")}


def skipped_by(query: str, rules: list[tuple[str, str]]) -> str | None:
    """Name of the first rule (name, pattern) a query matches: query-driven retrieval is then left out, everything else goes on."""
    return next((name for name, pattern in rules if re.search(pattern, query)), None)


def parse_coordinates(pairs: list[str]) -> dict[str, Any]:
    """``key=value`` texts; a value with commas is a list. ValueError for anything else, and for a key named twice."""
    out: dict[str, Any] = {}
    for pair in pairs:
        key, eq, raw = pair.partition("=")
        values = [v.strip() for v in raw.split(",")]
        if not eq or not key.strip() or not all(values) or key.strip() in out:
            raise ValueError(f"{pair!r} is not a coordinate")
        out[key.strip()] = values if len(values) > 1 else values[0]
    return out
