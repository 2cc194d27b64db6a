"""Strategy search: text, vector, or both, with an honest report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import filters, search


class Unavailable(RuntimeError):
    """The vector half cannot answer."""


@dataclass(frozen=True)
class Policy:
    vector_enabled: bool = True
    score_threshold: float | None = None
    order: tuple[str, str] = ("vector", "fts")
    fill_remaining: bool = True


@dataclass
class Report:
    hits: DataFrame  # position, id, source
    answered_by: str
    fallback: str | None
    total_matches: int | None
    rejected: DataFrame | None  # id, reason of stale vectors


@dataclass
class SearchEngine:
    """``view``: a ledger view with ``superseded``. ``points``: id, input_sha256, embedding; ``documents``: id, input_sha256, as of now.

    ``embed`` turns the query text into a vector of the points' space. ``index``
    holds the texts of the view; without it they are read for each query.
    """

    view: DataFrame
    points: DataFrame | None = None
    documents: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    policy: Policy = Policy()
    index: search.TextIndex | None = None

    def _eligible(self, namespace: str | None, type_name: str | None, flags: list[str], strict: bool) -> DataFrame:
        v = self.view.where(~F.col("superseded") & ~F.col("revoked"))
        if namespace is not None:
            v = v.where(F.col("namespace") == namespace)
        if type_name is not None:
            v = v.where(F.col("type_name") == type_name)
        return filters.where(v, flags, strict)

    def _text(self, query: str, eligible: DataFrame, limit: int, stem: bool) -> tuple[DataFrame, DataFrame]:
        scored = search.bm25(self.view, query, stem) if self.index is None else self.index.score(query, stem)
        every = scored.join(eligible.select("id", "recorded_at"), "id")
        key: list[Column] = [F.desc(F.round("score", 9)), F.desc("recorded_at"), F.asc("id")]
        return search.ranked(every, key, limit), every

    def _vector(self, query: str, eligible: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        if not self.policy.vector_enabled:
            raise Unavailable("vector retrieval is disabled")
        if self.points is None or self.documents is None or self.embed is None:
            raise Unavailable("there is no vector index")
        now = self.documents.select("id", F.col("input_sha256").alias("now"))
        judged = self.points.join(now, "id", "left").withColumn("reason", F.when(F.col("now").isNull(), "no document").when(F.col("now") != F.col("input_sha256"), "stale"))
        fresh = judged.where(F.col("reason").isNull()).join(eligible.select("id"), "id", "left_semi")
        hits = search.nearest(fresh, self.embed(query), limit, "cosine", self.policy.score_threshold, "id")
        return search.ranked(hits, [F.desc("score"), F.asc("id")], limit), judged.where(F.col("reason").isNotNull()).select("id", "reason")

    def search(self, query: str, strategy: str = "hybrid", limit: int = 30, namespace: str | None = None, type_name: str | None = None, flags: list[str] | None = None, strict: bool = False, stem: bool = True) -> Report:
        """Filters narrow both halves before either may claim to have answered. Only ``fts`` knows its total."""
        if not 1 <= limit <= 10_000:
            raise ValueError("limit must be between 1 and 10000")
        eligible = self._eligible(namespace, type_name, flags or [], strict)
        position = F.col("rank").alias("position")
        if strategy == "fts":
            hits, every = self._text(query, eligible, limit, stem)
            return Report(hits.select(position, "id", F.lit("fts").alias("source")), "fts", None, every.count(), None)
        if strategy not in ("vector", "hybrid"):
            raise ValueError("strategy must be fts, vector or hybrid")
        try:
            vector, rejected = self._vector(query, eligible, limit)
        except Unavailable as why:
            if strategy == "vector":
                raise
            hits, _ = self._text(query, eligible, limit, stem)
            return Report(hits.select(position, "id", F.lit("fts").alias("source")), "fts", str(why), None, None)
        if strategy == "vector":
            return Report(vector.select(position, "id", F.lit("vector").alias("source")), "vector", None, None, rejected)
        text, _ = self._text(query, eligible, limit, stem)
        pages = {"vector": vector, "fts": text}
        first, second = (pages[n] for n in self.policy.order)
        merged = search.ordered(first, second, limit, self.policy.fill_remaining, self.policy.order)
        if self.policy.fill_remaining:
            return Report(merged, "hybrid", None, None, rejected)
        stood_in = first.limit(1).count() == 0
        return Report(merged, self.policy.order[1] if stood_in else self.policy.order[0], f"{self.policy.order[0]} found nothing" if stood_in else None, None, rejected)
