"""Full-text, vector and hybrid search.

Text: BM25 over a kept inverted index (``TextIndex``: postings sorted by term, of
which a query reads its own terms) or, without one, over the texts themselves
(``bm25``). Corpus statistics cover all indexed records; lifecycle and scope are
applied to the hits. Vector: exact nearest neighbours (a set of queries is
compared with all rows block by block), or through cells fitted on a bounded
sample (``CellIndex``), of which a query meets the nearest few.
Hybrid: a priority merge of ranked lists, or reciprocal ranks as exact fractions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import fold, porter, search_text, tokens
from recordloom.session import kept, materialize

# The customary BM25 constants, the least idf, and the rank constant of reciprocal rank fusion.
K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(text: pd.Series) -> pd.Series:
    cache: dict[str, str] = {}

    def stem(t: str) -> str:
        if t not in cache:
            cache[t] = porter(t)
        return cache[t]

    return text.map(lambda x: [stem(t) for t in re.findall(r"[^\W_]+", fold(x))] if x else [])


def query_terms(query: str, stem: bool = False) -> list[list[str]]:
    """White-space terms, ORed; each is the list of its tokens (several make a phrase, none matches nothing)."""
    out = []
    for raw in query.split():
        toks = re.findall(r"[^\W_]+", fold(raw) if stem else raw.lower())
        toks = [porter(t) for t in toks] if stem else toks
        if toks:
            out.append(toks)
    return out


def _equals(token: str):
    return lambda x: x == token


def _scored(rows: DataFrame, n_terms: int, n: float, avg_len: float, frequencies: list[float]) -> DataFrame:
    """id, score of rows (id, len, t0, t1, ...) that hold one of the terms."""
    hits = rows.where(F.greatest(*[F.col(f"t{k}") for k in range(n_terms)], F.lit(0.0)) > 0)
    score: Column = F.lit(0.0)
    for k, df in enumerate(frequencies):
        tf = F.col(f"t{k}")
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avg_len))
    return hits.select("id", score.alias("score"))


def _words(view: DataFrame, stem: bool) -> DataFrame:
    text = search_text(F.col("payload"), F.col("evidence"), F.col("tags"))
    return view.select("id", (_stemmed(text) if stem else tokens(text)).alias("w"))


def bm25(view: DataFrame, query: str, stem: bool = False) -> DataFrame:
    """id, score for all records that hold a term of the query; higher is better.

    Only the query's terms are kept of each record, before anything is
    shuffled: a record contributes one row of counts. Terms of several tokens
    count where all tokens follow one another. Document frequencies and lengths
    come from one aggregate over all records.
    """
    terms = query_terms(query, stem)
    words = _words(view, stem)
    tfs: list[Column] = []
    for k, toks in enumerate(terms):
        if len(toks) == 1:
            tf = F.size(F.filter("w", _equals(toks[0])))
        else:
            follow = " AND ".join(f"get(w, i + {j}) = '{t}'" for j, t in enumerate(toks))  # tokens are letters and digits only
            tf = F.expr(f"size(filter(sequence(0, greatest(size(w) - 1, 0)), i -> coalesce({follow}, false)))")
        tfs.append(tf.cast("double").alias(f"t{k}"))
    rows = words.select("id", F.size("w").cast("double").alias("len"), *tfs)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    rows = materialize(rows, "term-counts")  # read twice, and the tokens need be cut only once
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"t{k}") > 0).cast("double").alias(f"d{k}") for k in range(len(terms))]).first()  # one row
    return _scored(rows, len(terms), stats["n"], stats["avg_len"] or 1.0, [stats[f"d{k}"] for k in range(len(terms))])


class TextIndex:
    """The inverted index at ``path``: ``postings`` (term, id, len, pos), one row a use, and ``stats``.

    Postings are sorted by term and record over all files, so that the row
    groups a query does not need are skipped by their statistics; a term that
    stands in a third of all records spans many files.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, view: DataFrame, stem: bool = False) -> "TextIndex":
        """Index a ledger view (id, payload, evidence, tags)."""
        words = materialize(_words(view, stem), "words")
        n = F.size("w")
        words.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg(F.when(n > 0, n).otherwise(0)), F.lit(0.0)).alias("avg_len")).write.mode("overwrite").parquet(f"{self.path}/stats")
        each = words.select("id", n.alias("len"), F.posexplode("w").alias("pos", "term"))
        each.select("term", "id", "len", "pos").orderBy("term", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/postings")
        return self

    def score(self, query: str, stem: bool = False) -> DataFrame:
        """id, score as ``bm25`` gives them, from the postings of the query's tokens alone."""
        terms = query_terms(query, stem)
        used = sorted({t for toks in terms for t in toks})
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("term").isin(used) if used else F.lit(False))
        tfs: list[Column] = []
        for k, toks in enumerate(terms):
            if len(toks) == 1:
                tf = F.count_if(F.col("term") == toks[0])
            else:  # where each token stands, moved to the phrase's first place
                places = [F.collect_list(F.when(F.col("term") == t, F.col("pos") - j)) for j, t in enumerate(toks)]
                common = F.array_distinct(places[0])
                for p in places[1:]:
                    common = F.array_intersect(common, p)
                tf = F.size(common)
            tfs.append(tf.cast("double").alias(f"t{k}"))
        if not terms:
            return rows.select("id", F.lit(0.0).alias("score"))
        rows = materialize(rows.groupBy("id").agg(F.first("len").cast("double").alias("len"), *tfs), "term-counts")
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        held = rows.agg(*[F.count_if(F.col(f"t{k}") > 0).cast("double").alias(f"d{k}") for k in range(len(terms))]).first()  # one row
        return _scored(rows, len(terms), stats["n"], stats["avg_len"] or 1.0, list(held))

    def terms(self) -> DataFrame:
        """term, n_records, n_uses."""
        return self.spark.read.parquet(f"{self.path}/postings").groupBy("term").agg(F.count_distinct("id").alias("n_records"), F.count(F.lit(1)).alias("n_uses"))


def kept_index(spark, sources: list[str], view, stem: bool = False) -> TextIndex:
    """The index of ``view()``, built when there is none for the present state of the files it is made from."""
    path = kept(spark, "stemmed" if stem else "text", sources, lambda at: TextIndex(spark, at).build(view(), stem))
    return TextIndex(spark, path)


def ranked(hits: DataFrame, key: list[Column], limit: int) -> DataFrame:
    """rank (from 1), id of the first ``limit`` hits by ``key``."""
    page = hits.orderBy(*key).limit(limit)
    return page.select(F.row_number().over(Window.orderBy(*key)).cast("int").alias("rank"), "id")  # over a page


def top_hits(hits: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    """rank, id, score of the k best of ``hits`` (id, score) among the eligible (id, recorded_at); ties by recorded_at (text, newest first), then id."""
    hits = hits.join(eligible.select("id", "recorded_at"), "id").select("id", "score", "recorded_at")
    best = hits.orderBy(F.desc(F.round("score", 9)), F.desc("recorded_at"), "id").limit(k)
    w = Window.orderBy(F.desc(F.round("score", 9)), F.desc("recorded_at"), "id")  # over k rows
    return best.select(F.row_number().over(w).alias("rank"), "id", F.round("score", 6).alias("score"))


def top_text(view: DataFrame, query: str, k: int, scope: Column | None = None, stem: bool = False) -> DataFrame:
    """As ``top_hits``, over the texts of the view itself; ``scope`` says what is eligible."""
    return top_hits(bm25(view, query, stem), view.where(scope) if scope is not None else view, k)


METRICS = ("cosine", "dot", "euclid", "manhattan")


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Similarity of two vector columns: higher is nearer (distances are negated)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    if metric == "dot":
        return dot
    if metric == "cosine":
        return dot / (norm(a) * norm(b))
    if metric == "euclid":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    return -F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def valid_vector(v: Column, dimensions: int) -> Column:
    """Right length, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0)


def nearest(points: DataFrame, query: list[float], k: int, metric: str = "cosine", threshold: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to one vector (ties by key); ``threshold`` drops hits before the limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = points.where(valid_vector(F.col(vector), len(query))).select(key, similarity(metric, F.col(vector), q).alias("score"))
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    return hits.orderBy(F.desc("score"), key).limit(k)


def points_in_scope(points: DataFrame, store: str | None = None, model: str | None = None, namespace: str | None = None, type_name: str | None = None) -> DataFrame:
    """The vectors of an index that a query may meet; each condition left out is open. All of them reach the scan."""
    for name, value in (("store", store), ("model", model), ("namespace", namespace), ("type_name", type_name)):
        if value is not None:
            points = points.where(F.col(name) == value)
    return points


def point_metadata(points: DataFrame, ids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Everything the index says of the given ids, without the vectors, which are not even read."""
    return points.drop(vector).join(ids.select("id").distinct(), "id", "left_semi")


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


def _unit(rows: list | np.ndarray) -> np.ndarray:
    m = np.asarray(rows, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(k: int):
    """Task body: lists of queries and points (key, v) -> the k best points of each query in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            s = col.flatten()
            return s.field("key").to_numpy(), _unit(s.field("v").to_pylist())

        for b in batches:
            for i in range(b.num_rows):
                qk, q = matrix(b.column(0).slice(i, 1))
                pk, p = matrix(b.column(1).slice(i, 1))
                score = np.round(q @ p.T, 12)
                for j in range(len(qk)):
                    top = np.lexsort((pk, -score[j]))[:k] if len(pk) <= 4 * k else (lambda c, s=score[j]: c[np.lexsort((pk[c], -s[c]))][:k])(np.flatnonzero(score[j] >= np.partition(score[j], len(pk) - k)[len(pk) - k]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), qk[j])), pa.array(pk[top]), pa.array(score[j][top])], ["query_id", "key", "score"])

    return run


_HITS = "query_id long, key long, score double"


def _k_best(hits: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


def nearest_of_all(queries: DataFrame, points: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, rank, key, score: the k nearest by cosine of each query among all points, exactly.

    Points and queries are packed into blocks of about ``block`` vectors; every
    pair of blocks is one matrix product, of which only the k best of each query
    leave the task. The merge sees k rows for each query and point block. The
    work is queries times points; ``CellIndex`` is the way for large numbers of both.
    """

    def packed(df: DataFrame, side: str) -> DataFrame:
        usable = _usable(df, key, vector)
        parts = max(1, -(-usable.count() // block))
        return usable.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("b")).agg(F.collect_list(F.struct("key", "v")).alias(side)), parts  # a block is bounded

    qs, n_q = packed(queries, "qs")
    ps, n_p = packed(points, "ps")
    # Each query block meets each point block once: the block number is spread over the other side's numbers.
    left = qs.select(F.col("b").alias("qb"), "qs", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))).alias("pb"))
    right = ps.select(F.col("b").cast("int").alias("pb"), "ps")
    return _k_best(left.join(right.hint("merge"), "pb").select("qs", "ps").mapInArrow(_best(k), _HITS), k, key)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` cells by spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


class CellIndex:
    """Approximate nearest neighbours by cosine: every vector lies in the cell of its nearest centre, a query meets ``probes`` cells.

    Centres and ``probes`` are fitted on a hash sample of at most about
    ``sample_rows`` vectors (the only rows the driver sees); all rows are
    indexed. ``probes`` is the least number whose recall of the 10 nearest, over
    the sample, reaches ``recall``. Cells are kept in blocks of about ``block``
    vectors, so a cell that holds a third of all rows is many blocks.
    """

    def __init__(self, points: DataFrame, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 20_000, cells: int | None = None, recall: float = 0.97, block: int = 4096) -> None:
        self.key, self.vector, self.block, self.spark = key, vector, block, points.sparkSession
        usable = _usable(points, key, vector)
        n = usable.count()
        share = max(1, n // sample_rows)
        rows = [r[0] for r in usable.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("v").collect()]
        sample = _unit(rows) if rows else np.zeros((0, 0))
        self.centres = fit_cells(sample, cells or min(4096, max(1, int(np.sqrt(n))))) if rows else sample
        self.probes = self._probes(sample, recall) if rows else 0
        self.cells = materialize(usable.mapInArrow(self._nearest_cells(1), "key long, v array<double>, cell int"), "cells")
        sizes = self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        spread = self.cells.join(sizes.hint("merge"), "cell").withColumn("b", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block)))
        self.blocks = materialize(spread.groupBy("cell", "b").agg(F.collect_list(F.struct("key", "v")).alias("ps")), "blocks")  # a block is bounded

    def _probes(self, sample: np.ndarray, recall: float) -> int:
        asked = sample[:: max(1, len(sample) // 200)]
        near = np.argsort(-(asked @ sample.T), axis=1)[:, :10]
        own = np.argmax(sample @ self.centres.T, axis=1)
        order = np.argsort(-(asked @ self.centres.T), axis=1)
        place = np.argsort(order, axis=1)  # at which probe a cell is met
        met = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
        return int(met[min(len(met) - 1, int(np.ceil(recall * len(met))))]) + 1

    def _nearest_cells(self, probes: int):
        held = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, 4096):
                    part = b.slice(start, 4096)
                    if not held.value.size:
                        continue
                    near = np.argsort(-(_unit(part.column(1).to_pylist()) @ held.value.T), axis=1, kind="stable")[:, :probes]
                    at = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["key", "v", "cell"])

        return run

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, rank, key, score of the k best of each query in the cells it meets."""
        asked = _usable(queries, self.key, self.vector).mapInArrow(self._nearest_cells(probes or self.probes), "key long, v array<double>, cell int")
        asked = materialize(asked, "asked")
        n = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        qs = asked.join(n.hint("merge"), "cell").groupBy("cell", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / self.block)).alias("qb")).agg(F.collect_list(F.struct("key", "v")).alias("qs"))  # a block is bounded
        hits = qs.join(self.blocks.hint("merge"), "cell").select("qs", "ps").mapInArrow(_best(k), _HITS)
        return _k_best(hits, k, self.key)


def first_ranks(hits: DataFrame) -> DataFrame:
    """id, rank: of a list that names an id twice, the first place counts."""
    return hits.groupBy("id").agg(F.min("rank").alias("rank"))


def reciprocal_ranks(vector: DataFrame, text: DataFrame) -> DataFrame:
    """id, numerator, denominator, position: 1/(60+v) + 1/(60+t) as an exact fraction, best first, ties by id.

    Fractions are compared as whole numbers: with the ranks' bound (10,000) the
    scaled quotient below separates any two different ones.
    """
    v, t = first_ranks(vector).withColumnRenamed("rank", "v"), first_ranks(text).withColumnRenamed("rank", "t")
    a, b = F.col("v") + RRF_K, F.col("t") + RRF_K
    j = v.join(t, "id", "full_outer")
    one = F.lit(1).cast("long")
    num = F.when(F.col("v").isNull() | F.col("t").isNull(), one).otherwise(a + b).cast("long")
    den = F.when(F.col("v").isNull(), b).when(F.col("t").isNull(), a).otherwise(a * b).cast("long")
    f = j.select("id", num.alias("numerator"), den.alias("denominator"))
    exact = F.col("numerator").cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)") / F.col("denominator").cast("decimal(19,0)")
    w = Window.orderBy(F.desc(exact), "id")  # two pages of hits
    return f.select("id", "numerator", "denominator", F.row_number().over(w).alias("position"))


def ordered(first: DataFrame, second: DataFrame, limit: int, fill_remaining: bool = True, names: tuple[str, str] = ("vector", "fts")) -> DataFrame:
    """position, id, source: the first list, then (if wanted, or if it is empty) the second; an id once, in its first place."""
    a = first_ranks(first).withColumn("priority", F.lit(0))
    b = first_ranks(second).withColumn("priority", F.lit(1))
    if not fill_remaining:
        b = b.join(a.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(F.lit(1).alias("priority")), "priority", "left_semi")
    both = a.unionByName(b.select(*a.columns))
    once = both.groupBy("id").agg(F.min(F.struct("priority", "rank")).alias("p"))
    w = Window.orderBy("p.priority", "p.rank", "id")  # two pages of hits
    return once.select("id", F.when(F.col("p.priority") == 0, names[0]).otherwise(names[1]).alias("source"), F.row_number().over(w).alias("position")).where(F.col("position") <= limit).select("position", "id", "source")
