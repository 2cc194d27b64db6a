import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import search

VIEW = "id string, recorded_at string, payload string, evidence string, tags string"


def view(spark, texts):
    return spark.createDataFrame([(f"r{i}", f"2025-01-{i % 28 + 1:02d}", None if t is None else json.dumps({"rule": t}), "[]", '["tag"]') for i, t in enumerate(texts)], VIEW)


def scores(spark, texts, query, stem=False):
    return {r.id: r.score for r in search.bm25(view(spark, texts), query, stem).collect()}


def test_or_phrase_and_empty_terms(spark):
    texts = ["alpha beta", "beta gamma", "gamma delta", "foo-bar baz", "bar foo", None, ""]
    assert set(scores(spark, texts, "alpha gamma")) == {"r0", "r1", "r2"}
    assert set(scores(spark, texts, "foo-bar")) == {"r3"}
    assert scores(spark, texts, '"') == {} and scores(spark, texts, "") == {} and scores(spark, [], "alpha") == {}
    assert set(scores(spark, ["two worktrees", "a worktree", "none"], "worktree", stem=True)) == {"r0", "r1"}
    assert set(scores(spark, ["rule"], "rule")) == {"r0"}  # keys are searchable


def test_bm25_against_the_formula(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    docs = [["rule", *t.split(), "tag"] for t in texts]
    got = scores(spark, texts, "a b")
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    for i, d in enumerate(docs):
        want = 0.0
        for t in "ab":
            df, tf = sum(t in x for x in docs), d.count(t)
            want += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        assert got.get(f"r{i}", 0.0) == pytest.approx(want)


def pages(spark, *lists):
    return [spark.createDataFrame([(str(x), i + 1) for i, x in enumerate(ids)], "id string, rank int") for ids in lists]


def test_reciprocal_ranks(spark):
    pos = lambda a, b: [r.id for r in search.reciprocal_ranks(*pages(spark, a, b)).orderBy("position").collect()]
    assert pos([1, 2], [3, 2])[0] == "2" and pos([10, 20], [30, 40]) == ["10", "30", "20", "40"]
    both = search.reciprocal_ranks(*pages(spark, [1], [1])).collect()[0]
    assert (both.numerator, both.denominator) == (122, 3721)


@pytest.mark.parametrize("limit,n_vector,want", [(30, 30, (30, 0)), (30, 20, (20, 10)), (30, 5, (5, 25)), (7, 5, (5, 2))])
def test_ordered_merge(spark, limit, n_vector, want):
    a, b = pages(spark, [f"v{i}" for i in range(n_vector)], [f"t{i}" for i in range(40)])
    got = search.ordered(a, b, limit).collect()
    assert (sum(r.source == "vector" for r in got), sum(r.source == "fts" for r in got)) == want
    only = search.ordered(a, b, limit, fill_remaining=False).collect()
    assert len(only) == min(limit, n_vector) and all(r.source == "vector" for r in only)
    assert len(search.ordered(a.limit(0), b, limit, fill_remaining=False).collect()) == limit


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[7] = m[8]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])], "vec_id long, embedding array<float>")
    x = m.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for metric, s in (("cosine", unit @ unit[0]), ("dot", x @ x[0]), ("euclid", -np.linalg.norm(x - x[0], axis=1)), ("manhattan", -np.abs(x - x[0]).sum(1))):
        got = search.nearest(df, [float(v) for v in m[0]], 20, metric).collect()
        assert [r.vec_id for r in got] == list(np.lexsort((np.arange(300), -s))[:20])
    good = df.where("vec_id < 300")
    got = search.nearest_of_all(good.where("vec_id % 20 = 0"), good, 5, block=40).collect()
    want = {(q, k + 1): v for q in range(0, 300, 20) for k, v in enumerate(np.lexsort((np.arange(300), -np.round(unit @ unit[q], 12)))[:5])}
    assert {(r.query_id, r.rank): r.vec_id for r in got} == want
    assert search.nearest_of_all(good.limit(0), good, 5).count() == 0


def test_metric_is_checked(spark):
    with pytest.raises(ValueError):
        search.similarity("hamming", None, None)


@pytest.mark.parametrize("stem", [False, True])
def test_index_scores_as_the_texts_do(spark, tmp_path, stem):
    rng = random.Random(7)
    words = ["fails", "closed", "worktrees", "alpha", "beta", "running", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["fails-closed, fails closed", None, ""]
    v = view(spark, texts)
    index = search.TextIndex(spark, str(tmp_path / "i")).build(v, stem)
    for q in ("alpha", "alpha beta beta", "fails-closed alpha", "worktree", "run-closed-fails", "nowhere", '"', "", "É"):
        want = {r.id: r.score for r in search.bm25(v, q, stem).collect()}
        got = {r.id: r.score for r in index.score(q, stem).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want), q
    empty = search.TextIndex(spark, str(tmp_path / "e")).build(view(spark, []), stem)
    assert empty.score("alpha", stem).collect() == []


def test_a_query_reads_its_own_terms(spark, tmp_path):
    index = search.TextIndex(spark, str(tmp_path / "i")).build(view(spark, ["alpha beta", "beta"]))
    plan = spark.read.parquet(f"{index.path}/postings").where("term in ('alpha', 'beta')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan
    assert {(r.term, r.n_records, r.n_uses) for r in index.terms().collect()} >= {("alpha", 1, 1), ("beta", 2, 2)}


def test_an_index_is_kept_until_its_files_change(spark, tmp_path):
    src, built = f"file://{tmp_path}/src", []

    def make():
        built.append(1)
        return view(spark, ["alpha"] * len(built))

    spark.range(3).coalesce(1).write.parquet(src)
    a = search.kept_index(spark, [src], make)
    assert search.kept_index(spark, [src], make).path == a.path and len(built) == 1
    spark.range(1).coalesce(1).write.mode("append").parquet(src)
    b = search.kept_index(spark, [src], make)
    assert b.path != a.path and len(built) == 2 and b.score("alpha").count() == 2


def test_points_in_scope_and_their_metadata(spark):
    points = spark.createDataFrame([("a", "s", "m", "n", "t", [1.0]), ("b", "s", "m2", "n", "t", [2.0]), ("c", "s", "m", None, "u", [3.0])], "id string, store string, model string, namespace string, type_name string, embedding array<double>")
    assert sorted(r.id for r in search.points_in_scope(points, "s", "m").collect()) == ["a", "c"]
    assert [r.id for r in search.points_in_scope(points, model="m", namespace="n", type_name="t").collect()] == ["a"]
    got = search.point_metadata(points, spark.createDataFrame([("b",), ("b",), ("z",)], "id string"))
    assert got.columns == ["id", "store", "model", "namespace", "type_name"] and [r.id for r in got.collect()] == ["b"]


def test_cells_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    vectors = [(centres[0 if i % 3 == 0 else i % 30] + 0.4 * rng.normal(size=16)).tolist() for i in range(3000)]  # a third near one centre
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(-1, None), (-2, [])], "vec_id long, embedding array<double>").repartition(4)
    queries = df.where("vec_id % 20 = 0")
    index = search.CellIndex(df, sample_rows=800, block=128)
    assert index.cells.count() == 3000 and index.probes < len(index.centres) / 2
    assert index.blocks.select(F.max(F.size("ps"))).first()[0] < 400
    exact = {(r.query_id, r.vec_id) for r in search.nearest_of_all(queries, df, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in index.nearest(queries, 10).collect()}
    assert len(exact & got) / len(exact) >= 0.9
    every = {(r.query_id, r.rank, r.vec_id) for r in index.nearest(queries, 10, len(index.centres)).collect()}
    assert every == {(r.query_id, r.rank, r.vec_id) for r in search.nearest_of_all(queries, df, 10).collect()}
    assert search.CellIndex(df.limit(0)).nearest(queries, 3).collect() == []
