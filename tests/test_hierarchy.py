import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import hierarchy as hierarchy_module
from recordloom.operators.hierarchy import descendants, hierarchy, ledger_nodes
from tests import brute


def make(spark, rows):
    return ledger_nodes(spark.createDataFrame(rows, "id string, supersedes string, revoked int, namespace string, extra string"))


def uid(i):
    return f"00000000-0000-7000-8000-{i:012d}"


def rows_of(parents, revoked, rng):
    out = []
    for i, p in parents.items():
        s = None if p is None else rng.choice([uid(p), uid(p).upper(), "{" + uid(p) + "}", "urn:uuid:" + uid(p), f" {uid(p)}\n", uid(p).replace("-", "")])
        out.append((uid(i), s, int(i in revoked), f"ns{i % 3}", "x"))
    return out


def random_forest(seed, n):
    rng = random.Random(seed)
    parents = {}
    for i in range(n):
        kind = rng.random()
        parents[i] = None if kind < 0.1 else rng.randrange(n) if kind < 0.3 else n + 5 if kind < 0.33 else max(0, i - rng.randint(1, 4)) if i else None
    return rows_of(parents, {i for i in range(n) if rng.random() < 0.2}, rng)


@pytest.mark.parametrize("seed,n,per_task", [(1, 60, 500_000), (2, 120, 25), (3, 200, 7), (4, 40, 1)])
def test_equals_brute_force_at_every_task_size(spark, seed, n, per_task):
    rows = random_forest(seed, n)
    rows += rows[::5]  # delivered twice
    got = hierarchy(make(spark, rows), rows_per_task=per_task)
    assert {(r.id, r.root, r.depth, r.n_revoked) for r in got.collect()} == brute.lineages([(a, b, c) for a, b, c, _, _ in rows])
    assert got.count() == got.select("id").distinct().count()


@pytest.mark.parametrize("per_task", [500_000, 20])
def test_paths_and_descendants(spark, per_task):
    rows = random_forest(9, 80)
    r = hierarchy(make(spark, rows), rows_per_task=per_task, with_paths=True)
    truth = {x[0]: x for x in brute.lineages([(a, b, c) for a, b, c, _, _ in rows])}
    parent = {a: brute.uid(b) for a, b, *_ in rows}
    below = set()
    for x in r.collect():
        if x.cyclic:
            assert x.path == [] and truth[x.id][2] == -1
            continue
        line = [x.id]
        while line[-1] != x.root:
            line.append(parent[line[-1]])
        assert x.path == line
        below |= {(a, x.id, d) for d, a in enumerate(line) if d}
    assert {tuple(x) for x in descendants(r).collect()} == below


def test_long_chain_and_circles(spark):
    n = 300
    parents = {i: (i - 1 if i else None) for i in range(n)} | {n: n, n + 1: n + 2, n + 2: n + 3, n + 3: n + 1, n + 4: n + 2}
    rows = rows_of(parents, {0, 5, n - 1}, random.Random(0))
    for per_task in (40, 500_000):
        got = {r.id: r for r in hierarchy(make(spark, rows), rows_per_task=per_task).collect()}
        assert (got[uid(n - 1)].depth, got[uid(n - 1)].root, got[uid(n - 1)].n_revoked) == (n - 1, uid(0), 3)
        assert (got[uid(n)].root, got[uid(n)].depth) == (uid(n), -1)
        assert {got[uid(n + k)].root for k in (1, 2, 3, 4)} == {uid(n + 1)}
        assert uid(0) not in got


def test_nulls_blanks_and_empty(spark):
    rows = [(uid(1), None, None, None, None), (uid(2), "  ", 1, None, None), (uid(3), "00000000-0000-0000-0000-000000000000", 0, "a", None), (uid(4), uid(1), None, None, None), (None, uid(1), 0, "a", None), (uid(5), "x" * 100_000, 0, "a", None)]
    got = [tuple(r)[:4] for r in hierarchy(make(spark, rows)).collect()]
    assert got == [(uid(4), uid(1), 1, 0)]
    assert hierarchy(make(spark, []), with_paths=True).collect() == []


def test_hot_root(spark):
    rows = [(uid(0), None, 0, "a", "")] + [(uid(i), uid(0), 0, "a", "") for i in range(1, 500)]
    got = hierarchy(make(spark, rows), rows_per_task=50).collect()
    assert len(got) == 499 and {(r.root, r.depth) for r in got} == {(uid(0), 1)}


@pytest.mark.parametrize("with_paths", [False, True])
def test_quotient_of_over_20_000_rows_is_solved_whole(spark, with_paths):
    n, rng = 45_000, random.Random(3)
    order = list(range(n))
    rng.shuffle(order)
    parents = {order[0]: None} | {order[k]: order[max(0, k - rng.randint(1, 2000))] for k in range(1, n)}
    circle = {n + k: n + (k + 1) % 3 for k in range(3)}
    rows = rows_of(parents | circle, {i for i in range(n) if rng.random() < 0.2}, rng)
    got = hierarchy(make(spark, rows), with_paths=with_paths).collect()
    flags = {i: r for i, _, r, *_ in rows}
    depth, rev = {uid(order[0]): 0}, {uid(order[0]): flags[uid(order[0])]}
    for k in range(1, n):
        i, p = uid(order[k]), uid(parents[order[k]])
        depth[i], rev[i] = depth[p] + 1, rev[p] + flags[i]
    want = {(i, uid(order[0]), d, rev[i]) for i, d in depth.items() if d} | {(uid(i), uid(n), -1, -1) for i in circle}
    assert len(got) == len(want) and {(r.id, r.root, r.depth, r.n_revoked) for r in got} == want
    if with_paths:
        assert all(r.path[-1] == r.root and len(r.path) == r.depth + 1 for r in got if not r.cyclic)


def test_paths_of_a_long_chain_take_no_climb_a_node(spark):
    """8 million path elements in one task, and the same chain cut into many fragments."""
    n = 4_000
    nodes = spark.range(n).select(F.format_string("%06d", "id").alias("id"), F.lit("z").alias("zone"), F.when(F.col("id") > 0, F.format_string("%06d", F.col("id") - 1)).alias("parent"), F.lit(0).alias("revoked"))
    for per_task in (500_000, 300):
        r = hierarchy(nodes, rows_per_task=per_task, with_paths=True)
        got = r.select("depth", F.size("path").alias("n"), F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("z"), "id").collect()
        assert len(got) == n - 1 and all(x.n == x.depth + 1 and x.a == x.id and x.z == "000000" for x in got)


def test_doubling_gives_the_same_paths(spark):
    """A quotient that does not shrink: every chain hops between ranges, so each task holds single nodes."""
    rows = random_forest(11, 90)
    nodes = make(spark, rows)
    q = hierarchy_module.materialize(nodes.select("id", "zone", "parent", "revoked", F.lit(1).cast("long").alias("w"), F.col("revoked").cast("long").alias("wr"), F.lit(None).cast("string").alias("loop"), F.col("id").alias("low"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("piece")), "q")
    known = q.join(q.select(F.col("id").alias("parent")), "parent", "left_semi").unionByName(q.join(q.select(F.col("id").alias("parent")), "parent", "left_anti").withColumn("parent", F.lit(None).cast("string")).withColumn("piece", F.array().cast("array<string>")))
    a = {r.id: (r.steps, r.rev, r.loop, r.above if r.loop is None else None) for r in hierarchy_module._double(known, 90, True).collect()}
    b = {r.id: (r.steps, r.rev, r.loop, r.above if r.loop is None else None) for r in hierarchy_module._solve(known, 500_000, True).collect()}
    assert {k: v if v[2] is None else v[2] for k, v in a.items()} == {k: v if v[2] is None else v[2] for k, v in b.items()}


def test_growing_sides_are_never_broadcast(spark):
    for with_paths in (False, True):
        plan = hierarchy(make(spark, random_forest(5, 50)), 10, with_paths)._jdf.queryExecution().toString()
        assert "Broadcast" not in plan


def test_the_smallest_id_of_a_circle_may_lie_inside_a_fragment(spark):
    """0 and 1 share a zone, 2 stands alone: the fragment's top is 1, the circle's smallest id still 0."""
    nodes = spark.createDataFrame([("0", "a", "1", 0), ("1", "a", "2", 0), ("2", "b", "0", 0)] + [(f"x{i}", "c", None, 0) for i in range(3)], "id string, zone string, parent string, revoked long")
    for per_task in (1, 2, 3, 500_000):
        assert {(r.id, r.root) for r in hierarchy(nodes, rows_per_task=per_task).collect()} == {("0", "0"), ("1", "0"), ("2", "0")}
