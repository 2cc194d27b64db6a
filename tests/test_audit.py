import math
import random

import pytest

from recordloom.operators import audit

SCHEMA = "id string, at long, nanos int, duration long, surface string, operation string, outcome string, session string, actor string, event string, ledger string, d string"


def rows(seed, n):
    rng = random.Random(seed)
    return [(f"e{i}", i // 3, rng.randint(0, 9), rng.choice([None, 5, 5, rng.randint(0, 10**7), rng.randint(0, 100)]), "cli", rng.choice(["a", "b", None, "c"]), rng.choice(["error", "success", None]), "s", rng.choice(["A", " a", None]), rng.choice(['{"output":{"count":0}}', '{"output":{"count":2}}', "{bad", None]), "2025-01", "clash") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 400])
def test_statistics(spark, n):
    data = rows(n, n)
    df = spark.createDataFrame(data + data[:3], SCHEMA)
    got = {r.operation: r for r in audit.statistics(audit.unique(df), ["operation"]).collect()}
    one = audit.statistics(audit.unique(df)).first()
    groups = {k: sorted(r[3] or 0 for r in data if r[5] == k) for k in {r[5] for r in data}}
    groups_all = sorted(r[3] or 0 for r in data)
    for r, d in [(got[k], v) for k, v in groups.items()] + [(one, groups_all)]:
        assert (r.n, r.least_us, r.most_us, r.p95_us) == (len(d), d[0], d[-1], d[math.ceil(0.95 * len(d)) - 1])
    assert one.failures == sum(r[6] == "error" for r in data) and one.error_rate == pytest.approx(one.failures / n, abs=1e-6)


def test_nearest_rank_of_one_to_fifty(spark):
    df = spark.range(1, 51).select(audit.F.col("id").alias("d"))
    assert audit.nearest_rank(df, [], "d", 0.95, "p").first().p == 48


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    r = audit.statistics(none).first()
    assert (r.n, r.failures, r.error_rate, r.p95_us, r.mean_us) == (0, 0, 0.0, 0, 0.0)
    assert audit.statistics(none, ["operation"]).collect() == [] and audit.newest(none, 5).collect() == []


def test_predicate_list_and_misses(spark):
    data = rows(5, 60)
    df = spark.createDataFrame(data, SCHEMA)
    got = [r.id for r in audit.newest(audit.select(df, {"operation": "a"}, 3, 15), 1000).collect()]
    want = sorted((r for r in data if r[5] == "a" and 3 <= r[1] < 15), key=lambda r: (r[1], r[2], r[0]), reverse=True)
    assert got == [r[0] for r in want]
    m = {r.operation: (r.n_queries, r.n_misses) for r in audit.misses(df).collect()}
    for k in {r[5] for r in data}:
        told = [r[9] for r in data if r[5] == k and r[9] and "output" in r[9]]
        assert m.get(k, (0, 0)) == (len(told), sum('"count":0' in t for t in told))
    for bad in (lambda: audit.newest(df, 0), lambda: audit.newest(df, 1001), lambda: audit.select(df, {"event": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_coordinates(spark):
    df = spark.createDataFrame([("ok-1.a/b",), ("bad name",), ("x" * 65,), (None,)], "c string")
    got = [r[0] for r in df.select(audit.coordinate(audit.F.col("c"))).collect()]
    assert got[0] == "ok-1.a/b" and got[1].startswith("sha256:") and len(got[2]) == 71 and got[3] is None
