import random

import pytest

from recordloom.llm import mixing as mx

DOCS = "doc_id long, text string, source string, slot string"
GOALS = "source string, target_share double, max_repeats int"


def test_pfair_stays_within_one_block():
    rng = random.Random(2)
    for _ in range(30):
        blocks = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 9))}
        out = mx.pfair(blocks)
        total = sum(blocks.values())
        assert len(out) == len(set(out)) == total
        seen = dict.fromkeys(blocks, 0)
        for t, (s, k) in enumerate(out, 1):
            assert k == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - t * blocks[x] / total) < 1 for x in blocks)
    assert mx.pfair({}) == []


def test_periods_go_on_within_one_block():
    """The schedule beyond one period: the same slots again, level at each period's end, whatever the number of blocks."""
    blocks, periods = mx.period({"a": 10**12, "b": 3 * 10**12 + 7, "c": 10**9}, 5 * 10**6, 500)
    one, whole = mx.pfair(blocks), sum(blocks.values())
    assert periods == 10_000 and blocks["c"] == 1 and abs(whole - 500) <= 2
    done = dict.fromkeys(blocks, 0)
    for t in range(3 * whole):
        s, k = one[t % whole]
        assert (done[s] // blocks[s]) * whole + one.index((s, done[s] % blocks[s])) == t
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * blocks[x] / whole) < 1 for x in blocks)
    assert mx.period({}, 0) == ({}, 1)


def test_plan_is_the_largest_that_repeats_allow():
    q = mx.plan({"a": 100, "b": 1000, "c": 50}, {"a": (0.5, 2), "b": (0.5, 1), "gone": (0.2, None), "z": (0.0, 1)})
    assert q == {"a": 200, "b": 200}
    assert mx.plan({"a": 10}, {}) == {} and mx.plan({}, {"a": (1.0, 1)}) == {}
    assert mx.plan({"a": 10, "b": 30}, {"a": (0.25, None), "b": (0.75, None)}) == {"a": 10, "b": 30}


def documents(spark, seed=3, n=1200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["hot", "HOT ", "mid", " Small", "other", None], [50, 20, 20, 4, 10, 2])[0]
        rows.append((i, None if rng.random() < 0.02 else " ".join(["word"] * rng.choice([0, 3, 9, 30, 90])), source, "clash"))
    return spark.createDataFrame(rows, DOCS)


def test_shares_repeats_and_order(spark):
    docs = documents(spark)
    goals = spark.createDataFrame([("Hot", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("nobody", 0.1, None)], GOALS)
    out = mx.mix(docs, goals)
    rows = out.collect()
    tokens = {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    whole = sum(tokens.values())
    for s, w in (("hot", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(tokens[s] / whole - w) < 0.003
        assert next(r.actual_share for r in rows if r.source == s) == pytest.approx(tokens[s] / whole)
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.use_no)
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    most = {"hot": 1, "mid": 2, "small": 3}
    assert all(len(u) <= most[s] for (s, _), u in uses.items())
    for s in most:  # documents of a source are used as evenly as whole passes allow
        counts = [len(u) for (x, _), u in uses.items() if x == s]
        assert max(counts) - min(counts) <= 1
    assert [(r.source, r.n_overused, r.n_blocks_off, r.n_shares_off) for r in mx.mix_checks(out, goals).orderBy("source").collect()] == [("hot", 0, 0, 0), ("mid", 0, 0, 0), ("nobody", 0, 0, 0), ("small", 0, 0, 0)]
    rep = {r.source: r for r in mx.share_report(out, goals).collect()}
    assert rep["nobody"].actual_share == 0.0 and rep["small"].most_uses <= 3 and sum(r.n_uses for r in rep.values()) == len(rows)
    # Interleaving: after any slot every source is near its weight.
    rows.sort(key=lambda r: (r.slot, r.source_position))
    seen, at = dict.fromkeys(tokens, 0), 0
    for r in rows:
        seen[r.source] += r.n_tokens
        at += r.n_tokens
        assert all(abs(seen[s] - at * tokens[s] / whole) < 0.03 * whole + 200 for s in seen)


def test_the_stream_of_many_periods_is_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mx, "PERIOD", 16)
    monkeypatch.setattr(mx.period, "__defaults__", (16,))
    docs = documents(spark, 4, 900)
    goals = spark.createDataFrame([("hot", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], GOALS)
    out = mx.mix(docs, goals)
    assert out.agg({"slot": "max"}).first()[0] > 100
    assert all(r.ahead < 1 and r.behind < 1 for r in mx.block_deviation(out).collect())
    assert {(r.n_overused, r.n_blocks_off) for r in mx.mix_checks(out, goals).collect()} == {(0, 0)}


def test_empty_tables(spark):
    goals = spark.createDataFrame([("a", 0.5, 1)], GOALS)
    none = spark.createDataFrame([], DOCS)
    assert mx.mix(none, goals).collect() == []
    assert [r.actual_share for r in mx.share_report(mx.mix(none, goals), goals).collect()] == [0.0]
    assert mx.mix(documents(spark), goals.limit(0)).collect() == []
