import random
from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import packing as pk


def check(rows, sizes, capacity):
    load, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        if r.container_id is not None:
            load[r.container_id] += r.n_tokens
        parts[r.doc_id].append((r.piece, r.token_start, r.n_tokens))
    assert all(v <= capacity for v in load.values())
    for d, n in sizes:
        got = sorted(parts[d])
        assert sum(x[2] for x in got) == (n or 0) and [x[0] for x in got] == list(range(len(got)))
        at = 0
        for _, s, k in got:
            assert s == at
            at += k
        assert len(got) == 1 or (n or 0) > capacity
    return len(load)


def test_pack_sizes_properties():
    rng = random.Random(0)
    for _ in range(60):
        cap = rng.choice([1, 2, 3, 10, 100, 1000])
        sizes = np.array([rng.randint(1, rng.choice([cap, max(1, cap // 3)])) for _ in range(rng.randint(0, 200))], np.int64)
        box = pk.pack_sizes(sizes, cap)
        load = np.bincount(box, sizes, minlength=1) if len(sizes) else np.zeros(1)
        assert (load <= cap).all() and (not len(sizes) or set(box) == set(range(box.max() + 1)))
        assert (np.bincount(box, 3 * sizes > cap) <= 2).all() if len(sizes) else True


def test_large_items_are_matched_as_well_as_possible():
    # Against exhaustive matching: containers for items above a third are items less pairs.
    from itertools import combinations

    def most_pairs(items, cap):
        if len(items) < 2:
            return 0
        first, rest = items[0], items[1:]
        return max([most_pairs(rest, cap)] + [1 + most_pairs(rest[:k] + rest[k + 1 :], cap) for k in range(len(rest)) if first + rest[k] <= cap])

    rng = random.Random(5)
    for _ in range(80):
        items = [rng.randint(34, 100) for _ in range(rng.randint(1, 8))]
        assert pk.pack_sizes(np.array(items), 100).max() + 1 == len(items) - most_pairs(items, 100)
    assert combinations


@pytest.mark.parametrize("per_task", [500_000, 40])
def test_every_piece_once_and_little_waste(spark, per_task):
    rng = random.Random(1)
    sizes = [(i, rng.choice([None, 0, 7, 7, 7, rng.randint(1, 60), rng.randint(1, 400)])) for i in range(400)]
    df = spark.createDataFrame([(d, n, "x", 1) for d, n in sizes], "doc_id long, n_tokens long, piece string, container_id int")
    rows = pk.pack(df, 100, per_task).collect()
    used = check(rows, sizes, 100)
    least = -(-sum(n or 0 for _, n in sizes) // 100)
    assert used <= least * (1.01 if per_task > 400 else 1.1) + 1


def test_empty_and_profiles(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).collect() == []
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 0)
    budgets = spark.createDataFrame([("w", 1, 5), ("w", 2, 8), ("x", 1, None), (None, 1, 3)], "profile_id string, version int, total_tokens long")
    assert pk.profiles_in_force(budgets) == [("w", 2, 8)]
    docs = spark.createDataFrame([(1, "one two three " * 20, "de"), (2, None, None), (3, "", "x"), (4, "short", "x")], "doc_id long, text string, lang string")
    packed = pk.pack_profiles(docs, budgets)
    rep = pk.packing_report(packed).collect()
    assert len(rep) == 1 and rep[0].capacity == 8 and rep[0].containers >= rep[0].least_containers
    assert {r.doc_id for r in packed.where("container_id is null").collect()} == {2, 3}
    assert [tuple(r) for r in pk.packing_checks(packed).collect()] == [("w", 4, 0, 0, 0, 0)]


def test_repeated_ids_of_different_size_pack_the_same_whatever_the_order(spark):
    rows = [(1, n) for n in (7, 3, 9, 3, 5)] + [(None, n) for n in (4, 4, 8)]
    got = [sorted(map(str, pk.pack(spark.createDataFrame(r, "doc_id long, n_tokens long"), 10).select("n_tokens", "container_id").collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1]
