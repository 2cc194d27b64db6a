import json
import random

import numpy as np

from recordloom.llm import neardup as nd
from tests.brute import jparse

SCHEMA = "id string, namespace string, type_name string, payload_json string, words string"


def uid(i):
    return f"00000000-0000-7000-8000-{i:012d}"


def words_of(text):
    v, ok = jparse(text)
    return {w for raw in " ".join(nd.text_values(v, [])).split() if (w := nd.word(raw))} if ok else set()


def truth(rows):
    seen = {}
    for i, ns, t, p, _ in rows:
        if i and ns is not None and t is not None and words_of(p):
            seen[i] = (ns, t, words_of(p))
    ids = sorted(seen)
    return {(a, b): 100 * len(seen[a][2] & seen[b][2]) // max(len(seen[a][2]), len(seen[b][2])) for k, a in enumerate(ids) for b in ids[k + 1 :] if seen[a][:2] == seen[b][:2] and 100 * len(seen[a][2] & seen[b][2]) // max(len(seen[a][2]), len(seen[b][2])) >= 70}


def edited(rng, base, vocabulary):
    w = list(base)
    for _ in range(rng.randint(0, max(1, len(w) // 5))):
        k = rng.random()
        if k < 0.4 and w:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif k < 0.7 and w:
            w.pop(rng.randrange(len(w)))
        else:
            w.insert(rng.randrange(len(w) + 1), rng.choice(vocabulary))
    if rng.random() < 0.3:
        rng.shuffle(w)
    return w


def fixture(seed, n=300):
    rng = random.Random(seed)
    common = ["the", "and", "with", "für", "record"]
    vocabulary = [f"w{i:03d}x" for i in range(400)] + common
    bases = [[rng.choice(common if rng.random() < 0.3 else vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 20, 60, 200]))] for _ in range(15)]
    rows = []
    for i in range(n):
        w = edited(rng, rng.choice(bases), vocabulary)
        v = {"key": " ".join(w[::2]), "list": [{"deep": "(" + " ".join(w[1::2]).upper() + ")."}], "n": 5, "text": json.dumps({"in": "inner words"}) if rng.random() < 0.2 else "ab"}
        rows.append((uid(i), rng.choice(["a", "a", "a", "b", None]), rng.choice(["t", "t", "t", "u"]), rng.choice([json.dumps(v), json.dumps(json.dumps(v))]), "clash"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        got = nd.near_duplicate_pairs(frame(spark, rows + rows[::6])).collect()
        want = truth(rows)
        assert len(want) > 50 and len(got) == len(want)
        assert {(r.record_a, r.record_b): r.overlap for r in got} == want


def test_boundary_of_the_overlap(spark):
    ten = [f"word{i}" for i in range(10)]
    rows = [(uid(0), "a", "t", json.dumps(ten), ""), (uid(1), "a", "t", json.dumps(ten[:7]), ""), (uid(2), "a", "t", json.dumps(ten[:6]), ""), (uid(3), "a", "t", json.dumps(ten[:7] + ["x1x", "x2x", "x3x"]), ""), (uid(4), "a", "t", json.dumps(ten[:7] + ["x1x", "x2x", "x3x", "x4x"]), "")]
    got = {(r.record_a[-1], r.record_b[-1]) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == {("0", "1"), ("0", "3"), ("1", "2"), ("1", "3"), ("3", "4")}


def test_nulls_empty_and_long(spark):
    long = " ".join(f"token{i}" for i in range(20_000))
    rows = [(uid(1), "a", "t", None, ""), (uid(2), "a", "t", "{broken", ""), (uid(3), "a", "t", "{}", ""), (uid(4), None, "t", '["same words here"]', ""), (uid(5), None, "t", '["same words here"]', ""), (None, "a", "t", '["same words here"]', ""), (uid(6), "a", "t", json.dumps([long]), ""), (uid(7), "a", "t", json.dumps([long + " more"]), "")]
    assert [(r.record_a, r.record_b, r.overlap) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()] == [(uid(6), uid(7), 99)]
    assert nd.near_duplicate_pairs(frame(spark, [])).collect() == []


def test_large_classes_of_copies_stay_linear(spark):
    rows = [(uid(i), "a", "t", '["alpha beta gamma delta"]', "") for i in range(40)] + [(uid(100 + i), "a", "t", '["alpha beta gamma delta extra"]', "") for i in range(2)]
    got = {(r.record_a, r.record_b) for r in nd.near_duplicate_pairs(frame(spark, rows), 5).collect()}
    assert got == {(uid(0), uid(i)) for i in range(1, 40)} | {(uid(0), uid(100)), (uid(0), uid(101)), (uid(100), uid(101))}
    cls = {r.record_id: (r.class_id, r.n_copies, r.n_links) for r in nd.near_duplicate_classes(frame(spark, rows)).collect()}
    assert cls[uid(7)] == (uid(0), 40, 1) and cls[uid(101)] == (uid(100), 2, 1)


def test_every_pair_on_request(spark):
    rows = [(uid(i), "a", "t", '["alpha beta gamma delta"]', "") for i in range(120)]
    assert nd.near_duplicate_pairs(frame(spark, rows), None).count() == 120 * 119 // 2
    assert nd.near_duplicate_pairs(frame(spark, rows)).count() == 119
    assert nd.near_duplicate_pairs(frame(spark, rows), 1).count() == 119


def apart(a, b):
    return sum((int(x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a.tolist(), b.tolist()))


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(-(2**62), 2**62, 120)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 100))) for _ in range(2))
        for segments in (64, 128, 1024):
            fa, fb = nd.embed([a], segments)[0], nd.embed([b], segments)[0]
            assert len(fa) == segments // 16 and apart(fa, fb) <= len(np.setxor1d(a, b))


def test_the_bound_rejects_unrelated_pairs_at_every_size():
    rng = np.random.default_rng(5)
    bounds = nd.size_cells()
    for n in (30, 90, 120, 300, 600, 1200, 5000):
        k = int(nd.level(np.searchsorted(bounds, n, side="right") - 1))
        assert k == nd.COARSE or n <= k < 4 * n
        sets = [rng.integers(-(2**63), 2**63, n) for _ in range(40)]
        codes = nd.embed(sets, k)
        limit = 2 * n - 2 * nd.need(n)
        far = [apart(codes[i], codes[j]) > limit for i in range(40) for j in range(i)]
        assert np.mean(far) > 0.9, (n, k, np.mean(far))


def test_long_sets_go_through_the_deeper_level(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i:05d}" for i in range(3000)]
    rows = []
    for i in range(12):
        base = rng.sample(vocabulary, rng.choice([110, 180, 400, 1200]))
        for j in range(4):
            w = base[: len(base) - rng.randrange(len(base) // 4)] + rng.sample(vocabulary, rng.randrange(len(base) // 5))
            rows.append((uid(10 * i + j), "a", "t", json.dumps([" ".join(w)]), ""))
    got = {(r.record_a, r.record_b): r.overlap for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == truth(rows) and len(got) > 20


def test_growing_sides_are_never_broadcast(spark):
    rows = fixture(3, 60)
    for f in (nd.near_duplicate_pairs, nd.near_duplicate_classes, nd.near_duplicate_links):
        plan = f(frame(spark, rows))._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_size_cells_reach_one_further():
    b = nd.size_cells(10**7)
    cell = lambda n: np.searchsorted(b, n, side="right") - 1
    for n in [*range(1, 5000), 99_999, 10**6]:
        assert cell(n * 100 // nd.OVERLAP) <= cell(n) + 1 and nd.need(n) * 100 >= 70 * n > (nd.need(n) - 1) * 100


def test_reordered_payloads_are_no_copies(spark):
    rng, ten = random.Random(6), [f"word{i}" for i in range(10)]
    texts = set()
    while len(texts) < 150:
        rng.shuffle(ten)
        texts.add(" ".join(ten))
    rows = [(uid(i), "a", "t", json.dumps([t]), "") for i, t in enumerate(sorted(texts))] + [(uid(200), "a", "t", json.dumps([" ".join(sorted(ten)[:9])]), "")]
    got = {(r.record_a, r.record_b): r.overlap for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert len(got) == 11_175 + 150 and got == truth(rows)
    assert [tuple(r) for r in nd.near_duplicate_links(frame(spark, rows)).collect()] == [(uid(0), uid(200), 90)]


def test_copies_are_equal_as_json(spark):
    texts = ['{"a": "one two", "b": ["é", 1]}', ' {"b":["\\u00e9",1],"a":"one two"}', json.dumps('{"a": "one two", "b": ["é", 1]}')]
    values = [nd.parse(t) for t in texts] + [{"a": "one two", "b": '["é", 1]'}]
    for v in values:
        nd.open_up(v)
    assert len({nd.canonical(v) for v in values}) == 1 != len({nd.canonical(v) for v in (["a", "b"], ["b", "a"])})
    flat = deep = {"b": [1, "x", {}], "a": [[], None]}
    for _ in range(200_000):
        deep = [deep, {"k": 1}]
    assert nd.canonical(deep).startswith("[" * 200_000 + nd.canonical(flat) + ',{"k":1}],')
