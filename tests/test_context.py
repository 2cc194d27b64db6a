import pytest

from recordloom.operators import context as cx

VIEW = "id string, namespace string, type_name string, observed_at string, valid_at string, payload string, tags string, superseded boolean, revoked boolean"


def words(rs):
    return " ".join(r["text"] for r in rs)


def item(i, tier, n):
    return {"id": f"{tier[0]}{i}", "tier": tier, "text": " ".join(["w"] * n)}


def fill(items, **kw):
    return cx.fill_budget(items, cx.Budget(**kw), words, lambda t: len(t.split()))


def test_skip_and_continue_and_caps():
    picked, left = fill([item(1, "relevant", 50), item(2, "relevant", 200), item(3, "relevant", 40)], total=100)
    assert [p["id"] for p in picked] == ["r1", "r3"] and left == [("r2", "total_budget")]
    picked, left = fill([item(1, "core", 90), item(2, "relevant", 60)], total=100, core_cap=100, relevant_floor=60)
    assert [p["id"] for p in picked] == ["r2"] and left == [("c1", "core_cap")]


def test_record_limit_and_required_overflow():
    items = [item(0, "required", 1), item(1, "core", 1), *[item(i, "relevant", 1) for i in range(9)]]
    picked, left = fill(items, total=1000, core_cap=10, records=7)
    assert len(picked) == 7 and {w for _, w in left} == {"record_budget"}
    with pytest.raises(cx.RequiredOverflow):
        fill([item(i, "required", 1) for i in range(8)], total=1000, records=7)
    with pytest.raises(cx.RequiredOverflow):
        fill([item(1, "required", 80)], total=100, required_cap=50)
    assert fill([], total=10) == ([], [])


def test_set_or_wildcard_and_exact():
    assert cx.set_or_wildcard(None, "a") and cx.set_or_wildcard(cx.MISSING, ["a"]) and cx.set_or_wildcard("a", ["b", "a"]) and cx.set_or_wildcard(["a", "b"], ["b"])
    assert not cx.set_or_wildcard("a", "b") and not cx.set_or_wildcard(1, "1") and not cx.set_or_wildcard(True, 1)
    s = cx.Selector("t", coordinate_pointers={"role": "/role"})
    ask = lambda v: cx.Request("2025-01-01T00:00:00Z", coordinates={"role": v})
    assert cx.coordinates_match({"role": None}, s, ask(None)) and not cx.coordinates_match({}, s, ask(None))
    assert cx.coordinates_match({}, s, cx.Request("2025-01-01T00:00:00Z"))


def test_gate_order_and_classes(spark):
    late = "2030-01-01T00:00:00Z"
    rows = [
        ("1", "x", "t", "2025", None, "{}", "[]", True, True), ("2", "n", "t", "2025", late, "{}", "[]", True, True), ("3", "n", "t", "2025", late, "{}", "[]", False, True), ("4", "n", "t", "2025", late, "{}", "[]", False, False),
        ("5", "n", "u", "2025-01-01T00:00:00Z", None, "{}", "[]", False, False), ("6", "n", "t", "2025-01-01T00:00:00Z", None, "{}", '["expires:2025-02-01T00:00:00Z"]', False, False), ("7", "n", "t", "2025-01-01T00:00:00Z", None, '{"role":"b"}', "[]", False, False),
        ("8", "n", "t", "2025-01-01T00:00:00Z", None, '{"role":"a","c":0.5}', '["must"]', False, False), ("9", "n", "t", "2025-01-02T00:00:00Z", None, '{"c":0.9}', None, False, False), ("10", "n", "t", "2025-01-03T00:00:00Z", None, None, '["status:revoked"]', False, False), ("11", None, "t", "2025", None, None, None, False, False),
        ("12", "n", "t", "2025-01-03T00:00:00Z", None, '{"c":0.1}', '["core"]', False, False),
    ]
    df = spark.createDataFrame(rows, VIEW)
    s = [cx.Selector("t", ("recency",), ("must",), ("core",), {"role": "/role"}, {"role": "set_or_wildcard"}, rank_pointer="/c")]
    req = cx.Request("2025-06-01T00:00:00Z", coordinates={"role": ["a"]})
    gated = cx.gate(df, [("n", "t"), ("n", "u")], s, req)
    assert {r.id: r.reason for r in gated.collect()} == {"1": "unauthorized", "2": "superseded", "3": "revoked", "4": "invalid_at_request_time", "5": "selector_mismatch", "6": "expired", "7": "selector_mismatch", "8": None, "9": None, "10": "revoked", "11": "unauthorized", "12": None}
    page = cx.page(cx.classify(gated.where("reason is null"), s, req)).collect()
    assert [(r.id, r.tier) for r in page] == [("8", "required"), ("12", "core"), ("9", "relevant")]


def test_bundle_digest_depends_on_order_and_content():
    a, b = {"id": "1", "record_sha256": "x"}, {"id": "2", "record_sha256": None}
    assert len({cx.bundle_digest(p) for p in ([a, b], [b, a], [a])}) == 3


def classified(spark, monkeypatch, rows):
    from recordloom.plans import ledger_queries

    schema = "id string, tier string, source string, search_rank int, rank double, score int, observed_at string, payload string, record_sha256 string"
    df = spark.createDataFrame([(i, t, None, None, None, 1, None, p, None) for i, t, p in rows], schema)
    monkeypatch.setattr(ledger_queries, "_classified", lambda *_: df)
    return ledger_queries


def test_bundle_query_takes_required_records_first_or_says_overflow(spark, monkeypatch):
    rows = [("a", "relevant", "one two"), ("b", "core", "three"), ("c", "required", "four five six"), ("d", None, "seven")]
    got = classified(spark, monkeypatch, rows).context_bundle(spark, "").collect()
    assert [tuple(r) for r in got] == [(0, "c", "required", 3, "picked"), (1, "b", "core", 1, "picked"), (2, "a", "relevant", 2, "picked")]
    overflow = [(None, None, "required", None, "required_overflow")]
    for more in ([("e", "required", "word " * 800)], [(f"r{i:02d}", "required", "x") for i in range(30)]):
        assert [tuple(r) for r in classified(spark, monkeypatch, rows + more).context_bundle(spark, "").collect()] == overflow


def test_no_candidate_beyond_the_page_is_lost(spark, monkeypatch):
    n = cx.MOST_CANDIDATES + 50
    rows = [(f"{i * 7919 % n:06d}", "core" if i % 3 else "required", "x") for i in range(n)] + [("none", None, "x")]
    queries = classified(spark, monkeypatch, rows)
    want = sorted((t != "required", i) for i, t, _ in rows if t)
    got = sorted(tuple(r) for r in queries.context_order(spark, "").collect())
    assert got == [(k + 1, i, "core" if core else "required") for k, (core, i) in enumerate(want)]
    with pytest.raises(ValueError, match="at most"):
        queries.context_bundle(spark, "")
