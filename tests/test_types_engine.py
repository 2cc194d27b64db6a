import pytest

from recordloom.functions import jsonschema as js
from recordloom.operators import context as cx
from recordloom.operators import engine, ledger, sync, types
from recordloom.operators.digests import prefix_digest


@pytest.mark.parametrize("value,schema,n", [
    ({"a": 1}, {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}}}, 2), ([1, 1], {"type": "array", "uniqueItems": True, "items": {"type": "integer", "minimum": 2}}, 3), (True, {"type": "integer"}, 1), (1.0, {"type": "integer"}, 0),
    (None, {"type": ["string", "null"]}, 0), ("ab", {"minLength": 3, "pattern": "^x"}, 2), ({"z": 1}, {"properties": {}, "additionalProperties": False}, 1), (5, {"enum": ["5", 5]}, 0), (1, {"enum": [True]}, 1), (3, {"anyOf": [{"type": "string"}, {"maximum": 2}]}, 1),
    (3, {"oneOf": [{"type": "integer"}, {"minimum": 1}]}, 1), (3, {"not": {"type": "integer"}}, 1), ({"x1": "s"}, {"patternProperties": {"^x": {"type": "number"}}}, 1), ([1, "a"], {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, 0), ({}, {}, 0), ({}, False, 1), ([1, 2], {"maxItems": 1, "const": [1]}, 2),
])
def test_schema_keywords(value, schema, n):
    assert len(js.faults(value, schema)) == n


def test_declared_fields_through_items():
    s = {"properties": {"a": {"type": "string"}, "l": {"type": "array", "items": {"properties": {"k": {"type": ["integer", "null"]}}}}}, "required": ["a"]}
    assert set(js.fields(s)) == {"a", "l", "l.k"} and js.fields(s)["a"]["required"] and js.fields(s)["l.k"]["type"] == "integer|null"


def test_lineage():
    assert types.current_types({"a": [], "b": ["a"], "c": []}) == {"b", "c"}
    for bad in ({"a": ["x"]}, {"a": ["b"], "b": ["a"]}, {"a": [], "b": ["a"], "c": ["a"]}):
        with pytest.raises(types.LineageFault):
            types.current_types(bad)


def test_payload_faults_and_fields(spark):
    rows = [("1", "t", '{"a": 1}'), ("2", "t", '{"a": "x", "n": null}'), ("3", "u", "{}"), ("4", "t", None), ("5", "t", '{"a":"x","b":[1,2,3,4,5,6,7]}')]
    df = spark.createDataFrame(rows, "id string, type_name string, payload string")
    schema = {"t": {"properties": {"a": {"type": "string"}, "b": {"items": {"type": "string"}}}}}
    got = {r.id: (r.n_faults, r.faults) for r in types.payload_faults(df, schema).collect()}
    assert set(got) == {"1", "3", "4", "5"} and got["5"][0] == 7 and got["5"][1].count(";") == 4 and got["1"][1] == "/a: is not string"
    assert {r.id: r.fields for r in types.project_fields(df, ["n", "type", "zz"]).collect()}["2"] == '{"n":null,"type":"t"}'
    kinds = spark.createDataFrame([("a.step.v1", "{}"), ("steps.taken.v1", '{"purpose":1}'), ("x.y.v1", '{"do":1,"kind":"k"}'), ("x.y.v1", None)], "type_name string, payload string")
    assert [r.k for r in kinds.select(types.record_kind().alias("k")).collect()] == ["step", "process", "role", "other"]


VIEW = "id string, namespace string, type_name string, actor string, recorded_at string, observed_at string, valid_at string, record_sha256 string, payload string, evidence string, tags string, supersedes string, superseded boolean, revoked boolean"


@pytest.fixture(scope="module")
def store(spark):
    texts = ["frozen receipt", "frozen migration of receipts", "gardens bloom", "receipt printed", "gone receipt", "old receipt"]
    rows = [(str(i), "n", "t.a.v1", "me", f"2025-01-0{i + 1}", None, None, "s", f'{{"rule":"{t}"}}', "[]", '["x"]' if i else '["draft"]', None, i == 5, i == 4) for i, t in enumerate(texts)]
    view = spark.createDataFrame(rows, VIEW)
    docs = sync.documents(view)
    points = sync.hashed_embedding(docs).join(docs.select("id", "input_sha256"), "id")
    embed = lambda q: [float(x) for x in sync.hashed_embedding(spark.createDataFrame([("q", q)], "id string, text string")).first()[1]]
    return view, docs, points, embed


def ids(report):
    return [r.id for r in report.hits.orderBy("position").collect()]


def test_strategies(spark, store):
    view, docs, points, embed = store
    e = engine.SearchEngine(view, points, docs, embed)
    text = e.search("receipt frozen", "fts")
    assert set(ids(text)) == {"0", "1", "3"} and text.total_matches == 3 and text.answered_by == "fts"
    assert set(ids(e.search("receipt frozen", "fts", flags=["record.tags=!draft"]))) == {"1", "3"}
    vec = e.search("receipt", "vector", limit=2)
    assert len(ids(vec)) == 2 and vec.total_matches is None and vec.rejected.count() == 0
    both = e.search("receipt", "hybrid", limit=10)
    assert both.answered_by == "hybrid" and set(ids(both)) == {"0", "1", "2", "3"}
    off = engine.SearchEngine(view, policy=engine.Policy(vector_enabled=False))
    assert off.search("receipt", "hybrid").fallback == "vector retrieval is disabled"
    with pytest.raises(engine.Unavailable):
        off.search("receipt", "vector")
    for bad in ({"limit": 0}, {"strategy": "graph"}):
        with pytest.raises(ValueError):
            e.search("x", **bad)


def test_stale_vectors_are_rejected_and_text_stands_in(spark, store):
    from pyspark.sql import functions as F

    view, docs, points, embed = store
    stale = points.withColumn("input_sha256", F.lit("old"))
    e = engine.SearchEngine(view, stale, docs, embed, engine.Policy(fill_remaining=False))
    r = e.search("receipt", "hybrid")
    assert r.rejected.count() == 6 and r.answered_by == "fts" and r.fallback and set(ids(r)) == {"0", "1", "3"}
    e.points = points
    assert e.search("receipt", "hybrid").answered_by == "vector"


def test_tombstones_and_pending(spark, store):
    view, *_ = store
    t = ledger.tombstones(view, spark.createDataFrame([("0",), ("9",)], "id string"), "x:revoked", "2025-02-01").collect()
    assert [(r.supersedes, r.tags, r.payload) for r in t] == [("0", '["draft","x:revoked"]', '{"rule":"frozen receipt"}')]
    d = prefix_digest(view, 4)
    assert ledger.pending(view, 4, d) == ("records", 2) and ledger.pending(view, 6, prefix_digest(view, 6)) == ("none", 0)
    assert ledger.pending(view, 4, "other") == ("unknown", None) and ledger.pending(view, 9, d) == ("unknown", None)


def test_first_source_and_cardinality(spark):
    rows = [("1", "t", "relevant", ["hybrid"], "vector"), ("2", "t", "relevant", ["hybrid"], "fts"), ("3", "t", "relevant", ["hybrid", "tag"], "fts"), ("4", "u", "core", ["tag"], "fts"), ("5", "v", None, [], None)]
    df = spark.createDataFrame(rows, "id string, type_name string, tier string, strategies array<string>, source string")
    assert sorted(r.id for r in cx.keep_first_source(df).collect()) == ["1", "3", "4", "5"]
    assert sorted(r.id for r in cx.keep_first_source(df.where("id <> '1'")).collect()) == ["2", "3", "4", "5"]
    got = {(r.type_name, r.expected): r.n_found for r in cx.cardinality_faults(df, {"t": "one", "u": "one", "v": "some", "w": "any"}).collect()}
    assert got == {("t", "one"): 3, ("v", "some"): 0}
    assert cx.tier_totals([{"tier": "core", "tokens": 5, "source": "fts"}, {"tier": "core", "tokens": 2}])["core_tokens"] == 7


def test_small_pieces(spark, tmp_path):
    import json
    import uuid

    from pyspark.sql import functions as F

    from recordloom.functions.ids import point_id
    from recordloom.operators import digests, ingest
    from recordloom.streaming import catchup

    store, rec = uuid.uuid4(), uuid.uuid4()
    assert spark.range(1).select(point_id(str(store), F.lit(str(rec)))).first()[0] == _uuid5_of_bytes(store, rec)
    a, b = (spark.createDataFrame(r, "id string, record_sha256 string") for r in ([("1", "x"), ("2", "y"), ("3", None)], [("2", "z"), ("3", None), ("4", "w")]))
    assert {r.id: r.fault for r in ledger.compare(a, b).collect()} == {"1": "missing", "2": "digest", "4": "extra"}
    assert digests.write_receipt(spark, str(tmp_path), {"b": 1, "a": "é"}) == digests.write_receipt(spark, str(tmp_path), {"a": "é", "b": 1}) and len(list(tmp_path.glob('*.json'))) == 1
    assert digests.set_digest("m", ["a", "b"]) != digests.set_digest("m", ["b", "a"])
    m = tmp_path / "m.jsonl"
    m.write_text('{"path":"a","expiry":{"pointer":"/x"}}\n\n{"path":"b"}\n')
    assert [e["path"] for e in ingest.read_manifest(spark, str(m))] == ["a", "b"] and ingest.read_manifest(spark, str(m))[0]["expiry"] == {"warning_days": 30, "pointer": "/x"}
    for bad in ('{"path":"a"}\n{"path":"a"}', '{"x":1}', '{"path":"a","zz":1}'):
        m.write_text(bad)
        with pytest.raises(ValueError):
            ingest.read_manifest(spark, str(m))
    m.write_text(json.dumps({"a": 1}, indent=1))
    assert not ingest.is_batch(spark, str(m))
    m.write_text('{"a":1}\n{"a":2}\n')
    assert ingest.is_batch(spark, str(m))
    assert [catchup.cooldown(n) for n in (0, 1, 2, 6, 9)] == [0, 1, 2, 32, 32]
    left = [3]
    assert catchup.drain_until_level(lambda: left.__setitem__(0, left[0] - 1), lambda: left[0] > 0) == 3 and catchup.drain_until_level(lambda: None, lambda: True, most_passes=5) == 5
    p = catchup.Position(3, 10, "d", {"max_chars": 5})
    assert [p.freshness(3, {"max_chars": 5}), p.freshness(4, {"max_chars": 5}), p.freshness(2, {"max_chars": 5}), p.freshness(3, {})] == ["current", "behind", "ahead", "other settings"]


def _uuid5_of_bytes(store, rec):
    import hashlib
    import uuid

    return str(uuid.UUID(bytes=hashlib.sha1(store.bytes + rec.bytes).digest()[:16], version=5))


def test_guards_frames_and_coordinates():
    from recordloom.operators import context, filters, sync

    assert filters.guard_pool(50, 100) == 100 and filters.guard_pool(200, 100) == 200
    with pytest.raises(ValueError):
        filters.guard_pool(10_001, 10)
    rules = [("greeting", r"(?i)^(hi|hello)\b"), ("short", r"^.{0,3}$")]
    assert [context.skipped_by(q, rules) for q in ("Hello there", "ok", "a real question")] == ["greeting", "short", None]
    assert context.parse_coordinates(["role=runner", "project=a, b"]) == {"role": "runner", "project": ["a", "b"]}
    for bad in (["role"], ["=x"], ["role="], ["role=a,,b"], ["role=a", "role=b"]):
        with pytest.raises(ValueError):
            context.parse_coordinates(bad)
    assert sync.room_for_query(None, 10) == 10 and sync.room_for_query("find", 40) == 40 - len(sync.framed_query("find", ""))
    with pytest.raises(ValueError):
        sync.room_for_query("x" * 100, 50)


def test_write_verdicts(spark):
    from recordloom.operators import grants

    drafts = spark.createDataFrame([("1", "a", "n", "t", '{"k":{"x":"v"}}', None, None), ("2", "a", "m", "t", None, None, None), ("3", "b", "n", "t", "{}", "m", "t"), ("4", "b", "n", "t", "{}", "n", "t"), ("5", "held", "n", "t", "{}", None, None), ("6", None, "n", "t", "{}", None, None)], "id string, actor string, namespace string, type_name string, payload string, parent_namespace string, parent_type string")
    given = spark.createDataFrame([("a", "n", "*", {"/k/x": "v"}), ("b", "n", "t", None), ("held", "*", "*", None)], "actor string, namespace string, type_name string, payload_equals map<string,string>")
    hold = spark.createDataFrame([("held",), ("*",)], "actor string")
    want = {"1": "granted", "2": "refused", "3": "refused", "4": "granted", "5": "read_only", "6": "refused"}
    assert {r.id: r.verdict for r in grants.write_verdicts(drafts, given, hold).collect()} == want
    assert grants.write_verdicts(drafts.limit(0), given, hold).collect() == []


def test_rewritten_lines_touch_nothing_else(spark):
    from recordloom.operators import compaction

    lines = ['{"id": "a",  "supersedes": "x.1",\t"payload": "{\\"supersedes\\":\\"x.1\\"}"}', '{"id":"b","supersedes":"keep"}', '{"id":"x.1"}', "no record", '{"id":"c"}']
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ordinal int, line string")
    got = {r.ordinal: r.line for r in compaction.rewritten_lines(df, spark.createDataFrame([("x.1", "superseded")], "id string, reason string")).collect()}
    assert got == {0: lines[0].replace('"supersedes": "x.1"', '"supersedes": null'), 1: lines[1], 3: lines[3], 4: lines[4]}
