import json
import random

from recordloom.operators import flatten
from tests import brute

SCHEMA = "id string, payload_json string, evidence_json string, tags_json string, pointer string, field string"


def value(rng, depth=0):
    k = rng.random()
    if depth > 3 or k < 0.35:
        return rng.choice([None, True, 1, 2.5, 10**30, "text", "", " [1, 2", "{broken", "é中", '{"in":[1,{"x":2}]}', ' [1,"[2]"] ', '"[]"'])
    if k < 0.7:
        return {rng.choice(["a", "b/c", "d~e", "", "0", "ü"]) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def records(seed, n=80):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        f = []
        for _ in range(3):
            t = json.dumps(value(rng), ensure_ascii=rng.random() < 0.5)
            f.append(rng.choice([t, t, t, json.dumps(t), t[:-1], None, "", "plain", "NaN", "[NaN]"]))
        out.append({"id": f"00000000-0000-7000-8000-{i:012d}", "payload_json": f[0], "evidence_json": f[1], "tags_json": f[2], "pointer": "clash", "field": "clash"})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_equals_brute_force(spark):
    rows = records(5)
    got = [tuple(r)[:4] for r in flatten.nested_nodes(frame(spark, rows + rows[::4])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.nodes(rows)


def test_empty_null_and_very_deep(spark):
    assert flatten.nested_nodes(frame(spark, [])).collect() == []
    deep = "[" * 3000 + "{}" + "]" * 3000
    rows = [{"id": "00000000-0000-7000-8000-000000000001", "payload_json": deep, "evidence_json": None, "tags_json": json.dumps(["x" * 200_000]), "pointer": "", "field": ""}, {"id": None, "payload_json": "[1]", "evidence_json": None, "tags_json": None, "pointer": "", "field": ""}]
    got = flatten.nested_nodes(frame(spark, rows)).collect()
    assert len(got) == 3001 and max(len(r.pointer) for r in got) == 6000
    assert {r.parent_pointer + "/0" for r in got} == {r.pointer for r in got}


def test_lone_surrogates_do_not_crash(spark):
    rows = [{"id": "00000000-0000-7000-8000-000000000001", "payload_json": '{"\\ud800k": {"a": 1}}', "evidence_json": None, "tags_json": None, "pointer": "", "field": ""}]
    assert [r.pointer for r in flatten.nested_nodes(frame(spark, rows)).collect()] == ["/�k"]


def test_variants_route_to_typed_tables(spark, tmp_path):
    payloads = ['{"o": [{"k": 1, "t": "a"}, {"k": 2, "t": "b"}, {"k": 3}]}', '{"o": [{"k": 4, "t": "c", "in": {"z": true}}]}']
    rows = [{"id": f"00000000-0000-7000-8000-{i:012d}", "payload_json": p, "evidence_json": None, "tags_json": None, "pointer": "", "field": ""} for i, p in enumerate(payloads)]
    flatten.write_variant_tables(frame(spark, rows), str(tmp_path))
    cat = spark.read.parquet(f"{tmp_path}/catalog").where("place = '/o/*'").collect()
    assert sorted((r.n_objects, tuple(r["keys"])) for r in cat) == [(1, ("k",)), (1, ("k", "t")), (2, ("k", "t"))]
    assert {tuple(r.common_keys) for r in cat} == {("k",)}
    two = next(r for r in cat if r.n_objects == 2)
    assert two.types == {"k": "int", "t": "text"}
    table = flatten.subtype_table(str(tmp_path), spark, two.variant)
    assert dict(table.dtypes)["k"] == "decimal(38,0)" and dict(table.dtypes)["t"] == "string"
    got = table.orderBy("pointer").collect()
    assert [(r.pointer, r.parent_pointer, int(r.k), r.t) for r in got] == [("/o/0", "", 1, "a"), ("/o/1", "", 2, "b")]
    child = spark.read.parquet(f"{tmp_path}/subtypes").where("pointer = '/o/0/in'").collect()
    assert [r.parent_pointer for r in child] == ["/o/0"]


def test_keys_of_digits_and_stars_are_no_list_positions(spark):
    rows = [{"id": "00000000-0000-7000-8000-000000000001", "payload_json": '{"by_year": {"2024": {"x": {}}, "*": {}}, "l": [{}]}', "evidence_json": None, "tags_json": None, "pointer": "", "field": ""}]
    got = {r.pointer: r.place for r in flatten.object_rows(frame(spark, rows)).collect()}
    assert got == {"": "", "/by_year": "/by_year", "/by_year/2024": "/by_year/2024", "/by_year/2024/x": "/by_year/2024/x", "/by_year/*": "/by_year/~2", "/l/0": "/l/*"}


def test_very_deep_records_fill_the_tables(spark):
    deep = '{"a":' * 1500 + "1" + "}" * 1500
    rows = [{"id": "00000000-0000-7000-8000-000000000001", "payload_json": deep, "evidence_json": "[" * 1500 + "]" * 1500, "tags_json": None, "pointer": "", "field": ""}]
    assert flatten.object_rows(frame(spark, rows)).count() == 1500 and flatten.element_rows(frame(spark, rows)).count() == 1500
    assert flatten.object_rows(frame(spark, [])).collect() == [] == flatten.element_rows(frame(spark, [])).collect()


def test_routing_keeps_every_row(spark):
    nodes = flatten.nested_nodes(frame(spark, records(5)))
    assert sorted(map(tuple, flatten.routed(nodes).select("record_id", "field", "pointer").collect())) == sorted(map(tuple, nodes.select("record_id", "field", "pointer").collect()))


def test_same_shape_same_variant():
    a = flatten.walk(json.loads('[{"x": 1, "y": "s"}]'), {})[3][0]
    assert a == flatten.walk(json.loads('[{"y": "t", "x": 9}]'), {})[3][0] != flatten.walk(json.loads('[{"y": 1, "x": 9}]'), {})[3][0]


def test_typed_columns_and_clashing_keys(spark, tmp_path):
    rows = [{"id": "00000000-0000-7000-8000-000000000001", "payload_json": '[{"pointer": true, "f": 1.5, "n": null, "big": 123456789012345678901234567890, "s": "[broken"}]', "evidence_json": None, "tags_json": None, "pointer": "", "field": ""}]
    flatten.write_variant_tables(frame(spark, rows), str(tmp_path))
    v = spark.read.parquet(f"{tmp_path}/catalog").first()
    r = flatten.subtype_table(str(tmp_path), spark, v.variant).first()
    assert (r.pointer, r.pointer_, r.f, r.n, int(r.big), r.s) == ("/0", True, 1.5, None, 123456789012345678901234567890, "[broken")


def opened(v):
    v = flatten.unwrap(v)
    return {k: opened(x) for k, x in v.items()} if type(v) is dict else [opened(x) for x in v] if type(v) is list else v


def rebuilt(objects, elements):
    """(record_id, field) -> value, from the rows of the flat tables alone."""
    read = lambda text, kind: text if kind == "text" else None if kind == "null" else json.loads(text)
    at = {(r.record_id, r.field, r.pointer): {k: read(t, r.types[k]) for k, t in r.members.items()} for r in objects}
    at |= {(r.record_id, r.field, r.pointer): [] if r.kind == "list" else read(r.value, r.kind) for r in elements}
    position = lambda p: [(0, int(s), "") if s.isdigit() else (1, 0, s) for s in p.split("/")]
    for rid, field, p in sorted(at, key=lambda x: position(x[2])):
        if p:
            up, step = p.rsplit("/", 1)
            holder = at[rid, field, up]
            if type(holder) is list:
                assert len(holder) == int(step)
                holder.append(at[rid, field, p])
            else:
                holder[step.replace("~1", "/").replace("~0", "~")] = at[rid, field, p]
    return {(rid, field): v for (rid, field, p), v in at.items() if not p}


def test_records_can_be_rebuilt_from_the_tables(spark, tmp_path):
    rows = records(7, 150)
    rows[0] |= {"payload_json": '{"a": 1, "e": [], "o": {}, "l": [[], [1, "x", null, [true]]]}', "evidence_json": '["a", "b"]', "tags_json": '{"\\ud800k": "\\ud800"}'}
    flatten.write_variant_tables(frame(spark, rows), str(tmp_path))
    got = rebuilt(spark.read.parquet(f"{tmp_path}/subtypes").collect(), spark.read.parquet(f"{tmp_path}/elements").collect())
    want = {(r["id"], f): opened(v) for r in rows for f in flatten.FIELDS if (v := flatten.parse(r[f])) is not flatten.NOTHING}
    want[rows[0]["id"], "tags_json"] = {"�k": "�"}
    assert got == want
    nodes = {(r.record_id, r.field, r.pointer, r.parent_pointer) for r in flatten.nested_nodes(frame(spark, rows)).collect()}
    parts = {tuple(r) for d in ("subtypes", "elements") for r in spark.read.parquet(f"{tmp_path}/{d}").select("record_id", "field", "pointer", "parent_pointer").collect()}
    assert nodes <= parts
    root = spark.read.parquet(f"{tmp_path}/subtypes").where(f"pointer = '' AND record_id = '{rows[0]['id']}' AND field = 'payload_json'").first()
    assert (root.parent_pointer, root.members["a"]) == (None, "1")
    table = flatten.element_table(str(tmp_path), spark, "int")
    assert dict(table.dtypes)["value"] == "decimal(38,0)" and ("/l/1/0", 1) in {(r.pointer, int(r.value)) for r in table.where("field = 'payload_json'").collect()}
