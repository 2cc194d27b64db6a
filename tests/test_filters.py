import json

import pytest

from recordloom.functions.text import porter
from recordloom.operators import filters


def hold(payload, flag, strict=False, envelope=None):
    return filters.holds(payload, envelope or {}, filters.parse_flag(flag), strict)


@pytest.mark.parametrize("payload,flag,strict,want", [
    ({"a": "x"}, "a=x", False, True), ({"a": "x"}, "a=y,x", False, True), ({"a": "x"}, "a=!x", False, False), ({"a": "x"}, "a=!y,z", False, True),
    ({}, "a=x", False, True), ({}, "a=x", True, False), ({"a": None}, "a=x", True, False), ({"a": None}, "a=x", False, True),
    ({}, "a=null", False, True), ({"a": None}, "a=null", True, True), ({"a": 1}, "a=null", False, False), ({}, "a=!null", False, False), ({"a": 0}, "a=!null", False, True),
    ({}, "a=x,null", True, True), ({"a": "y"}, "a=x,null", False, False), ({"a": 1}, "a=1", False, True), ({"a": 1.0}, "a=1.0", False, True), ({"a": True}, "a=true", False, True), ({"a": "1"}, "a=1", False, True),
    ({"a": ["x", "y"]}, "a=y", False, True), ({"a": ["x", "y"]}, "a=!x", False, False), ({"a": [["x"]]}, "a=x", False, True), ({"a": {"x": 1}}, "a=x", False, False),
    ({"a": [{"c": 1}, {"b": "v"}]}, "a.b=v", False, True), ({"a": [{"b": "u"}, {"b": "v"}]}, "a.b=v", False, False),
])
def test_truth_table(payload, flag, strict, want):
    assert hold(payload, flag, strict) is want


def test_addressing():
    env = {"evidence": [{"kind": "e"}], "tags": ["t"], "namespace": "n"}
    assert hold({"evidence": {"sha": "p"}}, "evidence.sha=p", True, env) and hold({}, "record.evidence.kind=e", True, env)
    assert hold({"namespace": "own"}, "namespace=own", True, env) and not hold({"namespace": None}, "namespace=n", True, env)
    assert hold({}, "namespace=n", True, env) and not hold({}, "tags.x=t", True, env)


@pytest.mark.parametrize("flag", ["colour", "=tint", "colour=", "k=!null,blue", ".colour=tint", "k..m=n", "k=x,"])
def test_refused_forms(flag):
    with pytest.raises(ValueError):
        filters.parse_flag(flag)


def test_declared_fields():
    filters.check_declared(["rule=x", "record.evidence.kind=y", "payload.rule=z", "tags=t"], {"rule"})
    for flag in ("nope=x", "record.nope=x", "payload.tags=x", "tags.x=y"):
        with pytest.raises(ValueError):
            filters.check_declared([flag], {"rule"})


def test_frame_agrees_with_rows(spark):
    rows = [("1", "n", "t.a.v1", None, json.dumps({"a": "x", "l": [1, 2]}), '[{"kind":"k"}]', '["u"]'), ("2", None, "t.a.v1", "me", '{"a": null}', "[]", "[]"), ("3", "m", "t.b.v1", "me", None, None, None), ("4", "n", "t.b.v1", "you", "{bad", None, '["u","w"]')]
    df = spark.createDataFrame(rows, "id string, namespace string, type_name string, actor string, payload string, evidence string, tags string")
    got = lambda *flags, strict=False: [r.id for r in filters.where(df, list(flags), strict).orderBy("id").collect()]
    assert got("a=x") == ["1", "2", "3", "4"] and got("a=x", strict=True) == ["1"]
    assert got("record.namespace=n") == ["1", "2", "4"] and got("record.namespace=n", strict=True) == ["1", "4"]
    assert got("record.namespace=!n", strict=True) == ["3"] and got("record.actor=null") == ["1"] and got("record.type=t.b.v1", "tags=u", strict=True) == ["4"]
    assert got("evidence.kind=k", strict=True) == ["1"] and got("l=2", strict=True) == ["1"]
    assert filters.where(df.limit(0), ["a=x"]).count() == 0


@pytest.mark.parametrize("a,b", [("worktrees", "worktree"), ("fixtures", "fixture"), ("mutations", "mutation"), ("withdrawal", "withdraw"), ("running", "run"), ("hopping", "hop"), ("relational", "relate"), ("ponies", "poni"), ("caresses", "caress"), ("agreed", "agree")])
def test_porter_pairs(a, b):
    assert porter(a) == porter(b)


def test_conditions_on_plain_columns_reach_the_scan(spark, tmp_path):
    rows = [(f"00000000-0000-7000-8000-{i:012d}", ["n", "m", None][i % 3], ["t.a.v1", "t.b.v1"][i % 2], None, "2025-01-01T00:00:00Z", "2025-01-01T00:00:00Z", None, json.dumps({"a": i}), "[]", '["u"]', None, 0, 0, "s", "l") for i in range(12)]
    schema = "id string, namespace string, type_name string, actor string, recorded_at string, observed_at string, valid_at string, payload_json string, evidence_json string, tags_json string, supersedes string, superseded int, revoked int, record_sha256 string, ledger string"
    spark.createDataFrame(rows + rows[:4], schema).write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    from recordloom.operators import ledger

    for flags, strict in ((["record.namespace=n", "record.type=t.a.v1", "a=6"], False), (["record.namespace=!n"], True), (["record.namespace=!n", "tags=u"], False), (["record.tags=u", "a=3,null"], True), (["record.recorded_at=x"], False)):
        got = filters.where_records(records, flags, strict)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in filters.where(ledger.ledger_view(records), flags, strict).collect())
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for strict in (True, False):
        plan = filters.where_records(records, ["record.namespace=n", "record.type=t.a.v1", "a=6"], strict)._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line)
        assert "EqualTo(type_name,t.a.v1)" in scan and "EqualTo(namespace,n)" in scan
        assert "evidence_json" not in scan.split("ReadSchema")[1] and "tags_json" not in scan.split("ReadSchema")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
