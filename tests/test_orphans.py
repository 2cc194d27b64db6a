import json
import random
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from recordloom.operators import orphans
from tests import brute

SCHEMA = "id string, namespace string, recorded_at string, supersedes string, evidence_json string, target_key string"
FACTS = "kind string, target string, state string, recorded_at timestamp"
GONE = "record_id string, reason string"


def uid(i):
    return f"00000000-0000-7000-8000-{i:012d}"


def fixture(seed=3, n=120):
    rng = random.Random(seed)
    records = []
    for i in range(n):
        t = f"2025-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}:00:00.{rng.randint(0, 999999):06d}{rng.choice(['Z', '+02:00', '-08:00'])}"
        ev = []
        for _ in range(rng.randint(0, 4)):
            ref = rng.choice([uid(rng.randrange(n + 40)), uid(rng.randrange(n)).upper(), "urn:uuid:" + uid(n + 3), None, ""])
            ev.append(rng.choice([{"kind": rng.choice(["record", " RECORD", "file", None]), "reference": ref}, f"record:{ref}", f"Record : {ref}", {"kind": "anchor:ticket", "reference": f" TCK-{rng.randint(1, 9)} "}, f"anchor:diff:D{rng.randint(1, 4)}", "Anchor:Trunk:t/1", "free record: text", 5, [1], json.dumps({"kind": "record", "reference": uid(n + 1)})]))
        text = rng.choice([json.dumps(ev), json.dumps(ev, indent=1), json.dumps(json.dumps(ev)), json.dumps(ev)[:-1], None, json.dumps(ev[0]) if ev and isinstance(ev[0], dict) else "[]"])
        records.append({"id": uid(i), "namespace": "a", "recorded_at": t, "supersedes": rng.choice([None, "", uid(rng.randrange(n + 20)), "{" + uid(rng.randrange(n)) + "}"]), "evidence_json": text, "target_key": "clash"})
    facts = [("Anchor:Ticket", f"tck-{k}", rng.choice(["alive", "DEAD", " dead"]), datetime(2025, 5, k)) for k in range(1, 8)] + [("anchor:ticket", "TCK-2", "alive", datetime(2025, 8, 1)), ("anchor:diff", "d1", "dead", datetime(2025, 1, 1)), (None, "x", "dead", None)]
    gone = [(uid(n + k).upper(), "r") for k in range(0, 20, 2)] + [(None, None), (uid(1), "back again")]
    return records, facts, gone


def frames(spark, records, facts, gone):
    return spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA), spark.createDataFrame(facts, FACTS), spark.createDataFrame(gone, GONE)


def test_equals_brute_force(spark):
    records, facts, gone = fixture()
    truth = brute.faults(records, [(k, t, s, int(a.replace(tzinfo=timezone.utc).timestamp() * 1e6)) for k, t, s, a in facts if k], [g[0] for g in gone])
    fr = frames(spark, records + records[:30], facts, gone)
    got = [tuple(r) for r in orphans.faulty_references(*fr).collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    assert {x[5] for x in truth} == {"missing", "deleted", "late"}
    # Beyond the bound the filters are tested slice by slice, here all three of them.
    assert {tuple(r) for r in orphans.faulty_references(*fr, most_filter_bytes=0).collect()} == truth


def test_empty_tables(spark):
    assert orphans.faulty_references(*frames(spark, [], [], [])).collect() == []
    records, facts, gone = fixture(4, 5)
    assert orphans.faulty_references(*frames(spark, records, [], [])).count() >= 0
    rep = orphans.fault_report(orphans.faulty_references(*frames(spark, records, facts, gone)))
    assert set(rep.columns) == {"target_table", "source_field", "period", "status", "n_references", "n_targets"}


def test_null_columns(spark):
    rows = [{"id": uid(1), "namespace": None, "recorded_at": None, "supersedes": uid(9), "evidence_json": None, "target_key": None}, {"id": None, "namespace": None, "recorded_at": None, "supersedes": uid(9), "evidence_json": None, "target_key": None}]
    got = [tuple(r) for r in orphans.faulty_references(*frames(spark, rows, [], [])).collect()]
    assert got == [(uid(1), "supersedes", "records", uid(9), None, "missing")]


def test_bloom_has_no_false_negatives():
    keys = [f"k{i}" for i in range(5000)]
    b = orphans.Bloom(orphans.Bloom.size_for(len(keys)))
    b.add(orphans.key_hashes(keys))
    assert b.holds(keys).all()
    assert np.mean(b.holds([f"other{i}" for i in range(5000)])) < 0.02


def test_bloom_is_built_by_slices(spark):
    keys = [f"k{i}é" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    one = orphans.Bloom(orphans.Bloom.size_for(3000))
    one.add(orphans.key_hashes(keys))
    assert orphans.build_bloom(df, 3000).bits.tobytes() == one.bits.tobytes()
    assert not orphans.build_bloom(df.limit(0), 0).holds(["x"]).any()


def test_sliced_filter_proves_most_absent_keys_and_no_present_one(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    wanted = spark.range(30_000).select(F.xxhash64(F.concat(F.lit("k"), "id")).alias("h"), "id")
    absent = orphans.absent_hashes(keys, wanted.unionByName(wanted), 20_000, keys_per_task=1_500).join(wanted, "h")
    got = {r.id for r in absent.collect()}
    assert min(got) >= 20_000 and len(got) > 9_700
    assert orphans.absent_hashes(keys.limit(0), wanted.limit(5), 0).count() == 5


def test_growing_sides_are_never_broadcast(spark):
    plan = orphans.faulty_references(*frames(spark, *fixture(4, 20)))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan
