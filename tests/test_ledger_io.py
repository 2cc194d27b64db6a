import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import compaction, defense, digests, ingest, ledger, sync
from recordloom.sources.tables import table
from recordloom.streaming import catchup

SF = "/root/testdata/sf0.001"


def line(i, **kw):
    return json.dumps({"id": f"id{i}", "namespace": "n", "type": "a.b.v1", "actor": "x", "recorded_at": "2025-01-01T00:00:00Z", "observed_at": "2025-01-01T00:00:00Z", "payload": "{}", "evidence": [], "tags": []} | kw)


def test_read_fails_closed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(f"{line(1)}\n\n{line(2)}\n")
    got = ingest.read_ledger(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r.id for r in got.collect()) == ["id1", "id2"]
    for bad in (f"{line(1)}\n{{broken\n", f"{line(1)}\n{line(1)}\n"):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(ingest.BrokenLedger):
            ingest.read_ledger(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "c.jsonl").write_text("")
    assert ingest.read_ledger(spark, str(tmp_path / "c.jsonl")).count() == 0


def test_a_line_in_the_making_is_left_out(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text(f"{line(1)}\n{line(2)[:20]}é")
    (tmp_path / "l" / "b.jsonl").write_text(f"{line(3)}\n")
    (tmp_path / "l" / "c.jsonl").write_text("")
    path = f"file://{tmp_path}/l"
    assert [x.rsplit("/", 1)[1] for x in ingest.torn_tails(spark, path)] == ["a.jsonl"]
    assert sorted(r.id for r in ingest.read_ledger(spark, path, whole_only=True).collect()) == ["id1", "id3"]
    with pytest.raises(ingest.BrokenLedger):
        ingest.read_ledger(spark, path)


def test_round_trip_by_month(spark, tmp_path):
    rows = [("1", "n", "a.b.v1", "x", "2025-01-31T23:30:00-02:00", "o", "v", '{"k":1}', '[{"kind":"k","reference":"r"}]', '["t"]', None), ("2", "n", "a.b.v1", None, "2025-01-02T00:00:00Z", "o", None, None, None, None, "1")]
    df = spark.createDataFrame(rows, "id string, namespace string, type_name string, actor string, recorded_at string, observed_at string, valid_at string, payload string, evidence string, tags string, supersedes string")
    ingest.write_ledger(df, str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").iterdir() if p.is_dir()) == ["month=2025-01", "month=2025-02"]
    back = {r.id: r for r in ingest.read_ledger(spark, f"{tmp_path}/l/*").collect()}
    assert back["1"].payload == '{"k":1}' and back["1"].evidence[0].kind == "k" and back["2"].supersedes == "1"
    assert [json.loads(r.line)["id"] for r in ingest.read_shards(spark, f"{tmp_path}/l", ["2025-02"]).collect()] == ["1"]


def test_import_and_replay(spark):
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "ordinal long, sha256 string")
    got = {r.ordinal: r.action for r in ingest.import_plan(lines, spark.createDataFrame([("b",)], "sha256 string")).collect()}
    assert got == {1: "import", 2: "known", 3: "repeated", 4: "import"}
    req = spark.createDataFrame([(1, "a", "k", "x"), (2, "a", "k", "x"), (3, "a", "k", "y"), (4, "b", "k", "y"), (5, "b", "z", "q")], "ordinal long, actor string, key string, draft_sha256 string")
    done = spark.createDataFrame([("b", "z", "p")], "actor string, key string, draft_sha256 string")
    assert {r.ordinal: r.verdict for r in ingest.replay(req, done).collect()} == {1: "new", 2: "replay", 3: "conflict", 4: "new", 5: "conflict"}
    targets = spark.createDataFrame([(1, "old-1"), (2, "{0190AA5A-65BA-756B-BD53-8E7329EEF594}"), (3, "nowhere"), (4, None)], "ordinal long, target string")
    ids = spark.createDataFrame([("0190aa5a-65ba-756b-bd53-8e7329eef594",)], "id string")
    r = {x.ordinal: (x.resolved, x.failed) for x in ingest.resolve_supersedes(targets, spark.createDataFrame([("old-1", "new-1")], "legacy string, id string"), ids).collect()}
    assert r == {1: ("new-1", False), 2: ("0190aa5a-65ba-756b-bd53-8e7329eef594", False), 3: (None, True), 4: (None, False)}


def test_counts_with_a_superseded_tombstone(spark):
    df = spark.createDataFrame([("1", None, False), ("2", "1", True), ("3", "2", False)], "id string, supersedes string, revoked boolean")
    c = ledger.counts(ledger.with_superseded(df)).first()
    assert (c.total, c.live, c.dead, c.n_superseded, c.n_revoked, c.n_both) == (3, 1, 2, 2, 1, 1)
    v = ledger.with_superseded(df)
    kept = compaction.rewritten(v, compaction.native_plan(v)).collect()
    assert [(r.id, r.supersedes, r.severed) for r in kept] == [("3", None, True)]
    with pytest.raises(ValueError):
        ledger.scan(df, None, None, 0)


def test_observation_skew_is_exact(spark):
    rows = [("1", "2025-01-01T01:01:00+01:00", "2025-01-01T00:00:00Z"), ("2", "2025-01-01T00:01:00.000001Z", "2025-01-01T00:00:00Z"), ("3", "2020-01-01T00:00:00Z", "2025-01-01T00:00:00Z"), ("4", None, "x")]
    df = spark.createDataFrame(rows, "id string, observed_at string, recorded_at string")
    assert [(r.id, r.ahead_us) for r in ledger.too_early(df).collect()] == [("2", 60_000_001)]


def test_manifest_plan(spark):
    rows = [("1", None, False, "[]"), ("2", "1", False, '["expires:2025-01-01T00:00:00Z"]'), ("3", None, False, '["expires:2025-05-20T00:00:00Z"]'), ("4", None, False, '["anchor:ticket:A"]'), ("5", None, False, '["Anchor:Diff:B"]'), ("6", None, False, '["anchor:trunk:C"]'), ("7", "8", False, "[]"), ("8", None, False, "[]"), ("9", None, False, None)]
    v = ledger.with_superseded(spark.createDataFrame(rows, "id string, supersedes string, revoked boolean, tags string"))
    facts = spark.createDataFrame([("anchor:ticket", "a", "alive", "2025-01-01"), ("Anchor:Ticket", "A ", "DEAD", "2025-02-01"), ("anchor:diff", "b", "alive", "2025-01-01")], "kind string, target string, state string, recorded_at string")
    got = {r.id: (r.remove, r.reason) for r in compaction.manifest_plan(v, compaction.anchor_states(facts), "2025-06-01T00:00:00Z").collect()}
    assert got == {"1": (True, "superseded"), "2": (True, "expired"), "3": (False, "expiry_warning_window"), "4": (True, "dead_anchor"), "5": (False, "active_anchor"), "6": (False, "unknown_anchor"), "7": (False, "active_descendant"), "8": (True, "superseded")}


def test_digests(spark):
    import hashlib

    rows = [(f"{i:03d}", f"s{i}") for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "id string, record_sha256 string")
    want = hashlib.sha256("".join(s for _, s in rows).encode()).hexdigest()
    assert digests.corpus_digest(df) == want == digests.corpus_digest(df.repartition(7))
    assert digests.prefix_digest(df, 2) == hashlib.sha256(b"s0s1").hexdigest() and digests.corpus_digest(df.limit(0)) == hashlib.sha256(b"").hexdigest()
    from pyspark.sql import functions as F

    one = spark.range(1).select(digests.chain(F.array(F.lit("a"), F.lit("b"))).alias("c"), digests.fingerprint(F.array().cast("array<string>")).alias("f")).first()
    assert one.c == hashlib.sha256((hashlib.sha256(b"a").hexdigest() + "b").encode()).hexdigest() and one.f is None


def test_secrets(spark):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    pem = "-----BEGIN PRIVATE KEY-----\n" + "A1b2" * 20 + "\n-----END PRIVATE KEY-----"
    rows = [(1, f"first\n use {key} now"), (2, "nothing here, an api key is not told"), (3, None), (4, ""), (5, pem), (6, f"token: {key}{'aB3' * 6}"), (7, "password = aaaaaaaaaaaaaaaaaaaaaaaa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.rule): (r.line, r.col) for r in defense.findings(df, "doc_id", "text").collect()}
    assert got[1, "aws-access-token"] == (2, 6) and (5, "private-key") in got and (6, "generic-api-key") in got and not any(k[0] in (2, 3, 4, 7) for k in got)
    red = {r.doc_id: r.redacted for r in defense.redact(df, "doc_id", "text").collect()}
    assert red[1] == "first\n use [REDACTED:aws-access-token] now" and key not in red[6]
    ok, refused = defense.apply_policy(df, "doc_id", "text")
    assert sorted(r.doc_id for r in ok.collect()) == [2, 3, 4, 7] and sorted(r.doc_id for r in refused.collect()) == [1, 5, 6]
    assert defense.redacted("abcdefgh", [(1, 4, "x"), (2, 6, "y"), (7, 8, "z")]) == "a[REDACTED:x+y]g[REDACTED:z]"
    own = defense.custom_rules("[[rules]]\nid = \"my rule\"\nregex = '''zz[0-9]+'''\nkeywords = [\"zz\"]\n")
    assert [r.rule for r in defense.findings(spark.createDataFrame([(1, "zz12")], "doc_id long, text string"), "doc_id", "text", own).collect()] == ["my_rule"]


def test_delta(spark):
    s = "id string, record_sha256 string, input_sha256 string"
    got = sync.delta(spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z"), ("4", "d", "w")], s), spark.createDataFrame([("1", "a", "x"), ("2", "B", "y"), ("3", "c", "Z"), ("5", "e", "q")], s))
    assert {r.id: r.action for r in got.collect()} == {"1": "unchanged", "2": "relabel", "3": "embed", "4": "embed", "5": "delete"}
    assert sync.canonical_text("n", "t", ["b", "a", "b", 1], {"k": [1, None, {"z/y": True}], "a": "é"}) == "namespace n\ntype t\ntag a\ntag b\n/a é\n/k/0 1\n/k/2/z~1y true\n"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    ev = table(spark, SF, "audit_events")
    a, b = ev.randomSplit([0.5, 0.5], 3)
    a.coalesce(2).write.parquet(str(src))
    catchup.drain(spark, f"file://{src}", ev.schema, out, catchup.partial_counts, 1)
    b.unionByName(a.limit(20)).coalesce(1).write.mode("append").parquet(str(src))
    assert catchup.drain(spark, f"file://{src}", ev.schema, out, catchup.partial_counts) == 1
    assert catchup.drain(spark, f"file://{src}", ev.schema, out, catchup.partial_counts) == 0
    whole = catchup.partial_counts(ev).dropDuplicates(["id"]).groupBy("month", "operation").count()
    assert {(r.month, r.operation): r.n for r in catchup.merged_counts(spark, out).collect()} == {(r.month, r.operation): r["count"] for r in whole.collect()}


def test_word_count_and_validity_patterns(spark):
    import re

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a  b\tc\n",), ("",), (None,), ("x y　z",)], "t string")
    assert [r[0] for r in df.select(ingest.word_count(F.col("t"))).collect()] == [3, 0, 0, 3]
    assert all(re.match(ingest.TYPE_NAME, t) for t in ("a.b.v1", "a-1.b.c.v20")) and not any(re.match(ingest.TYPE_NAME, t) for t in ("a.v1", "a.b.1", "A.b.v1", "a.b.v"))
    assert all(re.match(ingest.POINTER, t) for t in ("", "/a", "/a~1b/0")) and not any(re.match(ingest.POINTER, t) for t in ("a", "/a~2"))


def test_sync_applied(spark):
    s = "id string, record_sha256 string, input_sha256 string"
    corpus = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z"), ("4", "d", "w")], s)
    index = spark.createDataFrame([("1", "a", "x", [1.0]), ("2", "B", "y", [2.0]), ("3", "c", "Z", [3.0]), ("5", "e", "q", [5.0])], s + ", embedding array<double>")
    plan = sync.delta(corpus, index)
    fresh = spark.createDataFrame([("3", [30.0]), ("4", [40.0])], "id string, embedding array<double>")
    after = sync.applied(index, plan, corpus, fresh)
    assert {r.id: (r.record_sha256, r.input_sha256, r.embedding) for r in after.collect()} == {"1": ("a", "x", [1.0]), "2": ("b", "y", [2.0]), "3": ("c", "z", [30.0]), "4": ("d", "w", [40.0])}
    assert {r.action for r in sync.delta(corpus, after).collect()} == {"unchanged"}


def test_documents_are_whole_unless_asked(spark):
    v = spark.createDataFrame([("1", "n", "t", "s", "[]", json.dumps({"a": "x" * 20_000})), ("2", " ", "t", "s", None, None)], "id string, namespace string, type_name string, record_sha256 string, tags string, payload string")
    r = sync.documents(v).first()
    assert len(r.text) > 20_000 and not r.truncated
    cut = sync.documents(v, 100).first()
    assert len(cut.text) == 100 and cut.truncated and cut.input_sha256 != r.input_sha256 and sync.documents(v).count() == 1


def test_publish_verifies_swaps_and_recovers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/led"
    one, two = spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("b", 2), ("c", 3)], "id string, n int")
    compaction.publish(one, path)
    first = compaction.publish(two, path, {"why": "test"})
    assert sorted(r.id for r in spark.read.parquet(f"{path}/current").collect()) == ["b", "c"]
    assert [r.id for r in spark.read.parquet(f"{path}/before-{first}").collect()] == ["a"]
    assert compaction.recover(spark, path) == "nothing to do"
    # Dies between the two moves: nothing is in force, the verified shadow is put there.
    moves, real = [], compaction.move_path

    def dying(s, a, b):
        moves.append(b)
        if len(moves) == 2:
            raise RuntimeError("lost")
        real(s, a, b)

    monkeypatch.setattr(compaction, "move_path", dying)
    with pytest.raises(RuntimeError):
        compaction.publish(one, path)
    monkeypatch.setattr(compaction, "move_path", real)
    assert compaction.recover(spark, path) == "shadow put in force" and [r.id for r in spark.read.parquet(f"{path}/current").collect()] == ["a"]


def test_point_reads_and_claims(spark):
    records = table(spark, SF, "records")
    some = [r[0] for r in records.select("id").limit(3).collect()]
    got = ledger.get(records, spark.createDataFrame([(some[0].upper(),), (some[1],), ("no such id",), (None,)], "id string"))
    assert {r.id for r in got.collect()} == {x.lower() for x in some[:2]} and got.columns[0] == "id"
    reg = spark.createDataFrame([("a.v1", "dag", []), ("a.v2", "linear", ["a.v1"]), ("b.v1", "linear", None)], "type_name string, lifecycle_mode string, predecessor_types array<string>")
    v = spark.createDataFrame([("1", "a.v1"), ("2", "a.v2"), ("3", "b.v1"), ("4", "c.v1")], "id string, type_name string")
    assert {(r.id, r.claimed_by) for r in ledger.claims(v, reg).collect()} == {("1", "a.v2"), ("2", "a.v2"), ("3", "b.v1")}


def test_ordinals_count_through_the_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r.ordinal, r.k) for r in ledger.ordinals(df, "k").orderBy("ordinal").collect()] == [(i + 1, i) for i in range(1000)]
    assert ledger.ordinals(df.limit(0), "k").collect() == []
