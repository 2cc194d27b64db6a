from collections import defaultdict

import pytest

from recordloom.operators import features as fx

SCHEMA = "id string, at long, duration long, actor string, operation string, outcome string, bucket long, n string"
DAY = 86_400


def events(n=400):
    out = []
    for i in range(n):
        actor = [None, "  ", "A ", "a", "b", "hot"][i % 6 if i % 3 else 5]
        out.append((f"e{i}", 1_700_000_000 + (i * 791_923) % (200 * DAY), None if i % 11 == 0 else i, actor, f"op{i % 4}", [None, "ok", "error"][i % 3], 7, "clash"))
    return out + out[:50] + [(None, 1_700_000_000, 5, "b", "op0", "ok", 7, ""), (None, 1_700_000_000, 5, "b", "op0", "ok", 7, "")]


def truth(rows, lo=None, hi=None):
    seen, out = set(), defaultdict(lambda: [0, None, 0])
    for i, at, d, a, op, oc, *_ in rows:
        if i is not None and i in seen or lo is not None and not lo <= at < hi:
            continue
        seen.add(i)
        a = (a or "").strip().lower() or None
        x = out[a, op, oc]
        x[0] += 1
        x[1] = max(x[1] or at, at)
        x[2] += d or 0
    return {k: tuple(v) for k, v in out.items()}


def as_dict(df):
    return {(r.actor, r.operation, r.outcome): (r.n, r.latest_at, r.total_duration) for r in df.collect()}


def test_features_equal_brute_force(spark):
    rows = events()
    store = fx.FeatureStore(spark)
    store.refresh(spark.createDataFrame(rows, SCHEMA))
    merged = store.merged()
    assert as_dict(merged) == truth(rows)
    labels = fx.labels_of(merged)
    wide = fx.wide(merged, labels).collect()
    assert len(wide) == len({k[0] for k in truth(rows)}) and len(wide[0]) == 1 + 3 * len(labels)
    cell = {(r["actor"], x): (r[f"{x}_n"], r[f"{x}_latest_at"], r[f"{x}_total_duration"]) for r in wide for x in labels}
    for (a, op, oc), v in truth(rows).items():
        assert cell[a, f"{op}|{oc or 'missing'}"] == v
    assert sum(v == (0, None, 0) for v in cell.values()) == len(cell) - len(truth(rows))
    long = {(r.actor, r.event_type): (r.n, r.latest_at, r.total_duration) for r in fx.long_form(merged, labels).collect()}
    assert long == cell


def test_only_changed_buckets_are_rebuilt(spark, tmp_path):
    rows = events()
    store = fx.FeatureStore(spark, f"file://{tmp_path}/s")
    built = store.refresh(spark.createDataFrame(rows, SCHEMA))
    assert len(built) > 3 and store.refresh(spark.createDataFrame(rows, SCHEMA)) == []
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("partials/bucket=*/*.parquet")}
    late = [("new", 1_700_000_000 + 3 * DAY, 9, "c", "op9", "ok", 7, "")]
    touched = store.refresh(spark.createDataFrame(rows + late, SCHEMA))
    assert touched == [(1_700_000_000 + 3 * DAY) // fx.BUCKET_SECONDS]
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("partials/bucket=*/*.parquet")}
    kept = [p for p in before if f"bucket={touched[0]}" not in str(p)]
    assert kept and all(after[p] == before[p] for p in kept)
    assert as_dict(store.merged()) == truth(rows + late)
    gone = [r for r in rows if r[1] // fx.BUCKET_SECONDS != touched[0]]
    store.refresh(spark.createDataFrame(gone, SCHEMA))
    assert as_dict(store.merged()) == truth(gone)


@pytest.mark.parametrize("lo,hi", [(1_700_000_000, 1_700_000_000 + 100 * DAY), (1_700_000_000 + 5, 1_700_000_000 + 5 * DAY), (fx.BUCKET_SECONDS * 656, fx.BUCKET_SECONDS * 658)])
def test_windows_merge_buckets_and_boundary_events(spark, lo, hi):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    store = fx.FeatureStore(spark)
    store.refresh(df)
    assert as_dict(store.merged(df, lo, hi)) == truth(rows, lo, hi)


def test_empty_table(spark):
    store = fx.FeatureStore(spark)
    store.refresh(spark.createDataFrame([], SCHEMA))
    assert store.merged().collect() == [] and fx.wide(store.merged(), []).collect() == []


def test_more_types_than_any_list_of_before(spark):
    rows = [(f"e{i}", 1_700_000_000 + i, i, f"a{i % 2}", f"op.{i}`", "ok", 0, "") for i in range(2_300)]
    store = fx.FeatureStore(spark)
    store.refresh(spark.createDataFrame(rows, SCHEMA))
    labels = fx.labels_of(store.merged())
    assert len(labels) == 2_300 and fx.long_form(store.merged(), labels).where("n = 1").count() == 2_300
    wide = fx.wide(store.merged(), labels[:40]).collect()
    assert len(wide) == 2 and sum(r[f"{x}_n"] for r in wide for x in labels[:40]) == 40


def test_an_id_in_two_buckets_counts_once_whatever_came_first(spark):
    """x is delivered for day 1 and again for day 40; the earlier one stands, refresh after refresh."""
    x1, x40 = ("x", 1 * DAY, 1, "a", "op", "ok", 0, ""), ("x", 40 * DAY, 1, "a", "op", "ok", 0, "")
    y, z = ("y", 41 * DAY, 1, "a", "op", "ok", 0, ""), ("z", 42 * DAY, 1, "a", "op", "ok", 0, "")
    for steps in ([[x1, x40, y], [z]], [[x40, y], [x1, z]], [[y, z], [x1], [x40]]):
        whole, by_files = fx.FeatureStore(spark), fx.FeatureStore(spark)
        folder, so_far = fx.new_path(spark, "in"), []
        for rows in steps:
            so_far += rows
            whole.refresh(spark.createDataFrame(so_far, SCHEMA))
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            by_files.take_in(folder)
            rebuilt = fx.FeatureStore(spark)
            rebuilt.refresh(spark.createDataFrame(so_far, SCHEMA))
            assert as_dict(whole.merged()) == as_dict(by_files.merged()) == as_dict(rebuilt.merged())
        assert as_dict(whole.merged()) == {("a", "op", "ok"): (3, 42 * DAY, 3)}


def test_a_kept_store_reads_new_files_only(spark, tmp_path):
    rows = events()
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    spark.createDataFrame(rows[:300], SCHEMA).coalesce(1).write.parquet(folder)
    assert len(fx.FeatureStore(spark, path).take_in(folder)) > 3
    assert fx.FeatureStore(spark, path).take_in(folder) == []
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("store/partials/bucket=*/*.parquet")}
    late = [("new", 1_700_000_000 + 3 * DAY, 9, "c", "op9", "ok", 7, ""), rows[5]]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    store = fx.FeatureStore(spark, path)  # another session's object, the same store
    touched = store.take_in(folder)
    assert set(touched) == {x[1] // fx.BUCKET_SECONDS for x in late} and as_dict(store.merged()) == truth(rows[:300] + late)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items() if not any(f"bucket={b}/" in str(p) for b in touched))
    assert store.merged().agg({"n": "sum"}).first()[0] == store.events().count()
    # A file is gone: everything is compared, and what it brought goes.
    for p in (tmp_path / "in").glob("*.parquet"):
        if p.stat().st_mtime_ns == max(q.stat().st_mtime_ns for q in (tmp_path / "in").glob("*.parquet")):
            last = p
    last.unlink()
    store.take_in(folder)
    assert as_dict(store.merged()) == truth(rows[:300])
