"""Queries p2 to p5: the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import features, flatten, hierarchy, orphans
from recordloom.plans.sqltext import clean_sql, us_sql, uuid_sql
from recordloom.session import materialize, new_path
from recordloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hierarchy.hierarchy(hierarchy.ledger_nodes(table(spark, sf_dir, "records")))
    return r.select(F.col("id").alias("record_id"), F.col("root").alias("root_id"), "depth", "n_revoked")


def _with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.ledger_nodes(table(spark, sf_dir, "records")), with_paths=True)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _with_paths(spark, sf_dir)
    return r.select(F.col("id").alias("record_id"), F.col("root").alias("root_id"), "depth", "cyclic", F.concat_ws(">", F.reverse("path")).alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_with_paths(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.faulty_references(*(table(spark, sf_dir, t) for t in ("records", "anchor_facts", "compacted_records")))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.fault_report(p3_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all subtype and element tables together."""
    return flatten.routed(flatten.nested_nodes(table(spark, sf_dir, "records"))).select("record_id", "field", "pointer", "parent_pointer")


def _listed(members: str) -> Column:
    """A map as text: key=value lines in order of the keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(members), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), "\n")


def p4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = flatten.variant_catalog(materialize(flatten.object_rows(table(spark, sf_dir, "records")), "objects"))
    return c.select("field", "place", "variant", "n_objects", _listed("types").alias("types"), F.array_join("keys", ",").alias("keys"), F.array_join("common_keys", ",").alias("common_keys"))


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = flatten.object_rows(table(spark, sf_dir, "records"))
    return o.select("record_id", "field", "pointer", "parent_pointer", "place", "variant", _listed("members").alias("members"))


def p4_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.element_rows(table(spark, sf_dir, "records")).select("record_id", "field", "pointer", "parent_pointer", "place", "kind", "value")


def p4_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables written, and every numeric member read back from its typed column."""
    path = new_path(spark, "variants")
    flatten.write_variant_tables(table(spark, sf_dir, "records"), path)
    return flatten.number_totals(spark.read.parquet(f"{path}/subtypes")).select("field", "place", "key", "type", "n_values", F.round("total", 3).alias("total"))


def _feature_store(spark: SparkSession, sf_dir: str) -> tuple[features.FeatureStore, DataFrame]:
    events = table(spark, sf_dir, "audit_events")
    store = features.FeatureStore(spark)
    store.refresh(events)
    return store, events


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _feature_store(spark, sf_dir)
    merged = materialize(store.merged(), "merged")
    return features.wide(merged, features.labels_of(merged))


def p5_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _feature_store(spark, sf_dir)
    merged = materialize(store.merged(), "merged")
    return features.long_form(merged, features.labels_of(merged))


def p5_features_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of 2025: whole buckets merged, both boundary buckets read from the events."""
    store, events = _feature_store(spark, sf_dir)
    return store.merged(events, 1_735_689_600, 1_751_328_000)


def p5_features_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrived up to the middle month is taken in first, the later files then: late and repeated deliveries change some buckets."""
    events = table(spark, sf_dir, "audit_events")
    months = sorted(r[0] for r in events.select("ledger").distinct().collect() if r[0])
    folder, store = new_path(spark, "arrivals"), features.FeatureStore(spark)
    first = F.coalesce(F.col("ledger") <= (months[len(months) // 2] if months else ""), F.lit(True))
    for part in (first, ~first):
        events.where(part).write.mode("append").parquet(folder)
        store.take_in(folder)
    return store.merged()


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_report, p4_found, p4_variants, p4_objects, p4_elements, p4_typed, p5_features, p5_features_long, p5_features_window, p5_features_refresh)}

_NODES = (
    f"WITH RECURSIVE raw AS (SELECT {uuid_sql('id')} AS id, nullif({uuid_sql('supersedes')}, '00000000-0000-0000-0000-000000000000') AS parent, coalesce(revoked, 0) = 1 AS revoked FROM records), "
    "n AS (SELECT id, min(parent) AS parent, bool_or(revoked) AS revoked FROM raw WHERE id IS NOT NULL GROUP BY id), "
    "e AS (SELECT c.id, c.parent, c.revoked, p.revoked AS p_revoked FROM n c JOIN n p ON p.id = c.parent), "
    # A line stops at a root, or where it meets itself: ``circle`` is then the part that repeats.
    "walk AS (SELECT id, parent AS cur, [id, parent] AS path, CAST(revoked AS INT) + CAST(p_revoked AS INT) AS rev, CASE WHEN parent = id THEN [id] END AS circle FROM e UNION ALL "
    "SELECT w.id, e.parent, list_append(w.path, e.parent), w.rev + CAST(e.p_revoked AS INT), CASE WHEN list_contains(w.path, e.parent) THEN w.path[list_position(w.path, e.parent):] END FROM walk w JOIN e ON e.id = w.cur WHERE w.circle IS NULL), "
    "done AS (SELECT id, cur, path, rev, circle FROM walk w WHERE circle IS NOT NULL OR NOT EXISTS (SELECT 1 FROM e WHERE e.id = w.cur))\n"
)
_KINDS = "record|anchor:ticket|anchor:diff|anchor:trunk"
_P3 = f"""WITH d AS (SELECT {uuid_sql('id')} AS id, {us_sql('recorded_at')} AS us, nullif({uuid_sql('supersedes')}, '00000000-0000-0000-0000-000000000000') AS sup, {clean_sql('evidence_json')} AS ev FROM records),
own AS (SELECT id, min(us) AS us FROM d GROUP BY id), gone AS (SELECT DISTINCT {uuid_sql('record_id')} AS key FROM compacted_records),
anchors AS (SELECT lower(trim(kind)) || '/' || lower(trim(target)) AS key, min(epoch_us(recorded_at)) AS us, arg_max(lower(trim(state)) = 'dead', (recorded_at, lower(trim(state)) = 'dead')) AS dead FROM anchor_facts WHERE kind IS NOT NULL AND target IS NOT NULL GROUP BY 1),
el AS (SELECT id, unnest(CASE WHEN json_type(ev) = 'ARRAY' THEN CAST(ev AS JSON[]) WHEN json_type(ev) = 'OBJECT' THEN [CAST(ev AS JSON)] ELSE [] END) AS e FROM d WHERE ev IS NOT NULL),
kr AS (SELECT id, CASE WHEN json_type(e) = 'OBJECT' AND json_type(e, '$.kind') = 'VARCHAR' AND json_type(e, '$.reference') = 'VARCHAR' THEN lower(regexp_replace(e->>'$.kind', '^\\s+|\\s+$', '', 'g')) WHEN json_type(e) = 'VARCHAR' THEN regexp_extract(lower(e->>'$'), '^\\s*({_KINDS})\\s*:', 1) END AS kind,
 CASE WHEN json_type(e) = 'OBJECT' THEN e->>'$.reference' ELSE regexp_replace(e->>'$', '^(?i)\\s*({_KINDS})\\s*:', '') END AS ref FROM el),
refs AS (SELECT DISTINCT id, 'supersedes' AS source_field, 'records' AS target_table, sup AS target_key FROM d WHERE sup IS NOT NULL UNION SELECT DISTINCT id, 'evidence_json', 'records', {uuid_sql('ref')} FROM kr WHERE kind = 'record' AND trim(ref) <> ''
 UNION SELECT DISTINCT id, 'evidence_json', 'anchor_facts', kind || '/' || lower(regexp_replace(ref, '^\\s+|\\s+$', '', 'g')) FROM kr WHERE kind IN ('anchor:ticket', 'anchor:diff', 'anchor:trunk') AND trim(ref) <> ''),
st AS (SELECT r.id AS record_id, r.source_field, r.target_table, r.target_key, strftime(make_timestamp(o.us), '%Y-%m') AS period, CASE WHEN r.target_table = 'records' THEN CASE WHEN t.id IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN t.id IS NULL THEN 'missing' WHEN t.us > o.us THEN 'late' END
 ELSE CASE WHEN a.key IS NULL THEN 'missing' WHEN a.dead THEN 'deleted' WHEN a.us > o.us THEN 'late' END END AS status
 FROM refs r JOIN own o ON o.id = r.id LEFT JOIN own t ON r.target_table = 'records' AND t.id = r.target_key LEFT JOIN gone g ON r.target_table = 'records' AND g.key = r.target_key LEFT JOIN anchors a ON r.target_table = 'anchor_facts' AND a.key = r.target_key WHERE r.target_key IS NOT NULL)
"""
_OPEN = "CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j->>'$') AND json_type(j->>'$') IN ('OBJECT', 'ARRAY') THEN CAST(j->>'$' AS JSON) ELSE j END"
_P4 = f"""WITH RECURSIVE d AS (SELECT {uuid_sql('id')} AS id, {clean_sql('payload_json')} AS payload_json, {clean_sql('evidence_json')} AS evidence_json, {clean_sql('tags_json')} AS tags_json FROM records),
one AS (SELECT id, min(payload_json) AS payload_json, min(evidence_json) AS evidence_json, min(tags_json) AS tags_json FROM d GROUP BY id),
roots AS (SELECT id, 'payload_json' AS field, CAST(payload_json AS JSON) AS v FROM one WHERE payload_json IS NOT NULL UNION ALL SELECT id, 'evidence_json', CAST(evidence_json AS JSON) FROM one WHERE evidence_json IS NOT NULL UNION ALL SELECT id, 'tags_json', CAST(tags_json AS JSON) FROM one WHERE tags_json IS NOT NULL),
t AS (SELECT id, field, v, '' AS pointer, '' AS up, false AS row, 0 AS lvl, NULL::VARCHAR AS holder, NULL::VARCHAR AS key, '' AS place, false AS listed FROM roots UNION ALL
 SELECT id, field, {_OPEN}, p, up2, l OR json_type({_OPEN}) = 'OBJECT', lvl + 1, pointer, replace(replace(y, '~1', '/'), '~0', '~'), place || '/' || CASE WHEN l THEN '*' WHEN y = '*' THEN '~2' ELSE y END, l FROM (SELECT id, field, lvl, pointer, y, place, json_extract(v, '/' || y) AS j, pointer || '/' || y AS p, CASE WHEN row THEN pointer ELSE up END AS up2, l FROM (
  SELECT t.*, json_type(v) = 'ARRAY' AS l, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE list_transform(json_keys(v), lambda k: replace(replace(k, '~', '~0'), '/', '~1')) END) AS y FROM t WHERE json_type(v) IN ('ARRAY', 'OBJECT'))))
"""
#: All values of the JSON columns, opened: id, field, v, pointer, up (parent row's pointer), row. For checks built on it.
JSON_WALK = _P4
_TYPE = "CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
_SCALAR = "CASE WHEN typ NOT IN ('object', 'list', 'null') THEN v->>'$' END"
#: k: the walk with types; s: the automaton's states from the deepest level up; o: the objects with their variants.
_P4_STATES = _P4 + f""", k AS (SELECT *, {_TYPE} AS typ FROM t),
s AS (SELECT max(lvl) + 1 AS lvl, NULL::VARCHAR AS id, NULL::VARCHAR AS field, NULL::VARCHAR AS pointer, NULL::VARCHAR AS holder, NULL::VARCHAR AS key, NULL::VARCHAR AS state FROM k UNION ALL
 SELECT n.lvl, n.id, n.field, n.pointer, n.holder, n.key, CASE n.typ WHEN 'object' THEN left(md5('{{}}' || coalesce(chr(30) || c.members, '')), 16) WHEN 'list' THEN left(md5('[]' || coalesce(chr(30) || c.items, '')), 16) ELSE n.typ END
 FROM (SELECT DISTINCT lvl - 1 AS lvl FROM s) w JOIN k n ON n.lvl = w.lvl LEFT JOIN (SELECT id, field, holder, string_agg(key || chr(31) || state, chr(30) ORDER BY key) AS members, string_agg(DISTINCT state, chr(30) ORDER BY state) AS items FROM s WHERE id IS NOT NULL GROUP BY ALL) c ON c.id = n.id AND c.field = n.field AND c.holder = n.pointer),
o AS (SELECT k.*, s.state AS variant FROM k JOIN s ON s.id = k.id AND s.field = k.field AND s.pointer = k.pointer WHERE k.typ = 'object'),
m AS (SELECT id, field, holder, key, typ, {_SCALAR} AS text FROM k WHERE typ NOT IN ('object', 'list') AND NOT listed AND holder IS NOT NULL)
"""
_MEMBERS = "SELECT id, field, holder, string_agg(key || '=' || {0}, chr(10) ORDER BY key || '=' || {0}) AS x, list_sort(list(key)) AS keys FROM m GROUP BY ALL"
_P5 = "WITH once AS (SELECT DISTINCT ON (id) id, \"at\", coalesce(duration, 0) AS duration, nullif(lower(trim(actor)), '') AS actor, operation, outcome, coalesce(operation, 'missing') || '|' || coalesce(outcome, 'missing') AS label FROM audit_events)\n"
SQL = {
    "p2_found": _NODES + "SELECT id AS record_id, CASE WHEN circle IS NULL THEN cur ELSE list_min(circle) END AS root_id, CAST(CASE WHEN circle IS NULL THEN len(path) - 1 ELSE -1 END AS BIGINT) AS depth, CAST(CASE WHEN circle IS NULL THEN rev ELSE -1 END AS BIGINT) AS n_revoked FROM done",
    "p2_paths": _NODES + "SELECT id AS record_id, CASE WHEN circle IS NULL THEN cur ELSE list_min(circle) END AS root_id, CAST(CASE WHEN circle IS NULL THEN len(path) - 1 ELSE -1 END AS BIGINT) AS depth, circle IS NOT NULL AS cyclic, CASE WHEN circle IS NULL THEN array_to_string(list_reverse(path), '>') ELSE '' END AS path FROM done",
    "p2_descendants": _NODES + "SELECT path[i + 1] AS ancestor_id, id AS record_id, CAST(i AS BIGINT) AS distance FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM done WHERE circle IS NULL)",
    "p3_found": _P3 + "SELECT * FROM st WHERE status IS NOT NULL",
    "p3_report": _P3 + "SELECT target_table, source_field, period, status, count(*) AS n_references, count(DISTINCT target_key) AS n_targets FROM st WHERE status IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT id AS record_id, field, pointer, up AS parent_pointer FROM t WHERE row",
    "p4_objects": _P4_STATES + f"SELECT o.id AS record_id, o.field, o.pointer, CASE WHEN o.pointer <> '' THEN o.up END AS parent_pointer, o.place, o.variant, coalesce(a.x, '') AS members FROM o LEFT JOIN ({_MEMBERS.format("coalesce(text, 'null')")}) a ON a.id = o.id AND a.field = o.field AND a.holder = o.pointer",
    "p4_variants": _P4_STATES + f""", v AS (SELECT o.field, o.place, o.variant, count(*) AS n_objects, coalesce(any_value(a.x), '') AS types, coalesce(any_value(a.keys), []) AS keys FROM o LEFT JOIN ({_MEMBERS.format("typ")}) a ON a.id = o.id AND a.field = o.field AND a.holder = o.pointer GROUP BY ALL)
SELECT v.field, v.place, variant, n_objects, types, array_to_string(keys, ',') AS keys, coalesce(c.common, '') AS common_keys FROM v LEFT JOIN (SELECT field, place, string_agg(key, ',' ORDER BY key) AS common FROM (SELECT u.field, u.place, u.key FROM (SELECT field, place, unnest(keys) AS key FROM v) u JOIN (SELECT field, place, count(*) AS n FROM v GROUP BY ALL) p ON p.field = u.field AND p.place = u.place
 GROUP BY u.field, u.place, u.key, p.n HAVING count(*) = p.n) GROUP BY field, place) c ON c.field = v.field AND c.place = v.place""",
    "p4_elements": _P4 + f"SELECT id AS record_id, field, pointer, CASE WHEN pointer <> '' THEN up END AS parent_pointer, place, typ AS kind, {_SCALAR} AS value FROM (SELECT *, {_TYPE} AS typ FROM t) WHERE typ = 'list' OR (typ <> 'object' AND (listed OR pointer = ''))",
    "p4_typed": _P4 + f"SELECT field, regexp_replace(place, '/[^/]*$', '') AS place, key, typ AS type, count(*) AS n_values, round(sum(CAST(v->>'$' AS DOUBLE)), 3) AS total FROM (SELECT *, {_TYPE} AS typ FROM t) WHERE typ IN ('int', 'float') AND NOT listed AND holder IS NOT NULL GROUP BY ALL",
    "p5_features_long": _P5 + "SELECT a.actor, l.label AS event_type, coalesce(f.n, 0) AS n, f.latest_at, CAST(coalesce(f.total_duration, 0) AS BIGINT) AS total_duration FROM (SELECT DISTINCT actor FROM once) a CROSS JOIN (SELECT DISTINCT label FROM once) l LEFT JOIN (SELECT actor, label, count(*) AS n, max(\"at\") AS latest_at, sum(duration) AS total_duration FROM once GROUP BY ALL) f ON f.actor IS NOT DISTINCT FROM a.actor AND f.label = l.label",
    "p5_features_refresh": _P5 + "SELECT actor, operation, outcome, count(*) AS n, max(\"at\") AS latest_at, CAST(sum(duration) AS BIGINT) AS total_duration FROM once GROUP BY ALL",
    "p5_features_window": _P5 + "SELECT actor, operation, outcome, count(*) AS n, max(\"at\") AS latest_at, CAST(sum(duration) AS BIGINT) AS total_duration FROM once WHERE \"at\" >= 1735689600 AND \"at\" < 1751328000 GROUP BY ALL",
}


def features_sql(path: str) -> str:
    """The SQL of ``p5_features`` for one table of events: its columns are the event types found there."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["operation", "outcome"])
    names = sorted(set(pc.binary_join_element_wise(pc.fill_null(t["operation"], "missing"), pc.fill_null(t["outcome"], "missing"), "|").to_pylist()))
    cells = ", ".join(f"""count(*) FILTER (label = '{x}') AS "{x}_n", max("at") FILTER (label = '{x}') AS "{x}_latest_at", CAST(coalesce(sum(duration) FILTER (label = '{x}'), 0) AS BIGINT) AS "{x}_total_duration\"""" for x in names)
    return _P5 + f"SELECT actor, {cells} FROM once GROUP BY actor"
