"""More capabilities as queries over whole tables: sinks read back, point reads, links, keys, planted cases.

Where the tables hold no case of a rule (secrets, expiry, anchors), the query
plants some by a stated rule and its SQL plants the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.ids import canonical_uuid, clean_key, instant, point_id, utc_month
from recordloom.operators import compaction, context, defense, digests, grants, ingest, ledger, search, sync, types
from recordloom.plans.ledger_queries import _CLASS_SQL, _Q0, _TAGS, VIEW, _classified, _first_vector, _flagged, _view
from recordloom.plans.registry import Registry
from recordloom.plans.sqltext import us_sql, uuid_sql
from recordloom.session import materialize, new_path
from recordloom.sources.tables import table
from recordloom.streaming import catchup

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query
_NOW = "2026-01-01T00:00:00Z"


# --- the ledger on disk --------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> str:
    v = _view(spark, sf_dir, "namespace", "type_name", "actor", "recorded_at", "observed_at", "valid_at", "payload", "evidence", "tags", "supersedes")
    path = new_path(spark, "ledger")
    ingest.write_ledger(v.where(F.col("namespace").isNotNull() & F.col("type_name").isNotNull()), path)
    return path


@query(VIEW + "SELECT id, namespace, type_name, actor, recorded_at, payload, supersedes FROM led WHERE namespace IS NOT NULL AND type_name IS NOT NULL")
def ledger_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records written as monthly JSON lines and read by the canonical scan, which verifies every line and id."""
    got = ingest.read_ledger(spark, f"{_written(spark, sf_dir)}/*")
    return got.select("id", "namespace", F.col("type").alias("type_name"), "actor", "recorded_at", "payload", "supersedes")


@query(VIEW + f"SELECT strftime(make_timestamp({us_sql('recorded_at')}), '%Y-%m') AS month, id FROM led WHERE namespace IS NOT NULL AND type_name IS NOT NULL AND month IN ('2025-03', '2025-04')")
def ledger_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months read back; the folders of the others are not opened."""
    lines = ingest.read_shards(spark, _written(spark, sf_dir), ["2025-03", "2025-04"])
    return lines.select(F.col("month").cast("string").alias("month"), F.get_json_object("line", "$.id").alias("id"))


@query("SELECT sha256(line) AS sha256, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))) WHERE trim(line) <> '' GROUP BY 1")
def line_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files of lines: the digest of every line that is not blank."""
    path = new_path(spark, "lines")
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("\r"))
    d.select("text").write.text(path)
    return ingest.read_lines(spark, path).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query(VIEW + f"SELECT id, type_name, recorded_at, supersedes, superseded, revoked FROM v WHERE id IN (SELECT {uuid_sql('record_id')} FROM compacted_records)")
def records_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads: the records that compaction took out and that stand in the ledger again, whatever their state."""
    records = table(spark, sf_dir, "records")
    got = ledger.get(records, table(spark, sf_dir, "compacted_records").select(F.col("record_id").alias("id")), ("type_name", "recorded_at", "supersedes"))
    return ledger.with_superseded(got, ledger.predecessors(records)).select("id", "type_name", "recorded_at", "supersedes", "superseded", "revoked")


@query(VIEW + f"SELECT id, {us_sql('recorded_at')} AS us, strftime(make_timestamp({us_sql('recorded_at')}), '%Y-%m') AS month, sha256(payload) AS payload_sha256 FROM led")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir, "recorded_at", "payload")
    at = instant(F.col("recorded_at"))
    return v.select("id", F.unix_micros(at).alias("us"), utc_month(at).alias("month"), F.sha2("payload", 256).alias("payload_sha256"))


_STORE = "6ba7b8109dad11d180b400c04fd430c8"


@query(VIEW + f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
 FROM (SELECT id, sha1(unhex('{_STORE}' || replace(id, '-', ''))) AS h FROM led)""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir).select("id", point_id("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("id")).alias("point_id"))


# --- links, receipts, keys ------------------------------------------------------


@query(f"""WITH l AS (SELECT {uuid_sql('id')} AS id, min(supersedes) AS target FROM records GROUP BY 1), m AS (SELECT DISTINCT {uuid_sql('record_id')} AS legacy FROM compacted_records WHERE record_id IS NOT NULL)
SELECT l.id AS ordinal, l.target, coalesce('moved-' || m.legacy, k.id) AS resolved, l.target IS NOT NULL AND coalesce('moved-' || m.legacy, k.id) IS NULL AS failed FROM l LEFT JOIN m ON m.legacy = l.target LEFT JOIN (SELECT DISTINCT id FROM l) k ON k.id = {uuid_sql('l.target')}""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw predecessor texts lead to: compacted ids as they stand through a map, other spellings as existing UUIDs."""
    records = table(spark, sf_dir, "records").select(canonical_uuid(F.col("id")).alias("id"), "supersedes").where(F.col("id").isNotNull())
    lines = records.groupBy(F.col("id").alias("ordinal")).agg(F.min("supersedes").alias("target"))
    moved = table(spark, sf_dir, "compacted_records").select(canonical_uuid(F.col("record_id")).alias("legacy")).where(F.col("legacy").isNotNull()).distinct()
    return ingest.resolve_supersedes(lines, moved.select("legacy", F.concat(F.lit("moved-"), "legacy").alias("id")), records.select("id").distinct())


@query(VIEW + "SELECT DISTINCT record_sha256 AS sha256 FROM led WHERE record_sha256 IS NOT NULL AND record_sha256 NOT IN (SELECT record_sha256 FROM v WHERE NOT superseded AND record_sha256 IS NOT NULL)")
def receipt_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests a receipt of all records claims that no record still in force names."""
    v = _flagged(spark, sf_dir, "record_sha256").where(F.col("record_sha256").isNotNull())
    claimed = v.select(F.col("record_sha256").alias("sha256")).distinct()
    return ingest.verify_receipts(claimed, v.where(~F.col("superseded")).select(F.col("record_sha256").alias("sha256")))


@query(VIEW + "SELECT id, actor, 'key-' || id AS key, record_sha256 FROM v WHERE NOT superseded AND NOT revoked")
def keys_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one idempotency key a record, those whose record survives, under the digest it has now."""
    v = materialize(_flagged(spark, sf_dir, "actor", "record_sha256"), "keys")
    done = v.select("id", "actor", F.concat(F.lit("key-"), "id").alias("key"), F.lit("old").alias("record_sha256"))
    return ingest.kept_keys(done, compaction.rewritten(v, compaction.native_plan(v))).select("id", "actor", "key", "record_sha256")


@query("""WITH r AS (SELECT doc_id AS ordinal, coalesce(lower(trim(source)), '') AS a, coalesce(namespace, '') || chr(1) || coalesce(kind, '') AS k, sha256(text) AS sha FROM documents WHERE text IS NOT NULL),
d AS (SELECT a, k, min(sha) AS sha FROM r WHERE ordinal % 10 = 0 GROUP BY ALL), q AS (SELECT * FROM r WHERE ordinal % 10 <> 0), f AS (SELECT a, k, min(ordinal) AS o, arg_min(sha, ordinal) AS sha FROM q GROUP BY ALL)
SELECT q.ordinal, CASE WHEN d.sha IS NULL AND q.ordinal = f.o THEN 'new' WHEN q.sha = coalesce(d.sha, f.sha) THEN 'replay' ELSE 'conflict' END AS verdict FROM q JOIN f ON f.a = q.a AND f.k = q.k LEFT JOIN d ON d.a = q.a AND d.k = q.k""")
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed writes against a store in which every tenth was done before."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    req = d.select(F.col("doc_id").alias("ordinal"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("actor"), F.concat(F.coalesce("namespace", F.lit("")), F.lit("\x01"), F.coalesce("kind", F.lit(""))).alias("key"), F.sha2("text", 256).alias("draft_sha256"))
    done = F.col("ordinal") % 10 == 0
    return ingest.replay(req.where(~done), req.where(done).select("actor", "key", "draft_sha256"))


@query(VIEW + f"SELECT id AS supersedes, type_name, payload, CAST(len(list_distinct(list_append({_TAGS}, 'lapsed'))) AS INT) AS n_tags FROM v WHERE NOT superseded AND namespace = 'fleet.memory'")
def tombstone_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that withdraw every current record of a namespace: the payload kept, the tag added."""
    v = _view(spark, sf_dir, "namespace", "type_name", "payload", "tags", "supersedes")
    drafts = ledger.tombstones(v, v.where(F.col("namespace") == "fleet.memory"), "lapsed", _NOW)
    return drafts.select("supersedes", "type_name", "payload", F.size(F.from_json("tags", "array<string>")).alias("n_tags"))


@query(VIEW + f"SELECT id, CASE WHEN len(tg) = 0 THEN '' ELSE list_reduce(list_prepend('', tg), lambda a, x: sha256(a || x)) END AS digest FROM (SELECT id, {_TAGS} AS tg FROM led)")
def tag_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained digest over each record's tags."""
    return _view(spark, sf_dir, "tags").select("id", digests.chain(context.json_tags(F.col("tags"))).alias("digest"))


@query(VIEW + "SELECT led.id, led.type_name, t.type_name AS claimed_by FROM led JOIN type_registry t ON t.lifecycle_mode = 'linear' AND (t.type_name = led.type_name OR list_contains(t.predecessor_types, led.type_name))")
def type_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.claims(_view(spark, sf_dir, "type_name"), table(spark, sf_dir, "type_registry"))


@query("SELECT type_name FROM type_registry WHERE type_name NOT IN (SELECT unnest(predecessor_types) FROM type_registry WHERE predecessor_types IS NOT NULL)")
def current_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one current type of every connected group of the registry, which is refused if it has circles or several."""
    registry = {r[0]: list(r[1] or []) for r in table(spark, sf_dir, "type_registry").select("type_name", "predecessor_types").collect()}  # a fixed table of tens of rows
    return spark.createDataFrame([(t,) for t in sorted(types.current_types(registry))], "type_name string")


@query(VIEW + f"SELECT id FROM led WHERE len(list_filter({_TAGS}, lambda t: regexp_full_match(lower(t), '[a-z]+:revoked'))) > 0")
def withdrawn_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.withdrawals(_view(spark, sf_dir, "tags"))


@query(VIEW + "SELECT id, CASE WHEN json_type(payload, '$.options') = 'ARRAY' THEN list_filter(json_extract_string(payload, '$.options[*].label'), lambda x: x IS NOT NULL)[1] END AS label, json_extract_string(payload, '$.impact.cost.unit') AS unit FROM led WHERE type_name IN ('plan.decision.v1', 'work.incident.v2')")
def addressed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted paths: through a list the first element that has the rest, and down nested objects."""
    v = _view(spark, sf_dir, "type_name", "payload", only=F.col("type_name").isin("plan.decision.v1", "work.incident.v2"))
    got = types.project_fields(v, ["options.label", "payload.impact.cost.unit"])
    at = lambda name: F.get_json_object("fields", f"$['{name}']")
    return got.select("id", at("options.label").alias("label"), at("payload.impact.cost.unit").alias("unit"))


_GRANTS_SQL = "(VALUES ('*', 'fleet.memory', '*', NULL), ('*', '*', 'plan.task.v1', NULL), ('*', '*', 'work.incident.v2', 'tokens')) g(actor, namespace, type_name, unit)"


@query(VIEW + f"""SELECT c.id, CASE WHEN c.actor = (SELECT min(actor) FROM led) THEN 'read_only' WHEN EXISTS (SELECT 1 FROM {_GRANTS_SQL} WHERE (g.namespace = '*' OR g.namespace = c.namespace) AND (g.type_name = '*' OR g.type_name = c.type_name) AND (p.id IS NULL OR ((g.namespace = '*' OR g.namespace = p.namespace) AND (g.type_name = '*' OR g.type_name = p.type_name)))
 AND (g.unit IS NULL OR g.unit = json_extract_string(c.payload, '$.impact.cost.unit'))) THEN 'granted' ELSE 'refused' END AS verdict FROM led c LEFT JOIN led p ON p.id = c.supersedes""")
def write_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as a draft against three grants (one with a condition on the payload) and one actor on hold."""
    v = materialize(_view(spark, sf_dir, "actor", "namespace", "type_name", "payload", "supersedes"), "drafts")
    parents = v.select(F.col("id").alias("supersedes"), F.col("namespace").alias("parent_namespace"), F.col("type_name").alias("parent_type"))
    grants_given = spark.createDataFrame([("*", "fleet.memory", "*", None), ("*", "*", "plan.task.v1", None), ("*", "*", "work.incident.v2", {"/impact/cost/unit": "tokens"})], "actor string, namespace string, type_name string, payload_equals map<string,string>")
    return grants.write_verdicts(v.join(parents, "supersedes", "left"), grants_given, v.agg(F.min("actor").alias("actor")))


@query(VIEW + """, g AS (SELECT id FROM v WHERE superseded OR revoked), k AS (SELECT v.id, v.supersedes IN (SELECT id FROM g) AS cut, v.supersedes FROM v WHERE namespace IS NOT NULL AND type_name IS NOT NULL AND NOT superseded AND NOT revoked)
SELECT id, CASE WHEN NOT coalesce(cut, false) THEN supersedes END AS supersedes, NOT coalesce(cut, false) AS untouched FROM k""")
def rewritten_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly files after a compaction: removed lines gone, links to them null, every other line as it was."""
    lines = spark.read.text(_written(spark, sf_dir)).select(F.col("month").cast("string").alias("file"), F.xxhash64("value").alias("ordinal"), F.col("value").alias("line"))
    lines = materialize(lines, "before")
    after = compaction.rewritten_lines(lines, compaction.native_plan(_flagged(spark, sf_dir)))
    both = after.join(lines.select("ordinal", F.col("line").alias("before")), "ordinal")
    return both.select(F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.supersedes").alias("supersedes"), (F.col("line") == F.col("before")).alias("untouched"))


# --- context ---------------------------------------------------------------------


@query(VIEW + _CLASS_SQL + """, n AS (SELECT s.type_name, s.expected, count(v.id) AS n_found FROM (VALUES ('fleet.lesson.v1', 'one'), ('fleet.roleset.v1', 'some'), ('plan.decision.v1', 'any'), ('gone.type.v1', 'some')) s(type_name, expected)
 LEFT JOIN (SELECT c.id, g.type_name FROM c JOIN g ON g.id = c.id WHERE c.tier IS NOT NULL) v ON v.type_name = s.type_name GROUP BY ALL) SELECT type_name, expected, n_found FROM n WHERE (expected = 'some' AND n_found < 1) OR (expected = 'one' AND n_found <> 1)""")
def selector_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.cardinality_faults(_classified(spark, sf_dir), {"fleet.lesson.v1": "one", "fleet.roleset.v1": "some", "plan.decision.v1": "any", "gone.type.v1": "some"})


@query(VIEW + _CLASS_SQL + "SELECT string_agg(DISTINCT s, ',' ORDER BY s) AS strategies FROM (SELECT CASE WHEN c.tier <> 'relevant' OR g.type_name = 'fleet.lesson.v1' THEN 'tag' WHEN g.type_name = 'fleet.roleset.v1' THEN 'recency' ELSE 'exact' END AS s FROM c JOIN g ON g.id = c.id WHERE c.tier IS NOT NULL)")
def strategies_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.strategies_used(_classified(spark, sf_dir))


@query(VIEW + _CLASS_SQL + "SELECT 1::BIGINT AS n_uncovered, n AS n_cardinality_faults, 0::BIGINT AS n_findings, false AS ok FROM (SELECT CAST(count(*) FILTER (g.type_name = 'fleet.lesson.v1') <> 1 AS BIGINT) AS n FROM c JOIN g ON g.id = c.id WHERE c.tier IS NOT NULL)")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors without vectors, selectors that found too many or too few, and secrets in any payload of the ledger."""
    hybrid = [context.Selector("fleet.lesson.v1", ("hybrid",)), context.Selector("plan.task.v1", ("hybrid",))]
    return context.health(_classified(spark, sf_dir), {"fleet.lesson.v1": "one", "plan.decision.v1": "any"}, defense.findings(_view(spark, sf_dir, "payload"), "id", "payload"), hybrid, ["plan.task.v1"])


def _planted_tags(tags: Column, *cases: tuple[str, str]) -> Column:
    """The tags, or for ids that end in a given character one tag that is planted."""
    out = tags
    for last, tag in cases:
        out = F.when(F.col("id").endswith(last), F.to_json(F.array(F.lit(tag)))).otherwise(out)
    return out


def _planted_sql(*cases: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN id LIKE '%{last}' THEN '[\"{tag}\"]'" for last, tag in reversed(cases)) + " ELSE tags END"


_EXPIRING = (("0", "expires:2025-11-01T00:00:00Z"), ("1", "expires:2025-12-20T00:00:00+02:00"), ("2", "expires:2026-02-01T00:00:00Z"))
_EXACT = [context.Selector("work.incident.v2", kind_pointer="/impact/cost/unit"), context.Selector("fleet.roleset.v1", coordinate_pointers={"role": "/role"})]
_EXACT_REQUEST = context.Request(_NOW, kinds=("tokens", "rounds"), coordinates={"role": "runner"})


@query(VIEW + f"""SELECT id, CASE WHEN superseded THEN 'superseded' WHEN revoked OR len(list_filter(coalesce(from_json({_planted_sql(*_EXPIRING)}, '["VARCHAR"]'), []), lambda t: regexp_full_match(lower(t), '[a-z]+:revoked'))) > 0 THEN 'revoked' WHEN {us_sql('coalesce(valid_at, observed_at)')} > 1767225600000000 THEN 'invalid_at_request_time'
 WHEN type_name NOT IN ('work.incident.v2', 'fleet.roleset.v1') THEN 'selector_mismatch' WHEN id LIKE '%0' OR id LIKE '%1' THEN 'expired' ELSE 'selector_mismatch' END AS reason FROM v
 WHERE superseded OR revoked OR type_name <> 'work.incident.v2' OR id LIKE '%0' OR id LIKE '%1' OR {us_sql('coalesce(valid_at, observed_at)')} > 1767225600000000 OR (id NOT LIKE '%2' AND len(list_filter({_TAGS}, lambda t: regexp_full_match(lower(t), '[a-z]+:revoked'))) > 0) OR NOT coalesce(json_extract_string(payload, '$.impact.cost.unit') IN ('tokens', 'rounds'), false)""")
def gate_expiry_and_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with planted expiry tags, kinds asked for by pointer, and a coordinate that must match exactly (a set matches none)."""
    v = _flagged(spark, sf_dir, "namespace", "type_name", "observed_at", "valid_at", "payload", "tags")
    v = v.withColumn("tags", _planted_tags(F.col("tags"), *_EXPIRING))
    grants = [(r[0], r[1]) for r in v.select("namespace", "type_name").distinct().collect()]  # namespaces x types: the scopes of the ledger
    return context.gate(v, grants, _EXACT, _EXACT_REQUEST).where(F.col("reason").isNotNull()).select("id", "reason")


_ANCHORED = (("3", "anchor:ticket:planted-dead"), ("4", "Anchor:Ticket:PLANTED-ALIVE"), ("5", "anchor:diff:planted-nowhere"))
_MANIFEST_TAGS = (*_EXPIRING, *_ANCHORED)


@query(VIEW + """, b AS (SELECT v.*, p.id IS NOT NULL AS parent_gone, right(id, 1) AS z FROM v LEFT JOIN (SELECT id AS pid FROM v WHERE superseded) p(id) ON p.id = v.supersedes),
r AS (SELECT id, CASE WHEN superseded THEN 'superseded' WHEN z = '0' THEN 'expired' WHEN z = '1' THEN 'expiry_warning_window' WHEN z = '3' THEN 'dead_anchor' WHEN z = '4' THEN 'active_anchor' WHEN z = '5' THEN 'unknown_anchor' WHEN parent_gone THEN 'active_descendant' END AS reason FROM b)
SELECT id, reason IN ('superseded', 'expired', 'dead_anchor') AS remove, reason FROM r WHERE reason IS NOT NULL""".replace("b AS (SELECT v.*, p.id IS NOT NULL AS parent_gone, right(id, 1) AS z", "b AS (SELECT v.*, p.id IS NOT NULL AS parent_gone, right(v.id, 1) AS z"))
def manifest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest plan with every reason: tags of expiry and anchors are planted by the last character of the id."""
    facts = table(spark, sf_dir, "anchor_facts").select("kind", "target", "state", "recorded_at")
    planted = spark.createDataFrame([("anchor:ticket", "planted-dead", "alive", "2025-01-01"), ("Anchor:Ticket", " Planted-Dead", "DEAD", "2025-02-01"), ("anchor:ticket", "planted-alive", "alive", "2025-01-01")], "kind string, target string, state string, at string")
    anchors = compaction.anchor_states(facts.unionByName(planted.select("kind", "target", "state", F.col("at").cast("timestamp").cast(facts.schema["recorded_at"].dataType).alias("recorded_at"))))
    v = _flagged(spark, sf_dir, "tags", "payload")
    return compaction.manifest_plan(v.withColumn("tags", _planted_tags(F.col("tags"), *_MANIFEST_TAGS)), anchors, _NOW)


@query(VIEW + f"SELECT id, {us_sql('observed_at')} - {us_sql('recorded_at')} AS ahead_us FROM led WHERE {us_sql('observed_at')} - {us_sql('recorded_at')} > -3600000000")
def observed_within_the_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skew test with an allowance of minus one hour: records observed less than an hour before they were recorded."""
    return ledger.too_early(_view(spark, sf_dir, "observed_at", "recorded_at"), -3_600_000_000)


@query(VIEW + "SELECT id, supersedes, severed FROM (SELECT k.id, CASE WHEN g.id IS NULL THEN k.supersedes END AS supersedes, g.id IS NOT NULL AS severed FROM v k LEFT JOIN (SELECT id FROM v WHERE superseded OR revoked) g ON g.id = k.supersedes WHERE NOT (k.superseded OR k.revoked))")
def compact_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compaction put in force (shadow, verified, swapped), and the ledger in force read back."""
    v, path = _flagged(spark, sf_dir, "record_sha256"), new_path(spark, "compacted")
    compaction.publish(v.select("id", "supersedes", "record_sha256", F.lit(False).alias("severed")), path)
    compaction.publish(compaction.rewritten(v, compaction.native_plan(v)).select("id", "supersedes", "record_sha256", "severed"), path)
    return spark.read.parquet(f"{path}/current").select("id", "supersedes", "severed")


# --- vectors -----------------------------------------------------------------------

_NUMBERED = "(SELECT id, namespace, type_name, record_sha256, row_number() OVER (ORDER BY id) - 1 AS k FROM led)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as an index: number k belongs to the k-th record in order of id."""
    numbered = ledger.ordinals(_view(spark, sf_dir, "namespace", "type_name", "record_sha256"), "id").withColumn("vec_id", F.col("ordinal") - 1)
    model = F.when(F.col("vec_id") % 7 == 0, "old").otherwise("new")
    return table(spark, sf_dir, "embeddings").join(numbered, "vec_id").select("id", F.lit("main").alias("store"), model.alias("model"), "namespace", "type_name", "record_sha256", "embedding")


@query(VIEW + f"SELECT id, round(s, 6) AS score FROM (SELECT r.id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q) AS s FROM {_NUMBERED} r JOIN embeddings e ON e.vec_id = r.k, (SELECT {_Q0} AS q) WHERE r.k % 7 <> 0 AND type_name = 'work.finding.v1') ORDER BY round(s, 9) DESC, id LIMIT 20")
def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of one store, model and type: the conditions hold before the limit."""
    _, q = _first_vector(spark, sf_dir)
    return search.nearest(search.points_in_scope(_points(spark, sf_dir), "main", "new", None, "work.finding.v1"), q, 20, key="id").select("id", F.round("score", 6).alias("score"))


@query(VIEW + f"SELECT r.id, 'main' AS store, CASE WHEN r.k % 7 = 0 THEN 'old' ELSE 'new' END AS model, namespace, type_name, record_sha256 FROM {_NUMBERED} r JOIN embeddings e ON e.vec_id = r.k WHERE r.id IN (SELECT supersedes FROM led)")
def vector_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of the superseded records, without their vectors."""
    return search.point_metadata(_points(spark, sf_dir), ledger.predecessors(table(spark, sf_dir, "records")))


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 through the cell index: whether its recall of the exact 10 nearest reaches 0.9."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where(F.col("vec_id") % 20 == 0)
    got = search.CellIndex(e).nearest(queries, 10)
    exact = search.nearest_of_all(queries, e, 10)
    hit = exact.join(got.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)) >= 0.9).alias("enough"))


_INDEXED = "ledger <= 'records/2026-01.jsonl' AND NOT revoked AND trim(namespace) <> '' AND trim(type_name) <> ''"
_WANTED = "NOT superseded AND NOT revoked AND trim(namespace) <> '' AND trim(type_name) <> ''"
_TAGGED = f"type_name = 'fleet.lesson.v1' AND len(list_filter({_TAGS}, lambda t: t IS NOT NULL)) > 0"
_DELTA = VIEW + f""", a AS (SELECT id, CASE WHEN NOT ({_WANTED}) THEN 'delete' WHEN NOT coalesce({_INDEXED}, false) OR ({_TAGGED}) THEN 'embed' WHEN namespace = 'fleet.memory' THEN 'relabel' ELSE 'unchanged' END AS action, record_sha256 FROM v WHERE ({_WANTED}) OR ({_INDEXED}))
"""


def _index_and_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus now, and an index of an earlier month that knew no tags of lessons and other digests in one namespace."""
    v = materialize(_flagged(spark, sf_dir, "namespace", "type_name", "record_sha256", "tags", "payload", "ledger"), "corpus")
    before = v.where((F.col("ledger") <= "records/2026-01.jsonl") & ~F.col("revoked"))
    before = before.withColumn("tags", F.when(F.col("type_name") != "fleet.lesson.v1", F.col("tags"))).withColumn("record_sha256", F.when(F.col("namespace") == "fleet.memory", "before").otherwise(F.col("record_sha256")))
    old = materialize(sync.documents(before), "indexed")
    index = sync.hashed_embedding(old).join(old.select("id", "record_sha256", "input_sha256"), "id")
    return materialize(index, "index"), materialize(sync.documents(v.where(~F.col("superseded") & ~F.col("revoked"))), "documents")


@query(_DELTA + "SELECT id, action FROM a")
def embedding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, corpus = _index_and_corpus(spark, sf_dir)
    return sync.delta(corpus, index)


@query(VIEW + f"SELECT id, record_sha256 FROM v WHERE {_WANTED}")
def index_after_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan carried out: only what changed is embedded, and the index then holds the corpus."""
    index, corpus = _index_and_corpus(spark, sf_dir)
    plan = materialize(sync.delta(corpus, index), "plan")
    fresh = sync.hashed_embedding(corpus.join(plan.where(F.col("action") == "embed").select("id"), "id", "left_semi"))
    return sync.applied(index, plan, corpus, fresh).where(F.size("embedding") == 64).select("id", "record_sha256")


# --- secrets, streams ----------------------------------------------------------------


def _with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, every 50th with a line that holds a key, every 75th with a token in the middle of a line."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    text = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("\nkey AIza"), F.substring(h, 1, 35), F.lit(" end"))).otherwise(F.col("text"))
    return d.select("doc_id", F.when(F.col("doc_id") % 75 == 1, F.concat(text, F.lit(" gsk_"), F.substring(h, 1, 48))).otherwise(text).alias("text"))


_SECRETS = "WITH d AS (SELECT doc_id, text, sha256(CAST(doc_id AS VARCHAR)) AS h, doc_id % 50 = 0 AS a, doc_id % 75 = 1 AS b FROM documents WHERE text IS NOT NULL)\n"


@query(_SECRETS + "SELECT doc_id, 'google-api-key' AS rule, length(text) - length(replace(text, chr(10), '')) + 2 AS line, 5 AS col FROM d WHERE a UNION ALL SELECT doc_id, 'groq-api-key', length(text) - length(replace(text, chr(10), '')) + 1, length(regexp_extract(text, '[^\\n]*$')) + 2 FROM d WHERE b AND NOT a")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, with planted keys, against all rules: those are found where they stand, and nothing else."""
    return defense.findings(_with_secrets(spark, sf_dir), "doc_id", "text")


@query(_SECRETS + "SELECT doc_id, CASE WHEN a THEN text || chr(10) || 'key [REDACTED:google-api-key] end' ELSE text || ' [REDACTED:groq-api-key]' END AS redacted, 1 AS n_findings FROM d WHERE a OR b")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defense.redact(_with_secrets(spark, sf_dir), "doc_id", "text")


@query(_SECRETS + "SELECT doc_id, CASE WHEN a THEN 'google-api-key' ELSE 'groq-api-key' END AS rules FROM d WHERE a OR b")
def secret_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy ``block`` refuses, with the rules."""
    _, refused = defense.apply_policy(_with_secrets(spark, sf_dir), "doc_id", "text")
    return refused.select("doc_id", F.array_join("rules", ",").alias("rules"))


@query("SELECT strftime(make_timestamp(\"at\" * 1000000), '%Y-%m') AS month, operation, count(*) AS n, CAST(sum(coalesce(duration, 0)) AS BIGINT) AS total_us FROM (SELECT DISTINCT ON (id) * FROM audit_events) GROUP BY ALL")
def stream_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log as a stream of files: one part drained, then the files of later months with their late and repeated rows, each id once."""
    events = table(spark, sf_dir, "audit_events")
    source, target = new_path(spark, "arrivals"), new_path(spark, "catchup")
    first = F.coalesce(F.col("ledger") <= "2025-06", F.lit(True))
    for part in (first, ~first):
        events.where(part).write.mode("append").parquet(source)
        catchup.drain(spark, source, events.schema, target, catchup.partial_counts)
    return catchup.merged_counts(spark, target)


@query("SELECT actor, count(*) AS n FROM (SELECT id, min(nullif(lower(trim(actor)), '')) AS actor FROM audit_events WHERE id IS NOT NULL GROUP BY id) GROUP BY actor")
def actor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "audit_events").where(F.col("id").isNotNull()).groupBy("id").agg(F.min(clean_key(F.col("actor"))).alias("actor"))
    return once.groupBy("actor").agg(F.count(F.lit(1)).alias("n"))
