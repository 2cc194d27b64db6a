"""The reference capabilities as queries over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import clean_key
from recordloom.operators import audit, compaction, context, defense, digests, engine, filters, ingest, ledger, search, sync, types
from recordloom.plans.registry import Registry
from recordloom.plans.sqltext import clean_sql, us_sql, uuid_sql
from recordloom.session import materialize
from recordloom.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


_NIL = "'00000000-0000-0000-0000-000000000000'"
#: led: one row a record; v: the same with ``superseded``.
VIEW = f"""WITH d AS (SELECT {uuid_sql('id')} AS id, namespace, type_name, actor, recorded_at, observed_at, valid_at, {clean_sql('payload_json')} AS payload, {clean_sql('evidence_json')} AS evidence, {clean_sql('tags_json')} AS tags,
 nullif({uuid_sql('supersedes')}, {_NIL}) AS supersedes, coalesce(revoked, 0) = 1 AS revoked, CAST(coalesce(superseded, 0) AS INT) AS superseded_flag, record_sha256, ledger FROM records),
led AS (SELECT id, min(namespace) AS namespace, min(type_name) AS type_name, min(actor) AS actor, min(recorded_at) AS recorded_at, min(observed_at) AS observed_at, min(valid_at) AS valid_at, min(payload) AS payload, min(evidence) AS evidence,
 min(tags) AS tags, min(supersedes) AS supersedes, min(record_sha256) AS record_sha256, min(ledger) AS ledger, bool_or(revoked) AS revoked FROM d WHERE id IS NOT NULL GROUP BY id),
v AS (SELECT led.*, EXISTS (SELECT 1 FROM led c WHERE c.supersedes = led.id) AS superseded FROM led)
"""
_TAGS = "coalesce(from_json(tags, '[\"VARCHAR\"]'), [])"


def _view(spark: SparkSession, sf_dir: str, *columns: str, only: Column | None = None) -> DataFrame:
    return ledger.ledger_view(table(spark, sf_dir, "records"), tuple(columns), only)


def _flagged(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return ledger.with_superseded(_view(spark, sf_dir, "supersedes", *columns))


def _of_type(*types: str) -> Column:
    return F.col("type_name").isin(*types)


@query(VIEW + "SELECT id, namespace, type_name FROM v WHERE NOT superseded AND NOT revoked AND namespace = 'fleet.memory' AND type_name = 'fleet.lesson.v1' ORDER BY id LIMIT 100")
def scan_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.scan(table(spark, sf_dir, "records"), "fleet.memory", "fleet.lesson.v1", 100).select("id", "namespace", "type_name")


@query(VIEW + "SELECT id, type_name, superseded, revoked FROM v")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, "type_name").select("id", "type_name", "superseded", "revoked")


@query(f"SELECT row_number() OVER (ORDER BY w.id) AS ordinal, w.id, min(r.ledger) AS ledger, min(r.record_sha256) AS record_sha256 FROM (SELECT DISTINCT {uuid_sql('record_id')} AS id FROM compacted_records) w JOIN records r ON {uuid_sql('r.id')} = w.id GROUP BY w.id")
def locate_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the compacted records that stand in the ledger again are to be found."""
    from recordloom.functions.ids import canonical_uuid

    records = table(spark, sf_dir, "records")
    wanted = table(spark, sf_dir, "compacted_records").select(canonical_uuid(F.col("record_id")).alias("id")).distinct().join(records.select(canonical_uuid(F.col("id")).alias("id")), "id", "left_semi")
    return ledger.locate(records, ledger.ordinals(wanted, "id"))


@query(VIEW + "SELECT count(*) AS total, count(*) FILTER (NOT superseded AND NOT revoked) AS live, count(*) FILTER (superseded OR revoked) AS dead, count(*) FILTER (superseded) AS n_superseded, count(*) FILTER (revoked) AS n_revoked, count(*) FILTER (superseded AND revoked) AS n_both FROM v")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts(_flagged(spark, sf_dir))


@query(VIEW + "SELECT namespace, type_name, count(*) AS total, count(*) FILTER (NOT superseded AND NOT revoked) AS live, count(*) FILTER (superseded OR revoked) AS dead, count(*) FILTER (superseded) AS n_superseded, count(*) FILTER (revoked) AS n_revoked, count(*) FILTER (superseded AND revoked) AS n_both FROM v GROUP BY ALL")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts(_flagged(spark, sf_dir, "namespace", "type_name"), ["namespace", "type_name"])


@query(f"SELECT {uuid_sql('id')} AS id, count(*) AS n_rows, count(DISTINCT coalesce(payload_json, '')) AS n_spellings, count(DISTINCT recorded_at) AS n_instants FROM records GROUP BY 1 HAVING count(*) > 1")
def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.repeated_deliveries(table(spark, sf_dir, "records"))


@query(VIEW + "SELECT d.id, CAST(v.superseded AS INT) AS truth, count(*) AS n_rows FROM d JOIN v ON v.id = d.id WHERE CAST(v.superseded AS INT) <> d.superseded_flag GROUP BY ALL")
def stale_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.stale_flags(table(spark, sf_dir, "records"))


@query(VIEW + "SELECT p.id, count(*) AS n_children FROM led c JOIN led p ON p.id = c.supersedes GROUP BY 1")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fan_out(_view(spark, sf_dir, "supersedes"))


@query(VIEW + """SELECT c.id, c.supersedes, CASE WHEN p.id IS NULL THEN 'unknown_parent' WHEN c.id = c.supersedes THEN 'self_edge' WHEN c.namespace IS DISTINCT FROM p.namespace THEN 'cross_namespace'
 WHEN t.lifecycle_mode = 'append_only' THEN 'append_only' WHEN c.type_name = p.type_name OR coalesce(list_contains(t.predecessor_types, p.type_name), false) THEN 'ok' ELSE 'cross_type' END AS verdict
 FROM led c LEFT JOIN led p ON p.id = c.supersedes LEFT JOIN type_registry t ON t.type_name = c.type_name WHERE c.supersedes IS NOT NULL""")
def edge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.edge_verdicts(_view(spark, sf_dir, "supersedes", "namespace", "type_name"), table(spark, sf_dir, "type_registry"))


@query(VIEW + "SELECT p.id, c.type_name, count(*) AS n_successors FROM led c JOIN led p ON p.id = c.supersedes JOIN type_registry t ON t.type_name = c.type_name AND t.lifecycle_mode = 'linear' GROUP BY ALL HAVING count(*) > 1")
def linear_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.linear_conflicts(_view(spark, sf_dir, "supersedes", "type_name"), table(spark, sf_dir, "type_registry"))


@query(VIEW + "SELECT v.namespace, v.type_name, any_value(t.lifecycle_mode) AS mode, count(*) AS n_heads FROM v LEFT JOIN type_registry t ON t.type_name = v.type_name WHERE NOT superseded GROUP BY v.namespace, v.type_name")
def lifecycle_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.heads(_view(spark, sf_dir, "supersedes", "namespace", "type_name"), table(spark, sf_dir, "type_registry"))


@query(VIEW + f"SELECT id, {us_sql('observed_at')} - {us_sql('recorded_at')} AS ahead_us FROM led WHERE {us_sql('observed_at')} - {us_sql('recorded_at')} > 60000000")
def observed_too_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.too_early(_view(spark, sf_dir, "observed_at", "recorded_at"))


@query(VIEW + f"SELECT type_name, count(*) AS n FROM led WHERE {us_sql('coalesce(valid_at, observed_at)')} <= {us_sql(chr(39) + '2025-06-01T00:00:00Z' + chr(39))} GROUP BY 1")
def valid_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.valid_as_of(_view(spark, sf_dir, "valid_at", "observed_at", "type_name"), "2025-06-01T00:00:00Z").groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))


@query(VIEW + "SELECT ledger, count(*) AS n_records, CAST(sum(strlen(payload)) AS BIGINT) AS payload_bytes FROM led GROUP BY 1")
def monthly_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.monthly(_view(spark, sf_dir, "ledger", "payload"))


@query("SELECT type_name, type_name NOT IN (SELECT unnest(predecessor_types) FROM type_registry WHERE predecessor_types IS NOT NULL) AS current FROM type_registry")
def type_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.type_lineage(table(spark, sf_dir, "type_registry"))


@query(VIEW + f"SELECT namespace, CAST(row_number() OVER (PARTITION BY namespace ORDER BY {us_sql('recorded_at')} DESC NULLS LAST, id) AS INT) AS rank, id FROM v WHERE NOT superseded AND NOT revoked QUALIFY rank <= 3")
def latest_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_per_scope(_view(spark, sf_dir, "namespace", "recorded_at", "supersedes"), 3)


@query(VIEW + "SELECT sha256(string_agg(coalesce(record_sha256, ''), '' ORDER BY id)) AS digest, count(*) AS n FROM led")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = materialize(_view(spark, sf_dir, "record_sha256"), "digest")
    return spark.createDataFrame([(digests.corpus_digest(v), v.count())], "digest string, n long")


@query(VIEW + "SELECT sha256(string_agg(coalesce(record_sha256, ''), '' ORDER BY id)) AS digest FROM (SELECT * FROM led ORDER BY id LIMIT 1000)")
def prefix_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a prefix is the feature: it tells whether a corpus only grew."""
    return spark.createDataFrame([(digests.prefix_digest(_view(spark, sf_dir, "record_sha256"), 1000),)], "digest string")


@query("SELECT type_name, CASE WHEN len(predecessor_types) > 0 THEN sha256(array_to_string(list_sort(list_distinct(predecessor_types)), chr(10))) END AS fingerprint FROM type_registry")
def type_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "type_registry").select("type_name", digests.fingerprint(F.col("predecessor_types")).alias("fingerprint"))


# --- filters ---------------------------------------------------------------


def _where(spark: SparkSession, sf_dir: str, flags: list[str], strict: bool = False) -> DataFrame:
    return filters.where_records(table(spark, sf_dir, "records"), flags, strict).select("id")


_ROLE = "json_extract_string(payload, '$.role')"
_KIND = "json_type(payload, '$.role')"


@query(VIEW + f"SELECT id FROM led WHERE type_name = 'fleet.roleset.v1' AND ({_ROLE} IN ('runner', 'reviewer') OR {_ROLE} IS NULL)")
def where_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, ["record.type=fleet.roleset.v1", "role=runner,reviewer"])


@query(VIEW + f"SELECT id FROM led WHERE type_name = 'fleet.roleset.v1' AND {_ROLE} IN ('runner', 'reviewer')")
def where_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, ["record.type=fleet.roleset.v1", "role=runner,reviewer"], strict=True)


@query(VIEW + f"SELECT id FROM led WHERE type_name = 'fleet.roleset.v1' AND ({_ROLE} <> 'runner' OR {_ROLE} IS NULL)")
def where_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, ["record.type=fleet.roleset.v1", "role=!runner"])


@query(VIEW + f"SELECT id FROM led WHERE type_name = 'fleet.roleset.v1' AND {_ROLE} IS NULL")
def where_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, ["type=fleet.roleset.v1", "role=null"])


@query(VIEW + f"SELECT id FROM led WHERE list_contains({_TAGS}, 'must') AND namespace = 'fleet.memory'")
def where_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, ["record.namespace=fleet.memory", "record.tags=must"], strict=True)


@query(VIEW + "SELECT id FROM led WHERE json_extract_string(payload, '$.chosen') = '1'")
def where_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _where(spark, sf_dir, ["payload.chosen=1"], strict=True)


# --- audit -----------------------------------------------------------------

_ONCE = "WITH once AS (SELECT id, min(\"at\") AS \"at\", min(nanos) AS nanos, min(duration) AS duration, min(surface) AS surface, min(operation) AS operation, min(outcome) AS outcome, min(session) AS session, min(actor) AS actor, min(event) AS event FROM audit_events WHERE id IS NOT NULL GROUP BY id)\n"
_STATS = "count(*) AS n, count(*) FILTER (outcome = 'error') AS failures, round(count(*) FILTER (outcome = 'error') / count(*), 6) AS error_rate, min(coalesce(duration, 0)) AS least_us, max(coalesce(duration, 0)) AS most_us, quantile_disc(coalesce(duration, 0), 0.95) AS p95_us, round(sum(coalesce(duration, 0)) / count(*), 3) AS mean_us"


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return audit.unique(table(spark, sf_dir, "audit_events").select("id", *columns))


@query(_ONCE + f"SELECT {_STATS} FROM once")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.statistics(_events(spark, sf_dir, "duration", "outcome"))


@query(_ONCE + f"SELECT operation, {_STATS} FROM once GROUP BY operation")
def audit_stats_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.statistics(_events(spark, sf_dir, "operation", "duration", "outcome"), ["operation"])


@query(_ONCE + f"SELECT {_STATS} FROM once WHERE surface = 'cli' AND \"at\" >= 1735689600 AND \"at\" < 1751328000")
def audit_stats_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The predicate goes below the deduplication and reaches the scan: rows of one id are equal.
    scoped = audit.select(table(spark, sf_dir, "audit_events"), {"surface": "cli"}, 1735689600, 1751328000)
    return audit.statistics(audit.unique(scoped.select("id", "duration", "outcome")))


@query(_ONCE + 'SELECT id, "at", nanos, operation FROM once ORDER BY "at" DESC, nanos DESC, id DESC LIMIT 1000')
def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.newest(_events(spark, sf_dir, "at", "nanos", "operation"), 1000).select("id", "at", "nanos", "operation")


@query(_ONCE + "SELECT operation, count(*) AS n_queries, count(*) FILTER (n = 0) AS n_misses FROM (SELECT operation, CAST(json_extract_string(CASE WHEN json_valid(event) THEN event END, '$.output.count') AS BIGINT) AS n FROM once) WHERE n IS NOT NULL GROUP BY 1")
def query_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.misses(_events(spark, sf_dir, "operation", "event"))


@query("SELECT actor, CASE WHEN regexp_full_match(actor, '[A-Za-z0-9._:/@-]{1,64}') THEN actor ELSE 'sha256:' || sha256(actor) END AS coordinate, count(*) AS n FROM audit_events WHERE actor IS NOT NULL GROUP BY ALL")
def audit_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audit_events").where(F.col("actor").isNotNull()).groupBy("actor").agg(F.count(F.lit(1)).alias("n")).select("actor", audit.coordinate(F.col("actor")).alias("coordinate"), "n")


@query("SELECT ledger, CAST(datediff('month', make_timestamp(\"at\" * 1000000)::DATE, (ledger || '-01')::DATE) AS INT) AS months_late, count(*) AS n FROM audit_events GROUP BY ALL")
def audit_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lateness(table(spark, sf_dir, "audit_events").select("ledger", "at"))


@query(_ONCE + "SELECT session, count(*) AS n, min(\"at\") AS first_at, max(\"at\") AS last_at, count(DISTINCT nullif(lower(trim(actor)), '')) AS n_actors FROM once GROUP BY session")
def audit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sessions(_events(spark, sf_dir, "session", "at", "actor"))


# --- search ----------------------------------------------------------------

_WORDS = "regexp_extract_all(lower(concat_ws(' ', payload, evidence, tags)), '([\\p{L}\\p{N}]+)')"


def _bm25_sql(terms: list[str]) -> str:
    tfs = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS t{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"CAST(count(*) FILTER (t{k} > 0) AS DOUBLE) AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * l / al))" for k in range(len(terms)))
    some = " + ".join(f"t{k}" for k in range(len(terms)))
    return f", w AS (SELECT id, {_WORDS} AS w FROM led), rows AS (SELECT id, CAST(len(w) AS DOUBLE) AS l, {tfs} FROM w), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS al, {dfs} FROM rows), hits AS (SELECT id, {score} AS score FROM rows, st WHERE {some} > 0)\n"


_TEXT_TOP = _bm25_sql(["migration", "receipt", "frozen"]) + ", text_top AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, recorded_at DESC, hits.id) AS rank, hits.id, round(score, 6) AS score FROM hits JOIN v ON v.id = hits.id WHERE NOT superseded AND NOT revoked AND namespace = 'fleet.memory' QUALIFY rank <= 100)\n"


def _index(spark: SparkSession, sf_dir: str, stem: bool = False) -> search.TextIndex:
    """The kept full-text index of the records."""
    return search.kept_index(spark, [f"{sf_dir}/records.parquet"], lambda: _view(spark, sf_dir, "payload", "evidence", "tags"), stem)


def _eligible(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current records of one namespace."""
    v = _view(spark, sf_dir, "recorded_at", *columns, only=ledger.in_scope("fleet.memory", None))
    return ledger.current(v, ledger.predecessors(table(spark, sf_dir, "records")))


@query(VIEW + _TEXT_TOP + "SELECT CAST(rank AS INT) AS rank, id, score FROM text_top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_hits(_index(spark, sf_dir).score("migration receipt frozen"), _eligible(spark, sf_dir), 100)


@query(VIEW + _TEXT_TOP + "SELECT CAST(rank AS INT) AS rank, id, score FROM text_top")
def bm25_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer from the texts themselves."""
    v = materialize(_flagged(spark, sf_dir, "namespace", "recorded_at", "payload", "evidence", "tags"), "search")
    return search.top_text(v, "migration receipt frozen", 100, ~F.col("superseded") & ~F.col("revoked") & (F.col("namespace") == "fleet.memory"))


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_hits(_index(spark, sf_dir, True).score("migration receipt frozen", True), _eligible(spark, sf_dir), 100)


@query(VIEW + _bm25_sql(["lane", "docs"]) + "SELECT id, round(score, 6) AS score FROM hits")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).score("lane docs").select("id", F.round("score", 6).alias("score"))


@query(VIEW + f"""SELECT id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'fails' AND w[i + 1] = 'closed')) AS n FROM (SELECT id, {_WORDS} AS w FROM led) WHERE n > 0""")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which the tokens of ``fails-closed`` follow one another, and how often, from the postings."""
    index = _index(spark, sf_dir)
    rows = spark.read.parquet(f"{index.path}/postings").where(F.col("term").isin("fails", "closed"))
    at = lambda t, j: F.collect_list(F.when(F.col("term") == t, F.col("pos") - j))
    n = rows.groupBy("id").agg(F.size(F.array_intersect(at("fails", 0), at("closed", 1))).cast("long").alias("n")).where("n > 0")
    return n.join(index.score("fails-closed").select("id"), "id", "left_semi")


@query(VIEW + f"SELECT term, count(*) AS n_records, CAST(sum(tf) AS BIGINT) AS n_uses FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_WORDS}) AS term FROM led) GROUP BY ALL) GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms()


_Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, sf_dir, "embeddings")
    return e, [float(x) for x in e.orderBy("vec_id").select("embedding").first()[0]]


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points, q = _first_vector(spark, sf_dir)
        return search.nearest(points, q, 50, metric).select("vec_id", F.round("score", 6).alias("score"))

    run.__name__ = f"knn_{metric}"
    return run


_SIM = {"cosine": "list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)", "dot": "list_inner_product(CAST(embedding AS DOUBLE[]), q)", "euclid": "-list_distance(CAST(embedding AS DOUBLE[]), q)", "manhattan": "-list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda z: abs(z[1] - z[2])))"}
for _m, _s in _SIM.items():
    query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_s} AS s FROM embeddings, (SELECT {_Q0} AS q)) ORDER BY s DESC, vec_id LIMIT 50")(_knn(_m))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_SIM['cosine']} AS s FROM embeddings, (SELECT {_Q0} AS q)) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 1000")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, q = _first_vector(spark, sf_dir)
    return search.nearest(points, q, 1000, "cosine", 0.2).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10")
def knn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors, exactly."""
    e = table(spark, sf_dir, "embeddings")
    return search.nearest_of_all(e.where(F.col("vec_id") % 20 == 0), e, 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


#: Vectors of the first records in order of id, by the vector's number; vec_top: the eligible ones nearest to the first vector.
_VECTORS = f""", pts AS (SELECT r.id, CAST(e.embedding AS DOUBLE[]) AS x FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM led) r JOIN embeddings e ON e.vec_id = r.k),
vec_top AS (SELECT CAST(row_number() OVER (ORDER BY round(s, 9) DESC, id) AS INT) AS rank, id, s FROM (SELECT p.id, list_cosine_similarity(p.x, q) AS s FROM pts p JOIN v ON v.id = p.id, (SELECT {_Q0} AS q) WHERE NOT superseded AND NOT revoked AND namespace = 'fleet.memory') QUALIFY rank <= 100)
"""


def _vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _first_vector(spark, sf_dir)
    numbered = ledger.ordinals(_view(spark, sf_dir), "id").select((F.col("ordinal") - 1).alias("vec_id"), "id")
    points = e.join(numbered, "vec_id").join(_eligible(spark, sf_dir).select("id"), "id", "left_semi")
    hits = search.nearest(points, q, 100, "cosine", key="id").select("id", F.round("score", 9).alias("score"))
    return search.ranked(hits, [F.desc("score"), F.asc("id")], 100)


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _vector_top(spark, sf_dir), search.top_hits(_index(spark, sf_dir).score("migration receipt frozen"), _eligible(spark, sf_dir), 100)


@query(VIEW + _VECTORS + "SELECT rank, id FROM vec_top")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible records nearest to a vector: lifecycle and namespace narrow the candidates before the limit."""
    return _vector_top(spark, sf_dir)


@query(VIEW + _TEXT_TOP + _VECTORS + """, j AS (SELECT coalesce(a.id, b.id) AS id, a.rank + 60 AS x, b.rank + 60 AS y FROM vec_top a FULL JOIN text_top b ON a.id = b.id),
f AS (SELECT id, CAST(CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE x + y END AS BIGINT) AS numerator, CAST(CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE x * y END AS BIGINT) AS denominator FROM j)
SELECT id, numerator, denominator, CAST(row_number() OVER (ORDER BY CAST(numerator AS DOUBLE) / denominator DESC, id) AS INT) AS position FROM f""")
def rrf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.reciprocal_ranks(*_two_lists(spark, sf_dir))


@query(VIEW + _TEXT_TOP + _VECTORS + """, u AS (SELECT id, min(p * 100000 + rank) AS k FROM (SELECT id, 0 AS p, rank FROM vec_top UNION ALL SELECT id, 1 AS p, rank FROM text_top) GROUP BY id)
SELECT CAST(row_number() OVER (ORDER BY k, id) AS INT) AS position, id, CASE WHEN k < 100000 THEN 'vector' ELSE 'fts' END AS source FROM u QUALIFY position <= 150""")
def hybrid_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ordered(*_two_lists(spark, sf_dir), 150)


# --- context ---------------------------------------------------------------

_SELECTORS = [
    context.Selector("fleet.lesson.v1", ("fts", "tag"), ("must",), ("core",), rank_pointer="/confidence"),
    context.Selector("fleet.roleset.v1", ("recency",), ("must",), (), {"role": "/role"}, {"role": "set_or_wildcard"}),
    context.Selector("plan.decision.v1", ("exact",), (), ("core",)),
]
_GRANTS = [(ns, t) for ns in ("fleet.memory", "plan.briaquufaen", "store.baekrouploun") for t in ("fleet.lesson.v1", "fleet.roleset.v1", "plan.decision.v1", "plan.task.v1")]
_REQUEST = context.Request("2026-01-01T00:00:00Z", "migration", ("retro",), (), {"role": ["runner", "reviewer"]})
_GATE_SQL = f""", g AS (SELECT v.*, CASE WHEN NOT (namespace IN ('fleet.memory', 'plan.briaquufaen', 'store.baekrouploun') AND type_name IN ('fleet.lesson.v1', 'fleet.roleset.v1', 'plan.decision.v1', 'plan.task.v1')) THEN 'unauthorized' WHEN superseded THEN 'superseded'
 WHEN revoked OR len(list_filter({_TAGS}, lambda t: regexp_full_match(lower(t), '[a-z]+:revoked'))) > 0 THEN 'revoked' WHEN {us_sql('coalesce(valid_at, observed_at)')} > 1767225600000000 THEN 'invalid_at_request_time'
 WHEN type_name NOT IN ('fleet.lesson.v1', 'fleet.roleset.v1', 'plan.decision.v1') THEN 'selector_mismatch' WHEN type_name = 'fleet.roleset.v1' AND NOT coalesce({_ROLE} IN ('runner', 'reviewer'), true) THEN 'selector_mismatch' END AS reason FROM v)
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.gate(_flagged(spark, sf_dir, "namespace", "type_name", "observed_at", "valid_at", "payload", "tags", "record_sha256"), _GRANTS, _SELECTORS, _REQUEST)


@query(VIEW + _GATE_SQL + "SELECT id, reason FROM g WHERE reason IS NOT NULL")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where(F.col("reason").isNotNull()).select("id", "reason")


@query(VIEW + _GATE_SQL + "SELECT type_name, coalesce(reason, 'kept') AS reason, count(*) AS n FROM g GROUP BY ALL")
def gate_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.reason_counts(_gated(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _view(spark, sf_dir, "namespace", "type_name", "observed_at", "valid_at", "payload", "tags", "record_sha256", only=context.may_read(_GRANTS))
    flagged = ledger.with_superseded(scoped, ledger.predecessors(table(spark, sf_dir, "records")))
    kept = context.gate(flagged, _GRANTS, _SELECTORS, _REQUEST).where(F.col("reason").isNull())
    return context.classify(kept, _SELECTORS, _REQUEST)


_CLASS_SQL = _GATE_SQL + f""", k AS (SELECT g.*, {_TAGS} AS tg FROM g WHERE reason IS NULL),
c AS (SELECT id, observed_at, record_sha256, CASE WHEN type_name IN ('fleet.lesson.v1', 'fleet.roleset.v1') AND list_contains(tg, 'must') THEN 'required' WHEN type_name IN ('fleet.lesson.v1', 'plan.decision.v1') AND list_contains(tg, 'core') THEN 'core'
 WHEN type_name = 'fleet.roleset.v1' THEN 'relevant' WHEN type_name = 'fleet.lesson.v1' AND list_contains(tg, 'retro') THEN 'relevant' WHEN type_name = 'plan.decision.v1' AND (contains(lower(payload), 'migration') OR len(list_filter(tg, lambda t: contains(lower(t), 'migration'))) > 0) THEN 'relevant' END AS tier,
 CASE WHEN type_name = 'fleet.lesson.v1' THEN TRY_CAST(json_extract_string(payload, '$.confidence') AS DOUBLE) END AS rank FROM k)
"""


@query(VIEW + _CLASS_SQL + "SELECT id, tier FROM c")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("id", "tier")


@query(VIEW + _CLASS_SQL + "SELECT CAST(row_number() OVER (ORDER BY CASE tier WHEN 'required' THEN 0 WHEN 'core' THEN 1 ELSE 2 END, rank DESC NULLS LAST, observed_at DESC NULLS LAST, id) AS INT) AS position, id, tier FROM c WHERE tier IS NOT NULL QUALIFY position <= 10000")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in order; the SQL stops at 10,000, so beyond that it says less."""
    return context.numbered(_classified(spark, sf_dir), "id", "tier")


@query()
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle under a profile's budget, required records first, or one row that says they overflow it; words stand for tokens here, the count is a parameter. More than MOST_CANDIDATES candidates raise."""
    page = [r.asDict() for r in context.page(_classified(spark, sf_dir), context.MOST_CANDIDATES + 1).select("id", "tier", "payload", "record_sha256").toLocalIterator()]
    rows = context.bundle_rows(page, context.Budget(2048, 768, 512, 256, 64, 30), lambda rs: "\n\n".join(r["payload"] or "" for r in rs), lambda t: len(t.split()))
    return spark.createDataFrame(rows, "position int, id string, tier string, tokens int, outcome string")


@query(VIEW + f"SELECT id FROM led WHERE type_name = 'fleet.roleset.v1' AND coalesce({_ROLE} IN ('runner', 'reviewer'), true)")
def coordinate_set_or_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir, "type_name", "payload", only=_of_type("fleet.roleset.v1"))
    fits = context._coordinate_udf(_SELECTORS, _REQUEST)
    return v.where(fits(F.col("payload"), F.col("type_name"))).select("id")


@query(VIEW + f"SELECT 'project' AS key, true AS declared, count(*) FILTER (json_extract_string(payload, '$.project') IS NOT NULL) AS n_naming, count(*) FILTER (json_extract_string(payload, '$.project') IN ('nowhere')) AS n_matching FROM led UNION ALL SELECT 'role', true, count(*) FILTER ({_ROLE} IS NOT NULL), count(*) FILTER ({_ROLE} IN ('runner', 'reviewer')) FROM led UNION ALL SELECT 'zone', false, 0, 0")
def unmatched_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.unmatched_coordinates(_view(spark, sf_dir, "payload"), {"role": "/role", "project": "/project"}, {"role": ["runner", "reviewer"], "project": "nowhere", "zone": 1})


# --- compaction, ingest, sync, defense ----------------------------------------


@query(VIEW + "SELECT id, CASE WHEN superseded THEN 'superseded' ELSE 'revoked' END AS reason FROM v WHERE superseded OR revoked")
def compact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.native_plan(_flagged(spark, sf_dir))


@query(VIEW + "SELECT k.id, CASE WHEN g.id IS NULL THEN k.supersedes END AS supersedes, g.id IS NOT NULL AS severed FROM v k LEFT JOIN (SELECT id FROM v WHERE superseded OR revoked) g ON g.id = k.supersedes WHERE NOT (k.superseded OR k.revoked)")
def compact_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _flagged(spark, sf_dir)
    return compaction.rewritten(v, compaction.native_plan(v)).select("id", "supersedes", "severed")


_ANCHORS = "a AS (SELECT lower(trim(kind)) AS kind, lower(trim(target)) AS target, arg_max(lower(trim(state)) = 'dead', (recorded_at, lower(trim(state)) = 'dead')) AS dead, min(recorded_at) AS first_at, max(recorded_at) AS last_at FROM anchor_facts WHERE kind IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_ANCHORS} SELECT kind, target, dead, first_at, last_at FROM a")
def anchor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.anchor_states(table(spark, sf_dir, "anchor_facts"))


@query(VIEW + f", {_ANCHORS}" + """, b AS (SELECT v.*, p.id IS NOT NULL AS parent_gone FROM v LEFT JOIN (SELECT id FROM v WHERE superseded) p ON p.id = v.supersedes)
SELECT id, superseded AS remove, CASE WHEN superseded THEN 'superseded' ELSE 'active_descendant' END AS reason FROM b WHERE superseded OR parent_gone""")
def compact_manifest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = compaction.anchor_states(table(spark, sf_dir, "anchor_facts"))
    return compaction.manifest_plan(_flagged(spark, sf_dir, "tags", "payload"), anchors, "2026-01-01T00:00:00Z")


@query("""SELECT ordinal, sha256, CASE WHEN known THEN 'known' WHEN n > 1 THEN 'repeated' ELSE 'import' END AS action FROM (SELECT doc_id AS ordinal, sha256(text) AS sha256, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) AS known,
 row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL)""")
def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids arrive at a ledger that holds those with even ids."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.import_plan(d.where(F.col("doc_id") % 2 == 1).select(F.col("doc_id").alias("ordinal"), "sha256"), d.where(F.col("doc_id") % 2 == 0))


@query("""SELECT ordinal, CASE WHEN n = 1 THEN 'new' WHEN sha = first_sha THEN 'replay' ELSE 'conflict' END AS verdict FROM (SELECT doc_id AS ordinal, sha256(text) AS sha, row_number() OVER w AS n, first_value(sha256(text)) OVER w AS first_sha FROM documents WHERE text IS NOT NULL
 WINDOW w AS (PARTITION BY coalesce(lower(trim(source)), ''), coalesce(namespace, ''), coalesce(kind, '') ORDER BY doc_id))""")
def idempotent_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as keyed writes: the source is the actor, namespace and kind make the key."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    req = d.select(F.col("doc_id").alias("ordinal"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("actor"), F.concat(F.coalesce("namespace", F.lit("")), F.lit("\x01"), F.coalesce("kind", F.lit(""))).alias("key"), F.sha2("text", 256).alias("draft_sha256"))
    return ingest.replay(req, req.select("actor", "key", "draft_sha256").limit(0))


@query(VIEW + """SELECT id, fault FROM (SELECT id, CASE WHEN namespace IS NULL OR NOT regexp_full_match(namespace, '[a-z0-9][a-z0-9-]*(\\.[a-z0-9][a-z0-9-]*)*') THEN 'namespace' WHEN type_name IS NULL OR NOT regexp_full_match(type_name, '([a-z0-9-]+\\.){2,}v[0-9]+') THEN 'type_name'
 WHEN actor IS NULL OR trim(actor) = '' THEN 'actor' WHEN NOT coalesce(regexp_full_match(record_sha256, '[0-9a-f]{64}'), false) THEN 'record_sha256' WHEN payload IS NULL THEN 'payload' WHEN tags IS NULL THEN 'tags' WHEN evidence IS NULL THEN 'evidence' END AS fault FROM led) WHERE fault IS NOT NULL""")
def record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validity(_view(spark, sf_dir, "namespace", "type_name", "actor", "record_sha256", "recorded_at", "payload", "tags", "evidence"))


@query(VIEW + "SELECT id, 'rule' AS field, len(list_filter(regexp_split_to_array(json_extract_string(payload, '$.rule'), '\\s+'), lambda w: w <> '')) AS words FROM led WHERE type_name = 'fleet.lesson.v1' AND len(list_filter(regexp_split_to_array(json_extract_string(payload, '$.rule'), '\\s+'), lambda w: w <> '')) > 30")
def word_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.over_word_limit(_view(spark, sf_dir, "type_name", "payload", only=_of_type("fleet.lesson.v1")), {("fleet.lesson.v1", "rule"): 30})


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir, "namespace", "type_name", "record_sha256", "tags", "payload")
    return sync.hashed_embedding(sync.documents(v))


@query("SELECT event_type, CAST(ts AS DATE)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.streaming.catchup import windowed

    return windowed(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT coalesce(nullif(lower(trim(source)), ''), '') AS source, count(*) AS n, count(DISTINCT sha256(text)) AS n_texts FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(clean_key(F.col("source")), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"))


@query(VIEW + """SELECT id, CASE WHEN list_contains(string_split(type_name, '.'), 'role') THEN 'role' WHEN list_contains(string_split(type_name, '.'), 'process') THEN 'process' WHEN list_contains(string_split(type_name, '.'), 'step') THEN 'step'
 WHEN json_extract_string(payload, '$.does') IS NOT NULL OR (json_extract_string(payload, '$.gate') IS NOT NULL AND json_extract_string(payload, '$.do') IS NOT NULL) THEN 'step' WHEN json_extract_string(payload, '$.purpose') IS NOT NULL THEN 'process'
 WHEN json_extract_string(payload, '$.do') IS NOT NULL AND json_extract_string(payload, '$.kind') IS NOT NULL THEN 'role' ELSE 'other' END AS kind FROM led""")
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "type_name", "payload").select("id", types.record_kind().alias("kind"))


_SCHEMAS = {
    "fleet.lesson.v1": {"type": "object", "required": ["rule", "confidence"], "properties": {"rule": {"type": "string"}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}},
    "fleet.roleset.v1": {"type": "object", "required": ["title"], "properties": {"role": {"type": ["string", "array", "null"]}}},
}


@query(VIEW + """SELECT id, CAST(n AS INT) AS n_faults FROM (SELECT id, CASE WHEN payload IS NULL OR json_type(payload) <> 'OBJECT' THEN 1 WHEN type_name = 'fleet.lesson.v1' THEN CAST(json_type(payload, '$.rule') IS NULL AS INT) + CAST(json_type(payload, '$.confidence') IS NULL AS INT)
 + CAST(coalesce(json_type(payload, '$.rule') <> 'VARCHAR', false) AS INT) + CAST(coalesce(json_type(payload, '$.confidence') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT'), false) AS INT) + CAST(coalesce(json_type(payload, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND NOT (TRY_CAST(json_extract_string(payload, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1), false) AS INT)
 ELSE CAST(json_type(payload, '$.title') IS NULL AS INT) + CAST(coalesce(json_type(payload, '$.role') NOT IN ('VARCHAR', 'ARRAY', 'NULL'), false) AS INT) END AS n FROM led WHERE type_name IN ('fleet.lesson.v1', 'fleet.roleset.v1')) WHERE n > 0""")
def payload_schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir, "type_name", "payload", only=_of_type(*sorted(_SCHEMAS)))
    return types.payload_faults(v, _SCHEMAS).select("id", "n_faults")


@query("SELECT * FROM (VALUES ('fleet.lesson.v1', 'confidence', 'number', true, NULL), ('fleet.lesson.v1', 'rule', 'string', true, NULL), ('fleet.roleset.v1', 'role', 'string|array|null', false, NULL)) t(type_name, field, type, required, enum)")
def type_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.catalog(spark, _SCHEMAS)


@query(VIEW + "SELECT id, '{' || CASE WHEN json_type(payload, '$.confidence') IS NOT NULL THEN '\"confidence\":' || json_extract(payload, '$.confidence') || ',' ELSE '' END || '\"type\":\"' || type_name || '\"}' AS fields FROM led WHERE type_name = 'fleet.lesson.v1'")
def projected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _view(spark, sf_dir, "type_name", "payload", only=_of_type("fleet.lesson.v1"))
    return types.project_fields(v, ["type", "confidence", "nowhere"])


@query()
def engine_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves over the ledger, the vectors made by the offline embedder; the text half fills what the vector half leaves."""
    v = materialize(_flagged(spark, sf_dir, "namespace", "type_name", "actor", "recorded_at", "observed_at", "valid_at", "record_sha256", "payload", "evidence", "tags"), "engine")
    docs = materialize(sync.documents(v), "documents")
    points = materialize(sync.hashed_embedding(docs).join(docs.select("id", "input_sha256"), "id"), "points")
    embed = lambda q: [float(x) for x in sync.hashed_embedding(spark.createDataFrame([("q", q)], "id string, text string")).first()[1]]
    e = engine.SearchEngine(v, points, docs, embed, engine.Policy(score_threshold=0.2))
    return e.search("the migration returned a frozen receipt", "hybrid", 100, namespace="fleet.memory", flags=["record.tags=!draft"]).hits


@query(VIEW + """, p AS (SELECT id, count(*) AS n, bool_or(payload IS NOT NULL) AS pl, bool_or(evidence IS NOT NULL) AS ev, bool_or(tags IS NOT NULL) AS tg, bool_or(TRY_CAST(regexp_replace(recorded_at, '(\\.\\d{6})\\d+', '\\1') AS TIMESTAMPTZ) IS NOT NULL) AS ok, min(supersedes) AS supersedes FROM d WHERE id IS NOT NULL GROUP BY id)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_records, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (NOT pl) AS n_without_payload, count(*) FILTER (NOT ev) AS n_without_evidence, count(*) FILTER (NOT tg) AS n_without_tags, count(*) FILTER (NOT ok) AS n_bad_instants,
 count(*) FILTER (supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM p)) AS n_dangling FROM p""")
def integrity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.integrity(table(spark, sf_dir, "records"))


@query(VIEW + "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' ELSE 'digest' END AS fault FROM (SELECT id, record_sha256 FROM v WHERE NOT superseded) a FULL JOIN (SELECT id, record_sha256 FROM v WHERE NOT revoked) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.record_sha256 IS DISTINCT FROM b.record_sha256")
def projection_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a projection without the revoked has against a truth without the superseded."""
    v = _flagged(spark, sf_dir, "record_sha256")
    return ledger.compare(v.where(~F.col("superseded")), v.where(~F.col("revoked")))
