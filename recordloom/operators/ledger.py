"""The ledger as one relation: views, lifecycle, edges, counts, point reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import canonical_uuid, instant, predecessor_uuid
from recordloom.session import materialize


def clean_json(c: Column) -> Column:
    """The JSON text of a column, opened if kept as text inside JSON; null if damaged. A text is parsed once, one inside JSON twice."""
    inner = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.when(c.rlike('^[ \\t\\r\\n]*"'), F.when(F.try_parse_json(inner).isNotNull(), inner)).when(F.try_parse_json(c).isNotNull(), c)


_TEXTS = ("namespace", "type_name", "actor", "recorded_at", "observed_at", "valid_at", "payload", "evidence", "tags", "supersedes", "record_sha256", "ledger")


def deliveries(records: DataFrame) -> DataFrame:
    """Every delivered row with canonical ids and readable JSON."""
    return records.select(
        canonical_uuid(F.col("id")).alias("id"), "namespace", "type_name", "actor", "recorded_at", "observed_at", "valid_at", clean_json(F.col("payload_json")).alias("payload"), clean_json(F.col("evidence_json")).alias("evidence"),
        clean_json(F.col("tags_json")).alias("tags"), predecessor_uuid(F.col("supersedes")).alias("supersedes"), (F.coalesce(F.col("revoked"), F.lit(0)) == 1).alias("revoked"), F.coalesce(F.col("superseded"), F.lit(0)).cast("int").alias("superseded_flag"),
        "record_sha256", "ledger",
    ).where(F.col("id").isNotNull())


#: What all deliveries of a record spell alike, so that a condition on it may go below the grouping, down to the scan.
PLAIN = ("namespace", "type_name", "actor")


def ledger_view(records: DataFrame, columns: tuple[str, ...] = _TEXTS, only: Column | None = None) -> DataFrame:
    """One row for each record: id, the named columns, revoked.

    Deliveries of one record say the same, so the smallest spelling of each
    column stands for it; any revoked delivery revokes. Columns that are not
    asked for are neither parsed nor shuffled. ``only`` is a condition on the
    PLAIN columns; it cuts deliveries before anything is parsed or shuffled.
    """
    source = records if only is None else records.where(only)
    return deliveries(source).groupBy("id").agg(*[F.min(c).alias(c) for c in columns], F.max("revoked").alias("revoked"))


def predecessors(records: DataFrame) -> DataFrame:
    """id of every record that some delivery names as its predecessor, once each: all that has to be known of the records outside a scope."""
    return records.select(predecessor_uuid(F.col("supersedes")).alias("id")).where(F.col("id").isNotNull()).distinct()


def in_scope(namespace: str | None, type_name: str | None) -> Column:
    """The condition of a namespace and a type, either of which may be left open."""
    out = F.lit(True)
    for name, value in (("namespace", namespace), ("type_name", type_name)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def with_superseded(view: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Adds ``superseded``: some record names this one as its predecessor. ``named`` (``predecessors``) is needed if the view is but a part."""
    if named is None:
        named = view.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id")).distinct()
    return view.join(named.withColumn("superseded", F.lit(True)), "id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def current(view: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Records no other record supersedes and nobody revoked."""
    if named is None:
        named = view.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"))
    return view.where(~F.col("revoked")).join(named, "id", "left_anti")


def scan(records: DataFrame, namespace: str | None, type_name: str | None, limit: int) -> DataFrame:
    """Current records of a scope in id order, a page of ``limit`` rows (1 to 10,000)."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be between 1 and 10000")
    scoped = ledger_view(records, ("namespace", "type_name"), in_scope(namespace, type_name))
    return current(scoped, predecessors(records)).orderBy("id").limit(limit)


def ordinals(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``ordinal`` (from 1) in order of ``key``: rank within the sort's partitions plus the partitions' offsets, no window over all rows."""
    ordered = materialize(rows.orderBy(key).withColumn("_m", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_m", 33))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a partition
    at = F.col("_base") + (F.col("_m") - F.shiftleft("_part", 33)) + 1
    return ordered.join(F.broadcast(offsets), "_part").select(at.alias("ordinal"), *rows.columns)


def locate(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """ordinal, id, ledger, record_sha256 in the order of ``wanted`` (ordinal, id); unknown ids are left out."""
    at = records.select(canonical_uuid(F.col("id")).alias("id"), "ledger", "record_sha256").join(wanted.select("id"), "id", "left_semi")
    return wanted.join(at.groupBy("id").agg(F.min("ledger").alias("ledger"), F.min("record_sha256").alias("record_sha256")), "id").select("ordinal", "id", "ledger", "record_sha256")


def get(records: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = _TEXTS) -> DataFrame:
    """The records with the ids of ``wanted`` (id), superseded and revoked ones too; other deliveries are neither parsed nor shuffled whole."""
    ids = wanted.select(canonical_uuid(F.col("id")).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    held = records.withColumn("_id", canonical_uuid(F.col("id"))).join(ids, "_id", "left_semi").drop("_id")
    return ledger_view(held, columns)


def claims(view: DataFrame, type_registry: DataFrame) -> DataFrame:
    """id, type_name, claimed_by: each linear type whose line a record belongs to, its own or one that lists its type as a predecessor."""
    linear = type_registry.where(F.col("lifecycle_mode") == "linear").select(F.col("type_name").alias("claimed_by"), F.explode(F.array_union(F.array("type_name"), F.coalesce("predecessor_types", F.array().cast("array<string>")))).alias("type_name")).distinct()
    return view.join(linear, "type_name").select("id", "type_name", "claimed_by")


def counts(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, live, dead, superseded, revoked, both; dead = superseded + revoked - both."""
    n = lambda c: F.count_if(c)
    s, r = F.col("superseded"), F.col("revoked")
    return flagged.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), n(~s & ~r).alias("live"), n(s | r).alias("dead"), n(s).alias("n_superseded"), n(r).alias("n_revoked"), n(s & r).alias("n_both"))


def repeated_deliveries(records: DataFrame) -> DataFrame:
    """Ids that were delivered more than once, with how often and in how many spellings."""
    d = records.select(canonical_uuid(F.col("id")).alias("id"), "payload_json", "recorded_at").where(F.col("id").isNotNull())
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.coalesce("payload_json", F.lit(""))).alias("n_spellings"), F.count_distinct("recorded_at").alias("n_instants")).where(F.col("n_rows") > 1)


def stale_flags(records: DataFrame) -> DataFrame:
    """Deliveries whose stored ``superseded`` flag differs from what the graph says."""
    d = deliveries(records).select("id", "supersedes", "superseded_flag")
    named = d.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id")).distinct().withColumn("named", F.lit(1))
    j = d.join(named, "id", "left").withColumn("truth", F.coalesce("named", F.lit(0)))
    return j.where(F.col("truth") != F.col("superseded_flag")).groupBy("id", "truth").agg(F.count(F.lit(1)).alias("n_rows"))


def fan_out(view: DataFrame) -> DataFrame:
    """Children of each named predecessor that exists."""
    per = view.where(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return per.join(view.select("id"), "id", "left_semi")


def edge_verdicts(view: DataFrame, type_registry: DataFrame) -> DataFrame:
    """id, supersedes, verdict for each record with a predecessor.

    In order: unknown parent, self edge, cross-namespace, append-only type,
    cross-type (neither the same type nor an allowed predecessor type), ok. The
    registry is a small fixed table.
    """
    types = type_registry.groupBy("type_name").agg(F.min("lifecycle_mode").alias("mode"), F.flatten(F.collect_list("predecessor_types")).alias("allowed"))
    child = view.where(F.col("supersedes").isNotNull()).select("id", "supersedes", "namespace", "type_name")
    parent = view.select(F.col("id").alias("supersedes"), F.col("namespace").alias("p_ns"), F.col("type_name").alias("p_type"))
    j = child.join(parent, "supersedes", "left").join(types, "type_name", "left")
    ok_type = (F.col("p_type") == F.col("type_name")) | F.coalesce(F.array_contains("allowed", F.col("p_type")), F.lit(False))
    verdict = (
        F.when(F.col("p_type").isNull(), "unknown_parent").when(F.col("id") == F.col("supersedes"), "self_edge").when(~F.col("namespace").eqNullSafe(F.col("p_ns")), "cross_namespace")
        .when(F.col("mode") == "append_only", "append_only").when(~ok_type, "cross_type").otherwise("ok")
    )
    return j.select("id", "supersedes", verdict.alias("verdict"))


def linear_conflicts(view: DataFrame, type_registry: DataFrame) -> DataFrame:
    """Records of linear types with more than one successor: their line has more than one head."""
    linear = type_registry.where(F.col("lifecycle_mode") == "linear").select("type_name").distinct()
    child = view.where(F.col("supersedes").isNotNull()).join(linear, "type_name", "left_semi").groupBy(F.col("supersedes").alias("id"), "type_name").agg(F.count(F.lit(1)).alias("n_successors"))
    return child.where(F.col("n_successors") > 1).join(view.select("id"), "id", "left_semi").select("id", "type_name", "n_successors")


def heads(view: DataFrame, type_registry: DataFrame) -> DataFrame:
    """Heads (records nothing supersedes) per namespace and type, with the type's lifecycle mode."""
    named = view.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"))
    modes = type_registry.groupBy("type_name").agg(F.min("lifecycle_mode").alias("mode"))
    return view.join(named, "id", "left_anti").groupBy("namespace", "type_name").agg(F.count(F.lit(1)).alias("n_heads")).join(modes, "type_name", "left").select("namespace", "type_name", "mode", "n_heads")


def too_early(view: DataFrame, most_ahead_us: int = 60_000_000) -> DataFrame:
    """Records observed more than 60 s after they were recorded; however old an observation is, it is fine."""
    ahead = F.unix_micros(instant(F.col("observed_at"))) - F.unix_micros(instant(F.col("recorded_at")))
    return view.select("id", ahead.alias("ahead_us")).where(F.col("ahead_us") > most_ahead_us)


def valid_as_of(view: DataFrame, at: str) -> DataFrame:
    """Records whose valid_at is not after ``at``; without valid_at the observation counts."""
    return view.where(instant(F.coalesce("valid_at", "observed_at")) <= instant(F.lit(at)))


def monthly(view: DataFrame) -> DataFrame:
    """Records and bytes of each monthly shard."""
    return view.groupBy("ledger").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("payload")).alias("payload_bytes"))


def type_lineage(type_registry: DataFrame) -> DataFrame:
    """type_name, current: a type is current unless another type lists it as a predecessor."""
    named = type_registry.select(F.explode("predecessor_types").alias("type_name")).distinct().withColumn("named", F.lit(True))
    return type_registry.select("type_name").distinct().join(named, "type_name", "left").select("type_name", F.col("named").isNull().alias("current"))


def latest_per_scope(view: DataFrame, k: int) -> DataFrame:
    """The k newest current records of each namespace, by recorded instant, then id."""
    w = Window.partitionBy("namespace").orderBy(F.col("us").desc_nulls_last(), "id")
    ranked = current(view).withColumn("us", F.unix_micros(instant(F.col("recorded_at")))).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("namespace", "rank", "id")


def tombstones(view: DataFrame, ids: DataFrame, tag: str, observed_at: str) -> DataFrame:
    """Drafts that withdraw the given current records: the payload as it is, the tag added, superseding the record."""
    named = view.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"))
    held = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    target = view.join(ids.select("id"), "id", "left_semi").join(named, "id", "left_anti")
    return target.select("namespace", "type_name", F.lit(observed_at).alias("observed_at"), "payload", F.to_json(F.array_union(held, F.array(F.lit(tag)))).alias("tags"), F.col("id").alias("supersedes"))


def pending(corpus: DataFrame, indexed: int, digest: str) -> tuple[str, int | None]:
    """("none", 0), ("records", n) or ("unknown", None): what an index that covered ``indexed`` records with ``digest`` lacks."""
    from recordloom.operators.digests import corpus_digest, prefix_digest

    if corpus_digest(corpus) == digest:
        return "none", 0
    n = corpus.count()
    if indexed > n or prefix_digest(corpus, indexed) != digest:
        return "unknown", None
    return "records", n - indexed


def compare(truth: DataFrame, projection: DataFrame) -> DataFrame:
    """id, fault of every difference between the ledger and what was derived from it: missing, extra or digest."""
    t = truth.select("id", F.col("record_sha256").alias("t"), F.lit(True).alias("in_t"))
    p = projection.select("id", F.col("record_sha256").alias("p"), F.lit(True).alias("in_p"))
    j = t.join(p, "id", "full_outer")
    fault = F.when(F.col("in_p").isNull(), "missing").when(F.col("in_t").isNull(), "extra").when(~F.col("t").eqNullSafe(F.col("p")), "digest")
    return j.select("id", fault.alias("fault")).where(F.col("fault").isNotNull())


def integrity(records: DataFrame) -> DataFrame:
    """One row of counts over all deliveries: rows, ids, unreadable columns and instants, and predecessors that do not exist."""
    d = deliveries(records)
    by_id = d.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("payload").isNotNull()).alias("payload"), F.max(F.col("evidence").isNotNull()).alias("evidence"), F.max(F.col("tags").isNotNull()).alias("tags"),
        F.max(instant(F.col("recorded_at")).isNotNull()).alias("at"), F.min("supersedes").alias("supersedes"),
    )
    parents = by_id.select(F.col("id").alias("supersedes"), F.lit(True).alias("there"))
    j = by_id.join(parents, "supersedes", "left")
    bad = lambda c: F.count_if(~F.col(c))
    return j.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("n") > 1).alias("n_repeated"), bad("payload").alias("n_without_payload"), bad("evidence").alias("n_without_evidence"),
        bad("tags").alias("n_without_tags"), bad("at").alias("n_bad_instants"), F.count_if(F.col("supersedes").isNotNull() & F.col("there").isNull()).alias("n_dangling"),
    )
