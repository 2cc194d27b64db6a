"""Per-entity feature tables from events (problem 5).

Method: incremental time-bucketed partial aggregates. Events are deduplicated
by id, cut into time buckets and pre-aggregated by (bucket, entity, type). The
store keeps the partial aggregates and the few event columns they are made of,
each id once, partitioned by bucket. New files are merged with the buckets
their ids fall or once fell into, and only those buckets are rebuilt; an event
table of any other origin is compared with the store by a digest a bucket.
Features merge the partials of whole buckets with the raw events of the two
boundary buckets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.ids import clean_key
from recordloom.session import delete_path, get_text, list_files, materialize, new_path, path_exists, put_text

BUCKET_SECONDS = 30 * 86_400
_EVENT = "bucket long, id string, at long, duration long, actor string, operation string, outcome string"
_PARTIAL = "bucket long, actor string, operation string, outcome string, n long, latest_at long, total_duration long"


def clean_events(events: DataFrame) -> DataFrame:
    """id, at, duration, actor, operation, outcome, nothing else; unknown actors are null."""
    return events.select("id", F.col("at").cast("long").alias("at"), F.col("duration").cast("long").alias("duration"), clean_key(F.col("actor")).alias("actor"), "operation", "outcome")


def with_bucket(events: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    return events.withColumn("bucket", F.coalesce(F.floor(F.col("at") / seconds).cast("long"), F.lit(-1).cast("long")))


def unique_events(events: DataFrame) -> DataFrame:
    """Each id once. Rows without id cannot be told apart and all count.

    Rows of one id are equal but for their delivery; if they ever differ the
    smallest row wins, so the result does not depend on arrival.
    """
    body = F.struct("at", "duration", "actor", "operation", "outcome", *(["bucket"] if "bucket" in events.columns else []))
    named = events.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(body).alias("e")).select("id", "e.*")
    return named.unionByName(events.where(F.col("id").isNull()))


def partials(events: DataFrame) -> DataFrame:
    return events.groupBy("bucket", "actor", "operation", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("latest_at"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration"))


def bucket_digests(events: DataFrame) -> DataFrame:
    """bucket, rows, digest over the distinct ids and all that features use; order does not matter."""
    h = F.xxhash64("id", "at", "duration", "actor", "operation", "outcome")
    return events.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("digest"), F.bit_xor(h).alias("mix"))


class FeatureStore:
    """At ``path``: ``events/bucket=…`` (each id once), ``partials/bucket=…``, ``digests``, and ``files``, the list of input files taken in.

    A store outlives its session: give the same ``path`` again and go on. Only
    without a path is it an intermediate table. One writer at a time. Partials
    are written before the events they come from and the list of files last, so
    a refresh that dies is repeated, never skipped.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_seconds: int = BUCKET_SECONDS) -> None:
        self.spark, self.path, self.seconds = spark, path or new_path(spark, "features"), bucket_seconds

    def _clean(self, events: DataFrame) -> DataFrame:
        return with_bucket(clean_events(events), self.seconds)

    def _known(self) -> dict[str, list]:
        """Input files taken in, with length and time of change: one entry a file."""
        versions = list_files(self.spark, f"{self.path}/files") if path_exists(self.spark, f"{self.path}/files") else {}
        return json.loads(get_text(self.spark, max(versions))) if versions else {}

    def _remember(self, files: dict[str, list]) -> None:
        n = len(list_files(self.spark, f"{self.path}/files")) if path_exists(self.spark, f"{self.path}/files") else 0
        put_text(self.spark, f"{self.path}/files/{n:012d}.json", json.dumps(files, sort_keys=True))

    def take_in(self, folder: str) -> list[int]:
        """Bring the store level with the Parquet files under ``folder``; returns the buckets that were rebuilt.

        Only files not taken in before are read. If one of those taken in was
        rewritten or is gone, everything is compared (``refresh``).
        """
        now, known = list_files(self.spark, folder), self._known()
        new = sorted(set(now) - set(known))
        if not known or any(now.get(f) != v for f, v in known.items()):
            touched = self.refresh(self.spark.read.parquet(folder))
        elif not new:
            return []
        else:
            touched = self._merge(self.spark.read.parquet(*new))
        self._remember(now)
        return touched

    def _merge(self, events: DataFrame) -> list[int]:
        """Add deliveries to the store: the buckets they fall into and those their ids stand in are rebuilt together."""
        fresh = materialize(unique_events(self._clean(events)), "fresh")
        held = self.events()
        # Of the events already there only id and bucket are read.
        moved = held.select("id", "bucket").join(fresh.select("id").where(F.col("id").isNotNull()).hint("merge"), "id", "left_semi").select("bucket")
        touched = sorted(r[0] for r in fresh.select("bucket").unionByName(moved).distinct().collect())  # as many as there are time buckets
        if touched:
            both = held.where(F.col("bucket").isin(touched)).select(*fresh.columns).unionByName(fresh)
            once = materialize(unique_events(both), "once")
            self._write(once, touched)
            kept = self.spark.read.parquet(f"{self.path}/digests").where(~F.col("bucket").isin(touched))
            self._put_digests(kept.unionByName(bucket_digests(once)))
        return touched

    def refresh(self, events: DataFrame) -> list[int]:
        """Bring the store level with a whole table of events; returns the buckets that were rebuilt.

        All events are deduplicated and digested, and only buckets whose digest
        changed are written: the result does not depend on what came when.
        """
        once = materialize(unique_events(self._clean(events)), "once")
        now = materialize(bucket_digests(once), "digests")
        if not path_exists(self.spark, f"{self.path}/digests"):
            touched = sorted(r[0] for r in now.select("bucket").collect())
            self._write(once, None)
        else:
            was = self.spark.read.parquet(f"{self.path}/digests").select("bucket", F.col("rows").alias("r0"), F.col("digest").alias("d0"), F.col("mix").alias("m0"))
            diff = now.join(was, "bucket", "full_outer").where(~(F.col("rows").eqNullSafe(F.col("r0")) & F.col("digest").eqNullSafe(F.col("d0")) & F.col("mix").eqNullSafe(F.col("m0"))))
            touched = sorted(r[0] for r in diff.select("bucket").collect())  # as many as there are time buckets
            if not touched:
                return []
            self._write(once.where(F.col("bucket").isin(touched)), touched)
        self._put_digests(now)
        return touched

    def _write(self, once: DataFrame, touched: list[int] | None) -> None:
        """Replace the touched buckets (null: all) by what ``once`` holds of them; tasks follow the size of a bucket."""
        for name, rows in (("partials", partials(once)), ("events", once)):
            at = f"{self.path}/{name}"
            rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(at)
            alive = {r[0] for r in once.select("bucket").distinct().collect()} if touched else set()
            for gone in set(touched or ()) - alive:
                delete_path(self.spark, f"{at}/bucket={gone}")

    def _put_digests(self, digests: DataFrame) -> None:
        staged = materialize(digests, "digests")
        staged.write.mode("overwrite").parquet(f"{self.path}/digests")

    def events(self) -> DataFrame:
        return self.spark.read.schema(_EVENT).parquet(f"{self.path}/events")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(_PARTIAL).parquet(f"{self.path}/partials")

    def merged(self, events: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """actor, operation, outcome, n, latest_at, total_duration for start <= at < end (seconds).

        Buckets wholly inside come from the partials; boundary buckets are read
        from ``events``. Without limits the partials alone answer.
        """
        p = self.stored()
        if start is None and end is None:
            parts = p
        else:
            lo = -(2**62) if start is None else start
            hi = 2**62 if end is None else end
            first_full, last_full = -(-lo // self.seconds), hi // self.seconds  # whole buckets: first_full <= b < last_full
            parts = p.where((F.col("bucket") >= first_full) & (F.col("bucket") < last_full))
            if events is None and (lo % self.seconds or hi % self.seconds):
                raise ValueError("limits inside a bucket need the events")
            if events is not None:
                inside = (F.col("at") >= lo) & (F.col("at") < hi) & ((F.col("at") < first_full * self.seconds) | (F.col("at") >= last_full * self.seconds))
                edge = with_bucket(clean_events(events.where(inside)), self.seconds)
                parts = parts.unionByName(partials(unique_events(edge)).select(*parts.columns))
        return parts.groupBy("actor", "operation", "outcome").agg(F.sum("n").alias("n"), F.max("latest_at").alias("latest_at"), F.sum("total_duration").alias("total_duration"))


def type_label(operation: Column, outcome: Column) -> Column:
    return F.concat_ws("|", F.coalesce(operation, F.lit("missing")), F.coalesce(outcome, F.lit("missing")))


def _per_label(merged: DataFrame) -> DataFrame:
    per = merged.withColumn("label", type_label(F.col("operation"), F.col("outcome")))
    return per.groupBy("actor", "label").agg(F.sum("n").alias("n"), F.max("latest_at").alias("latest_at"), F.sum("total_duration").alias("total_duration"))


def _per_actor(merged: DataFrame) -> DataFrame:
    """actor, f: a map from event type to its figures, at most as long as the list of types."""
    return _per_label(merged).groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("n", "latest_at", "total_duration")))).alias("f"))


def wide(merged: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each actor, three columns for each event type; never-seen pairs are 0, null, 0.

    A pivot over known labels: each figure goes to its column by one look-up.
    """
    per = _per_label(merged)
    if not labels:
        return per.select("actor").distinct()
    table = per.groupBy("actor").pivot("label", labels).agg(F.first("n").alias("n"), F.first("latest_at").alias("latest_at"), F.first("total_duration").alias("total_duration"))
    zero = F.lit(0).cast("long")
    quoted = lambda name: F.col(f"`{name.replace('`', '``')}`")
    cols: list[Column] = []
    for name in labels:
        cols += [F.coalesce(quoted(f"{name}_n"), zero).alias(f"{name}_n"), quoted(f"{name}_latest_at"), F.coalesce(quoted(f"{name}_total_duration"), zero).alias(f"{name}_total_duration")]
    return table.select("actor", *cols)


def labels_of(merged: DataFrame) -> list[str]:
    """All event types, sorted: the list of columns, as long as the wide table is wide (the long form has no such list)."""
    return [r[0] for r in merged.select(type_label(F.col("operation"), F.col("outcome")).alias("l")).distinct().orderBy("l").collect()]


def long_form(merged: DataFrame, labels: list[str]) -> DataFrame:
    """The same table with a row for each actor and event type."""
    zero = F.lit(0).cast("long")
    rows = _per_actor(merged).select("actor", "f", F.explode(F.array(*[F.lit(x) for x in labels])).alias("event_type")) if labels else _per_actor(merged).select("actor", "f", F.lit("").alias("event_type")).limit(0)
    cell = F.col("f")[F.col("event_type")]
    return rows.select("actor", "event_type", F.coalesce(cell["n"], zero).alias("n"), cell["latest_at"].alias("latest_at"), F.coalesce(cell["total_duration"], zero).alias("total_duration"))
