"""The request-audit log: predicate, list, statistics, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import clean_key

EQUAL_ON = ("surface", "operation", "project", "role", "process", "outcome", "instance", "session", "actor", "lane")


def unique(events: DataFrame) -> DataFrame:
    """Each id once, whatever month its deliveries came in."""
    body = [c for c in events.columns if c != "id"]
    return events.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(*body)).alias("e")).select("id", "e.*")


def select(events: DataFrame, equal: dict[str, str] | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Equality on the event's columns, ``at`` from since (inclusive) to until (exclusive), in seconds."""
    for name, value in (equal or {}).items():
        if name not in EQUAL_ON:
            raise ValueError(f"cannot select by {name}")
        events = events.where(F.col(name) == value)
    if since is not None:
        events = events.where(F.col("at") >= since)
    return events if until is None else events.where(F.col("at") < until)


def newest(events: DataFrame, limit: int) -> DataFrame:
    """Newest first by second, nanosecond and id; a page of 1 to 1,000 rows."""
    if not 1 <= limit <= 1_000:
        raise ValueError("limit must be between 1 and 1000")
    return events.orderBy(F.desc("at"), F.desc("nanos"), F.desc("id")).limit(limit)


#: Durations are counted in steps of 2^16 us (65 ms) first, so a step holds at most that many distinct ones.
_STEP_BITS = 16


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """by, name: the value at rank ceil(q * n) of each group, exactly.

    Values are counted map-side; a window over the counts of coarse steps finds
    the step that holds the rank, and only that step's distinct values are
    ordered. No task sees all values of a large group.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")).withColumn("step", F.shiftright(value, _STEP_BITS))
    steps = counts.groupBy(*by, "step").agg(F.sum("c").alias("c"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("step")
    rank = F.ceil(F.sum("c").over(whole) * q).cast("long")
    steps = steps.select(*by, "step", "c", rank.alias("rank"), F.sum("c").over(upto).alias("cum"))
    hit = steps.where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("c") < F.col("rank"))).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("step").alias("_step"), (F.col("rank") - F.col("cum") + F.col("c")).alias("need"))
    on = F.col("step") == F.col("_step")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = counts.join(hit, on).withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value)))
    return inner.where(F.col("upto") >= F.col("need")).groupBy(*by).agg(F.min(value).alias(name))


def statistics(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, failures, error_rate, least, most, mean and nearest-rank p95 of durations; zeros over nothing."""
    keys = by or []
    rows = events.select(*keys, F.coalesce(F.col("duration"), F.lit(0)).cast("long").alias("d"), "outcome")
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "error").alias("failures"), F.min("d").alias("least_us"), F.max("d").alias("most_us"), F.sum("d").alias("total"))
    p95 = nearest_rank(rows, keys, "d", 0.95, "p95_us").select(*[F.col(k).alias(f"_{k}") for k in keys], "p95_us")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = base.join(p95, on, "left") if keys else base.join(F.broadcast(p95), how="left")  # one row each without keys
    zero = F.lit(0).cast("long")
    n = F.col("n")
    return joined.select(*keys, "n", "failures", F.when(n > 0, F.round(F.col("failures") / n, 6)).otherwise(0.0).alias("error_rate"), *[F.coalesce(c, zero).cast("long").alias(c) for c in ("least_us", "most_us", "p95_us")], F.when(n > 0, F.round(F.col("total") / n, 3)).otherwise(0.0).alias("mean_us"))


def coordinate(c: Column) -> Column:
    """At most 64 safe characters as they are, anything else as the digest of its text."""
    return F.when(c.rlike("^[A-Za-z0-9._:/@-]{1,64}$"), c).otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))


def misses(events: DataFrame) -> DataFrame:
    """Queries and misses per operation: a miss is an event whose output counts nothing."""
    n = F.get_json_object("event", "$.output.count").cast("long")
    return events.where(n.isNotNull()).groupBy("operation").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(n == 0).alias("n_misses"))


def lateness(events: DataFrame) -> DataFrame:
    """Rows per month of arrival and months they came late."""
    occurred = F.date_format(F.timestamp_seconds("at"), "yyyy-MM")
    late = F.months_between(F.to_date(F.concat("ledger", F.lit("-01"))), F.to_date(F.concat(occurred, F.lit("-01")))).cast("int")
    return events.groupBy("ledger", late.alias("months_late")).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame) -> DataFrame:
    """Events, first and last second and actors of each session."""
    return events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct(clean_key(F.col("actor"))).alias("n_actors"))
