"""What compaction removes, and the links it severs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.ids import clean_key, instant
from recordloom.operators.context import json_tags, withdrawn
from recordloom.operators.digests import write_receipt
from recordloom.session import delete_path, list_files, move_path, path_exists


def anchor_states(anchor_facts: DataFrame) -> DataFrame:
    """kind, target, dead, first_at, last_at of each anchor: its latest row tells its state (of ties, dead)."""
    f = anchor_facts.select(clean_key(F.col("kind")).alias("kind"), clean_key(F.col("target")).alias("target"), (clean_key(F.col("state")) == "dead").alias("dead"), "recorded_at").where(F.col("kind").isNotNull() & F.col("target").isNotNull())
    return f.groupBy("kind", "target").agg(F.max(F.struct("recorded_at", "dead")).alias("last"), F.min("recorded_at").alias("first_at")).select("kind", "target", F.coalesce("last.dead", F.lit(False)).alias("dead"), "first_at", F.col("last.recorded_at").alias("last_at"))


def native_plan(flagged: DataFrame) -> DataFrame:
    """id, reason of every record that goes: superseded, or revoked."""
    return flagged.where(F.col("superseded") | F.col("revoked")).select("id", F.when(F.col("superseded"), "superseded").otherwise("revoked").alias("reason"))


def rewritten(view: DataFrame, plan: DataFrame) -> DataFrame:
    """The records that stay; a link to a removed record becomes null and ``severed``."""
    removed = plan.select(F.col("id").alias("supersedes"), F.lit(True).alias("gone"))
    kept = view.join(plan.select("id"), "id", "left_anti")
    j = kept.join(removed, "supersedes", "left")
    gone = F.coalesce("gone", F.lit(False))
    return j.withColumn("severed", gone).withColumn("supersedes", F.when(gone, None).otherwise(F.col("supersedes"))).drop("gone")


def manifest_plan(flagged: DataFrame, anchors: DataFrame, at: str, expires_pointer: str | None = None, warning_days: int = 30) -> DataFrame:
    """id, remove, reason; the first that holds decides.

    superseded (goes), expired (goes) or, for ``warning_days`` after its expiry,
    expiry_warning_window (stays), dead_anchor (goes), active_anchor or unknown_anchor (stay) by its
    anchor tag, active_descendant (stays: its predecessor goes). Records no
    reason touches give no row.
    """
    tags = json_tags(F.col("tags"))
    text = F.get_json_object("payload", "$" + "".join(f"['{p}']" for p in expires_pointer.split("/")[1:])) if expires_pointer else F.regexp_replace(F.try_element_at(F.filter(tags, lambda t: t.startswith("expires:")), F.lit(1)), "^expires:", "")
    expires, now = instant(text), instant(F.lit(at))
    anchor = F.try_element_at(F.filter(tags, lambda t: F.lower(t).rlike("^anchor:(diff|trunk|ticket):")), F.lit(1))
    state = anchors.groupBy(F.concat_ws(":", "kind", "target").alias("anchor")).agg(F.max("dead").alias("dead"))
    gone = flagged.where("superseded").select(F.col("id").alias("supersedes"), F.lit(True).alias("parent_gone")).distinct()
    base = flagged.withColumn("anchor", F.lower(F.trim(anchor))).join(state, "anchor", "left").join(gone, "supersedes", "left")
    reason = (
        F.when(F.col("superseded"), "superseded").when(F.unix_seconds(expires) + warning_days * 86_400 <= F.unix_seconds(now), "expired").when(expires <= now, "expiry_warning_window").when(F.col("anchor").isNotNull() & F.col("dead"), "dead_anchor")
        .when(F.col("anchor").isNotNull() & F.col("dead").isNotNull(), "active_anchor").when(F.col("anchor").isNotNull(), "unknown_anchor").when(F.col("parent_gone"), "active_descendant")
    )
    return base.select("id", reason.isin("superseded", "expired", "dead_anchor").alias("remove"), reason.alias("reason")).where(F.col("reason").isNotNull())


def withdrawals(view: DataFrame) -> DataFrame:
    """id of records whose tags withdraw them."""
    return view.where(withdrawn(json_tags(F.col("tags")))).select("id")


def rewritten_lines(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """file, ordinal, line of JSONL sources (file, ordinal, line) after a plan (id, reason).

    Lines of removed records go; of the others only a link to a removed record
    is touched: its value becomes null. Everything else stays byte for byte, and
    so do lines that are no records.
    """
    named = lambda key: F.get_json_object("line", f"$.{key}")
    gone = plan.select("id").distinct()
    kept = lines.withColumn("_id", named("id")).join(gone.withColumnRenamed("id", "_id"), "_id", "left_anti")
    marked = kept.withColumn("_up", named("supersedes")).join(gone.select(F.col("id").alias("_up"), F.lit(True).alias("_cut")), "_up", "left")
    # The key at the top level: nested objects with the same key hold other values, so key and value are matched together, once.
    link = F.concat(F.lit('("supersedes"[ ]*:[ ]*)"'), F.regexp_replace("_up", r"([^A-Za-z0-9-])", r"\\$1"), F.lit('"'))
    return marked.select("file", "ordinal", F.when(F.col("_cut"), F.regexp_replace("line", link, F.lit("$1null"))).otherwise(F.col("line")).alias("line"))


class NotVerified(RuntimeError):
    """What was written does not hold what it should; the ledger in force stays."""


def publish(kept: DataFrame, path: str, receipt: dict | None = None) -> str:
    """Put the records that stay in force at ``path``; returns the digest of the receipt.

    They are written to a shadow folder, read back and compared by count and
    digest, and only then take the name ``current``; the ledger before it is
    kept as ``before-<digest>``. A run that dies leaves the old one in force, or
    (between the two moves) none under ``current`` and both whole: ``recover``.
    """
    spark = kept.sparkSession
    shadow = f"{path}/shadow-{uuid.uuid4().hex}"
    kept.write.parquet(shadow)
    figures = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*sorted(kept.columns))).alias("x")).first().asDict()
    want, got = figures(kept), figures(spark.read.schema(kept.schema).parquet(shadow))
    if want != got:
        delete_path(spark, shadow)
        raise NotVerified(f"{got} written for {want}")
    name = write_receipt(spark, f"{path}/receipts", (receipt or {}) | {"records": got["n"], "digest": got["x"]})
    if path_exists(spark, f"{path}/current"):
        move_path(spark, f"{path}/current", f"{path}/before-{name}")
    move_path(spark, shadow, f"{path}/current")
    return name


def recover(spark: SparkSession, path: str) -> str:
    """After an interrupted ``publish``: the newest ledger that was verified comes into force. Says what was done."""
    if path_exists(spark, f"{path}/current"):
        return "nothing to do"
    files = list_files(spark, path)
    folders = {f.rsplit("/", 2)[1]: max(v[1] for g, v in files.items() if g.rsplit("/", 2)[1] == f.rsplit("/", 2)[1]) for f in files}
    verified = [d for d in folders if d.startswith("before-")]
    shadows = [d for d in folders if d.startswith("shadow-") and path_exists(spark, f"{path}/{d}/_SUCCESS")]
    # The old ledger was moved away, so the shadow had been verified before.
    pick = max(shadows, key=folders.get) if verified and shadows else max(verified, key=folders.get) if verified else None
    if pick is None:
        raise NotVerified("there is no verified ledger")
    move_path(spark, f"{path}/{pick}", f"{path}/current")
    return f"{pick.split('-')[0]} put in force"
