"""Who may write what: drafts against grants, as a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"


def _covers(pattern: str, value: str) -> Column:
    return (F.col(pattern) == ANY) | F.col(pattern).eqNullSafe(F.col(value))


def _payload_fits() -> Column:
    """Every pointer of the grant leads to the text it names; a grant without pointers fits."""
    return F.expr(
        "forall(map_entries(coalesce(payload_equals, cast(map() as map<string,string>))), "
        "e -> get_json_object(payload, concat('$', regexp_replace(e.key, '/([^/]*)', \"['$1']\"))) <=> e.value)"
    )


def write_verdicts(drafts: DataFrame, grants: DataFrame, read_only: DataFrame) -> DataFrame:
    """id, verdict for drafts (id, actor, namespace, type_name, payload, parent_namespace, parent_type): read_only, refused or granted.

    ``read_only`` (actor) beats every grant and knows no wildcard. ``grants``:
    actor, namespace, type_name (``*`` covers all) and payload_equals (JSON
    pointer -> text, all must hold). One grant has to cover the record and, if
    it has one, its predecessor (parent columns null: none).
    """
    held = drafts.join(read_only.select("actor").distinct().withColumn("held", F.lit(True)), "actor", "left")
    g = grants.select(F.col("actor").alias("g_actor"), F.col("namespace").alias("g_namespace"), F.col("type_name").alias("g_type"), "payload_equals")
    each = drafts.withColumn("g_actor", F.explode(F.array("actor", F.lit(ANY)))).join(g, "g_actor")
    parent = F.col("parent_namespace").isNull() & F.col("parent_type").isNull() | _covers("g_namespace", "parent_namespace") & _covers("g_type", "parent_type")
    granted = each.where(_covers("g_namespace", "namespace") & _covers("g_type", "type_name") & parent & _payload_fits()).select("id").distinct().withColumn("granted", F.lit(True))
    verdict = F.when(F.col("held"), "read_only").when(F.col("granted"), "granted").otherwise("refused")
    return held.join(granted, "id", "left").select("id", verdict.alias("verdict"))
