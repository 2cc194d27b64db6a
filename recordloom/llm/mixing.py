"""Mixing sources to target weights (problem 7).

Method: Pfair scheduling. Each source's stream of documents is cut into blocks
of equal size; block k of a source with weight w is released at k/w and due at
(k+1)/w. Earliest deadline first among the released blocks then interleaves
all sources so that after any number of slots no source is a whole block ahead
of or behind its weight.

A block holds about BLOCK_DOCUMENTS documents, however large the mix. With
whole numbers of blocks the schedule is periodic: one period of at most about
PERIOD slots is scheduled on the driver, block k of a source with p blocks a
period then gets slot (k // p) * period + the slot of its place in the period,
by formula. At the end of a period every source is exactly level.

The size of the mix is the largest at which every source can give its share
within its repeats. Documents get their place in the source's stream by a
two-level prefix sum (hash buckets, then within a bucket), so a source with a
third of all rows is never in one task. The driver sees one row for each
source and one period of blocks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import clean_key
from recordloom.llm.tokens import VOCABULARY, count_tokens
from recordloom.session import materialize

#: Slots of a period: the resolution of the weights.
PERIOD = 4_096
BLOCK_DOCUMENTS = 2
DOCS_PER_BUCKET = 100_000


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) for each slot: earliest deadline first within Pfair windows, in whole numbers."""
    slots = sum(blocks.values())
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * slots // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * slots // blocks[s], s, k + 1))
    return out


def period(quota: dict[str, int], n_blocks: int, most_slots: int = PERIOD) -> tuple[dict[str, int], int]:
    """(blocks of each source in a period, periods) for about ``n_blocks`` blocks over all sources."""
    size = sum(quota.values())
    slots = max(1, min(most_slots, n_blocks))
    return {s: max(1, round(q * slots / size)) for s, q in quota.items()} if size else {}, max(1, round(n_blocks / slots))


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int | None]]) -> dict[str, int]:
    """Tokens each source is to give: weights of the sources at hand, scaled to the largest mix their repeats allow."""
    able = {s: targets[s][0] for s in totals if totals[s] > 0 and s in targets and targets[s][0] > 0 and (targets[s][1] is None or targets[s][1] > 0)}
    whole = sum(able.values())
    if not able:
        return {}
    limits = [targets[s][1] * totals[s] * whole / w for s, w in able.items() if targets[s][1] is not None]
    size = min(limits) if limits else float(sum(totals[s] for s in able))
    return {s: min(round(size * w / whole), totals[s] * (targets[s][1] or 2**62)) for s, w in able.items()}


def clean_targets(source_targets: DataFrame) -> dict[str, tuple[float, int | None]]:
    """The fixed table of goals as a dictionary; of repeated sources the largest row counts."""
    rows = source_targets.select(clean_key(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("long").alias("r")).where("s is not null and w is not null")
    return {r[0]: (r[1], r[2]) for r in rows.orderBy("s", "w", "r").collect()}


def _placed(docs: DataFrame, count: int) -> DataFrame:
    """docs (source, doc_id, n_tokens) with ``before``: tokens of the source's documents ahead of this one."""
    buckets = max(16, -(-count // DOCS_PER_BUCKET))
    docs = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("base"))
    within = docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return within.join(offsets.hint("merge"), ["source", "bucket"]).select("source", "doc_id", "n_tokens", (F.col("base") + F.col("inner")).alias("before"))


def mix(documents: DataFrame, source_targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """slot, source, use_no, doc_id, n_tokens, source_position, target_share, block, weight, actual_share; one row for each use.


    Ordered by (slot, source_position) the rows are the mixed stream.
    Sources are compared without case and outer blanks. Documents without
    tokens or source, and sources without a target, are not used; a target
    without documents cannot be met, the others then keep their proportions.
    Every document of a source is used the same number of times or once more,
    never over ``max_repeats`` (null: no limit). An empty table gives no rows.
    """
    spark = documents.sparkSession
    goals = clean_targets(source_targets)
    sized = count_tokens(documents.select("doc_id", "text", clean_key(F.col("source")).alias("source")), ["doc_id", "source"], vocabulary)
    usable = sized.where((F.col("n_tokens") > 0) & F.col("source").isin(sorted(goals))) if goals else sized.limit(0)
    figures = {r[0]: (r[1], r[2]) for r in usable.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}  # at most one row a goal
    quota = plan({s: f[0] for s, f in figures.items()}, goals)
    docs = sum(f[1] for f in figures.values())
    size = sum(quota.values())
    mean = max(1, sum(f[0] for f in figures.values()) // max(1, docs))
    blocks, periods = period(quota, size // (BLOCK_DOCUMENTS * mean))
    slots_a_period = sum(blocks.values())
    goal_rows = [(s, goals[s][0], figures[s][0], q // figures[s][0], q % figures[s][0], q, blocks[s], blocks[s] * periods) for s, q in sorted(quota.items())]
    goal_df = spark.createDataFrame(goal_rows, "source string, target_share double, total long, full long, rest long, quota long, a_period long, blocks long")
    stream = materialize(_placed(usable.select("source", "doc_id", "n_tokens"), docs).join(F.broadcast(goal_df), "source"), "streams")
    # The last, partial pass takes documents while they fit; one more, the nearest in size to what is then left, closes the gap.
    fits = F.col("before") + F.col("n_tokens") <= F.col("rest")
    reached = stream.where(fits).groupBy("source").agg(F.max(F.col("before") + F.col("n_tokens")).alias("reached"))
    gap = stream.where(~fits).join(F.broadcast(reached), "source", "left").withColumn("gap", F.col("rest") - F.coalesce("reached", F.lit(0))).where(F.col("gap") > 0)
    off = F.abs(F.col("n_tokens") - F.col("gap"))
    last = gap.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("doc_id").alias("d"), "gap")).alias("l")).select("source", F.col("l.d").alias("last_doc"), F.col("l.gap").alias("gap"))
    uses = stream.join(F.broadcast(last), "source", "left")
    is_last = F.coalesce(F.col("doc_id") == F.col("last_doc"), F.lit(False)) & ~fits
    n_uses = F.col("full") + F.when(fits | is_last, 1).otherwise(0)
    each = uses.where(n_uses > 0).withColumn("use_no", F.explode(F.sequence(F.lit(1).cast("long"), n_uses)))
    at = F.when((F.col("use_no") > F.col("full")) & is_last, F.col("full") * F.col("total") + F.col("rest") - F.col("gap")).otherwise((F.col("use_no") - 1) * F.col("total") + F.col("before"))
    each = each.withColumn("source_position", at).withColumn("block", F.least(F.floor(F.col("source_position") * F.col("blocks") / F.col("quota")).cast("long"), F.col("blocks") - 1))
    slots = spark.createDataFrame([(s, k, t) for t, (s, k) in enumerate(pfair(blocks))], "source string, place long, at long")  # one period
    each = each.withColumn("place", F.col("block") % F.col("a_period")).join(F.broadcast(slots), ["source", "place"])
    slot = F.floor(F.col("block") / F.col("a_period")).cast("long") * slots_a_period + F.col("at")
    out = materialize(each.select(slot.alias("slot"), "source", "use_no", "doc_id", "n_tokens", "source_position", "target_share", "block", (F.col("a_period") / max(1, slots_a_period)).alias("weight")), "mix")
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("got"))
    shares = got.select("source", (F.col("got") / F.sum("got").over(Window.partitionBy())).alias("actual_share"))  # one row a source
    return out.join(F.broadcast(shares), "source").select("slot", "source", "use_no", "doc_id", "n_tokens", "source_position", "target_share", "block", "weight", "actual_share")


def block_deviation(mixed: DataFrame) -> DataFrame:
    """source, ahead, behind: the most blocks a source was ahead of or behind its weight, right after and right before its own slots.

    In between a source only falls behind, so these are the extremes: block k
    in slot t leaves k + 1 blocks done where (t + 1) w are due, and found k done
    where t w were due.
    """
    w = F.col("weight")
    b = mixed.select("source", "block", "slot", w).distinct()
    return b.groupBy("source").agg(F.max(F.col("block") + 1 - (F.col("slot") + 1) * w).alias("ahead"), F.max(F.col("slot") * w - F.col("block")).alias("behind"))


def share_report(mixed: DataFrame, source_targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, actual_share, n_tokens, n_documents, n_uses, most_uses; targets without documents too."""
    goals = clean_targets(source_targets)
    spark = mixed.sparkSession
    want = spark.createDataFrame([(s, w, r) for s, (w, r) in sorted(goals.items())], "source string, target_share double, max_repeats long")
    got = mixed.groupBy("source").agg(F.max("actual_share").alias("actual_share"), F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_uses"), F.max("use_no").alias("most_uses"))
    zero = F.lit(0).cast("long")
    return want.join(got, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, zero).alias(c) for c in ("n_tokens", "n_documents", "n_uses", "most_uses")])


def mix_checks(mixed: DataFrame, source_targets: DataFrame) -> DataFrame:
    """For each source with a target: rows of fault: documents used too often or with gaps in their numbering, a deviation of a whole block, a share off its target (among the sources in the mix) by more than a thousandth and two documents."""
    want = mixed.sparkSession.createDataFrame([(s, w, r) for s, (w, r) in sorted(clean_targets(source_targets).items())], "source string, target_share double, max_repeats long")
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("use_no").alias("last")).join(F.broadcast(want), "source")
    over = uses.groupBy("source").agg(F.count_if((F.col("n") > F.coalesce("max_repeats", F.col("n"))) | (F.col("n") != F.col("last"))).alias("n_overused"))
    off = block_deviation(mixed).select("source", ((F.col("ahead") >= 1) | (F.col("behind") >= 1)).cast("long").alias("n_blocks_off"))
    share = mixed.groupBy("source").agg(F.max("actual_share").alias("actual_share"), F.sum("n_tokens").alias("got"), F.max("n_tokens").alias("largest")).join(F.broadcast(want), "source")
    every = Window.partitionBy()  # one row a source
    even = share.withColumn("due", F.col("target_share") / F.sum("target_share").over(every)).withColumn("slack", 0.001 + 2 * F.max("largest").over(every) / F.sum("got").over(every))
    shares = even.select("source", (F.abs(F.col("actual_share") - F.col("due")) > F.col("slack")).cast("long").alias("n_shares_off"))
    zero = F.lit(0).cast("long")
    j = want.join(over, "source", "left").join(off, "source", "left").join(shares, "source", "left")
    return j.select("source", "target_share", *[F.coalesce(c, zero).alias(c) for c in ("n_overused", "n_blocks_off", "n_shares_off")])
