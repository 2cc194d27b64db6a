"""Filling fixed-capacity containers with items (problem 6).

Method: large-item matching. At most two items above a third of the capacity
share a container, so those are matched greedily: the largest one left takes
the largest partner that still fits, which leaves as few large items alone as
any matching can. Smaller items then go, largest first, to the container with
the smallest gap that holds them (best fit); new containers open only when
none does.

Only sizes are needed for this, 24 bytes an item. They are spread over tasks
by hash, at most about ``ITEMS_PER_TASK`` each, and every task packs its own
share: the only loss against one global packing is the last open containers of
a task that holds hundreds of thousands of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tokens import VOCABULARY, count_tokens

ITEMS_PER_TASK = 500_000


class _Pool:
    """Multiset of values 0..top with "smallest at least" and "largest at most"."""

    def __init__(self, top: int) -> None:
        self.held: list[list[int]] = [[] for _ in range(top + 1)]
        self.mask = 0

    def put(self, value: int, item: int) -> None:
        if not self.held[value]:
            self.mask |= 1 << value
        self.held[value].append(item)

    def take(self, value: int) -> int:
        item = self.held[value].pop()
        if not self.held[value]:
            self.mask &= ~(1 << value)
        return item

    def least_from(self, value: int) -> int:
        up = self.mask >> value
        return value + (up & -up).bit_length() - 1 if up else -1

    def most_to(self, value: int) -> int:
        return (self.mask & ((1 << (value + 1)) - 1)).bit_length() - 1 if value >= 0 else -1


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes lie in 1..capacity."""
    n = len(sizes)
    box = np.full(n, -1, np.int64)
    order = np.lexsort((np.arange(n), -sizes))
    n_large = int((3 * sizes > capacity).sum())
    used = 0
    gaps = _Pool(capacity)
    large = _Pool(capacity)
    for i in order[:n_large][::-1].tolist():  # so that each size's next item in order lies on top
        large.put(int(sizes[i]), i)
    for i in order[:n_large].tolist():
        if box[i] >= 0:
            continue
        s = int(sizes[i])
        large.take(s)
        box[i] = used
        gap = capacity - s
        partner = large.most_to(gap)
        if partner > 0:
            j = large.take(partner)
            box[j] = used
            gap -= partner
        gaps.put(gap, used)
        used += 1
    for i in order[n_large:].tolist():
        s = int(sizes[i])
        gap = gaps.least_from(s)
        if gap < 0:
            b, gap = used, capacity
            used += 1
        else:
            b = gaps.take(gap)
        box[i] = b
        gaps.put(gap - s, b)
    return box


def _packer(capacity: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")]).combine_chunks()  # the same packing however the rows arrived
        sizes = t.column("n_tokens").to_numpy().astype(np.int64)
        place = TaskContext.get().partitionId()
        box = pack_sizes(sizes, capacity) * tasks + place
        for b in t.append_column("container_id", pa.array(box)).to_batches(max_chunksize=50_000):
            yield b

    return run


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, token_start, n_tokens: a document over the capacity is cut into full pieces and a rest."""
    n, cap = F.col("n_tokens"), F.lit(capacity).cast("long")
    last: Column = F.greatest(F.ceil(n / cap).cast("long") - 1, F.lit(0).cast("long"))
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * cap).alias("token_start"), F.least(cap, n - F.col("piece") * cap).alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int, items_per_task: int = ITEMS_PER_TASK, n_items: int | None = None) -> DataFrame:
    """doc_id, piece, token_start, n_tokens, container_id for sizes (doc_id, n_tokens).

    No container holds over ``capacity`` tokens; only a document larger than
    that is divided, at token positions. Documents without tokens (null or empty
    text, null size) are listed with container_id null: they take no room. An
    empty table gives no rows; documents may share a size or repeat.
    ``n_items`` saves a pass where the number of pieces is known.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    known = sizes.select("doc_id", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
    cut = pieces(known, capacity)
    items = cut.where(F.col("n_tokens") > 0)
    tasks = max(1, -(-(items.count() if n_items is None else n_items) // items_per_task))
    spread = items.coalesce(1) if tasks == 1 else items.repartition(tasks, F.xxhash64("doc_id", "piece", "n_tokens"))
    packed = spread.mapInArrow(_packer(capacity, tasks), "doc_id long, piece long, token_start long, n_tokens long, container_id long")
    return packed.unionByName(cut.where(F.col("n_tokens") <= 0).withColumn("container_id", F.lit(None).cast("long")))


def profiles_in_force(profile_budgets: DataFrame) -> list[tuple[str, int, int]]:
    """(profile_id, version, total_tokens) of each profile's highest version; a small fixed table."""
    top = profile_budgets.where(F.col("profile_id").isNotNull()).groupBy("profile_id").agg(F.max(F.struct("version", "total_tokens")).alias("v"))
    return [(r[0], r[1], r[2]) for r in top.select("profile_id", "v.version", "v.total_tokens").where(F.col("total_tokens") > 0).orderBy("profile_id").collect()]


def pack_profiles(documents: DataFrame, profile_budgets: DataFrame, vocabulary: str = VOCABULARY, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """The packing of all documents for every profile in force; texts are tokenized once."""
    sizes = count_tokens(documents, ["doc_id"], vocabulary)
    out: DataFrame | None = None
    profiles = profiles_in_force(profile_budgets)
    n_pieces = sizes.agg(F.lit(0).alias("none"), *[F.coalesce(F.sum(F.ceil(F.col("n_tokens") / c)), F.lit(0)).cast("long") for _, _, c in profiles]).first()  # one row
    for k, (name, version, capacity) in enumerate(profiles, 1):
        one = pack(sizes, capacity, items_per_task, n_pieces[k]).select(F.lit(name).alias("profile_id"), F.lit(version).cast("int").alias("version"), F.lit(capacity).cast("long").alias("capacity"), "container_id", "doc_id", "piece", "token_start", "n_tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no profile has a capacity")
    return out


def packing_report(packed: DataFrame) -> DataFrame:
    """For each profile: containers, tokens, unused tokens and share, and the least number of containers possible."""
    per = packed.groupBy("profile_id", "version", "capacity").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    unused = F.col("containers") * F.col("capacity") - F.col("tokens")
    return per.select("*", unused.alias("unused_tokens"), (unused / (F.col("containers") * F.col("capacity"))).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))


def packing_checks(packed: DataFrame) -> DataFrame:
    """For each profile: documents, and rows of fault: containers over capacity, documents with a gap or overlap, divided though they fit, and containers beyond a thousandth over the least number (1 allowed)."""
    loads = packed.where(F.col("container_id").isNotNull()).groupBy("profile_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("load"))
    boxes = loads.groupBy("profile_id", "capacity").agg(F.count_if(F.col("load") > F.col("capacity")).alias("n_overfull"), F.count(F.lit(1)).alias("used"), F.sum("load").alias("tokens"))
    docs = packed.groupBy("profile_id", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count_distinct("piece").alias("different"), F.max("piece").alias("last"))
    whole = (F.col("n") == F.col("end")) & (F.col("different") == F.col("pieces")) & (F.col("last") == F.col("pieces") - 1)
    per = docs.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(~whole).alias("n_broken"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_divided"))
    spare = F.col("used") - F.ceil(F.col("tokens") / F.col("capacity")) * 1.001 - 1
    too_many = F.when(spare > 0, F.ceil(spare)).otherwise(0).cast("long").alias("n_too_many")
    return per.join(boxes, "profile_id", "left").select("profile_id", "n_documents", F.coalesce("n_overfull", F.lit(0)).cast("long").alias("n_overfull"), "n_broken", "n_divided", F.coalesce(too_many, F.lit(0)).cast("long").alias("n_too_many"))
