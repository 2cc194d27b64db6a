"""References to records that do not exist (problem 3).

Method: Bloom filters of the parent keys (records, anchors, compacted records)
are built in one distributed pass each. A key the filter does not hold is proven
absent and needs no join; only filter-positive references go through the exact
joins, and the findings are aggregated per table and period.

A filter's size is set from the counted keys. Up to ``most_filter_bytes`` it is
broadcast. A larger one is never in one place: the hashes of the keys and of the
distinct references are brought together slice by slice, each task fills the
filter of its own slices and tests the references that belong there
(``absent_hashes``). Either way each reference is tested; the rows are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.arrow import strings
from recordloom.functions.ids import canonical_uuid, clean_key, instant_micros, predecessor_uuid, py_canonical_uuid, utc_month
from recordloom.functions.jsontext import NOTHING, allow_big_numbers, parse, unwrap
from recordloom.session import materialize

BITS_PER_KEY = 12
HASHES = 4
SLICES = 256
#: Largest filter that is broadcast, and keys a task takes of a larger one.
MOST_FILTER_BYTES = 64 * 2**20
KEYS_PER_TASK = 4_000_000
ANCHOR_KINDS = ("anchor:ticket", "anchor:diff", "anchor:trunk")
_TEXT = re.compile(r"\s*(record|anchor:ticket|anchor:diff|anchor:trunk)\s*:(.*)", re.S | re.I)


def key_hashes(keys: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for the same texts, as unsigned numbers."""
    return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in keys), np.uint64, len(keys))


class Bloom:
    """A Bloom filter in SLICES parts: a key's hash names its slice, and HASHES bits in it by double hashing.

    Each slice depends on its own keys only, so one task builds it alone.
    """

    def __init__(self, n_bits: int, bits: bytes | None = None) -> None:
        self.n_bits = n_bits
        self.bits = np.zeros(n_bits // 8, np.uint8) if bits is None else np.frombuffer(bits, np.uint8)

    @staticmethod
    def size_for(keys: int) -> int:
        return max(SLICES * 64, 1 << int(max(1, keys) * BITS_PER_KEY - 1).bit_length())

    def places(self, h: np.ndarray) -> np.ndarray:
        in_slice = np.uint64(self.n_bits // SLICES)
        a, b = h & np.uint64(0xFFFFFFFF), ((h >> np.uint64(24)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        inner = (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) & (in_slice - np.uint64(1))
        return (h >> np.uint64(56))[:, None] * in_slice + inner

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, h: np.ndarray) -> None:
        at = self.places(h).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def holds(self, keys: list[str]) -> np.ndarray:
        return self.has(key_hashes(keys))


def build_bloom(keys: DataFrame, count: int, most_bytes: int = MOST_FILTER_BYTES) -> Bloom | None:
    """Filter of the single text column of ``keys``; None if it would be too large to broadcast.

    Hashes (8 bytes a key) are shuffled to the tasks of their slices; the driver
    gets each byte of the filter once.
    """
    n_bits = Bloom.size_for(count)
    if n_bits // 8 > most_bytes:
        return None
    slice_bytes = n_bits // 8 // SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        shape = Bloom(n_bits, b"")
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for s in np.unique(h >> np.uint64(56)).tolist():
                part = shape.places(h[h >> np.uint64(56) == s]).ravel() - np.uint64(s * slice_bytes * 8)
                bits = held.setdefault(s, np.zeros(slice_bytes, np.uint8))
                np.bitwise_or.at(bits, (part >> np.uint64(3)).astype(np.int64), (1 << (part & np.uint64(7))).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["at", "bits"])

    name = keys.columns[0]
    hashes = keys.where(F.col(name).isNotNull()).select(F.xxhash64(name).alias("h"))
    raw = np.zeros(n_bits // 8, np.uint8)
    for at, bits in hashes.repartition(F.shiftrightunsigned("h", 56)).mapInArrow(build, "at long, bits binary").collect():
        raw[at * slice_bytes : (at + 1) * slice_bytes] = np.frombuffer(bits, np.uint8)
    return Bloom(n_bits, raw.tobytes())


def absent_hashes(keys: DataFrame, wanted: DataFrame, count: int, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """h of every hash in ``wanted`` (h) that the filter of the text column ``keys`` does not hold; for filters of any size.

    Both sides travel as hashes, the wanted ones distinct, so a key that a third
    of all rows refer to is tested once. Within a task the keys come first.
    """
    spark = keys.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // keys_per_task))
    n_bits = Bloom.size_for(-(-count // tasks) * 5 // 4)
    name = keys.columns[0]
    both = keys.where(F.col(name).isNotNull()).select(F.xxhash64(name).alias("h"), F.lit(False).alias("asked")).unionByName(wanted.select("h").distinct().withColumn("asked", F.lit(True)))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(n_bits)
        for b in batches:
            h, asked = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            own.add(h[~asked])
            h = h[asked]
            yield pa.RecordBatch.from_arrays([pa.array(h[~own.has(h)].view(np.int64))], ["h"])

    return both.repartition(tasks, F.shiftrightunsigned("h", 44)).sortWithinPartitions("asked").mapInArrow(test, "h long")


def evidence_references(value: Any) -> list[tuple[str, str]]:
    """(target_table, target_key) of an evidence column's value, each once."""
    if type(value) is dict:
        value = [value]
    if type(value) is not list:
        return []
    out: dict[tuple[str, str], None] = {}
    for e in value:
        e = unwrap(e)
        if type(e) is dict:
            kind, ref = e.get("kind"), e.get("reference")
            if type(kind) is not str or type(ref) is not str:
                continue
            kind = kind.strip().lower()
        elif type(e) is str:
            m = _TEXT.fullmatch(e)
            if m is None:
                continue
            kind, ref = m[1].lower(), m[2]
        else:
            continue
        ref = ref.strip()
        if not ref:
            continue
        if kind == "record":
            out["records", py_canonical_uuid(ref)] = None
        elif kind in ANCHOR_KINDS:
            out["anchor_facts", f"{kind}/{ref.lower()}"] = None
    return list(out)


def _extract(blooms: dict[str, Any]):
    """Task body: record_id, supersedes (canonical), evidence_json -> references with what the filters say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_big_numbers()
        filters = {k: b if isinstance(b, Bloom) or b is None else b.value for k, b in blooms.items()}
        for b in batches:
            rid, field, table, key = [], [], [], []
            for i, sup, ev in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if sup is not None:
                    rid.append(i), field.append("supersedes"), table.append("records"), key.append(sup)
                root = parse(ev)
                if root is not NOTHING:
                    for t, k in evidence_references(root):
                        rid.append(i), field.append("evidence_json"), table.append(t), key.append(k)
            maybe = np.ones(len(key), bool)
            gone = np.ones(len(key), bool)
            is_record = np.array([t == "records" for t in table], bool)
            for name, mask in (("records", is_record), ("anchor_facts", ~is_record)):
                if filters[name] is not None and mask.any():
                    maybe[mask] = filters[name].holds([k for k, m in zip(key, mask) if m])
            gone[~is_record] = False
            if filters["compacted_records"] is not None and is_record.any():
                gone[is_record] = filters["compacted_records"].holds([k for k, m in zip(key, is_record) if m])
            yield pa.RecordBatch.from_arrays([strings(rid), pa.array(field, pa.string()), pa.array(table, pa.string()), strings(key), pa.array(maybe), pa.array(gone)], ["record_id", "source_field", "target_table", "target_key", "maybe", "maybe_compacted"])

    return run


def _broadcast(spark: SparkSession, bloom: Bloom | None):
    return None if bloom is None else spark.sparkContext.broadcast(bloom)


def _test_apart(refs: DataFrame, name: str, keys: DataFrame, count: int) -> DataFrame:
    """``refs`` with what a filter too large to broadcast says of them."""
    refs = materialize(refs.withColumn("h", F.xxhash64("target_key")), "untested")
    table, flag = ("records", "maybe_compacted") if name == "compacted_records" else (name, "maybe")
    absent = absent_hashes(keys, refs.where(F.col("target_table") == table).select("h"), count).select("h", F.lit(True).alias("absent"))
    out = refs.join(absent.hint("merge"), "h", "left")
    return out.withColumn(flag, F.col(flag) & ~((F.col("target_table") == table) & F.col("absent").isNotNull())).drop("h", "absent")


def faulty_references(records: DataFrame, anchor_facts: DataFrame, compacted_records: DataFrame, most_filter_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """record_id, source_field, target_table, target_key, period, status; one row a fault.

    status: ``missing``, ``deleted`` or ``late``. Null or damaged evidence
    refers to nothing; null, blank and all-zero predecessors are none; a record
    delivered twice counts once; rows without id are left out. A late target
    needs both instants: an unreadable one is never late, and gives period
    null. Of equal latest anchor rows that disagree, dead wins. Tables may be
    empty and may hold further columns.
    """
    spark = records.sparkSession
    rows = records.select(canonical_uuid(F.col("id")).alias("record_id"), instant_micros(F.col("recorded_at")).alias("us"), predecessor_uuid(F.col("supersedes")).alias("sup"), "evidence_json").where(F.col("record_id").isNotNull())
    parents = materialize(rows.groupBy("record_id").agg(F.min("us").alias("us")), "parents")
    gone = materialize(compacted_records.select(canonical_uuid(F.col("record_id")).alias("target_key")).where(F.col("target_key").isNotNull()).distinct(), "compacted")
    facts = anchor_facts.select(F.concat_ws("/", clean_key(F.col("kind")), clean_key(F.col("target"))).alias("target_key"), clean_key(F.col("state")).alias("state"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("at"), F.col("kind").isNotNull() & F.col("target").isNotNull()).toDF("target_key", "state", "at", "ok")
    anchors = materialize(facts.where("ok").groupBy("target_key").agg(F.min("at").alias("first_us"), F.max(F.struct(F.coalesce("at", F.lit(-(2**62))).alias("at"), (F.col("state") == "dead").alias("dead"))).alias("last")).select("target_key", "first_us", F.coalesce("last.dead", F.lit(False)).alias("dead")), "anchors")
    sides = {"records": parents.select("record_id"), "anchor_facts": anchors.select("target_key"), "compacted_records": gone.select("target_key")}
    counts = {name: keys.count() for name, keys in sides.items()}
    blooms = {name: _broadcast(spark, build_bloom(keys, counts[name], most_filter_bytes)) for name, keys in sides.items()}
    refs = rows.select("record_id", "sup", "evidence_json").mapInArrow(_extract(blooms), "record_id string, source_field string, target_table string, target_key string, maybe boolean, maybe_compacted boolean")
    refs = refs.groupBy("record_id", "source_field", "target_table", "target_key").agg(F.max("maybe").alias("maybe"), F.max("maybe_compacted").alias("maybe_compacted"))
    for name, keys in sides.items():
        if blooms[name] is None:
            refs = _test_apart(refs, name, keys, counts[name])
    refs = materialize(refs.join(parents.withColumnRenamed("us", "own_us").hint("merge"), "record_id"), "references")
    definite = refs.where(~F.col("maybe"))
    to_records = refs.where(F.col("maybe") & (F.col("target_table") == "records"))
    to_anchors = refs.where(F.col("maybe") & (F.col("target_table") == "anchor_facts"))
    keys = ["record_id", "source_field", "target_table", "target_key", "own_us"]
    checked = to_records.join(parents.select(F.col("record_id").alias("target_key"), F.col("us").alias("first_us"), F.lit(True).alias("there")).hint("merge"), "target_key", "left")
    late = F.when(F.col("first_us") > F.col("own_us"), F.lit("late"))
    absent = checked.where(F.col("there").isNull()).select(*keys, "maybe_compacted").unionByName(definite.where(F.col("target_table") == "records").select(*keys, "maybe_compacted"))
    sure = absent.where(~F.col("maybe_compacted")).select(*keys, F.lit("missing").alias("status"))
    looked = absent.where(F.col("maybe_compacted")).join(gone.withColumn("compacted", F.lit(True)).hint("merge"), "target_key", "left").select(*keys, F.when(F.col("compacted"), F.lit("deleted")).otherwise(F.lit("missing")).alias("status"))
    held = to_anchors.join(anchors.withColumn("there", F.lit(True)).hint("merge"), "target_key", "left").select(*keys, F.when(F.col("there").isNull(), F.lit("missing")).when(F.col("dead"), F.lit("deleted")).otherwise(late).alias("status"))
    parts = [checked.where(F.col("there")).select(*keys, late.alias("status")), sure, looked, held, definite.where(F.col("target_table") == "anchor_facts").select(*keys, F.lit("missing").alias("status"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("status").isNotNull()).select("record_id", "source_field", "target_table", "target_key", utc_month(F.timestamp_micros(F.col("own_us"))).alias("period"), "status")


def fault_report(faults: DataFrame) -> DataFrame:
    """Faults per target table, field, period and status."""
    return faults.groupBy("target_table", "source_field", "period", "status").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("target_key").alias("n_targets"))
