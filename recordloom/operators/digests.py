"""Digests over ordered rows, without holding the rows anywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import put_text


def _ordered_parts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The values in key order, packed into blobs of about a megabyte: part, seq, blob."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array(["".join(held)])], ["part", "seq", "blob"])

        for b in batches:
            for v in b.column(0).to_pylist():
                held.append(v or "")
                size += len(held[-1])
                if size > 1 << 20:
                    yield out()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield out()

    return rows.orderBy(key).select(value).mapInArrow(pack, "part long, seq long, blob string")


def corpus_digest(rows: DataFrame, key: str = "id", value: str = "record_sha256") -> str:
    """sha256 of all values joined in key order.

    A digest of a concatenation can only be computed front to back. The sort is
    distributed; the driver takes one blob of about a megabyte at a time and
    keeps nothing but the running hash.
    """
    h = hashlib.sha256()
    for r in _ordered_parts(rows, key, value).toLocalIterator():
        h.update(r["blob"].encode())
    return h.hexdigest()


def prefix_digest(rows: DataFrame, n: int, key: str = "id", value: str = "record_sha256") -> str:
    """The corpus digest of the first n rows in key order: shows whether a corpus only grew."""
    return corpus_digest(rows.orderBy(key).limit(n), key, value)


def shard_digests(rows: DataFrame, shard: str, key: str = "id", value: str = "record_sha256") -> DataFrame:
    """An order-free digest for each shard: rows, and sum and xor of a hash of key and value."""
    h = F.xxhash64(key, value)
    return rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("sum"), F.bit_xor(h).alias("xor"))


def fingerprint(names: Column) -> Column:
    """Sorted, deduplicated, newline-joined sha256 of an array; null when it is empty."""
    return F.when(F.size(names) > 0, F.sha2(F.array_join(F.array_sort(F.array_distinct(names)), "\n"), 256))


def chain(lines: Column) -> Column:
    """h = sha256(h + line) over an ordered array, from the empty text."""
    return F.aggregate(lines, F.lit("").cast("string"), lambda acc, x: F.sha2(F.concat(acc, x), 256))


def set_digest(manifest_sha256: str, inputs: list[str]) -> str:
    """sha256 of a manifest's digest followed by each input's, in order, parted by NUL."""
    return hashlib.sha256("\0".join([manifest_sha256, *inputs]).encode()).hexdigest()


def write_receipt(spark: SparkSession, folder: str, body: dict) -> str:
    """Write a receipt under its own digest; the same body gives the same file, written once. Returns the digest."""
    import json

    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    name = hashlib.sha256(text.encode()).hexdigest()
    put_text(spark, f"{folder}/{name}.json", text)
    return name
