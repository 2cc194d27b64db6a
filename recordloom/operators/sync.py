"""Embedding documents and the incremental plan that keeps an index level with the ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.arrow import strings
from recordloom.functions.jsonpath import leaves
from recordloom.functions.jsontext import NOTHING, allow_big_numbers, parse


def canonical_text(namespace: str, type_name: str, tags: list, payload: object) -> str:
    """A record's meaning as text: namespace, type, sorted tags, sorted payload leaves; no provenance."""
    head = [f"namespace {namespace}", f"type {type_name}"]
    return "".join(f"{line}\n" for line in [*head, *(f"tag {t}" for t in sorted({t for t in tags if isinstance(t, str)})), *(f"{p} {v}" for p, v in leaves(payload))])


def framed_query(instruction: str, query: str) -> str:
    """A query as models with instructions take it."""
    return f"Instruct: {instruction}\nQuery: {query}"


def room_for_query(instruction: str | None, most_chars: int) -> int:
    """Characters left for a query inside its frame; ValueError if there are none."""
    room = most_chars - (len(framed_query(instruction, "")) if instruction is not None else 0)
    if room < 1:
        raise ValueError("the instruction leaves no room for a query")
    return room


def documents(view: DataFrame, max_chars: int | None = None) -> DataFrame:
    """id, namespace, type_name, record_sha256, input_sha256, text, truncated; whole texts.

    ``max_chars`` is for models that take no more: texts are then cut before
    they are hashed, and ``truncated`` says which. Records without namespace or
    type cannot be embedded and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow_big_numbers()
        for b in batches:
            text, sha, cut = [], [], []
            for ns, t, tags, payload in zip(*(b.column(k).to_pylist() for k in (1, 2, 4, 5))):
                held, value = parse(tags), parse(payload)
                x = canonical_text(ns, t, held if isinstance(held, list) else [], None if value is NOTHING else value)
                cut.append(max_chars is not None and len(x) > max_chars)
                x = x[:max_chars]
                text.append(x)
                sha.append(hashlib.sha256(x.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sha, pa.string()), strings(text), pa.array(cut, pa.bool_())], ["id", "namespace", "type_name", "record_sha256", "input_sha256", "text", "truncated"])

    usable = view.where((F.trim("namespace") != "") & (F.trim("type_name") != ""))
    return usable.select("id", "namespace", "type_name", "record_sha256", "tags", "payload").mapInArrow(run, "id string, namespace string, type_name string, record_sha256 string, input_sha256 string, text string, truncated boolean")


def delta(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """id, action for id, record_sha256, input_sha256 on both sides.

    ``embed`` (new, or its text changed), ``relabel`` (only the record's digest
    changed), ``unchanged``, ``delete`` (indexed, but not in the corpus).
    """
    i = index.groupBy("id").agg(F.min("record_sha256").alias("r"), F.min("input_sha256").alias("t"), F.lit(True).alias("indexed"))
    j = corpus.select("id", "record_sha256", "input_sha256", F.lit(True).alias("wanted")).join(i, "id", "full_outer")
    action = F.when(F.col("wanted").isNull(), "delete").when(F.col("indexed").isNull() | ~F.col("input_sha256").eqNullSafe(F.col("t")), "embed").when(~F.col("record_sha256").eqNullSafe(F.col("r")), "relabel").otherwise("unchanged")
    return j.select("id", action.alias("action"))


def applied(index: DataFrame, plan: DataFrame, corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """The index after a plan of ``delta``: id, record_sha256, input_sha256, embedding.

    Deleted ids go, relabelled ones keep their vector under the new digest,
    embedded ones take theirs from ``vectors`` (id, embedding). To activate it,
    write it beside the old one and move it to its name (``session.move_path``).
    """
    todo = plan.select("id", "action")
    old = index.groupBy("id").agg(F.max(F.struct("record_sha256", "input_sha256", "embedding")).alias("i")).select("id", "i.*")
    new = corpus.select("id", F.col("record_sha256").alias("r"), F.col("input_sha256").alias("t"))
    stays = old.join(todo.where(F.col("action").isin("unchanged", "relabel")), "id").join(new, "id", "left").select("id", F.coalesce("r", "record_sha256").alias("record_sha256"), "input_sha256", "embedding")
    comes = new.join(todo.where(F.col("action") == "embed"), "id").join(vectors.select("id", "embedding"), "id").select("id", F.col("r").alias("record_sha256"), F.col("t").alias("input_sha256"), "embedding")
    return stays.unionByName(comes)


def hashed_embedding(texts: DataFrame, dimensions: int = 64, key: str = "id", column: str = "text") -> DataFrame:
    """A deterministic offline embedder: hashed words, signed, normalised. Replace it by any model with this signature."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = np.zeros((b.num_rows, dimensions), np.float32)
            for i, text in enumerate(b.column(1).to_pylist()):
                for w in (text or "").lower().split():
                    h = xxhash.xxh3_64_intdigest(w)
                    rows[i, h % dimensions] += 1 if h >> 63 else -1
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, norm, out=rows, where=norm > 0)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dimensions).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors], [key, "embedding"])

    return texts.select(key, column).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, embedding array<float>")
