"""Token counts with the vocabulary of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import materialize

#: Where the vocabulary lies; the environment may name another place.
VOCABULARY = os.environ.get("RECORDLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the split pattern that belongs to the rank files of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark: SparkSession, vocabulary: str) -> None:
    """Give every executor the vocabulary file, which only the driver need have."""
    spark.sparkContext.addFile(vocabulary)


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken
    from pyspark import SparkFiles

    here = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
    with open(here, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and n_tokens (long; 0 for null or empty text), as a written table.

    Whole texts are encoded; nothing but the counts leaves the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            counts = [0 if t is None else len(encode(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    ship(documents.sparkSession, vocabulary)
    source = documents.select(F.col("text").alias("__text"), *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + ["n_tokens long"])
    return materialize(source.mapInArrow(run, schema), "tokens")
