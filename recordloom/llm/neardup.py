"""Near-duplicate records with small edits (problem 1).

Method: segment-popcount embedding, grid range-join under the Manhattan distance, exact check.

* A payload's fingerprint has one bit for each distinct word, at the place its
  64-bit hash names. Cut into equal segments, the bits of each are counted: the
  embedding. Halving the segments gives the embedding at the next level, down
  to a single segment, the set's size. At every level counts differ by no more
  than the sets do: L1(A, B) <= |A ^ B|, so the distance is a lower bound.
* Grid: the axes are namespace and type, the size (one segment, cells growing
  by 10/7, so that the radius reaches the next cell and no further: a range
  join on two neighbouring cells) and the occupied places of the finest level
  (2**PLACE_BITS segments). A record is put at only as many places, those of
  the least populated segments first, as it may differ in at most, plus one:
  two records within the radius must then share a place. The cell is hence a
  prefix filter in popcount space. Sums over a few large segments would be the
  plainer axes, but the radius (up to 0.6 n) exceeds their spread (about the
  square root of n) at every size, so they part nothing.
* Pairs that meet are held against the bound twice: at 64 segments, carried in
  the grid row (32 bytes), and for sets of over about 100 words at a level that
  grows with the size cell (``level``), so that counters never fill up.
* What is left is verified on the whole word sets, exactly.

Records with equal word sets are one class; only one of them is joined.
Populated segments end up last in every order, so no cell grows with a frequent
word; what remains uneven is split by AQE's skew join. No bucket is capped.
Every join of growing sides is a sort-merge join by hint: Spark cannot price
what ``mapInArrow`` gives out, and must not broadcast it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.arrow import strings
from recordloom.functions.ids import canonical_uuid
from recordloom.functions.jsontext import NOTHING, allow_big_numbers, parse, unwrap
from recordloom.session import materialize, spread

#: Overlap in percent, and the same as a fraction for whole-number arithmetic.
OVERLAP = 70
#: Segments whose population is counted over all records, to tell rare places from frequent ones; bounds the broadcast (8 bytes each).
COUNT_BITS = 18
SEGMENTS = 1 << COUNT_BITS
#: Finest level of the embedding: a grid place is one of so many segments.
PLACE_BITS = 40
#: Segments of the code in each grid row, and the highest count a thermometer code can show.
COARSE, LEVELS = 64, 4
#: Default of ``copies_in_full``.
COPIES_IN_FULL = 100
_EDGE = regex.compile(r"^[^\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}]+$")
_SIGN = np.uint64(1 << 63)


def text_values(value: Any, out: list[str]) -> list[str]:
    """All strings of a JSON value at any depth; strings that stand for JSON are opened."""
    todo = [value]
    while todo:
        v = todo.pop()
        t = type(v)
        if t is str:
            w = unwrap(v)
            if type(w) is str:
                out.append(w)
            else:
                todo.append(w)
        elif t is dict:
            todo.extend(v.values())
        elif t is list:
            todo.extend(v)
    return out


def open_up(root: Any) -> None:
    """Strings that stand for JSON become, in place, what they stand for."""
    todo = [root]
    while todo:
        v = todo.pop()
        for k, x in v.items() if type(v) is dict else enumerate(v) if type(v) is list else ():
            if type(x) is str:
                w = unwrap(x)
                if type(w) is str:
                    continue
                v[k] = x = w
            if type(x) is dict or type(x) is list:
                todo.append(x)


def canonical(root: Any) -> str:
    """One text for each opened JSON value: sorted keys, no spaces, everything escaped the same way."""
    try:
        return json.dumps(root, sort_keys=True, separators=(",", ":"))
    except RecursionError:  # nesting the C encoder refuses: the same text without recursion
        out: list[str] = []
        todo: list[tuple[bool, Any]] = [(False, root)]
        while todo:
            raw, v = todo.pop()
            if raw:
                out.append(v)
            elif type(v) is dict:
                todo.append((True, "}"))
                for i, k in reversed(list(enumerate(sorted(v)))):
                    todo += [(False, v[k]), (True, ("," if i else "") + json.dumps(k) + ":")]
                out.append("{")
            elif type(v) is list:
                todo.append((True, "]"))
                for i in range(len(v) - 1, -1, -1):
                    todo += [(False, v[i]), (True, "," if i else "")]
                out.append("[")
            else:
                out.append(json.dumps(v))
        return "".join(out)


def word(raw: str) -> str | None:
    w = _EDGE.sub("", raw).lower()
    return w if len(w.encode("utf-8", "surrogatepass")) > 2 else None


def need(n: Any) -> Any:
    """Shared words that an overlap of OVERLAP % of n takes: the least s with 100 s >= OVERLAP n."""
    return -(-n * OVERLAP // 100)


def size_cells(most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size cells; no set reaches past the next cell at this overlap."""
    b = [1]
    while b[-1] < most:
        b.append(b[-1] * 100 // OVERLAP + 1)
    return np.array(b, np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    allow_big_numbers()
    cache: dict[str, int | None] = {}
    for b in batches:
        for start in range(0, b.num_rows, 2048):
            part = b.slice(start, 2048)
            offsets, flat, digests, texts, keep = [0], [], [], [], []
            for row, text in enumerate(part.column(2).to_pylist()):
                root = parse(text)
                if root is NOTHING:
                    continue
                open_up(root)
                found = set()
                for raw in set(" ".join(text_values(root, [])).split()):
                    if raw in cache:
                        h = cache[raw]
                    else:
                        w = word(raw)
                        h = None if w is None else xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63)
                        if len(cache) > 500_000:
                            cache.clear()
                        cache[raw] = h
                    if h is not None:
                        found.add(h)
                if found:
                    arr = np.fromiter(found, np.int64, len(found))
                    arr.sort()
                    flat.append(arr)
                    offsets.append(offsets[-1] + len(arr))
                    digests.append(xxhash.xxh3_128_digest(arr.tobytes()))
                    texts.append(xxhash.xxh3_128_digest(canonical(root).encode()))
                    keep.append(row)
            if keep:
                at = pa.array(keep)
                words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat)))
                n = pa.array(np.diff(offsets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(digests, pa.binary()), pa.array(texts, pa.binary()), n, words], ["id", "scope", "digest", "text", "n", "words"])


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SEGMENTS, np.int64)
    for b in batches:
        if b.num_rows:
            h = b.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=SEGMENTS)
    cut = SEGMENTS // 256
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array([total[i * cut : (i + 1) * cut].tobytes() for i in range(256)], pa.binary())], ["at", "counts"])


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(raw, np.int64)
            held[at] = held[at] + x if at in held else x
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["at", "counts"])


def segment_counts(words: DataFrame) -> np.ndarray:
    """Population count of every fine segment over all records: SEGMENTS numbers, whatever the input."""
    parts = words.mapInArrow(_local_counts, "at int, counts binary").repartition("at").mapInArrow(_merge_counts, "at int, counts binary")
    total = np.zeros(SEGMENTS, np.int64)
    cut = SEGMENTS // 256
    for at, raw in parts.collect():
        total[at * cut : (at + 1) * cut] = np.frombuffer(raw, np.int64)
    return total


def level(cell: Any) -> Any:
    """Segments of the embedding pairs of a size cell are held against: at least one a word, so that counts stay small."""
    most = size_cells()[np.asarray(cell) + 1] - 1
    return np.where(most <= 2 * COARSE, COARSE, 1 << np.ceil(np.log2(most)).astype(np.int64))


def first_deep() -> tuple[int, int]:
    """The first size cell whose level is above COARSE, and the smallest set that probes it."""
    cell = int(np.argmax(level(np.arange(60)) > COARSE))
    return cell, int(size_cells()[cell - 1])


def embed(sets: list[np.ndarray], segments: int = COARSE) -> np.ndarray:
    """Thermometer codes of the population counts: a 64-bit word for each 16 segments."""
    rec = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return _codes(rec, np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64), len(sets), segments)


def _codes(rec: np.ndarray, h: np.ndarray, n: int, segments: int = COARSE) -> np.ndarray:
    at = (h >> np.uint64(65 - segments.bit_length())).astype(np.int64)
    counts = np.bincount(rec * segments + at, minlength=n * segments).reshape(n, segments)
    code = (np.uint64(1) << np.minimum(counts, LEVELS).astype(np.uint64)) - np.uint64(1)
    code = code.reshape(n, segments // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(LEVELS))
    return np.bitwise_or.reduce(code, axis=2).view(np.int64)


def _deep_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: c, n, words -> c, n, cell, the codes at the level of the own size cell and of the next."""
    bounds = size_cells()
    for b in batches:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            cell = np.searchsorted(bounds, part.column(1).to_numpy(), side="right") - 1
            sets = [x.values.to_numpy() for x in part.column(2)]
            levels = [[int(x) for x in level(cell + step)] for step in (0, 1)]
            codes = [pa.array([embed([w], k)[0] for w, k in zip(sets, ks)], pa.list_(pa.int64())) for ks in levels]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), *codes], ["c", "n", "cell", "own", "next"])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One well-mixed 64-bit number of two."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _grid(counts: Any):
    """Task body: c, scope_key, n, words -> a row for each cell the class occupies or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = counts if isinstance(counts, np.ndarray) else counts.value
        bounds = size_cells()
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                m = part.num_rows
                n = part.column(2).to_numpy().astype(np.int64)
                h = part.column(3).flatten().to_numpy().view(np.uint64)
                rec = np.repeat(np.arange(m), n)
                fp = _codes(rec, h, m)
                seg = h >> np.uint64(64 - PLACE_BITS)
                order = np.lexsort((seg, rarity[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], rec))
                seg, rec = seg[order], rec[order]
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                place = np.arange(len(seg)) - first[rec]
                cell = np.searchsorted(bounds, n, side="right") - 1
                own = n - need(n) + 1
                ahead = n - need(bounds[cell + 1]) + 1
                scope = part.column(1).to_numpy().view(np.uint64)
                for step, reach in ((0, own), (1, ahead)):
                    take = place < reach[rec]
                    r, w = rec[take], seg[take]
                    if not len(r):
                        continue
                    grid = _mix(_mix(scope[r], (cell[r] + step).astype(np.uint64)), w).view(np.int64)
                    # One number for size, own cell and probed cell: the grid's rows are what is shuffled.
                    shape = (n[r] << 16) | (cell[r] << 8) | (cell[r] + step)
                    yield pa.RecordBatch.from_arrays([pa.array(grid), part.column(0).take(pa.array(r)), pa.array(shape), *[pa.array(fp[r, k]) for k in range(4)]], ["grid", "c", "shape", "f0", "f1", "f2", "f3"])

    return run


def word_sets(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): classes c, scope_key, n, words of equal word sets; members record_id, c, text (the payload's digest)."""
    source = records.where(F.col("namespace").isNotNull() & F.col("type_name").isNotNull()).select(canonical_uuid(F.col("id")).alias("id"), F.to_json(F.struct("namespace", "type_name")).alias("scope"), "payload_json").where(F.col("id").isNotNull())
    rows = materialize(source.mapInArrow(_fingerprints, "id string, scope string, digest binary, text binary, n int, words array<long>"), "fingerprints")
    members = rows.groupBy("id").agg(F.max(F.struct("n", "scope", "digest", "text")).alias("m")).select(F.col("id").alias("record_id"), "m.scope", "m.digest", "m.text")
    classes = rows.groupBy("scope", "digest").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), F.xxhash64("scope").alias("scope_key"), "n", "words", "scope", "digest"), "classes")
    members = materialize(members.join(classes.select("scope", "digest", "c").hint("merge"), ["scope", "digest"]).select("record_id", "c", "text"), "members")
    return classes, members


def within_bound(met: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of ``met`` (a, b, cell of b) whose embeddings at the level of their size are no farther apart than their overlap allows."""
    cell, least = first_deep()
    codes = classes.where(F.col("n") >= least).select("c", "n", "words").mapInArrow(_deep_codes, "c long, n int, cell int, own array<long>, next array<long>")
    codes = materialize(codes, "codes")
    x = codes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("cell").alias("ca"), F.col("own").alias("oa"), F.col("next").alias("xa"))
    y = codes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"))
    both = met.where(F.col("cell") >= cell).join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    code = F.when(F.col("ca") == F.col("cell"), F.col("oa")).otherwise(F.col("xa"))
    apart = F.aggregate(F.zip_with(code, F.col("ob"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    near = both.where(apart <= F.col("na") + F.col("nb") - 2 * F.ceil(F.col("nb") * OVERLAP / 100))
    return met.where(F.col("cell") < cell).select("a", "b").unionByName(near.select("a", "b"))


def class_links(classes: DataFrame) -> DataFrame:
    """a, b, overlap: all pairs of classes of one scope with an overlap of OVERLAP or more, each once."""
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(segment_counts(classes.select("words")))
    n_places = classes.agg(F.sum("n")).first()[0] or 0
    cells = classes.select("c", "scope_key", "n", "words").mapInArrow(_grid(counts), "grid long, c long, shape long, f0 long, f1 long, f2 long, f3 long")
    cells = spread(cells, n_places, "grid")  # a record is put at fewer places than it has words
    x, y = cells.alias("x"), cells.alias("y")
    size = lambda side: F.shiftright(f"{side}.shape", 16)
    cell = lambda side: F.shiftright(f"{side}.shape", 8).bitwiseAND(F.lit(255))
    probe = lambda side: F.col(f"{side}.shape").bitwiseAND(F.lit(255))
    apart = F.bit_count(F.col("x.f0").bitwiseXOR(F.col("y.f0")))
    for k in ("f1", "f2", "f3"):
        apart = apart + F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}")))
    least = F.ceil(size("y") * OVERLAP / 100)
    # y is met in its own cell (cell >= probe), x in its own or the next; x is the smaller set. Both sides read the same columns and share one shuffle.
    close = (
        (F.col("x.grid") == F.col("y.grid")) & (cell("y") >= probe("x")) & ((size("x") < size("y")) | ((size("x") == size("y")) & (F.col("x.c") < F.col("y.c"))))
        & (size("x") >= least) & (apart <= size("x") + size("y") - 2 * least)
    )
    met = materialize(x.join(y.hint("merge"), close).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), cell("y").cast("int").alias("cell")).distinct(), "met")
    left = classes.select(F.col("c").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na"), F.col("scope").alias("sa"))
    right = classes.select(F.col("c").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb"), F.col("scope").alias("sb"))
    both = within_bound(met, classes).join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.col("sa") == F.col("sb"))
    overlap = F.floor(F.size(F.array_intersect("wa", "wb")) * 100 / F.greatest("na", "nb")).cast("int")
    return both.select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= OVERLAP)


def near_duplicate_pairs(records: DataFrame, copies_in_full: int | None = COPIES_IN_FULL) -> DataFrame:
    """record_a, record_b, overlap: records of one namespace and type with an overlap of 70 or more.

    record_a is the smaller id; each pair once; a record delivered twice counts
    once. Null or damaged payloads, payloads without words, and rows whose id,
    namespace or type_name is null have no partners; an empty table gives no
    rows; whole payloads are read, however long. Further columns are ignored.

    All pairs of different payloads are listed, also those of one word set.
    Equal payloads (as JSON: whatever the spacing, escapes and order of keys)
    are listed pair by pair up to ``copies_in_full`` records (null: however
    many; 1: never); more of them as pairs of their smallest id with each of the
    others, and their links to other payloads by that id alone.
    ``near_duplicate_links`` and ``near_duplicate_classes`` together say every
    pair there is, in one form for all classes.
    """
    classes, members = word_sets(records)
    links = materialize(class_links(classes), "links")
    texts = members.groupBy("c", "text").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("rep"))
    marked = members.join(texts.hint("merge"), ["c", "text"])
    many = F.lit(False) if copies_in_full is None else F.col("copies") > copies_in_full
    told = materialize(marked.where(~many | (F.col("record_id") == F.col("rep"))).select("c", "record_id"), "told")
    big = marked.where(many & (F.col("record_id") != F.col("rep"))).select(F.col("rep").alias("p"), F.col("record_id").alias("q"), F.lit(100).alias("overlap"))
    between = links.join(told.select(F.col("c").alias("a"), F.col("record_id").alias("p")).hint("merge"), "a").join(told.select(F.col("c").alias("b"), F.col("record_id").alias("q")).hint("merge"), "b").select("p", "q", "overlap")
    twin = told.join(told.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("c").hint("merge"), "c")
    within = twin.select("c", F.col("record_id").alias("p")).join(twin.select("c", F.col("record_id").alias("q")).hint("merge"), "c").where(F.col("p") < F.col("q")).select("p", "q", F.lit(100).alias("overlap"))
    return between.unionByName(within).unionByName(big).select(F.least("p", "q").alias("record_a"), F.greatest("p", "q").alias("record_b"), "overlap")


def near_duplicate_links(records: DataFrame) -> DataFrame:
    """class_a, class_b, overlap: linked classes of ``near_duplicate_classes``, the smaller id first.

    Two records are a pair if and only if their classes are the same or linked.
    """
    classes, members = word_sets(records)
    names = materialize(members.groupBy("c").agg(F.min("record_id").alias("name")), "names")
    named = class_links(classes).join(names.select(F.col("c").alias("a"), F.col("name").alias("p")).hint("merge"), "a").join(names.select(F.col("c").alias("b"), F.col("name").alias("q")).hint("merge"), "b")
    return named.select(F.least("p", "q").alias("class_a"), F.greatest("p", "q").alias("class_b"), "overlap")


def near_duplicate_classes(records: DataFrame) -> DataFrame:
    """record_id, class_id, n_copies, n_links: every record with words, its class and the class's links to other classes."""
    classes, members = word_sets(records)
    links = materialize(class_links(classes), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy("c").agg(F.count(F.lit(1)).alias("n_copies"), F.min("record_id").alias("class_id"))
    return members.join(sizes.join(degree.hint("merge"), "c", "left").hint("merge"), "c").select("record_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
