"""Parent-child links to full hierarchies (problem 2).

Method: fragment contraction. Nodes are range-partitioned so that lineages
mostly stay together; each task follows its partition-local parent chains to
the fragment's exit by pointer doubling in numpy. Only the exits remain: they
form a smaller quotient forest, which is solved the same way, recursively, and
its answers are joined back to the fragments. Cycles inside a fragment are
found there; cycles through several fragments appear as cycles of the quotient.
Paths are expanded along the same recursion: a fragment writes for each node
the piece up to its top, a quotient edge carries the piece it stands for, and a
node's path is its fragment's piece followed by its top's.

No step needs a whole lineage, root or namespace in one task: a task holds one
range of at most ``rows_per_task`` nodes, whatever they belong to. A quotient
that does not shrink is finished by distributed pointer doubling. Joins of
growing sides are sort-merge joins by hint; a line that holds a third of all
nodes has one row on the other side, so AQE's skew join can split it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.ids import canonical_uuid, clean_key, predecessor_uuid
from recordloom.session import materialize, task_count

ROWS_PER_TASK = 500_000
#: Path elements a task holds at once.
_ELEMENTS = 2_000_000
_FRAGMENT = "id string, zone string, top string, steps long, revoked_below long, top_revoked long, exit string, loop string, low string, seg array<string>"


def follow(par: np.ndarray, steps: np.ndarray, rev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chase parents to the end by pointer doubling.

    ``par`` holds positions, -1 where a chain ends; ``steps`` and ``rev`` are the
    weights of each edge. Returns (top, steps, rev, loop): ``loop`` is -1, or a
    position on the circle the node runs into; top is then meaningless.
    """
    n = len(par)
    ends = par < 0
    here = np.arange(n)
    ptr = np.where(ends, here, par)
    steps = np.where(ends, 0, steps)
    rev = np.where(ends, 0, rev)
    for _ in range(max(1, int(n).bit_length() + 1)):
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            break
        steps = steps + steps[ptr]
        rev = rev + rev[ptr]
        ptr = nxt
    loop = np.where(ends[ptr], -1, ptr) if n else ptr
    return ptr, steps, rev, loop


def circle_min(par: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For nodes on a circle the smallest rank on it (other nodes: no meaning)."""
    n = len(par)
    ptr, low = np.where(par < 0, np.arange(n), par), rank.copy()
    for _ in range(max(1, int(n).bit_length() + 1)):
        low = np.minimum(low, low[ptr])
        ptr = ptr[ptr]
    return low


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _col(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _int(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(_col(t, name), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def climb(par: np.ndarray, nodes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The edges (named by their lower end) above each node up to its top, one node after the other."""
    first = np.concatenate(([0], np.cumsum(steps)[:-1])).astype(np.int64)
    out = np.empty(int(steps.sum()), np.int64)
    at, place = nodes, first
    live = np.flatnonzero(steps > 0)
    at, place, left = at[live], place[live], steps[live]
    while len(at):
        out[place] = at
        at, place, left = par[at], place + 1, left - 1
        more = left > 0
        if not more.all():
            at, place, left = at[more], place[more], left[more]
    return out


def _segments(par: np.ndarray, loop: np.ndarray, pieces: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(nodes, ids above each up to its fragment's top), a bounded number of path elements at a time; none for those that run in a circle."""
    size = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
    _, hops, weight, _ = follow(par, np.ones(len(par), np.int64), size + 1)
    hops, weight = np.where(loop >= 0, 0, hops), np.where(loop >= 0, 0, weight)
    values, start = pieces.values, pieces.offsets.to_numpy().astype(np.int64)
    order = np.argsort(hops, kind="stable")
    cut = np.cumsum(weight[order] + 1) // _ELEMENTS
    for nodes in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
        edges = climb(par, nodes, hops[nodes])
        length = size[edges]
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = np.arange(ends[-1]) - np.repeat(ends[:-1] - start[edges], length)
        bounds = ends[np.concatenate(([0], np.cumsum(hops[nodes])))]
        yield nodes, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values.take(pa.array(flat)))


def _contract(with_paths: bool):
    """Task body: id, zone, parent, revoked, w, wr, loop, low, piece -> fragment rows.

    ``w`` and ``wr`` weigh the edge to the parent (1 and the node's own flag at
    the first level), ``piece`` holds the ids it leads through, the parent last,
    ``low`` is the smallest of them (the node's own id at the first level).
    A node may arrive with ``loop`` set: its line is already known to run into
    that circle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        ids, parent = _col(t, "id"), _col(t, "parent")
        n = len(ids)
        par = pc.fill_null(pc.index_in(parent, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = _col(t, "loop")
        revoked = _int(t, "revoked")
        top, steps, rev, loop = follow(par, _int(t, "w"), _int(t, "wr"))
        rank = np.empty(n, np.int64)
        lows = _col(t, "low")
        order = pc.sort_indices(lows).to_numpy()
        rank[order] = np.arange(n)
        low_up = order[circle_min(par, rank)]
        named = pc.take(lows, pa.array(np.where(loop >= 0, low_up[np.maximum(loop, 0)], -1), mask=loop < 0))
        inherited = pc.take(known, pa.array(top))
        loops = pc.coalesce(named, inherited)
        open_exit = pc.if_else(pc.is_null(pc.take(known, pa.array(top))), pc.take(parent, pa.array(top)), pa.scalar(None, pa.string()))
        exits = pc.if_else(pa.array(loop >= 0), pa.scalar(None, pa.string()), open_exit)
        out = pa.table(
            {"id": ids, "zone": _col(t, "zone"), "top": pc.take(ids, pa.array(top)), "steps": steps, "revoked_below": rev, "top_revoked": revoked[top], "exit": exits, "loop": loops, "low": pc.take(lows, pa.array(low_up))}
        )
        if not with_paths:
            yield from out.append_column("seg", pa.nulls(n, pa.list_(pa.string()))).to_batches(max_chunksize=50_000)
            return
        for nodes, seg in _segments(par, loop, _col(t, "piece")):
            yield from out.take(pa.array(nodes)).append_column("seg", seg).to_batches(max_chunksize=50_000)

    return run


def _local(nodes: DataFrame, rows_per_task: int, with_paths: bool, count: int) -> DataFrame:
    tasks = task_count(count, nodes.sparkSession, rows_per_task)
    placed = nodes.coalesce(1) if tasks == 1 else nodes.repartitionByRange(tasks, "zone", "id")
    return placed.mapInArrow(_contract(with_paths), _FRAGMENT)


def _quotient(frag: DataFrame) -> DataFrame:
    """One row for each fragment top with an exit: its parent is the top of the fragment the exit leads to."""
    entry = frag.select(F.col("id").alias("exit"), F.col("top").alias("e_top"), F.col("steps").alias("e_steps"), F.col("revoked_below").alias("e_rev"), F.col("top_revoked").alias("e_top_rev"), F.col("loop").alias("e_loop"), F.col("exit").alias("e_exit"), F.col("low").alias("e_low"), F.col("seg").alias("e_seg"))
    tops = frag.where((F.col("id") == F.col("top")) & F.col("exit").isNotNull())
    return tops.select("id", "zone", "exit", F.col("top_revoked").alias("revoked")).join(entry.hint("merge"), "exit", "left")


_NO_IDS = "array<string>"


def _joined(a: Column, b: Column, with_paths: bool) -> Column:
    """Two path pieces end to end; null where no paths are wanted."""
    return F.concat(F.coalesce(a, F.array().cast(_NO_IDS)), F.coalesce(b, F.array().cast(_NO_IDS))) if with_paths else F.lit(None).cast(_NO_IDS)


def _double(q: DataFrame, count: int, with_paths: bool = False) -> DataFrame:
    """Distributed pointer doubling for a quotient too large and too tangled for a task."""
    state = q.select(
        "id", F.when(F.col("loop").isNull(), F.col("parent")).alias("ptr"), F.coalesce("parent", "id").alias("end"), F.when(F.col("parent").isNotNull(), F.col("w")).otherwise(0).alias("steps"),
        F.when(F.col("parent").isNotNull(), F.col("wr")).otherwise(0).alias("rev"), "loop", "low",
    )
    state = materialize(state, "double")
    for _ in range(max(1, int(count).bit_length() + 1)):
        o = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("o_ptr"), F.col("end").alias("o_end"), F.col("steps").alias("o_steps"), F.col("rev").alias("o_rev"), F.col("loop").alias("o_loop"), F.col("low").alias("o_low"))
        state = materialize(
            state.join(o.hint("merge"), "ptr", "left").select(
                "id", F.col("o_ptr").alias("ptr"), F.coalesce("o_end", "end").alias("end"), (F.col("steps") + F.coalesce("o_steps", F.lit(0))).alias("steps"),
                (F.col("rev") + F.coalesce("o_rev", F.lit(0))).alias("rev"), F.coalesce("loop", "o_loop").alias("loop"), F.least("low", "o_low").alias("low"),
            ),
            "double",
        )
        if state.where(F.col("ptr").isNotNull()).limit(1).count() == 0:
            break
    on_circle = state.select(F.col("id").alias("end"), F.col("low").alias("c_low"))
    done = state.join(on_circle.hint("merge"), "end", "left")
    endless = F.col("ptr").isNotNull()
    out = done.select("id", F.when(~endless, F.col("end")).alias("end"), "steps", "rev", F.when(endless, F.col("c_low")).otherwise(F.col("loop")).alias("loop"))
    if not with_paths:
        return out.withColumn("above", F.lit(None).cast(_NO_IDS))
    out = materialize(out, "doubled")
    return out.join(_doubled_paths(q, out).hint("merge"), "id", "left")


def _doubled_paths(q: DataFrame, solved: DataFrame) -> DataFrame:
    """id, above: the ids above each quotient node whose line ends, by doubling pieces."""
    open_ids = solved.where(F.col("loop").isNull()).select("id")
    state = materialize(q.join(open_ids.hint("merge"), "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.col("piece").alias("above")), "paths")
    while state.where(F.col("ptr").isNotNull()).limit(1).count():
        o = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("o_ptr"), F.col("above").alias("o_above"))
        state = materialize(state.join(o.hint("merge"), "ptr", "left").select("id", F.col("o_ptr").alias("ptr"), _joined(F.col("above"), F.col("o_above"), True).alias("above")), "paths")
    return state.select("id", "above")


def _solve(q: DataFrame, rows_per_task: int, with_paths: bool = False, spent: int | None = None) -> DataFrame:
    """id, zone, parent, revoked, w, wr, loop, piece -> id, end, steps, rev, loop, above."""
    q = materialize(q, "quotient")
    count = q.count()
    if spent is not None and count > rows_per_task and count > 0.8 * spent:
        return _double(q, count, with_paths)
    if count <= rows_per_task:  # final, so all of it in one task: coalesced before the body runs, not behind it
        whole = q.coalesce(1).mapInArrow(_contract(with_paths), _FRAGMENT)
        return whole.select("id", F.col("top").alias("end"), "steps", F.col("revoked_below").alias("rev"), "loop", F.col("seg").alias("above"))
    frag = materialize(_local(q, rows_per_task, with_paths, count), "fragments")
    inner = _quotient(frag).where(F.col("e_top").isNotNull())
    nxt = inner.select("id", "zone", F.col("e_top").alias("parent"), "revoked", F.lit(None).cast("long").alias("x"), "e_steps", "e_rev", "e_loop", "e_low", "e_seg", "exit")
    edge = q.select("id", F.col("w").alias("own_w"), F.col("wr").alias("own_wr"), F.col("low").alias("own_low"), F.col("piece").alias("own_piece"))
    nxt = nxt.join(edge.hint("merge"), "id").select(
        "id", "zone", "parent", "revoked", (F.col("own_w") + F.col("e_steps")).alias("w"), (F.col("own_wr") + F.col("e_rev")).alias("wr"), F.col("e_loop").alias("loop"), F.least("own_low", "e_low").alias("low"), _joined(F.col("own_piece"), F.col("e_seg"), with_paths).alias("piece")
    )
    missing = nxt.select(F.col("parent").alias("id")).distinct().join(nxt.select("id").hint("merge"), "id", "left_anti")
    nxt = nxt.unionByName(_quotient_roots(missing.withColumn("revoked", F.lit(0).cast("long"))))
    solved = materialize(_solve(nxt, rows_per_task, with_paths, count), "solved").select(F.col("id").alias("top"), "end", F.col("steps").alias("s2"), F.col("rev").alias("r2"), F.col("loop").alias("l2"), F.col("above").alias("a2"))
    return frag.join(solved.hint("merge"), "top", "left").select(
        "id", F.coalesce("end", "top").alias("end"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), (F.col("revoked_below") + F.coalesce("r2", F.lit(0))).alias("rev"), F.coalesce("loop", "l2").alias("loop"),
        _joined(F.col("seg"), F.col("a2"), with_paths).alias("above"),
    )


def _quotient_roots(roots: DataFrame) -> DataFrame:
    """Quotient rows of fragment tops (id, revoked) without an exit."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return roots.select("id", F.lit("").alias("zone"), none.alias("parent"), "revoked", zero.alias("w"), zero.alias("wr"), none.alias("loop"), F.col("id").alias("low"), F.array().cast(_NO_IDS).alias("piece"))


def ledger_nodes(records: DataFrame) -> DataFrame:
    """One node for each record id: id, zone, parent, revoked (any row revoked counts)."""
    return (
        records.select(canonical_uuid(F.col("id")).alias("id"), clean_key(F.col("namespace")).alias("zone"), predecessor_uuid(F.col("supersedes")).alias("parent"), (F.col("revoked") == 1).cast("long").alias("revoked"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("zone").alias("zone"), F.min("parent").alias("parent"), F.coalesce(F.max("revoked"), F.lit(0)).alias("revoked"))
    )


def hierarchy(nodes: DataFrame, rows_per_task: int = ROWS_PER_TASK, with_paths: bool = False) -> DataFrame:
    """Root, depth and revoked count of every node whose parent exists.

    ``nodes``: id (unique), zone (any locality hint, may be null), parent (null:
    none), revoked (0 or 1). Other columns are ignored.

    Returns id, root, depth, n_revoked, cyclic[, path]. A node whose line never
    reaches a root has cyclic = true, root = smallest id of the circle and depth
    and n_revoked -1. Nodes without an existing parent (roots, orphans) give no
    row; an empty table gives none. A node naming itself is a circle of one.
    ``path`` runs from the node to its root, both included (empty if cyclic).
    """
    one = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast(_NO_IDS)) if with_paths else F.lit(None).cast(_NO_IDS)
    nodes = materialize(nodes.select("id", "zone", "parent", "revoked", F.lit(1).cast("long").alias("w"), F.col("revoked").cast("long").alias("wr"), F.lit(None).cast("string").alias("loop"), F.col("id").alias("low"), one.alias("piece")), "nodes")
    count = nodes.count()
    frag = materialize(_local(nodes, rows_per_task, with_paths, count), "fragments")
    exits = materialize(_quotient(frag), "exits")
    found = F.col("e_top").isNotNull()
    edges = exits.where(found).select(
        "id", "zone", F.col("e_top").alias("parent"), "revoked", (1 + F.col("e_steps")).alias("w"), (F.col("revoked") + F.col("e_rev")).alias("wr"), F.col("e_loop").alias("loop"), F.col("e_low").alias("low"), _joined(F.array("exit"), F.col("e_seg"), with_paths).alias("piece")
    )
    # A fragment top that an exit leads to and that has no exit of its own is a root of the quotient.
    roots = exits.where(found & F.col("e_loop").isNull()).select(F.col("e_top").alias("id"), F.col("e_top_rev").alias("revoked")).distinct().join(edges.select("id").hint("merge"), "id", "left_anti")
    solved = materialize(_solve(edges.unionByName(_quotient_roots(roots)), rows_per_task, with_paths), "solved")
    root_flags = roots.select(F.col("id").alias("end"), F.col("revoked").alias("end_revoked"))
    answers = solved.join(root_flags.hint("merge"), "end", "left").select(F.col("id").alias("top"), "end", F.col("steps").alias("q_steps"), F.col("rev").alias("q_rev"), F.col("loop").alias("q_loop"), "end_revoked", "above")
    joined = frag.join(materialize(answers, "answers").hint("merge"), "top", "left")
    loop = F.coalesce("loop", "q_loop")
    cyclic = loop.isNotNull()
    has_parent = (F.col("id") != F.col("top")) | cyclic | (F.col("q_steps") > 0)
    minus = F.lit(-1).cast("long")
    total = F.col("revoked_below") + F.when(F.col("q_steps") > 0, F.col("q_rev") + F.coalesce("end_revoked", F.lit(0))).otherwise(F.col("top_revoked"))
    cols = [
        "id", F.when(cyclic, loop).otherwise(F.coalesce("end", "top")).alias("root"), F.when(cyclic, minus).otherwise(F.col("steps") + F.coalesce("q_steps", F.lit(0))).alias("depth"),
        F.when(cyclic, minus).otherwise(total).alias("n_revoked"), cyclic.alias("cyclic"),
    ]
    if with_paths:
        path: Column = F.concat(F.array("id"), _joined(F.col("seg"), F.col("above"), True))
        cols.append(F.when(cyclic, F.array().cast(_NO_IDS)).otherwise(path).alias("path"))
    return joined.where(has_parent).select(*cols)


def descendants(resolved: DataFrame) -> DataFrame:
    """ancestor_id, record_id, distance for all records below each record; needs ``path``."""
    return resolved.where(~F.col("cyclic")).select(F.posexplode("path").alias("distance", "ancestor_id"), F.col("id").alias("record_id")).where(F.col("distance") > 0).select("ancestor_id", "record_id", F.col("distance").cast("long").alias("distance"))
