"""Minimum (s, t)-cuts of many small graphs, and their alternatives, as a kernel over the tasks of a partition (GR09-GR11, GR17, SET03).

A group is one task's contracted graph, which is small; the tasks are what is distributed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
_FIELDS = [T.StructField("task_id", T.LongType()), T.StructField("cut_ix", T.IntegerType()), T.StructField("weight", T.DoubleType()), *[T.StructField(n, _TEXTS) for n in ("edges", "source", "sink")]]
SCHEMA = T.StructType(_FIELDS)
_TYPES = [pa.int64(), pa.int32(), pa.float64(), *[pa.list_(pa.string())] * 3]


def min_cut(edges: list[tuple[str, str]], weights: list[float], s: str, t: str) -> tuple[float, list[int], set[str]]:
    """Weight, indices of the cut edges, and the source side, of an undirected graph; augments along shortest paths."""
    left: dict[str, dict[str, float]] = {s: {}, t: {}}
    for (a, b), w in zip(edges, weights, strict=True):
        if a != b:
            for x, y in ((a, b), (b, a)):
                left.setdefault(x, {}).setdefault(y, 0.0)
                left[x][y] += w
    flow = 0.0
    while True:
        parent, todo = {s: s}, deque([s])
        while todo and t not in parent:
            x = todo.popleft()
            for y, c in left[x].items():
                if c > 1e-12 and y not in parent:
                    parent[y] = x
                    todo.append(y)
        if t not in parent or s == t:
            side = set(parent)
            return flow, [i for i, (a, b) in enumerate(edges) if (a in side) != (b in side)], side
        path, y = [], t
        while y != s:
            path.append((parent[y], y))
            y = parent[y]
        most = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= most
            left[b][a] += most
        flow += most


def all_cuts(edges: list[tuple[str, str]], s: str, t: str) -> list[tuple[float, list[int], set[str]]]:
    """The first cut and alternatives of at most the best weight, in the order in which they are found.

    The work list holds edges to make one dearer before the cut is computed again; it begins with none.  A cut that is
    dearer than the best puts its edge's weight back to 1; otherwise the increment stays, and a new cut puts its edges on the list.
    What the source reaches beside a greatest flow is the same for all greatest flows, so that a flow is kept and goes on where an edge gets dearer.
    """
    if not edges or s == t:
        return []
    number: dict[str, int] = {s: 0, t: 1}
    ends = [(number.setdefault(a, len(number)), number.setdefault(b, len(number))) for a, b in edges]
    to, on = [0] * (2 * len(edges)), [[] for _ in number]
    for i, (a, b) in enumerate(ends):
        if a != b:
            to[2 * i], to[2 * i + 1] = b, a
            on[a].append(2 * i)
            on[b].append(2 * i + 1)

    def pushed(left: list[int], flow: int, most: float) -> tuple[int, list[int]]:
        """The flow after augmenting along shortest paths, and by which arc each node is reached then (-1: not at all); ends where it is over most."""
        while flow <= most:
            via, todo = [-1] * len(on), [0]
            via[0] = -2
            for x in todo:
                for e in on[x]:
                    if left[e] and via[y := to[e]] == -1:
                        via[y] = e
                        todo.append(y)
                if via[1] != -1:
                    break
            else:
                return flow, via
            path, y = [], 1
            while y:
                path.append(via[y])
                y = to[via[y] ^ 1]
            least = min(left[e] for e in path)
            for e in path:
                left[e] -= least
                left[e ^ 1] += least
            flow += least
        return flow, []

    names, weights, best, found, seen = list(number), [1] * len(edges), float("inf"), [], set()
    left, flow, todo = [1] * len(to), 0, deque([None])
    while todo:
        e, trial = todo.popleft(), left.copy()
        if e is not None:
            weights[e] += 1
            trial[2 * e] += 1
            trial[2 * e + 1] += 1
        total, via = pushed(trial, flow, best)
        if total > best:
            dear, weights[e] = weights[e] > 2, 1
            if dear:
                left = [w for w in weights for _ in "ab"]
                flow, _ = pushed(left, 0, float("inf"))
            continue
        best, left, flow = total, trial, total
        cut = [i for i, (a, b) in enumerate(ends) if (via[a] == -1) != (via[b] == -1)]
        if tuple(cut) not in seen:
            seen.add(tuple(cut))
            found.append((float(total), cut, {names[n] for n, arc in enumerate(via) if arc != -1}))
            todo.extend(cut)
    return found


def _rows_of(task: int, rows: list[tuple[str, str, str, str]], first_only: bool) -> list[tuple]:
    """The result rows of one task's (src, dst, s, t)."""
    pairs, (*_, s, t) = [(a, b) for a, b, *_ in rows], rows[0]
    nodes = {x for p in pairs for x in p} | {s, t}
    found = [min_cut(pairs, [1.0] * len(pairs), s, t)] if first_only else all_cuts(pairs, s, t)
    return [(task, i, w, sorted(f"{pairs[e][0]}->{pairs[e][1]}" for e in es), sorted(side), sorted(nodes - side)) for i, (w, es, side) in enumerate(found)]


def cuts(edges: DataFrame, first_only: bool = False) -> DataFrame:
    """task_id, cut_ix, weight, edges ("src->dst"), source, sink for edges(task_id, ord, src, dst, s, t); arrays are sorted.

    Tasks are dealt to partitions and come one behind the other, so that a worker holds one task's graph: that of one
    project's contracted libraries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, out = None, [], []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], [f.name for f in _FIELDS])
            out.clear()
            return batch

        for b in batches:
            for t, *row in zip(*(b[c].to_pylist() for c in ("task_id", "src", "dst", "s", "t")), strict=True):
                if t != task:
                    if rows:
                        out.extend(_rows_of(task, rows, first_only))
                    task, rows = t, []
                rows.append(tuple(row))
            if len(out) > 1000:
                yield made()
        if rows:
            out.extend(_rows_of(task, rows, first_only))
        yield made()

    dealt = edges.select(F.col("task_id").cast("long").alias("task_id"), "ord", "src", "dst", "s", "t").repartition("task_id").sortWithinPartitions("task_id", "ord")
    return dealt.mapInArrow(run, SCHEMA)
