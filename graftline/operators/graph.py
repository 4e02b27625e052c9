"""Graph operators over edge tables (src, dst), for many graphs at once where ``by`` names the columns of a graph's key (GR01-GR17).

Traversals advance a frontier by joins; each round's new rows are written once into one growing table, which is both what
is visited (left out by an anti-join) and the result.  Shortest paths carry the path of the parent, so that no paths are
enumerated for them; ``bounded_paths`` enumerates, for every path is its result.  Of many graphs those of at most ``SMALL`` edges and
starts are searched side by side by the workers, in one pass, and only larger ones by rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.names import cleared_group
from graftline.staging import Rounds, release, stage


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once, with unit weight."""
    return edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).distinct().withColumn("weight", F.lit(1.0))


def induced(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges whose two ends are among nodes(by, node)."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*by, F.col("node").alias(end)), [*by, end], "left_semi").select(*edges.columns)
    return edges


def roots(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, node: sources of edges that no edge enters."""
    return edges.select(*by, F.col("src").alias("node")).distinct().join(edges.select(*by, F.col("dst").alias("node")), [*by, "node"], "left_anti")


def first_root(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, node, is_first: the roots, and whether a root is its graph's first."""
    r = roots(edges, by)
    least = r.groupBy(*by).agg(F.min("node").alias("first"))
    met = r.join(least, list(by)) if by else r.crossJoin(F.broadcast(least))  # one row where there is one graph
    return met.select(*by, "node", (F.col("node") == F.col("first")).alias("is_first"))


def _search(first: DataFrame, key: Sequence[str], advance, max_depth: int | None) -> DataFrame:
    """first, and per round what advance(frontier, depth) gives and is not there by key yet."""
    found, depth = Rounds(first.sparkSession, "found"), 0
    frontier = found.add(first)
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = found.add(advance(frontier, depth).join(found.all().select(*key), list(key), "left_anti"))
        if frontier.isEmpty():
            break
    return found.all()


def _kept(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """The distinct edges, written once: every round of a traversal reads them."""
    return stage(edges.select(*by, "src", "dst").distinct(), "edges")


#: Edges and starts of a graph that a worker holds.
SMALL = 20_000
#: Rows of many graphs that a worker searches together, pairs of starts and what they may reach that it walks at once, and values of a batch that leaves it.
_ROWS_AT_ONCE, _PAIRS_AT_ONCE, _VALUES_AT_ONCE = 100_000, 1 << 19, 1 << 20

_EDGE, _TOP, _SINK, _CUT, _ASKED = 0, 1, 2, 3, 4


def _each_graph(rows: DataFrame, by: Sequence[str], walk: Callable, result: Sequence[str], kind: T.DataType, rounds: Callable) -> DataFrame:
    """by and the columns result (start, node, a number, path) of walk over rows(by, src, dst, _kind), which tell edges, starts and the like apart, for each graph; rounds(rows) for graphs that are too large.

    The rows are dealt once.  A worker searches many graphs side by side, and of a graph that is too large gives the key alone.
    """
    by, most = list(by), SMALL
    of = rows.schema["src"].dataType
    types = {"start": of, "node": of, "path": T.ArrayType(of)}
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in by] + [T.StructField(c, types.get(c, T.IntegerType())) for c in result] + [T.StructField("_large", T.BooleanType())])
    arrow = _arrow_schema(schema)
    n = len(by)

    def searched(held: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Results of the graphs that begin at the rows first."""
        sizes = np.diff(first, append=held.num_rows)
        of_row = np.repeat(np.arange(len(first)), sizes)
        keys = [held.column(i).take(pa.array(first)) for i in range(n)]
        # a null is no node like others: it is left to the joins of the rounds
        odd = reduce(np.logical_or, [_nulls(held.column(i)) for i in range(n + 2)])
        large = (sizes > most) | (np.bincount(of_row, weights=odd, minlength=len(first)) > 0)
        if large.any():
            at = pa.array(np.flatnonzero(large))
            yield pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), *(pa.nulls(len(at), t) for t in arrow.types[n:-1]), pa.array(np.ones(len(at), bool))], schema=arrow)
        fits = ~large[of_row]
        if not fits.any():
            return
        part = held.filter(pa.array(fits))
        for graphs, columns in walk(_Graphs(of_row[fits], part.column(n), part.column(n + 1), part.column(n + 2).to_numpy())):
            at = pa.array(graphs)
            yield pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), *(c if c.type == t else c.cast(t) for c, t in zip(columns, arrow.types[n:-1], strict=True)), pa.array(np.zeros(len(at), bool))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch in batches:
            parts.append(batch)
            count += batch.num_rows
            if count >= _ROWS_AT_ONCE:
                held = pa.concat_batches(parts)
                first = _begins(held, n)
                if first[-1]:
                    yield from searched(held.slice(0, int(first[-1])), first[:-1])
                # of a graph that goes on, no more is kept than tells that it is too large
                rest = held.slice(int(first[-1]), most + 1 if most >= 0 else 1)
                parts, count = [rest], rest.num_rows
        if count:
            held = pa.concat_batches(parts)
            yield from searched(held, _begins(held, n))

    dealt = rows.select(*by, "src", "dst", "_kind").repartition(*by).sortWithinPartitions(*by)
    every = stage(dealt.mapInArrow(run, schema), "found")
    shown = [F.col(c).cast(T.ArrayType(kind) if c == "path" else kind).alias(c) if c in types else F.col(c) for c in result]
    found = every.filter("not _large").select(*by, *shown)
    large = every.filter("_large").select(*by).distinct()
    if not large.isEmpty():
        same = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by])
        rest = stage(rows.alias("r").join(large.alias("l"), same, "left_semi"), "rest")
        found = found.unionByName(rounds(rest).select(found.columns))
        release(rest)
    return found


def _searched(edges: DataFrame, starts: DataFrame, by: Sequence[str], walk: Callable, result: Sequence[str], rounds: Callable, nodes: DataFrame | None = None, mark: int | None = None) -> DataFrame:
    """The results of walk from starts, or of rounds(edges, starts, nodes) for one graph; the walk finds nodes(by, node) by their mark."""
    if not by:
        return rounds(edges, starts, nodes)
    kind, rows = starts.schema["start"].dataType, _rows(by, edges, starts)
    if nodes is not None:
        rows = rows.unionByName(_ends(by, nodes, mark))
    return _each_graph(rows, by, walk, result, kind, _in_rounds(rounds, by, kind, None if nodes is None else mark))


def _rows(by: Sequence[str], edges: DataFrame, starts: DataFrame) -> DataFrame:
    one = starts.select(*by, F.col("start").alias("src"), F.col("start").alias("dst"), _mark(_TOP))
    return edges.select(*by, "src", "dst", _mark(_EDGE)).unionByName(one)


def _mark(kind: int) -> Column:
    return F.lit(kind).cast("byte").alias("_kind")


def _ends(by: Sequence[str], nodes: DataFrame, mark: int) -> DataFrame:
    return nodes.select(*by, F.col("node").alias("src"), F.col("node").alias("dst"), _mark(mark))


def _in_rounds(rounds: Callable, by: Sequence[str], kind: T.DataType, mark: int | None = None) -> Callable:
    """rounds(edges, starts, nodes) over rows; without a mark nodes are None."""
    of = lambda rest, m, name: rest.filter(F.col("_kind") == m).select(*by, F.col("src").cast(kind).alias(name))
    return lambda rest: rounds(rest.filter(F.col("_kind") == _EDGE).select(*by, "src", "dst"), of(rest, _TOP, "start"), None if mark is None else of(rest, mark, "node"))


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _nulls(c: pa.Array) -> np.ndarray:
    return c.is_null().to_numpy(zero_copy_only=False) if c.null_count else np.zeros(len(c), bool)


def _begins(rows: pa.RecordBatch, n: int) -> np.ndarray:
    """Where a row's first n columns differ from those of the row before; nulls are equal."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in rows.columns[:n]:
        gone = _nulls(c)
        new[1:] |= (gone[1:] != gone[:-1]) | pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


class _Graphs:
    """Many graphs as arrays: nodes are numbered by graph and value, edges are in the order of their ends."""

    def __init__(self, of: np.ndarray, src: pa.Array, dst: pa.Array, kind: np.ndarray):
        self.values = pa.concat_arrays([src, dst])
        if pa.types.is_integer(self.values.type):
            code = self.values.to_numpy().astype(np.int64)
        else:
            coded = self.values.dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            code = rank[coded.indices.to_numpy()]
        low, high = int(code.min()), int(code.max())
        if high - low >= (1 << 62) // (int(of[-1]) + 1):
            _, code = np.unique(code, return_inverse=True)
            low, high = 0, len(code)
        spread = high - low + 1
        met, self.at, number = np.unique(np.concatenate([of, of]) * spread + (code - low), return_index=True, return_inverse=True)
        self.n, self.graph = len(met), met // spread
        a, b = number[: len(of)], number[len(of) :]
        self.a, self.b, self.kind = a, b, kind
        own = kind == _EDGE
        self._link(a[own], b[own])
        #: Where the numbers of each node's graph begin, and how many nodes and edges it has.
        count = np.bincount(self.graph, minlength=int(of[-1]) + 1)
        self.base = (np.cumsum(count) - count)[self.graph]
        self.nodes = count[self.graph]

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        links = np.unique(a * self.n + b)
        self.ends = links % max(self.n, 1)
        self.begin = np.searchsorted(links, np.arange(self.n + 1) * self.n)

    def marked(self, kind: int) -> np.ndarray:
        return np.unique(self.a[self.kind == kind])

    def among(self, kind: int) -> np.ndarray:
        """Of each node whether it is marked."""
        is_marked = np.zeros(self.n, bool)
        is_marked[self.marked(kind)] = True
        return is_marked

    def inside(self, keep: np.ndarray) -> None:
        """Only edges between nodes for which keep is true stay."""
        a, b = np.repeat(np.arange(self.n), np.diff(self.begin)), self.ends
        own = keep[a] & keep[b]
        self._link(a[own], b[own])

    def named(self, numbers: np.ndarray) -> pa.Array:
        return self.values.take(pa.array(self.at[numbers]))

    def onward(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge that leaves one of nodes the place of its start there, and its end; in this order."""
        low, n = self.begin[nodes], self.begin[nodes + 1] - self.begin[nodes]
        place = np.repeat(np.arange(len(nodes)), n)
        return place, self.ends[np.arange(len(place)) + np.repeat(low - (np.cumsum(n) - n), n)]

    def shares(self, tops: np.ndarray) -> Iterator[np.ndarray]:
        """tops in parts whose graphs have about as many nodes and edges as may be walked at once."""
        links = np.bincount(self.graph, weights=np.diff(self.begin)).astype(np.int64)
        whole = np.cumsum(self.nodes[tops] + links[self.graph[tops]]) // _PAIRS_AT_ONCE
        return (part for part in np.split(tops, np.flatnonzero(np.diff(whole)) + 1) if len(part))


def _parts(n: int, width: int = 1) -> Iterator[slice]:
    step = max(1, _VALUES_AT_ONCE // 4 // width)
    return (slice(at, at + step) for at in range(0, n, step))


def _levels(g: _Graphs, tops: np.ndarray, depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """dist, starts, nodes, and the place of each one's parent on the level before; of a start's nodes on a level those with the least paths first."""
    offset = np.cumsum(g.nodes[tops]) - g.nodes[tops] - g.base[tops]
    seen = np.zeros(int(g.nodes[tops].sum()), bool)
    slot, node, dist, parent = np.arange(len(tops)), tops, 0, np.arange(len(tops))
    seen[offset + tops] = True
    while len(node):
        yield dist, tops[slot], node, parent
        if dist == depth:
            return
        dist += 1
        place, end = g.onward(node)
        where = offset[slot[place]] + end
        fresh = np.flatnonzero(~seen[where])
        # paths of one length are in the order of their parents' paths, then of their last nodes
        _, first = np.unique(where[fresh], return_index=True)
        first = fresh[np.sort(first)]
        seen[where[first]] = True
        slot, node, parent = slot[place[first]], end[first], place[first]


def _walk_distances(depth: int | None, within: bool) -> Callable:
    """(start, node, dist); within: by edges inside the sink alone."""

    def walk(g: _Graphs) -> Iterator[tuple]:
        if within:
            g.inside(g.among(_SINK))
        for tops in g.shares(g.marked(_TOP)):
            for dist, start, node, _ in _levels(g, tops, depth):
                for s in _parts(len(node)):
                    yield g.graph[node[s]], (g.named(start[s]), g.named(node[s]), pa.array(np.full(len(node[s]), dist, np.int32)))

    return walk


def _walk_nearest(depth: int | None) -> Callable:
    """(node, start, len)."""

    def walk(g: _Graphs) -> Iterator[tuple]:
        node = start = g.marked(_TOP)
        seen, dist = np.zeros(g.n, bool), 0
        seen[node] = True
        while len(node):
            for s in _parts(len(node)):
                yield g.graph[node[s]], (g.named(node[s]), g.named(start[s]), pa.array(np.full(len(node[s]), dist, np.int32)))
            if dist == depth:
                return
            dist += 1
            place, end = g.onward(node)
            fresh = ~seen[end]
            both = np.unique(end[fresh] * g.n + start[place[fresh]])
            node, start = both // g.n, both % g.n
            least = np.r_[True, node[1:] != node[:-1]][: len(node)]
            node, start = node[least], start[least]
            seen[node] = True

    return walk


def _walk_paths(depth: int | None, asked: bool) -> Callable:
    """(start, node, len, path); asked: to the nodes that are asked for alone."""

    def walk(g: _Graphs) -> Iterator[tuple]:
        shown = g.among(_ASKED) if asked else np.ones(g.n, bool)
        for tops in g.shares(g.marked(_TOP)):
            above = []
            for dist, start, node, parent in _levels(g, tops, depth):
                above.append((node, parent))
                ends = np.flatnonzero(shown[node])
                for s in _parts(len(ends), dist + 1):
                    end = place = ends[s]
                    path = np.empty((len(end), dist + 1), np.int64)
                    for level in range(dist, -1, -1):
                        path[:, level] = above[level][0][place]
                        place = above[level][1][place]
                    cuts = pa.array(np.arange(len(path) + 1, dtype=np.int32) * (dist + 1))
                    yield g.graph[node[end]], (g.named(start[end]), g.named(node[end]), pa.array(np.full(len(path), dist, np.int32)), pa.ListArray.from_arrays(cuts, g.named(path.reshape(-1))))

    return walk


def _walk_sinks(depth: int | None) -> Callable:
    """(node, start) inside the sink, from the cut's nodes that no edge inside it enters."""

    def walk(g: _Graphs) -> Iterator[tuple]:
        sink, top = g.among(_SINK), g.among(_CUT)
        g.inside(sink)
        top &= sink
        top[g.ends] = False
        for tops in g.shares(np.flatnonzero(top)):
            for _, start, node, _ in _levels(g, tops, depth):
                for s in _parts(len(node)):
                    yield g.graph[node[s]], (g.named(node[s]), g.named(start[s]))

    return walk


def _walk_missed(g: _Graphs) -> Iterator[tuple]:
    """(start, node) of what is asked for in the sink and not reached by edges inside it."""
    sink = g.among(_SINK)
    asked = np.flatnonzero(sink & g.among(_ASKED))
    g.inside(sink)
    for tops in g.shares(g.marked(_TOP)):
        low, high = (np.searchsorted(g.graph[asked], g.graph[tops], side) for side in ("left", "right"))
        n = high - low
        start, node = np.repeat(tops, n), asked[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
        met = np.concatenate([top * g.n + end for _, top, end, _ in _levels(g, tops, None)])
        missed = ~np.isin(start * g.n + node, met)
        start, node = start[missed], node[missed]
        for s in _parts(len(node)):
            yield g.graph[node[s]], (g.named(start[s]), g.named(node[s]))


def distances(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, by: Sequence[str] = (), within: DataFrame | None = None) -> DataFrame:
    """by, start, node, dist: the least number of edges from each start(by, start) to every node that it reaches, itself included; only edges between nodes of within(by, node) count, where that is given.

    The result has a row for each pair of a start and a node: use ``nearest`` or ``reachable`` where starts need not be told apart.
    """

    def rounds(edges: DataFrame, starts: DataFrame, within: DataFrame | None) -> DataFrame:
        kept = _kept(edges if within is None else induced(edges, within, by), by)
        first = starts.select(*by, "start", F.col("start").alias("node"), F.lit(0).alias("dist")).distinct()

        def advance(frontier: DataFrame, depth: int) -> DataFrame:
            step = frontier.select(*by, "start", F.col("node").alias("src")).join(kept, [*by, "src"])
            return step.select(*by, "start", F.col("dst").alias("node")).distinct().withColumn("dist", F.lit(depth))

        found = _search(first, [*by, "start", "node"], advance, max_depth)
        release(kept)
        return found

    return _searched(edges, starts, by, _walk_distances(max_depth, within is not None), ("start", "node", "dist"), rounds, within, _SINK)


def nearest(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, node, start, len: for each node that is reached the nearest start, the first one on ties; one row for each node."""

    def rounds(edges: DataFrame, starts: DataFrame, _: None) -> DataFrame:
        kept = _kept(edges, by)
        first = starts.select(*by, F.col("start").alias("node"), "start", F.lit(0).alias("len")).distinct()

        def advance(frontier: DataFrame, depth: int) -> DataFrame:
            step = frontier.withColumnRenamed("node", "src").join(kept, [*by, "src"])
            return step.groupBy(*by, F.col("dst").alias("node")).agg(F.min("start").alias("start")).withColumn("len", F.lit(depth))

        found = _search(first, [*by, "node"], advance, max_depth)
        release(kept)
        return found

    return _searched(edges, starts, by, _walk_nearest(max_depth), ("node", "start", "len"), rounds)


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, node: what any of starts(by, start) reaches, starts included."""
    return nearest(edges, starts, max_depth, by).select(*by, "node")


def unreached(nodes: DataFrame, edges: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """nodes(by, node) that no start reaches."""
    return nodes.join(reachable(edges, starts, by=by), [*by, "node"], "left_anti")


def missed(asked: DataFrame, edges: DataFrame, starts: DataFrame, within: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, start, node: of asked(by, node) those of within(by, node) that the start(by, start) does not reach by edges between nodes of within."""
    kind = starts.schema["start"].dataType
    rows = _rows(by, edges, starts).unionByName(_ends(by, within, _SINK)).unionByName(_ends(by, asked, _ASKED))

    def rest(rows: DataFrame) -> DataFrame:
        of = lambda m, name: rows.filter(F.col("_kind") == m).select(*by, F.col("src").cast(kind).alias(name)).distinct()
        own, starts = of(_SINK, "node"), of(_TOP, "start")
        met = distances(rows.filter(F.col("_kind") == _EDGE).select(*by, "src", "dst"), starts, by=by, within=own)
        pairs = starts.join(of(_ASKED, "node").join(own, [*by, "node"], "left_semi"), list(by))
        return stage(pairs.join(met, [*by, "start", "node"], "left_anti").select(*by, "start", "node"), "missed")

    return _each_graph(rows, by, _walk_missed, ("start", "node"), kind, rest)


def bounded_paths(edges: DataFrame, starts: DataFrame, max_depth: int, by: Sequence[str] = ()) -> DataFrame:
    """by, start, node, len, path (nodes): every path of at most max_depth edges that repeats no edge, length zero included."""
    kept, found = _kept(edges, by), Rounds(edges.sparkSession, "paths")
    level = found.add(starts.select(*by, "start", F.col("start").alias("node"), F.lit(0).alias("len"), F.array("start").alias("path")).distinct())
    hops = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path")).alias("b"))
    again = F.exists(hops, lambda h: (h["a"] == F.col("src")) & (h["b"] == F.col("dst")))
    for depth in range(1, max_depth + 1):
        longer = level.withColumnRenamed("node", "src").join(kept, [*by, "src"]).filter(~again)
        level = found.add(longer.select(*by, "start", F.col("dst").alias("node"), F.lit(depth).alias("len"), F.concat("path", F.array("dst")).alias("path")))
    release(kept)
    return found.all()


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, by: Sequence[str] = (), to: DataFrame | None = None) -> DataFrame:
    """by, start, node, len, path: of each pair the shortest path, ties by the nodes; each round keeps a node's least path alone.  With to(by, node) only paths that end there."""

    def rounds(edges: DataFrame, starts: DataFrame, to: DataFrame | None) -> DataFrame:
        kept = _kept(edges, by)
        first = starts.select(*by, "start", F.col("start").alias("node"), F.lit(0).alias("len"), F.array("start").alias("path")).distinct()

        def advance(frontier: DataFrame, depth: int) -> DataFrame:
            step = frontier.withColumnRenamed("node", "src").join(kept, [*by, "src"])
            best = step.groupBy(*by, "start", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
            return best.select(*by, "start", "node", F.lit(depth).alias("len"), F.concat("path", F.array("node")).alias("path"))

        found = _search(first, [*by, "start", "node"], advance, max_depth)
        release(kept)
        # what is asked for may be deleted before the paths are read
        return found if to is None else stage(found.join(to, [*by, "node"], "left_semi"), "asked")

    return _searched(edges, starts, by, _walk_paths(max_depth, to is not None), ("start", "node", "len", "path"), rounds, to, _ASKED)


def contract(edges: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges between groups, and nodes(by, node, family): members(by, node, family) maps nodes to the group that stands for them.

    Ends in a group become the group; parallel edges collapse and loops stay.
    """
    m = members.select(*by, "node", "family")
    a, b = m.withColumnsRenamed({"node": "src", "family": "sf"}), m.withColumnsRenamed({"node": "dst", "family": "df"})
    met = edges.select(*by, "src", "dst").join(a, [*by, "src"], "left").join(b, [*by, "dst"], "left")
    return met.select(*by, F.coalesce("sf", F.col("src").cast("string")).alias("src"), F.coalesce("df", F.col("dst").cast("string")).alias("dst")).distinct(), m


def families(nodes: DataFrame, own_group: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, node, family, scopes, version: nodes(by, node, grp, scopes, version, ord) in cleared groups of two and more, without those of own_group."""
    if own_group is not None:
        nodes = nodes.filter(~F.col("grp").eqNullSafe(own_group))
    g = nodes.filter("grp is not null").withColumn("cleared", cleared_group(F.col("grp")))
    scopes = g.select(*by, "cleared", F.explode("scopes").alias("scope")).groupBy(*by, "cleared").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))
    groups = g.groupBy(*by, "cleared").agg(F.count("*").alias("n"), F.min_by("version", "ord").alias("version")).filter("n >= 2").drop("n")
    full = groups.join(scopes, [*by, "cleared"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    return g.select(*by, "node", "cleared").join(full, [*by, "cleared"]).select(*by, "node", F.concat(F.lit("family:"), F.col("cleared")).alias("family"), "scopes", "version")


def expand(nodes: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of nodes with node (text) replaced by the members of the families among them; other nodes stay as they are."""
    m = members.select(*by, F.col("family").alias("node"), F.col("node").cast("string").alias("_member"))
    text = nodes.withColumn("node", F.col("node").cast("string"))
    return text.join(m, [*by, "node"], "left").withColumn("node", F.coalesce("_member", "node")).select(*nodes.columns).distinct()


def sink_roots(edges: DataFrame, sink: DataFrame, cut: DataFrame, max_depth: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, node, root: for each sink node the cut nodes without parents in the sink from which it is reached inside the sink."""

    def joined(edges: DataFrame, sink: DataFrame, cut: DataFrame) -> DataFrame:
        inside = induced(edges, sink, by)
        tops = sink.join(inside.select(*by, F.col("dst").alias("node")), [*by, "node"], "left_anti").join(cut, [*by, "node"], "left_semi")
        return distances(inside, tops.withColumnRenamed("node", "start"), max_depth, by).select(*by, "node", F.col("start").alias("root"))

    edges, sink, cut = edges.select(*by, "src", "dst"), sink.select(*by, "node"), cut.select(*by, "node")
    if not by:
        return joined(edges, sink, cut)
    kind = sink.schema["node"].dataType
    rows = edges.select(*by, "src", "dst", _mark(_EDGE)).unionByName(_ends(by, sink, _SINK)).unionByName(_ends(by, cut, _CUT))

    def rest(rows: DataFrame) -> DataFrame:
        nodes = lambda mark: rows.filter(F.col("_kind") == mark).select(*by, F.col("src").cast(kind).alias("node"))
        return joined(rows.filter(F.col("_kind") == _EDGE).select(*by, "src", "dst"), nodes(_SINK), nodes(_CUT)).withColumnRenamed("root", "start")

    return _each_graph(rows, by, _walk_sinks(max_depth), ("node", "start"), kind, rest).select(*by, "node", F.col("start").alias("root"))


def degrees(calls: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, counting repeated calls(src, tgt)."""
    out = calls.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = calls.groupBy(F.col("tgt").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(into, "node", "full").select("node", zero("in_degree"), zero("out_degree"))


def call_vertices(calls: DataFrame) -> DataFrame:
    """node: the methods that call."""
    return calls.select(F.col("src").alias("node")).distinct()


def sizes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, vertices, edges: the counters of each graph."""
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(*by).agg(F.count("*").alias("vertices"))
    n = edges.groupBy(*by).agg(F.count("*").alias("edges"))
    return ends.join(n, list(by)) if by else ends.crossJoin(n)
