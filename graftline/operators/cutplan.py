"""The cuts of many projects, what each leaves to be met, and the joint solution of what is left, as kernels over the projects and runs of a partition (DOM08, DOM09, GR09-GR11, JN15-JN17).

The rules are those of ``mincut``, ``graph.sink_roots``, ``constraints.plan`` and ``constraints.solve``, which take them as joins over all tasks.  Here a project's rows are
dealt once, and a worker holds one project's graph; of the ecosystem it holds no more than the ways that can meet a run's constraints, which joins have found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.names import FRAMEWORK_GROUP
from graftline.operators.constraints import DEFAULT_LENGTH, MIN_PATH_LENGTH
from graftline.operators.mincut import all_cuts

_EDGE, _NODE, _TASK, _ROOT = 0, 1, 2, 3
_ROOTS = "array<struct<root: bigint, kin: bigint, version: string, same: boolean, bound: int>>"
#: One cut of a task: of the project's nodes the length of the shortest path from its root, whether a cut node is on it, and whether the node stays; around: the library's surroundings are asked for; wants: the other constraints in order.
_CUT = f"cut_ix int, weight double, cut_nodes array<bigint>, nodes array<bigint>, lens array<int>, through array<boolean>, kept array<boolean>, around boolean, wants array<struct<node: bigint, kin: bigint, same: boolean, roots: {_ROOTS}>>"
_FOUND = "cand bigint, version string, ways array<array<bigint>>, fresh array<bigint>"
#: Runs or cuts of a batch that leaves a worker.
_AT_ONCE = 500


def cleared(group: str | None) -> str | None:
    """As ``cleared_group``."""
    return FRAMEWORK_GROUP if group is not None and group.startswith(FRAMEWORK_GROUP) else group


class _Project:
    """One project's graph. nodes: node to (kin, grp, gav, version, ok, scoped)."""

    def __init__(self, edges: list[tuple[int, int]], nodes: dict[int, tuple], root: int):
        self.nodes, self.root, self.edges = nodes, root, set(edges)
        self.on = defaultdict(list)
        for a, b in sorted(self.edges):
            self.on[a].append(b)
        self.far: dict[int, dict[int, int]] = {}
        groups, own = defaultdict(list), nodes[root][1] if root in nodes else None
        for n, x in nodes.items():
            if x[1] is not None and x[1] != own and root in nodes:
                groups[cleared(x[1])].append(n)
        self.members = {f"family:{g}": sorted(ns) for g, ns in groups.items() if len(ns) > 1}
        self.family = {n: f for f, ns in self.members.items() for n in ns}
        compiled = {str(n) for n, x in nodes.items() if x[4] and n not in self.family} | {f for f, ns in self.members.items() if any(nodes[n][5] for n in ns)}
        pairs = {(self.name(a), self.name(b)) for a, b in self.edges}
        self.contracted = sorted((p for p in pairs if p[0] in compiled and p[1] in compiled), key=" ".join)
        # a breadth-first search in the order of nodes meets the least of the shortest paths first
        self.parent, self.dist = {root: root}, {root: 0}
        todo = [root]
        for x in todo:
            for y in self.on.get(x, ()):
                if y not in self.dist:
                    self.dist[y], self.parent[y] = self.dist[x] + 1, x
                    todo.append(y)

    def name(self, n: int) -> str:
        return self.family.get(n) or str(n)

    def expand(self, names: set[str]) -> set[int]:
        return {m for n in names for m in (self.members[n] if n in self.members else (int(n),))}

    def length(self, start: int, node: int) -> int | None:
        if start not in self.far:
            dist, todo = {start: 0}, [start]
            for x in todo:
                for y in self.on.get(x, ()):
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        todo.append(y)
            self.far[start] = dist
        return self.far[start].get(node)

    def roots(self, sink: set[int], cut: set[int]) -> dict[int, list[int]]:
        """node, roots: the cut's nodes without parents in the sink that reach it there."""
        inside = {a: [b for b in bs if b in sink] for a, bs in self.on.items() if a in sink}
        entered = {b for bs in inside.values() for b in bs}
        out = defaultdict(list)
        for top in sorted(cut & sink - entered):
            seen, todo = {top}, [top]
            for x in todo:
                out[x].append(top)
                for y in inside.get(x, ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return out

    def plan(self, lib: int, roots: dict[int, list[int]]) -> tuple[bool, list[tuple]]:
        """Whether the library's surroundings are asked for, and (node, kin, same, roots (root, kin, version, same, bound)) of the constraints, as ``constraints.plan``."""
        far = lambda n: (n == lib, n not in self.dist, self.dist.get(n, 0), n)
        of, own_group = self.nodes, cleared(self.nodes[lib][1]) if lib in self.nodes else None
        around, out, done = False, [], set()
        for n in sorted((n for n in roots if n in of), key=far):
            fams: dict[str, tuple] = {}
            for r in roots[n]:
                if r in of:
                    f, g = self.name(r), of[r][2]
                    fams[f] = (min(g, fams[f][0]), min(r, fams[f][1])) if f in fams else (g, r)
            if n != lib:
                own = self.name(n)
                fams = {f: x for f, x in fams.items() if (own, f) not in done}
                done.update((own, f) for f in fams)
            group, single = cleared(of[n][1]), len(fams) == 1
            if single and n == lib:
                (f, (_, r)), = fams.items()
                if cleared(of[r][1]) == group or r == lib:
                    around = True
                    continue
                chosen = [(f, r)]
            elif len(fams) > 1:
                best: dict[str | None, tuple] = {}
                for f, (g, r) in fams.items():
                    key = cleared(of[r][1]) if f in self.members else of[r][1]
                    best[key] = min(best.get(key, (g, r, f)), (g, r, f))
                chosen = [(f, r) for _, r, f in best.values() if cleared(of[r][1]) != group]
            else:
                continue
            if chosen:
                out.append((n, of[n][0], group == own_group, sorted((self._stand_in(f, r, n, single) for f, r in chosen), key=lambda x: x[0])))
        # a member that is no artifact has no facts, and cannot be met
        described = lambda m: (of[m][0], of[m][3], cleared(of[m][1]) == own_group) if m in of else (None, None, False)
        return around, [(n, kin, same, [(m, *described(m), bound) for m, bound in rs]) for n, kin, same, rs in out]

    def _stand_in(self, family: str, root: int, node: int, single: bool) -> tuple[int, int]:
        """The member that is nearest to the node, and its bound."""
        is_family = family in self.members
        least = min(((n := self.length(m, node)) is None, n or 0, m) for m in (self.members[family] if is_family else (root,)))
        default = least[0] or (single and not is_family)
        return least[2], max(DEFAULT_LENGTH if default else least[1], MIN_PATH_LENGTH)

    def cuts(self, lib: int) -> Iterator[tuple]:
        s, t = str(self.root), self.name(lib)
        names = {x for p in self.contracted for x in p} | {s, t}
        for ix, (weight, cut, side) in enumerate(all_cuts(self.contracted, s, t)):
            sink = names - side
            sunk, kept = self.expand(sink), self.expand(side)
            ends = self.expand({x for e in cut for x in self.contracted[e] if x in sink})
            around, wants = self.plan(lib, self.roots(sunk, ends))
            through: dict[int, bool] = {}
            for n, p in self.parent.items():  # parents come first
                through[n] = n in ends or (p != n and through[p])
            nodes = sorted(self.nodes.keys() | self.dist.keys() | kept)
            yield ix, weight, sorted(ends), nodes, [self.dist.get(n) for n in nodes], [through.get(n, False) for n in nodes], [n in kept for n in nodes], around, wants


def _batches(rows: list[tuple], schema: T.StructType, arrow: pa.Schema) -> pa.RecordBatch:
    """Rows, with structs as tuples, as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([_named(r[i], f.dataType) for r in rows], t) for i, (f, t) in enumerate(zip(schema.fields, arrow.types, strict=True))], schema=arrow)


def _named(x, kind: T.DataType):
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [_named(e, kind.elementType) for e in x]
    if isinstance(kind, T.StructType):
        return {f.name: _named(e, f.dataType) for f, e in zip(kind.fields, x, strict=True)}
    return x


def _mapped(rows: DataFrame, schema: T.StructType, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in made(batches):
            out.append(row)
            if len(out) >= _AT_ONCE:
                yield _batches(out, schema, arrow)
                out = []
        if out:
            yield _batches(out, schema, arrow)

    return rows.mapInArrow(run, schema)


def planned_cuts(tasks: DataFrame, projects: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """task_id, project, lib and the columns of a cut for tasks(task_id, project, lib), projects(project, root), nodes(project, node, kin, grp, gav, version, ok, scoped), links(project, src, dst).

    kin is the same for what may stand for a node and null where nothing may; ok: a compile artifact that is no test library, scoped: a compile artifact.
    """
    none = lambda t: F.lit(None).cast(t)
    wanted = tasks.select("project").distinct()
    flags: Callable[[int, Column, Column], list[Column]] = lambda kind, a, b: ["project", F.lit(kind).cast("byte").alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b")]
    bare = [none("string").alias(c) for c in ("grp", "gav", "version")] + [none("boolean").alias(c) for c in ("ok", "scoped")]
    of_tasks = lambda df: df.join(wanted, "project", "left_semi")
    rows = of_tasks(links).select(*flags(_EDGE, F.col("src"), F.col("dst")), *bare)
    rows = rows.unionByName(of_tasks(nodes).select(*flags(_NODE, F.col("node"), F.col("kin")), "grp", "gav", "version", "ok", "scoped"))
    rows = rows.unionByName(tasks.select(*flags(_TASK, F.col("task_id"), F.col("lib")), *bare)).unionByName(of_tasks(projects).select(*flags(_ROOT, F.col("root"), F.col("root")), *bare))
    schema = T.StructType([T.StructField("task_id", T.LongType()), T.StructField("project", tasks.schema["project"].dataType), T.StructField("lib", T.LongType()), *T._parse_datatype_string(_CUT).fields])

    def of(project, lines: list[tuple]) -> Iterator[tuple]:
        by = defaultdict(list)
        for kind, *row in lines:
            by[kind].append(row)
        for root in {r[0] for r in by[_ROOT]}:
            graph = _Project([(a, b) for a, b, *_ in by[_EDGE]], {a: tuple(x) for a, *x in by[_NODE]}, root)
            for task, lib, *_ in by[_TASK]:
                for cut in graph.cuts(lib):
                    yield (task, project, lib, *cut)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, lines = None, []
        for batch in batches:
            for project, *line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if project != at:
                    if lines:
                        yield from of(at, lines)
                    at, lines = project, []
                lines.append(line)
        if lines:
            yield from of(at, lines)

    return _mapped(rows.repartition("project").sortWithinPartitions("project"), schema, made)


def _least(ways: list[list[tuple]]) -> tuple | None:
    """The least (hops, [(root, eco)], [path]) of one way of each root, which have no edge in common; ways: of each root (hops, eco, path, edges) in order."""
    best, n = None, len(ways)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + ways[i][0][0]
    # by the number of edges first: what is longer than the best so far is left
    todo = [(0, 0, (), (), frozenset())]
    while todo:
        i, size, picks, paths, used = todo.pop()
        if best is not None and size + least[i] > best[0]:
            continue
        if i == n:
            best = min(best or (size, picks, paths), (size, picks, paths))
            continue
        most = len(ways[i]) if best is None else bisect_left(ways[i], best[0] - size - least[i + 1] + 1, key=lambda w: w[0])
        for hops, eco, path, edges in reversed(ways[i][:most]):
            if not used & edges:
                todo.append((i + 1, size + hops, (*picks, eco), (*paths, path), used | edges))
    return best


def solution(lib: int, wants: list[dict], tries: list[dict], ways: list[dict]) -> tuple | None:
    """cand, version, paths and newly bound roots of the first of tries(pos, cand, version) by which all wants are met in order; ways(place, i, src, src_version, dst, dst_version, path)."""
    held: dict[tuple, list] = defaultdict(list)
    for w in ways:
        path = tuple(w["path"])
        held[w["place"], w["i"]].append((len(path) - 1, w["src"], path, frozenset(zip(path, path[1:], strict=False)), w["dst"], w["src_version"], w["dst_version"]))
    for rows in held.values():
        rows.sort(key=lambda r: (r[0], r[1], r[2]))
    for t in tries:
        bound, paths, fresh = {lib: t["cand"]}, [(t["cand"],)], []
        for place, want in enumerate(wants):
            node, by_end = want["node"], defaultdict(list)
            for i, r in enumerate(want["roots"]):
                ends = defaultdict(list)
                for hops, src, path, edges, dst, src_version, dst_version in held[place, i]:
                    to_fits = bound[node] == dst if node in bound else (not want["same"] or (dst_version is not None and dst_version == t["version"]))
                    if r["root"] in bound:
                        fits = bound[r["root"]] == src
                    elif src_version is None:
                        fits = False
                    else:
                        fits = src_version == t["version"] if r["same"] else r["version"] is not None and src_version >= r["version"]
                    if to_fits and fits:
                        ends[dst].append((hops, src, path, edges))
                for dst, rows in ends.items():
                    by_end[dst].append(rows)
            met = ((b[0], dst, b[1], b[2]) for dst, rows in by_end.items() if len(rows) == len(want["roots"]) and (b := _least(rows)))
            best = min(met, default=None)
            if best is None:
                break
            _, to, picks, chosen = best
            paths += chosen
            for n, eco in [(node, to), *zip((r["root"] for r in want["roots"]), picks, strict=True)]:
                if n not in bound:
                    bound[n] = eco
                    if n != node:
                        fresh.append(eco)
        else:
            return t["cand"], t["version"], [list(p) for p in dict.fromkeys(paths)], fresh
    return None


def solutions(runs: DataFrame) -> DataFrame:
    """run, cand, version, ways, fresh of the runs(run, lib, wants, tries, ways) that can be met."""
    schema = T.StructType([T.StructField("run", T.StringType()), *T._parse_datatype_string(_FOUND).fields])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if found := solution(row["lib"], row["wants"], row["tries"], row["ways"]):
                    yield (row["run"], *found)

    return _mapped(runs.select("run", "lib", "wants", "tries", "ways"), schema, made)
