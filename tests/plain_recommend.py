"""The rules of an update, task by task in plain Python, for comparison with the set-oriented operators."""

from collections import defaultdict
from itertools import product

from graftline.operators import mincut


def shortest(edges, start):
    """Shortest paths from start, ties by the nodes."""
    found, level = {start: [start]}, [start]
    while level:
        new = {}
        for x in level:
            for y in edges.get(x, ()):
                if y not in found and (y not in new or found[x] + [y] < new[y]):
                    new[y] = found[x] + [y]
        found |= new
        level = list(new)
    return found


def walks(edges, start, most):
    """All paths of at most most edges that repeat no edge, as tuples of nodes."""
    todo, out = [((start,), frozenset())], []
    while todo:
        path, used = todo.pop()
        out.append(path)
        if len(path) <= most:
            todo += [((*path, y), used | {(path[-1], y)}) for y in edges.get(path[-1], ()) if (path[-1], y) not in used]
    return out


def hops(path):
    return list(zip(path, path[1:], strict=False))


class Plain:
    def __init__(self, t):
        """t: the tables of Inputs as lists of dicts."""
        self.t = t
        self.eco = {r["node"]: r for r in t["eco_nodes"]}
        self.eco_edges = defaultdict(set)
        for r in t["eco_edges"]:
            self.eco_edges[r["src"]].add(r["dst"])
        self.docs, self.checks = {r["gav"] for r in t["docs"]}, {(r["base"], r["next"], r["kind"]) for r in t["checks"]}
        self.known, self.bodies = defaultdict(list), defaultdict(list)
        for r in t["incompatibilities"]:
            self.known[r["base"], r["next"], r["kind"]].append(r)
        for r in t["semantic"]:
            self.bodies[r["base"], r["next"]].append(r)
        self.of = {k: defaultdict(list) for k in ("artifacts", "deps", "calls", "projects")}
        for k, rows in self.of.items():
            for r in t[k]:
                rows[r["project"]].append(r)

    def gav(self, r):
        return f"{r['grp']}:{r['artifact']}:{r['version']}"

    def load(self, project):
        self.art = {r["node"]: r for r in self.of["artifacts"][project]}
        self.dep, self.up = defaultdict(set), defaultdict(set)
        for r in self.of["deps"][project]:
            self.dep[r["src"]].add(r["dst"])
            self.up[r["dst"]].add(r["src"])
        self.root, self.has_calls = self.of["projects"][project][0]["root"], self.of["projects"][project][0]["has_calls"]
        self.calls = self.of["calls"][project]
        self.paths = shortest(self.dep, self.root)
        groups = defaultdict(list)
        for n, r in self.art.items():
            if r["grp"] != self.art[self.root]["grp"]:
                groups[r["grp"]].append(n)
        self.family = {n: f"family:{g}" for g, ns in groups.items() if len(ns) > 1 for n in ns}
        self.members = defaultdict(list)
        for n, f in self.family.items():
            self.members[f].append(n)

    def name(self, n):
        return self.family.get(n, str(n))

    def expand(self, names):
        return {m for n in names for m in (self.members[n] if n in self.members else [int(n)])}

    def violations(self, nodes, decide, unupdated, skip_family):
        """Rows of (problem, calls)."""
        out = []
        for n in sorted(nodes):
            new = self.eco[n]
            old = min((m for m, r in self.art.items() if (r["grp"], r["artifact"]) == (new["grp"], new["artifact"])), default=None)
            if old is None or self.art[old]["version"] == new["version"]:
                continue
            what = decide(old, n)
            if what == "FORWARD":
                out.append((None, 1))
            if what != "CHECK":
                continue
            if not self.has_calls:
                out.append(("EMPTY_CG", 0))
                continue
            risky = [c for c in self.calls if c["dst"] == old and c["src"] in unupdated and not (skip_family and self.art[c["src"]]["grp"] == self.art[old]["grp"])]
            if not risky:
                continue
            pair = self.gav(self.art[old]), self.gav(new)
            kinds = {"SRC" if c["src"] == self.root else "BINARY" for c in risky}
            if any((*pair, k) not in self.checks for k in kinds) or not set(pair) <= self.docs:
                out.append(("FAILED_SIGTEST", 0))
                continue
            n_calls = 0
            for c in risky:
                for i in self.known[*pair, "SRC" if c["src"] == self.root else "BINARY"]:
                    if i["class_name"] == c["tgt_class"]:
                        gone = not i["methods"] and not i["fields"] and not i["interfaces"]
                        n_calls += gone or any((m["name"], m["return_type"], m["params"]) == (c["name"], c["return_type"], c["params"]) for m in i["methods"] or [])
                n_calls += sum(b["start_method"] == c["signature"] for b in self.bodies[pair])
            out.append((None, n_calls))
        return out

    def constraints(self, lib, sink, cut):
        """(kind, shared node, [(root, bound)]) in order."""
        def tops(n):
            seen, todo, found = set(), [n], set()
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                ups = [u for u in self.up[x] if u in sink]
                todo += ups
                if not ups and x in cut:
                    found.add(x)
            return found

        far = lambda n: (len(self.paths[n]) if n in self.paths else 10**9, n)
        roots = {n: {self.name(r): r for r in sorted(tops(n), reverse=True)} for n in sink}
        done = defaultdict(set)
        for n in sorted((n for n in sink if n != lib), key=far):
            own = done[self.name(n)]
            for f in list(roots[n]):
                if f in own:
                    del roots[n][f]
                own.add(f)
        out = []
        for n in sorted(sink, key=lambda n: (n == lib, far(n))):
            grp, fams = self.art[n]["grp"], roots[n]

            def stand_in(f, shared=n):
                best = None
                for m in sorted(self.members.get(f, [fams[f]])):
                    path = shortest(self.dep, m).get(shared)
                    if path and (best is None or len(path) - 1 < best[1]):
                        best = m, len(path) - 1
                return best or (min(self.members.get(f, [fams[f]])), 3)

            if len(fams) == 1 and n == lib:
                f, r = next(iter(fams.items()))
                if r == lib or self.art[r]["grp"] == grp:
                    out.append(("AROUND", n, []))
                else:
                    m, length = stand_in(f) if f in self.members else (r, 3)
                    out.append(("FROM_ROOT", n, [(m, max(5, length))]))
            elif len(fams) > 1:
                groups = defaultdict(list)
                for f, r in fams.items():
                    groups[self.art[r]["grp"]].append((self.gav(self.art[r]), f))
                rs = [stand_in(min(g)[1]) for k, g in groups.items() if k != grp]
                if rs:
                    out.append(("SHARED", n, sorted((m, max(5, length)) for m, length in rs)))
        return out

    def solve(self, lib, version, cand, plan):
        """Nodes and edges of the sub-graph, or None."""
        bound, paths = {lib: cand}, [(cand,)]
        fresh = []
        own = self.art[lib]["grp"]

        def options(n, least):
            if n in bound:
                return [bound[n]]
            r = self.art[n]
            ok = lambda v: v == version if r["grp"] == own else not least or v >= r["version"]
            return [e for e, x in self.eco.items() if (x["grp"], x["artifact"]) == (r["grp"], r["artifact"]) and ok(x["version"])]

        for kind, n, roots in plan:
            if kind == "AROUND":
                paths += walks(self.eco_edges, cand, 3)
                continue
            best = None
            for to in options(n, False):
                ways = []
                for r, most in roots:
                    ways.append([(r, w) for e in options(r, True) for w in walks(self.eco_edges, e, most) if w[-1] == to])
                for combo in product(*ways):
                    used = [h for _, w in combo for h in hops(w)]
                    if len(set(used)) == len(used):
                        key = (len(used), to, [(r, w[0]) for r, w in combo], [w for _, w in combo])
                        best = key if best is None or key < best else best
            if best is None:
                return None
            _, to, picks, ways = best
            paths += ways
            for m, e in [(n, to), *picks]:
                if m not in bound:
                    bound[m] = e
                    if m != n:
                        fresh.append(e)
        for e in fresh:
            paths += sorted(walks(self.eco_edges, e, 3), key=lambda w: (len(w), w))[:10]
        return {x for p in paths for x in p}, {h for p in paths for h in hops(p)}

    def contracted(self):
        text = lambda n: self.name(n)
        scopes = defaultdict(set)
        for n, r in self.art.items():
            scopes[text(n)] |= set(r["scopes"])
        edges = {(text(a), text(b)) for a, bs in self.dep.items() for b in bs}
        return sorted((e for e in edges if "compile" in scopes[e[0]] and "compile" in scopes[e[1]]), key=" ".join)

    def min_cut(self, lib, candidates):
        """(cut_ix, weight, version, status, violations, calls, steps); candidates: (pos, version, node) in order."""
        edges, out = self.contracted(), []
        for ix, (weight, cut, side) in enumerate(mincut.all_cuts(edges, str(self.root), self.name(lib))):
            names = {x for e in edges for x in e} | {str(self.root), self.name(lib)}
            ends = self.expand({x for i in cut for x in edges[i] if x not in side})
            sink, source = self.expand(names - side), self.expand(side)
            plan = self.constraints(lib, sink, ends)
            weight = int(weight + 0.5)
            found = next(((v, s) for _, v, c in candidates if (s := self.solve(lib, v, c, plan))), None)
            if found is None:
                out.append((ix, weight, None, "NO_NEO4J_ENTRY", -1, 0, None))
                continue
            version, (nodes, sub) = found
            graph = defaultdict(set)
            for a, b in sub:
                graph[a].add(b)
            match = lambda n: min((e for e in nodes if (self.eco[e]["grp"], self.eco[e]["artifact"]) == (self.art[n]["grp"], self.art[n]["artifact"])), default=None)
            lens = [shortest(graph, m) for m in {match(n) for n in ends} - {None}]

            def decide(old, new, ends=ends, lens=lens):
                path = self.paths[old]
                if set(path) & ends:
                    return "CHECK"
                d = min((len(p[new]) - 1 for p in lens if new in p), default=None)
                return "SKIP" if d is None else "CHECK" if len(path) - 1 >= d + 1 else "FORWARD"

            rows = self.violations(nodes, decide, source, True)
            status = "EMPTY_CG" if any(p == "EMPTY_CG" for p, _ in rows) else "FAILED_SIGTEST" if any(p for p, _ in rows) else "SUCCESS"
            ok = status == "SUCCESS"
            steps = set()
            for n in nodes - {b for _, b in sub}:
                olds = [r for r in self.art.values() if (r["grp"], r["artifact"]) == (self.eco[n]["grp"], self.eco[n]["artifact"])]
                if olds:
                    steps.add((self.gav(min(olds, key=lambda r: r["ord"])), self.gav(self.eco[n])))
            for n in ends:
                near = match(n)
                if near is None:
                    r = self.art[n]
                    near = min((e for e in nodes if r["grp"] in self.eco[e]["grp"] and r["artifact"] in self.eco[e]["artifact"]), default=None)
                if near is not None:
                    steps.add((self.gav(self.art[n]), self.gav(self.eco[near])))
            out.append((ix, weight, version, status, sum(c > 0 for _, c in rows) if ok else -1, sum(c for _, c in rows) if ok else -1, sorted(steps)))
            if not ok or not rows:
                break
        return out
