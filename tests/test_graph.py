import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graftline.operators import constraints, graph, matching, mincut


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=14))
@settings(max_examples=150, deadline=None)
def test_min_cut_equals_brute_force(pairs):
    edges = [(str(a), str(b)) for a, b in pairs]
    weight, cut, side = mincut.min_cut(edges, [1.0] * len(edges), "0", "6")
    inner = [str(i) for i in range(1, 6)]
    best = min(sum((a in s) != (b in s) for a, b in edges) for n in range(6) for c in itertools.combinations(inner, n) for s in [{"0", *c}])
    assert weight == best == len(cut) and "0" in side and "6" not in side
    assert all((edges[i][0] in side) != (edges[i][1] in side) for i in cut)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_alternative_cuts_are_cuts(pairs):
    edges = [(str(a), str(b)) for a, b in pairs]
    found = mincut.all_cuts(edges, "0", "5")
    assert len({tuple(c) for _, c, _ in found}) == len(found)
    for _, cut, side in found:
        assert cut == [i for i, (a, b) in enumerate(edges) if (a in side) != (b in side)]


def dag(n=30, m=70, seed=1):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def bfs(edges, start, most=10**9):
    dist, todo = {start: 0}, [start]
    for x in todo:
        for a, b in edges:
            if a == x and b not in dist and dist[x] < most:
                dist[b] = dist[x] + 1
                todo.append(b)
    return dist


def test_traversals_equal_plain_search(spark):
    pairs = dag() + [(29, 3)]  # with a cycle
    e, s = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,), (3,)], "start long")
    got = {(r.start, r.node): r.dist for r in graph.distances(e, s).collect()}
    want = {(i, n): d for i in (0, 3) for n, d in bfs(pairs, i).items()}
    assert got == want
    assert {r.node for r in graph.reachable(e, s).collect()} == {n for _, n in want}
    short = {(r.start, r.node): r.len for r in graph.shortest_paths(e, s, 3).collect()}
    assert short == {k: d for k, d in want.items() if d <= 3}


def test_paths_repeat_no_edge(spark):
    e, s = spark.createDataFrame([(1, 2), (2, 1), (2, 2)], "src long, dst long"), spark.createDataFrame([(1,)], "start long")
    got = sorted(r.path for r in graph.bounded_paths(e, s, 5).collect())
    assert got == [[1], [1, 2], [1, 2, 1], [1, 2, 2], [1, 2, 2, 1]]


def test_contraction(spark):
    nodes = spark.createDataFrame([(1, "g", ["c"], "1", 1), (2, "g", ["t"], "2", 2), (3, "h", ["c"], "1", 3), (4, "org.springframework.a", [], "1", 4), (5, "org.springframework.b", [], "1", 5)], "node long, grp string, scopes array<string>, version string, ord int")
    fam = graph.families(nodes, None)
    assert {(r.node, r.family, r.version) for r in fam.collect()} == {(1, "family:g", "1"), (2, "family:g", "1"), (4, "family:org.springframework", "1"), (5, "family:org.springframework", "1")}
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (3, 5)], "src long, dst long")
    got = {(r.src, r.dst) for r in graph.contract(e, fam)[0].collect()}
    assert got == {("family:g", "family:g"), ("family:g", "3"), ("3", "family:org.springframework")}
    back = graph.expand(spark.createDataFrame([("family:g",), ("3",)], "node string"), fam)
    assert {r.node for r in back.collect()} == {"1", "2", "3"}


def test_matching(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "z", "x")], "id int, g string, a string")
    right = spark.createDataFrame([("a", None, 2, "late"), ("a", None, 1, "early"), ("a", "x", 5, "five")], "g string, a string, ord int, v string")
    assert {r.id: r.v for r in matching.match_first(left, right, ["g", "a"], "ord", "v").collect()} == {1: "early", 2: "five", 3: None}
    loose = matching.match_loose(left, right, [("g", "g")], "ord", "v", ["id"])
    assert {r.id: r.v for r in loose.collect()} == {1: "early", 2: "early", 3: None}
    every, some = spark.createDataFrame([("a",), ("b",)], "n string"), spark.createDataFrame([("b",)], "n string")
    assert [r.n for r in matching.filter_queue(every, some, some, "n").collect()] == ["b"]
    assert [r.n for r in matching.filter_queue(every, some.limit(0), some, "n").collect()] == ["a"]


@pytest.mark.parametrize("roots, kind", [([(7, 7)], "AROUND"), ([(7, 1)], "FROM_ROOT"), ([(8, 1)], None), ([(8, 1), (8, 2)], "SHARED")])
def test_constraints_by_number_of_roots(spark, roots, kind):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = df([(0, n, f"g{n}", "a", "1") for n in (1, 2, 7, 8)], "project long, node long, grp string, artifact string, version string")
    dist = "project long, node long, dist int"
    lengths = df([(0, 1, 8, 9)], "project long, start long, node long, dist int")
    planned = constraints.plan(df([(1, 0, 7)], "run long, project long, lib long"), df([(1, *r) for r in roots], "run long, node long, root long"), nodes, nodes.select("project", "node", nodes.grp.alias("family")).limit(0), df([(0, 8, 3), (0, 1, 1)], dist), lengths)
    got = planned.collect()
    assert [r.kind for r in got] == ([kind] if kind else [])
    if kind == "SHARED":
        assert [(r.root, r.bound) for r in got[0].roots] == [(1, 9), (2, 5)]


def test_paths_of_a_constraint_share_no_edge(spark):
    """The only way of the first root leads over the second one's only edge, until another edge is there."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = df([(0, n, f"g{n}", "a", "1") for n in (1, 2, 7, 8)], "project long, node long, grp string, artifact string, version string")
    eco = df([(n, f"g{n}", "a", "1") for n in (1, 2, 7, 8)] + [(20, "g2", "a", "0"), (9, "x", "x", "1")], "node long, grp string, artifact string, version string")
    plan = df([("r", 0, 8, "SHARED", 1, [(1, 5), (2, 5)])], "run string, project long, node long, kind string, place int, roots array<struct<root:long,bound:int>>")
    tries = df([("t", "r", 0, 7, "1", 7)], "try string, run string, project long, lib long, version string, cand long")
    edges = [(1, 2), (2, 8), (7, 9)]
    assert constraints.solve(tries, plan, nodes, eco, df(edges, "src long, dst long"))[0].count() == 0
    solved, sub, found = constraints.solve(tries, plan, nodes, eco, df([*edges, (1, 9), (9, 8)], "src long, dst long"))
    assert solved.count() == 1 and {r.node for r in sub.collect()} == {1, 2, 7, 8, 9}
    assert {(r.src, r.dst) for r in found.collect()} == {(1, 9), (9, 8), (2, 8), (1, 2)}


def test_loose_matches_need_no_first_characters(spark):
    left = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, "f"), (4, "xyz")], "id int, g string")
    right = spark.createDataFrame([("--abcdefg", 1, "one"), ("f", 2, "two")], "g string, ord int, v string")
    assert {r.id: r.v for r in matching.match_loose(left, right, [("g", "g")], "ord", "v", ["id"]).collect()} == {1: "one", 2: "one", 3: "one", 4: None}


def test_undirected_and_reversed(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (2, 3, "z")], "src long, dst long, kind string")
    assert {tuple(r) for r in graph.reversed_edges(e).collect()} == {(2, 1, "x"), (1, 2, "y"), (3, 2, "z")}
    assert {tuple(r) for r in graph.undirected(e).collect()} == {(a, b, 1.0) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2))}
