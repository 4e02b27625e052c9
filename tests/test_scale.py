"""What makes the project-wide queries fit large tables: each is held against the plain way."""

import dataclasses
import os
import random

import pytest
from pyspark.sql import functions as F

from graftline.operators import compat, constraints, graph, mincut, recommend
from graftline.plans import derived, graph_queries
from graftline.staging import stage

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@tables
def test_tables_of_a_batch_are_made_when_asked_for(spark, monkeypatch):
    """Checking tasks and picking versions needs no pairs of versions, which grow by the square."""
    made, write = [], derived.stage
    monkeypatch.setattr(derived, "stage", lambda df, name: made.append(name) or write(df, name))
    x = derived.batch_inputs(spark, SMALL)
    assert recommend.validated(derived.batch_tasks(x), x).count() > 0
    assert made == ["items", "artifacts"]
    assert x.deps.count() > 0 and x.deps is x.deps and made == ["items", "artifacts", "deps"]


@tables
def test_checks_between_asked_pairs_are_those_of_the_whole_tables(spark):
    x = derived.batch_inputs(spark, SMALL)
    asked = x.checks.select("base", "next").distinct().filter("hash(base, next) % 3 <> 0").cache()
    absent = spark.createDataFrame([("no:such:1", "no:such:2")], "base string, next string")
    assert asked.count() > 0
    for part, whole in zip(x.between(asked.unionByName(absent).unionByName(asked)), (x.checks, x.incompatibilities, x.semantic), strict=True):
        columns = [c for c in whole.columns if c != "inc_id"]
        want = whole.join(asked, ["base", "next"], "left_semi").select(columns).collect()
        assert sorted(map(str, part.select(columns).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("depth", [None, 2])
def test_small_graphs_are_searched_without_rounds(spark, monkeypatch, depth):
    rng = random.Random(5)
    pairs = [(g, *(rng.randint(0, 8) for _ in "ab")) for g in range(30) for _ in range(12)] + [(30, i, i + 1) for i in range(12)] + [(31, None, 2), (31, 1, None), (None, 1, 2)]
    tops = [(g, rng.randint(0, 9)) for g in range(31) for _ in range(2)] + [(31, 1), (None, 1), (40, 7)]
    e, s = spark.createDataFrame(pairs, "g int, src long, dst long"), spark.createDataFrame(tops, "g int, start long")
    for search in (graph.distances, graph.nearest, graph.shortest_paths):
        clean = e.filter("g < 31"), s.filter("g is not null")
        with monkeypatch.context() as m:
            m.setattr(graph, "Rounds", None)  # a chain would take a round for each edge
            quick = search(*clean, max_depth=depth, by=["g"]).collect()
        both = search(e, s, max_depth=depth, by=["g"]).collect() if depth else quick
        with monkeypatch.context() as m:
            m.setattr(graph, "SMALL", -1)
            assert sorted(map(str, search(*clean, max_depth=depth, by=["g"]).collect())) == sorted(map(str, quick)) and quick
            if depth:
                assert sorted(map(str, search(e, s, max_depth=depth, by=["g"]).collect())) == sorted(map(str, both))


def test_first_versions_are_found_without_all_candidates(spark, monkeypatch):
    rng = random.Random(3)
    versions = [("g", f"a{a}", rng.choice(["", "v"]) * (rng.random() < 0.1) + f"{rng.randint(1, 9)}.{rng.randint(0, 4)}", rng.randint(0, 20)) for a in range(4) for _ in range(25)] + [("g", "a0", None, 0)]
    eco = [(i, g, a, v) for i, (g, a, v, _) in enumerate(versions) if i % 3]
    tasks = [(i, i, 1, rng.choice(["1.0", "3", "5.2", "9.9", "10", "4-rc"])) for i in range(60)]
    part = lambda rows, schema: spark.createDataFrame(rows, schema)
    none = spark.range(0)
    arts = part([(i, 1, "g", f"a{i % 5}", "1", ["compile"], 1) for i in range(60)], "project long, node long, grp string, artifact string, version string, scopes array<string>, ord long")
    x = recommend.Inputs(none, arts, none, part(versions, "grp string, artifact string, version string, pos long"), part(eco, "node long, grp string, artifact string, version string"), none, none, none, none, none, none)
    t = part(tasks, "task_id long, project long, lib long, target string")
    least = {}
    for n, g, a, v in eco:
        least[g, a, v] = min(n, least.get((g, a, v), n))
    want = {i: None for i, *_ in tasks}
    for r in recommend.candidates(t, x).collect():
        if (c := least.get((r.grp, r.artifact, r.version))) is not None:
            want[r.task_id] = min(want[r.task_id] or (r.pos, c, r.version), (r.pos, c, r.version))
    monkeypatch.setattr(recommend, "candidates", None)
    got = {r.task_id: (r.cand, r.cand_version) for r in recommend.pick_versions(t, x).collect()}
    assert got == {k: (w[1:] if w else (None, None)) for k, w in want.items()} and any(want.values()) and not all(want.values())


def test_a_second_lookup_asks_for_what_is_new_alone(spark, monkeypatch):
    made, write = [], compat.stage
    monkeypatch.setattr(compat, "stage", lambda df, name: made.append(name) or write(df, name))
    rows = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    pairs = [(a, b) for a in range(12) for b in range(12)] + [(3, 4), (None, 4)]
    docs, more_docs = {*range(0, 8)}, {8, 9, 9}
    checks, more_checks = {p for p in pairs[:144] if sum(p) % 3}, {p for p in pairs[:144] if sum(p) % 6 == 0}
    asked = []

    def generate(missing):
        asked.extend(tuple(r) for r in missing.collect())
        return rows([(d,) for d in more_docs], "gav"), rows(sorted(more_checks) * 2, "base next")

    good = lambda p, d, c: "SUCCESS" if p[0] in d and p[1] in d and p in c else "FAILED_SIGTEST"
    got = compat.lookup_again(rows(pairs, "base next"), rows([(d,) for d in docs] * 2, "gav"), rows(sorted(checks), "base next"), generate).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*p, good(p, docs | more_docs, checks | more_checks))) for p in pairs)
    assert sorted(map(str, asked)) == sorted(str(p) for p in pairs if good(p, docs, checks) != "SUCCESS") and made == ["first"]


def test_tries_are_solved_in_waves_up_to_the_first(spark, monkeypatch):
    rows = [(f"{r}/{p}", r, 1, 1, p, str(p), 100 + p, p) for r in "abc" for p in range(1, 8)]
    tries = spark.createDataFrame(rows, "try string, run string, project long, lib long, pos long, version string, cand long, rank int")
    good, waves = {"a": {1, 2}, "b": {4, 6}, "c": set()}, []

    def solve(wave, *_):
        have = wave.select("try", "run", "pos").collect()
        waves.append({(r.run, r.pos) for r in have})
        hit = wave.filter(" or ".join(f"run = '{k}' and pos in (0, {', '.join(map(str, v)) or 0})" for k, v in good.items()))
        return hit.select("try"), stage(hit.selectExpr("try", "cand as node"), "nodes"), stage(hit.selectExpr("try", "cand as src", "cand + 1 as dst"), "edges")

    monkeypatch.setattr(recommend.constraints, "solve", solve)
    x = recommend.Inputs(*[None] * 11)
    first, sub, lines = recommend.first_solved(tries, None, x)
    assert sorted((r.run, r.pos) for r in first.collect()) == [("a", 1), ("b", 4)]
    assert sorted((r.run, r.node) for r in sub.collect()) == [("a", 101), ("b", 104)] and sorted((r.run, r.dst) for r in lines.collect()) == [("a", 102), ("b", 105)]
    assert waves == [{(r, 1) for r in "abc"}, {(r, p) for r in "bc" for p in range(2, 6)}, {("c", 6), ("c", 7)}]


def _plain_sinks(pairs, sink, cut):
    """graph, node, root by plain walks."""
    out = set()
    for g in {g for g, _ in sink}:
        side = {n for h, n in sink if h == g}
        inside = {(a, b) for h, a, b in pairs if h == g and {a, b} <= side}
        for top in side & {n for h, n in cut if h == g} - {b for _, b in inside}:
            todo, seen = [top], {top}
            for x in todo:
                todo += (more := {b for a, b in inside if a == x} - seen)
                seen |= more
            out |= {(g, n, top) for n in seen}
    return out


@pytest.mark.parametrize("text", [False, True])
def test_graphs_are_dealt_once(spark, monkeypatch, text):
    """Many graphs are written once, when they are searched; what is too large among them goes by rounds, and sinks need no joins."""
    rng = random.Random(9)
    name = (lambda i: f"n{i}") if text else int
    pairs = [(g, name(rng.randint(0, 9)), name(rng.randint(0, 9))) for g in range(20) for _ in range(11)] + [(20, name(i), name(i + 1)) for i in range(30)] + [(21, name(3), name(4))]
    tops = [(g, name(rng.randint(0, 9))) for g in range(21) for _ in range(2)] + [(22, name(1))]
    kind = "string" if text else "long"
    e, s = spark.createDataFrame(pairs, f"g int, src {kind}, dst {kind}"), spark.createDataFrame(tops, f"g int, start {kind}")
    sink, cut = ([(g, name(i)) for g in range(23) for i in range(12) if rng.random() < p and (g != 20 or i < 4)] for p in (0.8, 0.7))
    sides = [spark.createDataFrame(x, f"g int, node {kind}") for x in (sink, cut)]
    made, write = [], graph.stage
    searches = graph.distances, graph.nearest, graph.shortest_paths
    for at_once, depth in ((100_000, None), (7, 3)):
        with monkeypatch.context() as m:
            m.setattr(graph, "Rounds", None)
            m.setattr(graph, "induced", None)
            m.setattr(graph, "stage", lambda df, n: made.append(n) or write(df, n))
            m.setattr(graph, "_ROWS_AT_ONCE", at_once)
            m.setattr(graph, "_PAIRS_AT_ONCE", at_once)
            quick = {f: sorted(map(str, f(e, s, by=["g"], max_depth=depth).collect())) for f in searches}
            assert {tuple(r) for r in graph.sink_roots(e, *sides, by=["g"]).collect()} == _plain_sinks(pairs, sink, cut)
    assert set(made) == {"found"} and len(made) == 8
    with monkeypatch.context() as m:
        m.setattr(graph, "SMALL", 29)  # the chain is too large
        for f, want in quick.items():
            assert sorted(map(str, f(e, s, by=["g"], max_depth=3).collect())) == want
        assert {tuple(r) for r in graph.sink_roots(e, *sides, by=["g"]).collect()} == _plain_sinks(pairs, sink, cut)


@tables
def test_paths_from_roots_need_no_table_of_dependencies(spark, monkeypatch):
    made, write = [], derived.stage
    monkeypatch.setattr(derived, "stage", lambda df, name: made.append(name) or write(df, name))
    x = derived.batch_inputs(spark, SMALL)
    paths = recommend.root_paths(x, x.projects).select("project", "node").collect()
    assert made == ["items"]
    nodes = x.nodes().distinct().collect()
    assert made == ["items", "nodes"]
    links, deps, artifacts = x.links().distinct().collect(), x.deps.select("project", "src", "dst").collect(), x.artifacts.select("project", "node").collect()
    assert sorted(paths) == sorted(nodes) == sorted(artifacts) and sorted(links) == sorted(deps)


@tables
def test_constraints_broadcast_no_table_of_all_projects(spark, monkeypatch):
    plans, write = [], constraints.stage
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(constraints, "stage", lambda df, name: plans.append(shown(df)) or write(df, name))
    planned = graph_queries.plan_constraints(spark, SMALL)
    assert len(plans) == 1 and "Broadcast" not in plans[0] + shown(planned) and planned.count() > 0


@tables
@pytest.mark.parametrize("odd", [False, True])
def test_simple_updates_ask_for_little_of_the_graphs(spark, monkeypatch, tmp_path, odd):
    """Neither texts of all artifacts nor tables of all dependencies and calls are written, and the results are those of the whole tables."""
    folder = SMALL
    if odd:
        folder = str(tmp_path)
        for t in ("lineitem", "orders"):
            spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        name = "case when p_partkey % 5 = 0 then 'junit' when p_partkey % 6 = 0 then 'p7' when p_partkey % 11 <> 0 then concat('n', p_partkey % 3) end"
        p = spark.read.parquet(f"{SMALL}/part.parquet").filter("p_partkey % 13 <> 3").withColumns({"p_name": F.expr(name), "p_brand": F.expr("if(p_partkey % 6 = 0, 'project', p_brand)"), "p_size": F.expr("cast(p_partkey % 3 as int)")})
        p.write.parquet(f"{folder}/part.parquet")
    x, made, write = derived.batch_inputs(spark, folder), [], derived.stage
    monkeypatch.setattr(derived, "stage", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(recommend, "induced", None)

    def run(x, asked):
        every = recommend.validated(asked, x).collect()
        tasks = stage(recommend.validated(asked, x).filter("problem is null").select("task_id", "project", "lib", "target"), "tasks")
        return [sorted(map(str, rows)) for rows in (every, recommend.simple_update(tasks, x).collect())]

    asked = stage(derived.batch_tasks(x), "asked")
    roots = asked.filter("project % 7 = 0").selectExpr("-1 - task_id as task_id", "project", "concat('project:p', project, ':1') as org_gav", "target_gav")
    asked = asked.unionByName(roots)
    got = run(x, asked)
    assert made == ["items", "artifacts", "eco-edges", "pairs"]
    whole = recommend.Inputs(**{f.name: getattr(x, f.name) for f in dataclasses.fields(recommend.Inputs)})
    assert run(whole, asked) == got and len(got[1]) > 20 and any("SUCCESS" in r for r in got[1])


def test_asked_nodes_of_many_graphs_are_found_in_the_search(spark, monkeypatch):
    """Paths to what is asked for, distances inside a side and what is missed there, without joins; the same by rounds and by plain walks."""
    rng = random.Random(4)
    pairs = [(g, rng.randint(0, 9), rng.randint(0, 9)) for g in range(20) for _ in range(13)] + [(20, i, i + 1) for i in range(30)] + [(21, 3, 4)]
    tops = [(g, rng.randint(0, 9)) for g in range(21) for _ in range(2)] + [(22, 1)]
    side, asked = ([(g, i) for g in range(23) for i in range(12) if rng.random() < p] for p in (0.8, 0.4))
    e, s = spark.createDataFrame(pairs, "g int, src long, dst long"), spark.createDataFrame(tops, "g int, start long")
    own, to = (spark.createDataFrame(rows * 2, "g int, node long") for rows in (side, asked))
    every = [r for r in graph.shortest_paths(e, s, by=["g"]).collect() if (r.g, r.node) in set(asked)]
    inside = graph.distances(graph.induced(e, own, ["g"]), s, by=["g"]).collect()
    met = {(r.g, r.start, r.node) for r in inside}
    left = {(g, t, n) for g, t in tops for h, n in set(asked) & set(side) if g == h} - met

    def check():
        paths, near, rest = graph.shortest_paths(e, s, by=["g"], to=to), graph.distances(e, s, by=["g"], within=own), graph.missed(to, e, s, own, ["g"])
        assert sorted(map(str, paths.collect())) == sorted(map(str, every)) and sorted(map(str, near.collect())) == sorted(map(str, inside))
        assert sorted(map(tuple, rest.collect())) == sorted(left) and left and every

    with monkeypatch.context() as m:
        m.setattr(graph, "Rounds", None)
        m.setattr(graph, "induced", None)
        check()
        m.setattr(graph, "_ROWS_AT_ONCE", 7)
        m.setattr(graph, "_PAIRS_AT_ONCE", 7)
        check()
    with monkeypatch.context() as m:
        m.setattr(graph, "SMALL", 45)  # the chain and others are too large
        check()


@tables
def test_cuts_are_solved_without_rounds_of_tries(spark, monkeypatch):
    """No wave of tries and no joint of all tasks is written: a project is dealt once, and a run's ways are met in its worker."""
    x, made, write = derived.batch_inputs(spark, SMALL), [], recommend.stage
    tasks = stage(recommend.validated(derived.batch_tasks(x), x).filter("problem is null and project % 6 = 0").select("task_id", "project", "lib", "target"), "tasks")
    monkeypatch.setattr(recommend, "stage", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(recommend, "first_solved", None)
    monkeypatch.setattr(constraints, "solve", None)
    assert recommend.min_cut_updates(tasks, x).count() > 0
    assert "wave" not in made and made.count("cuts") == 1 and "artifacts" not in x.__dict__


def test_surroundings_alone_are_met(spark):
    """Plans without roots, as all of a batch's may be: any version meets them."""
    df = spark.createDataFrame
    tries = df([("r/0", "r", 1, 5, "2", 9)], "try string, run string, project long, lib long, version string, cand long")
    plan = df([("r", 1, 5, "AROUND", 1, [])], "run string, project long, node long, kind string, place int, roots array<struct<root: long, bound: int>>")
    nodes = df([(1, 5, "g", "a", "1")], "project long, node long, grp string, artifact string, version string")
    eco = df([(9, "g", "a", "2"), (8, "h", "b", "1")], "node long, grp string, artifact string, version string")
    solved, sub, lines = constraints.solve(tries, plan, nodes, eco, df([(9, 8)], "src long, dst long"))
    assert [r[0] for r in solved.collect()] == ["r/0"] and {r.node for r in sub.collect()} == {8, 9} and {(r.src, r.dst) for r in lines.collect()} == {(9, 8)}


def test_cuts_go_on_from_a_kept_flow(monkeypatch):
    """The same cuts as from the beginning each time, which asks ``min_cut`` for every edge of the work list."""
    rng, many = random.Random(7), 0

    def again(edges, s, t):
        weights, todo, best, found, seen = [1.0] * len(edges), [None], float("inf"), [], set()
        for e in todo:
            if e is not None:
                weights[e] += 1
            cut = mincut.min_cut(edges, weights, s, t)
            if cut[0] > best:
                weights[e] = 1.0
                continue
            best = cut[0]
            if tuple(cut[1]) not in seen:
                seen.add(tuple(cut[1]))
                found.append(cut)
                todo += cut[1]
        return found

    cases = []
    for _ in range(2000):
        names = [f"n{i}" for i in range(rng.randint(2, 9))]
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 16))]
        s, t = rng.choice(names), rng.choice([*names, "far"])
        if s != t:
            cases.append(((edges, s, t), again(edges, s, t)))
    monkeypatch.setattr(mincut, "min_cut", None)
    for case, want in cases:
        assert mincut.all_cuts(*case) == want
        many += len(want) > 2
    assert many
