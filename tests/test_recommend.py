import dataclasses
import os

import pytest
from plain_recommend import Plain

from graftline.operators import recommend
from graftline.plans.derived import batch_inputs, batch_tasks
from graftline.staging import stage

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_min_cut_updates_equal_the_plain_rules(spark):
    """All projects of the smallest tables: cuts, joint path constraints, checks, statuses, steps and the stop at a perfect cut."""
    x = batch_inputs(spark, SMALL)
    tasks = stage(recommend.validated(batch_tasks(x), x).filter("problem is null").select("task_id", "project", "lib", "target"), "tasks")
    got = {}
    for r in recommend.min_cut_updates(tasks, x).collect():
        steps = None if r.update_steps is None else [(s["from"], s["to"]) for s in r.update_steps]
        got.setdefault(r.task_id, []).append((r.cut_ix, r.cut_weight, r.cand_version, r.status, r.nr_violations, r.nr_calls, steps))
    eco = {}
    for r in sorted(x.eco_nodes.collect(), key=lambda r: r.node):
        eco.setdefault((r.grp, r.artifact, r.version), r.node)
    options = {}
    for r in recommend.candidates(tasks, x).collect():
        if (r.grp, r.artifact, r.version) in eco:
            options.setdefault(r.task_id, []).append((r.pos, r.version, eco[r.grp, r.artifact, r.version]))
    plain = Plain({f.name: [r.asDict(recursive=True) for r in getattr(x, f.name).collect()] for f in dataclasses.fields(x)})
    kinds = set()
    for t in tasks.collect():
        plain.load(t.project)
        want = plain.min_cut(t.lib, sorted(options.get(t.task_id, [])))
        assert sorted(got.get(t.task_id, [])) == want, t
        if want and any(c[0] != "AROUND" for c in plain.constraints(t.lib, set(plain.art) - {plain.root}, set(plain.dep[plain.root]))):
            kinds.add("joint")
    assert kinds and {s for rows in got.values() for _, _, _, s, *_ in rows} >= {"SUCCESS", "NO_NEO4J_ENTRY"}


def test_recommend_leaves_solved_tasks_and_shows_errors(spark):
    x = batch_inputs(spark, SMALL)
    rows = recommend.recommend(batch_tasks(x), x).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.task_id, set()).add(r.kind)
    solved = {r.task_id for r in rows if r.kind == "simple" and r.status == "SUCCESS" and r.nr_violations == 0}
    assert {k for t, k in kinds.items() if t not in solved for k in k} >= {"error", "simple", "min-cut"}
    assert all(k == {"error"} for k in kinds.values() if "error" in k)
    assert {r.status for r in rows if r.kind == "error"} == {"INVALID_TARGET", "UNKNOWN_LIBRARY"}
