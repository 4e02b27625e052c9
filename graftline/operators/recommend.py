"""Update recommendations for many tasks of many projects at once (DOM01-DOM07, DOM10, DOM17-DOM20).

A task is a project's library (a node of its dependency graph) and a target version.  The phases are joins over all tasks; a
task that fails becomes a row with a status or an error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftline.functions.names import gav, rounded_weight, same_family
from graftline.functions.versions import version_key
from graftline.operators import compat, constraints, cutplan
from graftline.operators.compat import override_decision, status_of
from graftline.operators.constraints import NEIGHBOUR_DEPTH
from graftline.operators.graph import distances, induced, missed, nearest, shortest_paths  # noqa: F401 (induced: tests look whether it is used)
from graftline.operators.matching import first_by, match_first, match_loose, name_pairs
from graftline.staging import release, stage

PROJECT = ["project"]


@dataclass
class Inputs:
    """The tables of a batch.

    projects(project, root, has_calls); artifacts(project, node, grp, artifact, version, scopes, ord), the root among them;
    deps(project, src, dst, included); versions(grp, artifact, version, pos) in the order of the search's response;
    eco_nodes(node, grp, artifact, version); eco_edges(src, dst) of the compile scope;
    calls(project, src, dst, tgt_class, name, return_type, params, signature) between libraries; docs(gav), checks(base, next, kind),
    incompatibilities(base, next, kind, class_name, methods, fields, interfaces), semantic(base, next, start_method, changed_body_method).
    """

    projects: DataFrame
    artifacts: DataFrame
    deps: DataFrame
    versions: DataFrame
    eco_nodes: DataFrame
    eco_edges: DataFrame
    calls: DataFrame
    docs: DataFrame
    checks: DataFrame
    incompatibilities: DataFrame
    semantic: DataFrame

    def links(self) -> DataFrame:
        """project, src, dst of deps, for who needs no more; rows may repeat."""
        return self.deps.select("project", "src", "dst")

    def nodes(self) -> DataFrame:
        """project, node of artifacts; rows may repeat."""
        return self.artifacts.select("project", "node")

    def included(self) -> DataFrame:
        """project, src, dst of the dependencies that are included; rows may repeat."""
        return self.deps.filter("included").select("project", "src", "dst")

    def compiled(self) -> DataFrame:
        """project, node of the compile artifacts; rows may repeat."""
        return compile_only(self.artifacts).select("project", "node")

    def called(self, tasks: DataFrame) -> DataFrame:
        """project, org_gav, node, ord, ok (in the compile scope): the artifacts that tasks(project, org_gav) name."""
        known = self.artifacts.select("project", _gav().alias("org_gav"), "node", "ord", is_compile(F.col("scopes"), F.col("artifact")).alias("ok"))
        return known.join(tasks.select("project", "org_gav").distinct(), ["project", "org_gav"], "left_semi")

    def described(self) -> DataFrame:
        """project, node, kin, grp, gav, version, ok, scoped of artifacts, for the cuts; kin is the ecosystem's first node of the same name."""
        scoped = F.coalesce(F.array_contains("scopes", "compile"), F.lit(False))
        own = self.artifacts.select("project", "node", "grp", "artifact", _gav().alias("gav"), "version", is_compile(F.col("scopes"), F.col("artifact")).alias("ok"), scoped.alias("scoped"))
        return own.join(kinds(self), ["grp", "artifact"], "left").drop("artifact")

    @cached_property
    def tried(self) -> DataFrame:
        """grp, artifact, version, pos, cand, key: the versions that the ecosystem has, with its first node of each; a key is made once for each version."""
        eco = self.eco_nodes.groupBy("grp", "artifact", "version").agg(F.min("node").alias("cand"))
        have = self.versions.select("grp", "artifact", "pos", "version").join(eco, ["grp", "artifact", "version"])
        return stage(have.join(_keys(self.versions, "version", "key"), "version"), "tried")

    def named(self, nodes: DataFrame) -> DataFrame:
        """nodes(project, node, ...), which are artifacts of their projects, with grp, artifact and version."""
        return nodes.join(self.artifacts.select("project", "node", "grp", "artifact", "version"), ["project", "node"])

    def first_named(self, names: DataFrame) -> DataFrame:
        """project, grp, artifact, old, old_version: of at least the names(project, grp, artifact) the project's first artifact."""
        first = self.artifacts.groupBy("project", "grp", "artifact").agg(F.min_by(F.struct(F.col("node").alias("old"), F.col("version").alias("old_version")), "ord").alias("o"))
        return first.select("project", "grp", "artifact", "o.*")

    def calls_into(self, ends: DataFrame) -> DataFrame:
        """calls into at least the ends(project, dst)."""
        return self.calls

    def between(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """checks, incompatibilities and semantic for at least the pairs(base, next)."""
        return self.checks, self.incompatibilities, self.semantic


def kinds(x: Inputs) -> DataFrame:
    """grp, artifact, kin: each name in the ecosystem with its first node."""
    return x.eco_nodes.groupBy("grp", "artifact").agg(F.min("node").alias("kin"))


def is_compile(scopes: Column, artifact: Column, scope: str = "compile", test_mark: str = "junit") -> Column:
    return F.coalesce(F.array_contains(scopes, scope), F.lit(False)) & ~F.coalesce(F.contains(artifact, F.lit(test_mark)), F.lit(False))


def compile_only(artifacts: DataFrame, scope: str = "compile", test_mark: str = "junit") -> DataFrame:
    """Artifacts of the scope that are no test libraries."""
    return artifacts.filter(is_compile(F.col("scopes"), F.col("artifact"), scope, test_mark))


def _gav() -> Column:
    return gav(F.col("grp"), F.col("artifact"), F.col("version"))


def validated(tasks: DataFrame, x: Inputs) -> DataFrame:
    """tasks(task_id, project, org_gav, target_gav) with lib, target and problem, which is null for tasks that can be worked on.

    INVALID_TARGET: the target has no version; UNKNOWN_LIBRARY: no artifact of the project has the GAV; WRONG_SCOPE: no compile dependency.
    """
    lib = x.called(tasks).groupBy("project", "org_gav").agg(F.min_by(F.struct(F.col("node").alias("lib"), "ok"), "ord").alias("l"))
    target = F.get(F.split("target_gav", ":", -1), F.lit(2))
    problem = F.when(F.coalesce(target, F.lit("")) == "", "INVALID_TARGET").when(F.col("l").isNull(), "UNKNOWN_LIBRARY").when(~F.col("l.ok"), "WRONG_SCOPE")
    return tasks.join(lib, ["project", "org_gav"], "left").select("task_id", "project", "org_gav", "target_gav", F.col("l.lib").alias("lib"), target.alias("target"), problem.alias("problem"))


def candidates(tasks: DataFrame, x: Inputs) -> DataFrame:
    """task_id, project, lib, pos, version: the versions that are at least the target, in response order."""
    lib = x.artifacts.select("project", F.col("node").alias("lib"), "grp", "artifact")
    every = x.versions.select("grp", "artifact", "pos", "version", version_key(F.col("version")).alias("key"))
    met = tasks.join(lib, ["project", "lib"]).join(every, ["grp", "artifact"]).filter(F.col("key") >= version_key(F.col("target")))
    return met.select("task_id", "project", "lib", "grp", "artifact", "pos", "version")


def _keys(df: DataFrame, version: str, key: str) -> DataFrame:
    """The distinct versions of df with their keys, written once: a key costs more than a join, and many artifacts have the same version."""
    return stage(df.filter(F.col(version).isNotNull()).select(version).distinct().withColumn(key, version_key(F.col(version))), "keys")


def listed_versions(tasks: DataFrame, x: Inputs) -> DataFrame:
    """task_id, tries (pos, cand, version): all candidates that the ecosystem has, in response order; they are looked up once for each artifact and target."""
    wanted = stage(x.named(tasks.withColumn("node", F.col("lib"))).select("task_id", "grp", "artifact", "target"), "wanted")
    asked = wanted.select("grp", "artifact", "target").distinct().join(_keys(wanted, "target", "least"), "target")
    met = asked.join(x.tried, ["grp", "artifact"]).filter(F.col("key") >= F.col("least"))
    each = met.groupBy("grp", "artifact", "target").agg(F.sort_array(F.collect_list(F.struct("pos", "cand", "version"))).alias("tries"))
    return wanted.join(each, ["grp", "artifact", "target"]).select("task_id", "tries")


def pick_versions(tasks: DataFrame, x: Inputs) -> DataFrame:
    """task_id, project, lib, cand, cand_version: the first candidate, in response order, that the ecosystem has; null where there is none.

    The first version that is at least some target is newer than all before it, so that tasks meet these alone: few of an artifact's many versions.
    """
    have = x.tried
    before = Window.partitionBy("grp", "artifact").orderBy("pos", "cand", "version").rowsBetween(Window.unboundedPreceding, -1)
    newer = have.withColumn("newest", F.max("key").over(before)).filter("newest is null or key > newest").drop("newest")
    wanted = x.named(tasks.withColumn("node", F.col("lib"))).select("task_id", "grp", "artifact", "target")
    # a target's answer is looked up once for each artifact, however many tasks have it
    asked = wanted.select("grp", "artifact", "target").distinct()
    asked = asked.join(_keys(tasks, "target", "least"), "target")
    best = asked.join(newer, ["grp", "artifact"]).filter(F.col("key") >= F.col("least")).groupBy("grp", "artifact", "target").agg(F.min(F.struct("pos", "cand", "version")).alias("b"))
    found = wanted.join(best, ["grp", "artifact", "target"]).groupBy("task_id").agg(F.min("b").alias("b"))
    return tasks.select("task_id", "project", "lib").join(found, "task_id", "left").select("task_id", "project", "lib", "b.cand", F.col("b.version").alias("cand_version"))


def changed_nodes(sub_nodes: DataFrame, x: Inputs) -> DataFrame:
    """run, project, new, old, base, next: nodes(run, project, node) of sub-graphs whose artifact the project has in another version."""
    return known_nodes(sub_nodes, x).filter("changed").drop("changed")


def known_nodes(sub_nodes: DataFrame, x: Inputs) -> DataFrame:
    """run, project, new, old, base, next, changed (in another version): nodes(run, project, node) of sub-graphs whose artifact the project has."""
    eco = x.eco_nodes.select(F.col("node").alias("new"), "grp", "artifact", F.col("version").alias("new_version"))
    met = sub_nodes.select("run", "project", F.col("node").alias("new")).join(eco, "new")
    old = x.first_named(met.select("project", "grp", "artifact"))
    same = met["project"].eqNullSafe(old["project"]) & met["grp"].eqNullSafe(old["grp"]) & met["artifact"].eqNullSafe(old["artifact"])
    base, new = (gav(met["grp"], met["artifact"], F.col(v)) for v in ("old_version", "new_version"))
    return met.join(old, same).select("run", met["project"], "new", "old", base.alias("base"), new.alias("next"), (~F.col("old_version").eqNullSafe(F.col("new_version"))).alias("changed"))


def decisions(changed: DataFrame, root_paths: DataFrame, init: DataFrame, new_len: DataFrame) -> DataFrame:
    """changed with decision: root_paths(project, node, len, path) from the project's root, init(run, node), new_len(run, new, new_len) over the updated nodes."""
    old = root_paths.select("project", F.col("node").alias("old"), F.col("len").alias("old_len"), "path")
    met = changed.join(old, ["project", "old"], "left").join(init.groupBy("run").agg(F.collect_set("node").alias("init")), "run", "left").join(new_len, ["run", "new"], "left")
    through = F.coalesce(F.arrays_overlap("path", "init"), F.lit(False))
    return met.select(*changed.columns, override_decision(F.col("old_len"), through, F.col("new_len")).alias("decision"))


def violated(decided: DataFrame, unupdated: Callable[[DataFrame], DataFrame], x: Inputs, skip_family: bool) -> DataFrame:
    """run, old, new, problem, calls (number): a row for every change that is a violation, maybe without calls.

    Calls into a changed library count where unupdated(calls with run, project, src) keeps them, with skip_family not from its own family.  Calls of the
    project's root are checked for source, others for binary compatibility, all of them for changed bodies where that is known; problem is
    EMPTY_CG without calls of the project, FAILED_SIGTEST where the pair of versions has no check of a kind that is needed.
    """
    root = x.projects.select("project", "root", "has_calls")
    check = decided.filter("decision = 'CHECK'").join(root, "project").select("run", "project", "old", "new", "base", "next", "root", "has_calls")
    empty = check.filter("not has_calls").select("run", "old", "new", F.lit("EMPTY_CG").alias("problem"), F.lit(0).cast("long").alias("calls"))
    calls = x.calls_into(check.filter("has_calls").select("project", F.col("old").alias("dst")).distinct())
    risky = unupdated(check.filter("has_calls").join(calls.withColumnRenamed("dst", "old"), ["project", "old"]))
    if skip_family:
        for end, group in (("src", "src_group"), ("old", "tgt_group")):
            risky = x.named(stage(risky, "risky").withColumnRenamed(end, "node")).withColumnsRenamed({"node": end, "grp": group}).drop("artifact", "version")
        risky = risky.filter(~same_family(F.col("src_group"), F.col("tgt_group")))
    kind = F.when(F.col("src") == F.col("root"), "SRC").otherwise("BINARY")
    risky = stage(risky.select("run", "old", "new", "base", "next", kind.alias("kind"), "tgt_class", "name", "return_type", "params", "signature"), "risky")
    key, kinds = ["run", "old", "new"], ["base", "next", "kind"]
    asked = risky.select(*key, *kinds).distinct()
    checks, incompatibilities, semantic = x.between(risky.select("base", "next").distinct())
    status = compat.lookup(asked.select(*kinds).distinct(), x.docs, checks, ["kind"])
    rows = asked.join(status, kinds).groupBy(*key).agg(F.max(F.when(F.col("status") != "SUCCESS", F.col("status"))).alias("problem"))
    broken = compat.broken_calls(risky.withColumn("call_id", F.struct(*key)), incompatibilities, kinds).select("call_id.*")
    bodies = compat.semantic_calls(risky.withColumn("call_id", F.struct(*key)), semantic, ["base", "next"]).select("call_id.*")
    n = broken.unionByName(bodies).groupBy(*key).agg(F.count("*").alias("calls"))
    checked = rows.join(n, key, "left").select(*key, "problem", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))
    # a kept old version stands for one call that has to be forward compatible
    forward = decided.filter("decision = 'FORWARD'").select(*key, F.lit(None).cast("string").alias("problem"), F.lit(1).cast("long").alias("calls"))
    return empty.unionByName(checked).unionByName(forward)


def outcome(runs: DataFrame, found: DataFrame) -> DataFrame:
    """runs(run, cand, ...) with status, nr_violations, nr_calls (-1 on failure) and is_perfect: no violation at all, or none that could be checked."""
    n = found.groupBy("run").agg(F.count_if(F.col("calls") > 0).alias("v"), F.sum("calls").alias("c"), F.max(F.col("problem") == "EMPTY_CG").alias("no_cg"), F.max(F.col("problem") == "FAILED_SIGTEST").alias("no_check"), F.count("*").alias("rows"))
    false = lambda c: F.coalesce(c, F.lit(False))
    status = status_of(~false(F.col("no_cg")), F.col("cand").isNotNull(), ~false(F.col("no_check")))
    ok = F.col("status") == "SUCCESS"
    count = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0))).otherwise(-1).cast("long")
    met = runs.join(n, "run", "left").withColumn("status", status)
    perfect = F.when(F.col("cand").isNull(), False).otherwise(~ok | F.col("rows").isNull())
    return met.select(*runs.columns, "status", count("v").alias("nr_violations"), count("c").alias("nr_calls"), perfect.alias("is_perfect"))


def root_paths(x: Inputs, of: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """project, node, len, path from the project's root, for the projects of of; with to(project, node) only the paths to these."""
    starts = x.projects.join(of.select("project").distinct(), "project", "left_semi").select("project", F.col("root").alias("start"))
    return shortest_paths(x.links(), starts, by=PROJECT, to=to).drop("start")


def simple_update(tasks: DataFrame, x: Inputs, paths: DataFrame | None = None, picked: DataFrame | None = None) -> DataFrame:
    """Suggestions that update the library alone, for tasks(task_id, project, lib, target).

    What changes is found first; paths and calls are then asked for by it, as it is little of the projects' graphs.
    """
    picked = stage(pick_versions(tasks, x), "picked") if picked is None else picked
    hood = distances(x.eco_edges, picked.filter("cand is not null").select(F.col("cand").alias("start")).distinct(), NEIGHBOUR_DEPTH)
    sub = picked.select(F.col("task_id").alias("run"), "project", F.col("cand").alias("start")).join(hood, "start")
    changed = stage(changed_nodes(sub, x), "changed")
    if paths is None:
        paths = root_paths(x, changed, changed.select("project", F.col("old").alias("node")).distinct())
    libs = tasks.select(F.col("task_id").alias("run"), "project", F.col("lib").alias("start"))

    def unupdated(calls: DataFrame) -> DataFrame:
        calls = stage(calls, "into")
        asked = calls.select("project", F.col("src").alias("node")).distinct()
        rest = missed(asked, x.included(), libs.select("project", "start").distinct(), x.compiled(), PROJECT)
        return calls.join(libs.join(rest, ["project", "start"]).select("run", F.col("node").alias("src")), ["run", "src"], "left_semi")

    decided = stage(decisions(changed, paths, tasks.select(F.col("task_id").alias("run"), F.col("lib").alias("node")), sub.select("run", F.col("node").alias("new"), F.col("dist").alias("new_len"))), "decided")
    done = outcome(picked.withColumnRenamed("task_id", "run"), violated(decided, unupdated, x, skip_family=False))
    return done.withColumnRenamed("run", "task_id").withColumn("is_simple", F.lit(True))


def min_cut_updates(tasks: DataFrame, x: Inputs, picked: DataFrame | None = None) -> DataFrame:
    """Suggestions that update all libraries behind a minimum cut, in the order of the cuts up to the first perfect one, for tasks(task_id, project, lib, target); picked as of ``pick_versions``, where that is known.

    task_id, cut_ix, cut_weight, cand_version, update_steps, status, nr_violations, nr_calls.
    """
    return _cut_updates(*_solved_cuts(tasks, pick_versions(tasks, x) if picked is None else picked, x), x)


def _solved_cuts(tasks: DataFrame, picked: DataFrame, x: Inputs) -> tuple[DataFrame, DataFrame]:
    """The cuts of ``cutplan.planned_cuts`` with run, and those of ``solved_cuts``, written."""
    run = F.concat_ws("/", F.col("task_id").cast("string"), F.col("cut_ix").cast("string"))
    cuts = stage(cutplan.planned_cuts(tasks, x.projects, x.described(), x.links()).withColumn("run", run), "cuts")
    return cuts, stage(solved_cuts(cuts, tasks, picked, x), "first")


def _cut_updates(cuts: DataFrame, first: DataFrame, x: Inputs) -> DataFrame:
    """The suggestions of cuts and their solutions."""
    around = first.filter("around").select("run", "project", F.col("cand").alias("start"))
    hood = stage(around.join(distances(x.eco_edges, around.select("start").distinct(), NEIGHBOUR_DEPTH), "start").select("run", "project", "node", "dist"), "hood")
    fresh = first.select("run", "project", F.explode("fresh").alias("start")).distinct()
    near = fresh.join(constraints.neighbourhood(x.eco_edges, fresh.select("start").distinct()).select("start", "path"), "start").select("run", "project", "path")
    ways = stage(first.select("run", "project", F.explode("ways").alias("path")).unionByName(near), "ways")
    sub = stage(ways.select("run", "project", F.explode("path").alias("node")).unionByName(hood.select("run", "project", "node")).distinct(), "sub")
    sub_edges, met, lens = _cut_matches(cuts, first, ways, hood, sub, x)
    known = stage(known_nodes(sub, x), "known")
    of = lambda column, node: F.get(column, F.array_position("nodes", F.col(node)) - 1)
    changed = known.filter("changed").drop("changed")
    judged = changed.join(cuts.select("run", "nodes", "lens", "through"), "run").withColumns({"old_len": of("lens", "old"), "by": F.coalesce(of("through", "old"), F.lit(False))}).join(lens, ["run", "new"], "left")
    decided = stage(judged.select(*changed.columns, override_decision(F.col("old_len"), F.col("by"), F.col("new_len")).alias("decision")), "decided")
    kept = lambda calls: calls.join(cuts.select("run", "nodes", "kept"), "run").filter(of("kept", "src")).select(*calls.columns)
    found = violated(decided, kept, x, skip_family=True)
    runs = cuts.select("run", "task_id", "cut_ix", rounded_weight(F.col("weight")).alias("cut_weight")).join(first.select("run", "cand", F.col("version").alias("cand_version")), "run", "left")
    done = stage(outcome(runs, found), "outcome")
    stop = done.filter("is_perfect").groupBy("task_id").agg(F.min("cut_ix").alias("stop"))
    shown = done.join(stop, "task_id", "left").filter("stop is null or cut_ix <= stop")
    # roots of the sub-graphs, and the cut nodes matched exactly, else loosely
    tops = known.join(sub_edges.select("run", F.col("dst").alias("new")), ["run", "new"], "left_anti").select("run", F.col("base").alias("from"), F.col("next").alias("to"))
    cut = met.groupBy("run", "old_gav").agg(F.min(F.struct(~F.col("exact"), "node", "new_gav")).alias("m")).select("run", F.col("old_gav").alias("from"), F.col("m.new_gav").alias("to"))
    steps = tops.unionByName(cut).groupBy("run").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("update_steps"))
    # a cut without a solution keeps 0 violated calls
    calls = F.when(F.col("status") == compat.NO_ENTRY, F.lit(0)).otherwise(F.col("nr_calls")).cast("long")
    return shown.join(steps, "run", "left").select("task_id", "cut_ix", "cut_weight", "cand_version", "update_steps", "status", "nr_violations", calls.alias("nr_calls"), "is_perfect")


def _cut_matches(cuts: DataFrame, first: DataFrame, ways: DataFrame, hood: DataFrame, sub: DataFrame, x: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges(run, src, dst) of the sub-graphs, their nodes that match cut nodes (run, node, new_gav, exact, old_gav), and lengths(run, new, new_len) from those that match exactly."""
    i = F.sequence(F.lit(1), F.size("path") - 1)
    walked = ways.filter("size(path) > 1").select("run", F.explode(F.transform(i, lambda n: F.struct(F.get(F.col("path"), n - 1).alias("src"), F.get(F.col("path"), n).alias("dst")))).alias("e")).select("run", "e.*")
    outward = hood.filter(F.col("dist") < NEIGHBOUR_DEPTH).select("run", F.col("node").alias("src")).join(x.eco_edges.select("src", "dst"), "src").select("run", "src", "dst")
    sub_edges = stage(walked.unionByName(outward).distinct(), "sub-edges")
    cut_nodes = stage(x.named(cuts.select("run", "project", F.explode("cut_nodes").alias("node")).join(first.select("run"), "run", "left_semi")).select("run", "project", "grp", "artifact", _gav().alias("old_gav")), "cut-nodes")
    updates = stage(sub.join(x.eco_nodes.select("node", "grp", "artifact", _gav().alias("new_gav")), "node"), "updates")
    pairs = stage(name_pairs(cut_nodes, updates), "names")
    met = stage(updates.join(pairs, F.col("to_grp").eqNullSafe(updates["grp"]) & F.col("to_artifact").eqNullSafe(updates["artifact"])).select("run", pairs["grp"], pairs["artifact"], "node", "new_gav", "exact").alias("u").join(cut_nodes.alias("c"), reduce(and_, [F.col(f"u.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("run", "grp", "artifact")])).select("u.run", "node", "new_gav", "exact", "old_gav"), "met")
    init = met.filter("exact").groupBy("run", "old_gav").agg(F.min("node").alias("start")).select("run", "start").distinct()
    lens = nearest(sub_edges.join(init.select("run").distinct(), "run", "left_semi"), init, by=["run"]).select("run", F.col("node").alias("new"), F.col("len").alias("new_len"))
    return sub_edges, met, lens


def solved_cuts(cuts: DataFrame, tasks: DataFrame, picked: DataFrame, x: Inputs) -> DataFrame:
    """run, project, around, cand, version, ways, fresh: of the cuts of ``cutplan.planned_cuts`` with run those that a candidate solves, with the first that does.

    A cut without constraints is solved by the first candidate.  Of the others only those are tried whose every constraint has an end that ways of all its roots reach,
    whatever versions are bound: ends and ways depend on names alone, so that they are looked up once for all runs.
    """
    keep = ["run", "task_id", "project", "lib", "around", "wants"]
    free = cuts.filter(F.size("wants") == 0).select(*keep)
    picked = picked.filter("cand is not null").select("task_id", "cand", F.col("cand_version").alias("version"))
    alone = free.join(picked, "task_id").select("run", "project", "around", "cand", "version", F.array(F.array("cand")).alias("ways"), F.array().cast("array<bigint>").alias("fresh"))
    rows = cuts.filter(F.size("wants") > 0).select("run", F.posexplode("wants").alias("place", "w")).select("run", "place", F.col("w.kin").alias("dst_kin"), F.size("w.roots").alias("n"), F.posexplode("w.roots").alias("i", "r"))
    asked = stage(rows.select("run", "place", "i", "n", "dst_kin", F.col("r.kin").alias("src_kin"), F.col("r.bound").alias("bound")), "asked")
    names = stage(asked.filter("src_kin is not null and dst_kin is not null").groupBy("src_kin", "dst_kin").agg(F.max("bound").alias("bound")), "names")
    deepest = names.agg(F.max("bound")).first()[0]
    if deepest is None:
        return alone
    eco = stage(x.eco_nodes.join(kinds(x), ["grp", "artifact"]).select("node", "kin", "version"), "eco")
    end = lambda e: eco.select(F.col("node").alias(e), F.col("kin").alias(f"{e}_kin"), F.col("version").alias(f"{e}_version"))
    starts = eco.join(names.select(F.col("src_kin").alias("kin")), "kin", "left_semi").select(F.col("node").alias("start"))
    reach = distances(x.eco_edges, starts, int(deepest))
    near = reach.select(F.col("start").alias("src"), F.col("node").alias("dst"), "dist").join(end("src"), "src").join(end("dst"), "dst").join(names, ["src_kin", "dst_kin"]).filter("dist <= bound").drop("bound")
    near = stage(near, "near")
    hits = asked.join(near.groupBy("src_kin", "dst_kin", "dst").agg(F.min("dist").alias("dist")), ["src_kin", "dst_kin"]).filter("dist <= bound")
    ends = hits.groupBy("run", "place", "n", "dst").agg(F.count("*").alias("k")).filter("k = n")
    open_ = ends.groupBy("run").agg(F.count_distinct("place").alias("k")).join(cuts.select(*keep), "run").filter(F.col("k") == F.size("wants"))
    open_ = stage(open_.select(*keep), "open")
    met = ends.select("run", "place", "dst").join(open_.select("run"), "run", "left_semi")
    # a single root needs a shortest path only
    ways = asked.join(met, ["run", "place"]).join(near, ["src_kin", "dst_kin", "dst"]).filter("dist <= bound")
    ways = stage(ways.select("run", "place", "i", "src", "src_version", "dst", "dst_version", F.when(F.col("n") == 1, F.col("dist")).otherwise(F.col("bound")).alias("most")), "pairs")
    joint = constraints.joint_paths(ways.select(F.col("src").alias("from"), F.col("dst").alias("to"), "most"), x.eco_edges, reach).select(F.col("from").alias("src"), F.col("to").alias("dst"), "most", "path")
    ways = ways.join(joint, ["src", "dst", "most"]).groupBy("run").agg(F.collect_list(F.struct("place", "i", "src", "src_version", "dst", "dst_version", "path")).alias("ways"))
    tries = listed_versions(stage(open_.select("task_id").distinct().join(tasks, "task_id"), "open-tasks"), x)
    found = cutplan.solutions(open_.join(tries, "task_id").join(ways, "run"))
    return alone.unionByName(open_.select("run", "project", "around").join(found, "run").select(alone.columns))


def first_solved(tries: DataFrame, planned: DataFrame, x: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each run the first of tries(try, run, project, lib, pos, version, cand, rank) that can be solved, its sub-graph nodes(run, project, node) and edges(run, src, dst).

    Tries go in waves, each four times as long as the one before, for the runs that no earlier one has solved.
    """
    done, subs, lines, begin, size = [], [], [], 0, 1
    most = tries.agg(F.max("rank")).first()[0] or 0
    while begin < max(most, 1):
        wave = tries.filter(F.col("rank").between(begin + 1, begin + size))
        for d in done:
            wave = wave.join(d.select("run"), "run", "left_anti")
        wave = stage(wave, "wave")
        solved, nodes, edges = constraints.solve(wave, planned, x.artifacts, x.eco_nodes, x.eco_edges)
        first = stage(first_by(wave.join(solved, "try", "left_semi"), ["run"], "pos", "cand"), "first")
        done.append(first)
        subs.append(stage(first.select("try", "run", "project").join(nodes, "try").select("run", "project", "node"), "sub"))
        lines.append(stage(first.select("try", "run").join(edges, "try").select("run", "src", "dst"), "sub-edges"))
        release(wave, nodes, edges)
        begin, size = begin + size, size * 4
    return tuple(reduce(DataFrame.unionByName, parts) for parts in (done, subs, lines))


def recommend(tasks: DataFrame, x: Inputs) -> DataFrame:
    """Simple suggestions of all tasks(task_id, project, org_gav, target_gav) that are valid, and min-cut suggestions for those that are not solved by them.

    Tasks that are not valid become rows of kind error, whose status is the problem; those of another scope have no row, as there is nothing to do.
    """
    every = stage(validated(tasks, x), "tasks")
    valid = every.filter("problem is null").select("task_id", "project", "lib", "target")
    picked = stage(pick_versions(valid, x), "picked")
    simple = stage(simple_update(valid, x, picked=picked), "simple")
    solved = simple.filter("status = 'SUCCESS' and is_perfect").select("task_id")
    cut = min_cut_updates(stage(valid.join(solved, "task_id", "left_anti"), "unsolved"), x, picked)
    a = simple.select("task_id", F.lit("simple").alias("kind"), F.lit(None).cast("int").alias("cut_ix"), F.lit(1).alias("cut_weight"), "cand_version", "status", "nr_violations", "nr_calls")
    b = cut.select("task_id", F.lit("min-cut").alias("kind"), "cut_ix", "cut_weight", "cand_version", "status", "nr_violations", "nr_calls")
    none = F.lit(-1).cast("long")
    errors = every.filter("problem in ('INVALID_TARGET', 'UNKNOWN_LIBRARY')").select("task_id", F.lit("error").alias("kind"), F.lit(None).cast("int").alias("cut_ix"), F.lit(0).alias("cut_weight"), F.lit(None).cast("string").alias("cand_version"), F.col("problem").alias("status"), none.alias("nr_violations"), none.alias("nr_calls"))
    return a.unionByName(b).unionByName(errors)


def update_steps(roots: DataFrame, cut_nodes: DataFrame, updates: DataFrame, known: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, old_gav, new_gav: updated roots by (grp, artifact), and cut nodes matched exactly, else loosely; distinct."""
    by = by or []
    new = updates.withColumn("new_gav", _gav())
    a = match_first(roots.withColumn("new_gav", _gav()).drop("version"), known.withColumn("old_gav", _gav()), [*by, "grp", "artifact"], "ord", "old_gav")
    exact = match_first(cut_nodes.withColumn("old_gav", _gav()), new, [*by, "grp", "artifact"], "ord", "new_gav")
    missed = exact.filter("new_gav is null").select(*by, "grp", "artifact", "old_gav")
    loose = match_loose(missed, new.select(*by, F.col("grp").alias("ug"), F.col("artifact").alias("ua"), "ord", "new_gav"), [("grp", "ug"), ("artifact", "ua")], "ord", "new_gav", [*by, "old_gav"], by)
    both = [df.filter("old_gav is not null and new_gav is not null").select(*by, "old_gav", "new_gav") for df in (a, exact, loose)]
    return both[0].unionByName(both[1]).unionByName(both[2]).distinct()
