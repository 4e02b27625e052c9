"""Path constraints between updated roots and the nodes that they share, and their joint solution (DOM08, DOM09, DOM15, DOM16, SET02, SET04, TOP01, TOP02, JN15-JN17).

``plan`` turns what a cut leaves into ordered constraints, and ``solve`` finds for many attempts at once versions of all
nodes that meet them: constraint after constraint, nodes that are bound stay bound, and of a constraint's solutions the
first by length, shared node and roots is taken.  Texts of queries are never made; every step is a join over all attempts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftline.functions.names import cleared_group, gav
from graftline.operators.graph import bounded_paths, distances
from graftline.operators.matching import first_by, fits, top_by
from graftline.staging import Rounds, release, stage

# Least bound of a path, length where none is known, depth and number of neighbourhood paths.
MIN_PATH_LENGTH, DEFAULT_LENGTH, NEIGHBOUR_DEPTH, NEIGHBOUR_PATHS = 5, 3, 3, 10


def dedupe(rows: DataFrame, key: list[str], target: str, source: str, order: list[Column | str]) -> DataFrame:
    """Of each target and source the first row in order (SET04)."""
    return first_by(rows, [*key, target, source], *order)


def plan(runs: DataFrame, sink_roots: DataFrame, nodes: DataFrame, members: DataFrame, dist: DataFrame, lengths: DataFrame) -> DataFrame:
    """run, project, node, kind, place, roots (array of (root, bound)): the constraints that an update has to meet, in order.

    runs(run, project, lib), sink_roots(run, node, root), nodes(project, node, grp, artifact, version), members(project, node,
    family), dist(project, node, dist) from the project's root, lengths(project, start, node, dist) from roots and members.
    Roots of one family count as one.  Of constraints on one family by one family the nearest to the project's root stays, but
    the library keeps its own.  Then, by the number of roots:
    one: only for the library; AROUND if the root is the library or in its family, else FROM_ROOT.
    more: SHARED by one root of each group (the least GAV), without those in the node's own family.
    Of a family the member nearest to the node stands for it.  The library's own constraint comes last.
    """
    text = nodes.select("project", F.col("node").cast("string").alias("name"), F.col("node").alias("id"), cleared_group(F.col("grp")).alias("cleared"), "grp", gav(F.col("grp"), F.col("artifact"), F.col("version")).alias("gav"))
    fam = members.select("project", F.col("node").alias("id"), "family")
    # all of these grow with the projects, and are far larger than their files: never broadcast
    many_rows = lambda df: df.hint("merge")
    known = text.join(many_rows(fam), ["project", "id"], "left").select("project", "id", F.coalesce("family", "name").alias("own"), F.col("family").isNotNull().alias("is_family"), "cleared", F.when(F.col("family").isNull(), F.col("grp")).otherwise(F.col("cleared")).alias("grp"), "gav")
    by = lambda c: known.select("project", F.col("id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("own", "is_family", "cleared", "grp", "gav")])
    pairs = sink_roots.join(many_rows(runs.select("run", "project", "lib")), "run").join(many_rows(by("node")), ["project", "node"]).join(many_rows(by("root")), ["project", "root"])
    rows = pairs.groupBy("run", "project", "lib", "node", "node_own", "node_cleared", "root_own", "root_is_family", "root_cleared", "root_grp").agg(F.min("root_gav").alias("gav"), F.min("root").alias("root"))
    rows = rows.join(many_rows(dist.select("project", "node", F.col("dist").alias("node_dist"))), ["project", "node"], "left").withColumn("is_lib", F.col("node") == F.col("lib"))
    order = [F.col("node_dist").asc_nulls_last(), "node"]
    rows = stage(dedupe(rows.filter("not is_lib"), ["run"], "node_own", "root_own", order).unionByName(rows.filter("is_lib")), "constraints")
    rows = rows.join(many_rows(rows.groupBy("run", "node").agg(F.count("*").alias("n"))), ["run", "node"])
    near = F.col("root_cleared").eqNullSafe(F.col("node_cleared"))
    one = rows.filter("n = 1 and is_lib").withColumn("kind", F.when(near | (F.col("root") == F.col("lib")), "AROUND").otherwise("FROM_ROOT"))
    many = first_by(rows.filter("n > 1"), ["run", "node", "root_grp"], "gav", "root").filter(~near).withColumn("kind", F.lit("SHARED"))
    every = one.unionByName(many)
    stands = members.select("project", F.col("family").alias("root_own"), F.col("node").alias("member"))
    length = lengths.select("project", F.col("start").alias("member"), "node", F.col("dist").alias("length"))
    chosen = every.join(many_rows(stands), ["project", "root_own"], "left").withColumn("member", F.coalesce("member", "root")).join(many_rows(length), ["project", "member", "node"], "left")
    chosen = first_by(chosen, ["run", "node", "root_own"], F.col("length").asc_nulls_last(), "member")
    default = F.col("length").isNull() | ((F.col("kind") == "FROM_ROOT") & ~F.col("root_is_family"))
    bound = F.greatest(F.when(default, DEFAULT_LENGTH).otherwise(F.col("length")), F.lit(MIN_PATH_LENGTH)).cast("int")
    grouped = chosen.groupBy("run", "project", "node", "kind", "is_lib", "node_dist").agg(F.sort_array(F.collect_list(F.struct(F.col("member").alias("root"), bound.alias("bound")))).alias("roots"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("is_lib", *order))
    return grouped.select("run", "project", "node", "kind", place.alias("place"), F.when(F.col("kind") == "AROUND", F.array().cast(grouped.schema["roots"].dataType)).otherwise(F.col("roots")).alias("roots"))


def joint_paths(pairs: DataFrame, eco_edges: DataFrame, reach: DataFrame) -> DataFrame:
    """from, to, most, path, hops: for pairs(from, to, most) all paths of at most most edges that repeat no edge.

    Paths grow backwards, and only over nodes that the start reaches within what is left, reach(start, node, dist).
    """
    found = Rounds(pairs.sparkSession, "joint")
    level = found.add(pairs.select("from", "to", "most", F.array("to").alias("path"), F.array().cast("array<string>").alias("hops")).distinct())
    within = reach.select(F.col("start").alias("from"), F.col("node").alias("src"), "dist")
    used = 0
    while not level.isEmpty():
        used += 1
        step = level.withColumn("dst", F.get("path", F.lit(0))).join(eco_edges.select("src", "dst"), "dst").join(within, ["from", "src"]).filter(F.col("dist") + used <= F.col("most"))
        hop = F.concat_ws(">", "src", "dst")
        step = step.filter(~F.array_contains("hops", hop))
        level = found.add(step.select("from", "to", "most", F.concat(F.array("src"), "path").alias("path"), F.concat(F.array(hop), "hops").alias("hops")))
    return found.all().filter(F.get("path", F.lit(0)) == F.col("from"))


def solve(tries: DataFrame, planned: DataFrame, nodes: DataFrame, eco_nodes: DataFrame, eco_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """solved(try), sub-graph nodes(try, node) and edges(try, src, dst) of the attempts whose constraints can all be met.

    tries(try, run, project, lib, version, cand): the library's candidate of that version is bound.  A node of the library's family
    has the same version; any other root has at least its own (in text order); a shared node is free.  All paths of a constraint have
    no edge in common.  The sub-graph is the chosen paths, the library's surroundings where the plan asks for them, and the
    first ``NEIGHBOUR_PATHS`` paths around every newly bound root.
    """
    facts = nodes.select("project", "node", "grp", "artifact", "version", cleared_group(F.col("grp")).alias("cleared"))
    eco = eco_nodes.select("grp", "artifact", F.col("version").alias("eco_version"), F.col("node").alias("eco"))
    lib = facts.select("project", F.col("node").alias("lib"), F.col("cleared").alias("lib_cleared"))
    alive = stage(tries.join(lib, ["project", "lib"]).select("try", "run", "project", "lib", "lib_cleared", F.col("version").alias("target"), "cand"), "alive")
    steps = stage(planned.join(alive.select("run").distinct(), "run", "left_semi"), "planned")
    roots = steps.select("run", "project", "place", F.posexplode("roots").alias("i", "r")).select("run", "project", "place", "i", F.col("r.root").alias("root"), F.col("r.bound").alias("bound"))
    last, deepest = steps.agg(F.max("place")).first()[0] or 0, roots.agg(F.max("bound")).first()[0] or 0

    def candidates(wanted: DataFrame, rule: Column) -> DataFrame:
        """wanted(try, project, node, target, lib_cleared, ...) with eco: the nodes of the ecosystem that stand for node; bound ones as they are."""
        held = wanted.join(bound.all().withColumnRenamed("eco", "held"), ["try", "node"], "left").join(facts, ["project", "node"])
        free = held.filter("held is null").join(eco, ["grp", "artifact"]).filter(rule)
        return held.filter("held is not null").withColumn("eco", F.col("held")).select(*wanted.columns, "eco").unionByName(free.select(*wanted.columns, "eco"))

    same = F.col("cleared").eqNullSafe(F.col("lib_cleared"))
    root_rule = fits(same, F.col("eco_version"), F.col("target"), F.col("version"))
    node_rule = fits(same, F.col("eco_version"), F.col("target"))
    bound, paths, around = Rounds(tries.sparkSession, "bound"), Rounds(tries.sparkSession, "chosen"), []
    bound.add(alive.select("try", F.col("lib").alias("node"), F.col("cand").alias("eco")))
    paths.add(alive.select("try", F.array("cand").alias("path")))
    starts = candidates(alive.join(roots.withColumnRenamed("root", "node"), ["run", "project"]).select("try", "project", "node", "target", "lib_cleared"), root_rule).select(F.col("eco").alias("start")).distinct()
    reach = distances(eco_edges, starts, int(deepest)) if deepest else None
    # without roots there are only surroundings, which any version meets
    for place in range(1, last + 1 if deepest else 1):
        here = alive.select("try", "run", "project", "target", "lib_cleared").join(steps.filter(F.col("place") == place).select("run", "node", "kind", "roots"), "run")
        asked = here.filter("kind <> 'AROUND'").withColumn("n", F.size("roots"))
        to = candidates(asked.select("try", "project", "node", "n", "target", "lib_cleared"), node_rule).select("try", F.col("node").alias("shared"), "n", F.col("eco").alias("to"))
        one = asked.select("try", "project", "target", "lib_cleared", F.posexplode("roots").alias("i", "r")).select("try", "project", "target", "lib_cleared", "i", F.col("r.root").alias("node"), F.col("r.bound").alias("bound"))
        frm = candidates(one, root_rule).select("try", "i", F.col("node").alias("root"), "bound", F.col("eco").alias("from"))
        met = frm.join(reach.select(F.col("start").alias("from"), F.col("node").alias("to"), "dist"), "from").filter("dist <= bound").join(to, ["try", "to"])
        whole = met.groupBy("try", "to").agg(F.count_distinct("i").alias("k"), F.first("n").alias("all")).filter("k = all").select("try", "to")
        # a single root needs a shortest path only
        met = stage(met.join(whole, ["try", "to"]).withColumn("most", F.when(F.col("n") == 1, F.col("dist")).otherwise(F.col("bound"))).select("try", "shared", "to", "n", "i", "root", "from", "most"), "pairs")
        if not met.isEmpty():
            joint = joint_paths(met.select("from", "to", "most"), eco_edges, reach)
            options = stage(met.join(joint, ["from", "to", "most"]).select("try", "shared", "to", "n", "i", F.struct("root", F.col("from").alias("eco")).alias("pick"), "path", "hops"), "options")
            state = options.filter("i = 0").select("try", "shared", "to", "n", F.array("pick").alias("picks"), F.array("path").alias("ways"), "hops")
            full = [state.filter("n <= 1")]
            for i in range(1, options.agg(F.max("n")).first()[0]):
                nxt = options.filter(F.col("i") == i).select("try", "to", "pick", F.col("path").alias("way"), F.col("hops").alias("more"))
                longer = state.filter(F.col("n") > i).join(nxt, ["try", "to"]).filter(~F.arrays_overlap("hops", "more"))
                # written, as it is read twice: else the plan doubles with each root
                state = stage(longer.select("try", "shared", "to", "n", F.concat("picks", F.array("pick")).alias("picks"), F.concat("ways", F.array("way")).alias("ways"), F.concat("hops", "more").alias("hops")), "state")
                full.append(state.filter(F.col("n") == i + 1))
            state = reduce(DataFrame.unionByName, full)
            best = stage(state.groupBy("try", "shared").agg(F.min(F.struct(F.size("hops").alias("len"), "to", "picks", "ways")).alias("b")), "best")
            new = best.select("try", F.explode(F.concat(F.array(F.struct(F.col("shared").alias("root"), F.col("b.to").alias("eco"))), "b.picks")).alias("x")).select("try", F.col("x.root").alias("node"), F.col("x.eco").alias("eco"))
            fresh = stage(new.distinct().join(bound.all().select("try", "node"), ["try", "node"], "left_anti"), "fresh")
            bound.add(fresh)
            paths.add(best.select("try", F.explode("b.ways").alias("path")))
            around.append(fresh.join(best.select("try", F.col("shared").alias("node")), ["try", "node"], "left_anti").select("try", "eco"))
            solved_here = best.select("try")
        else:
            solved_here = met.select("try")
        failed = asked.select("try").join(solved_here, "try", "left_anti")
        before, alive = alive, stage(alive.join(failed, "try", "left_anti"), "alive")
        release(before, met)
    hoods = [p.select("try", "path") for p in _surroundings(around, eco_edges)]
    every = paths.all()
    for h in hoods:
        every = every.unionByName(h)
    every = every.join(alive.select("try"), "try", "left_semi")
    i = F.sequence(F.lit(1), F.size("path") - 1)
    walked = every.filter("size(path) > 1").select("try", F.explode(F.transform(i, lambda n: F.struct(F.get(F.col("path"), n - 1).alias("src"), F.get(F.col("path"), n).alias("dst")))).alias("e")).select("try", "e.src", "e.dst")
    near = alive.join(steps.filter("kind = 'AROUND'").select("run"), "run", "left_semi")
    hood = distances(eco_edges, near.select(F.col("cand").alias("start")).distinct(), NEIGHBOUR_DEPTH)
    own = near.select("try", F.col("cand").alias("start")).join(hood, "start")
    outward = own.filter(F.col("dist") < NEIGHBOUR_DEPTH).select("try", F.col("node").alias("src")).join(eco_edges.select("src", "dst"), "src").select("try", "src", "dst")
    seen = every.select("try", F.explode("path").alias("node")).unionByName(own.select("try", "node"))
    return alive.select("try"), stage(seen.distinct(), "sub-nodes"), stage(walked.unionByName(outward).distinct(), "sub-edges")


def _surroundings(bound: list[DataFrame], eco_edges: DataFrame) -> list[DataFrame]:
    """try, path: the neighbourhood of each bound(try, eco)."""
    if not bound:
        return []
    every = bound[0]
    for b in bound[1:]:
        every = every.unionByName(b)
    every = every.distinct()
    hoods = neighbourhood(eco_edges, every.select(F.col("eco").alias("start")).distinct())
    return [every.join(hoods.select(F.col("start").alias("eco"), "path"), "eco").select("try", "path")]


def shared_nodes(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """first, second, node: pairs of starts that reach a node on paths without a common edge, first < second."""
    p = bounded_paths(edges, starts, max_depth).filter("len > 0")
    hops = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.concat_ws(">", F.get(F.col("path"), i - 1), F.get(F.col("path"), i)))
    p = p.select("start", "node", hops.alias("hops"))
    a, b = p.select(F.col("start").alias("first"), "node", F.col("hops").alias("ha")), p.select(F.col("start").alias("second"), "node", F.col("hops").alias("hb"))
    return a.join(b, "node").filter((F.col("first") < F.col("second")) & ~F.arrays_overlap("ha", "hb")).select("first", "second", "node").distinct()


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = NEIGHBOUR_DEPTH, most: int = NEIGHBOUR_PATHS) -> DataFrame:
    """start, node, len, path: of each start the first paths by length and nodes."""
    return top_by(bounded_paths(edges, starts, depth), ["start"], most, "len", "path")
