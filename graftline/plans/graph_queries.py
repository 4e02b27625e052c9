"""Queries of the graph, matching, call and constraint operators over relations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions.names import cleared_group
from graftline.operators import compat, constraints, graph, matching, mincut, modules, recommend
from graftline.plans.derived import ART, BATCH, CALLS, ROOT, artifacts, batch_inputs, batch_tasks, calls, class_index, edge_sql, edges, table
from graftline.staging import stage

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _library(spark: SparkSession, d: str) -> DataFrame:
    """start: the versions of one family's large libraries."""
    return table(spark, d, "part").filter("p_brand = 'Brand#2' and p_type = 'LARGE'").select(F.col("p_partkey").alias("start"))


_LIBRARY = "lib AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#2' AND p_type = 'LARGE')"


def _shown(paths: DataFrame) -> DataFrame:
    return paths.withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


@query("root_vertices", f"""
    WITH {edge_sql()}, r AS (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e))
    SELECT node, node = (SELECT min(node) FROM r) AS is_first FROM r""")  # fmt: skip
def root_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_root(edges(spark, d))


@query("compile_filter", """
    WITH s AS (SELECT l_partkey AS node, bool_or(l_returnflag = 'R') AS c FROM lineitem GROUP BY l_partkey)
    SELECT p_partkey AS node, p_name AS artifact FROM part JOIN s ON node = p_partkey WHERE c AND NOT contains(p_name, 'ring') AND p_brand <> 'Brand#1' AND regexp_matches(p_name, '\\S')""")  # fmt: skip
def compile_filter(spark: SparkSession, d: str) -> DataFrame:
    from graftline.operators.recommend import compile_only

    scopes = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.collect_set("l_returnflag").alias("scopes"))
    a = artifacts(spark, d).join(scopes, "node")
    return compile_only(a, "R", "ring").filter(~F.col("grp").eqNullSafe("Brand#1") & F.col("artifact").rlike(r"\S")).select("node", "artifact")


@query("select_nodes", f"""
    WITH {ART} SELECT node, version, CASE WHEN grp = 'Brand#2' THEN 'EXACT' ELSE 'AT_LEAST' END AS rule FROM art
    WHERE (grp = 'Brand#2' AND version = '11.0') OR (grp <> 'Brand#2' AND version >= '2')""")  # fmt: skip
def select_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Exact nodes in the library's family, nodes from a bound on elsewhere."""
    a = artifacts(spark, d)
    own = cleared_group(F.col("grp")) == "Brand#2"
    return a.filter(matching.fits(own, F.col("version"), F.lit("11.0"), F.lit("2"))).select("node", "version", F.when(own, "EXACT").otherwise("AT_LEAST").alias("rule"))


@query("gav_lookup", f"""
    WITH {ART}, w AS (SELECT p_partkey AS id, p_brand || ':' || p_name || ':' || CASE WHEN p_partkey % 4 = 0 THEN '0' ELSE p_size::VARCHAR || '.' || (p_partkey % 13)::VARCHAR END AS gav, p_brand, p_name FROM part),
    a AS (SELECT grp || ':' || artifact || ':' || version AS gav, min(node) AS exact FROM art GROUP BY 1), b AS (SELECT grp, artifact, min(node) AS any_version FROM art GROUP BY 1, 2)
    SELECT id, exact, any_version FROM w LEFT JOIN a USING (gav) LEFT JOIN b ON grp = p_brand AND artifact = p_name""")  # fmt: skip
def gav_lookup(spark: SparkSession, d: str) -> DataFrame:
    """GAV texts to nodes, with and without their version."""
    a = artifacts(spark, d)
    w = a.select(F.col("node").alias("id"), F.concat_ws(":", "grp", "artifact", F.when(F.col("node") % 4 == 0, "0").otherwise(F.col("version"))).alias("gav"))
    exact = matching.by_gav(w, a).withColumnRenamed("node", "exact")
    return matching.by_gav(exact, a, with_version=False).select("id", "exact", F.col("node").alias("any_version"))


@query("node_match_first", f"""
    WITH {ART}, f AS (SELECT grp, artifact, arg_min(version, ord) AS old_version FROM art WHERE ord % 3 = 0 GROUP BY grp, artifact)
    SELECT node, f.old_version, CASE WHEN f.old_version IS NULL THEN 'NEW' WHEN f.old_version = version THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
    FROM art LEFT JOIN f USING (grp, artifact)""")  # fmt: skip
def node_match_first(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d)
    return matching.classify_versions(a, a.filter("ord % 3 = 0")).select("node", "old_version", "status")


@query("loose_match", "SELECT a.n_nationkey AS nation, min(b.n_nationkey) AS found FROM nation a LEFT JOIN nation b ON contains(b.n_name, a.n_name) AND b.n_nationkey <> 1 GROUP BY a.n_nationkey")
def loose_match(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    left, right = n.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("a")), n.filter("n_nationkey <> 1").select("n_nationkey", F.col("n_name").alias("b"))
    return matching.match_loose(left, right, [("a", "b")], "n_nationkey", "n_nationkey", ["nation"]).select("nation", F.col("n_nationkey").alias("found"))


_REACH = f"""WITH RECURSIVE {edge_sql('e', 'R')}, {_LIBRARY},
    r(node) AS (SELECT node FROM lib UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"""


@query("reachable", f"{_REACH} SELECT node FROM r")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(edges(spark, d, "R"), _library(spark, d))


@query("unupdated", f"{_REACH} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def unupdated(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreached(table(spark, d, "part").select(F.col("p_partkey").alias("node")), edges(spark, d, "R"), _library(spark, d))


@query("shortest_path", f"""
    WITH RECURSIVE {BATCH}, sp(project, node, len, path) USING KEY (project, node) AS (SELECT DISTINCT project, -1::BIGINT, 0, [-1::BIGINT] FROM it
        UNION SELECT sp.project, dst, any_value(sp.len) + 1, min(list_append(sp.path, dst)) FROM sp JOIN dep ON dep.project = sp.project AND src = sp.node
            LEFT JOIN recurring.sp r ON r.project = dep.project AND r.node = dst WHERE r.node IS NULL GROUP BY sp.project, dst)
    SELECT project, node, len, array_to_string(path, '>') AS path FROM sp""")  # fmt: skip
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From every project's root to all of its libraries, side by side."""
    x = batch_inputs(spark, d)
    return _shown(recommend.root_paths(x, x.projects)).select("project", "node", "len", "path")


@query("nearest_start", f"""
    WITH RECURSIVE {edge_sql('e', 'R')}, {_LIBRARY}, n(node, start, len) USING KEY (node) AS (SELECT node, node, 0 FROM lib
        UNION SELECT dst, min(n.start), any_value(n.len) + 1 FROM n JOIN e ON src = n.node LEFT JOIN recurring.n r ON r.node = dst WHERE r.node IS NULL GROUP BY dst)
    SELECT node, start, len FROM n""")  # fmt: skip
def nearest_start(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest(edges(spark, d, "R"), _library(spark, d))


_PATHS = f"""WITH RECURSIVE {edge_sql('e', 'A')}, p(start, node, len, path) AS (
        SELECT DISTINCT src, src, 0, [src] FROM e
        UNION ALL SELECT p.start, e.dst, p.len + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE p.len < 3)"""


def _sources(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("start")).distinct()


@query("bounded_paths", f"{_PATHS} SELECT start, node, len::INTEGER AS len, count(*) AS n FROM p GROUP BY start, node, len")
def bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d, "A")
    return graph.bounded_paths(e, _sources(e), 3).groupBy("start", "node", "len").agg(F.count("*").alias("n"))


@query("neighbourhood", f"{_PATHS}, k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len, path) AS r FROM p) SELECT start, node, len::INTEGER AS len, array_to_string(path, '>') AS path FROM k WHERE r <= 10")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d, "A")
    return _shown(constraints.neighbourhood(e, _sources(e)))


_SINK = """sink AS (SELECT project, node FROM art WHERE node % 3 <> 0 AND node >= 0), cut AS (SELECT project, node FROM art WHERE node % 5 < 3),
    i AS (SELECT dep.project, src, dst FROM dep JOIN sink a ON a.project = dep.project AND a.node = src JOIN sink b ON b.project = dep.project AND b.node = dst),
    tops AS (SELECT project, node FROM sink JOIN cut USING (project, node) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.project = sink.project AND i.dst = sink.node)),
    r(project, node, root) AS (SELECT project, node, node FROM tops UNION SELECT i.project, i.dst, r.root FROM r JOIN i ON i.project = r.project AND i.src = r.node)"""


def _side_roots(x: recommend.Inputs) -> DataFrame:
    """A side and a cut in every project: the roots of the side's nodes."""
    a = x.nodes()
    return graph.sink_roots(x.links(), a.filter("node % 3 <> 0 and node >= 0"), a.filter("node % 5 < 3"), by=["project"])


@query("sink_roots", f"WITH RECURSIVE {BATCH}, {_SINK} SELECT project, node, root FROM r")
def sink_roots(spark: SparkSession, d: str) -> DataFrame:
    return _side_roots(batch_inputs(spark, d))


def _members(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d)
    return graph.families(a.withColumn("scopes", F.array("p_type")), F.lit("Brand#1"))


@query("contract_groups", f"""
    WITH {edge_sql()}, m AS (SELECT p_partkey AS node, 'family:' || p_brand AS family FROM part WHERE p_brand <> 'Brand#1' AND p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 2))
    SELECT DISTINCT coalesce(a.family, src::VARCHAR) AS src, coalesce(b.family, dst::VARCHAR) AS dst FROM e LEFT JOIN m a ON a.node = src LEFT JOIN m b ON b.node = dst""")  # fmt: skip
def contract_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.contract(edges(spark, d), _members(spark, d))[0]


@query("family_nodes", "SELECT 'family:' || p_brand AS family, array_to_string(list_sort(list(DISTINCT p_type)), ' ') AS scopes, arg_min(p_size::VARCHAR || '.' || (p_partkey % 13)::VARCHAR, p_partkey) AS version, count(*) AS n FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_brand HAVING count(*) >= 2")
def family_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).groupBy("family", F.concat_ws(" ", "scopes").alias("scopes"), "version").agg(F.count("*").alias("n"))


@query("induced_subgraph", f"WITH {edge_sql()}, n AS (SELECT p_partkey AS node FROM part WHERE p_size < 25), u AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)) SELECT src, dst, 1.0::DOUBLE AS weight FROM u UNION SELECT dst, src, 1.0 FROM u")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(graph.induced(edges(spark, d), artifacts(spark, d).filter("p_size < 25")))


@query("call_shrink", f"WITH {CALLS} SELECT a.gav AS src_gav, b.gav AS tgt_gav, count(*)::INTEGER AS n, min(call) AS first_call FROM calls JOIN cls a ON a.class_name = src_class JOIN cls b ON b.class_name = tgt_class GROUP BY a.gav, b.gav")
def call_shrink(spark: SparkSession, d: str) -> DataFrame:
    s = compat.shrink_calls(calls(spark, d), class_index(spark, d))
    return s.select("src_gav", "tgt_gav", F.size("calls").alias("n"), F.get("calls", F.lit(0)).alias("first_call"))


@query("call_graph", f"WITH {CALLS}, l AS (SELECT a.gav AS src_gav, b.gav AS tgt_gav, count(*) AS n FROM calls JOIN cls a ON a.class_name = src_class JOIN cls b ON b.class_name = tgt_class GROUP BY a.gav, b.gav) SELECT v.gav, coalesce(sum(l.n), 0)::BIGINT AS n FROM (SELECT DISTINCT gav FROM cls UNION SELECT 'no:calls:1') v LEFT JOIN l ON l.src_gav = v.gav GROUP BY v.gav")
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """Vertices with their calls; an entry of the class path without calls is one too."""
    index = class_index(spark, d)
    idle = spark.range(1).select(F.lit("idle").alias("class_name"), F.lit("no:calls:1").alias("gav"), F.lit(3).alias("cp_ord"))
    vertices, lines = compat.call_graph(calls(spark, d), index.unionByName(idle))
    n = lines.groupBy(F.col("src_gav").alias("gav")).agg(F.sum("n").alias("n"))
    return vertices.join(n, "gav", "left").select("gav", F.coalesce("n", F.lit(0)).alias("n"))


@query("call_vertices", f"WITH {CALLS} SELECT DISTINCT src_class AS node FROM calls")
def call_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_vertices(calls(spark, d).select(F.col("src_class").alias("src")))


@query("graph_sizes", f"WITH {BATCH}, v AS (SELECT project, src AS node FROM dep UNION SELECT project, dst FROM dep) SELECT project, count(*) AS vertices, any_value(n) AS edges FROM v JOIN (SELECT project, count(*) AS n FROM dep GROUP BY project) USING (project) GROUP BY project")
def graph_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.sizes(batch_inputs(spark, d).deps, ["project"])


@query("queue_counters", "SELECT 'queued' AS name, count(*) AS n FROM customer UNION ALL SELECT 'done', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'todo', 0")
def queue_counters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    return modules.counters(c, table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey").distinct(), c.filter("false"))


@query("class_packages", "SELECT DISTINCT regexp_replace(url, '\\.[^.]*$', '') AS package FROM pages WHERE regexp_matches(url, '^.+\\.')")
def class_packages(spark: SparkSession, d: str) -> DataFrame:
    return modules.packages(table(spark, d, "pages").select(F.col("url").alias("class_name")))


@query("class_sets", f"WITH {CALLS}, o AS (SELECT class_name, gav, 1 AS ord FROM cls UNION ALL SELECT 's' || s_suppkey, 'late:1:1', 5 FROM supplier WHERE s_nationkey < 5), w AS (SELECT class_name, arg_max(gav, ord) AS gav FROM o GROUP BY class_name) SELECT gav, count(*) AS n, min(class_name) AS first_class FROM w GROUP BY gav")
def class_sets(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of the class path owns a class: some suppliers' classes stand in a later one again."""
    late = table(spark, d, "supplier").filter("s_nationkey < 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("class_name"), F.lit("late:1:1").alias("gav"), F.lit(5).alias("cp_ord"))
    owners = compat.class_owner(class_index(spark, d).unionByName(late))
    return owners.groupBy("gav").agg(F.count("*").alias("n"), F.min("class_name").alias("first_class"))


@query("call_degrees", f"WITH {CALLS}, o AS (SELECT src_class AS node, count(*) AS n FROM calls GROUP BY 1), i AS (SELECT tgt_class AS node, count(*) AS n FROM calls GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM o FULL JOIN i ON o.node = i.node")
def call_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(calls(spark, d).select(F.col("src_class").alias("src"), F.col("tgt_class").alias("tgt")))


@query("edges_at_risk", f"""
    WITH {CALLS}, l AS (SELECT a.gav AS src_gav, b.gav AS tgt_gav, count(*) AS n FROM calls JOIN cls a ON a.class_name = src_class JOIN cls b ON b.class_name = tgt_class GROUP BY a.gav, b.gav)
    SELECT src_gav, tgt_gav, n FROM l WHERE split_part(tgt_gav, ':', 2)::INT % 4 = 0 AND split_part(src_gav, ':', 2)::INT % 3 = 1 AND split_part(tgt_gav, ':', 2)::INT % 5 <> split_part(src_gav, ':', 2)::INT % 5""")  # fmt: skip
def edges_at_risk(spark: SparkSession, d: str) -> DataFrame:
    s = compat.shrink_calls(calls(spark, d), class_index(spark, d)).select("src_gav", "tgt_gav", F.size("calls").cast("long").alias("n"))
    number = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(2)).cast("int")
    s = s.withColumn("src_group", (number("src_gav") % 5).cast("string")).withColumn("tgt_group", (number("tgt_gav") % 5).cast("string"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("gav"))
    return compat.edges_at_risk(s, n.filter("k % 4 = 0"), n.filter("k % 3 = 1"), skip_family=True).select("src_gav", "tgt_gav", "n")


@query("call_incompatible", """
    WITH i AS (SELECT p_partkey AS inc_id, p_brand || '.' || p_name AS class_name, p_size, p_type FROM part),
    c AS (SELECT p_partkey AS call_id, p_brand || '.' || p_name AS class_name, p_type, p_size % 3 AS k FROM part)
    SELECT call_id, inc_id FROM c JOIN i USING (class_name) WHERE i.p_size % 7 = 0 OR (c.p_type = i.p_type AND k = i.p_size % 3)""")  # fmt: skip
def call_incompatible(spark: SparkSession, d: str) -> DataFrame:
    """Calls of part methods against incompatible parts; every seventh size stands for a deleted class."""
    p = table(spark, d, "part")
    params = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("int"))).otherwise(F.array(F.lit("int"), F.lit("long")))
    cls = F.concat_ws(".", "p_brand", "p_name")
    c = p.select(F.col("p_partkey").alias("call_id"), cls.alias("tgt_class"), F.lit("run").alias("name"), F.col("p_type").alias("return_type"), params.alias("params"))
    method = F.struct(F.lit("run").alias("name"), F.col("p_type").alias("return_type"), params.alias("params"))
    empty = F.array().cast("array<string>")
    i = p.select(F.col("p_partkey").alias("inc_id"), cls.alias("class_name"), F.when(F.col("p_size") % 7 != 0, F.array(method)).alias("methods"), empty.alias("fields"), empty.alias("interfaces"))
    return compat.broken_calls(c, i)


@query("call_semantic", "WITH s AS (SELECT p_brand || '.' || p_name || '.' || p_type AS m, p_partkey FROM part) SELECT a.p_partkey AS call_id, 'b' || b.p_partkey AS changed_body_method FROM s a JOIN s b USING (m)")
def call_semantic(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("m", F.concat_ws(".", "p_brand", "p_name", "p_type"))
    s = p.select(F.col("m").alias("start_method"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("changed_body_method"))
    return compat.semantic_calls(p.select(F.col("p_partkey").alias("call_id"), F.col("m").alias("signature")), s)


def _levels(name: str, only: str) -> str:
    """Distances from every project's root, in SQL."""
    return f"""{name}(project, node, len) USING KEY (project, node) AS (SELECT DISTINCT project, -1::BIGINT, 0 FROM it
        UNION SELECT w.project, dst, any_value(w.len) + 1 FROM {name} w JOIN dep ON dep.project = w.project AND src = w.node
            LEFT JOIN recurring.{name} r ON r.project = dep.project AND r.node = dst WHERE r.node IS NULL AND {only} GROUP BY w.project, dst)"""


@query("override_decision", f"""
    WITH RECURSIVE {BATCH}, {_levels('o', 'true')}, {_levels('n', 'src % 4 <> 1')}
    SELECT o.project, o.node, CASE WHEN o.node % 9 = 0 THEN 'CHECK' WHEN n.len IS NULL THEN 'SKIP' WHEN o.len >= n.len + 1 THEN 'CHECK' ELSE 'FORWARD' END AS decision FROM o LEFT JOIN n ON n.project = o.project AND n.node = o.node""")  # fmt: skip
def override_decision(spark: SparkSession, d: str) -> DataFrame:
    """Distances in every project's graph, and with some edges gone, without a bound."""
    x = batch_inputs(spark, d)
    starts = x.projects.select("project", F.col("root").alias("start"))
    least = lambda e, name: graph.nearest(e, starts, by=["project"]).select("project", "node", F.col("len").alias(name))
    met = least(x.deps, "old_len").join(least(x.deps.filter("src % 4 <> 1"), "new_len"), ["project", "node"], "left")
    return met.select("project", "node", compat.override_decision(F.col("old_len"), F.col("node") % 9 == 0, F.col("new_len")).alias("decision"))


@query("violation_counts", "SELECT l_orderkey, count(*) FILTER (WHERE n > 0) AS nr_violations, sum(n)::BIGINT AS nr_calls FROM (SELECT l_orderkey, l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("calls"))
    return compat.violation_counts(v, "l_orderkey")


@query("violated_calls", "SELECT l_orderkey, array_to_string(list_sort(list('m' || l_partkey) FILTER (WHERE l_returnflag = 'R') || list('s' || l_suppkey) FILTER (WHERE l_linestatus = 'F')), ' ') AS calls FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_linestatus = 'F') > 0")
def violated_calls(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of violated calls of an order, duplicates kept."""
    a = F.collect_list(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("m"), F.col("l_partkey").cast("string"))))
    b = F.collect_list(F.when(F.col("l_linestatus") == "F", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(a.alias("a"), b.alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return g.select("l_orderkey", F.concat_ws(" ", F.sort_array(compat.all_calls(F.col("a"), F.col("b")))).alias("calls"))


@query("queue_filter", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) ORDER BY c_name")
def queue_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    done = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return matching.filter_queue(c, c.limit(0), done, "c_custkey").orderBy("c_name")


@query("lateral_first", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus = 'F', o_totalprice, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01') WHERE r = 1")
def lateral_first(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first order, finished ones last."""
    o = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).withColumnRenamed("o_custkey", "c_custkey")
    return matching.lateral_first(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], [F.col("o_orderstatus") == "F", "o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("multi_path_constraint", f"""
    WITH RECURSIVE {edge_sql('e', 'R')}, p(start, node, len, hops) AS (
        SELECT DISTINCT src, src, 0, CAST([] AS VARCHAR[]) FROM e
        UNION ALL SELECT p.start, e.dst, p.len + 1, list_append(p.hops, e.src || '>' || e.dst) FROM p JOIN e ON e.src = p.node WHERE p.len < 2)
    SELECT DISTINCT a.start AS first, b.start AS second, a.node FROM p a JOIN p b ON a.node = b.node AND a.start < b.start AND a.len > 0 AND b.len > 0 AND NOT list_has_any(a.hops, b.hops)""")  # fmt: skip
def multi_path_constraint(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d, "R")
    return constraints.shared_nodes(e, _sources(e), 2)


@query("dedupe_constraints", f"""
    WITH {edge_sql()}, c AS (SELECT b.p_brand AS target, a.p_brand AS source, dst AS node, abs(a.p_size - b.p_size) AS dist FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY dist, node) AS r FROM c)
    SELECT target, source, node, dist::INTEGER AS dist FROM r WHERE r = 1""")  # fmt: skip
def dedupe_constraints(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).select("node", "grp", "p_size")
    s, t = a.select(F.col("node").alias("src"), F.col("grp").alias("source"), F.col("p_size").alias("z")), a.select(F.col("node").alias("dst"), F.col("grp").alias("target"), "p_size")
    c = edges(spark, d).join(s, "src").join(t, "dst").select("target", "source", F.col("dst").alias("node"), F.abs(F.col("z") - F.col("p_size")).alias("dist"))
    return constraints.dedupe(c, [], "target", "source", ["dist", "node"])


@query("first_solution", f"""
    WITH {BATCH}, e AS (SELECT gav, min(node) AS cand FROM eco GROUP BY gav)
    SELECT v.project AS task, s.cand, s.version FROM valid v LEFT JOIN (SELECT v.project, arg_min(e.cand, pt.node) AS cand, arg_min(pt.version, pt.node) AS version FROM valid v JOIN pt ON pt.grp = v.grp AND pt.artifact = v.artifact AND [pt.major, pt.minor] >= [v.major, 0] JOIN e USING (gav) GROUP BY v.project) s USING (project)""")  # fmt: skip
def first_solution(spark: SparkSession, d: str) -> DataFrame:
    """For each task the first version, in response order, that the ecosystem has; later ones are tried where it has not."""
    x = batch_inputs(spark, d)
    tasks = recommend.validated(batch_tasks(x), x).filter("problem is null").select("task_id", "project", "lib", "target")
    return recommend.pick_versions(tasks, x).select(F.col("task_id").alias("task"), "cand", F.col("cand_version").alias("version"))


@query("compat_lookup", """
    WITH p AS (SELECT a.p_partkey AS base, b.p_partkey AS next FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND b.p_partkey > a.p_partkey)
    SELECT base, next, CASE WHEN base % 3 <> 0 AND next % 3 <> 0 AND (base + next) % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED_SIGTEST' END AS status FROM p""")  # fmt: skip
def compat_lookup(spark: SparkSession, d: str) -> DataFrame:
    return compat.lookup(*_lookup_inputs(spark, d))


def _lookup_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("base"), "p_brand", "p_name")
    pairs = p.join(p.withColumnRenamed("base", "next"), ["p_brand", "p_name"]).filter("next > base").select("base", "next")
    return pairs, p.filter("base % 3 <> 0").select(F.col("base").alias("gav")), pairs.filter("(base + next) % 2 = 0")


@query("missing_pairs", "WITH p AS (SELECT a.p_partkey AS base, b.p_partkey AS next FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND b.p_partkey > a.p_partkey) SELECT base, next FROM p WHERE base % 3 = 0 OR next % 3 = 0 OR (base + next) % 2 = 1")
def missing_pairs(spark: SparkSession, d: str) -> DataFrame:
    return compat.missing_pairs(compat.lookup(*_lookup_inputs(spark, d)))


@query("lookup_again", "WITH p AS (SELECT a.p_partkey AS base, b.p_partkey AS next FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND b.p_partkey > a.p_partkey) SELECT base, next, CASE WHEN base % 3 <> 0 AND next % 3 <> 0 AND ((base + next) % 2 = 0 OR base % 5 = 0) THEN 'SUCCESS' ELSE 'FAILED_SIGTEST' END AS status FROM p")
def lookup_again(spark: SparkSession, d: str) -> DataFrame:
    """A second reading after a generator has answered some of the requests."""
    pairs, docs, checks = _lookup_inputs(spark, d)
    return compat.lookup_again(pairs, docs, checks, lambda missing: (docs.filter("false"), missing.filter("base % 5 = 0")))


@query("status_mapping", """
    SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'EMPTY_CG' WHEN c_custkey % 5 = 0 THEN 'NO_NEO4J_ENTRY' WHEN max(o_totalprice) > 450000 THEN 'FAILED_SIGTEST' ELSE 'SUCCESS' END AS status,
        (CASE WHEN count(o_orderkey) = 0 OR c_custkey % 5 = 0 OR max(o_totalprice) > 450000 THEN -1 ELSE count(o_orderkey) END)::BIGINT AS nr FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")  # fmt: skip
def status_mapping(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m"))
    met = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    status = compat.status_of(F.col("n").isNotNull(), F.col("c_custkey") % 5 != 0, F.col("m") <= 450000)
    return met.select("c_custkey", status.alias("status"), F.when(status == "SUCCESS", F.col("n")).otherwise(-1).cast("long").alias("nr"))


@query("module_groups", "SELECT o_custkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' ') AS kinds, min(o_orderkey) AS first_order, any_value(c_acctbal) IS NULL OR any_value(c_acctbal) < 0 AS skipped FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def module_groups(spark: SparkSession, d: str) -> DataFrame:
    """Steps of modules, gathered from two halves, with the builds that there are."""
    o = table(spark, d, "orders")
    steps = modules.gather([o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 <> 0")])
    groups = modules.by_module(steps, "o_custkey", kinds=F.concat_ws(" ", F.array_sort(F.collect_set("o_orderpriority"))), first_order=F.min("o_orderkey"))
    builds = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return modules.with_builds(groups, builds, "o_custkey").select("o_custkey", "n", "kinds", "first_order", "skipped")


def _cut_edges(spark: SparkSession, d: str) -> DataFrame:
    """Small graphs between a start and an end: paths of an order's items, tied together by part."""
    i = table(spark, d, "lineitem")
    a = i.select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 6).cast("string")).alias("v"), F.concat(F.lit("q"), (F.col("l_suppkey") % 4).cast("string")).alias("w"))
    e = a.select("task_id", F.explode(F.array(F.struct(F.lit("s").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("w").alias("dst")), F.struct(F.col("w").alias("src"), F.lit("t").alias("dst")))).alias("x")).select("task_id", "x.src", "x.dst").distinct()
    return e.withColumn("ord", F.concat_ws(">", "src", "dst")).withColumn("s", F.lit("s")).withColumn("t", F.lit("t"))


def _cut_text(found: DataFrame) -> DataFrame:
    return found.select("task_id", "cut_ix", "weight", *[F.concat_ws(" ", c).alias(c) for c in ("edges", "source", "sink")])


# All sides of a cut by enumeration; of the lightest the smallest is the one that flow finds first.
@query("min_cut", """
    WITH a AS (SELECT DISTINCT l_orderkey AS task_id, 'p' || (l_partkey % 6) AS v, 'q' || (l_suppkey % 4) AS w FROM lineitem),
    e AS (SELECT task_id, 's' AS s, v AS d FROM a UNION SELECT task_id, v, w FROM a UNION SELECT task_id, w, 't' FROM a),
    n AS (SELECT task_id, list_sort(list_distinct(list(x))) AS mid FROM (SELECT task_id, v AS x FROM a UNION SELECT task_id, w FROM a) GROUP BY task_id),
    g AS (SELECT n.task_id, any_value(n.mid) AS mid, list_sort(list(e.s || '->' || e.d)) AS edges FROM n JOIN e USING (task_id) GROUP BY n.task_id),
    c AS (SELECT task_id, mid, edges, list_filter(mid, lambda x, i: (mask >> (i - 1)) & 1 = 1) || ['s'] AS side FROM g, unnest(range(1 << len(mid))) m(mask)),
    k AS (SELECT task_id, side, mid, list_filter(edges, lambda x: list_contains(side, split_part(x, '->', 1)) <> list_contains(side, split_part(x, '->', 2))) AS cut FROM c),
    b AS (SELECT task_id, arg_min(struct_pack(side, mid, cut), row(len(cut), len(side))) AS b FROM k GROUP BY task_id)
    SELECT task_id, 0 AS cut_ix, len(b.cut)::DOUBLE AS weight, array_to_string(b.cut, ' ') AS edges, array_to_string(list_sort(b.side), ' ') AS source, array_to_string(list_sort(list_filter(b.mid || ['t'], lambda x: NOT list_contains(b.side, x))), ' ') AS sink FROM b""")  # fmt: skip
def min_cut(spark: SparkSession, d: str) -> DataFrame:
    return _cut_text(mincut.cuts(_cut_edges(spark, d), first_only=True))


@query("min_cut_all")
def min_cut_all(spark: SparkSession, d: str) -> DataFrame:
    return _cut_text(mincut.cuts(_cut_edges(spark, d)))


# One project is a run; its library is the greatest node of the side, and families are groups of two and more.
@query("plan_constraints", f"""
    WITH RECURSIVE {BATCH}, {_SINK}, {_levels('o', 'true')},
    fam AS (SELECT project, node, 'family:' || grp AS family FROM art WHERE node >= 0 AND (project, grp) IN (SELECT (project, grp) FROM art WHERE node >= 0 GROUP BY 1 HAVING count(*) >= 2)),
    inf AS (SELECT art.project, art.node, art.grp, art.gav, coalesce(family, art.node::VARCHAR) AS own, family IS NOT NULL AS isf FROM art LEFT JOIN fam ON fam.project = art.project AND fam.node = art.node),
    run AS (SELECT project, max(node) AS lib FROM sink GROUP BY project),
    rows AS (SELECT r.project, r.node, lib, r.node = lib AS is_lib, a.own AS nown, a.grp AS ngrp, b.own AS rown, b.isf, b.grp AS rgrp, min(b.gav) AS gav, min(r.root) AS root FROM r JOIN run USING (project) JOIN inf a ON a.project = r.project AND a.node = r.node JOIN inf b ON b.project = r.project AND b.node = r.root GROUP BY ALL),
    dis AS (SELECT rows.*, o.len AS d, row_number() OVER (PARTITION BY rows.project, nown, rown, is_lib ORDER BY o.len, rows.node) AS k FROM rows JOIN o ON o.project = rows.project AND o.node = rows.node),
    kept AS (SELECT *, count(*) OVER (PARTITION BY project, node) AS n FROM dis WHERE k = 1 OR is_lib),
    many AS (SELECT *, row_number() OVER (PARTITION BY project, node, rgrp ORDER BY gav, root) AS first FROM kept WHERE n > 1),
    cons AS (SELECT project, node, is_lib, d, rown, isf, root, CASE WHEN rgrp = ngrp OR root = lib THEN 'AROUND' ELSE 'FROM_ROOT' END AS kind FROM kept WHERE n = 1 AND is_lib
        UNION ALL SELECT project, node, is_lib, d, rown, isf, root, 'SHARED' FROM many WHERE first = 1 AND rgrp <> ngrp),
    mem AS (SELECT c.*, coalesce(fam.node, root) AS member FROM cons c LEFT JOIN fam ON fam.project = c.project AND fam.family = c.rown),
    far(project, start, node, len) USING KEY (project, start, node) AS (SELECT DISTINCT project, member, member, 0 FROM mem
        UNION SELECT f.project, f.start, dst, any_value(f.len) + 1 FROM far f JOIN dep ON dep.project = f.project AND src = f.node LEFT JOIN recurring.far q ON q.project = dep.project AND q.start = f.start AND q.node = dst WHERE q.node IS NULL GROUP BY f.project, f.start, dst),
    best AS (SELECT m.*, far.len, row_number() OVER (PARTITION BY m.project, m.node, rown ORDER BY far.len NULLS LAST, member) AS b FROM mem m LEFT JOIN far ON far.project = m.project AND far.start = member AND far.node = m.node),
    grp AS (SELECT project, node, kind, is_lib, d, CASE WHEN kind = 'AROUND' THEN '' ELSE string_agg(member || '<=' || greatest(5, CASE WHEN len IS NULL OR (kind = 'FROM_ROOT' AND NOT isf) THEN 3 ELSE len END), ' ' ORDER BY member) END AS roots FROM best WHERE b = 1 GROUP BY project, node, kind, is_lib, d)
    SELECT project, node, kind, row_number() OVER (PARTITION BY project ORDER BY is_lib, d, node)::INTEGER AS place, roots FROM grp""")  # fmt: skip
def plan_constraints(spark: SparkSession, d: str) -> DataFrame:
    x = batch_inputs(spark, d)
    artifacts = x.artifacts
    tops = stage(_side_roots(x), "tops")
    runs = artifacts.filter("node % 3 <> 0 and node >= 0").groupBy("project").agg(F.max("node").alias("lib")).select(F.col("project").alias("run"), "project", "lib")
    members = stage(graph.families(artifacts.filter(F.col("node") != ROOT), by=["project"]), "members")
    dist = graph.nearest(x.links(), x.projects.select("project", F.col("root").alias("start")), by=["project"]).select("project", "node", F.col("len").alias("dist"))
    lengths = graph.distances(x.links(), tops.select("project", F.col("root").alias("start")).unionByName(members.select("project", F.col("node").alias("start"))).distinct(), by=["project"])
    planned = constraints.plan(runs, tops.withColumnRenamed("project", "run"), artifacts, members, dist, lengths)
    return planned.select("project", "node", "kind", "place", F.concat_ws(" ", F.transform("roots", lambda r: F.concat_ws("<=", r["root"], r["bound"]))).alias("roots"))
