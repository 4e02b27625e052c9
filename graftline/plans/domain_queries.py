"""Queries of the composite operators: suggestions, steps, batches, files and the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators import modules, recommend
from graftline.plans.derived import ART, BATCH, artifacts, batch_inputs, batch_tasks, edge_sql, edges, table
from graftline.sources import files, sinks
from graftline.staging import new_folder, stage
from graftline.streaming import queue

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _valid(x: recommend.Inputs) -> DataFrame:
    return recommend.validated(stage(batch_tasks(x), "asked"), x).filter("problem is null").select("task_id", "project", "lib", "target")


@query("task_errors", f"""
    WITH {BATCH} SELECT t.project AS task_id, CASE WHEN t.project % 97 = 0 THEN 'INVALID_TARGET' WHEN t.project % 89 = 0 THEN 'UNKNOWN_LIBRARY' WHEN v.lib IS NULL THEN 'WRONG_SCOPE' END AS problem FROM task t LEFT JOIN valid v USING (project)""")  # fmt: skip
def task_errors(spark: SparkSession, d: str) -> DataFrame:
    x = batch_inputs(spark, d)
    return recommend.validated(batch_tasks(x), x).select("task_id", "problem")


# From the rules of an update, not from the operators: pick, sub-graph, decision by root path and length, calls, checks, status.
@query("simple_update", f"""
    WITH RECURSIVE {BATCH}, {edge_sql('all_eco', 'N')},
    ee AS (SELECT * FROM all_eco WHERE src % 7 <> 0 AND dst % 7 <> 0 AND (src + dst) % 3 = 0),
    pick AS (SELECT v.project, arg_min(pt.version, pt.node) AS version, arg_min(e.cand, pt.node) AS cand FROM valid v JOIN pt ON pt.grp = v.grp AND pt.artifact = v.artifact AND [pt.major, pt.minor] >= [v.major, 0]
        JOIN (SELECT gav, min(node) AS cand FROM eco GROUP BY gav) e USING (gav) GROUP BY v.project),
    usg(project, node, d) AS (SELECT project, cand, 0 FROM pick UNION SELECT project, dst, d + 1 FROM usg JOIN ee ON src = node WHERE d < 3),
    upd(project, node) AS (SELECT project, lib FROM valid UNION SELECT upd.project, dst FROM upd JOIN dep ON dep.project = upd.project AND src = node JOIN art a ON a.project = dep.project AND a.node = dst
        JOIN art b ON b.project = dep.project AND b.node = src WHERE included AND a.compile AND b.compile),
    sp(project, node, len, path) USING KEY (project, node) AS (SELECT DISTINCT project, -1::BIGINT, 0, [-1::BIGINT] FROM it
        UNION SELECT sp.project, dst, any_value(sp.len) + 1, min(list_append(sp.path, dst)) FROM sp JOIN dep ON dep.project = sp.project AND src = sp.node
            LEFT JOIN recurring.sp r ON r.project = dep.project AND r.node = dst WHERE r.node IS NULL GROUP BY sp.project, dst),
    old AS (SELECT project, grp, artifact, arg_min(node, node) AS old, arg_min(version, node) AS version, arg_min(gav, node) AS base FROM art GROUP BY 1, 2, 3),
    chg AS (SELECT u.project, u.node AS new, old.old, old.base, eco.gav AS next, min(u.d) AS new_len FROM usg u JOIN eco USING (node) JOIN old ON old.project = u.project AND old.grp = eco.grp AND old.artifact = eco.artifact WHERE old.version <> eco.version GROUP BY 1, 2, 3, 4, 5),
    dec AS (SELECT chg.*, list_contains(sp.path, valid.lib) OR sp.len >= new_len + 1 AS chk FROM chg JOIN valid USING (project) JOIN sp ON sp.project = chg.project AND sp.node = old),
    risk AS (SELECT dec.*, cal.src, cal.c, cal.m, cal.p FROM dec JOIN cal ON cal.project = dec.project AND cal.dst = old WHERE chk AND EXISTS (SELECT 1 FROM art WHERE art.project = dec.project AND art.node = cal.src AND compile)
        AND NOT EXISTS (SELECT 1 FROM upd WHERE upd.project = dec.project AND upd.node = cal.src)),
    prs AS (SELECT a.gav AS base, b.gav AS next, a.node AS a, b.node AS b FROM pt a JOIN pt b ON a.grp = b.grp AND a.artifact = b.artifact AND a.version <> b.version AND (a.node + b.node) % 5 <> 0),
    doc AS (SELECT DISTINCT gav FROM pt WHERE node % 29 <> 0),
    hits AS (SELECT r.project, r.old, r.new, count(*) FILTER (WHERE (a + b + r.c) % 3 = 0 AND (CASE WHEN src = -1 THEN a % 5 = m AND p = 1 ELSE (a + r.c) % 4 = 0 OR (b % 5 = m AND p = 0) END)) + count(*) FILTER (WHERE (a + b) % 4 = 0 AND (a + b) % 5 = m) AS n
        FROM risk r JOIN prs USING (base, next) GROUP BY 1, 2, 3),
    vio AS (SELECT DISTINCT d.project, d.old, d.new, 'EMPTY_CG' AS problem, 0 AS n FROM dec d WHERE chk AND project % 11 = 0
        UNION ALL SELECT r.project, r.old, r.new, CASE WHEN bool_or(r.base NOT IN (SELECT gav FROM doc) OR r.next NOT IN (SELECT gav FROM doc) OR NOT EXISTS (SELECT 1 FROM prs WHERE prs.base = r.base AND prs.next = r.next AND (r.src <> -1 OR (a + b) % 7 <> 0))) THEN 'FAILED_SIGTEST' END, coalesce(any_value(h.n), 0)
            FROM risk r LEFT JOIN hits h ON h.project = r.project AND h.old = r.old AND h.new = r.new GROUP BY r.project, r.old, r.new
        UNION ALL SELECT project, old, new, NULL, 1 FROM dec WHERE NOT chk),
    agg AS (SELECT project, count(*) FILTER (WHERE n > 0) AS v, sum(n) AS c, bool_or(problem = 'EMPTY_CG') AS cg, bool_or(problem = 'FAILED_SIGTEST') AS sig FROM vio GROUP BY project),
    res AS (SELECT v.project, v.lib, pick.cand, pick.version, CASE WHEN coalesce(cg, false) THEN 'EMPTY_CG' WHEN cand IS NULL THEN 'NO_NEO4J_ENTRY' WHEN coalesce(sig, false) THEN 'FAILED_SIGTEST' ELSE 'SUCCESS' END AS status, agg.v, agg.c FROM valid v LEFT JOIN pick USING (project) LEFT JOIN agg USING (project))
    SELECT project AS task_id, project, lib, cand, version AS cand_version, status, (CASE WHEN status = 'SUCCESS' THEN coalesce(v, 0) ELSE -1 END)::BIGINT AS nr_violations, (CASE WHEN status = 'SUCCESS' THEN coalesce(c, 0) ELSE -1 END)::BIGINT AS nr_calls,
        cand IS NOT NULL AND (status <> 'SUCCESS' OR v IS NULL) AS is_perfect, true AS is_simple FROM res""")  # fmt: skip
def simple_update(spark: SparkSession, d: str) -> DataFrame:
    x = batch_inputs(spark, d)
    return recommend.simple_update(stage(_valid(x), "tasks"), x)


@query("min_cut_update")
def min_cut_update(spark: SparkSession, d: str) -> DataFrame:
    x = batch_inputs(spark, d)
    found = recommend.min_cut_updates(stage(_valid(x), "tasks"), x)
    steps = F.concat_ws(" ", F.transform("update_steps", lambda s: F.concat_ws("=>", s["from"], s["to"])))
    return found.withColumn("update_steps", steps)


@query("batch_recommend")
def batch_recommend(spark: SparkSession, d: str) -> DataFrame:
    x = batch_inputs(spark, d)
    return recommend.recommend(batch_tasks(x), x)


@query("update_steps", f"""
    WITH {ART}, g AS (SELECT *, grp || ':' || artifact || ':' || version AS gav FROM art),
    known AS (SELECT * FROM g WHERE ord % 2 = 0), upd AS (SELECT * FROM g WHERE ord % 2 = 1), cutn AS (SELECT * FROM known),
    a AS (SELECT k.old_gav, u.gav AS new_gav FROM upd u JOIN (SELECT grp, artifact, arg_min(gav, ord) AS old_gav FROM known GROUP BY 1, 2) k USING (grp, artifact)),
    x AS (SELECT c.grp, c.artifact, c.gav AS old_gav, u.new_gav FROM cutn c LEFT JOIN (SELECT grp, artifact, arg_min(gav, ord) AS new_gav FROM upd GROUP BY 1, 2) u USING (grp, artifact)),
    l AS (SELECT x.old_gav, arg_min(u.gav, u.ord) AS new_gav FROM x JOIN upd u ON contains(u.grp, x.grp) AND contains(u.artifact, x.artifact) WHERE x.new_gav IS NULL GROUP BY x.old_gav)
    SELECT * FROM a UNION SELECT old_gav, new_gav FROM x WHERE new_gav IS NOT NULL UNION SELECT * FROM l""")  # fmt: skip
def update_steps(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).select("grp", "artifact", "version", "ord")
    known, new = a.filter("ord % 2 = 0"), a.filter("ord % 2 = 1")
    return recommend.update_steps(new, known, new, known)


@query("input_check", "SELECT * FROM (VALUES ('part', true, true), ('lineitem', true, true), ('orders', true, false), ('no_such_table', false, false)) t(name, found, complete)")
def input_check(spark: SparkSession, d: str) -> DataFrame:
    return files.check_inputs(spark, d, {"part": ["p_partkey"], "lineitem": ["l_orderkey", "l_partkey"], "orders": ["nothing"], "no_such_table": ["x"]})


@query("file_roundtrip", f"""
    WITH {ART}, {edge_sql('e', 'R')} SELECT grp, count(*) AS n_rows, min(grp || ':' || artifact || ':' || version || ',x:y:1') AS first_steps, true AS listed, (SELECT count(*) + 2 FROM e) AS n_lines FROM art GROUP BY grp""")  # fmt: skip
def file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions written as text tables by brand, listed and read again, and a drawing."""
    out = new_folder(spark, "roundtrip")
    a = artifacts(spark, d)
    gav = F.concat_ws(":", "grp", "artifact", "version")
    steps = a.select("grp", gav.alias("orgGav"), F.array(F.struct(gav.alias("from"), F.lit("x:y:1").alias("to"))).alias("updateSteps"))
    sinks.suggestions(steps, f"{out}/steps", "grp")
    sinks.dot(edges(spark, d, "R"), f"{out}/dot")
    found = files.listing(spark, f"{out}/steps", "*.csv").groupBy("folder").agg(F.count("*").alias("n_files"))
    rows = spark.read.option("header", True).csv(f"{out}/steps").groupBy("grp").agg(F.count("*").alias("n_rows"), F.min("updateSteps").alias("first_steps"))
    drawn = spark.read.text(f"{out}/dot").agg(F.count("*").alias("n_lines"))
    return rows.join(found.select(F.url_decode(F.substring_index("folder", "grp=", -1)).alias("grp"), (F.col("n_files") > 0).alias("listed")), "grp", "left").crossJoin(drawn)


@query("project_files", f"""
    WITH {BATCH} SELECT 'artifacts' AS what, count(*) AS n FROM art UNION ALL SELECT 'deps', count(*) FROM dep UNION ALL SELECT 'steps', count(*) FROM task WHERE project % 89 <> 0
    UNION ALL SELECT 'markers', count(*) FROM task UNION ALL SELECT 'errors', count(*) FROM task WHERE project % 97 = 0 UNION ALL SELECT 'requests', count(*) FROM pt WHERE node % 5 = 0 UNION ALL SELECT 'jobs', count(*) FROM task
    UNION ALL SELECT 'results', count(*) FROM task UNION ALL SELECT 'archives', count(*) FROM task UNION ALL SELECT 'entries', 2 * count(*) FROM task UNION ALL SELECT 'commits', count(*) FROM task""")  # fmt: skip
def project_files(spark: SparkSession, d: str) -> DataFrame:
    """Every project's graph, steps, marker, error, request, job, result and archive through its sink and its source."""
    out, x = new_folder(spark, "projects"), batch_inputs(spark, d)
    a = F.struct(F.col("node").cast("string").alias("id"), F.col("node").alias("numericId"), F.col("grp").alias("groupId"), F.col("artifact").alias("artifactId"), "version", "scopes")
    e = F.struct(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.when(F.col("included"), "INCLUDED").otherwise("OMITTED").alias("resolution"))
    graphs = x.artifacts.groupBy("project").agg(F.collect_list(a).alias("artifacts")).join(x.deps.groupBy("project").agg(F.collect_list(e).alias("dependencies")), "project", "left")
    graphs.select(F.to_json(F.struct(F.col("project").cast("string").alias("graphName"), "artifacts", "dependencies")).alias("value")).write.text(f"{out}/graphs")
    arts, deps = files.graph_json(spark, f"{out}/graphs", lines=True)
    t = stage(batch_tasks(x), "tasks")
    name = F.col("project").cast("string")
    sinks.suggestions(t.select(name.alias("projectName"), "org_gav", "target_gav").select("projectName", F.col("org_gav").alias("orgGav"), F.when(F.col("projectName").cast("long") % 89 != 0, F.col("target_gav")).alias("newGav")), f"{out}/steps")
    steps = files.with_gavs(files.update_steps(spark, f"{out}/steps", by_name=True))
    sinks.markers(t.select(name.alias("path")), f"{out}/markers")
    sinks.errors(t.filter("project % 97 = 0").select(name.alias("module"), F.lit("no target").alias("message")), f"{out}/errors")
    sinks.requests(x.eco_nodes.sparkSession.read.parquet(f"{d}/part.parquet").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("base"), F.lit("1").alias("next")), f"{out}/requests")
    sinks.jobs(t, f"{out}/jobs")
    sinks.results(t, f"{out}/results")
    entry = F.explode(F.array(F.struct(F.lit("steps.csv").alias("name"), F.encode("org_gav", "UTF-8").alias("content")), F.struct(F.lit("COMMIT").alias("name"), F.encode(F.concat(F.lit("c"), name, F.lit("\n")), "UTF-8").alias("content"))))
    zips = stage(sinks.packed(t.select(name.alias("project"), entry.alias("f")).select("project", "f.*"), "202601010000"), "zips")
    inside = stage(files.unpacked(zips.select(F.col("archive").alias("path"), "content")), "inside")
    n = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    commits = inside.filter("entry = 'COMMIT' and decode(content, 'UTF-8') = concat('c', split_part(path, '_', 1), '\n')")
    return modules.gather([n("artifacts", arts), n("deps", deps), n("steps", steps), n("markers", spark.read.csv(f"{out}/markers")), n("errors", spark.read.text(f"{out}/errors")), n("requests", spark.read.option("header", True).csv(f"{out}/requests")), n("jobs", spark.read.text(f"{out}/jobs")), n("results", spark.read.parquet(f"{out}/results")), n("archives", zips), n("entries", inside.filter("error is null")), n("commits", commits)])


@query("queue_stream", "SELECT event_type, count(*) AS n, min(user_id) AS first_user FROM events GROUP BY event_type")
def queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events through the queue: produced as messages, drained by a stream, counted."""
    base = new_folder(spark, "queue")
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    queue.produce(e.select(F.to_json(F.struct("event_type", "user_id")).alias("projectNameFolder")), f"{base}/messages")

    queue.drain(spark, f"{base}/messages", files.MESSAGE_SCHEMA, queue.worker(lambda batch: batch, base), f"{base}/checkpoint")
    m = spark.read.parquet(f"{base}/results").select(F.from_json("projectNameFolder", "event_type string, user_id long").alias("m")).select("m.*")
    return m.groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"))


