"""Queries of the scalar functions, version orders and report grammars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import names, reports, versions
from graftline.plans.derived import artifacts, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("gav_projection", """
    SELECT p_partkey AS node, p_brand || ':' || p_name || ':' || p_size AS gav, p_brand AS grp, p_name AS artifact, p_size::VARCHAR AS version,
        p_size::VARCHAR AS target_version, p_size % 2 = 0 AS is_naive
    FROM part""")  # fmt: skip
def gav_projection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    gav = names.gav(F.col("p_brand"), F.col("p_name"), F.col("p_size"))
    target = names.gav(F.col("p_brand"), F.col("p_name"), F.col("p_size") + F.col("p_size") % 2)
    parts = names.gav_parts(gav)
    return p.select(F.col("p_partkey").alias("node"), gav.alias("gav"), parts["group"].alias("grp"), parts["artifact"].alias("artifact"), parts["version"].alias("version"), names.target_version(gav).alias("target_version"), names.is_naive(target, gav).alias("is_naive"))


@query("path_to_gav", """
    WITH p AS (SELECT page_id, '/home/u/.m2/repository/' || regexp_replace(url, '^[a-z]+://', '') || '/x.jar' AS path, url FROM pages),
    s AS (SELECT page_id, path, url, string_split(regexp_replace(regexp_replace(path, '^.*\\.m2/repository/', ''), '/+[^/]*$', ''), '/') AS parts FROM p)
    SELECT page_id, array_to_string(list_filter(parts[1:len(parts) - 2], lambda x: regexp_matches(x, '\\S')), '.') || ':' || parts[len(parts) - 1] || ':' || parts[len(parts)] AS gav,
        regexp_replace(path, '^.+/', '') AS file, replace(replace(path, '/', '.'), '.class', '') AS class_name, regexp_replace(url, '\\.[^.]*$', '') AS package
    FROM s""")  # fmt: skip
def path_to_gav(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("path", F.concat(F.lit("/home/u/.m2/repository/"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/x.jar")))
    path = F.col("path")
    return p.select("page_id", names.path_to_gav(path, F.lit("root:root:1")).alias("gav"), names.file_name(path).alias("file"), names.class_of_entry(path).alias("class_name"), names.package_of(F.col("url")).alias("package"))


@query("group_clearing", """
    WITH g AS (SELECT DISTINCT p_brand AS b, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'org.springframework.' || lower(p_brand) ELSE p_brand END AS grp FROM part)
    SELECT grp, CASE WHEN grp LIKE 'org.springframework%' THEN 'org.springframework' ELSE grp END AS cleared,
        (CASE WHEN grp LIKE 'org.springframework%' THEN 'org.springframework' ELSE grp END) = 'org.springframework' AS with_framework FROM g""")  # fmt: skip
def group_clearing(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    g = table(spark, d, "part").select(F.when(b.like("Brand#1%"), F.concat(F.lit("org.springframework."), F.lower(b))).otherwise(b).alias("grp")).distinct()
    return g.select("grp", names.cleared_group(F.col("grp")).alias("cleared"), names.same_family(F.col("grp"), F.lit("org.springframework.boot")).alias("with_framework"))


@query("name_normalise", """
    WITH c AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '_projectRun1_x' ELSE '_a_b' END AS n FROM customer)
    SELECT c_custkey, CASE WHEN contains(n, 'projectRun') THEN array_to_string(list_filter(string_split(n, '_'), lambda x: NOT starts_with(x, 'projectRun')), '_') ELSE n END AS project,
        'https://host/' || string_split(n, '_')[1] || '/' || array_to_string(string_split(n, '_')[2:], '_') AS url,
        CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '_m' || c_custkey END AS module FROM c JOIN customer USING (c_custkey)""")  # fmt: skip
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("n", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "_projectRun1_x").otherwise("_a_b")))
    key = F.col("c_custkey")
    path = F.when(key % 2 == 0, "pom").otherwise("m/pom")
    return c.select("c_custkey", names.project_name(F.col("n")).alias("project"), names.repository_url(F.col("n"), "https://host/").alias("url"), names.module_name(path, F.lit("pom"), F.col("c_name"), F.concat(F.lit("m"), key.cast("string"))).alias("module"))


@query("signature_parse", """
    SELECT p_partkey, replace(p_name, ' ', '') AS name, 'java.' || p_type AS return_type, 'public|final' AS qualifiers,
        CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'int' ELSE 'int|java.' || p_type END AS params, (p_size % 3)::INTEGER AS n_params,
        greatest(1, p_size % 3)::INTEGER AS n_literal FROM part""")  # fmt: skip
def signature_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("public final java."), F.col("p_type"), F.lit(" com."), F.regexp_replace("p_brand", "#", ""), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.lit("("), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "int").otherwise(F.concat(F.lit("int,java."), F.col("p_type"))), F.lit(")"))
    s = names.signature(text)
    return table(spark, d, "part").select("p_partkey", s["name"].alias("name"), s["return_type"].alias("return_type"), F.concat_ws("|", s["qualifiers"]).alias("qualifiers"), F.concat_ws("|", s["params"]).alias("params"), F.size(s["params"]).alias("n_params"), F.size(names.signature(text, literal=True)["params"]).alias("n_literal"))


def order_reports(spark: SparkSession, d: str) -> DataFrame:
    """report_id, text, n: a binary report for each order, with two blocks; every seventh status line is off by one."""
    i = table(spark, d, "lineitem")
    entry = F.concat(F.lit('  "E1.2 - API type removed" : '), F.when(F.col("l_returnflag") == "R", "field").otherwise("method"), F.lit(" public int p"), F.col("l_partkey").cast("string"), F.lit(".m"), F.col("l_linenumber").cast("string"))
    half = F.when(F.col("l_linestatus") == "F", "F").otherwise("O")
    blocks = i.groupBy("l_orderkey", half.alias("half")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("b"), F.count("*").alias("n"))
    one = F.concat(F.lit("Class org."), F.col("half"), F.col("l_orderkey").cast("string"), F.lit("\n"), F.col("b"), F.lit("\n  warn : method none x\n\n"))
    per = blocks.withColumn("t", one).groupBy(F.col("l_orderkey").alias("report_id")).agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("t"), F.sum("n").alias("n"))
    said = F.col("n") + (F.col("report_id") % 7 == 0).cast("int")
    return per.select("report_id", F.concat(F.lit("Classes: 2\nBase version: 1\n\n\n"), F.col("t"), F.lit("\nSTATUS:Failed."), said.cast("string"), F.lit(" errors\n")).alias("text"), "n")


@query("report_blocks", """
    SELECT l_orderkey AS report_id, 'org.' || (CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'O' END) || l_orderkey AS class_name,
        (count(*) FILTER (WHERE l_returnflag <> 'R'))::INTEGER AS n_methods, (count(*) FILTER (WHERE l_returnflag = 'R'))::INTEGER AS n_fields, 0::INTEGER AS n_interfaces,
        coalesce(min('public int p' || l_partkey || '.m' || l_linenumber) FILTER (WHERE l_returnflag <> 'R'), '') AS first_method
    FROM lineitem GROUP BY l_orderkey, (CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'O' END)""")  # fmt: skip
def report_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = reports.parse_binary(order_reports(spark, d))
    return b.select("report_id", "class_name", F.size("methods").alias("n_methods"), F.size("fields").alias("n_fields"), F.size("interfaces").alias("n_interfaces"), F.coalesce(F.array_min("methods"), F.lit("")).alias("first_method"))


@query("report_status_check", """
    SELECT l_orderkey AS report_id, count(*) AS parsed, count(*) + (l_orderkey % 7 = 0)::INTEGER AS declared, 'Failed' AS status, l_orderkey % 7 <> 0 AS valid FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def report_status_check(spark: SparkSession, d: str) -> DataFrame:
    return reports.status_check(order_reports(spark, d))


@query("source_report", """
    WITH t AS (SELECT l_orderkey AS report_id, 'k' || l_suppkey AS class_name, l_partkey, l_returnflag FROM lineitem)
    SELECT report_id, class_name, (count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'A'))::INTEGER AS n_methods, (count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'N'))::INTEGER AS n_interfaces FROM t GROUP BY report_id, class_name""")  # fmt: skip
def source_report(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a source report: removed classes, methods and super types of an order's items."""
    i = table(spark, d, "lineitem")
    name, part = F.concat(F.lit("k"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string")
    line = F.when(F.col("l_returnflag") == "R", name).when(F.col("l_returnflag") == "A", F.concat(name, F.lit(":   method public int x.m"), part, F.lit("()"))).otherwise(F.concat(name, F.lit(":   s"), part))
    title = {"R": "Missing Classes\n---------------\n\n", "A": "Missing Methods\n---------------\n\n", "N": "Missing Superclasses or Superinterfaces\n---------------------------------------\n\n"}
    body = [F.concat(F.lit(t), F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, line))), "\n"), F.lit("\n\nAdded Methods\n-------------\n\nz:  method int z.z()\n\n")) for f, t in title.items()]
    text = i.groupBy(F.col("l_orderkey").alias("report_id")).agg(F.concat(F.lit("SignatureTest report\n\n\n"), *body).alias("text"))
    p = reports.parse_source(text)
    return p.select("report_id", "class_name", F.size("methods").alias("n_methods"), F.size("interfaces").alias("n_interfaces"))


@query("version_text_order", "SELECT p_partkey, p_size::VARCHAR || '.' || (p_partkey % 13)::VARCHAR AS version FROM part WHERE p_size::VARCHAR || '.' || (p_partkey % 13)::VARCHAR >= '4.9'")
def version_text_order(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d)
    return a.filter(versions.text_at_least(F.col("version"), F.lit("4.9"))).select(F.col("node").alias("p_partkey"), "version")


@query("version_maven_order", "SELECT p_partkey, p_size::VARCHAR || '.' || (p_partkey % 13)::VARCHAR AS version, dense_rank() OVER (ORDER BY p_size, p_partkey % 13)::INTEGER AS place FROM part WHERE [p_size, p_partkey % 13] >= [4, 9]")
def version_maven_order(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).filter(versions.maven_at_least(F.col("version"), F.lit("4.9"))).select(F.col("node").alias("p_partkey"), "version")
    return versions.ranks(a, "version").select("p_partkey", "version", "place")


@query("json_versions", "SELECT event_id, json_extract_string(props, '$.k') AS v, ('{\"response\":{\"docs\":[{\"v\":\"' || json_extract_string(props, '$.k') || '\"},{\"v\":\"1.' || user_id || '\"}]}}') IS NOT NULL AS ok, '1.' || user_id AS last_version, 2::INTEGER AS n FROM events")
def json_versions(spark: SparkSession, d: str) -> DataFrame:
    from graftline.sources.files import versions_of_response

    e = table(spark, d, "events").withColumn("v", F.get_json_object("props", "$.k"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("v").alias("v")), F.struct(F.concat(F.lit("1."), F.col("user_id").cast("string")).alias("v"))).alias("docs")).alias("response")))
    found = versions_of_response(body)
    return e.select("event_id", F.get(found, F.lit(0)).alias("v"), body.isNotNull().alias("ok"), F.element_at(found, -1).alias("last_version"), F.size(found).alias("n"))


@query("mode_bitmask", "SELECT l_orderkey, l_linenumber, bit_or(1 << (l_linenumber % 4))::INTEGER AS mode, bool_or((l_linenumber & 4) <> 0) AS has_four FROM lineitem GROUP BY l_orderkey, l_linenumber")
def mode_bitmask(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bit_or(F.expr("shiftleft(1, l_linenumber % 4)")).alias("mode"), F.bool_or(names.has_mode(n, 4)).alias("has_four"))


@query("message_join", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS messages, count(DISTINCT event_type)::INTEGER AS n FROM events GROUP BY user_id")
def message_join(spark: SparkSession, d: str) -> DataFrame:
    kinds = names.joined_messages(F.array_sort(F.collect_set("event_type")))
    return table(spark, d, "events").groupBy("user_id").agg(kinds.alias("m")).select("user_id", F.col("m.text").alias("messages"), "m.n")


@query("archive_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M') AS stamp FROM orders")
def archive_stamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", names.archive_stamp(F.col("o_orderdate")).alias("stamp"))


@query("weight_round", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 4 + 0.5)::INTEGER AS weight FROM lineitem")
def weight_round(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", names.rounded_weight(F.col("l_quantity") / 4).alias("weight"))


@query("url_parts", "SELECT page_id, array_to_string(string_split(replace(url, 'https://', ''), ':'), ' ') AS parts, string_split(replace(url, 'https://', ''), ':')[1] AS host FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = names.host_port(F.col("url"), "https://")
    return table(spark, d, "pages").select("page_id", F.concat_ws(" ", parts).alias("parts"), F.get(parts, F.lit(0)).alias("host"))


@query("var_names", "SELECT p_partkey, 'n' || regexp_replace(p_brand || ':' || p_name, '[^A-Za-z0-9]', '_', 'g') AS node_name, 'n' || p_partkey AS number_name, 'p' || p_brand || '_' || p_name AS path_name FROM part")
def var_names(spark: SparkSession, d: str) -> DataFrame:
    node = F.concat_ws(":", "p_brand", "p_name")
    return table(spark, d, "part").select("p_partkey", names.variable_name(node, F.col("p_partkey")).alias("node_name"), names.variable_name(F.lit(None).cast("string"), F.col("p_partkey")).alias("number_name"), names.path_name(F.col("p_brand"), F.col("p_name")).alias("path_name"))


@query("semantic_explode", "SELECT l_orderkey, 'start' || l_partkey AS start_method, 'body' || l_suppkey AS changed_body_method FROM lineitem")
def semantic_explode(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("start"), F.col("l_partkey").cast("string")).alias("start_method"), F.concat(F.lit("body"), F.col("l_suppkey").cast("string")).alias("changed_body_method"))).alias("broken"))
    return reports.explode_semantic(i, "l_orderkey", "broken")


@query("report_codec", """
    WITH i AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'O' END AS half, '  "E1.2 - API type removed" : ' || CASE WHEN l_returnflag = 'R' THEN 'field' ELSE 'method' END || ' public int p' || l_partkey || '.m' || l_linenumber AS entry FROM lineitem),
    b AS (SELECT l_orderkey, count(*) AS n, length('Class org.' || half || l_orderkey) + 1 + sum(length(entry) + 1) + length('  warn : method none x') + 2 AS size FROM i GROUP BY l_orderkey, half)
    SELECT l_orderkey AS report_id, (length('Classes: 2Base version: 1STATUS:Failed. errors') + 6 + sum(size) + length((sum(n) + (l_orderkey % 7 = 0)::INTEGER)::VARCHAR))::INTEGER AS chars, true AS same FROM b GROUP BY l_orderkey""")  # fmt: skip
def report_codec(spark: SparkSession, d: str) -> DataFrame:
    """Reports through the codec and back."""
    r = order_reports(spark, d).withColumn("back", reports.decode_report(reports.encode_report("text")))
    return r.select("report_id", F.length("back").alias("chars"), (F.col("back") == F.col("text")).alias("same"))
