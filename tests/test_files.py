import zipfile

from pyspark.sql import functions as F

from graftline.sources import files, sinks
from graftline.streaming import queue


def test_storage_and_settings(spark):
    assert files.storage_kind("file:/home") == "local" and files.storage_kind("https://h/x") == "web" and files.storage_kind("x") is None
    spark.conf.set("graftline.test", "no number")
    assert files.setting(spark, "graftline.test", 5) == 5 and files.setting(spark, "graftline.absent", 3) == 3


def test_graph_and_steps(spark, tmp_path):
    (tmp_path / "m_dependency-graph.json").write_text('{"graphName":"g","artifacts":[{"id":"a","numericId":1,"groupId":"g","artifactId":"x","version":"1","scopes":["compile"]}],\n"dependencies":[{"from":"a","to":"b","numericFrom":1,"numericTo":2,"resolution":"INCLUDED"},{"from":"a","to":"b","numericFrom":1,"numericTo":2,"resolution":"INCLUDED"}]}')
    a, e = files.graph_json(spark, str(tmp_path / "m_dependency-graph.json"))
    assert a.collect()[0].scopes == ["compile"] and e.count() == 1
    (tmp_path / "o_r").mkdir()
    (tmp_path / "o_r" / "s_update-steps.csv").write_text("projectName,orgGav,newGav\np,g:a:1,g:a:2\nq, ,g:a:2\n")
    (tmp_path / "o_r" / "s_graph-analysis.csv").write_text("x\n")
    (tmp_path / "o_r" / "COMMIT").write_text(" abc \nsecond\n")
    (tmp_path / "o_r" / "s_recommendation_results.csv").write_text("x\n")
    assert [r.name for r in files.step_files(spark, str(tmp_path)).collect()] == ["s_update-steps.csv"]
    assert sorted(r.name for r in files.step_files(spark, str(tmp_path), worker=True).collect()) == ["s_recommendation_results.csv", "s_update-steps.csv"]
    read = files.with_gavs(files.update_steps(spark, str(tmp_path / "o_r" / "s_update-steps.csv"), by_name=True)).collect()
    assert [(r.projectName, r.inDegree, r.transitive, r.buildResult) for r in read] == [("p", 0, False, None)]
    got = files.commits(spark, str(tmp_path)).collect()
    assert [(r.folder, r.commit) for r in got] == [("o_r", "abc")]
    modules = spark.createDataFrame([("M",), ("none",)], "module string")
    found = {r.module: r.graph for r in files.graph_files(files.listing(spark, str(tmp_path)), modules).collect()}
    assert found["M"].endswith("m_dependency-graph.json") and found["none"] is None


def test_lists_archives_and_versions(spark, tmp_path):
    assert files.name_list(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "done.txt").write_text(" a \nb\n")
    assert [r.name for r in files.name_list(spark, str(tmp_path / "done.txt")).collect()] == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "l.jar", "w") as z:
        z.writestr("p/q/A.class", "")
        z.writestr("readme", "")
    (tmp_path / "broken.jar").write_text("no archive")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "B.class").write_text("x")
    found = files.archive_classes(spark, str(tmp_path)).collect()
    assert {r.class_name for r in found} == {"p.q.A", "c.B", None} and [r.path.split("/")[-1] for r in found if r.error] == ["broken.jar"]
    entries = files.archive_entries(spark, str(tmp_path), "*.jar").collect()
    assert {(r.entry, r.content, r.error is None) for r in entries} == {("p/q/A.class", b"", True), ("readme", b"", True), (None, None, False)}
    assert files.fetch(spark, str(tmp_path / "l.jar"), str(tmp_path / "copy.zip")) and (tmp_path / "copy.zip").read_bytes() == (tmp_path / "l.jar").read_bytes()
    df = spark.createDataFrame([(1, '{"response":{"docs":[{"v":"2"},{"v":"1"}]}}'), (2, "no json")], "k int, body string")
    assert [(r.pos, r.version) for r in files.available_versions(df, "k", "body").collect()] == [(0, "2"), (1, "1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", [("a", "b"), ("c", "d")], 1)], "project string, updateSteps array<struct<from:string,to:string>>, n int")
    sinks.suggestions(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0].updateSteps == "a,b/c,d"
    name = spark.createDataFrame([(" ",), ("x",)], "p string").select(sinks.result_name(F.col("p"), F.lit("parent")).alias("r"))
    assert [r.r for r in name.collect()] == ["parent_recommendation_results.csv", "x_recommendation_results.csv"]


def test_drawings_and_archives(spark, tmp_path):
    sinks.dot(spark.createDataFrame([(1, 2)], "src int, dst int"), str(tmp_path / "dot"), spark.createDataFrame([(1, "g:a:1")], "node int, label string"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()] == ["strict digraph G {", '  "1" [ label="g:a:1" ];', '  "1" -> "2";', "}"]
    packed = sinks.packed(spark.createDataFrame([("p", "a.csv", bytearray(b"1")), ("p", "b.csv", bytearray(b"2"))], "project string, name string, content binary"), "202601020304")
    sinks.put(packed, str(tmp_path / "up"))
    with zipfile.ZipFile(tmp_path / "up" / "p_202601020304.zip") as z:
        assert z.namelist() == ["a.csv", "b.csv"] and z.read("b.csv") == b"2"


def test_an_error_is_a_row_of_its_message(spark, tmp_path):
    def pipeline(batch):
        if batch.filter("projectNameFolder = 'bad'").count():
            raise ValueError("no such project")
        return batch

    queue.produce(spark.createDataFrame([("good",), ("bad",)], "projectNameFolder string"), str(tmp_path / "q"))
    queue.drain(spark, str(tmp_path / "q"), files.MESSAGE_SCHEMA, queue.worker(pipeline, str(tmp_path / "out")), str(tmp_path / "c"))
    assert [r.projectNameFolder for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()] == ["good"]
    assert {(r.projectNameFolder, r.error) for r in spark.read.parquet(str(tmp_path / "out" / "status")).collect()} == {("good", None), ("bad", "no such project")}


def test_queue_is_drained_once(spark, tmp_path):
    seen = []
    projects = spark.createDataFrame([("b",), ("a",)], "projectNameFolder string")
    work = lambda batch, n: seen.extend(sorted(r.projectNameFolder for r in batch.collect()))
    for _ in range(2):
        queue.produce(projects, str(tmp_path / "q"))
        queue.drain(spark, str(tmp_path / "q"), files.MESSAGE_SCHEMA, work, str(tmp_path / "c"))
    queue.drain(spark, str(tmp_path / "q"), files.MESSAGE_SCHEMA, work, str(tmp_path / "c"))
    assert seen == ["a", "b"] * 2


def test_archives_of_many_projects_are_packed_in_turn(spark, monkeypatch):
    """A worker packs and unpacks many small archives in one batch."""
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInArrow", None)  # one call for each project
    n = 400
    rows = spark.range(n).selectExpr("id as project", "explode(array('b', 'a', 'c/d')) as name").selectExpr("project", "name", "cast(concat(name, project) as binary) as content")
    zips = sinks.packed(rows, "1").coalesce(1)
    inside = files.unpacked(zips.withColumnRenamed("archive", "path"))

    def batches(it):
        import pyarrow as pa

        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    assert zips.count() == n
    sizes = [r.n for r in inside.mapInArrow(batches, "n long").collect()]
    assert sum(sizes) == 3 * n and len(sizes) == 1
    got = sorted((r.path, r.entry, bytes(r.content)) for r in inside.filter("error is null").collect())
    assert got == sorted((f"{p}_1.zip", e, f"{e}{p}".encode()) for p in range(n) for e in ("a", "b", "c/d"))
