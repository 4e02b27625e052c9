"""Sources (SRC01-SRC25): graphs, tables, listings, lists and responses as DataFrames.

Paths are Hadoop paths, so that local folders, object stores and web file systems are one and the same to the readers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.names import class_of_entry

# Column names and file-name marks of the evaluation data.
GRAPH_SCHEMA = "graphName string, artifacts array<struct<id:string,numericId:long,groupId:string,artifactId:string,version:string,scopes:array<string>>>, dependencies array<struct<`from`:string,`to`:string,numericFrom:long,numericTo:long,resolution:string>>"
STEP_SCHEMA = "projectName string, inDegree int, orgGav string, newGav string, transitive boolean, buildResult string, testResult string, buildError string, testErrors string, nrtestErrors int, testFailures string, nrtestFailures int, nrOfNewerVersions int"
NOT_INPUT = ("graph-analysis", "_options-analysis.csv", "_recommendation_results.csv")
WORKER_NOT_INPUT = ("_graph-analysis", "_options-analysis.csv")
GRAPH_SUFFIX = "_dependency-graph.json"
RESPONSE = "response struct<docs: array<struct<v: string>>>"
MESSAGE_SCHEMA = "projectNameFolder string"
#: Entries of a batch, and their bytes, after which it is passed on.
ENTRIES_AT_ONCE, BYTES_AT_ONCE = 5_000, 16 << 20


def graph_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """artifacts(graph_id, node_id, numeric_id, group_id, artifact_id, version, scopes, ord) and deps(graph_id, src, dst, resolution, ord) of graph files.

    With lines every line is a graph, known by its name; else a file is one, known by its path.
    """
    read = spark.read.schema(GRAPH_SCHEMA).option("multiLine", not lines).json(path)
    g = read.withColumn("graph_id", F.col("graphName") if lines else F.col("_metadata.file_path"))
    a = g.select("graph_id", F.posexplode("artifacts").alias("ord", "x")).select("graph_id", F.col("x.id").alias("node_id"), F.col("x.numericId").alias("numeric_id"), F.col("x.groupId").alias("group_id"), F.col("x.artifactId").alias("artifact_id"), "x.version", "x.scopes", "ord")
    e = g.select("graph_id", F.posexplode("dependencies").alias("ord", "x")).select("graph_id", F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.resolution", "ord").dropDuplicates(["graph_id", "src", "dst"])
    return a, e


def update_steps(spark: SparkSession, path: str, by_name: bool = False) -> DataFrame:
    """Update steps; counts default to 0 and transitive to false.  With by_name columns are found by the files' header, and those that it lacks are null."""
    if by_name:
        have = spark.read.option("header", True).csv(path)
        df = have.select([(F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(STEP_SCHEMA)])
    else:
        df = spark.read.schema(STEP_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return df.fillna(0, ["inDegree", "nrtestErrors", "nrtestFailures", "nrOfNewerVersions"]).fillna(False, ["transitive"])


def with_gavs(steps: DataFrame) -> DataFrame:
    """Steps whose two GAVs are not blank."""
    return steps.filter(F.col("orgGav").rlike(r"\S") & F.col("newGav").rlike(r"\S"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name and folder of the files below root that are not empty; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return f.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.element_at(F.split("path", "/"), -2))


def step_files(spark: SparkSession, root: str, worker: bool = False) -> DataFrame:
    """Files of update steps: tables that are no analysis and no earlier result; a worker of the queue lists earlier results too."""
    f = listing(spark, root, "*.csv")
    for mark in WORKER_NOT_INPUT if worker else NOT_INPUT:
        f = f.filter(~F.contains("name", F.lit(mark)))
    return f


def graph_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """modules(module) with the first listed graph file of its name, in whatever case."""
    want = F.lower(F.concat("module", F.lit(GRAPH_SUFFIX)))
    first = files.groupBy(F.lower("name").alias("low")).agg(F.min("path").alias("graph"))
    return modules.join(first, want == F.col("low"), "left").select("module", "graph")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """folder and commit: the first line of every COMMIT file, trimmed, empty if there is none."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "COMMIT").text(root, wholetext=True)
    path = F.split(F.col("_metadata.file_path"), "/")
    return t.select(F.element_at(path, -2).alias("folder"), F.trim(F.substring_index(F.regexp_replace("value", "\r\n?", "\n"), "\n", 1)).alias("commit"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """name: trimmed lines of a list; a list that is missing is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "name string")
    return spark.read.text(path).select(F.trim("value").alias("name"))


def versions_of_response(body: Column) -> Column:
    """Versions of a search response in its order."""
    return F.transform(F.from_json(body, RESPONSE)["response"]["docs"], lambda x: x["v"])


def available_versions(responses: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, version."""
    return responses.select(key, F.posexplode(versions_of_response(F.col(body))).alias("pos", "version"))


def archive_entries(spark: SparkSession, path: str, pattern: str = "*.zip", content: bool = True) -> DataFrame:
    """path, entry, content, error: the files in the archives below path, each archive opened where it is read.

    What is no archive is one row with its error and a null entry.  content: whether the entries' bytes are wanted.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return unpacked(found.select("path", "content"), content)


def unpacked(archives: DataFrame, content: bool = True) -> DataFrame:
    """path, entry, content, error of archives(path, content)."""
    import io
    import zipfile

    import pyarrow as pa

    def made(rows: list) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["path", "entry", "content", "error"])

    def unpack(batches):
        held, size = [], 0
        for batch in batches:
            for p, blob in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows, error = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        rows = [(n, z.read(n) if content else None) for n in z.namelist() if not n.endswith("/")]
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError) as x:
                    rows, error = [(None, None)], f"{type(x).__name__}: {x}"
                held += [(p, n, c, error) for n, c in rows]
                size += sum(len(c) for _, c in rows if c is not None)
                if len(held) >= ENTRIES_AT_ONCE or size >= BYTES_AT_ONCE:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return archives.select("path", "content").mapInArrow(unpack, "path string, entry string, content binary, error string")


def archive_classes(spark: SparkSession, path: str) -> DataFrame:
    """path, class_name, error: classes of jar, war and zip archives, and of folders of class files; a broken archive is a row with its error."""
    packed = archive_entries(spark, path, "*.{jar,war,zip}", content=False).filter("entry is null or entry like '%.class'")
    root = re.sub("^[a-z0-9]+:/*", "/", path).rstrip("/")
    below = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), len(root) + 2, 2**31 - 1)
    loose = listing(spark, path, "*.class").select(F.lit(path).alias("path"), below.alias("entry"), F.lit(None).cast("string").alias("error"))
    return packed.select("path", "entry", "error").unionByName(loose).select("path", class_of_entry(F.col("entry")).alias("class_name"), "error").distinct()


def fetch(spark: SparkSession, source: str, target: str) -> str:
    """Copy a file between any two file systems that Hadoop knows (local, web, store), and return the target."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"{source} was not copied")
    return target


def storage_kind(url: str) -> str | None:
    """Which file system an address names: web, local or none."""
    if url.startswith(("http://", "https://")):
        return "web"
    return "local" if url.startswith("file:/") else None


def setting(spark: SparkSession, key: str, default: int) -> int:
    """A whole-number setting; what is no number counts as absent."""
    try:
        return int(spark.conf.get(key, str(default)))
    except ValueError:
        return default


def check_inputs(spark: SparkSession, root: str, wanted: dict[str, list[str]]) -> DataFrame:
    """name, found, complete: whether each input table can be read and has its columns."""
    from pyspark.errors import AnalysisException

    rows = []
    for name, columns in wanted.items():
        try:
            have = spark.read.parquet(f"{root}/{name}.parquet").columns
            rows.append((name, True, set(columns) <= set(have)))
        except AnalysisException:
            rows.append((name, False, False))
    return spark.createDataFrame(rows, "name string, found boolean, complete boolean")
