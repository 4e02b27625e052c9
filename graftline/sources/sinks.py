"""Sinks (SNK01-SNK11): suggestions, markers, graphs, requests and archives of results.

All of them write folders through Spark, partitioned by project where results of many projects are written at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = "DONE"
#: Archives of a batch, and their bytes, after which it is passed on.
ARCHIVES_AT_ONCE, BYTES_AT_ONCE = 5_000, 16 << 20


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as text, steps parted by '/', so that rows fit a text table."""
    out = df
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("array<struct"):
            out = out.withColumn(f.name, F.concat_ws("/", F.transform(f.name, lambda x: F.concat_ws(",", x["from"], x["to"]) if "from:" in kind else F.to_json(x))))
        elif kind.startswith("array"):
            out = out.withColumn(f.name, F.concat_ws("/", F.col(f.name).cast("array<string>")))
        elif kind.startswith(("struct", "map")):
            out = out.withColumn(f.name, F.to_json(f.name))
    return out


def suggestions(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows with a header; by: a folder for each value (project or module)."""
    w = flat(df).write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def result_name(project: Column, parent: Column) -> Column:
    """The name of a result: the project's, or its parent folder's where that is blank."""
    own = F.when(project.rlike(r"\S"), project)
    return F.concat(F.coalesce(own, parent), F.lit("_recommendation_results.csv"))


def markers(files: DataFrame, path: str) -> None:
    """A status row for each finished file."""
    files.select(F.concat("path", F.lit(".status")).alias("path"), F.lit(DONE).alias("status")).write.mode("append").csv(path)


def errors(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(": ", "module", "message")).write.mode("overwrite").text(path)


def dot(edges: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """A drawing of one graph: head, nodes with labels(node, label), edges, and end, as one file in this order."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    spark = edges.sparkSession
    row = lambda place, text: spark.range(1).select(F.lit(place).alias("place"), F.lit(text).alias("line"))
    lines = row(0, "strict digraph G {").unionByName(row(3, "}")).unionByName(edges.select(F.lit(2).alias("place"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line")))
    if labels is not None:
        lines = lines.unionByName(labels.select(F.lit(1).alias("place"), F.concat(F.lit("  "), quoted("node"), F.lit(" [ label="), quoted("label"), F.lit(" ];")).alias("line")))
    lines.coalesce(1).sortWithinPartitions("place", "line").select("line").write.mode("overwrite").text(path)


def requests(pairs: DataFrame, path: str) -> None:
    """Missing compatibility pairs, to be computed elsewhere."""
    pairs.write.mode("overwrite").option("header", True).csv(path)


def jobs(df: DataFrame, path: str) -> None:
    """Rows as JSON text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def packed(files: DataFrame, stamp: str) -> DataFrame:
    """archive, content: files(project, name, content) of each project as one zip archive, named by project and stamp."""
    import io
    import zipfile
    from itertools import groupby

    import pyarrow as pa

    def pack(batches):
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        names, contents, size = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["archive", "content"])
        for project, group in groupby(lines, lambda r: r[0]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, name, content in sorted(group, key=lambda r: r[1:]):
                    z.writestr(zipfile.ZipInfo(name), content)
            names.append(f"{project}_{stamp}.zip")
            contents.append(out.getvalue())
            size += len(contents[-1])
            if len(names) >= ARCHIVES_AT_ONCE or size >= BYTES_AT_ONCE:
                yield batch()
                names, contents, size = [], [], 0
        if names:
            yield batch()

    # dealt and sorted by project, many of which a worker packs in turn
    dealt = files.select("project", "name", "content").repartition("project").sortWithinPartitions("project")
    return dealt.mapInArrow(pack, "archive string, content binary")


def put(df: DataFrame, folder: str) -> None:
    """Every row of df(archive, content) as a file of its own, on whatever file system the folder is on; the rows come one by one."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in df.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row.archive}")
        with_stream = at.getFileSystem(conf).create(at, True)
        try:
            with_stream.write(bytearray(row.content))
        finally:
            with_stream.close()
