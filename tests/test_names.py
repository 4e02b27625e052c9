import pytest
from pyspark.sql import functions as F

from graftline.functions import names, versions


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("r")).collect()[0].r


@pytest.mark.parametrize("path, want", [
    ("/Users/myUser/.m2/repository/commons-net/commons-net/3.8.0/commons-net-3.8.0.jar", "commons-net:commons-net:3.8.0"),
    ("/Users/myUser/.m2/repository/net/lingala/zip4j/zip4j/2.6.1/zip4j-2.6.1.jar", "net.lingala.zip4j:zip4j:2.6.1"),
    ("/p/target/classes", "r:r:1"),
])
def test_path_to_gav(spark, path, want):
    assert one(spark, names.path_to_gav(F.col("p"), F.lit("r:r:1")), p=path) == want


def test_signatures(spark):
    s = one(spark, names.signature(F.col("p")), p="public final void io.netty.channel.AbstractChannel$AbstractUnsafe.close(io.netty.channel.ChannelPromise)")
    assert (s.name, s.return_type, s.qualifiers, s.params) == ("close", "void", ["public", "final"], ["io.netty.channel.ChannelPromise"])
    s = one(spark, names.signature(F.col("p")), p="public final okhttp3.internal.ws.MessageInflater okhttp3.internal.ws.WebSocketExtensions.newMessageInflater(boolean)")
    assert (s.name, s.return_type, s.params) == ("newMessageInflater", "okhttp3.internal.ws.MessageInflater", ["boolean"])
    assert one(spark, names.signature(F.col("p")), p="public int a.B.f()").params == []
    assert one(spark, names.signature(F.col("p"), literal=True), p="public int a.B.f()").params == [""]


def test_gavs(spark):
    assert one(spark, names.gav(F.col("a"), F.col("b"), F.col("c")), a="g", b=None, c="1") == "g:null:1"
    assert tuple(one(spark, names.gav_parts(F.col("a")), a="g:a:1:x")) == ("g", "a", None)
    assert tuple(one(spark, names.gav_parts(F.col("a")), a="g:a:1")) == ("g", "a", "1")
    assert one(spark, names.target_version(F.col("a")), a="g:a") is None
    assert one(spark, names.file_name(F.col("a")), a="/only") == "/only"
    assert one(spark, names.file_name(F.col("a")), a="/a/b.csv") == "b.csv"
    assert one(spark, names.project_name(F.col("a")), a="x_projectRun3_y") == "x_y"
    assert one(spark, names.repository_url(F.col("a"), "https://h/"), a="owner_my_repo") == "https://h/owner/my_repo"
    assert one(spark, names.package_of(F.col("a")), a="Main") == "Main"


ORDER = ["1-alpha-1", "1-alpha2", "1-beta", "1-milestone", "1-rc", "1-snapshot", "1", "1-sp", "1-abc", "1-1", "1.1", "1.2", "1.10", "1.99999999999999999999", "2-a1", "2"]


def test_version_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ORDER)], "i int, v string").withColumn("k", versions.version_key(F.col("v")))
    got = [r.v for r in df.orderBy("k", "i").collect()]
    assert got == ORDER
    same = spark.createDataFrame([(v,) for v in ("1", "1.0", "1.0.0", "1-ga", "1.final", "1-RELEASE", "01")], "v string")
    assert same.select(versions.version_key(F.col("v")).alias("k")).distinct().count() == 1
    assert one(spark, versions.version_key(F.col("a")), a=None) is None
    assert one(spark, versions.text_at_least(F.col("a"), F.lit("4.9.0")), a="4.10.0") is False
    assert one(spark, versions.maven_at_least(F.col("a"), F.lit("4.9.0")), a="4.10.0") is True
