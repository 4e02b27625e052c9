import pytest

from graftline.functions import reports

BINARY = "\n".join([
    "Classes: 2", "Constructs: 2", "SigCheck Content", "SignatureTest report", "Base version: 10.0", "Tested version: 10.0.1", "Check mode: bin [throws removed]", "Constant checking: on", "", "",
    "Class a.b.ForwardingMap$StandardEntrySet", '  "E1.2 - API type removed" : method public boolean java.util.AbstractCollection.add({x%0})', "",
    "Class a.b.ForwardingMap$StandardValues", '  "E1.2 - API type removed" : method public boolean java.util.AbstractCollection.add({x%0})', "", "", "", "STATUS:Failed.2 errors", "",
])

MIXED = "\n".join([
    "Class x.Kept", " E : method a b", " E : CLASS public x.Kept", " E : field int f", "", "Class x.Only", " warn : method a b", " E : nospace", "", "Class x.Gone", " E : CLASS y z", "\t",
    "Class x.Two", "Class x.Inner", " E : constructor public x.Two()", " E : interface java.io.S", "", "Class x.Open", " E : method m n",
])

SOURCE = "\n".join([
    "SignatureTest report", "", "Missing Classes", "---------------", "", "a.One", "a.Two", "", "a.Three", "Missing Superclasses or Superinterfaces", "-----", "", "k.Super:   a.Sub", "k.Super:a.Other", "",
    "Missing Methods", "----", "", "a.M:  method public int a.M.f(int)", "a.M:  method public a:b int g()", "bad line", "", "Missing Constructors", "----", "", "a.M:  constructor public a.M.M()", "", "Added Methods", "----", "", "z:  method int z.z()", "", "Missing Fields", "--", "", "q: field int q",
])


def parse(spark, f, text):
    return {r.class_name: (r.methods, r.fields, r.interfaces) for r in f(spark.createDataFrame([(1, text)], "report_id long, text string")).collect()}


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_binary_report(spark, ends):
    got = parse(spark, reports.parse_binary, BINARY.replace("\n", ends))
    entry = ["public boolean java.util.AbstractCollection.add({x%0})"]
    assert got == {"a.b.ForwardingMap$StandardEntrySet": (entry, [], []), "a.b.ForwardingMap$StandardValues": (entry, [], [])}


def test_binary_blocks(spark):
    got = parse(spark, reports.parse_binary, MIXED)
    assert got == {"x.Kept": ([], ["int f"], []), "x.Gone": ([], [], []), "x.Two": (["public x.Two()"], [], ["java.io.S"])}


def test_status(spark):
    rows = [(1, BINARY), (2, BINARY.replace("Failed.2", "Failed.3")), (3, "STATUS:Passed.\n"), (4, BINARY.replace("Failed.2 errors", "Passed.")), (5, "")]
    got = {r.report_id: (r.parsed, r.declared, r.valid) for r in reports.status_check(spark.createDataFrame(rows, "report_id long, text string")).collect()}
    assert got == {1: (2, 2, True), 2: (2, 3, False), 3: (0, None, True), 4: (2, None, False), 5: (0, None, True)}


def test_source_report(spark):
    got = parse(spark, reports.parse_source, SOURCE)
    none = ([], [], [])
    assert got == {"a.One": none, "a.Two": none, "k.Super": ([], [], ["a.Sub", "a.Other"]), "a.M": (["public int a.M.f(int)", "public a.M.M()"], [], [])}


def test_codec(spark):
    df = spark.createDataFrame([("é" * 5000,), ("",), (None,)], "t string").withColumn("r", reports.encode_report("t"))
    assert all(r.t == r.back for r in df.withColumn("back", reports.decode_report("r")).collect())
    assert df.filter("t = ''").collect()[0].r.startswith("eJ")
