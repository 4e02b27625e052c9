"""Compatibility reports: text to incompatibilities, as DataFrame plans (FN14-FN18, FN30, SRC20, AGG10).

Both grammars are state machines over lines.  Here lines are numbered by posexplode, and the machines' states are running
sums and last values over the lines of a report, so that all reports are parsed side by side.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graftline.functions.names import java_trim, split_trimmed

# Headings of the source report's sections.
SECTIONS = {
    "Missing Classes": "classes",
    "Missing Superclasses or Superinterfaces": "supers",
    "Missing Methods": "methods",
    "Missing Constructors": "constructors",
}
SCHEMA = "class_name string, methods array<string>, fields array<string>, interfaces array<string>"


@F.arrow_udf(T.StringType())
def decode_report(report: pa.Array) -> pa.Array:
    """Text of a base64 zlib report; null stays null."""
    return pa.array([None if r is None else zlib.decompress(base64.b64decode(r)).decode() for r in report.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def encode_report(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else base64.b64encode(zlib.compress(t.encode())).decode() for t in text.to_pylist()], pa.string())


def lines(reports: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line."""
    return reports.select(key, F.posexplode(F.split(text, r"\R")).alias("pos", "line"))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def parse_binary(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """key, class_name, methods, fields, interfaces: one row for each block of a binary report that is emitted."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    rows = lines(reports, key, text).withColumn("blank", _blank(line)).withColumn("words", split_trimmed(line, " "))
    rows = rows.withColumn("heads", (F.size("words") == 2) & F.startswith(F.get("words", F.lit(0)), F.lit("Class")))
    # a block ends at the next blank line; of the headings since the last blank line the first opens the block
    rows = rows.withColumn("gap", F.sum(F.col("blank").cast("int")).over(so_far) - F.col("blank").cast("int"))
    block = Window.partitionBy(key, "gap").orderBy("pos")
    rows = rows.withColumn("opens", F.col("heads") & (F.sum(F.col("heads").cast("int")).over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1))
    rows = rows.withColumn("class_name", F.last(F.when(F.col("opens"), F.get("words", F.lit(1))), ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, -1)))
    parts = split_trimmed(line, ":")
    first, second = java_trim(F.get(parts, F.lit(0))), java_trim(F.get(parts, F.lit(1)))
    entry = F.col("class_name").isNotNull() & ~F.col("blank") & (F.size(parts) >= 2) & ~first.isin("warn", "anno") & (F.instr(second, " ") > 0)
    kind = F.when(entry, F.substring_index(second, " ", 1))
    rest = F.when(entry, java_trim(F.substr(second, F.instr(second, " ") + 1)))
    rows = rows.withColumn("kind", kind).withColumn("rest", rest)
    cleared = F.max(F.when(F.col("kind") == "CLASS", F.col("pos"))).over(Window.partitionBy(key, "gap"))
    rows = rows.withColumn("cleared", cleared).withColumn("live", F.col("cleared").isNull() | (F.col("pos") > F.col("cleared")))
    pick = lambda *kinds: F.transform(F.sort_array(F.collect_list(F.when(F.col("live") & F.col("kind").isin(*kinds), F.struct("pos", "rest")))), lambda x: x["rest"])
    out = rows.groupBy(key, "gap").agg(
        F.max(F.when(F.col("opens"), F.get("words", F.lit(1)))).alias("class_name"), F.max(F.col("blank")).alias("closed"), F.max(F.col("cleared").isNotNull()).alias("kept"),
        pick("method", "constructor").alias("methods"), pick("field").alias("fields"), pick("interface").alias("interfaces"),
    )
    some = F.size("methods") + F.size("fields") + F.size("interfaces") > 0
    return out.filter(F.col("class_name").isNotNull() & F.col("closed") & (some | F.col("kept"))).select(key, "class_name", "methods", "fields", "interfaces")


def weight_of(methods: Column, fields: Column, interfaces: Column) -> Column:
    """Errors that a class stands for: all its entries, or one if it was removed as a whole."""
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return F.greatest(F.lit(1), n(methods) + n(fields) + n(interfaces))


def status_check(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """key, parsed, declared, status, valid: a report's status line against what was parsed."""
    parsed = parse_binary(reports, key, text).groupBy(key).agg(F.sum(weight_of(F.col("methods"), F.col("fields"), F.col("interfaces"))).alias("parsed"))
    status = F.regexp_extract(text, r"(?m)^STATUS:(Passed|Failed)\.", 1)
    declared = F.nullif(F.regexp_extract(text, r"(?m)^STATUS:Failed\.([0-9]+) errors", 1), F.lit("")).cast("long")
    own = reports.select(key, status.alias("status"), declared.alias("declared"))
    both = own.join(parsed, key, "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)).cast("long"))
    valid = F.when(F.col("status") == "Passed", F.col("parsed") == 0).when(F.col("status") == "Failed", F.coalesce(F.col("declared") == F.col("parsed"), F.lit(False))).otherwise(F.lit(True))
    return both.select(key, "parsed", "declared", "status", valid.alias("valid"))


def parse_source(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """key, class_name, methods, fields, interfaces: classes of a source report, entries in order of their lines."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trimmed = java_trim(F.col("line"))
    heading = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.lit(v))])[trimmed]
    rows = lines(reports, key, text).withColumn("blank", _blank(F.col("line"))).withColumn("heading", heading)
    rows = rows.withColumn("opened", F.max(F.when(F.col("heading").isNotNull(), F.col("pos"))).over(so_far)).withColumn("section", F.last("heading", ignorenulls=True).over(so_far))
    inside = Window.partitionBy(key, "opened").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("blanks", F.sum(F.col("blank").cast("int")).over(inside))
    live = rows.filter(F.col("opened").isNotNull() & (F.col("pos") > F.col("opened")) & (F.col("blanks") < 2) & ~F.col("blank") & ~trimmed.rlike("^-.*-$"))
    parts = split_trimmed(F.col("line"), ":")
    left, right = java_trim(F.get(parts, F.lit(0))), java_trim(F.get(parts, F.lit(1)))
    two = F.size(parts) == 2
    member = F.col("section").isin("methods", "constructors") & two & (F.instr(right, " ") > 0)
    classes = F.col("section") == "classes"
    supers = (F.col("section") == "supers") & two
    name = F.when(classes, trimmed).when(member | supers, left)
    entries = live.select(key, "pos", name.alias("class_name"), F.when(member, java_trim(F.substr(right, F.instr(right, " ") + 1))).alias("method"), F.when(supers, right).alias("super")).filter("class_name is not null")
    gather = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda x: x[c])
    return entries.groupBy(key, "class_name").agg(gather("method").alias("methods"), F.array().cast("array<string>").alias("fields"), gather("super").alias("interfaces"))


def explode_semantic(checks: DataFrame, key: str, broken: str) -> DataFrame:
    """key, start_method, changed_body_method: one row for each broken entry."""
    return checks.select(key, F.explode(broken).alias("b")).select(key, "b.start_method", "b.changed_body_method")
