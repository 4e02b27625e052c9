"""Steps of projects by module, build results, counters and packages (AGG01, AGG11, AGG16, AGG18, JN13, DOM18, DOM19)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.names import package_of


def gather(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all modules, one behind the other."""
    return reduce(DataFrame.unionByName, parts)


def by_module(steps: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """A row for each module with n, the number of its steps, and the aggregates."""
    return steps.groupBy(key).agg(F.count("*").alias("n"), *[a.alias(name) for name, a in aggregates.items()])


def with_builds(groups: DataFrame, builds: DataFrame, key: str) -> DataFrame:
    """groups of modules with their build(key, ...) result and skipped, which is true for modules that were not built."""
    found = builds.withColumn("_built", F.lit(True))
    return groups.join(found, key, "left").withColumn("skipped", F.col("_built").isNull()).drop("_built")


def counters(queued: DataFrame, done: DataFrame, todo: DataFrame) -> DataFrame:
    """name, n: how many projects are queued, done and to do."""
    return gather([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("queued", queued), ("done", done), ("todo", todo))])


def packages(classes: DataFrame, name: str = "class_name", by: Sequence[str] = ()) -> DataFrame:
    """by, package: the distinct packages of classes."""
    return classes.select(*by, package_of(F.col(name)).alias("package")).distinct()
