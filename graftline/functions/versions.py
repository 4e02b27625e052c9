"""Version orders: plain text order, and the order of Maven versions as a sortable array key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftline.staging import shuffle_partitions, stage

# Qualifiers in ascending order; a release ("" and its aliases) lies between snapshot and sp.
QUALIFIERS = ["alpha", "beta", "milestone", "rc", "snapshot", "", "sp"]
ALIASES = {"a": "alpha", "b": "beta", "m": "milestone", "cr": "rc", "ga": "", "final": "", "release": ""}
_RELEASE = QUALIFIERS.index("")


def text_at_least(version: Column, bound: Column) -> Column:
    return version >= bound


def _token_key(token: Column, short: Column) -> Column:
    """struct(kind, number, text): kind orders known qualifiers, the release, unknown qualifiers and numbers.

    short: a one-letter alias counts, as it does directly before a digit.
    """
    known = {q: i for i, q in enumerate(QUALIFIERS)} | {a: QUALIFIERS.index(q) for a, q in ALIASES.items() if len(a) > 1}
    letters = {a: QUALIFIERS.index(q) for a, q in ALIASES.items() if len(a) == 1}
    pick = lambda names: F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[token]
    rank = F.coalesce(F.when(short, pick(letters)), pick(known))
    number = token.rlike("^[0-9]+$")
    kind = F.when(number, F.when(F.ltrim(token, F.lit("0")) == "", F.lit(_RELEASE)).otherwise(F.lit(len(QUALIFIERS) + 1))).otherwise(F.coalesce(rank, F.lit(len(QUALIFIERS))))
    digits = F.ltrim(token, F.lit("0"))
    # numbers by length, then by text: numbers of any length are in order
    return F.struct(kind.alias("kind"), F.when(number, F.length(digits)).otherwise(0).alias("size"), F.when(number, digits).when(rank.isNull(), token).otherwise(F.lit("")).alias("text"))


def version_key(version: Column) -> Column:
    """An array of structs whose order is the order of the versions; 1.0, 1 and 1-ga are equal, null versions have a null key.

    Trailing parts that equal a release do not count, and the key ends with a release, so that alpha and the like come before
    the plain version and numbers behind it.
    """
    parts = F.regexp_extract_all(F.lower(version), F.lit("[0-9]+|[^0-9.\\-_]+"), 0)
    keys = F.transform(parts, lambda t, i: _token_key(t, F.coalesce(F.get(parts, i + 1).rlike("^[0-9]+$"), F.lit(False))))
    end = F.struct(F.lit(_RELEASE).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("text"))
    last = F.aggregate(F.transform(keys, lambda k, i: F.when(k["kind"] != _RELEASE, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(version.isNotNull(), F.concat(F.slice(keys, F.lit(1), last), F.array(end)))


def maven_at_least(version: Column, bound: Column) -> Column:
    return version_key(version) >= version_key(bound)


def ranks(df: DataFrame, version: str, out: str = "place") -> DataFrame:
    """df with the dense rank of its versions: keys are sorted in ranges, and a range's ranks begin behind those of the ranges before it."""
    spark = df.sparkSession
    keyed = df.withColumn("_key", version_key(F.col(version)))
    apart = keyed.select("_key").distinct().repartitionByRange(shuffle_partitions(spark), "_key").withColumn("_range", F.spark_partition_id())
    apart = stage(apart, "ranges")
    inside = apart.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy("_key")))
    # one row for each range: as many as there are partitions
    sizes = sorted(map(tuple, apart.groupBy("_range").count().collect()))
    before = [(r, sum(n for _, n in sizes[:i])) for i, (r, _) in enumerate(sizes)]
    first = F.create_map(*[F.lit(v) for pair in before for v in pair])[F.col("_range")] if before else F.lit(0)
    return keyed.join(inside.select("_key", (F.col("_rank") + first).cast("int").alias(out)), "_key").drop("_key")
