"""First-match and loose joins between node tables, and semi and anti joins on work lists (JN01-JN05, JN09, JN10, JN14-JN17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftline.functions.names import gav_parts
from graftline.functions.versions import text_at_least


#: Loose matches are looked up by so many first characters.
GRAM = 4


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Of each key the first row in order."""
    return top_by(df, keys, 1, *order)


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def match_first(left: DataFrame, right: DataFrame, on: list[str], order: str, found: str) -> DataFrame:
    """left with the found column of the first right row that agrees on all of on, null-safely; null where there is none.

    The right side is reduced to its first rows before the join, so that the join does not multiply rows.
    """
    best = right.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(F.min_by(found, order).alias(found))
    same = [left[c].eqNullSafe(best[f"_{c}"]) for c in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return left.join(best, cond, "left").select(*[left[c] for c in left.columns], found)


def match_loose(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], order: str, found: str, key: list[str], by: Sequence[str] = ()) -> DataFrame:
    """left with the first right row of the same by of which every right text contains its left text.

    Texts are short names.  A text of ``GRAM`` characters and more is contained only where its first ones are, so that the join is on
    by and these characters of the first pair; shorter texts meet every distinct position's characters by a key of their own length.
    """
    own = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[F.col(a).alias(f"_l{i}") for i, (a, _) in enumerate(pairs)])
    own = own.withColumn("_gram", F.substring("_l0", 1, GRAM))
    other = right.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(order).alias("_order"), F.col(found).alias("_found"), *[F.col(b).alias(f"_r{i}") for i, (_, b) in enumerate(pairs)])
    at = F.sequence(F.lit(1), F.length("_r0") + 1)
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substring("_r0", i, n)))))
    other = other.filter("_r0 is not null").withColumn("_gram", F.explode(grams))
    met = own.join(other, [*[f"_b{i}" for i in range(len(by))], "_gram"])
    for i in range(len(pairs)):
        met = met.filter(F.contains(F.col(f"_r{i}"), F.col(f"_l{i}")))
    best = met.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.min_by("_found", "_order").alias(found))
    keys = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).distinct().alias("l")
    same = F.lit(True)
    for i in range(len(key)):
        same = same & F.col(f"l._k{i}").eqNullSafe(F.col(f"r._k{i}"))
    return keys.join(best.alias("r"), same, "left").select(*[F.col(f"l._k{i}").alias(c) for i, c in enumerate(key)], found)


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """grp, artifact, to_grp, to_artifact, exact: the distinct names of right(grp, artifact) that are, null-safely, or contain those of left."""
    own, other = left.select("grp", "artifact").distinct(), right.select(F.col("grp").alias("to_grp"), F.col("artifact").alias("to_artifact")).distinct()
    exact = own.join(other, F.col("grp").eqNullSafe(F.col("to_grp")) & F.col("artifact").eqNullSafe(F.col("to_artifact"))).withColumn("exact", F.lit(True))
    at = F.sequence(F.lit(1), F.length("to_grp") + 1)
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substring("to_grp", i, n)))))
    met = own.withColumn("_gram", F.substring("grp", 1, GRAM)).join(other.filter("to_grp is not null").withColumn("_gram", F.explode(grams)), "_gram").drop("_gram")
    loose = met.filter(F.contains(F.col("to_grp"), F.col("grp")) & F.contains(F.col("to_artifact"), F.col("artifact"))).filter("not (grp = to_grp and artifact = to_artifact)")
    return exact.unionByName(loose.withColumn("exact", F.lit(False)))


def lateral_first(left: DataFrame, right: DataFrame, on: list[str], order: list[Column | str], take: list[str]) -> DataFrame:
    """left with the columns take of the first right row of its key; rows without one go, as with a sub-query that is limited to one row."""
    order = [F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = right.groupBy(*on).agg(F.min(F.struct(*order, F.struct(*take).alias("_row"))).alias("_b")).select(*on, "_b._row.*")
    return left.join(best, on)


def by_gav(wanted: DataFrame, nodes: DataFrame, gav: str = "gav", with_version: bool = True) -> DataFrame:
    """wanted with node: the first of nodes(node, grp, artifact, version, ord) that its GAV text names, with or without the version; null where there is none."""
    parts = gav_parts(F.col(gav))
    keys = ["grp", "artifact", *(["version"] if with_version else [])]
    of = {"grp": "group", "artifact": "artifact", "version": "version"}
    asked = wanted.withColumns({f"_{k}": parts[of[k]] for k in keys})
    first = nodes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by("node", "ord").alias("node"))
    return asked.join(first, [f"_{k}" for k in keys], "left").select(*wanted.columns, "node")


def fits(same_family: Column, version: Column, target: Column, least: Column | None = None) -> Column:
    """Whether a version can stand for a node: the target's in the library's family; elsewhere any, or one of at least least in text order."""
    return F.when(same_family, version == target).otherwise(F.lit(True) if least is None else text_at_least(version, least))


def classify_versions(updates: DataFrame, known: DataFrame) -> DataFrame:
    """updates(grp, artifact, version) with status NEW, UNCHANGED or CHANGED against known(grp, artifact, version, ord)."""
    old = known.withColumn("hit", F.struct(F.col("version").alias("version"), F.lit(True).alias("is")))
    met = match_first(updates, old, ["grp", "artifact"], "ord", "hit")
    status = F.when(F.col("hit").isNull(), "NEW").when(F.col("hit.version").eqNullSafe(F.col("version")), "UNCHANGED").otherwise("CHANGED")
    return met.withColumn("old_version", F.col("hit.version")).withColumn("status", status).drop("hit")


def filter_queue(projects: DataFrame, todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Only what is on the list of things to do if that has rows, else all but what is done."""
    if not todo.isEmpty():
        return projects.join(todo.select(key), key, "left_semi")
    return projects.join(done.select(key), key, "left_anti")
