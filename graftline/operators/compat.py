"""Calls between libraries against incompatibilities (JN06-JN08, JN11, JN12, GR14, AGG07-AGG09, DOM05-DOM07, DOM11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.names import same_family
from graftline.staging import stage


# Fixed value: the status of a task without a sub-graph.
NO_ENTRY = "NO_NEO4J_ENTRY"


def class_owner(index: DataFrame) -> DataFrame:
    """class_name, gav: the last class-path entry that has a class owns it."""
    return index.groupBy("class_name").agg(F.max_by("gav", "cp_ord").alias("gav"))


def shrink_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """src_gav, tgt_gav, calls: calls(src_class, tgt_class, call) between libraries; a call whose classes are not both known is left out."""
    owner = class_owner(index)
    a, b = (owner.select(F.col("class_name").alias(f"{s}_class"), F.col("gav").alias(f"{s}_gav")) for s in ("src", "tgt"))
    return calls.join(a, "src_class").join(b, "tgt_class").groupBy("src_gav", "tgt_gav").agg(F.sort_array(F.collect_list("call")).alias("calls"))


def call_graph(calls: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices(gav): every class-path entry, with calls or without; edges(src_gav, tgt_gav, n): how many calls there are between two."""
    owner = class_owner(index)
    a, b = (owner.select(F.col("class_name").alias(f"{s}_class"), F.col("gav").alias(f"{s}_gav")) for s in ("src", "tgt"))
    edges = calls.join(a, "src_class").join(b, "tgt_class").groupBy("src_gav", "tgt_gav").agg(F.count("*").alias("n"))
    return index.select("gav").distinct(), edges


def edges_at_risk(library_calls: DataFrame, updated: DataFrame, kept: DataFrame, skip_family: bool = False) -> DataFrame:
    """Library edges into updated(gav) from kept(gav); with skip_family not those within one family (needs src_group, tgt_group)."""
    edges = library_calls.filter(~same_family(F.col("src_group"), F.col("tgt_group"))) if skip_family else library_calls
    return edges.join(updated.select(F.col("gav").alias("tgt_gav")), "tgt_gav", "left_semi").join(kept.select(F.col("gav").alias("src_gav")), "src_gav", "left_semi")


def deleted(methods: Column, fields: Column, interfaces: Column) -> Column:
    """The class itself is gone: no list has an entry."""
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return n(methods) + n(fields) + n(interfaces) == 0


def broken_calls(calls: DataFrame, incompatibilities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """calls(by, call_id, tgt_class, name, return_type, params) with each incompatibility(by, inc_id, class_name, methods (parsed), fields, interfaces) that breaks them.

    A call breaks if its class is deleted, or a method of the list has its name, return type and parameters.
    """
    hit = F.exists("methods", lambda m: (m["name"] == F.col("name")) & (m["return_type"] == F.col("return_type")) & (m["params"] == F.col("params")))
    met = calls.join(incompatibilities.withColumnRenamed("class_name", "tgt_class"), [*by, "tgt_class"])
    return met.filter(deleted(F.col("methods"), F.col("fields"), F.col("interfaces")) | F.coalesce(hit, F.lit(False))).select("call_id", "inc_id")


def semantic_calls(calls: DataFrame, semantic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """calls(by, call_id, signature) whose signature starts a changed body; every matching entry counts."""
    return calls.join(semantic.withColumnRenamed("start_method", "signature"), [*by, "signature"]).select("call_id", "changed_body_method")


def violation_counts(violations: DataFrame, key: str) -> DataFrame:
    """key, nr_violations (with a call), nr_calls for violations(key, calls array)."""
    n = F.coalesce(F.greatest(F.size("calls"), F.lit(0)), F.lit(0))
    return violations.groupBy(key).agg(F.count_if(n > 0).alias("nr_violations"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("nr_calls"))


def _found(pairs: DataFrame, docs: DataFrame, checks: DataFrame, by: Sequence[str], flags: Sequence[str] = ("kb", "kn", "kc")) -> DataFrame:
    """pairs with the flags, true or null: base is among docs, next is, the pair has a check."""
    # a partition's documents are held as they are: keys are distinct, and the many pairs need no sort
    known = docs.select("gav").distinct().withColumn("k", F.lit(True))
    a, b = (known.select(F.col("gav").alias(end), F.col("k").alias(f)).hint("shuffle_hash") for end, f in zip(("base", "next"), flags, strict=False))
    key = ["base", "next", *by]
    c = checks.select(*key).distinct().withColumn(flags[2], F.lit(True))
    return pairs.join(a, "base", "left").join(b, "next", "left").join(c, key, "left")


def lookup(pairs: DataFrame, docs: DataFrame, checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """pairs(base, next, by) with status: FAILED_SIGTEST unless both are known documents(gav) and the pair has a check(base, next, by); by: the kind of check."""
    met = _found(pairs, docs, checks, by)
    return met.select("base", "next", *by, F.when(F.col("kb") & F.col("kn") & F.col("kc"), "SUCCESS").otherwise("FAILED_SIGTEST").alias("status"))


def lookup_again(pairs: DataFrame, docs: DataFrame, checks: DataFrame, generate: Callable[[DataFrame], tuple[DataFrame, DataFrame]], by: Sequence[str] = ()) -> DataFrame:
    """lookup, and for what it misses a second one, after generate(missing pairs) has given more docs and checks.

    What the first one has found is kept, so that the second asks for what is new alone.
    """
    key, old, new = ["base", "next", *by], ("kb", "kn", "kc"), ("nb", "nn", "nc")
    first = stage(_found(pairs, docs, checks, by).select(*key, *old), "first")
    whole = F.coalesce(F.col("kb") & F.col("kn") & F.col("kc"), F.lit(False))
    missing = first.filter(~whole)
    more = generate(missing.select(*key))
    second = _found(missing, *more, by, new)
    status = F.when((F.coalesce("kb", "nb") & F.coalesce("kn", "nn") & F.coalesce("kc", "nc")), "SUCCESS").otherwise("FAILED_SIGTEST")
    return first.filter(whole).select(*key, F.lit("SUCCESS").alias("status")).unionByName(second.select(*key, status.alias("status")))


def missing_pairs(looked_up: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The requests for what a lookup missed."""
    return looked_up.filter("status = 'FAILED_SIGTEST'").select("base", "next", *by)


def all_calls(semantic: Column, other: Column) -> Column:
    """The violated calls of both kinds of check, repeated ones kept; nulls count as none."""
    return F.concat(F.coalesce(semantic, F.array().cast("array<string>")), F.coalesce(other, F.array().cast("array<string>")))


def override_decision(old_len: Column, through_updated: Column, new_len: Column) -> Column:
    """CHECK if the new version takes effect, FORWARD if the old one does, SKIP where the new node is not reached."""
    return F.when(through_updated, "CHECK").when(new_len.isNull(), "SKIP").when(old_len >= new_len + 1, "CHECK").otherwise("FORWARD")


def status_of(call_graph: Column, sub_graph: Column, compatible: Column) -> Column:
    return F.when(~call_graph, "EMPTY_CG").when(~sub_graph, NO_ENTRY).when(~compatible, "FAILED_SIGTEST").otherwise("SUCCESS")
