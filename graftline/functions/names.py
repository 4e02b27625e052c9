"""Coordinates and names as column expressions (FN01-FN13, FN19-FN30).

A GAV is group:artifact:version.  Java-like conventions hold where results depend on them: null
prints as "null", trimming takes all characters up to a blank, and trailing empty parts of a split do not count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The collapsed group prefix and the repository folder of a class path.
FRAMEWORK_GROUP = "org.springframework"
REPOSITORY = ".m2/repository/"
RUN_PREFIX = "projectRun"


def gav(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("null")) for c in (group, artifact, version)))


def java_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def split_trimmed(c: Column, pattern: str) -> Column:
    """Parts without trailing empty ones; a text without a separator is one part even if it is empty."""
    parts = F.split(c, pattern, -1)
    last = F.array_max(F.filter(F.transform(parts, lambda x, i: F.when(x != "", i + 1)), lambda x: x.isNotNull()))
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))))


def gav_parts(c: Column) -> Column:
    """struct(group, artifact, version); version only where there are exactly three parts, nulls below two."""
    parts = split_trimmed(c, ":")
    n = F.size(parts)
    return F.struct(F.when(n >= 2, F.get(parts, F.lit(0))).alias("group"), F.when(n >= 2, F.get(parts, F.lit(1))).alias("artifact"), F.when(n == 3, F.get(parts, F.lit(2))).alias("version"))


def target_version(c: Column) -> Column:
    """The third part of a target, null if there are fewer."""
    return F.get(split_trimmed(c, ":"), F.lit(2))


def path_to_gav(path: Column, root: Column) -> Column:
    """The GAV of a class-path entry; folders of classes belong to root."""
    in_repository = F.when(F.instr(path, REPOSITORY) > 1, F.substring_index(path, REPOSITORY, -1)).otherwise(path)
    folder = F.when(F.instr(in_repository, "/") > 0, F.regexp_replace(in_repository, "[^/]*$", "")).otherwise(in_repository)
    parts = split_trimmed(F.when(F.length(folder) > 1, folder).otherwise(in_repository), "/")
    n = F.size(parts)
    group = F.array_join(F.filter(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: x.rlike(r"\S")), ".")
    return F.when(F.endswith(path, F.lit("classes")), root).when(n >= 2, F.concat_ws(":", group, F.get(parts, n - 2), F.get(parts, n - 1)))


def file_name(path: Column) -> Column:
    return F.when(path.rlike(r"(?s)^.+/"), F.substring_index(path, "/", -1)).otherwise(path)


def class_of_entry(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".class"), F.lit(""))


def package_of(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\."), F.regexp_extract(name, r"(?s)^(.+)\.", 1)).otherwise(name)


def cleared_group(group: Column) -> Column:
    return F.when(F.startswith(group, F.lit(FRAMEWORK_GROUP)), F.lit(FRAMEWORK_GROUP)).otherwise(group)


def same_family(a: Column, b: Column) -> Column:
    return cleared_group(a).eqNullSafe(cleared_group(b))


def project_name(name: Column) -> Column:
    kept = F.filter(F.split(name, "_"), lambda x: ~F.startswith(x, F.lit(RUN_PREFIX)))
    return F.when(F.contains(name, F.lit(RUN_PREFIX)), F.array_join(kept, "_")).otherwise(name)


def repository_url(folder: Column, base: str) -> Column:
    """base/owner/repo of a folder owner_repo; null below two parts."""
    s = F.split(folder, "_")
    return F.when(F.size(s) >= 2, F.concat(F.lit(base), F.get(s, F.lit(0)), F.lit("/"), F.array_join(F.slice(s, F.lit(2), F.size(s)), "_")))


def module_name(path: Column, root: Column, project: Column, folder: Column) -> Column:
    return F.when(path == root, project).otherwise(F.concat_ws("_", project, folder))


def variable_name(node_id: Column, number: Column) -> Column:
    return F.when(node_id.isNotNull(), F.concat(F.lit("n"), F.regexp_replace(node_id, "[^A-Za-z0-9]", "_"))).otherwise(F.concat(F.lit("n"), number.cast("string")))


def path_name(a: Column, b: Column) -> Column:
    return F.concat(F.lit("p"), a, F.lit("_"), b)


def signature(text: Column, literal: bool = False) -> Column:
    """struct(name, return_type, qualifiers, params) of a method signature.

    () gives no parameters; with literal, one empty parameter.
    """
    has = F.instr(text, "(") > 0
    inner = F.substr(text, F.instr(text, "(") + 1, F.length(text) - F.instr(text, "(") - 1)
    params = F.when(~has, F.array().cast("array<string>")).when((inner == "") & F.lit(not literal), F.array().cast("array<string>")).otherwise(split_trimmed(inner, ","))
    words = split_trimmed(F.when(has, F.substring_index(text, "(", 1)).otherwise(text), " ")
    n = F.size(words)
    name = F.get(words, n - 1)
    return F.struct(F.substring_index(name, ".", -1).alias("name"), F.get(words, n - 2).alias("return_type"), F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("qualifiers"), params.alias("params"))


def has_mode(mode: Column, bit: int) -> Column:
    return mode.bitwiseAND(F.lit(bit)) != 0


def rounded_weight(w: Column) -> Column:
    return F.floor(w + 0.5).cast("int")


def archive_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def host_port(url: Column, scheme: str) -> Column:
    return F.split(F.replace(url, F.lit(scheme), F.lit("")), ":")


def joined_messages(messages: Column) -> Column:
    """struct(text, n): the messages in order, joined by ;, and how many there are."""
    return F.struct(F.array_join(messages, ";").alias("text"), F.greatest(F.size(messages), F.lit(0)).alias("n"))


def is_naive(target_gav: Column, picked_gav: Column) -> Column:
    """Whether a suggestion picks the very target that was asked for."""
    return target_gav.eqNullSafe(picked_gav)
