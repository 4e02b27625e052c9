"""Exact deduplication by a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt to shards.  Each shard gets a minimal perfect hash: levels of
bit arrays, in which a digest takes the first level where no other remaining digest shares its
position; the rank of its bit is its slot.  A slot holds the full 32-byte digest and the locator of
the winner (the largest doc_id and the number of copies so far).  Digests that arrive are looked up in their
shard and compared byte by byte with the slot: equal ones are repeats of history, the others group
among themselves.  Texts never leave the scan; only digests and ids are shuffled, and both tables are
reduced to one row for each digest before any shard sees them, so copies cannot crowd a shard.

Defined results: a null text counts as empty; a null doc_id is below every id; of equal texts the row
with the largest doc_id stays, and of rows that repeat this doc_id too, one; an empty table gives an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.staging import shuffle_partitions, stage

A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Digests of a shard, on average.
SHARD_DIGESTS = 50_000
#: Bits of a level for each digest that is left.
GAMMA = 1.6

_SHARD_SCHEMA = "shard int, levels array<long>, bits binary, digests binary, winners binary, copies binary"
_FOUND_SCHEMA = "digest binary, hist_id long, hist_copies long"


@F.arrow_udf(T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return pa.array((hashlib.sha256((t or b"").translate(A_TO_Z)).digest() for t in text.cast(pa.binary()).to_pylist()), pa.binary())


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Positions of digests, as rows of four 64-bit words, in a level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits, and the slot of each digest; digests must be distinct."""
    sizes, bits, places, rest, offset = [], [], np.zeros(len(words), np.int64), np.arange(len(words)), 0
    while len(rest):
        size = max(64, int(GAMMA * len(rest)))
        at = _positions(words[rest], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        places[rest[fits]] = offset + at[fits]
        sizes.append(size)
        bits.append(alone)
        offset += size
        rest = rest[~fits]
    all_bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(all_bits) - 1
    return sizes, all_bits, rank[places] if len(words) else places


def look_up(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot in which each digest would be if it is a member; -1 where no level has its bit."""
    rank, slots, rest, offset = np.cumsum(bits) - 1, np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = offset + _positions(words[rest], level, size).astype(np.int64)
        hit = bits[at]
        slots[rest[hit]] = rank[at[hit]]
        rest, offset = rest[~hit], offset + size
    return slots


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _build_shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    digests = rows["digest"].to_pylist()
    sizes, bits, slots = build_hash(_words(digests))
    order = np.argsort(slots)
    held = np.frombuffer(b"".join(digests), "V32")[order]
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()),
        "levels": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "digests": pa.array([held.tobytes()], pa.binary()),
        "winners": pa.array([rows["hist_id"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
        "copies": pa.array([rows["hist_copies"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
    })


def _look_up_shard(arrived: pa.Table, shard: pa.Table) -> pa.Table:
    """Rows of history for the members among the digests that arrived."""
    if not len(arrived) or not len(shard):
        return pa.table({"digest": pa.array([], pa.binary()), "hist_id": pa.array([], pa.int64()), "hist_copies": pa.array([], pa.int64())})
    row = shard.to_pylist()[0]
    digests = arrived["digest"].to_pylist()
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["levels"])).astype(bool)
    slots = look_up(_words(digests), row["levels"], bits)
    held = row["digests"]
    member = [i for i, s in enumerate(slots.tolist()) if s >= 0 and held[32 * s : 32 * s + 32] == digests[i]]
    at = slots[member]
    return pa.table({
        "digest": pa.array([digests[i] for i in member], pa.binary()),
        "hist_id": pa.array(np.frombuffer(row["winners"], "<i8")[at], pa.int64()),
        "hist_copies": pa.array(np.frombuffer(row["copies"], "<i8")[at], pa.int64()),
    })


#: Stands for a null doc_id in winners.
_NO_ID = -(2**63)


def exact_dedup(arrived: DataFrame, history: DataFrame) -> DataFrame:
    """Decisions for the rows of both tables, of which only doc_id and text are read.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and repeats_history (its text is in history).
    """
    spark = arrived.sparkSession
    narrow = lambda df, old: df.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest("text").alias("digest"), F.lit(old).alias("old"))
    rows = stage(narrow(history, True).unionByName(narrow(arrived, False)), "digests")
    ids = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    n_shards = max(shuffle_partitions(spark), -(-rows.count() // SHARD_DIGESTS))
    winners = lambda df, name: df.groupBy("digest").agg(F.max(F.coalesce("doc_id", F.lit(_NO_ID))).alias(f"{name}_id"), F.count("*").alias(f"{name}_copies")).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))

    old = stage(winners(rows.filter("old"), "hist"), "history-digests")
    new = stage(winners(rows.filter("not old"), "new"), "arrived-digests")
    hashes = old.groupBy("shard").applyInArrow(_build_shard, _SHARD_SCHEMA)
    found = stage(new.select("digest", "shard").groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(_look_up_shard, _FOUND_SCHEMA), "members")
    # members take history's winner and copies along; the others are groups of their own
    arrived_groups = new.join(found, "digest", "left").select(
        "digest",
        F.greatest("new_id", F.coalesce("hist_id", "new_id")).alias("keep"),
        (F.col("new_copies") + F.coalesce("hist_copies", F.lit(0))).alias("size"),
        F.col("hist_id").isNotNull().alias("met"),
    )
    other_groups = old.join(found, "digest", "left_anti").select("digest", F.col("hist_id").alias("keep"), F.col("hist_copies").alias("size"), F.lit(True).alias("met"))
    groups = arrived_groups.unionByName(other_groups)
    copies = ids.join(groups, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    best = F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("keep")
    return copies.select(
        "doc_id",
        F.nullif("keep", F.lit(_NO_ID)).alias("keep_id"),
        F.col("size").alias("group_size"),
        (best & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("met").alias("repeats_history"),
    )


def dedup_corpus(docs: DataFrame) -> DataFrame:
    """exact_dedup with the lower half of the table's id range as history and the rest as arrivals."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (int(low) + int(high)) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    return exact_dedup(docs.filter(~old), docs.filter(old))
