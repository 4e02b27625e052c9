"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees.

Fingerprints are cut into bands such that two of them within the radius agree on at least
``agree`` bands.  For every choice of so many bands, the fingerprints that agree on them form a shard.  Each shard
builds a BK-tree (a child hangs on its parent by their Hamming distance) and asks it for each of its
fingerprints, following only the edges within the radius of the distance; subtrees whose members are all
linked already are left out.  A shard beyond ``SHARD_MAX`` fingerprints is cut by the bits that it does not agree on yet, into
radius + 1 further bands, of which near ones agree on one.  What is still beyond it is cut into blocks: each pair of blocks is
a group of its own, so that no task holds an unbounded shard and no pair is lost.  Trees are built where their shard is dealt to and not
broadcast: all of them together grow with the corpus.  The shard gives a spanning forest of its links, never all pairs;
components are joined over all shards afterwards.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated
rows are one node; a null doc_id is ignored for component ids, unless its component has no other id
(then the component id is null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.llm.components import connected_components
from graftline.llm.exact_dedup import A_TO_Z
from graftline.llm.memory import lean
from graftline.staging import shuffle_partitions, stage

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a shard, before it is cut into blocks, and of a block.
SHARD_MAX, BLOCK = 4096, 2048
#: Shingles hashed at once, which bounds memory for very long texts.
_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.translate(A_TO_Z).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_in_shingle, len(words))
    ends, starts = ends[k - 1 :].tolist(), [0, *(ends[: len(words) - k] + 1).tolist()]
    total, hash_ = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), _AT_ONCE):
        hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(ends)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def simhash(text: pa.Array) -> pa.Array:
    """The fingerprint as a signed 64-bit integer."""
    found = np.fromiter((fingerprint(t or b"") for t in text.cast(pa.binary()).to_pylist()), np.uint64, len(text))
    return pa.array(found.view(np.int64))


class BKTree:
    """Integers by Hamming distance; members are taken out once they are linked."""

    def __init__(self, values: list[int]):
        self.values, self.children, self.parent = values, [{} for _ in values], [-1] * len(values)
        for i in range(1, len(values)):
            at = 0
            while True:
                d = (values[i] ^ values[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d], self.parent[i] = i, at
                    break
                at = nxt
        self.left = [1] * len(values)  # members of the subtree that are not taken out
        for i in range(len(values) - 1, 0, -1):
            self.left[self.parent[i]] += self.left[i]
        self.taken = [False] * len(values)

    def take(self, i: int) -> None:
        self.taken[i] = True
        while i >= 0:
            self.left[i] -= 1
            i = self.parent[i]

    def near(self, value: int, radius: int) -> list[int]:
        """Members within the radius that are not taken out."""
        found, todo = [], [0] if self.values and self.left[0] else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius and not self.taken[at]:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius and self.left[child]:
                    todo.append(child)
        return found


def forest(own: list[int], other: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect what all links within own, or between own and other, connect."""
    links, both = [], bool(other)
    trees = [BKTree(own), BKTree(other)] if both else [BKTree(own)]
    for side, start in ((s, i) for s, tree in enumerate(trees) for i in range(len(tree.values))):
        if trees[side].taken[start]:
            continue
        trees[side].take(start)
        todo = [(side, trees[side].values[start])]
        while todo:
            s, value = todo.pop()
            tree = trees[1 - s if both else 0]
            for i in tree.near(value, radius):
                tree.take(i)
                links.append((value, tree.values[i]))
                todo.append((1 - s if both else 0, tree.values[i]))
    return links


def band_plan(n: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Masks: two values within the radius agree under one of them; wider masks for more values, so that shards stay small."""
    for agree in range(1, 4):
        bands = radius + agree
        cuts = [64 * i // bands for i in range(bands + 1)]
        masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
        if agree == 3 or n >> (agree * (64 // bands)) <= 256:
            return [sum(x) for x in combinations(masks, agree)]
    raise AssertionError


def _linker(radius: int):
    """A mapInArrow function over rows (shard columns, fp, side) sorted by shard: links of each shard."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        key, own, other = None, [], []

        def flush():
            for a, b in forest(own, other, radius) if len(own) + len(other) > 1 and (own or not other) else ():
                out_a.append(a)
                out_b.append(b)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])
            out_a.clear()
            out_b.clear()
            return made

        for b in batches:
            if not b.num_rows:
                continue
            fps = b["fp"].to_numpy().view(np.uint64)
            keys = np.stack([b[c].to_numpy() for c in ("band", "value", "sub", "rest", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            side = b["side"].to_numpy()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                k = tuple(keys[:, lo].tolist())
                if k != key:
                    flush()
                    key, own, other = k, [], []
                second = side[lo:hi] == 1
                own += fps[lo:hi][~second].tolist()
                other += fps[lo:hi][second].tolist()
            if len(out_a) > 10_000:
                yield batch()
        flush()
        yield batch()

    return link


def further_bands(mask: int, radius: int) -> list[int]:
    """Masks that part the other bits: two values within the radius that agree under mask agree under one of them too."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(1 << i for i in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> F.Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links_within(fps: DataFrame, n: int, radius: int = RADIUS, shard_max: int = SHARD_MAX, block: int = BLOCK) -> DataFrame:
    """(a, b) links that span every component of the distinct fingerprints fp within the radius; n: about how many there are."""
    spark = fps.sparkSession
    masks = band_plan(n, radius)
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_signed(m)) for m in masks])).alias("band", "value"))
    large = shards.groupBy("band", "value").agg(F.count("*").alias("n")).filter(F.col("n") > shard_max)
    marked = shards.join(large, ["band", "value"], "left")
    inner = F.array(*[F.array(*[_signed(x) for x in further_bands(m, radius)]) for m in masks])
    whole = marked.filter("n is null").select("band", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest"), "fp")
    parts = marked.filter("n is not null").select("band", "value", "fp", F.posexplode(F.get(inner, F.col("band"))).alias("sub", "mask"))
    parts = parts.select("band", "value", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")
    key = ["band", "value", "sub", "rest"]
    crowded = parts.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > shard_max)
    dealt = whole.withColumn("blocks", F.lit(1)).unionByName(parts.join(crowded, key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a block meets each block of its shard once: as the first side for those from it on, as the second for those before
    met = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "fp", (F.col("own") > F.col("with")).cast("int").alias("side")
    )
    key += ["i", "j"]
    return met.repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key, "side", "fp").mapInArrow(lean(_linker(radius)), "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (signed), the columns of carry, root (of the component: ids may repeat), component_id: the smallest doc_id that links within the radius reach."""
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash("text").alias("fp"), *carry), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    edges = stage(links_within(classes.select("fp"), classes.count(), radius), "links")
    roots = connected_components(edges)
    least = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    ids = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = least.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(known, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed), component_id."""
    return components(docs, radius).select("fp", "doc_id", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
