import hashlib
import random

import numpy as np
import pytest
import xxhash

from graftline.llm import exact_dedup, simhash
from graftline.llm.components import connected_components

SCHEMA = "doc_id long, text string, digest string, n int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits, slots = exact_dedup.build_hash(words)
    assert sorted(slots) == list(range(5000))
    assert (exact_dedup.look_up(words, sizes, bits) == slots).all()
    assert exact_dedup.build_hash(words[:0])[2].size == 0


ROWS = [(5, "Abc"), (9, "aBC"), (1, "abc"), (2, None), (3, ""), (4, "É"), (6, "é"), (None, "abc"), (7, "w " * 60000), (8, "W " * 60000), (10, "solo"), (11, "tie"), (11, "tie"), (None, "lost")]


def test_exact_dedup_matches_brute_force(spark):
    got = sorted(map(str, exact_dedup.dedup_corpus(docs(spark, ROWS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(-1 if i is None else i)
    want, seen = [], set()
    for i, t in ROWS:
        g = groups[lower(t)]
        best = (-1 if i is None else i) == max(g) and lower(t) not in seen
        if best:
            seen.add(lower(t))
        want.append((i, None if max(g) == -1 else max(g), len(g), best, hashlib.sha256(lower(t).encode()).hexdigest()))
    from pyspark.sql import Row

    row = Row("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(map(str, (row(*w) for w in want)))


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup_corpus(docs(spark, [])).count() == 0
    assert exact_dedup.dedup_corpus(docs(spark, [(None, None)])).collect()[0].kept


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in lower(text)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \t", "One two", "a b c d", "a\x0bB c d e f a b c d", "É é " * 50, "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def union_find(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def cluster(rng, n):
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        v = rng.choice(base)
        for _ in range(rng.randrange(9)):
            v ^= 1 << rng.randrange(64)
        out.add(v if rng.random() < 0.8 else rng.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize("shard_max", [4096, 8])
def test_links_span_all_components(spark, shard_max):
    values = cluster(random.Random(3), 300)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.links_within(fps, len(values), shard_max=shard_max, block=4)).collect()}
    want = union_find(values, 4)
    got = [roots.get(v, v) for v in values]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_wider_masks_find_the_same_links():
    rng = random.Random(5)
    for n in (10, 10**8, 10**11):
        for _ in range(200):
            a, diff = rng.getrandbits(64), 0
            for b in rng.sample(range(64), 4):
                diff |= 1 << b
            assert any(not diff & m for m in simhash.band_plan(n))


def test_near_duplicates(spark):
    rows = [(i, f"w{i % 7} " * (i % 5)) for i in range(60)] + [(None, None), (None, "only here once but long"), (3, "x")]
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", "fp", "component_id").collect()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    roots = union_find(fps, 4)
    want = sorted(str((i, f, min((j for (j, _), r in zip(rows, roots) if r == roots[k] and j is not None), default=None))) for k, ((i, _), f) in enumerate(zip(rows, fps)))
    assert sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_path_and_nulls(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
