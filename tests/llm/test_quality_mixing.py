import math
import random

import numpy as np
from pyspark.sql import functions as F

from graftline.llm import mixing, quality

SCHEMA = "doc_id long, text string, source string, key long, mix string"


def words(rng, pool, n):
    return " ".join(rng.choice(pool) for _ in range(n))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    good, bad = [f"w{i}" for i in range(40)], [f"W{i}!!" for i in range(40)]
    return [(i, words(rng, bad if i % 5 == 0 else good, rng.randrange(5, 60)), f"s{min(i % 9, 3)}", 0, "") for i in range(n)]


def test_ratios_equal_brute_force(spark):
    rows = corpus(60)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    fold = {r.doc_id: r.fold for r in quality._bounded_labels(labels).collect()}
    raw, target = np.full(quality.BINS, 0.5), np.zeros(quality.BINS)
    for i, t, *_ in rows:
        for b in quality.gram_bins(t.encode()).astype(int):
            raw[b] += 1
            target[b] += i % 5 != 0 and fold[i] == 0
    p = raw / raw.sum()
    want = np.log((target + 4096 * p) / (target.sum() + 4096)) - np.log(p)
    got = quality.fit(docs, labels)
    assert np.allclose(got, want)
    w = {r.doc_id: r.w for r in docs.select("doc_id", quality.log_weight(got)("text").alias("w")).collect()}
    assert all(math.isclose(w[i], want[quality.gram_bins(t.encode()).astype(int)].sum()) for i, t, *_ in rows)


def test_kth_largest_is_exact(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(6) for _ in range(500)] + [1.5] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 37, 300, 549):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 550) == -math.inf and quality.kth_largest(df, "x", 0) == math.inf


def test_selection_keeps_the_good_and_is_a_top_k(spark):
    rows = corpus() + [(1000, None, "s0", 0, ""), (1001, "", "s0", 0, ""), (None, "w1 w2", "s1", 0, ""), (7, corpus()[7][1], "s1", 0, "")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.selected for r in known if r.doc_id % 5) >= 0.97 * sum(1 for r in known if r.doc_id % 5)
    assert not any(r.selected for r in known if r.doc_id % 5 == 0)
    least = min(r.gumbel_key for r in got if r.selected)
    assert all(r.selected == (r.gumbel_key >= least) for r in got)
    assert {r.doc_id: r.log_weight for r in got}[1000] == 0.0
    kept = quality.select_documents(spark.createDataFrame(rows, SCHEMA), labels)
    assert kept.columns == ["doc_id", "text", "source", "key", "mix"] and kept.count() == sum(r.selected for r in got)


def test_selection_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.selected for r in quality.classify(spark.createDataFrame(corpus(10), SCHEMA), none).collect())
    assert quality.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def brute_weights(totals, share, repeats, budget):
    every = sum(totals.values())
    p = {s: t / every for s, t in totals.items()}

    def weights(t):
        z = sum(x**t for x in p.values())
        return {s: x**t / z for s, x in p.items()}

    h = lambda w: -sum(x * math.log(x) for x in w.values())
    target = h(p) + share * (math.log(len(p)) - h(p))
    fits = lambda t: h(weights(t)) <= target + 1e-12 and max(budget * w / totals[s] for s, w in weights(t).items()) <= repeats + 1e-9
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return weights(high)


def test_weights_and_budgets(spark):
    rows = corpus() + [(400, None, None, 0, ""), (401, "one two three", None, 0, ""), (402, "", "empty", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    totals = {}
    for _, t, s, *_ in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    totals = {s: t for s, t in totals.items() if t}
    for share, repeats in ((0.5, 4.0), (0.9, 1.3), (0.0, 4.0)):
        units = docs.select("source", mixing.tokens(F.col("text")).alias("tokens"))
        got = {r.source: r for r in mixing.plan(units, entropy_share=share, max_repeats=repeats).collect()}
        want = brute_weights(totals, share, repeats, sum(totals.values()))
        assert set(got) == set(want) and all(abs(got[s].weight - w) < 1e-6 for s, w in want.items())
    mixed = mixing.realise(docs).collect()
    longest = max(len((t or "").split()) for _, t, *_ in rows)
    for s, r in {r.source: r for r in mixing.plan(docs.select("source", mixing.tokens(F.col("text")).alias("tokens"))).collect()}.items():
        spent = sum(m.mix_.tokens for m in mixed if m.source == s)
        assert r.budget - longest < spent <= r.budget
        copies = {}
        for m in mixed:
            if m.source == s:
                copies[m.doc_id] = copies.get(m.doc_id, 0) + 1
        assert set(copies.values()) <= {r.whole, r.whole + 1}
    assert not any(m.source == "empty" for m in mixed)
    assert set(mixed[0].asDict()) == {"doc_id", "text", "source", "key", "mix", "mix_"}


def test_chosen_rows_equal_block_permutations(spark):
    """Whole epochs, then blocks by their keys, then documents of the block in which the budget ends; by plain loops over the hashes."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", None]), 0, "") for i in range(1500)]
    rows += [rows[5]] * 3 + [(None, None, "a", 0, ""), (9000, "w " * 20_000, "b", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    keyed = docs.select("doc_id", "source", mixing.tokens(F.col("text")).alias("tokens"), mixing.doc_key(F.col("doc_id"), F.col("text"), mixing.SEED).alias("key"))
    plan = {r.source: r for r in mixing.plan(keyed).collect()}
    want = {}
    for source, p in plan.items():
        own = [r for r in keyed.collect() if r.source == source]
        block_of = {r.key: r.key % p.blocks for r in own}
        blocks = spark.createDataFrame([(source, b) for b in sorted(set(block_of.values()))], "source string, block long")
        order = [r.block for r in blocks.withColumn("o", mixing._block_key(F.col("source"), F.col("block"), F.lit(p.whole).cast("long"), mixing.SEED)).orderBy("o").collect()]
        left, last = p.rest, set()
        for b in order:
            inside = sorted((r for r in own if block_of[r.key] == b), key=lambda r: r.key)
            if sum(r.tokens for r in inside) <= left:
                left -= sum(r.tokens for r in inside)
                last |= {r.key for r in inside}
                continue
            for key in sorted({r.key for r in inside}):
                need = sum(r.tokens for r in inside if r.key == key)
                if need > left:
                    break
                left -= need
                last.add(key)
            break
        for r in own:
            n = p.whole + (r.key in last)
            if n:
                want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + n
    got = {}
    for r in mixing.realise(docs).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == want


def test_columns_of_any_name_are_passed_on(spark):
    docs = spark.createDataFrame([(i, "some words here", "s", i, "m") for i in range(9)], SCHEMA).drop("mix")
    names = ["MIX", "cut", "epoch", "copies", "row", "block", "place", "a.b"]
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    got = mixing.realise(docs)
    assert got.columns == [*docs.columns, "mix_"] and all(r["a.b"] == "a.b" and r["cut"] == "cut" and r.mix_.epoch >= 0 for r in got.collect()) and got.count() > 0


def test_mixing_nothing(spark):
    assert mixing.realise(spark.createDataFrame([], SCHEMA)).count() == 0
