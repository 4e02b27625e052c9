"""The pipeline against a plain version of its stages on a small corpus."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graftline.llm import bpe, mixing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    pool = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fa") for b in ("ra", "ne", "lo", "ti", "mu")]
    rows = []
    for i in range(80):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(30, 60)))
        rows.append((i, text if i % 8 else " ".join(["JUNK!!"] * 40), "en", f"s{i % 3 if i % 4 else 0}", 0))
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s0", 0) for i in range(1, 12)]  # exact copies but for case
    rows += [(200 + i, rows[i][1] + " extra", "en", "s1", 0) for i in range(20, 30)]  # near copies
    return rows + [(None, None, None, None, None), (300, "", "en", "s2", 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    key = lambda rows: sorted(map(str, rows))
    for (_, step), plain in zip(corpus_pipeline.STAGES[:3], (plain_quality, plain_exact, plain_near), strict=True):
        out = step(spark, docs, folder)
        assert out.columns == names
        rows = [tuple(r) for r in out.collect()]
        assert key(rows) == key(plain(spark, folder, [tuple(r) for r in docs.collect()]))
        docs = spark.createDataFrame(rows, SCHEMA)
    mixed = corpus_pipeline.mixing_stage(spark, docs, folder)
    assert mixed.columns == names
    known, got = set(docs.collect()), mixed.collect()
    assert set(got) <= known
    limits = {r.source: r.budget for r in mixing.plan(docs.select("source", mixing.tokens(F.col("text")).alias("tokens"))).collect()}
    for source, budget in limits.items():
        spent = sum(len((r.text or "").split()) for r in got if r.source == source)
        assert budget - 70 < spent <= budget
    tok = Tokenizer.from_file(bpe.default_path())
    out = corpus_pipeline.bpe_stage(spark, mixed, folder).collect()
    sha = lambda r: hashlib.sha256(" ".join(map(str, tok.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest()
    assert key((r.doc_id, r.ids_sha256) for r in out) == key((r.doc_id, sha(r)) for r in got)


def plain_quality(spark, folder, rows):
    table = {r.doc_id: r.selected for r in quality.classify(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = [r for r in rows if table[r[0]]]
    assert sum(table[i] for i in range(80) if i % 8) >= 63 and not any(table[i] for i in range(0, 80, 8))
    return kept


def plain_exact(spark, folder, rows):
    best = {}
    for r in rows:
        k = "".join(c.lower() if c.isascii() else c for c in r[1] or "")
        if k not in best or (r[0] is not None and (best[k][0] is None or r[0] > best[k][0])):
            best[k] = r
    return list(best.values())


def plain_near(spark, folder, rows):
    fps = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        k = find(i)
        if k not in first or (r[0] is not None and (first[k][0] is None or r[0] < first[k][0])):
            first[k] = r
    return list(first.values())


def test_run_is_the_stages_in_a_row(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


def test_dedup_stages_keep_one_row_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e, f = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(6))
    rows = [(1, a)] * 2 + [(None, b)] * 3 + [(None, c)] + [(7, d), (7, e), (9, d)] + [(8, "One text in two cases"), (8, "one Text in two cases")] + [(50, f)] * 500
    rows = [(i, t, "en", None, 0) for i, t in rows] + [(60, "the same words again", None, "x", 0), (60, "the same words again", "x", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda found: sorted(str((r[0], r[1].lower())) for r in found)
    for step, plain in ((corpus_pipeline.exact_dedup_stage, plain_exact), (corpus_pipeline.near_dedup_stage, plain_near)):
        out = step(spark, docs, "")
        assert out.columns == docs.columns and key(out.collect()) == key(plain(spark, "", rows))


CLASHES = ("mix", "cut", "epoch", "copies", "kept", "k", "h", "_id", "_hash", "id", "hash", "row", "group", "fp", "digest", "good", "block", "key", "tokens", "a.b")


def test_stages_pass_columns_of_any_name_and_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(i))
    none = docs.limit(0)
    for _, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, docs, folder)
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(CLASHES)))}
        assert step(spark, none, folder).count() == 0
    assert corpus_pipeline.bpe_stage(spark, docs, folder).count() == docs.count() and corpus_pipeline.bpe_stage(spark, none, folder).count() == 0
