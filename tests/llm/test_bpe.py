import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from graftline.llm import bpe

PATH = bpe.default_path()
SCHEMA = "doc_id long, text string, k string, h int, word string"


def texts():
    rnd = random.Random(1)
    odd = [chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(1, 0xD7FF), rnd.randrange(0x300, 0x370), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(4000)]
    return ["".join(odd[i : i + 20]) for i in range(0, 4000, 20)] + [
        "", None, " \t", "Plain words, and more; words!", "a<|endoftext|>b <|startoftext|><|endo", "I'm they'll ''s !'s x's\x1cy\x85z\xa0q İI ΣΑΣ Σ", "é x", "w " * 50000, "x" * 30000, "İ̝", "tie", "tie",
    ]


@pytest.mark.parametrize("head, size, chunk", [(0, 1 << 23, 1000), (20, 1 << 23, 1), (10**6, 1 << 23, 2_000_000), (10**6, 200, 30_000)])
def test_results_equal_the_librarys(spark, head, size, chunk):
    rows = [(i if i % 9 else None, t, "a", 1, "b") for i, t in enumerate(texts())]
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        e = tok.encode(t or "", add_special_tokens=False)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((str(i), len(e.ids), sha(" ".join(map(str, e.ids))), sha(tok.decode(e.ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(spark.createDataFrame(rows, SCHEMA), digests=True, head_words=head, head_bytes=size, chunk_words=chunk).collect()]
    assert sorted(got) == sorted(want)


def test_texts_and_no_rows(spark):
    one = bpe.encode(spark.createDataFrame([(1, "Hello world", "a", 1, "b")], SCHEMA)).collect()[0]
    tok = Tokenizer.from_file(PATH)
    assert one.ids == " ".join(map(str, tok.encode("Hello world", add_special_tokens=False).ids))
    assert one.decoded == "hello</w> world</w>"
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distinct_words_make_one_row_with_their_ids(spark):
    docs = spark.createDataFrame([(1, "the the cat", "", 0, ""), (2, "The cat! unthinkableness", "", 0, "")], SCHEMA)
    tok = Tokenizer.from_file(PATH)
    rows = {r.word: r for r in bpe.word_table(bpe.split_corpus(docs, PATH, 1), PATH).collect()}
    assert {w: r.total for w, r in rows.items()} == {"the": 3, "cat": 2, "!": 1, "unthinkableness": 1}
    for w, r in rows.items():
        e = tok.encode(w, add_special_tokens=False)
        assert np.frombuffer(r.ids, "<u2").tolist() == e.ids and " ".join(bpe.pieces(PATH)[i] for i in e.ids) == tok.decode(e.ids)


def test_numbers_are_kept():
    rng = np.random.default_rng(0)
    for n in (0, 1, 300_000):
        x = rng.integers(0, 1 << 32, n)
        assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all()


def test_places_are_kept():
    rng = np.random.default_rng(1)
    for often, once, n in ((0, 0, 0), (0, 5, 0), (1, 0, 9), (300, 70, 5000), (70_000, 1000, 200_000)):
        x = np.r_[rng.integers(0, often, n) if often else np.zeros(0, np.int64), np.full(once, -1)]
        rng.shuffle(x)
        x[x < 0] = often + np.arange(once)
        assert (bpe.unpack_places(bpe.pack_places(x.astype(np.int32), often)) == x).all()
