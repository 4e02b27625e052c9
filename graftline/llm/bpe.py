"""BPE encoding and decoding through a table of distinct words.

Texts are split into words once, in chunks of about ``CHUNK_WORDS`` words; a chunk keeps its distinct words, the most frequent first, and for every
position the number of the word there.  The distinct words of all chunks are encoded once each.  Chunks' words are joined with
this table: frequent words, at most ``HEAD_WORDS`` of at most ``HEAD_BYTES``, without a shuffle, others by word.  Then every
chunk's ids come back to their positions, are joined with the vocabulary's id-to-piece table, and documents are put together.
Texts themselves are not shuffled.  The id-to-piece table is as long as the vocabulary and dense in its ids, so that every worker holds it
and a probe is an access by id.

The tokenizer's file gives NFC, white space and lower-casing, a pattern that cuts words, and byte-level
BPE whose last piece ends in </w>.  Texts of characters below U+0250 (but the separators U+001C-001F) are
split here in the same way; all others go through the library's own normaliser and splitter.  Special
tokens that appear in a text stay whole, as the library has it.  Decoding joins pieces by one space, as
the library does for a file that names no decoder.

Defined results: null and empty texts have no tokens; rows that repeat id and text are separate rows with equal results; a null doc_id
is an id like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers

from graftline.llm.memory import lean
from graftline.staging import shuffle_partitions, stage

#: Words whose ids all executors hold, at most, and bytes of their rows; the others are joined.
HEAD_WORDS, HEAD_BYTES = 250_000, 8 << 20
#: Words of a chunk, after which it ends with the document.
CHUNK_WORDS = 2_000_000
#: Documents that are taken from a batch, and words that are kept as Python texts or put in place, at once.
_DOCS_AT_ONCE, _WORDS_AT_ONCE = 512, 1 << 16

# The special tokens and the word pattern of the tokenizer's file.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters and numbers below U+0250, lower-cased; the pattern above in these terms, its most frequent case first.
_LETTER, _NUMBER = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
_WORDS = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ]*")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _cutter(path: str) -> Tokenizer:
    """The file's normaliser and splitter without its vocabulary, which splitting does not need."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"] |= {"vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None}))


@cache
def _word_tokenizer(path: str) -> Tokenizer:
    """For words, which are normalised already."""
    tok = Tokenizer.from_file(path)
    tok.normalizer = normalizers.Sequence([])
    return tok


@cache
def _byte_chars() -> tuple[dict[str, int], list[str]]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: b for b, c in chars.items()}, [chars[b] for b in range(256)]


def split_words(text: str | None, path: str) -> list[str]:
    """The words of a text in order."""
    if not text:
        return []
    if "<|" in text and len(parts := _SPECIAL.split(text)) > 1:
        return [w for p in parts for w in ([p] if p in SPECIALS else split_words(p, path))]
    if _PLAIN.fullmatch(text):
        return _WORDS.findall(text.lower())
    tok, (back, _) = _cutter(path), _byte_chars()
    return [bytes(back[c] for c in w).decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte in planes, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


def pack_places(rank: np.ndarray, often: int) -> bytes:
    """A word's number at each position, which is used up.  Words from number often on stand once, in the order of their numbers: 0 is the next of them.  Others are a byte, or 255 and planes."""
    rank += 1
    rank[rank > often] = 0
    large = rank >= 255
    rest = (rank[large] - 255).astype("<u4").view(np.uint8).reshape(-1, 4).T
    np.minimum(rank, 255, out=rank)
    return struct.pack("<QQ", often, len(rank)) + zstandard.compress(rank.astype(np.uint8).tobytes() + rest.tobytes(), 3)


def unpack_places(data: bytes) -> np.ndarray:
    often, n = struct.unpack_from("<QQ", data)
    plain = np.frombuffer(zstandard.decompress(data[16:]), np.uint8)
    out = plain[:n].astype(np.int32)
    out[out == 255] = 255 + plain[n:].reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int32)
    once = np.flatnonzero(out == 0)
    out -= 1
    out[once] = often + np.arange(len(once))
    return out


_CHUNKS = "chunk long, number int, word string, n int, places binary, docs array<long>, sizes array<int>"


def _sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts that the JVM takes one by one."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _splitter(path: str, chunk_words: int):
    """A mapInArrow function over (doc_id, text): for each chunk its words, and a row without a word for its documents and positions."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, words, parts, n, docs, sizes = TaskContext.get().partitionId() << 32, [], [], 0, [], []

        def made() -> pa.RecordBatch:
            coded = pa.chunked_array([*parts, pa.array(words, pa.string())]).combine_chunks().dictionary_encode()
            parts.clear()
            words.clear()
            met, known = coded.indices.to_numpy(), coded.dictionary
            counts = np.bincount(met, minlength=len(known))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            k = len(order)
            last = lambda x, t: pa.concat_arrays([pa.nulls(k, t), pa.array([x], t)])
            first = lambda x, t: pa.concat_arrays([x.cast(t), pa.nulls(1, t)])
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(k + 1, chunk, np.int64)), first(pa.array(np.arange(k)), pa.int32()), first(known.take(pa.array(order)), pa.string()), first(pa.array(counts[order]), pa.int32()),
                last(pack_places(rank[met], int((counts > 1).sum())), pa.binary()), last(docs, pa.list_(pa.int64())), last(sizes, pa.list_(pa.int32())),
            ], ["chunk", "number", "word", "n", "places", "docs", "sizes"])

        for b in (batch.slice(at, _DOCS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, _DOCS_AT_ONCE)):
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = split_words(text, path)
                words += own
                docs.append(doc_id)
                sizes.append(len(own))
                if n + len(words) >= chunk_words or len(docs) >= chunk_words:
                    yield from _sliced(made())
                    chunk, n, docs, sizes = chunk + 1, 0, [], []
                elif len(words) >= _WORDS_AT_ONCE:  # as Arrow they take a fifth
                    parts.append(pa.array(words, pa.string()))
                    n, words = n + len(words), []
        if docs:
            yield from _sliced(made())

    return split


def _id_type(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _encoder(path: str):
    """Ids of a word as bytes."""

    def encode(word: pa.Array) -> pa.Array:
        kind = _id_type(path)
        return pa.array([np.array(e.ids, kind).tobytes() for e in _word_tokenizer(path).encode_batch(word.to_pylist(), add_special_tokens=False)], pa.binary())

    encode.__annotations__ = {"word": pa.Array, "return": pa.Array}
    return F.arrow_udf(encode, T.BinaryType())


@cache
def pieces(path: str) -> list[str]:
    """The id-to-piece table: as long as the vocabulary, so that every executor holds it."""
    tok = _tokenizer(path)
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size())]


@cache
def _id_texts(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def split_corpus(docs: DataFrame, path: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """chunk, number, word, n of every chunk's words, and for each chunk a row with its documents' ids, their sizes in words, and the word's number at each position."""
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_splitter(path, chunk_words)), _CHUNKS), "chunks")


def word_table(chunks: DataFrame, path: str) -> DataFrame:
    """word, total (occurrences), ids (as bytes): a row for each distinct word of split_corpus."""
    words = chunks.filter("word is not null").groupBy("word").agg(F.sum("n").alias("total"))
    return stage(words.select("word", "total", _encoder(path)(F.col("word")).alias("ids")), "words")


def head_count(words: DataFrame, most: int, most_bytes: int) -> int:
    """The least power of two such that at most so many words, of at most so many bytes, are as frequent."""
    powers, size = range(48), F.octet_length("word") + F.octet_length("ids")
    often = [F.col("total") >= (1 << p) for p in powers]
    got = words.agg(*[x for o in often for x in (F.count_if(o), F.coalesce(F.sum(F.when(o, size)), F.lit(0)))]).first()
    return next((1 << p for p in powers if got[2 * p] <= most and got[2 * p + 1] <= most_bytes), 1 << 62)


_PACKED = "chunk long, numbers binary, widths binary, ids binary, places binary, docs array<long>, sizes array<int>"
#: Rows that a task gathers by chunk before it passes them on.
_ROWS_AT_ONCE = 200_000


def _packer(kind: str):
    """A mapInArrow function over (chunk, number, ids): one row for each chunk that a task has words of, numbers as steps."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            of = rows["chunk"].to_numpy()
            order = np.lexsort((rows["number"].to_numpy(), of))
            rows, of = rows.take(pa.array(order)).combine_chunks(), of[order]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            numbers, widths = rows["number"].to_numpy(), pc.binary_length(rows["ids"]).to_numpy()
            ids = rows["ids"].to_pylist()
            packed_ids = lambda lo, hi: pack_numbers(np.frombuffer(b"".join(ids[lo:hi]), kind))
            steps = lambda lo, hi: np.diff(numbers[lo:hi], prepend=0)
            spans = list(zip(cuts, cuts[1:], strict=False))
            k = len(spans)
            return pa.RecordBatch.from_arrays([
                pa.array(of[cuts[:-1]], pa.int64()), pa.array([pack_numbers(steps(lo, hi)) for lo, hi in spans], pa.binary()), pa.array([pack_numbers(widths[lo:hi]) for lo, hi in spans], pa.binary()),
                pa.array([packed_ids(lo, hi) for lo, hi in spans], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32())),
            ], ["chunk", "numbers", "widths", "ids", "places", "docs", "sizes"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= _ROWS_AT_ONCE:
                yield made()
                held, n = [], 0
        if held:
            yield made()

    return pack


def _assembler(path: str, digests: bool):
    """A mapInArrow function over packed rows, one chunk behind the other: documents with their ids and pieces."""
    table, size = pieces(path), np.dtype(_id_type(path)).itemsize

    def documents(rows: list[dict]) -> Iterator[tuple[int | None, int, str, str]]:
        head = next(r for r in rows if r["sizes"] is not None)
        packed = [r for r in rows if r["sizes"] is None]
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack_numbers(r["numbers"])) for r in packed)])
        width = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(r["widths"]) for r in packed)]) // size
        ids = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(r["ids"]) for r in packed)])
        starts, widths = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        starts[numbers], widths[numbers] = np.cumsum(width) - width, width
        word_at, texts, piece = unpack_places(head["places"]), _id_texts(len(table)), table
        docs, sizes, at, done = head["docs"], head["sizes"], 0, 0
        while done < len(docs):
            end, n = done, 0
            while end < len(docs) and (end == done or n + sizes[end] <= _WORDS_AT_ONCE):
                n += sizes[end]
                end += 1
            own = word_at[at : at + n]
            w = widths[own]
            before = np.cumsum(w) - w
            tokens = ids[np.repeat(starts[own] - before, w) + np.arange(int(w.sum()))].tolist()
            cut = np.r_[before, len(tokens)][np.cumsum([0, *sizes[done:end]])].tolist()
            for i in range(done, end):
                mine = tokens[cut[i - done] : cut[i - done + 1]]
                yield docs[i], len(mine), " ".join([texts[t] for t in mine]), " ".join([piece[t] for t in mine])
            at, done = at + n, end

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        shown = (lambda t: hashlib.sha256(t.encode()).hexdigest()) if digests else (lambda t: t)

        def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            out = [(i, n, shown(a), shown(b)) for i, n, a, b in documents(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

        chunk, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["chunk"] != chunk:
                    if held:
                        yield from made(held)
                    chunk, held = row["chunk"], []
                held.append(row)
        if held:
            yield from made(held)

    return assemble


def encode(docs: DataFrame, path: str | None = None, digests: bool = False, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (space-joined text), or with digests their SHA-256 instead."""
    path = path or default_path()
    chunks = split_corpus(docs, path, chunk_words)
    words = word_table(chunks, path)
    least = head_count(words, head_words, head_bytes)
    # at most head_words rows of at most head_bytes
    head = F.broadcast(words.filter(F.col("total") >= least).select("word", "ids"))
    tail = words.filter(F.col("total") < least).select("word", "ids")
    own = chunks.filter("word is not null").select("chunk", "number", "word")
    often = own.join(head, "word").select("chunk", "number", "ids")
    rest = own.join(head.select("word"), "word", "left_anti").join(tail, "word").select("chunk", "number", "ids")
    # written first, so that the words' shuffle is gone before the chunks' begins
    rest = stage(rest.mapInArrow(lean(_packer(_id_type(path))), _PACKED), "tails")
    packed = often.mapInArrow(lean(_packer(_id_type(path))), _PACKED).unionByName(rest)
    none = [F.lit(None).cast("binary").alias(c) for c in ("numbers", "widths", "ids")]
    every = packed.unionByName(chunks.filter("word is null").select("chunk", *none, "places", "docs", "sizes"))
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string")
    return every.repartition(shuffle_partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(lean(_assembler(path, digests)), out)
