"""Media columns: payloads stored as baseline JPEG, read back, with dimensions and thumbnail hashes.

Every text becomes a payload (UTF-8, blanks up to a positive multiple of 192 bytes), the payload a JPEG blob
that keeps it exactly.  Features come from the blob alone: its markers are parsed, its scan Huffman-decoded, and the luminance DC
coefficients give a thumbnail whose hashes are stored with the dimensions.  The work is row by row and needs no shuffle.

Defined results: a null text counts as empty, whose payload is 192 blanks; equal texts give equal blobs; rows
that repeat an id are separate rows; an empty table gives an empty result; other columns are ignored.  Media that are null have null features;
media that cannot be decoded have their size and digest, nulls for the rest and the reason in error; a file of others has no payload, but all else.
"""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.llm import jpeg

_FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("feature", pa.string()), ("error", pa.string())]
_SCHEMA = T.StructType([T.StructField(n, {"int64": T.LongType(), "int32": T.IntegerType(), "string": T.StringType()}[str(t)]) for n, t in _FEATURES])


@F.arrow_udf(T.BinaryType())
def to_media(text: pa.Array) -> pa.Array:
    """The JPEG blob of a text."""
    return pa.array([jpeg.encode(jpeg.pad(t or b"")) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def _header(blob: bytes) -> jpeg.Header | ValueError:
    try:
        return jpeg.parse(blob)
    except ValueError as x:
        return x


def _row(blob: bytes, h: jpeg.Header | ValueError, coefficients) -> tuple:
    stored = len(blob), jpeg.digest(blob)
    if isinstance(coefficients, ValueError):
        return None, None, None, *stored, None, None, None, str(coefficients)
    try:
        payload, error = jpeg.payload_of(h, coefficients), None
    except ValueError as x:
        payload, error = None, str(x)
    own = (None, None, None) if payload is None else (len(payload), jpeg.digest(payload), crc32(payload[-16:]))
    return *own, *stored, h.width, h.height, jpeg.feature(h, jpeg.thumbnail(h, coefficients)), error


def read_back(blobs: Sequence[bytes | None]) -> list[tuple]:
    """The features of each blob; files are decoded side by side, so many at once that memory is bounded."""
    out: list[tuple] = []
    at = 0
    while at < len(blobs):
        end, size = at, 0
        while end < len(blobs) and (end == at or size + len(blobs[end] or b"") <= jpeg.AT_ONCE):
            size += len(blobs[end] or b"")
            end += 1
        own = [b for b in blobs[at:end] if b is not None]
        headers = [_header(b) for b in own]
        rows = iter([_row(b, h, c) for b, h, c in zip(own, headers, jpeg.decode_many(headers), strict=True)])
        out += [(None,) * len(_FEATURES) if b is None else next(rows) for b in blobs[at:end]]
        at = end
    return out


@F.arrow_udf(_SCHEMA)
def media_features(media: pa.Array) -> pa.Array:
    """What the stored bytes give."""
    rows = read_back(media.to_pylist())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FEATURES)], [n for n, _ in _FEATURES])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the blob)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), to_media("text").alias("media"))


def describe(stored: DataFrame) -> DataFrame:
    """The features of stored media, beside doc_id and n_bytes."""
    return stored.withColumn("f", media_features("media")).select("doc_id", "n_bytes", "f.*")
