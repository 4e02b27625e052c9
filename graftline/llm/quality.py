"""Quality classifier by importance resampling.

Two bag-of-n-gram models over hashed word unigrams and bigrams are fitted: the target model on documents that
are labelled good, the raw model on the whole corpus.  A document's log importance weight is the sum
of log p_target / p_raw over its n-grams.  k is the number of documents whose weight is at least the
``CLEAN_LOSS`` quantile of labelled good documents outside the fit; then the k largest Gumbel-perturbed weights
are drawn (Gumbel top-k samples k documents without replacement in proportion to their weights).

Labels come from at most ``LABEL_BOUND`` labelled documents, those with the smallest hash of doc_id;
counts, weights and the k-th key cover every document.  The k-th key is found by counting keys
in bins, in a few passes, so that no keys are gathered.

Defined results: null and empty texts have weight 0; a null doc_id is a document without a label;
rows that repeat id and text share weight and noise, and those tied with the k-th are all selected; without
good labels every document is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.llm.memory import lean
from graftline.staging import stage

BINS = 1 << 16
LABEL_BOUND, CLEAN_LOSS, SMOOTHING, SEED = 20_000, 0.001, 0.5, 9
#: The target model starts from so many n-grams of the raw model, so that few labels do not make rare n-grams look bad.
PRIOR = 4096
#: Bins of a pass that looks for the k-th key.
KEY_BINS = 1024
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def gram_bins(text: bytes | None) -> np.ndarray:
    """Bins of the word unigrams and bigrams."""
    words = (text or b"").split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _PAIR + h[1:]) * _PAIR
    return np.concatenate([h, pairs]) >> np.uint64(48)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bins in all rows and in those marked as target."""
    raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for b in batches:
        for text, good in zip(b["text"].cast(pa.binary()).to_pylist(), b["good"].to_pylist(), strict=True):
            if text:
                bins = gram_bins(text).astype(np.int64)
                np.add.at(raw, bins, 1)
                if good:
                    np.add.at(target, bins, 1)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bin", "raw", "target"])


def _bounded_labels(labels: DataFrame) -> DataFrame:
    """At most LABEL_BOUND labelled ids, with fold 0 for the fit and 1 for calibration."""
    own = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    return own.orderBy("h", "doc_id", "quality").limit(LABEL_BOUND).groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target / p_raw for each bin."""
    chosen = _bounded_labels(labels).filter("quality = 1 and fold = 0").select("doc_id", F.lit(True).alias("good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(lean(_count), "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.full(BINS, SMOOTHING), np.zeros(BINS)
    at = counts["bin"].to_numpy()
    raw[at] += counts["raw"].to_numpy()
    target[at] += counts["target"].to_numpy()
    p_raw = raw / raw.sum()
    return np.log((target + PRIOR * p_raw) / (target.sum() + PRIOR)) - np.log(p_raw)


def log_weight(ratios: np.ndarray) -> Column:
    """A column function of text: the log importance weight."""
    table = ratios.astype(np.float64)

    def weigh(text: pa.Array) -> pa.Array:
        return pa.array([float(table[gram_bins(t)].sum()) if t else 0.0 for t in text.cast(pa.binary()).to_pylist()], pa.float64())

    weigh.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(weigh, T.DoubleType())


def gumbel(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on id, text and seed only."""
    unit = (F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a finite double column, by counting in ever smaller bins; -inf if there are fewer."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0:
        return math.inf
    if n <= k:
        return -math.inf
    above = 0  # keys over high
    while low < high:
        width = (high - low) / KEY_BINS
        if width == 0 or low + width == low:
            break
        inside = keys.filter(F.col(column).between(low, high))
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(KEY_BINS - 1))
        counts = sorted(inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r.slot)
        for r in counts:
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
    return low


def selection(docs: DataFrame, labels: DataFrame) -> tuple[Column, Column, float]:
    """Columns log_weight and gumbel_key over docs' doc_id and text, and the key from which documents are selected."""
    weight, noise = log_weight(fit(docs, labels))(F.col("text")), gumbel(F.col("doc_id"), F.col("text"))
    keys = stage(docs.select("doc_id", weight.alias("weight"), noise.alias("noise")), "weights")
    held = _bounded_labels(labels).filter("quality = 1 and fold = 1").select("doc_id")
    cutoff = keys.join(F.broadcast(held), "doc_id", "left_semi").agg(F.expr(f"percentile(weight, {CLEAN_LOSS})")).first()[0]
    k = keys.count() if cutoff is None else keys.filter(F.col("weight") >= cutoff).count()
    return weight, weight + noise, kth_largest(keys.select((F.col("weight") + F.col("noise")).alias("key")), "key", k)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected: one row for each document."""
    weight, _, least = selection(docs, labels)
    scored = docs.select("doc_id", weight.alias("log_weight"), gumbel(F.col("doc_id"), F.col("text")).alias("noise"))
    return scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key")).withColumn("selected", F.col("gumbel_key") >= least)


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected rows of docs, with docs' own columns."""
    _, key, least = selection(docs, labels)
    return docs.filter(key >= least)
