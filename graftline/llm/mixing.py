"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power t, normalised.  t is bisected, four bisection steps
a pass over the source totals, until the weights' entropy meets the target or no source repeats more often than
allowed, whichever asks for the larger t.  The weights become budgets in tokens, and the budgets are realised by block
permutations: documents are dealt to blocks by a hash; every epoch visits a source's blocks in a
permuted order of its own; whole epochs come first, and of the last epoch whole blocks, then, within the block in which the budget
ends, documents in hash order while they fit.  What a document needs to know for this is a row of its
source, so texts are not shuffled and a source that holds most rows stays spread out.

Defined results: tokens are words between white space; null and empty texts have none; a null source
is a source; a source without tokens gets weight 0 and no rows; rows that repeat id and text share their fate;
an empty table gives an empty result; other columns are passed on untouched by realise(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftline.staging import stage

#: Documents of a block, on average.
BLOCK_DOCS = 256
#: A source's block keys are summed in so many ranges (as a power of two) before they are ordered.
RANGE_BITS = 10
#: The target entropy lies so far from the shares' entropy towards that of equal weights.
ENTROPY_SHARE = 0.5
MAX_REPEATS = 4.0
SEED = 3
_SECTIONS = 16


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def doc_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Deals documents to blocks and orders them there."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def _smallest_exponent(totals: DataFrame, fits) -> float:
    """The smallest t in [0, 1] for which fits(log Z, sum w log v, max of (t - 1) log p) holds; v is the weight before Z divides it."""
    low, high = 0.0, 1.0
    for at in range(10):
        points = [low + (high - low) * i / _SECTIONS for i in range(0 if at == 0 else 1, _SECTIONS)]
        aggs = [x for t in points for x in (F.sum(F.exp(F.col("lp") * t)), F.sum(F.exp(F.col("lp") * t) * F.col("lp") * t), F.max(F.col("lp") * (t - 1)))]
        got = totals.agg(*aggs).first()
        fit = [fits(math.log(got[3 * i]), got[3 * i + 1] / got[3 * i], got[3 * i + 2]) for i in range(len(points))]
        first = next((i for i, f in enumerate(fit) if f), None)
        if first == 0 and points[0] == 0:
            return 0.0
        high, low = (high if first is None else points[first]), (points[-1] if first is None else points[first - 1] if first else low)
    return high


def plan(units: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, docs, total, weight, budget, whole (epochs), rest (tokens of the last epoch), blocks.

    units has source and tokens; budget: tokens of the mixture, all tokens if None.
    """
    sums = stage(units.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")).filter("total > 0"), "sources")
    n, every = sums.agg(F.count("*"), F.sum("total")).first()
    every = every or 1
    budget = float(every if budget is None else budget)
    shares = sums.withColumn("lp", F.log(F.col("total") / F.lit(float(every))))
    natural = shares.agg(-F.sum(F.exp("lp") * F.col("lp"))).first()[0] or 0.0
    target = natural + entropy_share * (math.log(max(1, n)) - natural)
    entropy = lambda log_z, mean_log, _: log_z - mean_log <= target + 1e-12
    repeats = lambda log_z, _, most: most - log_z + math.log(max(budget, 1e-9) / every) <= math.log(max_repeats) + 1e-12
    t = max(_smallest_exponent(shares, entropy), _smallest_exponent(shares, repeats)) if n else 1.0
    z = shares.agg(F.sum(F.exp(F.col("lp") * t))).first()[0] or 1.0
    weighed = shares.withColumn("weight", F.exp(F.col("lp") * t) / z).withColumn("budget", F.round(F.col("weight") * budget).cast("long"))
    return weighed.select("source", "docs", "total", "weight", "budget", F.floor(F.col("budget") / F.col("total")).alias("whole"), (F.col("budget") % F.col("total")).alias("rest"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(key, blocks)


def _block_key(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(source, block, epoch, F.lit(seed))


def cuts(units: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """sources with block_cut and doc_cut: the last epoch takes blocks before block_cut, and of that block documents up to doc_cut."""
    own = units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", _block(F.col("key"), F.col("blocks"))).withColumn("block_key", _block_key(F.col("source"), F.col("block"), F.col("whole"), seed))
    blocks = own.groupBy("source", "block_key").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    # first the range of block keys in which the budget ends, then the block: no window holds all blocks of a source
    part = F.shiftright("block_key", 64 - RANGE_BITS)
    before = lambda order: F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))
    ranges = blocks.groupBy("source", part.alias("part")).agg(F.sum("sum").alias("sum"), F.first("rest").alias("rest")).withColumn("before", before("part")).filter(ends).select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("before").alias("base"))
    near = blocks.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p")))
    last = near.withColumn("before", F.col("base") + before("block_key")).filter(ends).select(F.col("source").alias("s"), F.col("block_key").alias("block_cut"), (F.col("rest") - F.col("before")).alias("room"))
    inside = own.select("source", "block_key", "key", "tokens").join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block_key") == F.col("block_cut")))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    doc_cuts = inside.withColumn("upto", upto).filter("upto <= room").groupBy("source").agg(F.max("key").alias("doc_cut")).withColumnRenamed("source", "s")
    full = sources.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "room")
    return full.join(doc_cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def free_name(columns: Sequence[str], name: str) -> str:
    """name, with as many underscores behind it as make it differ from all columns, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def realise(docs: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """Rows of docs as often as the mixture has them, with a struct column mix (free_name of it, where docs has one).

    mix: tokens, weight, epoch (0 for a document's first copy), block, and place, by which the
    mixture is in order: sources advance through their epochs side by side.
    """
    row, source = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source")
    keyed = docs.select(row, source, tokens(F.col("text")).alias("tokens"), doc_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    units = stage(keyed.select("source", "tokens", "key"), "units")
    sources = stage(plan(units, **targets), "plan")
    limits = stage(cuts(units, sources, seed), "cuts").select(F.struct("*").alias("cut"))
    c = lambda name: F.col(f"cut.{name}")
    met = keyed.join(limits, source.eqNullSafe(c("source")))
    key, block = F.col("key"), _block(F.col("key"), c("blocks"))
    last_key = _block_key(c("source"), block, c("whole"), seed)
    in_last = F.coalesce((last_key < c("block_cut")) | ((last_key == c("block_cut")) & F.coalesce(key <= c("doc_cut"), F.lit(False))), F.lit(False))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    shown = met.withColumns({"block": block, "copies": c("whole") + in_last.cast("long")}).filter("copies > 0").select("row", "tokens", "block", "cut", epochs.alias("epoch"))
    spread = F.col("epoch") + (_block_key(c("source"), F.col("block"), F.col("epoch"), seed).cast("double") / 2.0**64 + 0.5)
    place = spread * c("total") / F.greatest(c("budget"), F.lit(1))
    mix = F.struct("tokens", c("weight").alias("weight"), "epoch", "block", place.alias("place")).alias(free_name(docs.columns, "mix"))
    return shown.select("row.*", mix)
