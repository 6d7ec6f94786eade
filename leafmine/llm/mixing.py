"""Mixing sources to target weights with hash-threshold histograms.

Tokens are summed by source and hash bucket; running sums find the bucket in which a source's budget
ends, and only that bucket is split further, level by level, until the threshold is one hash value.
Documents under the threshold are taken, so a larger budget keeps all that a smaller one took, no
document is sorted, and the work of a level is one pass over sizes and hashes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmine.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
#: Bits of the 32-bit hash that each level adds.
LEVELS = (11, 11, 10)
REPEATS = 2


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """source, source_size, target: water filling, in one task, as a row for each source is all it reads. The sources (by code point, null last) weigh `weights`,
    repeating, and share `share` of all tokens; a target stops at `repeats` times its source's size, and
    the excess goes to the others by weight. sizes: source, source_size, a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * repeats).cast("double").alias("most"))
    full = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # filled in the order in which they fill up: before a source fills, the level is (budget - filled ones) / weight of the others
    s = s.select("*", (F.sum("source_size").over(full) * F.lit(share)).alias("budget"), F.sum("w").over(full).alias("all_w"), F.coalesce(F.sum("most").over(upto), F.lit(0.0)).alias("filled"), F.coalesce(F.sum("w").over(upto), F.lit(0.0)).alias("filled_w"))
    s = s.withColumn("level", (F.col("budget") - F.col("filled")) / (F.col("all_w") - F.col("filled_w")))
    s = s.withColumn("open", F.col("level") * F.col("w") < F.col("most"))
    # the first open one has the final level, those after it lower ones
    level = F.max(F.when(F.col("open"), F.col("level"))).over(full)
    return s.select("source", "source_size", F.when(F.col("open"), level * F.col("w")).otherwise(F.col("most")).alias("target"))


def thresholds(items: DataFrame, want: DataFrame, scratch: Scratch, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """source, below: documents with a smaller hash are taken. items: source, size, h (32 bits); want: source,
    rest (tokens). The documents below are those whose tokens come nearest to the rest: the one at which they would
    exceed it is taken if that lands nearer than to leave it."""
    left, bits = scratch.write(want.select("source", "rest", F.lit(0).cast("long").alias("below")), "left0"), 32
    for i, more in enumerate(levels, 1):
        # the boundary bucket of the level before holds the hashes that begin as `below` does
        bits -= more
        inside = items.alias("x").join(left.alias("y"), F.expr(f"x.source <=> y.source and h >= below and h < below + {1 << bits + more}"))
        sums = inside.groupBy("x.source", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        run = sums.withColumn("run", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        over = F.col("run") > F.col("rest")
        end = run.groupBy("source").agg(F.min(F.when(over, F.col("bucket"))).alias("bucket"), F.max(F.when(~over, F.col("run"))).alias("used"), F.min(F.when(over, F.col("run"))).alias("next"))
        left = left.alias("y").join(end.alias("e"), F.expr("y.source <=> e.source"), "left")
        used = F.coalesce("used", F.lit(0))
        nearer = (F.col("next") - F.col("rest") < F.col("rest") - used).cast("long") if i == len(levels) else F.lit(0)
        # no bucket is over: the budget takes all
        below = F.coalesce(F.shiftleft("bucket", bits) + nearer, F.col("below") + F.lit(1 << bits + more))
        left = scratch.write(left.select("y.source", (F.col("rest") - used).alias("rest"), below.alias("below")), f"left{i}")
    return left.select("source", "below")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size (words), source_size, target (of the source), times, taken: how often the mix takes
    each row, and the words that makes.

    Every document of a source is taken floor(target / size of the source) times, and those under the hash
    threshold once more, never over `repeats` times. Rows with equal doc_id share a hash and so a fate, as do rows without one.
    Null text: size 0; null source: a source of its own. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    items = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_of(F.col("text")).alias("size"), h.alias("h")), "items")
    want = targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    want = scratch.write(want.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size")), "want")
    below = thresholds(items, want, scratch)
    plan = scratch.write(want.alias("w").join(below.alias("b"), F.expr("w.source <=> b.source")).select("w.source", "source_size", "target", "whole", "below"), "plan")
    scratch.drop("want", *(f"left{i}" for i in range(len(LEVELS) + 1)))
    times = F.col("whole") + ((F.col("h") < F.col("below")) & (F.col("whole") < repeats)).cast("int")
    out = items.alias("x").join(plan.alias("p"), F.expr("x.source <=> p.source"))
    return out.select("doc_id", "x.source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))
