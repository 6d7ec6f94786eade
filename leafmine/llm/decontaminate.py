"""Benchmark decontamination with DataFrame functions only.

Windows of a document that are as long as an item (in words) get SimHash fingerprints over their words, one size after
another, from running sums. The items' fingerprints stand in a multi-index: RADIUS + 1 blocks, of which one at
least is equal if no more than RADIUS bits differ, so the lookup of a window's blocks among all items of its size
finds every item within the radius. Only windows that hold a shingle of some item, whichever, are laid: the
similarity of any other window to any item is 0. A long item stands in the index by its parts, of which one
at least is as similar as the whole, and is found by any of them.

Of a document and an item that the index brings together, every place that lines up a shingle of both is compared
exactly, by the weighted Jaccard similarity of the shingle multisets; a shingle weighs the more, the fewer items have it.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmine.llm.keys import KEY, keyed
from leafmine.llm.scratch import Scratch

WORDS, PERCENT = 5, 75
#: Fingerprints: GROUPS running sums with LANES counters of WIDTH bits each.
GROUPS, LANES, WIDTH = 11, 5, 11
#: Bits of 55 in which fingerprints may differ: 21 blocks, 13 of 3 bits and 8 of 2.
RADIUS = 20
WIDE = 13
#: Most words of an item's part, and of the stretch of a document whose windows are laid at once; both keep a counter within its bits.
PART, STRETCH = 256, 128
#: The items' shingles are sent to all tasks if their hashes, 8 bytes each, take no more than so many bytes; beyond, positions are shuffled to them.
BROADCAST_BYTES = 32 << 20
_ONES = sum(1 << WIDTH * j for j in range(LANES))
_HALF = 1 << WIDTH - 1


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the lower-cased text; none: an empty array."""
    white = " \t\n\x0b\x0c\r"
    bare = F.btrim(F.lower(text), F.lit(white))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _counters(h: Column) -> list[Column]:
    """The bits of a word's hash, spread over the counters of the running sums."""
    return [F.shiftrightunsigned(h, g).bitwiseAND(F.lit(_ONES)) for g in range(GROUPS)]


def _fingerprint(sums: list[Column], n: Column) -> Column:
    """A bit for each counter: set in more than half of n words. Half of a counter's range, less n, is added to all counters
    at once, so the answer is their highest bit."""
    bias = F.lit(_HALF * _ONES) - (n + 1) * F.lit(_ONES)
    bits = [F.shiftleft(F.shiftrightunsigned(s * 2 + bias, WIDTH - 1).bitwiseAND(F.lit(_ONES)), g) for g, s in enumerate(sums)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _keyed_blocks(rows: DataFrame, p: str) -> DataFrame:
    """rows, once for each block of the fingerprint, with key: what the block holds, and its number."""
    at, mask = f"if(b < {WIDE}, 3 * b, 2 * b + {WIDE})", f"if(b < {WIDE}, 7, 3)"
    return rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(RADIUS)))).withColumn("key", F.expr(f"cast(shiftright({p}, {at}) & {mask} as int) + 8 * b")).drop("b")


def _index(items: DataFrame) -> DataFrame:
    """size, key, q, item: the blocks of the fingerprints of all items' parts. items: item, w."""
    n = F.size("w")
    count = F.ceil(n / PART).cast("int")
    part = items.select("item", "w", n.alias("n"), count.alias("of"), F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    lo, hi = (F.floor(F.col("n") * (F.col("part") + x) / F.col("of")).cast("int") for x in (0, 1))
    part = part.select("item", "part", F.explode(F.slice("w", lo + 1, hi - lo)).alias("word")).withColumn("h", F.xxhash64("word"))
    sums = part.groupBy("item", "part").agg(F.count("*").cast("int").alias("size"), *[F.sum(c).alias(f"s{g}") for g, c in enumerate(_counters(F.col("h")))])
    prints = sums.select("item", "size", _fingerprint([F.col(f"s{g}") for g in range(GROUPS)], F.col("size")).alias("q"))
    return _keyed_blocks(prints, "q")


def _hits(docs: DataFrame, seeds: DataFrame, small: bool, k: int) -> DataFrame:
    """keys, w, i, seed: the positions of each document where a shingle of some item begins."""
    d = docs.select(*KEY, words(F.col("text")).alias("w")).filter(F.size("w") >= k)
    at = d.select(*KEY, "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
    at = at.select(*KEY, "w", "i", F.xxhash64(F.concat_ws(" ", *[F.col("w")[F.col("i") + j] for j in range(k)])).alias("seed"))
    if small:
        return at.join(F.broadcast(seeds), "seed")
    return d.join(at.drop("w").join(seeds, "seed").distinct(), KEY)


def _lookup(stretches: DataFrame, index: DataFrame, sizes: list[int], k: int, scratch: Scratch) -> DataFrame:
    """keys, item: documents and items of which a window and a part lie within the radius."""
    h = F.xxhash64("word")
    by = [*KEY, "c"]
    upto = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # dealt out by number, as the work follows the windows of a stretch and not its bytes
    dealt = stretches.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), *by)
    rows = dealt.select(*by, "lo", "low", "high", F.posexplode("ws").alias("pos", "word")).withColumns({f"s{g}": c for g, c in enumerate(_counters(h))})
    rows = rows.select(*by, "lo", "low", "high", F.struct("pos", *[F.sum(f"s{g}").over(upto).alias(f"s{g}") for g in range(GROUPS)]).alias("r"))
    zero = F.array(F.struct(F.lit(-1).alias("pos"), *[F.lit(0).cast("long").alias(f"s{g}") for g in range(GROUPS)]))
    sums = rows.groupBy(*by, "lo", "low", "high").agg(F.concat(zero, F.array_sort(F.collect_list("r"))).alias("r"))
    sums = scratch.write(sums, "sums")  # or the arrays are made again for each window
    # every start whose window reaches a shingle of some item
    x = sums.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    x = x.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("low") - F.col("size") + k), F.col("high"))))
    start, end = F.col("s") - F.col("lo"), F.least(F.col("s") - F.col("lo") + F.col("size"), F.size("r") - 1)
    # both sums are taken once, apart from what is made of them: the code that Spark makes must stay small enough to be compiled
    x = x.select(*KEY, "size", F.explode(F.array(F.struct(F.col("r")[start].alias("a"), F.col("r")[end].alias("b"), (end - start).alias("n")))).alias("x"))
    inside = [F.col(f"x.b.s{g}") - F.col(f"x.a.s{g}") for g in range(GROUPS)]
    windows = x.select(*KEY, "size", _fingerprint(inside, F.col("x.n")).alias("p"))
    found = _keyed_blocks(windows, "p").join(index, ["size", "key"])
    return found.filter(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= RADIUS).select(*KEY, "item").distinct()


def leaks(docs: DataFrame, items: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, k0, k1, k2 (see keys), item_id, start (word), n_words, similarity: the best window of each document for each item it holds.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A window holds an item if their
    similarity is percent / 100 or more; of equally similar ones the first counts. Null or empty texts
    hold nothing, items of fewer than k words are held by nothing. Rows that agree in doc_id and
    text are one document, items that agree in item_id are separate texts of one item. Neither documents nor items
    are bounded in length. Shingles are compared by hashes of 64 bits.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    i = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") >= k).distinct()
    i = scratch.write(i.select(F.monotonically_increasing_id().alias("item"), "item_id", "w"), "items")
    n_items = i.count()
    gram = F.xxhash64(F.concat_ws(" ", *[F.col("w")[F.col("at") + j] for j in range(k)]))
    grams = i.select("item", F.size("w").alias("length"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("at"))
    grams = scratch.write(grams.select("item", "length", "at", gram.alias("seed")), "grams")
    # whole-number weights, so that sums don't depend on their order
    weigh = lambda n: F.round(1000 * F.log(1 + F.lit(n_items) / n)).cast("long")
    of_item = grams.groupBy("item", "seed").agg(F.count("*").alias("ci"))
    weights = scratch.write(of_item.groupBy("seed").agg(weigh(F.count("*")).alias("weight")), "weights")
    of_item = scratch.write(of_item.join(weights, "seed"), "of_item")
    index = scratch.write(_index(i), "index")
    sizes = [r["size"] for r in index.select("size").distinct().collect()]  # PART numbers at most
    if not sizes:
        sizes = [k]
    # stretches of documents around hits, with as many words on both sides as a window can reach
    hits = _hits(keyed(docs), weights.select("seed"), weights.count() * 8 <= BROADCAST_BYTES, k)
    c = F.floor(F.col("i") / STRETCH).cast("int")
    lo = F.greatest(c * STRETCH - max(sizes), F.lit(0))
    stretch = F.slice("w", lo + 1, c * STRETCH + STRETCH + max(sizes) - lo)
    hits = hits.select(*KEY, c.alias("c"), F.size("w").alias("n"), lo.alias("lo"), stretch.alias("ws"), F.struct("i", "seed").alias("hit"))
    stretches = hits.groupBy(*KEY, "c").agg(F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("ws").alias("ws"), F.collect_set("hit").alias("hits"))
    at = F.transform("hits", lambda x: x["i"])
    stretches = scratch.write(stretches.withColumns({"low": F.array_min(at), "high": F.array_max(at)}), "stretches")
    found = scratch.write(_lookup(stretches, index, sizes, k, scratch), "found")
    # exact: the places where a shingle of the document lines up with one of the item, each with the weights of what it covers
    hits = scratch.write(stretches.select(*KEY, "n", F.explode("hits").alias("hit")).select(*KEY, "n", "hit.i", "hit.seed").join(weights, "seed"), "hits")
    place = [*KEY, "item", "start"]
    lined = hits.join(grams, "seed").join(found, [*KEY, "item"])
    lined = lined.select(*KEY, "item", "n", "length", F.greatest(F.col("i") - F.col("at"), F.lit(0)).alias("start")).distinct()
    lined = scratch.write(lined.withColumn("grams", F.least(F.col("length"), F.col("n") - F.col("start")) - k + 1).filter("grams > 0"), "lined")
    covers = lined.select(*place, "grams", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("grams") - 1)).alias("i"))
    own = covers.join(hits.select(*KEY, "i", "seed", "weight"), [*KEY, "i"]).groupBy(*place, "grams", "seed", "weight").agg(F.count("*").alias("cw"))
    own = own.join(of_item.select("item", "seed", "ci"), ["item", "seed"], "left")
    known, both = F.sum("cw"), F.sum(F.least("cw", F.coalesce("ci", F.lit(0))) * F.col("weight"))
    same = own.groupBy(*place, "grams").agg(known.alias("known"), F.sum(F.col("cw") * F.col("weight")).alias("weighed"), both.alias("both"))
    # a shingle that no item has weighs as much as one that a single item has
    total = F.col("weighed") + (F.col("grams") - F.col("known")) * weigh(F.lit(1))
    sums = of_item.groupBy("item").agg(F.sum(F.col("ci") * F.col("weight")).alias("ti"))
    same = same.join(sums, "item").withColumn("either", total + F.col("ti") - F.col("both"))
    held = same.filter(F.col("both") * 100 >= F.col("either") * percent).join(i.select("item", "item_id", F.size("w").alias("n_words")), "item")
    best = F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("start")).alias("back"), (-F.col("n_words")).alias("n"))).alias("x")
    out = held.groupBy(*KEY, "item_id").agg(best)
    as_id = F.when(F.col("k0") != -(1 << 63), F.col("k0"))
    return out.select(as_id.alias("doc_id"), *KEY, "item_id", (-F.col("x.back")).cast("int").alias("start"), (-F.col("x.n")).cast("int").alias("n_words"), F.col("x.similarity").alias("similarity"))
