"""A Merkle manifest of a dataset with a proof for each row.

Rows are ranked in their group, ranks are written in base 3 and cut into blocks of DIGITS digits. Inside a block the digits are
grouped away one after another: each step turns up to three nodes into one whose struct holds them. A block is one
row of bounded size, and all its steps run behind a single shuffle. Heads of blocks are the ranked nodes of the next
round, up to one node for each group; the groups' nodes are then rolled up the same way. Proofs come down again round by round: a
block and the proof of its head meet in a grouping, and one explode of its nested structs gives those of its members.
"""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmine.llm.scratch import Scratch

#: Digits of a rank inside a block: 3 ** 6 = 729 members at most.
DIGITS = 6


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of what the parts concatenate to."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def leaves(docs: DataFrame) -> DataFrame:
    """group (`0` for a null source, else `1` and the source), doc_id, hash, other (the leaf of the tampered row, null where
    that is the leaf itself)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.col("text").contains("\n")
    other = F.when(touched, leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    return docs.select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("group"), "doc_id", leaf(F.col("text")).alias("hash"), other.alias("other"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each group in a sorted part, from 0."""
    group, n = None, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        start, numbers = 0, []
        for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            n = n if value == group else 0
            numbers += range(n, n + end - start)
            group, n, start = value, n + end - start, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "rank"])


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with rank: the number of each in its `group` by `order` (nulls first), from 0.

    Rows are range-partitioned by group and order, so a large group lies in many parts; equal rows are dealt by a number
    of their own. Only where a part begins inside a group does it need a number from the parts before: one row a part
    goes to the driver.
    """
    spark = scratch.spark
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["group", *order, "copy"]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*key)
    dealt = dealt.select("group", *[c for c in rows.columns if c != "group"], "part")
    kinds = dealt.withColumn("rank", F.lit(0).cast("long")).schema
    dealt = scratch.write(dealt.mapInArrow(_numbered, kinds), name)
    ends = dealt.groupBy("part", "group").count().groupBy("part").agg(F.min("group").alias("first"), F.max("group").alias("last"), F.min_by("count", "group").alias("n_first"), F.max_by("count", "group").alias("n_last"))
    begins, before = [], (None, 0)
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        carried = before[1] if before[0] == r["first"] else 0
        if carried:
            begins.append((r["part"], r["first"], carried))
        before = (r["last"], r["n_last"] + (carried if r["first"] == r["last"] else 0))
    begins = spark.createDataFrame(begins, "at_part int, at_group string, carried long")
    found = dealt.join(F.broadcast(begins), (F.col("part") == F.col("at_part")) & (F.col("group") == F.col("at_group")), "left")
    return found.select(*rows.columns, (F.col("rank") + F.coalesce("carried", F.lit(0))).alias("rank"))


def _rolled(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """group, block, height, head, node: the members of each block of ranked nodes in one nested struct.

    A group of one block stops where one node remains, `height` levels up, and `head` is that node's hash; the
    structs above it hold one child each and don't count. In all other blocks every level counts.
    """
    size = 3**DIGITS
    left = [f"d{i}" for i in range(DIGITS)]
    digits = [F.expr(f"cast(rank % {size} div {3**i} % 3 as int)").alias(d) for i, d in enumerate(left)]
    place = (F.col("rank") % size).alias("place")
    rows = nodes.select("group", F.expr(f"rank div {size}").alias("block"), place.alias("last"), *digits, F.struct("hash", place, *payload).alias("node")).repartition("group", "block")
    for _ in digits:
        gone, left = left[0], left[1:]
        kids = F.transform(F.sort_array(F.collect_list(F.struct(gone, "node"))), lambda p: p["node"])
        rows = rows.groupBy("group", "block", *left).agg(F.max("last").alias("last"), kids.alias("kids"))
        rows = rows.select("group", "block", *left, "last", F.struct(F.sha2(F.array_join(F.transform("kids", lambda k: k["hash"]), ""), 256).alias("hash"), "kids").alias("node"))
    height = F.when(F.col("block") > 0, F.lit(DIGITS)).otherwise(sum(((F.col("last") >= 3**i).cast("int") for i in range(DIGITS)), F.lit(0)))
    rows = rows.withColumn("height", height)
    head, at = F.col("node")["hash"], F.col("node")
    for level in range(DIGITS - 1, -1, -1):
        at = at["kids"][0]
        head = F.when(F.col("height") == level, at["hash"]).otherwise(head)
    return rows.select("group", "block", "height", head.alias("head"), "node")


def _rounds(nodes: DataFrame, payload: list[str], scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables of blocks, each over the heads of the one before, until every group is one block."""
    tables = []
    while True:
        tables.append(scratch.write(_rolled(nodes, [] if tables else payload), f"{name}-{len(tables)}"))
        if not tables[-1].filter("block > 0").limit(1).count():
            return tables
        nodes = tables[-1].select("group", F.col("block").alias("rank"), F.col("head").alias("hash"))


def _members(node: Column, level: int, height: Column, fields: list[str]) -> Column:
    """The leaves under a node that stands `level` levels above them, each with its path: the hashes before and after its own
    ancestor in each run, from the bottom."""
    kids = node["kids"]
    text = lambda some: F.array_join(F.transform(some, lambda k: k["hash"]), "")

    def of(kid: Column, i: Column) -> Column:
        step = F.array(F.struct(text(F.slice(kids, F.lit(1), i)).alias("before"), text(F.slice(kids, i + 2, F.lit(2))).alias("after")))
        step = F.when(F.lit(level) <= height, step).otherwise(F.slice(step, 1, 0))
        if level == 1:
            return F.array(F.struct(*[kid[f].alias(f) for f in fields], step.alias("path")))
        return F.transform(_members(kid, level - 1, height, fields), lambda m: F.struct(*[m[f].alias(f) for f in fields], F.concat(m["path"], step).alias("path")))

    return F.flatten(F.transform(kids, of))


def _down(blocks: DataFrame, up: DataFrame, fields: list[str]) -> DataFrame:
    """What `up` (group, block, above: the path and roots of each block's head) says of the members: group, rank, fields, above."""
    both = blocks.select("group", "block", F.struct("height", "node").alias("own")).unionByName(up, allowMissingColumns=True)
    met = both.groupBy("group", "block").agg(F.first("own", ignorenulls=True).alias("own"), F.first("above", ignorenulls=True).alias("above"))
    members = _members(F.col("own.node"), DIGITS, F.col("own.height"), ["hash", "place", *fields])
    rows = met.select("group", "block", "above", F.explode(members).alias("m"))
    path = F.struct(F.concat("m.path", "above.path").alias("path"), "above.subroot", "above.root")
    return rows.select("group", (F.col("block") * 3**DIGITS + F.col("m.place")).alias("rank"), "m.hash", *[f"m.{f}" for f in fields], path.alias("above"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (sha256 of all siblings, from the bottom), folded_root (from the tampered row's leaf and
    the original siblings), verified; a row for each row of docs.

    Nulls count as `-`, empty texts as `0:`. In a source rows stand by doc_id, null first, of equal ids by leaf; equal rows keep their number. A
    null source is a group of its own and the first. An empty table has no rows and no root. Columns that the leaf
    doesn't name are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = scratch.write(leaves(docs), "leaves")
    low = _rounds(ranked(rows, ["doc_id", "hash"], scratch, "ranked"), ["doc_id", "other"], scratch, "rows")
    groups = low[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), F.col("head").alias("hash"))
    high = _rounds(ranked(groups, ["of"], scratch, "groups"), ["of"], scratch, "roots")
    nothing = F.slice(F.array(F.struct(F.lit("").alias("before"), F.lit("").alias("after"))), 1, 0)
    up = high[-1].select("group", "block", F.struct(nothing.alias("path"), F.col("head").alias("subroot"), F.col("head").alias("root")).alias("above"))
    for i in range(len(high) - 1, -1, -1):
        rows = _down(high[i], up, [] if i else ["of"])
        if i:
            up = rows.select("group", F.col("rank").alias("block"), "above")
        else:
            own = F.struct("above.path", F.col("hash").alias("subroot"), "above.root")
            up = rows.select(F.col("of").alias("group"), F.lit(0).cast("long").alias("block"), own.alias("above"))
        up = scratch.write(up, f"up-{i}")
    for i in range(len(low) - 1, -1, -1):
        rows = _down(low[i], up, [] if i else ["doc_id", "other"])
        if i:
            up = scratch.write(rows.select("group", F.col("rank").alias("block"), "above"), f"down-{i}")
    siblings = F.array_join(F.transform("above.path", lambda e: F.concat(e["before"], e["after"])), "")
    folded = F.aggregate("above.path", F.coalesce("other", "hash"), lambda acc, e: F.sha2(F.concat(e["before"], acc, e["after"]), 256))
    rows = rows.select("doc_id", F.col("hash").alias("leaf"), "above.subroot", "above.root", F.sha2(siblings, 256).alias("proof"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
