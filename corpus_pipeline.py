"""Corpus pipeline: classify, dedup, decontaminate, mix, tokenize. Each stage reads what the one before it wrote."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmine.llm import decontaminate, jaccard_join, mixing, quality, token_output
from leafmine.llm.keys import KEY, with_keys
from leafmine.llm.queries import tokenizer_path
from leafmine.llm.scratch import Scratch

#: SQL has no words for a learned classifier; tests hold the stages against brute force.
ORACLE_SQL = None


# What the stages decide grows with the documents, so it is joined by sorting at every size and never sent to all tasks.


# Rows travel in one column, so no name of theirs clashes with the stages' own. Each stage keeps nulls, empty texts and repeated
# rows as its docstring says, and makes an empty table of an empty one.


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, rows that repeat as often as they stand there. Null text is
    scored as empty text. The model learns from the labels in sf_dir."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, model, name).filter(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links of the Jaccard join, the one with the smallest doc_id (null the lowest); of
    rows that share it the one with the smallest key. Texts without words, null ones too, link with nothing: all their rows stay."""
    scratch = Scratch(spark, "one")
    groups = scratch.write(jaccard_join.near_groups(docs).select(*KEY, "label"), "groups")
    rows = groups.groupBy("label", *KEY).agg(F.count("*").alias("n"))
    first = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(*KEY, "n")).alias("x")).select("x.*")
    keep = scratch.write(first.union(rows.filter("label is null").select(*KEY, F.lit(0).cast("long"))), "keep")
    kept = with_keys(docs).hint("merge").join(keep, KEY)
    if keep.filter("n > 1").limit(1).count():
        kept = kept.filter("n <= 1").union(kept.filter("n > 1").dropDuplicates(KEY))
    return kept.select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark in sf_dir; null and empty texts hold none."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*KEY).distinct()
    found = Scratch(spark, "held").write(found, "held")
    return with_keys(docs).hint("merge").join(found, KEY, "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Rows that share doc_id and source are taken equally often;
    null is a source of its own."""
    times = mixing.mix(docs).filter("times > 0").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k0"), F.col("source").alias("of"), "times")
    times = Scratch(spark, "times").write(times.groupBy("k0", "of").agg(F.max("times").alias("times")), "times")
    rows = with_keys(docs).select(F.col("k0").alias("own"), "row").hint("merge")
    taken = rows.join(times, (F.col("own") == F.col("k0")) & F.col("row.source").eqNullSafe(F.col("of")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of each document."""
    path = f"{Scratch(spark, 'tokens').root}/files"
    token_output.write(docs, path, tokenizer_path("word_bpe_49k.json"))
    return token_output.read(spark.read.schema(token_output.SEGMENT).parquet(path))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID output", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
