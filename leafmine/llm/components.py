"""Connected components of links by smallest labels and pointer jumping, as joins and grouped minima."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the smallest node of its component) of all nodes of links (a long, b long)."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    both = scratch.write(both, f"{name}-links")
    label = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        near = label.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        near = scratch.write(near, f"{name}-{step}a")
        jump = near.join(near.select(F.col("node").alias("up"), F.col("label").alias("top")), F.col("label") == F.col("up"))
        new = scratch.write(jump.select("node", F.least("label", "top").alias("label"), "was"), f"{name}-{step}b")
        moved = new.filter("label <> was").limit(1).count()
        label = new.select("node", "label")
        scratch.drop(f"{name}-{step}a", f"{name}-0" if step == 1 else f"{name}-{step - 1}b")
        if not moved:
            scratch.drop(f"{name}-links")
            return label
