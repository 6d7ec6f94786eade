"""Chat formatting as a prefix tree.

A turn together with all turns before it is a place in the tree, so conversations that share initial
turns share places. A node is a run of places that the same conversations pass: the tree branches only
between nodes, and long unshared stretches are one node. Each node is emitted once, in depth-first order,
as a piece of one long packed stream. Its position ids run on from its parent's (as if the conversation
stood alone); its tokens may attend to the stream intervals of its ancestors and, causally, to itself.
Tokens are code points here; a tokenizer's pieces can take their place.
"""

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.llm.scratch import Scratch

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """A text in which no control string stands: a backslash splits each, and backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the part of it that is under the loss mask (only an assistant's text)."""
    head = OPEN + escape(role) + MIDDLE
    body = escape(text)
    loss = len(head) + len(body) if role == LOSS_ROLE else len(head)
    return head + body + CLOSE, len(head), loss


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = piece.removeprefix(OPEN).removesuffix(CLOSE).partition(MIDDLE)
    return unescape(role), unescape(text)


def _steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for conv, turns in zip(frame["conv_id"], frame["turns"], strict=True):
            path, at = hashlib.sha256(), 0
            for i, t in enumerate(turns):
                piece, lo, hi = turn(t["role"], t["text"])
                path.update(len(piece).to_bytes(8, "little") + piece.encode("utf-8", "surrogatepass"))
                out.append((conv, i, path.hexdigest(), piece, lo, hi, at))
                at += len(piece)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "place", "piece", "loss_from", "loss_to", "position"])


def _nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of a conversation's steps that equally many (and so the same) conversations pass."""
    for frame in frames:
        out = []
        for conv, steps in zip(frame["conv_id"], frame["steps"], strict=True):
            path, runs, last = [], [], None
            for s in steps:
                if s["passing"] != last:
                    last = s["passing"]
                    path.append(s["place"])
                    runs.append([])
                runs[-1].append({c: s[c] for c in ("position", "piece", "loss_from", "loss_to")})
            for i, run in enumerate(runs):
                out.append((conv, path[i], path[: i + 1], run, sum(len(p["piece"]) for p in run), run[0]["position"], i + 1 == len(runs)))
        yield pd.DataFrame(out, columns=["conv_id", "node", "path", "pieces", "n", "position", "leaf"])


_PIECES = "array<struct<position: long, piece: string, loss_from: long, loss_to: long>>"


def tree(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The packed nodes and the last node of each conversation.

    nodes: node, path (ids of its ancestors and itself), pieces (formatted turns with position and loss mask),
    n, position (of its first token), start (in the stream), attend (the intervals [from, to) of its
    ancestors). leaves: conv_id, node. Columns conv_id, turn, role and text are read; null role or text is
    empty, null conv_id one conversation; equal turn numbers go by role, then text. No turns: no rows.
    """
    turns = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    steps = scratch.write(talks.mapInPandas(_steps, "conv_id long, turn int, place string, piece string, loss_from long, loss_to long, position long"), "steps")
    passing = scratch.write(steps.groupBy("place").agg(F.count("*").alias("passing")), "passing")
    whole = steps.join(passing, "place").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "place", "passing", "position", "piece", "loss_from", "loss_to"))).alias("steps"))
    runs = scratch.write(whole.mapInPandas(_nodes, f"conv_id long, node string, path array<string>, pieces {_PIECES}, n long, position long, leaf boolean"), "runs")
    leaves = runs.filter("leaf").select("conv_id", "node")
    # equal nodes have equal rows, so any one stands for all; they are combined before the shuffle
    parts = max(1, min(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 2000))
    nodes = scratch.write(runs.select("node", "path", "pieces", "n", "position").dropDuplicates(["node"]), "distinct")
    # depth first is the order of paths; the parts follow each other in it
    ordered = nodes.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    ordered = scratch.write(ordered, "ordered")
    before = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number for each part
    starts, at = [], 0
    for part in sorted(before):
        starts.append((part, at))
        at += before[part]
    starts = scratch.spark.createDataFrame(starts, "part int, base long")
    inside = ordered.select("node", "part", "row", "n").repartition("part").sortWithinPartitions("part", "row").mapInPandas(_running, "node string, part int, inside long")
    place = scratch.write(inside.join(F.broadcast(starts), "part").select("node", (F.col("base") + F.col("inside")).alias("start")), "place")
    spans = scratch.write(place.join(ordered.select("node", "n"), "node").select(F.col("node").alias("up"), F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to")).alias("span")), "spans")
    ups = scratch.write(ordered.select("node", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("up")), "ups")
    attend = ups.join(spans, "up").groupBy("node").agg(F.array_sort(F.collect_list("span")).alias("attend"))
    packed = ordered.drop("part", "row").join(place, "node").join(attend, "node", "left")
    packed = scratch.write(packed.withColumn("attend", F.coalesce("attend", F.array().cast("array<struct<from:bigint,to:bigint>>"))), "packed")
    scratch.drop("steps", "passing", "distinct", "ordered", "place", "spans", "ups")
    return packed, leaves


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = None, 0
    for frame in frames:
        sums = frame.groupby("part")["n"].cumsum() - frame["n"]
        if len(frame) and frame["part"].iloc[0] == part:
            sums = sums.where(frame["part"] != part, sums + at)
        if len(frame):
            last = frame["part"].iloc[-1]
            at = int(sums.iloc[-1] + frame["n"].iloc[-1])
            part = last
        yield pd.DataFrame({"node": frame["node"], "part": frame["part"], "inside": sums})


def read_back(packed: DataFrame, leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pieces: array<struct<position, piece, loss_from, loss_to>> of every conversation, in order.

    Each last node is rebuilt once, however many conversations end in it.
    """
    ends = scratch.write(leaves.select("node").distinct().join(packed.select("node", "path"), "node").select(F.col("node").alias("end"), F.posexplode("path").alias("depth", "node")), "ends")
    full = ends.join(packed.select("node", "pieces"), "node").groupBy("end").agg(F.array_sort(F.collect_list(F.struct("depth", "pieces"))).alias("nodes"))
    full = scratch.write(full.select("end", F.flatten(F.transform("nodes", lambda x: x["pieces"])).alias("pieces")), "full")
    return leaves.join(full, leaves["node"] == full["end"]).select("conv_id", "pieces")


def digests(talks: DataFrame) -> DataFrame:
    """What the output says of each conversation of read_back()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, pieces in zip(frame["conv_id"], frame["pieces"], strict=True):
                said, loss, n, at = hashlib.sha256(), [], 0, 0
                for p in pieces:
                    if p["position"] != at:
                        raise ValueError(f"conversation {conv}: a piece begins at {p['position']}, not at {at}")
                    role, text = parse(p["piece"])
                    said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    loss.append(unescape(p["piece"][p["loss_from"] : p["loss_to"]]))
                    at += len(p["piece"])
                    n += 1
                under = "".join(loss)
                out.append((conv, n, said.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), at))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return talks.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
