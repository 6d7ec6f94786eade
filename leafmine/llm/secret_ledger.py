"""Secret scans with a ledger of blobs.

Every historical version of a path is content-addressed. The ledger has a row for each pair of blob
and rule version that was scanned; a run scans only pairs that it lacks, each once however many paths
hold the blob, and joins findings back to all paths.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base kinds with their patterns, in the order of the contract.
RULES = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"
FINDINGS = "array<struct<kind: string, start: int, end: int>>"


def _patterns() -> list[tuple[str, re.Pattern, int]]:
    # A run of one class that is too short stays too short from any later start in it, so the least
    # length can stand in the pattern; a short assignment is consumed, hence the test afterwards.
    return [
        ("assign", re.compile(RULES["assign"], re.ASCII), 6),
        ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), 0),
        ("hex", re.compile(r"[0-9a-f]{24,}"), 0),
        ("pem", re.compile(RULES["pem"]), 0),
    ]


def find(text: str, patterns: list) -> list[dict]:
    """The spans of a text by start, then kind in the order of RULES."""
    out = []
    for rank, (kind, pattern, least) in enumerate(patterns):
        for m in pattern.finditer(text):
            if not least or len(m[2]) >= least:
                out.append((m.start(), rank, kind, m.end()))
    return [{"kind": kind, "start": s, "end": e} for s, _, kind, e in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = _patterns()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("blob")), pa.array([find(x, patterns) for x in texts], kind)], ["blob", "findings"])


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob (sha256 of the UTF-8 bytes; null text counts as empty), text."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("text"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule_version string, findings {FINDINGS}")


def scan_unseen(found: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """New rows of the ledger: each blob of versions() that it lacks under this rule version, scanned once."""
    unseen = found.select("blob", "text").join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    once = unseen.dropDuplicates(["blob"]).select("blob", "text")
    return once.mapInArrow(_scan, f"blob string, findings {FINDINGS}").select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def by_path(found: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, blob, findings for every row of versions(), rows with equal blobs alike. Blobs that the ledger lacks: null findings."""
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "findings")
    return found.select("path", "blob").join(known, "blob", "left").select("path", "blob", "findings")
