"""Inputs: files of tender folders, text pages, folder listings (SRC1 to SRC5)."""

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from leafmine import rules as R
from leafmine.functions import columns as C
from leafmine.scratch import Scratch


def _hidden(name: Column, rules: R.RuleSet) -> Column:
    return F.lit(False) if not rules.hidden else reduce(Column.__or__, [name.startswith(p) for p in rules.hidden])


def readable(paths: DataFrame, root_name: str, rules: R.RuleSet | None = None) -> DataFrame:
    """SRC1, the choice of files: paths (rel_path and any other columns) that are readable, with tender, file and suffix."""
    rules = rules or R.RuleSet()
    parts = F.split("rel_path", "/")
    file = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    suffix = F.lower(F.regexp_extract(file, r"(\.[^.]*)$", 1))
    out = F.exists(folders, lambda p: F.upper(C.strip(p)).isin(*[x.upper() for x in rules.excluded]))
    hidden = _hidden(file, rules) | file.startswith("_conv")
    tender = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit(root_name))
    x = paths.withColumns({"tender": tender, "file": file, "suffix": suffix})
    return x.filter(suffix.isin(*rules.suffixes) & ~out & ~hidden)


LISTED = "tender string, rel_path string, file string, suffix string, length long, mtime timestamp, path string"


class FolderTree(DataSource):
    """All files below a folder: rel_path, length, mtime, path. Only the folder itself is listed on the driver; its
    subfolders are dealt to at most `tasks` (64) tasks, each of which walks its own.

    path: a folder in any file system that pyarrow.fs opens by its address."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "rel_path string, length long, mtime timestamp, path string"

    def reader(self, schema: StructType) -> "DataSourceReader":
        return _TreeReader(self.options["path"], int(self.options.get("tasks", 64)))


@dataclass
class _Part(InputPartition):
    folders: list[str]
    files: bool  # of the root itself


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.root)
        folders = sorted(i.path for i in fs.get_file_info(pa_fs.FileSelector(root)) if i.type == pa_fs.FileType.Directory)
        return [_Part([], True), *[_Part(folders[i :: self.tasks], False) for i in range(min(self.tasks, len(folders)))]]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.root)
        for folder in partition.folders or [root] * partition.files:
            found = [i for i in fs.get_file_info(pa_fs.FileSelector(folder, recursive=not partition.files)) if i.is_file]
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i.path[len(root) :].lstrip("/") for i in some], pa.string()), pa.array([i.size for i in some], pa.int64()),
                    pa.array([i.mtime for i in some], pa.timestamp("us", "UTC")), pa.array([f"{self.root.rstrip('/')}/{i.path[len(root) :].lstrip('/')}" for i in some], pa.string()),
                ], ["rel_path", "length", "mtime", "path"])


def file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of an address, and the path in it; file:/x counts as /x."""
    fs, inner = pa_fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    return fs, inner.rstrip("/")


def list_files(spark: SparkSession, root: str, rules: R.RuleSet | None = None) -> DataFrame:
    """SRC1: all readable files below root (see LISTED), by the folder_tree source. Contents aren't read."""
    spark.dataSource.register(FolderTree)
    base = root.rstrip("/")
    x = spark.read.format("folder_tree").option("path", base).load()
    return readable(x, base.rsplit("/", 1)[-1], rules).select("tender", "rel_path", "file", "suffix", "length", "mtime", "path")


def packed(files: DataFrame, most: int = 64 << 20, each: int = 1 << 20) -> DataFrame:
    """files in partitions of at most `most` bytes (column length, and `each` for opening one), files of half of that alone.

    Files are dealt to as many buckets as there are shuffle partitions, and packed in a bucket by running sums; a row for each
    bucket says where its packs begin. Only rows of files travel, no contents."""
    spark = files.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce("length", F.lit(0)) + each
    x = files.withColumns({"_size": size, "_bucket": F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")})
    # of the others, those that begin in one half of `most` go together: with the last one they stay below it
    small, large = Window.partitionBy("_bucket").orderBy("_size", "path"), Window.partitionBy("_bucket").orderBy(F.desc("_size"), "path")
    before = F.sum("_size").over(small) - F.col("_size")
    x = x.withColumn("_pack", F.when(F.col("_size") * 2 >= most, -F.row_number().over(large)).otherwise(F.floor(before * 2 / most)).cast("int"))
    x = Scratch(spark, "packs").write(x, "packs")
    counts = x.groupBy("_bucket").agg(F.coalesce(F.max("_pack"), F.lit(-1)).alias("m"), F.min("_pack").alias("l")).collect()
    begins, total = [], 0
    for r in sorted(counts, key=lambda r: r["_bucket"]):
        alone = max(0, -r["l"])
        begins.append((r["_bucket"], total + alone))
        total += alone + max(0, r["m"] + 1)
    starts = spark.createDataFrame(begins, "_bucket int, _start int")
    dealt = x.join(F.broadcast(starts), "_bucket").withColumn("_at", (F.col("_start") + F.col("_pack")).cast("int"))
    return dealt.repartitionById(max(1, total), F.col("_at")).select(*files.columns)


DECODED = "tender string, file string, page int, text_layer string, ocr_text string, error string"
Decoder = Callable[[bytes], Iterable[tuple[int, str | None, str | None]]]


def text_decoder(content: bytes) -> Iterable[tuple[int, str | None, str | None]]:
    """SRC2: a text file is one page 0; bytes that are no UTF-8 are left out. Kept even if empty."""
    return [(0, content.decode("utf-8", "ignore"), None)]


def _decoded(decoders: dict[str, Decoder]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                try:
                    fs, path = file_system(f["path"])
                    with fs.open_input_stream(path, compression=None) as stream:
                        rows = [(page, layer, seen, None) for page, layer, seen in decoders[f["suffix"]](stream.read())]
                except Exception as e:  # whatever a decoder of the user's raises is that file's note and nobody else's
                    rows = [(None, None, None, f"{type(e).__name__}: {e}"[:300])]
                page, layer, seen, error = zip(*rows, strict=True) if rows else ((),) * 4
                own = lambda v, n=len(rows): pa.array([v] * n, pa.string())
                yield pa.RecordBatch.from_arrays([own(f["tender"]), own(f["file"]), pa.array(page, pa.int32()), *[pa.array(c, pa.string()) for c in (layer, seen, error)]], ["tender", "file", "page", "text_layer", "ocr_text", "error"])

    return run


def decode(files: DataFrame, decoders: dict[str, Decoder] | None = None, most: int = 64 << 20) -> DataFrame:
    """The decoder slot: pages (see DECODED) of files (see LISTED), by the decoder of each file's suffix: a function of its bytes that
    gives page, text layer and recognised text. Files without a decoder are left out.

    A file whose decoder fails gives one row with the error and no page; others go on. Files are packed by their bytes."""
    decoders = decoders or {".txt": text_decoder}
    some = files.filter(F.col("suffix").isin(*decoders)).select("tender", "file", "suffix", "length", "path")
    return packed(some, most).mapInArrow(_decoded(decoders), DECODED)


def read_text_pages(spark: SparkSession, root: str, rules: R.RuleSet | None = None) -> DataFrame:
    """SRC2: tender, file, page 0, text, ocr of .txt files, bytes that are no UTF-8 left out."""
    got = decode(list_files(spark, root, rules)).filter("error is null")
    return got.select("tender", "file", "page", C.clean_text(F.col("text_layer")).alias("text"), F.lit(False).alias("ocr"))


FOLDER_ID, FILE_ID = r"/folders/([A-Za-z0-9_-]+)", r"/(?:file/)?d/([A-Za-z0-9_-]+)"


def parse_listing(pages: DataFrame, folder_id: str = FOLDER_ID, file_id: str = FILE_ID) -> DataFrame:
    """SRC3: listing_id, name, id, is_folder of the anchors in html; the folder pattern is tried first; of equal ids the first."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    x = pages.select("listing_id", F.posexplode(anchors).alias("pos", "a"))
    href = F.regexp_extract("a", r'(?is)href="([^"]*)"', 1)
    name = F.regexp_replace(F.regexp_replace("a", r"(?is)^<a\s[^>]*>", ""), "<[^>]*>", "")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        name = F.replace(name, F.lit(k), F.lit(v))
    x = x.select("listing_id", "pos", C.strip(name).alias("name"), F.regexp_extract(href, folder_id, 1).alias("folder"), F.regexp_extract(href, file_id, 1).alias("doc"))
    x = x.select("listing_id", "pos", "name", F.when(F.col("folder") != "", F.col("folder")).otherwise(F.col("doc")).alias("id"), (F.col("folder") != "").alias("is_folder")).filter("id <> '' and name <> ''")
    first = x.groupBy("listing_id", "id").agg(F.min_by(F.struct("name", "is_folder"), "pos").alias("f"))
    return first.select("listing_id", "f.name", "id", "f.is_folder")


def folder_id(url: Column) -> Column:
    """SRC4: the id in /drive/folders/X, else ?id= or &id=, else the last part of the path."""
    a = F.regexp_extract(url, r"/folders/([A-Za-z0-9_-]+)", 1)
    b = F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1)
    last = F.element_at(F.split(F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", ""), "/"), -1)
    return F.when(a != "", a).when(b != "", b).otherwise(last)


def walk_listing(listing: DataFrame, roots: DataFrame, max_depth: int = 6, rules: R.RuleSet | None = None) -> DataFrame:
    """SRC5: root, rel_path, id, depth of the files in the folder trees below roots (root: an id), folders to max_depth.

    listing: parent_id, id, name, is_folder. A level is one join on the parent and is written, so the next one reads it and
    joins nothing again; the walk ends with the first level without folders. Excluded folders aren't entered, hidden
    files left out, and a folder that stands in its own path isn't entered again. (Spark's recursive queries keep their
    levels in executors' memory and stop at a million rows.)"""
    rules = rules or R.RuleSet()
    scratch = Scratch(listing.sparkSession, "walk")
    entry = listing.select("parent_id", "id", "name", "is_folder")
    level = roots.select("root", F.col("root").alias("at"), F.lit("").alias("path"), F.array("root").alias("trail"))
    found = []
    for depth in range(max_depth + 1):
        into = ~F.upper(C.strip(F.col("name"))).isin(*[e.upper() for e in rules.excluded]) & ~F.array_contains("trail", F.col("id"))
        x = level.join(entry, level["at"] == entry["parent_id"]).filter(F.when(F.col("is_folder"), into).otherwise(~_hidden(F.col("name"), rules)))
        x = scratch.write(x.select("root", "id", F.concat("path", "name").alias("rel_path"), "is_folder", "trail"), f"level-{depth}")
        found.append(x.filter(~F.col("is_folder")).select("root", "rel_path", "id", F.lit(depth).alias("depth")))
        folders = x.filter("is_folder")
        if depth == max_depth or not folders.limit(1).count():
            break
        level = folders.select("root", F.col("id").alias("at"), F.concat("rel_path", F.lit("/")).alias("path"), F.concat("trail", F.array("id")).alias("trail"))
    return reduce(DataFrame.union, found)
