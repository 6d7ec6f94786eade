"""Page assembly: choice of text, sheets and documents as pages, file-level features (PG2 to PG8)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmine import rules as R
from leafmine.functions import columns as C
from leafmine.scratch import Scratch


def choose_page_text(decoded: DataFrame, least: int = 60, most_ocr: int = 60, empty: bool = False) -> DataFrame:
    """PG2: tender, file, page, text, ocr from decoded pages (text_layer, ocr_text). Recognised text is used where the text
    layer is short, recognition found more, and fewer than most_ocr pages of the file used it before; empty pages go, unless empty.
    Pages without a tender or a file belong together like others, and their cap holds too.

    Of each file with more such pages than most_ocr the number of the first one too many is looked up, from page numbers alone; texts are
    neither sorted nor moved, but for those pages of these files. decoded is read twice: it should be a written table."""
    layer, seen = C.strip(F.coalesce("text_layer", F.lit(""))), C.strip(F.coalesce("ocr_text", F.lit("")))
    d = decoded.select("tender", "file", "page", "text_layer", "ocr_text", ((F.length(layer) < least) & (F.length(seen) > F.length(layer))).alias("fits"))
    order = Window.partitionBy("tender", "file").orderBy("page")
    over = d.filter("fits").select("tender", "file", "page").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most_ocr + 1)
    over = Scratch(decoded.sparkSession, "ocr").write(over.filter(F.col("r") == most_ocr + 1).select(F.col("tender").alias("_tender"), F.col("file").alias("_file"), F.col("page").alias("_over")), "over")
    text = lambda c: C.clean_text(F.coalesce(c, F.lit("")))
    few = d.filter("not fits").select("tender", "file", "page", text("text_layer").alias("text"), F.lit(False).alias("ocr"))
    fits = d.filter("fits").join(over.hint("shuffle_hash"), F.col("tender").eqNullSafe(F.col("_tender")) & F.col("file").eqNullSafe(F.col("_file")), "left") if over.limit(1).count() else d.filter("fits").withColumn("_over", F.lit(None).cast("int"))
    used = F.col("_over").isNull() | (F.col("page") < F.col("_over"))
    many = fits.select("tender", "file", "page", F.when(used, text("ocr_text")).otherwise(text("text_layer")).alias("text"), used.alias("ocr"))
    return few.union(many) if empty else few.union(many).filter("text <> ''")


def _in_order(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def sheet_pages(cells: DataFrame, least: int = 40) -> DataFrame:
    """PG3: tender, file, page (sheet number), text from cells (sheet_no, sheet, row, col, value)."""
    full = cells.filter(C.strip(F.coalesce("value", F.lit(""))) != "")
    rows = full.groupBy("tender", "file", "sheet_no", "sheet", "row").agg(F.array_join(F.transform(_in_order("col", "value"), lambda x: x["value"]), "\t").alias("line"))
    sheets = rows.groupBy("tender", "file", "sheet_no", "sheet").agg(F.array_join(F.transform(_in_order("row", "line"), lambda x: x["line"]), "\n").alias("body"))
    text = C.clean_text(F.concat(F.lit("[Sheet: "), F.col("sheet"), F.lit("]\n"), F.col("body")))
    return sheets.select("tender", "file", F.col("sheet_no").alias("page"), text.alias("text")).filter(F.length("text") > least)


def word_pages(blocks: DataFrame) -> DataFrame:
    """PG4: one page 0 a file from blocks (kind para or row, ord, cells): paragraphs, then table rows."""
    cells = F.transform("cells", lambda c: C.strip(F.coalesce(c, F.lit(""))))
    row = F.when(F.exists(cells, lambda c: c != ""), F.array_join(cells, " | "))
    para = F.when(F.element_at(cells, 1) != "", F.element_at("cells", 1))
    lines = blocks.select("tender", "file", (F.col("kind") != "para").alias("late"), "ord", F.when(F.col("kind") == "para", para).otherwise(row).alias("line")).filter("line is not null")
    text = C.clean_text(F.array_join(F.transform(_in_order("late", "ord", "line"), lambda x: x["line"]), "\n"))
    return lines.groupBy("tender", "file").agg(text.alias("text")).select("tender", "file", F.lit(0).alias("page"), "text")


def is_boilerplate(hits: Column, pages: Column) -> Column:
    """PG6: two of a file's first three pages name the standing conditions, or one in a file of 50 or more."""
    return (hits >= 2) | ((hits >= 1) & (pages >= 50))


def boilerplate_flags(pages: DataFrame) -> DataFrame:
    """PG6: tender, file, boilerplate: two of a file's first three pages name the standing conditions, or one in a file of 50
    or more. Page texts aren't shuffled: only numbers and hits are."""
    hits = pages.select("tender", "file", "page", F.coalesce("text", F.lit("")).rlike(C.I + "|".join(R.STANDING)).alias("hit"))
    order = Window.partitionBy("tender", "file").orderBy("page")
    first = hits.withColumn("r", F.row_number().over(order))
    flags = first.groupBy("tender", "file").agg(F.count("*").alias("n"), F.count_if(F.col("hit") & (F.col("r") <= 3)).alias("found"))
    return flags.select("tender", "file", is_boilerplate(F.col("found"), F.col("n")).alias("boilerplate"))


def mark_boilerplate(pages: DataFrame) -> DataFrame:
    """PG6: pages with boilerplate. Where only candidates need it, join boilerplate_flags() to these instead."""
    return pages.drop("boilerplate").join(boilerplate_flags(pages), ["tender", "file"])


def page_rank(priorities: list = R.PRIORITIES) -> Column:
    """PG7: sortable: boilerplate last, then priority, file, page. The tuple is kept; nothing is sorted globally."""
    return F.struct(F.coalesce("boilerplate", F.lit(False)).alias("late"), (-C.file_priority(F.col("file"), priorities)).alias("prio"), "file", "page")


def read_order(pages: DataFrame, priorities: list = R.PRIORITIES) -> DataFrame:
    """PG7: pages with read_ord, from 0, by priority, file, page within the tender."""
    order = Window.partitionBy("tender").orderBy((-C.file_priority(F.col("file"), priorities)), "file", "page")
    return pages.withColumn("read_ord", F.row_number().over(order) - 1)


def file_blocks(pages: DataFrame, priorities: list = R.PRIORITIES) -> DataFrame:
    """PG8: tender, file, text (pages joined by LF), starts (offset, page, ocr of each), prio."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("tender", "file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = pages.withColumn("at", before.cast("int")).groupBy("tender", "file").agg(_in_order("page", "at", "text", "ocr").alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    starts = F.transform("p", lambda x: F.struct(x["at"].alias("at"), x["page"].cast("int").alias("page"), x["ocr"].alias("ocr")))
    return got.select("tender", "file", text.alias("text"), starts.alias("starts"), (-C.file_priority(F.col("file"), priorities)).alias("prio"))


def page_at(starts: Column, pos: Column) -> Column:
    """The last entry of starts at or before an offset."""
    return F.element_at(F.filter(starts, lambda s: s["at"] <= pos), -1)
