"""The review board: counts, states by deadline, search, order, tiles (RV1 to RV6)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmine import rules as R
from leafmine.functions import columns as C

STATES = ["urgent", "soon", "open", "past"]


def _found() -> Column:
    return ~F.upper("value").startswith("NOT FOUND") & (F.col("value") != "")


def run_stats(results: DataFrame, ai_ok: DataFrame) -> DataFrame:
    """RV1: one row: tenders, found, total, percent (floor), flagged, without_ai."""
    r = results.agg(F.count_distinct("tender").alias("tenders"), F.count_if(_found()).alias("found"), F.count("*").alias("total"), F.count_if(F.col("flag") != "").alias("flagged"))
    a = ai_ok.agg(F.count_if(~F.col("ai_ok")).alias("without_ai"))
    return r.crossJoin(a).select("tenders", "found", "total", F.floor(F.col("found") * 100 / F.greatest("total", F.lit(1))).alias("percent"), "flagged", "without_ai")


def field_status(results: DataFrame) -> DataFrame:
    """RV2: tender, field, shown, status. The name of a tender without one is its folder."""
    status = F.when(F.col("flag") == "NOT FOUND", F.lit("not found")).when(F.col("flag") != "", F.concat(F.lit("warn: "), "flag")).when(~_found(), F.lit("not found")).otherwise(F.lit("verified"))
    shown = F.when((F.col("field") == "tender_name") & ~_found(), F.col("tender")).otherwise(F.col("value"))
    return results.select("tender", "field", shown.alias("shown"), status.alias("status"))


def urgency(results: DataFrame, today: Column) -> DataFrame:
    """RV3: tender, due, days, state, state_rank, review, emd. Amounts are read as money_number() does."""
    got = lambda f: F.max(F.when((F.col("field") == f) & _found(), F.col("value")))
    w = results.groupBy("tender").agg(got("submission_date").alias("d"), got("emd").alias("e"), F.count_if(F.col("flag") != "").alias("review"), F.count_if(_found()).alias("found"))
    days = F.datediff(F.col("due"), today)
    state = F.when(F.col("days").isNull() | (F.col("days") < 0), "past").when(F.col("days") <= 3, "urgent").when(F.col("days") <= 14, "soon").otherwise("open")
    w = w.withColumn("due", C.due_date(F.col("d"))).withColumn("days", days).withColumn("state", state)
    return w.select("tender", "due", "days", "state", (F.array_position(F.array(*map(F.lit, STATES)), F.col("state")) - 1).cast("int").alias("state_rank"), "review", F.coalesce(C.money_number(F.col("e")), F.lit(0.0)).alias("emd"), "found")


def search_texts(results: DataFrame) -> DataFrame:
    """RV4: tender, text: the folder and all its values in field order, in lower case."""
    order = F.array_position(F.array(*map(F.lit, R.ORDER)), F.col("field"))
    values = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce("value", F.lit("")).alias("v"))))
    t = results.groupBy("tender").agg(values.alias("xs"))
    return t.select("tender", F.lower(F.concat_ws(" ", "tender", F.transform("xs", lambda x: x["v"]))).alias("text"))


#: Characters of a piece in the search index.
GRAM = 3


def search_index(texts: DataFrame) -> DataFrame:
    """RV4: gram, tender: every piece of three characters of search_texts(), to be written by gram (say
    partitionBy(substring(gram, 1, 1)) or sorted), so that a search reads the postings of its own pieces alone."""
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - GRAM + 1), lambda i: F.substring("text", i, F.lit(GRAM)))
    return texts.filter(F.length("text") >= GRAM).select("tender", F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "tender")


def _found_by(texts: DataFrame, q: str, index: DataFrame | None) -> DataFrame:
    """tender of the texts that contain q."""
    q = q.lower()
    grams = {q[i : i + GRAM] for i in range(len(q) - GRAM + 1)}
    if index is not None and grams:
        # whoever contains q has all of its pieces; that they stand together is then looked up in these texts alone
        all_of = index.filter(F.col("gram").isin(*grams)).groupBy("tender").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
        texts = texts.join(all_of.select("tender"), "tender", "left_semi")
    return texts.filter(F.col("text").contains(q)).select("tender")


def search(board: DataFrame, results: DataFrame, q: str = "", review_only: bool = False, closing_14: bool = False, index: DataFrame | None = None) -> DataFrame:
    """RV4: rows of the board whose folder or any value contains q, regardless of case.

    index: search_index() of the same results, if there is one; searches of fewer than three characters scan all texts."""
    out = board
    if q:
        out = out.join(_found_by(search_texts(results), q, index), "tender", "left_semi")
    if review_only:
        out = out.filter("review > 0")
    return out.filter("days between 0 and 14") if closing_14 else out


def sort_rows(board: DataFrame, by: str = "due", limit: int | None = None) -> DataFrame:
    """RV5: the board by due date (live states first), folder, emd or review; with a limit a top-k."""
    order = {
        "due": [F.col("state_rank"), F.col("days").asc_nulls_last(), F.col("tender")], "folder": [F.col("tender")],
        "emd": [F.desc("emd"), F.col("tender")], "review": [F.desc("review"), F.col("tender")],
    }[by]
    out = board.orderBy(*order)
    return out if limit is None else out.limit(limit)


def tiles(board: DataFrame) -> DataFrame:
    """RV6: one row: tenders, next_due and next_tender (of those not past), emd (of all), flags, nothing_found."""
    x = board.agg(F.count("*").alias("tenders"), F.min(F.when(F.col("state") != "past", F.struct("days", "tender", "due"))).alias("n"), F.sum("emd").alias("emd"), F.sum("review").alias("flags"), F.count_if(F.col("found") == 0).alias("nothing_found"))
    return x.select("tenders", F.col("n.due").alias("next_due"), F.col("n.tender").alias("next_tender"), "emd", "flags", "nothing_found")
