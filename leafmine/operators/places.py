"""VP12 with a gazetteer of any size: places are a table, and addresses meet them in a join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmine.functions import columns as C


def _spans(words: int):
    """start, n, text of all runs of up to `words` words of a text, as they stand there."""
    # words and what stands between them alternate
    pieces = F.regexp_extract_all("_text", F.lit(r"(?U)\w+|\W+"), F.lit(0))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: F.get(pieces, i - 1).rlike(r"(?U)^\w"))
    run = lambda i, n: F.array_join(F.slice(pieces, i, F.lit(2 * n - 1)), "")
    fits = lambda i, n: i + 2 * n - 2 <= F.size(pieces)
    spans = F.transform(starts, lambda i: F.array(*[F.when(fits(i, n), F.struct(i.alias("start"), F.lit(n).alias("n"), run(i, n).alias("text"))) for n in range(1, words + 1)]))
    return F.filter(F.flatten(spans), lambda s: s.isNotNull())


def split_places(rows: DataFrame, address: str, places: DataFrame, words: int = 4) -> DataFrame:
    """rows with place: struct(city, state) of the address, as columns.split_city_state() gives it.

    places: city, state; cities of up to `words` words that begin and end with a letter or digit; of several states of one city the
    first by name counts. All runs of words of each different address meet the table in a join; the leftmost, there the longest one wins.
    A null address has no place."""
    text = C.strip(F.coalesce(F.col(address), F.lit("")))
    known = places.groupBy(F.upper("city").alias("_city")).agg(F.min("state").alias("_of"))
    runs = rows.select(text.alias("_text")).distinct().select("_text", F.explode(_spans(words)).alias("_s"))
    met = runs.join(known, F.upper("_s.text") == F.col("_city"))
    first = met.groupBy("_text").agg(F.min_by(F.struct("_s.text", "_of"), F.struct("_s.start", -F.col("_s.n"))).alias("_f"))
    out = rows.withColumn("_own", text).join(first, F.col("_own") == F.col("_text"), "left")
    place = C.city_and_state(F.col("_own"), F.coalesce("_f.text", F.lit("")), F.col("_f._of"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], place.alias("place"))
