"""Importance resampling towards a target's distribution of hashed n-grams, in DataFrame functions alone.

N-gram arrays are exploded and hashed into buckets by crc32; counts of a bucket in the documents and in the target give
its gain. The gain table, one row a bucket, is joined by broadcast, a document's gains are summed, and Gumbel noise from a
hash of the id makes the highest scores a draw without replacement. Ranks come from one distributed sort: a row's place
in its partition plus the rows of all partitions before.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

# What stands between words: all of ASCII but digits and letters a to z, after lower-casing (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_POSITION_BITS = 33  # of monotonically_increasing_id: the partition stands above, the row's place in it below


def words_of(text: Column) -> Column:
    """Words of a text with A-Z alone lower-cased; a null text has none."""
    plain = F.octet_length(text) == F.char_length(text)  # ASCII throughout: lower() does the same, and faster
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(folded, BETWEEN), ""), F.array().cast("array<string>"))  # five times as fast as regexp_extract_all


def features(texts: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """(keys, bucket): a row for each run of one to three consecutive words of column ``words``, repeats included.

    A row without words gives one row of a null bucket; the runs that would leave the text give null buckets too.
    """
    n = F.size("words")
    runs = texts.select(*keys, F.inline_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, n).alias("b"), F.slice("words", 3, n).alias("c"))).alias("a", "b", "c"))
    grams = [F.col("a"), F.concat("a", F.lit(" "), "b"), F.concat("a", F.lit(" "), "b", F.lit(" "), "c")]
    return runs.select(*keys, F.explode(F.array(*[(F.crc32(g) % buckets).cast("int") for g in grams])).alias("bucket"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, s, t, gain) of every bucket: counts in the documents and in the target, and 1000 times the log of the
    smoothed ratio of their shares, rounded down. Both tables are read whole; what is kept is one row a bucket."""
    sides = [df.select(F.lit(k).alias("side"), words_of(F.col(text_col).cast("string")).alias("words")) for k, df in enumerate((docs, target))]
    counted = [features(side, buckets, "side").filter("bucket IS NOT NULL").groupBy("side", "bucket").agg(F.count("*").alias("n")) for side in sides]
    counts = common.materialize(counted[0].unionByName(counted[1]), "buckets")
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0).cast("long"))
    totals = counts.agg(of(0).alias("all_s"), of(1).alias("all_t"))
    each = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts.groupBy("bucket").agg(of(0).alias("s"), of(1).alias("t"))), "bucket", "left")
    each = each.fillna(0, ["s", "t"]).crossJoin(F.broadcast(totals))
    d = lambda name, more: F.col(name).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return each.select("bucket", "s", "t", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """1000 times a standard Gumbel value, rounded down, from the first 32 bits of sha256 of ``seed:id``; a null id counts as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``: 1, 2, 3, ... in ``order``, by a distributed sort. What is gathered in one task is a count a partition."""
    at = F.monotonically_increasing_id()
    laid = common.materialize(df.orderBy(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", _POSITION_BITS)), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition of the sort
    offsets = laid.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1) + 1
    return laid.join(F.broadcast(offsets), "_part").withColumn("place", place).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) with the highest scores are drawn and
    ranked from 1, ties to the smaller id; other rows have a null rank. A null or empty text has no features and weight
    0. Null ids take part (their noise is that of no digits) and come last among ties; repeated rows are drawn each for
    itself. Empty documents give an empty table; an empty target makes every gain a plain function of s. Texts are read
    whole. Other columns are not read, so they can't clash. The text is split twice, for counts and for sums; nothing
    but bucket counts and one row a document is shuffled.
    """
    gains = common.materialize(gain_table(docs, target, buckets, text_col), "gains")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    each = features(rows.withColumn("n_words", F.size("words")), buckets, "row", "doc_id", "n_words")
    summed = each.join(F.broadcast(gains.select("bucket", "gain")), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    weighed = common.materialize(summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    drawn = weighed.filter(able).count() * percent // 100
    placed = ranked(weighed, able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
