"""The relational core: an append-only log of entries (key, seq, value), newest sequence number wins.

A null value is a delete marker. All functions take and give DataFrames of (key, seq, value), whatever
the type of value; filters on key reach the Parquet scan below the aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(entries: DataFrame, unique: bool = False) -> DataFrame:
    """One row per key, that of the highest seq; delete markers stay. ``unique`` keys (a compacted log) need no aggregation."""
    if unique:
        return entries.select("key", "seq", "value")
    return entries.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


def live(entries: DataFrame, unique: bool = False) -> DataFrame:
    """Newest versions without deleted keys: markers go only after newest-wins, or they would revive old versions."""
    return latest(entries, unique).where(F.col("value").isNotNull())


def get(entries: DataFrame, key: str) -> DataFrame:
    """The newest entry of one key; a row with a null value was deleted, no row was never written."""
    return latest(entries.where(F.col("key") == F.lit(key)))


def scan(entries: DataFrame, unique: bool = False) -> DataFrame:
    return live(entries, unique).orderBy("key")


def scan_range(entries: DataFrame, after: str, limit: int, unique: bool = False) -> DataFrame:
    """A page of live entries with key > after in key order, and whether more follow (``has_more``).

    One row beyond the page is looked at; deleted keys don't count. An empty page has no row to carry
    the flag: use ``has_more`` for limit 0.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    probe = live(entries.where(F.col("key") > F.lit(after)), unique).orderBy("key").limit(limit + 1)
    page = Window.orderBy("key")  # over limit + 1 rows
    numbered = probe.withColumn("n", F.row_number().over(page)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > limit)
    return numbered.where(F.col("n") <= limit).orderBy("key").select("key", "seq", "value", "has_more")


def has_more(entries: DataFrame, after: str, limit: int, unique: bool = False) -> DataFrame:
    """One row: how long the page after ``after`` is and whether more follow."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    probe = live(entries.where(F.col("key") > F.lit(after)), unique).select("key").orderBy("key").limit(limit + 1)
    return probe.agg(F.least(F.count("*"), F.lit(limit)).cast("long").alias("page_rows"), (F.count("*") > limit).alias("has_more"))


def scan_since(entries: DataFrame, seq: int) -> DataFrame:
    """Newest version of each key changed after ``seq``, in key order, deletions flagged: a collapsed change feed."""
    changed = latest(entries.where(F.col("seq") > seq))
    return changed.withColumn("is_deleted", F.col("value").isNull()).orderBy("key")


def as_of(entries: DataFrame, seq: int) -> DataFrame:
    """The live entries as they were at ``seq``."""
    return scan(entries.where(F.col("seq") <= seq))


def merge(*sources: DataFrame) -> DataFrame:
    """Ordered live merge of several logs."""
    return scan(reduce(DataFrame.unionByName, [s.select("key", "seq", "value") for s in sources]))


def compact(*sources: DataFrame) -> DataFrame:
    """One log with the newest version of every key, delete markers included."""
    return latest(reduce(DataFrame.unionByName, [s.select("key", "seq", "value") for s in sources]))


def segment_stats(entries: DataFrame, by: str | None = None) -> DataFrame:
    """Least and largest key and seq, and the number of entries, of a log or of each of its segments; an empty log gives blanks and zeros."""
    stats = [
        F.coalesce(F.min("key"), F.lit("")).alias("min_key"),
        F.coalesce(F.max("key"), F.lit("")).alias("max_key"),
        F.coalesce(F.min("seq"), F.lit(0)).cast("long").alias("min_seq"),
        F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("max_seq"),
        F.count("*").alias("n"),
    ]
    return entries.groupBy(by).agg(*stats) if by else entries.agg(*stats)


def max_seq(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("max_seq"))


def deleted(entries: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete marker."""
    return latest(entries).where(F.col("value").isNull()).select("key", "seq").orderBy("key")


def normalise(entries: DataFrame) -> DataFrame:
    """An empty binary value is a delete marker too."""
    return entries.withColumn("value", F.when(F.octet_length("value") > 0, F.col("value")))
