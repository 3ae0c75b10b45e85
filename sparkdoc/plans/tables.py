"""The driver's tables as entry logs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of events: a key per user and property, error events delete."""
    e = read(spark, sf_dir, "events")
    key = F.concat_ws("#", F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lpad(F.get_json_object("props", "$.k"), 3, "0"))
    return e.select(key.alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of orders: a key per customer, pending orders delete."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with attributes: language, source, size, sparse labels."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", "n_chars")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return d.join(labels, "id", "left")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the array of their event types, and of the whole values of their events (nulls for errors)."""
    e = read(spark, sf_dir, "events")
    whole = F.when(F.col("event_type") != "error", F.floor("value").cast("double"))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.collect_list(F.struct("event_id", whole.alias("v"))).alias("w")).select("id", "types", F.transform("w", lambda x: x["v"]).alias("values"))


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the words of their type."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ").alias("words"), F.col("p_size").alias("size"))
