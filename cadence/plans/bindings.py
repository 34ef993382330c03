"""The driver's tables in the shapes of the corpus model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.corpus import Corpus, build_corpus

ORIGIN = "2024-01-01T00:00:00Z"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str) -> Column:
    """A wall-clock column as the instant of that time in UTC, whatever the session's zone."""
    return F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())


def after(origin: str, amount: Column, unit_micros: int) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(origin).cast("timestamp")) + amount.cast("long") * unit_micros)


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.lit("generic").alias("platform"),
        utc("ts").alias("created_at"),
        F.lit("").alias("text"),
        F.when(F.col("event_type") == "error", "repost").otherwise("original").alias("kind"),
    )


def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("post_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.lit("generic").alias("platform"),
        utc("o_orderdate").alias("created_at"),
        F.lit("").alias("text"),
        F.lit("original").alias("kind"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("source").alias("account_id"),
        F.lit("generic").alias("platform"),
        after(ORIGIN, F.col("doc_id"), 60_000_000).alias("created_at"),
        "text",
        F.lit("original").alias("kind"),
        F.lit(None).cast("string").alias("root_post_id"),
    )


def customer_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.cast("string").alias("account_id"),
        F.lit("generic").alias("platform"),
        F.col("c_name").alias("handle"),
        F.col("c_name").alias("display_name"),
        F.when(key % 4 != 0, F.lit("about me")).alias("description"),
        F.col("c_nationkey").cast("string").alias("location"),
        after("2022-01-01T00:00:00Z", key, 3_600_000_000).alias("created_at"),
        F.when(key % 5 != 0, F.abs(F.floor(F.col("c_acctbal"))).cast("long")).alias("followers_count"),
        (key % 7 * 10).cast("long").alias("following_count"),
        (key % 11).cast("long").alias("post_count"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """All customers as accounts, all events as posts, and a label for each customer."""
    return build_corpus(customer_accounts(spark, sf_dir), event_posts(spark, sf_dir), planted_labels(spark, sf_dir), collected_at="2025-01-01T00:00:00Z")


def planted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    label = F.when(key % 10 == 9, "unknown").when(key % 2 == 0, "automated").otherwise("organic")
    return read(spark, sf_dir, "customer").select(key.cast("string").alias("account_id"), F.lit("generic").alias("platform"), label.alias("label"), F.concat(F.lit("set"), (key % 2).cast("string")).alias("dataset"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, probability) of the labelled documents: a stand-in score from the text's length."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("target"), ((F.col("n_chars") % 101) / 100.0).alias("probability"))


def digits(text: Column, n: int) -> Column:
    """The first n hexadecimal digits of a text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, n), 16, 10).cast("long")


def fingerprint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of coordination, with fingerprints that SQL can compute too.

    Five users that follow each other share texts, of which there is a new one every six hours; up to
    four bits of a fingerprint differ by event.
    """
    micros = F.unix_micros(utc("ts"))
    theme = F.concat_ws(":", F.floor(F.col("user_id") / 5), F.floor(micros / 21_600_000_000))
    noise = F.expr("shiftleft(1L, int(event_id % 57)) + shiftleft(1L, int(event_id * 7 % 53))")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("user_id").cast("string").alias("account_id"),
        micros.alias("micros"),
        F.when(F.col("event_type") == "error", F.lit("thread")).alias("root"),
        digits(theme, 15).bitwiseXOR(noise).alias("fingerprint"),
    )
