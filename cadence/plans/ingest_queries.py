"""Registered queries of the ingest layer: untidy rows made of the driver's tables, and files written and read.

Each untidy table has defects by row number, which its SQL repeats.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.corpus import build_corpus
from cadence.functions.scalar import active_days_ratio, blank_to_null, normalised_handle, safe_ratio
from cadence.operators import account, labels
from cadence.plans import bindings as b
from cadence.plans.lineage import shared_folder
from cadence.plans.registry import query, rounded
from cadence.sources import raw
from cadence.sources.adapters import AdapterRegistry, ArchiveAdapter, NativeAdapter, accounts_from_posts, archive_role
from cadence.sources.annotations import AUTOMATED, ORGANIC, normalised_class, read_labels
from cadence.sources.inspect import inspect_file
from cadence.sources.mapping import MappingConfig, account_rows, label_rows, post_rows, rejects
from cadence.sources.sinks import read_corpus, write_corpus, write_corpus_json, write_features

CONFIG = MappingConfig("twitter", assume_offset_hours=2.0, date_order="dmy")

#: Posts under aliases: (column, Spark SQL and DuckDB SQL of its cell); k is the event's number.
POST_CELLS = (
    ("tweetid", "CASE k % 23 WHEN 3 THEN '1.2E+17' WHEN 4 THEN ' ' WHEN 9 THEN ' tweetid' WHEN 10 THEN '' ELSE concat(' ', k, ' ') END"),
    ("USERID", "CASE k % 23 WHEN 9 THEN 'USERID' WHEN 10 THEN '' ELSE concat('', user_id) END"),
    ("platform", "CASE WHEN k % 23 = 9 THEN 'platform' WHEN k % 23 = 10 THEN '' WHEN k % 4 = 0 THEN 'Reddit' WHEN k % 4 = 1 THEN 'elsewhere' ELSE '' END"),
    ("tweet_time", "CASE k % 23 WHEN 5 THEN '' WHEN 6 THEN 'soon' WHEN 7 THEN concat('2024-01-0', 1 + k % 9, 'T10:00:00+01:00') WHEN 9 THEN 'tweet_time' WHEN 10 THEN '' ELSE concat('0', 1 + k % 9, '/02/2024 11:30') END"),
    ("body", "CASE k % 23 WHEN 9 THEN 'body' WHEN 10 THEN '' ELSE concat(' ', event_type) END"),
    ("kind", "CASE k % 23 WHEN 8 THEN 'scream' WHEN 9 THEN 'kind' WHEN 10 THEN '' WHEN 11 THEN 'QUOTE' ELSE '' END"),
    ("likes", "CASE k % 23 WHEN 9 THEN 'likes' WHEN 10 THEN '' WHEN 12 THEN '-4' WHEN 13 THEN '7.0' WHEN 14 THEN 'many' ELSE concat('', k % 100) END"),
    ("hashtags", "CASE k % 23 WHEN 9 THEN 'hashtags' WHEN 10 THEN '' WHEN 15 THEN '[\"a\", \" b \"]' ELSE 'x| y ||' END"),
    ("mood", "CASE k % 23 WHEN 9 THEN 'mood' WHEN 10 THEN '' WHEN 16 THEN '' ELSE 'glad' END"),
)
_RAW = f"x AS (SELECT k, user_id, event_type, {', '.join(f'{sql} AS c{n}' for n, (_, sql) in enumerate(POST_CELLS))} FROM (SELECT *, event_id AS k FROM events))"
_REASON = """CASE WHEN k % 23 = 9 THEN 'repeated_header' WHEN k % 23 = 10 THEN 'empty_row' WHEN k % 23 IN (5, 6) THEN 'ValueError'
 WHEN k % 23 = 3 THEN 'corrupted_identifier' WHEN k % 23 = 4 THEN 'post_id:string_type' WHEN k % 23 = 8 THEN 'kind:enum' WHEN k % 23 = 12 THEN 'like_count:greater_than_equal' END"""


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.read(spark, sf_dir, "events").withColumn("k", F.col("event_id"))
    return raw.from_dataframe(rows.select(*(F.expr(sql).alias(name) for name, sql in POST_CELLS)))


@query(
    f"""WITH {_RAW} SELECT k::VARCHAR AS post_id, user_id::VARCHAR AS account_id, CASE WHEN k % 4 = 0 THEN 'reddit' ELSE 'twitter' END AS platform,
 CASE WHEN k % 23 = 7 THEN epoch_us(TIMESTAMP '2024-01-01 09:00:00' + to_days((k % 9)::INTEGER)) ELSE epoch_us(TIMESTAMP '2024-02-01 09:30:00' + to_days((k % 9)::INTEGER)) END AS created, event_type AS text,
 CASE WHEN k % 23 = 11 THEN 'quote' ELSE 'original' END AS kind, CASE k % 23 WHEN 13 THEN 7 WHEN 14 THEN NULL ELSE k % 100 END AS like_count, 0::BIGINT AS media_count,
 CASE WHEN k % 23 = 15 THEN 'a,b' ELSE 'x,y' END AS hashtags, CASE WHEN k % 23 = 16 THEN NULL ELSE 'glad' END AS mood FROM x WHERE ({_REASON}) IS NULL"""
)
def ingest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = post_rows(raw_posts(spark, sf_dir), CONFIG).filter("reject_reason is null")
    return good.select("post_id", "account_id", "platform", F.unix_micros("created_at").alias("created"), "text", "kind", "like_count", "media_count", F.array_join("hashtags", ",").alias("hashtags"), F.element_at("extra", "mood").alias("mood"))


@query(f"WITH {_RAW} SELECT 'post:' || ({_REASON}) AS reason, count(*) AS n FROM x WHERE ({_REASON}) IS NOT NULL GROUP BY 1")
def ingest_post_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects("post", post_rows(raw_posts(spark, sf_dir), CONFIG)).groupBy("reason").agg(F.sum("n").alias("n"))


ACCOUNT_CELLS = (
    ("user_id", "CASE k % 19 WHEN 2 THEN '9E5' WHEN 3 THEN '' ELSE concat('', k) END"),
    ("screen_name", "CASE k % 19 WHEN 4 THEN ' @' WHEN 5 THEN '' ELSE concat('@@', c_name, ' ') END"),
    ("created", "CASE k % 19 WHEN 6 THEN '2024-13-45' WHEN 7 THEN '' ELSE '2020/2/3 04:05:06' END"),
    ("followers", "CASE k % 19 WHEN 8 THEN '-1' WHEN 9 THEN 'x' ELSE concat('', k % 50, '.0') END"),
    ("verified", "CASE k % 19 WHEN 10 THEN 'perhaps' WHEN 11 THEN 'F' ELSE 'Yes' END"),
    ("bio", "CASE k % 19 WHEN 12 THEN '  ' ELSE ' me ' END"),
)
_ACCOUNT_REASON = "CASE k % 19 WHEN 6 THEN 'ValueError' WHEN 2 THEN 'corrupted_identifier' WHEN 3 THEN 'account_id:string_type' WHEN 8 THEN 'followers_count:greater_than_equal' END"
_CUSTOMERS = "(SELECT *, c_custkey AS k FROM customer)"


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    return raw.from_dataframe(rows.select(*(F.expr(sql).alias(name) for name, sql in ACCOUNT_CELLS)))


@query(
    f"""SELECT k::VARCHAR AS account_id, 'twitter' AS platform, CASE WHEN k % 19 IN (4, 5) THEN NULL ELSE c_name END AS handle,
 CASE WHEN k % 19 <> 7 THEN epoch_us(TIMESTAMP '2020-02-03 02:05:06') END AS created, CASE WHEN k % 19 <> 9 THEN k % 50 END AS followers_count,
 CASE k % 19 WHEN 10 THEN NULL WHEN 11 THEN false ELSE true END AS verified, CASE WHEN k % 19 <> 12 THEN 'me' END AS description FROM {_CUSTOMERS} WHERE ({_ACCOUNT_REASON}) IS NULL"""
)
def ingest_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = account_rows(raw_accounts(spark, sf_dir), CONFIG).filter("reject_reason is null")
    return good.select("account_id", "platform", "handle", F.unix_micros("created_at").alias("created"), "followers_count", "verified", "description")


@query(f"SELECT 'account:' || ({_ACCOUNT_REASON}) AS reason, count(*) AS n FROM {_CUSTOMERS} WHERE ({_ACCOUNT_REASON}) IS NOT NULL GROUP BY 1")
def ingest_account_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects("account", account_rows(raw_accounts(spark, sf_dir), CONFIG)).groupBy("reason").agg(F.sum("n").alias("n"))


LABEL_CELLS = (
    ("account_id", "CASE k % 17 WHEN 1 THEN '' ELSE concat('', k) END"),
    ("label", "CASE k % 17 WHEN 2 THEN 'robot' WHEN 3 THEN '' WHEN 4 THEN 'Organic' ELSE 'automated' END"),
    ("dataset", "CASE k % 17 WHEN 5 THEN '' ELSE 'd' END"),
    ("confidence", "CASE k % 17 WHEN 6 THEN '1.5' WHEN 7 THEN '-0.5' WHEN 8 THEN 'sure' WHEN 9 THEN '' ELSE '0.25' END"),
)
_LABEL_REASON = """CASE k % 17 WHEN 1 THEN 'account_id:string_type' WHEN 2 THEN 'label:enum' WHEN 3 THEN 'label:string_type' WHEN 5 THEN 'dataset:string_type'
 WHEN 6 THEN 'confidence:less_than_equal' WHEN 7 THEN 'confidence:greater_than_equal' WHEN 8 THEN 'confidence:float_parsing' END"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.read(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    return raw.from_dataframe(rows.select(*(F.expr(sql).alias(name) for name, sql in LABEL_CELLS)))


@query(f"SELECT k::VARCHAR AS account_id, CASE WHEN k % 17 = 4 THEN 'organic' ELSE 'automated' END AS label, 'd' AS dataset, 'unknown' AS method, CASE WHEN k % 17 <> 9 THEN 0.25::DOUBLE END AS confidence FROM {_CUSTOMERS} WHERE ({_LABEL_REASON}) IS NULL")
def ingest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_rows(raw_labels(spark, sf_dir), CONFIG).filter("reject_reason is null").select("account_id", "label", "dataset", "method", "confidence")


@query(f"SELECT 'label:' || ({_LABEL_REASON}) AS reason, count(*) AS n FROM {_CUSTOMERS} WHERE ({_LABEL_REASON}) IS NOT NULL GROUP BY 1")
def ingest_label_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects("label", label_rows(raw_labels(spark, sf_dir), CONFIG)).groupBy("reason").agg(F.sum("n").alias("n"))


#: The ingest report of posts and accounts together.
@query(
    f"""WITH p AS (SELECT ({_REASON}) AS r, user_id FROM (SELECT *, event_id AS k FROM events)), a AS (SELECT ({_ACCOUNT_REASON}) AS r, k FROM {_CUSTOMERS})
SELECT (SELECT count(*) FROM p WHERE r IS NULL) AS n_posts, (SELECT count(*) FROM a WHERE r IS NULL) AS n_accounts,
 (SELECT count(*) FROM p WHERE r IS NOT NULL) + (SELECT count(*) FROM a WHERE r IS NOT NULL) AS n_skipped,
 (SELECT count(*) FROM p WHERE r IS NULL AND user_id NOT IN (SELECT k FROM a WHERE r IS NULL)) AS orphans"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NativeAdapter(CONFIG).from_records(spark, "tables", raw_posts(spark, sf_dir), raw_accounts(spark, sf_dir))
    told = found.report()
    orphans = next((int(w.split()[0]) for w in told.warnings if "not among the accounts" in w), 0)
    return spark.createDataFrame([(told.n_posts, told.n_accounts, told.n_skipped, orphans)], "n_posts long, n_accounts long, n_skipped long, orphans long")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'repost' WHEN event_id % 5 = 1 THEN 'reply' WHEN event_id % 5 = 2 THEN 'quote' ELSE 'original' END AS kind FROM events")
def archive_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    row = F.create_map(F.lit("is_retweet"), F.when(k == 0, "TRUE").otherwise("False"), F.lit("in_reply_to_tweetid"), F.when(k < 2, "9").otherwise(" "), F.lit("quoted_tweet_tweetid"), F.when(k < 3, "8"))
    return b.read(spark, sf_dir, "events").select("event_id", F.element_at(archive_role(row), "kind").alias("kind"))


@query("SELECT user_id::VARCHAR AS userid, arg_min(event_type, event_id) AS handle FROM events GROUP BY 1")
def archive_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.read(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.create_map(F.lit("userid"), F.col("user_id").cast("string"), F.lit("user_screen_name"), F.col("event_type")).alias("row"), F.lit(None).cast("string").alias("problem"))
    return accounts_from_posts(rows).select(F.element_at("row", "userid").alias("userid"), F.element_at("row", "user_screen_name").alias("handle"))


_NAMES = [(n, "automated") for n in AUTOMATED] + [(n, "organic") for n in ORGANIC] + [("1", "automated"), ("0", "organic"), ("cyborg", None), ("botany", None)]
_CLASSES = ", ".join(f"({k}, '{n}', {f"'{label}'" if label else 'NULL'})" for k, (n, label) in enumerate(_NAMES))


@query(f"SELECT c_custkey, label FROM customer JOIN (VALUES {_CLASSES}) t(nth, name, label) ON nth = c_custkey % {len(_NAMES)}")
def annotation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _ in _NAMES))
    name = F.element_at(names, (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    written = F.when(F.col("c_custkey") % 3 == 0, F.upper(name)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.replace(name, F.lit("_"), F.lit("-")))).otherwise(F.when(name.isin("1", "0", "cyborg", "botany"), name).otherwise(F.concat(name, F.lit("_7"))))
    return b.read(spark, sf_dir, "customer").select("c_custkey", normalised_class(written, "1_is_bot").alias("label"))


@query("SELECT event_id, epoch_us(CASE event_id % 6 WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END) AS at FROM events")
def timestamp_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadence.functions.timestamps import parsed

    at = F.col("ts").cast("timestamp")
    layouts = ("yyyy/MM/dd HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'", "dd/MM/yyyy'T'HH:mm:ss", "E MMM dd HH:mm:ss '+0000' yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm")
    written = F.coalesce(*(F.when(F.col("event_id") % 6 == k, F.date_format(at, x)) for k, x in enumerate(layouts)))
    rows = b.read(spark, sf_dir, "events").select("event_id", written.alias("written"))
    instant, _ = parsed(F.col("written"), assume_offset_hours=0, date_order="dmy")
    return rows.select("event_id", F.unix_micros(instant).alias("at"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_name END AS handle, CASE WHEN c_custkey % 4 <> 0 THEN 'x' END AS filled, CASE WHEN c_nationkey <> 0 THEN round(c_custkey / c_nationkey::DOUBLE, 9) END AS ratio, round(least((c_custkey % 9) / greatest(ceil(c_custkey % 7 / 2.0), 1), 1), 9)::DOUBLE AS active FROM customer")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    handle = F.when(k % 3 == 0, F.concat(F.lit(" @"), "c_name")).when(k % 3 == 1, F.concat(F.lit("@@"), "c_name", F.lit(" "))).otherwise(" @ ")
    found = b.read(spark, sf_dir, "customer").select("c_custkey", normalised_handle(handle).alias("handle"), blank_to_null(F.when(k % 4 == 0, "  ").otherwise(" x ")).alias("filled"), safe_ratio(k, F.col("c_nationkey")).alias("ratio"), active_days_ratio(k % 9, (k % 7) / 2.0).cast("double").alias("active"))
    return rounded(found)


# Files: written to the shared folder, read again, and held against the table they came from.


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cadence-files-{uuid.uuid4().hex}"


def post_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a file: texts with line breaks, quotes and separators."""
    return b.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then\n'), "o_orderstatus", F.lit("\tmore")).alias("message"),
    )


_POSTS = "SELECT o_orderkey::VARCHAR AS post_id, o_custkey::VARCHAR AS account_id, epoch_us(date_trunc('second', o_orderdate)) AS created, 'say \"' || o_orderpriority || '\", then' || chr(10) || o_orderstatus || chr(9) || 'more' AS text FROM orders"


def as_posts(found: DataFrame) -> DataFrame:
    return found.select("post_id", "account_id", F.unix_micros("created_at").alias("created"), "text")


@query(_POSTS)
def csv_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/posts.csv"
    post_table(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    adapter = AdapterRegistry((ArchiveAdapter("d"), NativeAdapter())).detect(path)
    return as_posts(adapter.load(spark, path).corpus.posts)


@query(_POSTS)
def tsv_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/posts.tsv"
    post_table(spark, sf_dir).write.option("header", True).option("escape", '"').option("sep", "\t").csv(path)
    return as_posts(NativeAdapter().load_tables(spark, path).corpus.posts)


@query(_POSTS)
def json_lines_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/posts.jsonl"
    post_table(spark, sf_dir).write.json(path)
    return as_posts(NativeAdapter().load(spark, path).corpus.posts)


@query("SELECT event_id::VARCHAR AS post_id, user_id::VARCHAR AS account_id, epoch_us(ts) AS created, '' AS text FROM events")
def cached_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_corpus(b.corpus(spark, sf_dir), folder(spark))
    return as_posts(read_corpus(spark, path).posts)


@query("SELECT s_suppkey::VARCHAR AS post_id, s_nationkey::VARCHAR AS account_id, epoch_us(TIMESTAMP '2024-01-01' + to_minutes(s_suppkey)) AS created, s_name AS text FROM supplier")
def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus as one object; the driver writes it, so it is made of the small table of suppliers."""
    import os

    posts = b.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("post_id"), F.col("s_nationkey").cast("string").alias("account_id"), F.lit("generic").alias("platform"), b.after(b.ORIGIN, F.col("s_suppkey"), 60_000_000).alias("created_at"), F.col("s_name").alias("text"), F.lit("original").alias("kind"))
    corpus = build_corpus(posts.select("account_id", "platform").distinct(), posts, source="origin")
    path = folder(spark).removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return as_posts(NativeAdapter().load(spark, write_corpus_json(corpus, f"{path}/corpus.json")).corpus.posts)


@query("SELECT c_custkey::VARCHAR AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'automated' ELSE 'organic' END AS label, 'set' AS dataset FROM customer")
def annotation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/labels.csv"
    k = F.col("c_custkey")
    wide = [F.lit("0").alias(f"x{n}") for n in range(40)]
    b.read(spark, sf_dir, "customer").select(k.cast("string").alias("user_id"), *wide, F.when(k % 2 == 0, "Bot").otherwise("human").alias("label")).coalesce(1).write.option("header", True).csv(path)
    return read_labels(spark, path, dataset="set").select("account_id", "label", "dataset")


@query("SELECT o_orderkey::VARCHAR AS post_id, CASE o_orderkey % 2 WHEN 0 THEN 'repost' ELSE 'original' END AS kind, o_custkey::VARCHAR AS account_id, 'info_operation' AS label FROM orders")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/set_tweets.csv"
    k = F.col("o_orderkey")
    rows = b.read(spark, sf_dir, "orders").select(k.cast("string").alias("tweetid"), F.col("o_custkey").cast("string").alias("userid"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm").alias("tweet_time"), F.lit("t").alias("tweet_text"), (k % 2 == 0).cast("string").alias("is_retweet"), F.lit("n").alias("user_screen_name"))
    rows.write.option("header", True).csv(path)
    adapter = AdapterRegistry((ArchiveAdapter("set"), NativeAdapter())).detect(path)
    corpus = adapter.load(spark, path).corpus
    return corpus.posts.select("post_id", "kind", "account_id").join(corpus.labels.select("account_id", "label"), "account_id").select("post_id", "kind", "account_id", "label")


@query("SELECT 'c_custkey' AS name, 'account_id' AS field, 0 AS empty, 2 AS shown UNION ALL SELECT 'c_name', 'handle', 0, 2 UNION ALL SELECT 'c_mktsegment', NULL, 0, 2")
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/accounts.csv"
    aliases = {"account_id": ("c_custkey",), "handle": ("c_name",)}
    b.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").coalesce(1).write.option("header", True).csv(path)
    found = inspect_file(spark, path, kind="accounts", config=MappingConfig(account_aliases=aliases))
    assert found.usable
    return spark.createDataFrame([(c.name, c.field, c.empty, min(2, len(c.examples))) for c in found.columns], "name string, field string, empty int, shown int")


@query("SELECT c_custkey::VARCHAR AS account_id, c_acctbal AS balance FROM customer")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_features(b.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.col("c_acctbal").alias("balance")), folder(spark))
    return spark.read.schema("account_id string, balance double").option("header", True).csv(path)


# The corpus and its labels.


@query("SELECT event_id::VARCHAR AS post_id, (SELECT count(*) FROM customer) AS accounts FROM events WHERE event_type = 'view'")
def filtered_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.corpus(spark, sf_dir)
    kinds = b.read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").cast("string").alias("post_id"), F.lit("view").alias("client"))
    told = corpus.posts.drop("client").join(kinds, "post_id", "left")
    kept = build_corpus(corpus.accounts, told).filter_posts(F.col("client") == "view")
    n = kept.accounts.agg(F.count(F.lit(1)).alias("accounts"))
    return kept.posts.select("post_id", F.lit(1).alias("_one")).join(n.withColumn("_one", F.lit(1)), "_one").select("post_id", "accounts")


@query("SELECT user_id::VARCHAR AS account_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id::VARCHAR) AS posts FROM events GROUP BY 1")
def grouped_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.corpus(spark, sf_dir).posts_by_account()
    return found.select("account_id", F.array_join(F.transform("posts", lambda p: p["post_id"]), ",").alias("posts"))


@query("SELECT c_custkey::VARCHAR AS account_id, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS hidden FROM customer")
def pseudonymised_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = b.read(spark, sf_dir, "customer").select(k.cast("string").alias("account_id"), F.when(k % 3 == 0, k.cast("string")).alias("handle"), F.when(k % 5 == 0, k.cast("string")).otherwise("n").alias("display_name"))
    return rows.select("account_id", account.pseudonymised_identity().alias("hidden"))


_OFFERED = "SELECT c_custkey, c_custkey::VARCHAR AS account_id, CASE WHEN c_acctbal > 0 THEN 'automated' ELSE 'organic' END AS label FROM customer"


@query(f"SELECT account_id, label FROM ({_OFFERED}) SEMI JOIN (SELECT user_id AS c_custkey FROM events UNION SELECT c_custkey FROM customer) USING (c_custkey)")
def replaced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a second file of the same dataset win over the first ones."""
    corpus = b.corpus(spark, sf_dir)
    second = corpus.labels.drop("label").join(b.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.when(F.col("c_acctbal") > 0, "automated").otherwise("organic").alias("label")), "account_id")
    attached, _ = labels.attach_labels(corpus, second)
    return attached.labels.select("account_id", "label")


@query("SELECT c_custkey::VARCHAR AS account_id, 'organic' AS label, 'outside_task' AS other FROM customer")
def last_label_of_an_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets for each account: the one that was attached last counts in training."""
    corpus = b.corpus(spark, sf_dir)
    second = corpus.labels.withColumn("dataset", F.lit("another")).withColumn("label", F.lit("organic"))
    third = corpus.labels.withColumn("dataset", F.lit("aaa")).withColumn("label", F.lit("info_operation"))
    attached, _ = labels.attach_labels(corpus, second)
    features = corpus.accounts.select("account_id", F.lit(1.0).alias("f"))
    found = labels.training_rows(features, attached.labels, ["f"]).select("account_id", "label")
    later, _ = labels.attach_labels(attached, third)
    return found.join(labels.training_rows(features, later.labels, ["f"]).select("account_id", F.col("status").alias("other")), "account_id")


_SEEN = "SELECT c_custkey AS k FROM customer UNION SELECT user_id FROM events"


@query(
    f"""WITH l AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT -n_nationkey - 1, 'BUILDING' FROM nation)
SELECT count(*) AS n_labels, count(*) FILTER (WHERE k IN ({_SEEN})) AS n_matched, count(*) FILTER (WHERE k NOT IN ({_SEEN})) AS n_unmatched,
 (SELECT count(*) FROM ({_SEEN}) WHERE k NOT IN (SELECT k FROM l)) AS n_unlabelled_accounts, round(count(*) FILTER (WHERE k IN ({_SEEN})) / count(*), 9) AS match_rate,
 round(least(count(*) FILTER (WHERE k > 0 AND s = 'BUILDING'), count(*) FILTER (WHERE k > 0 AND s = 'MACHINERY')) / count(*) FILTER (WHERE k > 0), 9) AS minority_share, 'set' AS datasets FROM l"""
)
def coverage_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.corpus(spark, sf_dir)
    known = b.read(spark, sf_dir, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").cast("string").alias("account_id"), F.when(F.col("c_mktsegment") == "BUILDING", "automated").otherwise("organic").alias("label"))
    foreign = b.read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("string").alias("account_id"), F.lit("automated").alias("label"))
    told = labels.label_coverage(corpus, known.unionByName(foreign).withColumn("dataset", F.lit("set"))).as_dict()
    row = [told[n] for n in ("n_labels", "n_matched", "n_unmatched", "n_unlabelled_accounts")]
    return rounded(spark.createDataFrame([(*row, told["match_rate"], told["minority_share"], ",".join(told["datasets"]))], "n_labels long, n_matched long, n_unmatched long, n_unlabelled_accounts long, match_rate double, minority_share double, datasets string"))
