"""The queries over the driver's tables, with the SQL they are held against.

Fractions are rounded to nine digits on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.corpus import ACCOUNTS, build_corpus
from cadence.functions.scalar import as_boolean, as_integer, as_list, entropy, quiet_share
from cadence.functions.simhash import fingerprinted
from cadence.functions.timestamps import parsed
from cadence.operators import account, coordination, labels, metrics, temporal
from cadence.plans import bindings as b
from cadence.plans.lineage import cut
from cadence.report import summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 9


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_features(spark, sf_dir)


def profile_sql(posts: str, least: int, factor: float = 0.25) -> str:
    """Temporal features of a relation (account_id, post_id, ts)."""
    hours = ", ".join(f"count(*) FILTER (WHERE h = {h})" for h in range(24))
    bins = ", ".join(f"count(*) FILTER (WHERE bin = {k})" for k in range(temporal.LOG_BINS))
    circle = ", ".join("(" + " + ".join(f"hist[{(s + k) % 24 + 1}]" for k in range(6)) + ")" for s in range(24))

    def evenness(counts: str, width: int) -> str:
        total = f"list_sum({counts})"
        return f"CASE WHEN {total} <= 0 THEN 0.0 ELSE abs(list_sum(list_transform(list_filter({counts}, lambda c: c > 0), lambda c: -(c / {total}) * log2(c / {total})))) / log2({width}) END"

    return f"""
WITH p AS ({posts}), g AS (
  SELECT *, epoch_us(ts) AS us, row_number() OVER w - 1 AS place,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE AS gap
  FROM p WINDOW w AS (PARTITION BY account_id ORDER BY ts, post_id)
), d AS (
  SELECT *, us // 3600000000 % 24 AS h, us // 86400000000 AS day,
    CASE WHEN gap IS NOT NULL THEN least(floor(log2(greatest(gap, 1.0))), 20) END AS bin,
    least({factor} * avg(gap) OVER (PARTITION BY account_id), 3600.0) AS lim
  FROM g
), runs AS (
  SELECT account_id, run, count(*) AS n FROM (
    SELECT account_id, sum(CASE WHEN coalesce(gap, 0) > lim THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY place) AS run
    FROM d WHERE lim > 0)
  GROUP BY 1, 2 HAVING count(*) >= 3
), bursts AS (
  SELECT account_id, sum(n) AS burst_posts, max(n) AS biggest FROM runs GROUP BY 1
), base AS (
  SELECT account_id, count(*) AS n, [{hours}] AS hist, [{bins}] AS bins, median(gap) AS mid,
    count(DISTINCT day) AS days, (max(us) - min(us)) / 86400000000.0::DOUBLE AS span,
    CASE WHEN bool_and(us % 86400000000 = 0) THEN 86400 WHEN bool_and(us % 3600000000 = 0) THEN 3600
      WHEN bool_and(us % 60000000 = 0) THEN 60 ELSE 1 END AS res
  FROM d GROUP BY 1
), features AS (
  SELECT account_id,
    CASE WHEN n >= {least} THEN {evenness("hist", 24)} END AS temp_circadian_entropy,
    CASE WHEN n >= {least} THEN list_min([{circle}]) / n END AS temp_quiet_hours_share,
    CASE WHEN n >= {least} THEN least(days / greatest(ceil(span), 1), 1.0) END AS temp_active_days_ratio,
    CASE WHEN n >= {least} AND res <= 3600 THEN {evenness("bins", temporal.LOG_BINS)} END AS temp_interarrival_entropy,
    CASE WHEN n >= {least} AND res <= 3600 THEN mid END AS temp_median_interarrival_seconds,
    CASE WHEN n >= {least} AND res <= 3600 THEN coalesce(burst_posts, 0) / n END AS temp_burst_share,
    CASE WHEN n >= {least} AND res <= 3600 THEN coalesce(biggest, 0) END AS temp_max_burst_size
  FROM base LEFT JOIN bursts USING (account_id)
)"""


TEMPORAL = tuple(s.name for s in temporal.SPECS)
_ROUNDED = ", ".join(f"round({c}::DOUBLE, {DIGITS}) AS {c}" for c in TEMPORAL)
_EVENTS = "SELECT user_id::VARCHAR AS account_id, event_id::VARCHAR AS post_id, ts FROM events"
_ORDERS = "SELECT o_custkey::VARCHAR AS account_id, o_orderkey::VARCHAR AS post_id, o_orderdate AS ts FROM orders"
_ACCOUNTS = "SELECT c_custkey::VARCHAR AS account_id FROM customer"


@query(f"{profile_sql(_EVENTS, 20)} SELECT account_id, {_ROUNDED} FROM features")
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.features(temporal.profiles(b.event_posts(spark, sf_dir))))


@query(f"{profile_sql(_ORDERS, 10)} SELECT account_id, {_ROUNDED} FROM features")
def temporal_features_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = temporal.TemporalConfig(min_posts=10)
    return rounded(temporal.features(temporal.profiles(b.order_posts(spark, sf_dir), config), config))


_ORIGINALS = f"{_EVENTS} WHERE event_type <> 'error'"


@query(f"{profile_sql(_ORIGINALS, 20)} SELECT account_id, {_ROUNDED} FROM features")
def temporal_features_without_reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = temporal.TemporalConfig(include_reposts=False)
    return rounded(temporal.features(temporal.profiles(b.event_posts(spark, sf_dir), config), config))


@query(
    """SELECT user_id::VARCHAR AS account_id, event_id::VARCHAR AS post_id,
 (row_number() OVER w - 1)::INTEGER AS place,
 (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE AS gap
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR)"""
)
def post_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_gaps(b.event_posts(spark, sf_dir)).select("account_id", "post_id", "place", "gap")


@query(
    f"""WITH p AS ({_EVENTS}), g AS (
 SELECT account_id, row_number() OVER w - 1 AS place, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE AS gap
 FROM p WINDOW w AS (PARTITION BY account_id ORDER BY ts, post_id)
), d AS (SELECT *, least(0.25 * avg(gap) OVER (PARTITION BY account_id), 3600.0) AS lim FROM g
), r AS (SELECT *, sum(CASE WHEN coalesce(gap, 0) > lim THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY place) AS run FROM d WHERE lim > 0)
SELECT account_id, min(place)::INTEGER AS start, (max(place) + 1)::INTEGER AS stop FROM r GROUP BY account_id, run HAVING count(*) >= 3"""
)
def burst_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.bursts(temporal.with_gaps(b.event_posts(spark, sf_dir)))


@query(
    """WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 % 24 AS h FROM events),
 c AS (SELECT event_type, """
    + ", ".join(f"count(*) FILTER (WHERE h = {k}) AS h{k}" for k in range(24))
    + """, count(*) AS n FROM h GROUP BY 1)
SELECT event_type, n, round(least("""
    + ", ".join("(" + " + ".join(f"h{(s + k) % 24}" for k in range(6)) + ")" for s in range(24))
    + """) / n, 9) AS quiet_share FROM c"""
)
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.pmod(F.floor(F.unix_micros(b.utc("ts")) / 3_600_000_000), F.lit(24))
    counts = F.array(*(F.count_if(hour == h) for h in range(24)))
    found = b.read(spark, sf_dir, "events").groupBy("event_type").agg(counts.alias("hist"), F.count(F.lit(1)).alias("n"))
    return rounded(found.select("event_type", "n", quiet_share(F.col("hist")).alias("quiet_share")))


_FIRST = "SELECT user_id::VARCHAR AS account_id, min(ts) AS first_post FROM events GROUP BY 1"


@query(
    f"""WITH a AS (
 SELECT c_custkey::VARCHAR AS account_id, c_name AS handle, TIMESTAMP '2022-01-01' + to_hours(c_custkey) AS created,
  CASE WHEN c_custkey % 4 <> 0 THEN 1 ELSE 0 END AS described,
  CASE WHEN c_custkey % 5 <> 0 THEN abs(floor(c_acctbal)) END AS followers, c_custkey % 7 * 10 AS following, c_custkey % 11 AS posts
 FROM customer
), f AS ({_FIRST}), j AS (
 SELECT *, (epoch_us(TIMESTAMP '2025-01-01') - epoch_us(created)) / 86400000000.0::DOUBLE AS age FROM a LEFT JOIN f USING (account_id)
), e AS (
 SELECT account_id, sum(-(c / t) * log2(c / t)) / log2(any_value(k)) AS entropy FROM (
  SELECT account_id, ch, count(*) AS c, sum(count(*)) OVER (PARTITION BY account_id) AS t, count(*) OVER (PARTITION BY account_id) AS k
  FROM (SELECT account_id, unnest(string_split(lower(handle), '')) AS ch FROM a) GROUP BY 1, 2) GROUP BY 1
), known AS (SELECT account_id FROM a UNION SELECT user_id::VARCHAR FROM events)
SELECT account_id, round(age, 9) AS acct_age_days,
 round(CASE WHEN age <> 0 THEN posts / age END, 9) AS acct_posts_per_day,
 round(length(regexp_replace(handle, '[^0-9]', '', 'g')) / length(handle)::DOUBLE, 9) AS acct_handle_digit_ratio,
 length(regexp_extract(handle, '([0-9]*)$', 1))::DOUBLE AS acct_handle_trailing_digits,
 round(entropy, 9) AS acct_handle_entropy,
 round(CASE WHEN followers + following <> 0 THEN followers / (followers + following)::DOUBLE END, 9) AS acct_followback_ratio,
 round((2 + described) / 3.0::DOUBLE, 9) AS acct_profile_completeness,
 round(CASE WHEN first_post IS NOT NULL THEN greatest((epoch_us(first_post) - epoch_us(created)) / 86400000000.0::DOUBLE, 0.0) END, 9) AS acct_dormancy_days
FROM known LEFT JOIN j USING (account_id) LEFT JOIN e USING (account_id)"""
)
def account_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(account.AccountExtractor().extract(b.corpus(spark, sf_dir)))


@query(
    f"""SELECT (SELECT count(*) FROM events) AS n_posts, 'generic' AS platforms,
 (SELECT epoch_us(min(ts)) FROM events) AS first_post, (SELECT epoch_us(max(ts)) FROM events) AS last_post,
 (SELECT count(*) FROM ({_ACCOUNTS})) AS n_accounts, (SELECT count(*) FROM customer) AS n_labels,
 (SELECT count(*) FROM events WHERE user_id::VARCHAR NOT IN ({_ACCOUNTS})) AS n_orphan_posts,
 (SELECT count(*) FROM ({_ACCOUNTS}) WHERE account_id NOT IN (SELECT user_id::VARCHAR FROM events)) AS n_silent_accounts"""
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.corpus(spark, sf_dir).summary()
    return found.withColumn("platforms", F.array_join("platforms", ",")).withColumn("first_post", F.unix_micros("first_post")).withColumn("last_post", F.unix_micros("last_post"))


@query(f"SELECT event_id::VARCHAR AS post_id, user_id::VARCHAR AS account_id FROM events WHERE user_id::VARCHAR NOT IN ({_ACCOUNTS})")
def orphan_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.corpus(spark, sf_dir).orphan_posts().select("post_id", "account_id")


@query(f"SELECT account_id FROM ({_ACCOUNTS}) WHERE account_id NOT IN (SELECT user_id::VARCHAR FROM events)")
def silent_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.corpus(spark, sf_dir).silent_accounts()


@query(f"{_ACCOUNTS} UNION SELECT user_id::VARCHAR FROM events")
def account_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.corpus(spark, sf_dir).spine()


_SEGMENT = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(
    f"""SELECT (SELECT count(*) FROM ({_SEGMENT})) AS n_accounts,
 (SELECT count(*) FROM events WHERE user_id IN ({_SEGMENT})) AS n_posts,
 (SELECT count(*) FROM ({_SEGMENT})) AS n_labels"""
)
def corpus_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = b.read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("account_id"))
    return b.corpus(spark, sf_dir).subset(some).summary().select("n_accounts", "n_posts", "n_labels")


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS from_second FROM events GROUP BY 1")
def corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = b.corpus(spark, sf_dir)
    kinds = b.read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("post_id"), "event_type")
    posts = b.event_posts(spark, sf_dir).withColumn("text", F.lit("second")).join(kinds.filter("event_type = 'click'"), "post_id", "left_semi")
    merged = first.merge(build_corpus(first.accounts, posts)).posts
    return merged.join(kinds, "post_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "second").alias("from_second"))


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS measured, count(*) - count({c}) AS missing, round(count({c}) / count(*), 9) AS coverage, "
    + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 9) AS {n}" for q, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90")))
    + " FROM features"
    for c in TEMPORAL
)


@query(f"{profile_sql(_EVENTS, 20)} {_STATS}")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = temporal.features(temporal.profiles(b.event_posts(spark, sf_dir)))
    return rounded(summary.summarise_features(features, TEMPORAL))


_LABELS = """SELECT c_custkey::VARCHAR AS account_id,
 CASE WHEN c_custkey % 10 = 9 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'automated' ELSE 'organic' END AS label
 FROM customer"""
_KNOWN = f"{_ACCOUNTS} UNION SELECT user_id::VARCHAR FROM events"


@query(f"SELECT label, count(*) AS n, count(k.account_id) AS n_matched FROM ({_LABELS}) l LEFT JOIN ({_KNOWN}) k USING (account_id) GROUP BY 1")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.corpus(spark, sf_dir)
    return labels.coverage_table(corpus.spine(), corpus.labels)


@query(f"SELECT account_id, label FROM ({_LABELS}) SEMI JOIN ({_KNOWN}) USING (account_id)")
def attached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.corpus(spark, sf_dir)
    attached, _ = labels.attach_labels(corpus, corpus.labels)
    return attached.labels.select("account_id", "label")


@query(
    f"""{profile_sql(_EVENTS, 20)}, l AS ({_LABELS}), s AS (
 SELECT CASE WHEN label IS NULL THEN 'unlabelled' WHEN label NOT IN ('automated', 'organic') THEN 'outside_task'
  WHEN coalesce({", ".join(TEMPORAL)}) IS NULL THEN 'no_measurable_features' END AS status,
  CASE label WHEN 'automated' THEN 1 WHEN 'organic' THEN 0 END AS target
 FROM features LEFT JOIN l USING (account_id))
SELECT status, target, count(*) AS n FROM s GROUP BY 1, 2"""
)
def training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = temporal.features(temporal.profiles(b.event_posts(spark, sf_dir)))
    rows = labels.training_rows(features, b.planted_labels(spark, sf_dir), list(TEMPORAL))
    return rows.groupBy("status", "target").agg(F.count(F.lit(1)).alias("n"))


_SCORED = "SELECT quality AS target, (n_chars % 101) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id)"
_EDGES = "CASE " + " ".join(f"WHEN p <= {(k + 1) / 10} THEN {k}" for k in range(10)) + " END"


@query(f"SELECT {_EDGES}::INTEGER AS bin, count(*) AS n, round(avg(p), 9) AS predicted, round(avg(target), 9) AS observed FROM ({_SCORED}) WHERE p > 0 GROUP BY 1")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(b.scored_documents(spark, sf_dir)))


@query(f"SELECT round(sum(n * abs(o - q)) / (SELECT count(*) FROM ({_SCORED})), 9) AS ece FROM (SELECT count(*) AS n, avg(p) AS q, avg(target) AS o FROM ({_SCORED}) WHERE p > 0 GROUP BY {_EDGES})")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.expected_calibration_error(b.scored_documents(spark, sf_dir)))


@query(
    f"""WITH s AS ({_SCORED}), c AS (SELECT p, sum(target) AS pos, sum(1 - target) AS neg FROM s GROUP BY 1),
 r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc,
 round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS average_precision,
 (SELECT round(avg((p - target) ** 2), 9) FROM s) AS brier, round(sum(pos) / (sum(pos) + sum(neg)), 9) AS base_rate FROM r"""
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ranking(b.scored_documents(spark, sf_dir)))


@query(
    f"""WITH s AS (SELECT target, (p >= 0.5)::INTEGER AS said FROM ({_SCORED})), k AS (SELECT unnest([0, 1]) AS class),
 c AS (SELECT class, count(*) FILTER (WHERE said = class AND target = class) AS tp, count(*) FILTER (WHERE said = class) AS claimed,
  count(*) FILTER (WHERE target = class) AS support FROM s, k GROUP BY 1)
SELECT class, round(tp / claimed, 9) AS precision, round(tp / support, 9) AS recall,
 round(coalesce(2 * (tp / claimed) * (tp / support) / (tp / claimed + tp / support), 0), 9) AS f1, support FROM c"""
)
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class(b.scored_documents(spark, sf_dir)))


@query(f"WITH e AS (SELECT unnest(range(10))::INTEGER AS bin), c AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n FROM ({_SCORED}) GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (bin)")
def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(b.scored_documents(spark, sf_dir))


@query(f"SELECT count(*) AS n, round(quantile_cont(p, 0.1), 9) AS p10, round(quantile_cont(p, 0.5), 9) AS median, round(quantile_cont(p, 0.9), 9) AS p90 FROM ({_SCORED})")
def probability_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.probability_summary(b.scored_documents(spark, sf_dir)).drop("mean_spread"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 3 THEN epoch_us(date_trunc('second', ts))
  WHEN 2 THEN CASE WHEN day(ts) > 12 THEN NULL END END::BIGINT AS at,
 CASE event_id % 5 WHEN 1 THEN 'naive_timestamp' WHEN 2 THEN CASE WHEN day(ts) > 12 THEN 'naive_timestamp' ELSE 'ambiguous_date' END WHEN 4 THEN 'ValueError' END AS reason
 FROM events"""
)
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("at")
    layouts = {
        0: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        1: F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
        2: F.date_format(at, "dd/MM/yyyy HH:mm"),
        3: F.floor(F.unix_micros(b.utc("ts")) / 1_000_000).cast("string"),
    }
    written = F.lit("nonsense")
    for k, layout in layouts.items():
        written = F.when(F.col("event_id") % 5 == k, layout).otherwise(written)
    rows = b.read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).select("event_id", written.alias("written"))
    instant, reason = parsed(F.col("written"))
    return rows.select("event_id", F.unix_micros(instant).alias("at"), reason.alias("reason"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey END AS whole,
 CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, 'a,b,' || c_custkey::VARCHAR AS items FROM customer"""
)
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = key.cast("string")
    number = F.when(key % 4 == 0, text).when(key % 4 == 1, F.concat(text, F.lit(".0"))).when(key % 4 == 2, F.concat(F.lit(" "), text, F.lit(" "))).otherwise("n/a")
    word = F.when(key % 3 == 0, " Yes ").when(key % 3 == 1, "F").otherwise("maybe")
    items = F.when(key % 3 == 0, F.concat(F.lit('["a", "b", "'), text, F.lit('"]'))).when(key % 3 == 1, F.concat(F.lit("[a, 'b', "), text, F.lit("]"))).otherwise(F.concat(F.lit("a | b||"), text))
    rows = b.read(spark, sf_dir, "customer").select("c_custkey", number.alias("n"), word.alias("w"), items.alias("i"))
    return rows.select("c_custkey", as_integer(F.trim("n")).alias("whole"), as_boolean(F.col("w")).alias("flag"), F.array_join(as_list(F.col("i")), ",").alias("items"))


@query(
    """SELECT c_mktsegment, round(abs(sum(-(c / t) * log2(c / t))) / log2(any_value(k)), 9) AS evenness FROM (
 SELECT c_mktsegment, c_nationkey, count(*) AS c, sum(count(*)) OVER (PARTITION BY c_mktsegment) AS t, count(*) OVER (PARTITION BY c_mktsegment) AS k
 FROM customer GROUP BY 1, 2) GROUP BY 1"""
)
def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.read(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    return rounded(counts.groupBy("c_mktsegment").agg(entropy(F.collect_list("c")).alias("evenness")))


COPOSTING = coordination.CoordinationConfig(window_seconds=360 * 60.0)


def _result(spark: SparkSession, sf_dir: str, permutations: int = 0) -> coordination.CoordinationResult:
    corpus = build_corpus(spark.createDataFrame([], ACCOUNTS), b.document_posts(spark, sf_dir))
    return coordination.detect(corpus, COPOSTING, permutations=permutations, check_budget=False)


@query()
def simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(b.read(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def coposting_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut(coordination.eligible(b.document_posts(spark, sf_dir), COPOSTING))
    return coordination.edges(coordination.pairs(records, COPOSTING), COPOSTING).drop("examples")


@query()
def coposting_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination.features(_result(spark, sf_dir))


@query()
def coposting_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).clusters.drop("examples")


@query()
def coposting_null_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut(coordination.eligible(b.document_posts(spark, sf_dir), COPOSTING))
    return coordination.null_model(records, COPOSTING)

