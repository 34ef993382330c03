"""Near-duplicate, near-simultaneous publishing: evidence, graph, communities, null model.

Posts meet in their time bucket and the next one: these are dealt to tasks by bucket, and pairs of
near fingerprints are found there in numpy (``functions.meeting``), so only pairs that are evidence
leave a task.  Crowded buckets are dealt by choices of bands besides.

Fingerprints, evidence and edges are each written once and read by all that follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import meeting
from cadence.functions.meeting import BAND_BITS, BANDS
from cadence.functions.scalar import band
from cadence.functions.simhash import fingerprinted
from cadence.operators.features import FeatureSpec
from cadence.operators.louvain import communities
from cadence.plans.lineage import cut, scratch
from cadence.plans.order import numbered

EXAMPLES = 3
#: Posts of a bucket beyond which it is dealt by choices of bands too.
CROWD = 100_000
#: Posts of all permutations that a round of the null model has; it has one permutation at least.
ROUND = 6_000_000
CAVEAT = "Coincidence in text and time is not proof of a common plan: news, slogans and share buttons produce it too."


class CandidateBudgetError(RuntimeError):
    """More candidate comparisons than the configuration allows."""


@dataclass(frozen=True)
class CoordinationConfig:
    window_seconds: float = 900.0
    max_hamming: int = 6
    shingle_size: int = 5
    min_chars: int = 30
    include_reposts: bool = False
    exclude_same_thread: bool = True
    min_edge_weight: int = 2
    min_cluster_size: int = 3
    resolution: float = 1.0
    seed: int = 20240301
    max_candidate_pairs: int = 5_000_000

    def __post_init__(self) -> None:
        if self.window_seconds <= 0:
            raise ValueError("the window is above 0")
        if not 0 <= self.max_hamming < BANDS:
            raise ValueError(f"max_hamming is from 0 to {BANDS - 1}: beyond it bands could miss pairs")
        if self.shingle_size < 1 or self.min_edge_weight < 1:
            raise ValueError("shingle_size and min_edge_weight are 1 at least")

    def as_dict(self) -> dict:
        return asdict(self)


def eligible(posts: DataFrame, config: CoordinationConfig) -> DataFrame:
    """post_id, account_id, micros, root and fingerprint of the posts that may match."""
    if not config.include_reposts:
        posts = posts.filter("kind <> 'repost'")
    rows = posts.select("post_id", "account_id", F.unix_micros("created_at").alias("micros"), F.col("root_post_id").alias("root"), "text")
    return fingerprinted(rows, config.shingle_size).filter(F.col("norm_length") >= config.min_chars).drop("norm_length")


def _bucket(micros: Column, config: CoordinationConfig) -> Column:
    return F.floor(micros / (config.window_seconds * 1e6)).cast("long")


def band_keys(fingerprint: Column, max_hamming: int) -> Column:
    """An array of (band, value) of which two fingerprints that are near enough share one at least."""
    one = [band(fingerprint, b, BAND_BITS) for b in range(BANDS)]
    if BANDS - max_hamming < 2:
        return F.array(*(F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in enumerate(one)))
    two = combinations(range(BANDS), 2)
    return F.array(*(F.struct(F.lit(k).alias("band"), F.shiftleft(one[a], BAND_BITS).bitwiseOR(one[b]).alias("value")) for k, (a, b) in enumerate(two)))


def _dealt(records: DataFrame, config: CoordinationConfig, keys: Sequence[str], columns: Sequence[str], crowd: int | None = None) -> DataFrame:
    """The posts by ``probe``: each in its own bucket, where it is late, and in the next; sorted in tasks.

    Buckets of over ``crowd`` posts come in parts: a post is in one for each choice of bands and the
    value that it has there.
    """
    spots = records.filter("fingerprint is not null and micros is not null").select(*keys, *columns, _bucket(F.col("micros"), config).alias("bucket"))
    probe = F.explode(F.array("bucket", F.col("bucket") + 1)).alias("probe")
    rows = spots.select("*", probe).select(*keys, "probe", F.lit(-1).alias("part"), (F.col("bucket") == F.col("probe")).alias("late"), *columns)
    if crowd is not None:
        full = spots.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
        full = cut(full.select(*keys, probe).distinct())
        if not full.isEmpty():
            near = F.transform(band_keys(F.col("fingerprint"), config.max_hamming), lambda b: F.shiftleft(b["band"], 2 * BAND_BITS).bitwiseOR(b["value"].cast("int")))
            parts = F.when(F.col("_full").isNull(), F.array(F.lit(-1))).otherwise(near)
            rows = rows.join(full.withColumn("_full", F.lit(True)), [*keys, "probe"], "left").withColumn("part", F.explode(parts)).drop("_full")
    group = [*keys, "probe", "part"]
    return rows.repartition(*group).sortWithinPartitions(*group)


def pairs(records: DataFrame, config: CoordinationConfig, keys: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """Evidence: earlier and later post, accounts, lag in seconds and similarity, within the window.

    Without keys it also has ``early``, which is true of the first ``EXAMPLES`` rows of two accounts and
    of few others, so that examples can be gathered without the rest.
    """
    rows = _dealt(records, config, keys, ("post_id", "account_id", "micros", "root", "fingerprint"), crowd)
    kinds = {f.name: f.dataType for f in rows.schema}
    sides = [(c, s) for s in "ab" for c in ("post_id", "account_id")]
    numbers = (("at", T.LongType()), ("lag_seconds", T.DoubleType()), ("similarity", T.DoubleType()))
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(f"{c}_{s}", kinds[c]) for c, s in sides] + [T.StructField(n, t) for n, t in numbers])
    keys = list(keys)
    if not keys:
        schema = schema.add("early", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, account, a, b, lag, distance in _met(batches, [*keys, "probe", "part"], config):
            micros, at = table.column("micros").to_numpy(), {"a": pa.array(a), "b": pa.array(b)}
            columns = [table.column(k).take(at["b"]) for k in keys] + [table.column(c).take(at[s]) for c, s in sides]
            columns += [pa.array(micros[b]), pa.array(lag / 1e6), pa.array(1 - distance / 64.0)]
            if not keys:
                columns.append(pa.array(meeting.among_first(meeting.unordered(account[a], account[b]), micros[b], EXAMPLES)))
            yield from pa.table(columns, names=schema.fieldNames()).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _met(batches: Iterator[pa.RecordBatch], group: list[str], config: CoordinationConfig) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The evidence in dealt posts: a table of them, their accounts' codes, earlier and later rows, lags in microseconds, bits that differ."""
    reach, most, apart = config.window_seconds * 1e6, config.max_hamming, config.exclude_same_thread
    for table, starts, sizes in meeting.grouped(batches, group):
        fp = table.column("fingerprint").to_numpy().view(np.uint64)
        late = table.column("late").to_numpy()
        micros = table.column("micros").to_numpy()
        account, root = meeting.codes(table, "account_id"), meeting.codes(table, "root")
        parts = table.column("part").to_numpy()[starts] >> 2 * BAND_BITS
        for a, b, distance in meeting.close(fp, late, starts, sizes, parts, most):
            lag = micros[b] - micros[a]
            kept = (lag >= 0) & (lag <= reach) & (account[a] != account[b]) & (account[a] >= 0) & (account[b] >= 0)
            if apart:
                kept &= (root[a] != root[b]) | (root[a] < 0)
            a, b, lag, distance = a[kept], b[kept], lag[kept], distance[kept]
            tied = np.flatnonzero(lag == 0)
            if len(tied):
                kept = np.ones(len(a), bool)
                kept[tied] = meeting.comes_first(table, "post_id", a[tied], b[tied])
                a, b, lag, distance = a[kept], b[kept], lag[kept], distance[kept]
            if len(a):
                yield table, account, a, b, lag, distance


def weights(records: DataFrame, config: CoordinationConfig, crowd: int = CROWD) -> DataFrame:
    """src, dst, weight, mean_similarity, median_lag_seconds: ``edges`` of ``pairs`` without examples.

    Evidence that is equal but for its posts leaves a task as one row with its number, and no posts do.
    """
    rows = _dealt(records, config, (), ("post_id", "account_id", "micros", "root", "fingerprint"), crowd)
    kind = rows.schema["account_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, account, a, b, lag, distance in meeting.gathered(_met(batches, ["probe", "part"], config)):
            first, n = meeting.counted(meeting.unordered(account[a], account[b]), lag, distance)
            columns = [table.column("account_id").take(pa.array(x[first])) for x in (a, b)]
            columns += [pa.array(lag[first] / 1e6), pa.array(1 - distance[first] / 64.0), pa.array(n)]
            yield from pa.table(columns, names=["account_id_a", "account_id_b", "lag_seconds", "similarity", "n"]).combine_chunks().to_batches()

    evidence = rows.mapInArrow(run, f"account_id_a {kind}, account_id_b {kind}, lag_seconds double, similarity double, n long")
    grouped = evidence.groupBy(F.least("account_id_a", "account_id_b").alias("src"), F.greatest("account_id_a", "account_id_b").alias("dst"))
    mean = F.sum(F.col("similarity") * F.col("n")) / F.sum("n")
    found = grouped.agg(F.sum("n").alias("weight"), mean.alias("mean_similarity"), F.percentile("lag_seconds", 0.5, F.col("n")).alias("median_lag_seconds"))
    return found.filter(F.col("weight") >= config.min_edge_weight)


def compared(records: DataFrame, config: CoordinationConfig) -> DataFrame:
    """comparisons, one row: the pairs of posts in a bucket or its next one that share bands enough to be near."""
    group, least = ["probe", "part"], meeting.shared(config.max_hamming)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for table, starts, sizes in meeting.grouped(batches, group):
            n += meeting.agreeing(table.column("fingerprint").to_numpy().view(np.uint64), table.column("late").to_numpy(), starts, sizes, least)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return _dealt(records, config, (), ("fingerprint",)).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("comparisons"))


def comparisons(records: DataFrame, config: CoordinationConfig) -> int:
    """The number of comparisons."""
    return compared(records, config).first()["comparisons"]


def edges(evidence: DataFrame, config: CoordinationConfig, keys: Sequence[str] = ()) -> DataFrame:
    """src < dst, weight, mean_similarity, median_lag_seconds, examples of pairs with enough evidence."""
    example = F.struct("at", F.col("post_id_b").alias("later"), F.col("post_id_a").alias("earlier"))
    if "early" in evidence.columns:
        example = F.when(F.col("early"), example)
    grouped = evidence.groupBy(*keys, F.least("account_id_a", "account_id_b").alias("src"), F.greatest("account_id_a", "account_id_b").alias("dst"))
    found = grouped.agg(F.count(F.lit(1)).alias("weight"), F.avg("similarity").alias("mean_similarity"), F.median("lag_seconds").alias("median_lag_seconds"), F.slice(F.array_sort(F.collect_list(example)), 1, EXAMPLES).alias("examples"))
    return found.filter(F.col("weight") >= config.min_edge_weight)


def matched_posts(evidence: DataFrame) -> DataFrame:
    """Posts of any evidence, also of pairs that stay below the edge threshold."""
    return evidence.select(F.col("post_id_a").alias("post_id"), F.col("account_id_a").alias("account_id")).union(evidence.select("post_id_b", "account_id_b")).distinct()


@dataclass(frozen=True)
class CoordinationResult:
    """The tables of one analysis; ``membership`` is (account_id, community, cluster_id or NULL)."""

    config: CoordinationConfig
    records: DataFrame
    evidence: DataFrame
    edges: DataFrame
    membership: DataFrame
    clusters: DataFrame
    null_model: DataFrame | None = None
    strategy: str = "shift"
    posts: DataFrame | None = None

    def clustered_accounts(self) -> DataFrame:
        return self.membership.filter("cluster_id is not null").select("account_id", "cluster_id")

    def nodes(self) -> DataFrame:
        return self.records.select("account_id").distinct()

    def stats(self) -> DataFrame:
        """One row: all, eligible and matched posts, comparisons, pairs with evidence, edges, nodes."""
        total = self.records if self.posts is None else self.posts
        pair = F.struct(F.least("account_id_a", "account_id_b"), F.greatest("account_id_a", "account_id_b"))
        parts = [
            total.agg(F.count(F.lit(1)).alias("total_posts")),
            self.records.agg(F.count(F.lit(1)).alias("eligible_posts"), F.count_distinct("account_id").alias("nodes")),
            matched_posts(self.evidence).agg(F.count(F.lit(1)).alias("matched_posts")),
            compared(self.records, self.config),
            self.evidence.agg(F.count_distinct(pair).alias("pairs_with_evidence")),
            self.edges.agg(F.count(F.lit(1)).alias("edges")),
        ]
        out = parts[0].withColumn("_one", F.lit(1))
        for p in parts[1:]:
            out = out.join(p.withColumn("_one", F.lit(1)), "_one")
        return out.drop("_one")

    def as_dict(self) -> dict:
        """What may be published of the analysis: numbers, parameters and the caveat, no account."""
        stats = self.stats().first().asDict()
        null = None if self.null_model is None else null_summary(self.null_model, stats["edges"]) | {"strategy": self.strategy}
        return {"caveat": CAVEAT, "config": self.config.as_dict(), "stats": stats, "clusters": cluster_summary(self.clusters).first().asDict(), "null_model": null}


def numbered_clusters(edge_table: DataFrame, membership: DataFrame, config: CoordinationConfig) -> DataFrame:
    """cluster_id, community, size, members, n_edges, total_weight, density, means, medians, examples.

    Communities are numbered by size and smallest member before small ones are left out.
    """
    sized = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("account_id")).alias("members"))
    named = numbered(sized, [F.desc("size"), F.element_at("members", 1)], "nth").withColumn("cluster_id", F.format_string("c%03d", "nth")).drop("nth")
    ends = membership.select("account_id", "community")
    inside = edge_table.join(ends.withColumnsRenamed({"account_id": "src", "community": "c"}), "src").join(ends.withColumnsRenamed({"account_id": "dst", "community": "d"}), "dst").filter("c = d")
    first = F.slice(F.array_sort(F.collect_list(F.struct("src", "dst", F.element_at("examples", 1).alias("example")))), 1, EXAMPLES)
    summed = inside.groupBy(F.col("c").alias("community")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total_weight"), F.avg("mean_similarity").alias("mean_similarity"), F.median("median_lag_seconds").alias("median_lag_seconds"), F.transform(first, lambda x: x["example"]).alias("examples"))
    density = F.col("n_edges") * 2.0 / (F.col("size") * (F.col("size") - 1))
    return named.hint("merge").join(summed, "community").filter(F.col("size") >= config.min_cluster_size).withColumn("density", density)


def detect(corpus, config: CoordinationConfig = CoordinationConfig(), *, permutations: int = 0, strategy: str = "shift", check_budget: bool = True, records: DataFrame | None = None) -> CoordinationResult:
    """Evidence, edges, communities and clusters of a corpus; with permutations, a null model too.

    ``records`` are the eligible posts of the corpus, if they have been made already.
    """
    records = cut(eligible(corpus.posts, config)) if records is None else records
    if check_budget and comparisons(records, config) > config.max_candidate_pairs:
        raise CandidateBudgetError(f"more than {config.max_candidate_pairs} comparisons; narrow the window or raise the limit")
    evidence = cut(pairs(records, config))
    graph = cut(edges(evidence, config))
    members = cut(communities(graph, config.resolution, config.seed))
    clusters = cut(numbered_clusters(graph, members, config))
    membership = members.join(clusters.select("community", "cluster_id"), "community", "left").select("account_id", "community", "cluster_id")
    null = null_model(records, config, permutations, strategy) if permutations else None
    return CoordinationResult(config, records, evidence, graph, membership, clusters, null, strategy, corpus.posts)


def _unit(*columns: Column) -> Column:
    """A number from 0 to 1 that depends on nothing but the columns: the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *(c.cast("string") for c in columns)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _permuted(records: DataFrame, first: int, permutations: int) -> DataFrame:
    return records.select("*", F.explode(F.sequence(F.lit(first), F.lit(permutations - 1))).alias("perm"))


def shifted(records: DataFrame, permutations: int, seed: int, first: int = 0) -> DataFrame:
    """Each account's posts moved together by up to half the span of all, once per permutation."""
    reach = records.agg((F.max("micros") - F.min("micros")).alias("reach")).first()["reach"] or 0
    move = F.floor((_unit(F.col("account_id"), F.col("perm"), F.lit(seed)) - 0.5) * reach).cast("long")
    return _permuted(records, first, permutations).withColumn("micros", F.col("micros") + move)


def shuffled(records: DataFrame, permutations: int, seed: int, first: int = 0) -> DataFrame:
    """The instants dealt anew among all posts, once per permutation.

    Every permutation has the same number of rows, so a row's number among all of them tells its
    number within its own.
    """
    n = max(1, records.count())
    times = numbered(records.select("post_id", "micros"), [F.col("micros"), F.col("post_id")], "nth").select("nth", "micros")
    draw = _unit(F.col("post_id"), F.col("perm"), F.lit(seed))
    dealt = numbered(_permuted(records.drop("micros"), first, permutations).withColumn("draw", draw), [F.col("perm"), F.col("draw"), F.col("post_id")], "nth").drop("draw")
    found = dealt.withColumn("nth", F.pmod("nth", F.lit(n))).hint("merge").join(times.hint("merge"), "nth")
    return found.select(*records.columns, "perm")


def null_model(records: DataFrame, config: CoordinationConfig, permutations: int = 100, strategy: str = "shift") -> DataFrame:
    """perm, edges: how many edges chance timing gives; permutations without edges count 0.

    ``records`` are read several times, so they should be written already.  Permutations are counted
    in rounds of about ``ROUND`` posts, whose tables don't outlast the round.
    """
    if strategy not in ("shift", "shuffle"):
        raise ValueError("strategy is shift or shuffle")
    spark = records.sparkSession
    at_once = max(1, ROUND // max(1, records.count()))
    counts: dict[int, int] = {}
    for first in range(0, permutations, at_once):
        with scratch(spark):
            moved = (shifted if strategy == "shift" else shuffled)(records, min(first + at_once, permutations), config.seed, first)
            found = edges(pairs(moved, config, ["perm"]), config, ["perm"]).groupBy("perm").agg(F.count(F.lit(1)).alias("edges"))
            counts |= {r["perm"]: r["edges"] for r in found.collect()}
            del moved, found
    return spark.createDataFrame([(k, counts.get(k, 0)) for k in range(permutations)], "perm int, edges long")


def null_summary(null: DataFrame, observed: int) -> dict:
    """Mean edges by chance and the p-value (1 + permutations that reach the observed) / (P + 1)."""
    row = null.agg(F.count(F.lit(1)).alias("n"), F.avg("edges").alias("mean"), F.count_if(F.col("edges") >= observed).alias("reached")).first()
    return {"permutations": row["n"], "mean_edges": row["mean"], "observed_edges": observed, "p_value": (1 + row["reached"]) / (row["n"] + 1)}


def window_sensitivity(corpus, windows: Sequence[float], config: CoordinationConfig = CoordinationConfig(), records: DataFrame | None = None) -> pd.DataFrame:
    """Edges, clusters and clustered accounts for each window length in seconds."""
    out, records = [], cut(eligible(corpus.posts, config)) if records is None else records
    for seconds in windows:
        result = detect(corpus, replace(config, window_seconds=seconds), check_budget=False, records=records)
        row = cluster_summary(result.clusters).first()
        out.append({"window_seconds": seconds, "edges": result.edges.count(), "clusters": row["n_clusters"], "clustered_accounts": row["n_accounts"]})
    return pd.DataFrame(out)


def window_edges(records: DataFrame, windows: Sequence[float], config: CoordinationConfig = CoordinationConfig()) -> list[int]:
    """The number of edges for each window length in seconds.

    The evidence of a window is that of the widest one without longer lags, so it is made once.
    """
    if not windows:
        return []
    evidence = pairs(records, replace(config, window_seconds=max(windows)))
    lag = F.round(F.col("lag_seconds") * 1e6)
    grouped = evidence.groupBy(F.least("account_id_a", "account_id_b").alias("src"), F.greatest("account_id_a", "account_id_b").alias("dst"))
    weights = grouped.agg(*(F.count_if(lag <= w * 1e6).alias(f"_{k}") for k, w in enumerate(windows)))
    return list(weights.agg(*(F.count_if(F.col(f"_{k}") >= config.min_edge_weight) for k in range(len(windows)))).first())


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_accounts"), F.max("size").alias("largest"), F.median("size").alias("median_size"))


def _spec(name: str, description: str, rationale: str, limitation: str, unit: str, maximum: float | None = None) -> FeatureSpec:
    return FeatureSpec(name, "coordination", description, rationale, limitation, unit, 0.0, maximum)


SPECS = (
    _spec("coord_partner_count", "Accounts that publish the same text at the same time repeatedly.", "Repeated agreement with many others is hard to explain by chance alone.", "Fans of one source and news aggregators repeat the same headlines together.", "accounts"),
    _spec("coord_pair_count", "Matching pairs of posts with those accounts.", "The more often two accounts coincide, the less chance explains it.", "Very active accounts coincide more often without any arrangement.", "pairs"),
    _spec("coord_max_similarity", "Highest mean similarity with any of them.", "Copies without a change point to one text that several accounts were given.", "Quotes, slogans and automatic share texts are equal letter by letter.", "ratio", 1.0),
    _spec("coord_median_lag_seconds", "Median over partners of the median lag.", "A steady lag of seconds suggests a common queue or trigger.", "Popular events produce short lags among people who never met.", "seconds"),
    _spec("coord_duplicate_post_ratio", "Share of eligible posts that match another account's.", "An account that mostly repeats others adds reach rather than content.", "Accounts with few long posts get extreme shares from one coincidence.", "ratio", 1.0),
    _spec("coord_cluster_size", "Size of the account's reported cluster, else 1.", "Groups that coincide with each other are more telling than single pairs.", "Community detection always finds groups, and their borders are not sharp.", "accounts"),
    _spec("coord_cluster_density", "Share of possible edges in that cluster, else 0.", "In a dense cluster everybody coincides with everybody, as under one plan.", "Small clusters are dense for lack of members, and hubs thin out large ones.", "ratio", 1.0),
)


class CoordinationExtractor:
    name = "coordination"

    def __init__(self, config: CoordinationConfig = CoordinationConfig()) -> None:
        self.config = config

    def specs(self) -> tuple[FeatureSpec, ...]:
        return SPECS

    def extract(self, corpus, result: CoordinationResult | None = None) -> DataFrame:
        return corpus.spine().join(features(result or detect(corpus, self.config)), "account_id", "left")


def features(result: CoordinationResult) -> DataFrame:
    """The columns for every account with an eligible post; no side of a join goes through the driver."""
    counts = result.records.join(matched_posts(result.evidence).select("post_id", F.lit(1).alias("hit")).hint("merge"), "post_id", "left")
    counts = counts.groupBy("account_id").agg(F.count(F.lit(1)).alias("eligible"), F.count("hit").alias("matched"))
    e = result.edges.select("src", "dst", "weight", "mean_similarity", "median_lag_seconds")
    sides = e.withColumnRenamed("src", "account_id").drop("dst").unionByName(e.withColumnRenamed("dst", "account_id").drop("src"))
    around = sides.groupBy("account_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"), F.max("mean_similarity").alias("best"), F.median("median_lag_seconds").alias("lag"))
    inside = result.clustered_accounts().join(result.clusters.select("cluster_id", "size", "density"), "cluster_id").drop("cluster_id")
    rows = counts.join(around.hint("merge"), "account_id", "left").join(inside.hint("merge"), "account_id", "left")

    def filled(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default))

    return rows.select(
        "account_id",
        filled("degree", 0.0).alias("coord_partner_count"),
        filled("weight", 0.0).alias("coord_pair_count"),
        filled("best", 0.0).alias("coord_max_similarity"),
        F.col("lag").alias("coord_median_lag_seconds"),
        (F.col("matched") / F.col("eligible")).alias("coord_duplicate_post_ratio"),
        filled("size", 1.0).alias("coord_cluster_size"),
        filled("density", 0.0).alias("coord_cluster_density"),
    )
