"""Posting rhythm per account: histogram, gaps, bursts, and the seven temporal features."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalar import active_days_ratio, entropy, log_bin, quiet_share
from cadence.operators.features import FeatureSpec

LOG_BINS = 21
#: Coarser timestamps than this leave sub-daily features unmeasured.
RESOLUTION_LIMIT = 3600


@dataclass(frozen=True)
class TemporalConfig:
    min_posts: int = 20
    quiet_window_hours: int = 6
    burst_factor: float = 0.25
    burst_ceiling_seconds: float = 3600.0
    min_burst_size: int = 3
    include_reposts: bool = True

    def __post_init__(self) -> None:
        if self.min_posts < 2 or self.min_burst_size < 2:
            raise ValueError("min_posts and min_burst_size are 2 at least")
        if not 0 < self.quiet_window_hours < 24:
            raise ValueError("quiet_window_hours is between 0 and 24")
        if self.burst_factor <= 0:
            raise ValueError("burst_factor is above 0")

    def as_dict(self) -> dict:
        return asdict(self)


def with_gaps(posts: DataFrame) -> DataFrame:
    """account_id, post_id, created_at, micros, place (from 0) and gap in seconds to the post before."""
    order = Window.partitionBy("account_id").orderBy("created_at", "post_id")
    rows = posts.select("account_id", "post_id", "created_at").withColumn("micros", F.unix_micros("created_at"))
    return rows.withColumn("place", F.row_number().over(order) - 1).withColumn("gap", (F.col("micros") - F.lag("micros").over(order)) / 1e6)


def bursts(gaps: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    """account_id, start, stop (places, exclusive) of each burst.

    A burst is a run of posts whose gaps stay within a share of the account's mean gap, up to a
    ceiling.  All windows and groups are by account, so the rows are dealt once.
    """
    whole = Window.partitionBy("account_id")
    order = whole.orderBy("place")
    limit = F.least(F.lit(config.burst_factor) * F.avg("gap").over(whole), F.lit(config.burst_ceiling_seconds))
    rows = gaps.withColumn("limit", limit).filter("limit > 0")
    rows = rows.withColumn("run", F.sum((F.coalesce("gap", F.lit(0.0)) > F.col("limit")).cast("int")).over(order))
    runs = rows.groupBy("account_id", "run").agg(F.min("place").alias("start"), (F.max("place") + 1).alias("stop"))
    return runs.filter(F.col("stop") - F.col("start") >= config.min_burst_size).select("account_id", "start", "stop")


def profiles(posts: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    """One row per account with posts: counts, histogram, gap bins, bursts, span and resolution."""
    if not config.include_reposts:
        posts = posts.filter("kind <> 'repost'")
    gaps = with_gaps(posts)
    order = Window.partitionBy("account_id").orderBy("place")
    day = F.floor(F.col("micros") / 86_400_000_000)
    gaps = gaps.withColumn("new_day", F.coalesce((day != F.lag(day).over(order)).cast("int"), F.lit(1)))
    micros = F.col("micros")
    hour = F.pmod(F.floor(micros / 3_600_000_000), F.lit(24))
    bins = log_bin(F.col("gap"))
    base = gaps.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.min("created_at").alias("first_post"),
        F.max("created_at").alias("last_post"),
        F.sum("new_day").alias("active_days"),
        F.array(*(F.count_if(hour == h) for h in range(24))).alias("hour_histogram"),
        F.array(*(F.count_if(bins == b) for b in range(LOG_BINS))).alias("gap_bins"),
        F.median("gap").alias("median_gap_seconds"),
        F.when(F.bool_and(micros % 86_400_000_000 == 0), 86400).when(F.bool_and(micros % 3_600_000_000 == 0), 3600).when(F.bool_and(micros % 60_000_000 == 0), 60).otherwise(1).alias("resolution_seconds"),
    )
    size = F.col("stop") - F.col("start")
    runs = bursts(gaps, config).groupBy("account_id").agg(F.sum(size).alias("burst_posts"), F.max(size).alias("max_burst_size"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("bursts"))
    span = (F.unix_micros("last_post") - F.unix_micros("first_post")) / 86_400_000_000.0
    joined = base.join(runs, "account_id", "left")
    return joined.select(
        *base.columns,
        span.alias("span_days"),
        F.coalesce("burst_posts", F.lit(0)).alias("burst_posts"),
        F.coalesce("max_burst_size", F.lit(0)).alias("max_burst_size"),
        "bursts",
    )


def _spec(name: str, description: str, rationale: str, limitation: str, unit: str = "ratio", maximum: float | None = 1.0, higher: str = "depends") -> FeatureSpec:
    return FeatureSpec(name, "temporal", description, rationale, limitation, unit, 0.0, maximum, higher)


SPECS = (
    _spec("temp_circadian_entropy", "Evenness of posting over the hours of the day.", "People sleep; a schedule that fills all hours alike needs a machine or a team.", "Several people behind one account, or travel, spread the hours as well."),
    _spec("temp_quiet_hours_share", "Share of posts in the quietest six hours in a row.", "A person's quietest run of hours is close to empty; a program's need not be.", "Shift workers and shared accounts fill their quiet hours without any program."),
    _spec("temp_active_days_ratio", "Days with a post over the days the account spans.", "Posting on every single day over a long time is rare for a person.", "Devoted people, and accounts seen for a few days only, reach 1 as well."),
    _spec("temp_interarrival_entropy", "Evenness of gaps over doublings of seconds.", "Timers leave few kinds of gaps, whatever the hour at which they run.", "Random delays added to a timer hide it; rare posters have few gaps to judge by."),
    _spec("temp_median_interarrival_seconds", "Median gap between posts.", "The usual pace tells a scheduled account from one that reacts to events.", "The median hides alternation between silence and activity altogether.", "seconds", None),
    _spec("temp_burst_share", "Share of posts that belong to bursts.", "Batches published at once point to a queue that is emptied by a program.", "Threads and live coverage by people are bursts in just the same way."),
    _spec("temp_max_burst_size", "Posts in the longest burst.", "Very long uninterrupted bursts are tiring for people and free for programs.", "One long thread suffices to raise it, and it grows with the time observed.", "posts", None),
)


class TemporalExtractor:
    name = "temporal"

    def __init__(self, config: TemporalConfig = TemporalConfig()) -> None:
        self.config = config

    def specs(self) -> tuple[FeatureSpec, ...]:
        return SPECS

    def extract(self, corpus) -> DataFrame:
        """Features of every account; NULL where there are too few posts or too coarse timestamps."""
        found = features(profiles(corpus.posts, self.config), self.config)
        return corpus.spine().join(found, "account_id", "left")


def features(profile: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    enough = F.col("n_posts") >= config.min_posts
    fine = enough & (F.col("resolution_seconds") <= RESOLUTION_LIMIT)
    return profile.select(
        "account_id",
        F.when(enough, entropy(F.col("hour_histogram"), 24)).alias("temp_circadian_entropy"),
        F.when(enough, quiet_share(F.col("hour_histogram"), config.quiet_window_hours)).alias("temp_quiet_hours_share"),
        F.when(enough, active_days_ratio(F.col("active_days"), F.col("span_days"))).alias("temp_active_days_ratio"),
        F.when(fine, entropy(F.col("gap_bins"), LOG_BINS)).alias("temp_interarrival_entropy"),
        F.when(fine, F.col("median_gap_seconds")).alias("temp_median_interarrival_seconds"),
        F.when(fine, F.col("burst_posts") / F.col("n_posts")).alias("temp_burst_share"),
        F.when(fine, F.col("max_burst_size").cast("double")).alias("temp_max_burst_size"),
    )
