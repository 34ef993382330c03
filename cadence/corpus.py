"""A corpus: lazy tables of accounts, posts and labels with their provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLATFORMS = ("reddit", "bluesky", "mastodon", "twitter", "facebook", "generic")
KINDS = ("original", "reply", "repost", "quote")
LABELS = ("automated", "info_operation", "organic", "unknown")

ACCOUNTS = """account_id string, platform string, handle string, display_name string, description string,
 location string, url string, language string, created_at timestamp, collected_at timestamp,
 followers_count long, following_count long, post_count long, verified boolean, protected boolean,
 has_default_profile_image boolean, declared_automated boolean, extra map<string,string>"""
POSTS = """post_id string, account_id string, platform string, created_at timestamp, text string,
 language string, parent_post_id string, root_post_id string, client string, kind string,
 urls array<string>, hashtags array<string>, mentions array<string>, media_count long,
 like_count long, repost_count long, reply_count long, collected_at timestamp, extra map<string,string>"""
LABEL_ROWS = """account_id string, platform string, label string, dataset string, method string,
 confidence double, labelled_at timestamp, notes string"""


class OrphanPostsError(ValueError):
    """Posts whose author is not among the accounts, where that is not allowed."""


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with exactly the columns of the schema; what it lacks is NULL."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


ORDINAL = "_ordinal"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with an ordinal: its own if it has one, else the place of a row in the table as it is read.

    Ordinals say which of two rows with one key was given last.  Tables keep theirs until they are
    written, so joins and shuffles in between don't matter.
    """
    return df if ORDINAL in df.columns else df.withColumn(ORDINAL, F.monotonically_increasing_id())


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str = ORDINAL, *, keep: bool = False) -> DataFrame:
    """One row per key: that with the largest ordinal, which ``keep`` keeps, and among equals the largest row."""
    kept = [c for c in df.columns if c not in (*keys, *([] if keep else [ordinal]))]
    plain = [c for c in kept if "map" not in df.schema[c].dataType.simpleString()]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(ordinal, *plain)).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in kept)).select(*(c for c in df.columns if keep or c != ordinal))


@dataclass(frozen=True)
class Corpus:
    accounts: DataFrame
    posts: DataFrame
    labels: DataFrame
    source: str | None = None
    collected_at: str | None = None
    notes: tuple[str, ...] = field(default=())

    @property
    def spark(self) -> SparkSession:
        return self.posts.sparkSession

    def spine(self) -> DataFrame:
        """Every account and every author, once."""
        return self.accounts.select("account_id").union(self.posts.select("account_id")).distinct()

    def orphan_posts(self) -> DataFrame:
        """Posts whose author is not among the accounts."""
        return self.posts.join(self.accounts.select("account_id").distinct(), "account_id", "left_anti")

    def silent_accounts(self) -> DataFrame:
        """Accounts without a post."""
        return self.accounts.select("account_id").distinct().join(self.posts.select("account_id"), "account_id", "left_anti")

    def accounts_by_id(self) -> DataFrame:
        """One row per account id; the last one given wins."""
        return last_wins(numbered(self.accounts), ["account_id"])

    def posts_by_account(self) -> DataFrame:
        """account_id and its posts in canonical order; ``extra`` is a list of entries, since maps have no order."""
        rest = [F.map_entries(c).alias(c) if c == "extra" else F.col(c) for c in self.posts.columns if c not in ("created_at", "post_id", "account_id")]
        return self.posts.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "post_id", *rest))).alias("posts"))

    def labels_by_account(self) -> DataFrame:
        return last_wins(numbered(self.labels), ["account_id"])

    def time_span(self) -> DataFrame:
        return self.posts.agg(F.min("created_at").alias("first_post"), F.max("created_at").alias("last_post"))

    def filter_posts(self, predicate: Column) -> Corpus:
        """The posts that satisfy the predicate; accounts and labels are retained."""
        return replace(self, posts=self.posts.filter(predicate))

    def subset(self, account_ids: DataFrame) -> Corpus:
        """What belongs to the given accounts (a table with account_id)."""
        ids = account_ids.select("account_id").distinct()
        return replace(self, **{n: getattr(self, n).join(ids, "account_id", "left_semi") for n in ("accounts", "posts", "labels")})

    def merge(self, other: Corpus, source: str | None = None) -> Corpus:
        """Both corpora; of rows with the same key the other's wins."""

        def both(name: str, keys: list[str]) -> DataFrame:
            sides = [numbered(getattr(c, name)).withColumn(ORDINAL, F.struct(F.lit(k).alias("side"), F.col(ORDINAL).alias("nth"))) for k, c in enumerate((self, other))]
            return last_wins(sides[0].unionByName(sides[1], allowMissingColumns=True), keys)

        return Corpus(
            both("accounts", ["platform", "account_id"]),
            both("posts", ["platform", "post_id"]),
            both("labels", ["platform", "account_id", "dataset"]),
            source if source is not None else self.source,
            self.collected_at,
        )

    def namespaced(self) -> Corpus:
        """The corpus with ids that carry their platform, so equal ids of two platforms stay apart."""
        put = F.concat_ws(":", "platform", "account_id")
        return replace(self, **{n: getattr(self, n).withColumn("account_id", put) for n in ("accounts", "posts", "labels")})

    def summary(self) -> DataFrame:
        """One row: counts, platforms of posts in order, first and last post, orphans and silent accounts."""
        posts = self.posts.agg(F.count(F.lit(1)).alias("n_posts"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.min("created_at").alias("first_post"), F.max("created_at").alias("last_post"))
        parts = [
            posts,
            self.accounts.agg(F.count(F.lit(1)).alias("n_accounts")),
            self.labels.agg(F.count(F.lit(1)).alias("n_labels")),
            self.orphan_posts().agg(F.count(F.lit(1)).alias("n_orphan_posts")),
            self.silent_accounts().agg(F.count(F.lit(1)).alias("n_silent_accounts")),
        ]
        keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
        out = keyed[0]
        for p in keyed[1:]:
            out = out.join(p, "_one")
        return out.drop("_one")


def build_corpus(accounts: DataFrame, posts: DataFrame, labels: DataFrame | None = None, *, source: str | None = None, collected_at: str | None = None, strict: bool = False) -> Corpus:
    """A corpus of conformed tables; with ``strict``, orphan posts raise."""
    spark = posts.sparkSession
    labels = spark.createDataFrame([], LABEL_ROWS) if labels is None else conformed(labels, LABEL_ROWS)
    corpus = Corpus(conformed(accounts, ACCOUNTS), conformed(posts, POSTS), labels, source, collected_at)
    if strict:
        found = [r["post_id"] for r in corpus.orphan_posts().select("post_id").orderBy("post_id").limit(6).collect()]
        if found:
            more = ", ..." if len(found) > 5 else ""
            raise OrphanPostsError(f"posts whose author is not among the accounts: {', '.join(found[:5])}{more}")
    return corpus
