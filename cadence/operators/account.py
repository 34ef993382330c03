"""Profile features per account."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalar import character_entropy, completeness, days_between, digit_ratio, safe_ratio, trailing_digits
from cadence.operators.features import FeatureSpec

FIELDS = ("display_name", "description", "location", "url")


@dataclass(frozen=True)
class AccountConfig:
    min_handle_length: int = 4
    profile_fields: tuple[str, ...] = FIELDS
    reference_time: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)


def pseudonymised_identity() -> Column:
    """The archive replaced the handle or the name by the id."""
    same = [F.coalesce(F.col("account_id") == F.col(c), F.lit(False)) for c in ("handle", "display_name")]
    return same[0] | same[1]


def available_fields(accounts: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[tuple[str, ...], bool]:
    """Which profile fields any account has, and whether any says something about its avatar."""
    row = accounts.agg(*(F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in (*fields, "has_default_profile_image"))).first()
    return tuple(c for c in fields if row[c]), row["has_default_profile_image"]


def reference_instant(corpus, explicit: str | None = None) -> Column:
    """The instant that ages refer to: given, of the corpus, of the posts' collection, or the last post."""
    given = explicit or corpus.collected_at
    if given:
        return F.lit(given).cast("timestamp")
    row = corpus.posts.agg(F.unix_micros(F.coalesce(F.max("collected_at"), F.max("created_at"))).alias("at")).first()
    return F.timestamp_micros(F.lit(row["at"]).cast("long"))


def _spec(name: str, description: str, rationale: str, limitation: str, unit: str = "ratio", minimum: float | None = 0.0, maximum: float | None = 1.0) -> FeatureSpec:
    return FeatureSpec(name, "account", description, rationale, limitation, unit, minimum, maximum)


SPECS = (
    _spec("acct_age_days", "Days from creation to the reference instant.", "Accounts made shortly before a campaign are often made for that campaign.", "Old accounts are bought and sold, and every honest account has been new once.", "days", None, None),
    _spec("acct_posts_per_day", "Posts over the account's age.", "A rate that nobody could type by hand points to a program that posts.", "The count covers deleted posts and reposts, and a young age inflates the rate.", "posts per day", 0.0, None),
    _spec("acct_handle_digit_ratio", "Share of digits in the handle.", "Handles made in bulk by a generator often end in, or consist of, numbers.", "Platforms suggest numbered handles to people too, and birth years are common."),
    _spec("acct_handle_trailing_digits", "Digits at the end of the handle.", "A long trailing number is the usual mark of an automatically suggested name.", "It is also what a person gets who accepts the first name that was suggested.", "characters", 0.0, None),
    _spec("acct_handle_entropy", "Evenness of the characters of the handle.", "Random strings use their characters more evenly than names and words do.", "Short handles are even by necessity, and scripts differ in their alphabets."),
    _spec("acct_followback_ratio", "Followers over followers and followed.", "Accounts that follow many and are followed by few are made to be noticed.", "New users and readers look the same, and followers can be bought in bulk."),
    _spec("acct_profile_completeness", "Share of the profile fields that are filled.", "Nobody fills in the profiles of accounts that are made in large numbers.", "Privacy-minded people leave them empty, and careful operators fill them in."),
    _spec("acct_dormancy_days", "Days from creation to the first observed post.", "Stockpiled accounts sleep for long before they are put to their use.", "Older posts may be missing from the corpus, which looks like dormancy.", "days", 0.0, None),
)


class AccountExtractor:
    name = "account"

    def __init__(self, config: AccountConfig = AccountConfig()) -> None:
        self.config = config

    def specs(self) -> tuple[FeatureSpec, ...]:
        return SPECS

    def extract(self, corpus) -> DataFrame:
        """Features of every account; NULL where a field they need is missing."""
        fields, avatar = available_fields(corpus.accounts, self.config.profile_fields)
        first = corpus.posts.groupBy("account_id").agg(F.min("created_at").alias("_first_post"))
        rows = corpus.accounts_by_id().join(first, "account_id", "left")
        found = rows.select("account_id", *features(reference_instant(corpus, self.config.reference_time), fields, avatar, self.config))
        return corpus.spine().join(found, "account_id", "left")


def features(reference: Column, fields: tuple[str, ...], avatar: bool, config: AccountConfig = AccountConfig()) -> list[Column]:
    """The columns over an account row with _first_post."""
    age = days_between(reference, F.col("created_at"))
    handle, hidden = F.col("handle"), pseudonymised_identity()
    shaped = handle.isNotNull() & (F.length(handle) >= config.min_handle_length) & ~hidden
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in fields]
    picture = F.col("has_default_profile_image") if avatar else None
    full = completeness(filled, picture)
    if "display_name" in fields:
        others = [f for c, f in zip(fields, filled, strict=True) if c != "display_name"]
        full = F.when(hidden, completeness(others, picture)).otherwise(full)
    followers, following = F.col("followers_count"), F.col("following_count")
    return [
        age.alias("acct_age_days"),
        safe_ratio(F.col("post_count"), age).alias("acct_posts_per_day"),
        F.when(shaped, digit_ratio(handle)).alias("acct_handle_digit_ratio"),
        F.when(shaped, trailing_digits(handle)).alias("acct_handle_trailing_digits"),
        F.when(shaped, character_entropy(F.lower(handle))).alias("acct_handle_entropy"),
        safe_ratio(followers, followers + following).alias("acct_followback_ratio"),
        full.alias("acct_profile_completeness"),
        F.when(F.col("_first_post").isNotNull() & F.col("created_at").isNotNull(), F.greatest(days_between(F.col("_first_post"), F.col("created_at")), F.lit(0.0))).alias("acct_dormancy_days"),
    ]
