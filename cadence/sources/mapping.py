"""Raw rows to typed records, with a reason for every row that is refused."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.corpus import ACCOUNTS, KINDS, LABEL_ROWS, LABELS, PLATFORMS, POSTS
from cadence.functions.scalar import as_boolean, as_integer, as_list, blank_to_null, corrupted_identifier, normalised_handle
from cadence.functions.timestamps import let, parsed_struct
from cadence.sources.raw import names_of

#: Column names in use and the fields they mean (fixed values).
POST_ALIASES: dict[str, tuple[str, ...]] = {
    "post_id": ("id", "status_id", "tweet_id", "tweetid"),
    "account_id": ("author", "author_id", "user", "user_id", "userid"),
    "created_at": ("created", "date", "time", "timestamp", "tweet_time"),
    "text": ("body", "content", "full_text", "message", "tweet_text"),
    "language": ("lang",),
    "parent_post_id": ("in_reply_to", "parent_id"),
    "root_post_id": ("conversation_id", "thread_id"),
    "like_count": ("favorite_count", "likes"),
    "repost_count": ("retweet_count", "shares"),
    "reply_count": ("replies",),
    "client": ("source",),
}
ACCOUNT_ALIASES: dict[str, tuple[str, ...]] = {
    "account_id": ("id", "user_id", "userid", "author_id"),
    "handle": ("acct", "screen_name", "username", "user_screen_name"),
    "display_name": ("display", "user_display_name"),
    "created_at": ("account_created_at", "created", "joined"),
    "description": ("bio", "profile_description", "user_profile_description"),
    "followers_count": ("followers", "follower_count"),
    "following_count": ("friends_count", "following"),
    "post_count": ("posts", "statuses_count", "tweet_count"),
}
LABEL_METHODS = ("human_annotation", "platform_enforcement", "self_declaration", "heuristic", "unknown")


@dataclass(frozen=True)
class MappingConfig:
    """How untidy values are read; nothing is guessed beyond it."""

    platform: str = "generic"
    assume_offset_hours: float | None = None
    date_order: str | None = None
    post_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: POST_ALIASES)
    account_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: ACCOUNT_ALIASES)
    list_separator: str = "|"
    post_row_transform: Callable[[Column], Column] | None = None
    #: The names that the transform sets in every row, if it leaves all others as they are.
    post_row_sets: tuple[str, ...] = ()
    strict: bool = False

    def __post_init__(self) -> None:
        if self.date_order not in (None, "dmy", "mdy"):
            raise ValueError("date_order is dmy, mdy or None")


class Row:
    """The fields of raw rows as columns, by their own names or aliases; an own name wins unless blank.

    The ``judged`` fields, which tell whether a row is refused, are taken out of the row once, so what
    is computed from them stays a small expression; others are taken where they are asked for.  Where
    all rows have the same ``names``, fields are looked up by these and no row's names are searched.
    """

    def __init__(self, raw: DataFrame, aliases: Mapping[str, tuple[str, ...]], judged: list[str], names: list[str] | None = None) -> None:
        self.aliases, self.judged, self.names = aliases, judged, names
        self.taken = [a for listed in aliases.values() for a in listed]
        if names is not None:
            self.table = once(raw, F.struct(*(self._told(name).alias(f"_{name}") for name in judged)))
            return
        entries = F.transform(F.map_entries("row"), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.lower(F.trim(e["key"])).alias("low"), e["value"].alias("value")))

        def taken(e: Column) -> Column:
            return F.struct(e.alias("_entries"), *(_field(e, name, aliases).alias(f"_{name}") for name in judged))

        self.table = once(raw, let(entries, taken))

    def _told(self, name: str) -> Column:
        """``_field`` of a row whose names are known."""
        own = next((n for n in self.names if n.strip(" ") == name), None)
        other = next((n for n in self.names if n.strip(" ").lower() in self.aliases.get(name, ())), None)
        cells = [blank_to_null(F.element_at("row", F.lit(n))) for n in (own, other) if n is not None]
        return F.struct(F.coalesce(*cells, F.lit(None).cast("string")).alias("value"), F.lit(bool(cells)).alias("has"))

    def __getitem__(self, name: str) -> Column:
        if name in self.judged:
            return F.col(f"_{name}.value")
        return self._told(name)["value"] if self.names is not None else let(F.col("_entries"), lambda e: _field(e, name, self.aliases))["value"]

    def has(self, name: str) -> Column:
        return F.col(f"_{name}.has")

    def instant(self, name: str, config: MappingConfig) -> tuple[Column, Column]:
        """The instant that a field holds, and why it holds none."""
        self.table = self.table.withColumn(f"_at_{name}", parsed_struct(self[name], config.assume_offset_hours, config.date_order))
        return F.col(f"_at_{name}.at"), F.col(f"_at_{name}.reason")

    def others(self, known: list[str]) -> Column:
        """The entries (key, low, value) of other names than these."""
        if self.names is None:
            return F.filter("_entries", lambda e: ~e["key"].isin(*known))
        rest = [n for n in self.names if n.strip(" ") not in known]
        entries = (F.struct(F.lit(n.strip(" ")).alias("key"), F.lit(n.strip(" ").lower()).alias("low"), F.element_at("row", F.lit(n)).alias("value")) for n in rest)
        return F.array(*entries) if rest else F.array().cast("array<struct<key:string,low:string,value:string>>")

    def extra(self, known: list[str]) -> Column:
        """What is left: columns of other names, and the members of an ``extra`` object."""
        rest = F.filter(self.others([*known, "extra"]), lambda e: ~e["low"].isin(*self.taken) & blank_to_null(e["value"]).isNotNull())
        given = F.from_json(self["extra"], "map<string,string>")
        rest = F.map_from_entries(F.transform(rest, lambda e: F.struct(e["key"], e["value"])))
        return F.when(given.isNull(), rest).otherwise(F.map_concat(F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(rest), k)), rest))


def once(table: DataFrame, row: Column) -> DataFrame:
    """``table`` with the members of a struct as columns, each computed once.

    A filter on a column of a plain select is moved below it with a copy of the column's expression
    for each mention; it can't be moved below a generator.
    """
    return table.select("*", F.inline(F.array(row)))


def _field(e: Column, name: str, aliases: Mapping[str, tuple[str, ...]]) -> Column:
    """The value under the own name, unless blank, else under the first alias, and whether there is such a column."""
    own, other = _place(e["key"], [name]), _place(e["low"], list(aliases.get(name, ())))
    if other is None:
        return let(own, lambda p: F.struct(blank_to_null(F.get(e["value"], p)).alias("value"), p.isNotNull().alias("has")))

    def told(p: Column) -> Column:
        value = F.coalesce(*(blank_to_null(F.get(e["value"], p[k])) for k in ("own", "other")))
        return F.struct(value.alias("value"), (p["own"].isNotNull() | p["other"].isNotNull()).alias("has"))

    return let(F.struct(own.alias("own"), other.alias("other")), told)


def _place(names: Column, wanted: list[str]) -> Column | None:
    """The place of the first of these names, from 0; NULL if none is there."""
    places = [F.nullif(F.array_position(names, n), F.lit(0).cast("long")) for n in wanted]
    return None if not places else (places[0] if len(places) == 1 else F.least(*places)).cast("int") - 1


def _required(row: Row, name: str) -> Column:
    return F.when(row[name].isNull(), F.when(row.has(name), f"{name}:string_type").otherwise(f"{name}:missing"))


def _first(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def _platform(row: Row, default: str) -> Column:
    said = F.lower(row["platform"])
    return F.when(said.isin(*PLATFORMS), said).otherwise(default)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.replace("\n", " ").replace("map<string,string>", "map").split(",")]


def _typed(raw: DataFrame, values: dict[str, Column], reason: Column) -> DataFrame:
    rows = once(raw, F.struct(F.coalesce("problem", reason).alias("_reason")))
    return rows.select("ordinal", *(v.alias(k) for k, v in values.items()), F.col("_reason").alias("reject_reason"))


def post_rows(raw: DataFrame, config: MappingConfig) -> DataFrame:
    """Typed posts with reject_reason; rows that have one are not to be used."""
    names = names_of(raw)
    if config.post_row_transform is not None:
        raw = raw.withColumn("row", config.post_row_transform(F.col("row")))
        names = [*(n for n in names if n not in config.post_row_sets), *config.post_row_sets] if names is not None and config.post_row_sets else None
    known = _names(POSTS)
    row = Row(raw, config.post_aliases, ["post_id", "account_id", "created_at", "collected_at", "kind", "media_count", "like_count", "repost_count", "reply_count"], names)
    created, bad_created = row.instant("created_at", config)
    collected, bad_collected = row.instant("collected_at", config)
    kind = F.coalesce(F.lower(row["kind"]), F.lit("original"))
    counts = {n: as_integer(row[n]) for n in ("media_count", "like_count", "repost_count", "reply_count")}
    values = {n: row[n] for n in known} | {
        "platform": _platform(row, config.platform),
        "created_at": created,
        "collected_at": collected,
        "text": F.coalesce(row["text"], F.lit("")),
        "kind": kind,
        **{n: as_list(row[n], config.list_separator) for n in ("urls", "hashtags", "mentions")},
        **counts,
        "media_count": F.coalesce(counts["media_count"], F.lit(0).cast("long")),
        "extra": row.extra(known),
    }
    reason = _first(
        F.when(row["created_at"].isNull(), "ValueError"),
        bad_created,
        bad_collected,
        *(F.when(corrupted_identifier(row[n]), "corrupted_identifier") for n in ("post_id", "account_id")),
        _required(row, "post_id"),
        _required(row, "account_id"),
        F.when(~kind.isin(*KINDS), "kind:enum"),
        *(F.when(c < 0, f"{n}:greater_than_equal") for n, c in counts.items()),
    )
    return _typed(row.table, values, reason)


def account_rows(raw: DataFrame, config: MappingConfig) -> DataFrame:
    """Typed accounts with reject_reason."""
    known = _names(ACCOUNTS)
    row = Row(raw, config.account_aliases, ["account_id", "created_at", "collected_at", "followers_count", "following_count", "post_count"], names_of(raw))
    created, bad_created = row.instant("created_at", config)
    collected, bad_collected = row.instant("collected_at", config)
    counts = {n: as_integer(row[n]) for n in ("followers_count", "following_count", "post_count")}
    flags = {n: as_boolean(row[n]) for n in ("verified", "protected", "has_default_profile_image", "declared_automated")}
    values = {n: row[n] for n in known} | {
        "platform": _platform(row, config.platform),
        "handle": normalised_handle(row["handle"]),
        "created_at": created,
        "collected_at": collected,
        **counts,
        **flags,
        "extra": row.extra(known),
    }
    reason = _first(
        bad_created,
        bad_collected,
        F.when(corrupted_identifier(row["account_id"]), "corrupted_identifier"),
        _required(row, "account_id"),
        *(F.when(c < 0, f"{n}:greater_than_equal") for n, c in counts.items()),
    )
    return _typed(row.table, values, reason)


def label_rows(raw: DataFrame, config: MappingConfig) -> DataFrame:
    """Typed labels with reject_reason; columns that are no field are refused."""
    known = _names(LABEL_ROWS)
    row = Row(raw, {}, ["account_id", "label", "dataset", "confidence", "labelled_at"], names_of(raw))
    labelled, bad = row.instant("labelled_at", config)
    label, method = F.lower(row["label"]), F.coalesce(F.lower(row["method"]), F.lit("unknown"))
    confidence = row["confidence"].try_cast("double")
    other = F.get(row.others(known), 0)["key"]
    values = {n: row[n] for n in known} | {"platform": _platform(row, config.platform), "label": label, "method": method, "confidence": confidence, "labelled_at": labelled}
    reason = _first(
        bad,
        _required(row, "account_id"),
        _required(row, "label"),
        F.when(~label.isin(*LABELS), "label:enum"),
        _required(row, "dataset"),
        F.when(row["confidence"].isNotNull() & confidence.isNull(), "confidence:float_parsing"),
        F.when(confidence < 0, "confidence:greater_than_equal"),
        F.when(confidence > 1, "confidence:less_than_equal"),
        F.concat(other, F.lit(":extra_forbidden")),
    )
    return _typed(row.table, values, reason)


def rejects(kind: str, typed: DataFrame) -> DataFrame:
    """reason (kind:reason) and n of the rows that were refused."""
    bad = typed.filter("reject_reason is not null")
    return bad.groupBy(F.concat(F.lit(f"{kind}:"), "reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def accepted(typed: DataFrame) -> DataFrame:
    return typed.filter("reject_reason is null").drop("reject_reason", "ordinal")
