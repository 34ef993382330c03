"""Scalar expressions: entropy, ratios, handle shape, coercions.  A missing value is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.timestamps import let

#: Spellings of booleans (fixed values).
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
#: An identifier that a spreadsheet has turned into a float (fixed pattern).
CORRUPTED_ID = r"^[0-9]+([.][0-9]+)?[eE][+-]?[0-9]+$"


def entropy(counts: Column, bins: int | Column | None = None) -> Column:
    """Shannon entropy of an array of counts over log2 of the bins (its size), from 0 to 1."""

    def of(known: Column) -> Column:
        width = F.size(known) if bins is None else (F.lit(bins) if isinstance(bins, int) else bins)

        def with_total(total: Column) -> Column:
            bits = F.aggregate(known, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))
            return F.when((total <= 0) | (width <= 1), 0.0).otherwise(F.abs(bits) / F.log2(width.cast("double")))

        return let(F.aggregate(known, F.lit(0.0), lambda a, c: a + c), with_total)

    return F.when(counts.isNotNull(), let(F.transform(counts, lambda c: c.cast("double")), of))


def run_lengths(ordered: Column) -> Column:
    """The lengths of the runs of equal elements of an array."""

    def cuts(items: Column) -> Column:
        places = F.transform(items, lambda x, i: F.when((i == 0) | (x != F.get(items, i - 1)), i))
        return let(F.filter(places, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(items)) - i))

    return let(ordered, cuts)


def character_entropy(text: Column) -> Column:
    """Entropy of the characters of a text, by the number of distinct ones."""
    counts = run_lengths(F.array_sort(F.split(text, "")))
    return F.when(F.length(text) > 0, entropy(counts)).when(text.isNotNull(), 0.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient; NULL if either side is missing or the denominator is 0."""
    return F.when(denominator != 0, F.try_divide(numerator.cast("double"), denominator.cast("double")))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def band(fingerprint: Column, number: int, bits: int = 8) -> Column:
    """Bits of a 64-bit fingerprint, from the lowest band up."""
    return F.shiftrightunsigned(fingerprint, number * bits).bitwiseAND((1 << bits) - 1)


def digit_ratio(text: Column) -> Column:
    return safe_ratio(F.length(F.regexp_replace(text, r"[^\p{Nd}]", "")), F.length(text))


def trailing_digits(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"(\p{Nd}*)$", 1)).cast("double")


def days_between(later: Column, earlier: Column) -> Column:
    """Days from one instant to another, to the microsecond; may be negative."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def quiet_share(histogram: Column, hours: int = 6) -> Column:
    """Share of the quietest run of hours around the clock."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, c: a + c)
    starts = F.sequence(F.lit(0), F.lit(23))
    sums = F.transform(starts, lambda s: F.aggregate(F.sequence(s, s + hours - 1), F.lit(0).cast("long"), lambda a, h: a + F.element_at(histogram, h % 24 + 1)))
    return F.when(total > 0, F.array_min(sums) / total)


def log_bin(gap: Column, last: int = 20) -> Column:
    """The doubling of seconds that a gap falls in, capped."""
    return F.when(gap.isNotNull(), F.least(F.floor(F.log2(F.greatest(gap, F.lit(1.0)))).cast("int"), F.lit(last)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def as_integer(text: Column) -> Column:
    """A whole number, through a float if need be; anything else is NULL."""
    return F.coalesce(text.try_cast("bigint"), F.when(~F.isnan(text.try_cast("double")), text.try_cast("double").try_cast("bigint")))


def as_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def as_list(text: Column, separator: str = "|") -> Column:
    """A JSON array, a bracketed list or separated items, trimmed, without blanks."""
    body = F.trim(text)
    parsed = F.from_json(body, "array<string>", {"mode": "PERMISSIVE"})
    quoted = r"^['\"]+|['\"]+$"
    bracketed = F.transform(F.split(F.regexp_replace(body, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), quoted, ""))
    separated = F.split(body, "[" + separator + "]")
    json_ok = body.startswith("[") & parsed.isNotNull() & ~F.exists(parsed, lambda x: x.isNull())
    items = F.when(json_ok, parsed).when(body.startswith("[") & body.endswith("]"), bracketed).otherwise(separated)
    return F.when(body.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def normalised_handle(text: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.trim(text), "^@+", ""))


def corrupted_identifier(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(CORRUPTED_ID), F.lit(False))


def completeness(fields: Sequence[Column], default_picture: Column | None = None) -> Column:
    """Share of the fields that are filled; of no field, NULL.

    A known default picture counts as a field that is not filled, any other known one as filled.
    """
    filled, counted = F.lit(0.0), F.lit(float(len(fields)))
    for f in fields:
        filled = filled + F.when(f, 1.0).otherwise(0.0)
    if default_picture is not None:
        filled = filled + F.when(~default_picture, 1.0).otherwise(0.0)
        counted = counted + F.when(default_picture.isNotNull(), 1.0).otherwise(0.0)
    return safe_ratio(filled, counted)


def active_days_ratio(days: Column, span_days: Column) -> Column:
    return F.least(days / F.greatest(F.ceil(span_days), F.lit(1)), F.lit(1.0))

