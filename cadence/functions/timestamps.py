"""Strict timestamps: nothing is guessed.

A time without a zone is refused unless one is assumed, and a slash date whose order the numbers do
not settle is refused unless an order is declared.  Every pattern is gated by an expression before a
cast, since casts would apply the session's zone silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAIVE, AMBIGUOUS, BAD = "naive_timestamp", "ambiguous_date", "ValueError"
#: Epochs beyond this are milliseconds (fixed value).
MILLISECONDS = 1e11

_NUMBER = r"^[+-]?[0-9]+([.][0-9]+)?$"
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2}(?:[.][0-9]{1,6})?)[0-9]*)?)?)? ?(Z|z|[+-][0-9]{2}:?[0-9]{2})?$"
_BASIC = r"^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})?([0-9]{2}(?:[.][0-9]{1,6})?)?[0-9]*(Z|z|[+-][0-9]{2}:?[0-9]{2})?$"
_YEAR_FIRST = r"^([0-9]{4})(?:/([0-9]{1,2})/([0-9]{1,2})(?: ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}))?|-([0-9]{1,2})-([0-9]{1,2})(?: ([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?)$"
_SLASH = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?$"
_WORDY = r"^[A-Za-z]{3} ([A-Za-z]{3}) ([0-9]{1,2}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) ([+-][0-9]{4}) ([0-9]{4})$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _zone(text: Column) -> Column:
    """Offset in microseconds of ``Z`` or ``+hh:mm``; NULL if there is none."""
    digits = F.regexp_replace(text, ":", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    return F.when(F.upper(text) == "Z", F.lit(0).cast("long")).when(F.length(digits) == 5, (sign * minutes).cast("long") * 60_000_000)


def _wall(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Microseconds of a wall-clock time in UTC; NULL if there is no such time."""
    zero = F.lit("0")
    made = F.try_make_timestamp(
        year.try_cast("int"),
        month.try_cast("int"),
        day.try_cast("int"),
        F.coalesce(hour, zero).try_cast("int"),
        F.coalesce(minute, zero).try_cast("int"),
        F.coalesce(second, zero).try_cast("decimal(16,6)"),
        F.lit("UTC"),
    )
    return F.unix_micros(made)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), 0)


def _parts(body: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern, which have no semicolon, as an array; groups that didn't match are empty texts.

    A body that matches is matched once more for all groups together, with what may follow its end.
    """
    return F.split(F.regexp_replace(body, rf"{pattern}[\s\S]*", ";".join(f"${k}" for k in range(1, groups + 1))), ";")


def _filled(parts: Column, k: int) -> Column:
    return F.when(F.get(parts, k) != "", F.get(parts, k))


def _iso_of(body: Column) -> Column:
    """wall and zone of an ISO 8601 time, in the extended or the basic form."""

    def made(parts: Column) -> Column:
        return F.struct(_wall(*(_filled(parts, k) for k in range(6))).alias("wall"), let(F.get(parts, 6), _zone).alias("zone"))

    return F.when(body.rlike(_ISO), let(_parts(body, _ISO, 7), made)).when(body.rlike(_BASIC), let(_parts(body, _BASIC, 7), made))


def _year_first_of(body: Column) -> Column:
    """The wall-clock time of a date that begins with the year, with slashes or short numbers."""

    def made(parts: Column) -> Column:
        return _wall(F.get(parts, 0), *(F.coalesce(_filled(parts, k), _filled(parts, k + 5)) for k in range(1, 6)))

    return F.when(body.rlike(_YEAR_FIRST), let(_parts(body, _YEAR_FIRST, 11), made))


def _wordy_of(body: Column) -> Column:
    names = F.array(*(F.lit(m) for m in _MONTHS))

    def made(parts: Column) -> Column:
        month = F.array_position(names, F.lower(F.get(parts, 0))).cast("string")
        return _wall(F.get(parts, 6), month, F.get(parts, 1), F.get(parts, 2), F.get(parts, 3), F.get(parts, 4)) - let(F.get(parts, 5), _zone)

    return F.when(body.rlike(_WORDY), let(_parts(body, _WORDY, 7), made))


def _slash_of(body: Column, date_order: str | None) -> Column:
    """wall and unclear of a slash date: a component over 12 settles the order, else the declared one."""

    def made(parts: Column) -> Column:
        first, second = F.get(parts, 0).cast("int"), F.get(parts, 1).cast("int")
        order = F.when((first > 12) & (second <= 12), "dmy").when((second > 12) & (first <= 12), "mdy")
        order = order.when((first <= 12) & (second <= 12), F.lit(date_order))

        def read(said: Column) -> Column:
            day, month = F.when(said == "dmy", F.get(parts, 0)).otherwise(F.get(parts, 1)), F.when(said == "dmy", F.get(parts, 1)).otherwise(F.get(parts, 0))
            wall = F.when(said.isNotNull(), _wall(F.get(parts, 2), month, day, *(_filled(parts, k) for k in (3, 4, 5))))
            return F.struct(wall.alias("wall"), (said.isNull() & F.lit(date_order is None)).alias("unclear"))

        return let(order, read)

    return F.when(body.rlike(_SLASH), let(_parts(body, _SLASH, 6), made))


def parsed(text: Column, assume_offset_hours: float | None = None, date_order: str | None = None) -> tuple[Column, Column]:
    """(instant, reason): a timestamp, or why there is none.

    ``date_order`` is ``mdy`` or ``dmy``.  NULL and blank texts have neither.
    """
    both = parsed_struct(text, assume_offset_hours, date_order)
    return both["at"], both["reason"]


def parsed_struct(text: Column, assume_offset_hours: float | None = None, date_order: str | None = None) -> Column:
    """``parsed`` as one struct of at and reason."""
    assumed = F.lit(None).cast("long") if assume_offset_hours is None else F.lit(round(assume_offset_hours * 3_600_000_000)).cast("long")

    def epoch(number: Column) -> Column:
        return F.round(F.when(F.abs(number) > MILLISECONDS, number / 1000.0).otherwise(number) * 1e6).cast("long")

    def read(body: Column) -> Column:
        known = F.struct(
            F.when(body.rlike(_NUMBER), let(body.try_cast("double"), epoch)).alias("epoch"),
            _iso_of(body).alias("iso"),
            _wordy_of(body).alias("wordy"),
            _slash_of(body, date_order).alias("slash"),
        )

        def settle(k: Column) -> Column:
            def judged(wall: Column) -> Column:
                micros = F.coalesce(k["epoch"], k["wordy"], wall - F.coalesce(k["iso"]["zone"], assumed))
                return F.struct(micros.alias("micros"), wall.isNotNull().alias("naive"), F.coalesce(k["slash"]["unclear"], F.lit(False)).alias("unclear"))

            return let(F.coalesce(k["iso"]["wall"], k["slash"]["wall"], _year_first_of(body)), judged)

        def told(m: Column) -> Column:
            reason = F.when(F.coalesce(body, F.lit("")) == "", None).when(m["micros"].isNotNull(), None).when(m["unclear"], AMBIGUOUS).when(m["naive"], NAIVE).otherwise(BAD)
            return F.struct(F.timestamp_micros(m["micros"]).alias("at"), reason.alias("reason"))

        return let(let(known, settle), told)

    return let(F.trim(text), read)
