"""Secret scans with DataFrame expressions only: fixed patterns, and windows of high entropy.

Positions are code points with exclusive ends.  They come from the lengths of the parts between the
matches of a pattern and of the matches themselves, so nothing leaves the row and nothing shuffles.

The entropy scan slides a window over each candidate, a long run of one character class, and keeps
the counts of the characters in the window: entering and leaving characters change the sum of
c * log2(c), from which Shannon's entropy of the window follows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm._shared import free_names

#: The patterns of the base kinds (fixed values), in the order of their listing.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: What a document must contain for the assign pattern to be tried at all.
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters, the window length and the entropy in bits that makes a finding."""

    kind: str
    pattern: str
    alphabet: str
    fold: bool
    window: int
    bits: float
    needs: str


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", True, 20, 3.0, r"(?=.*[0-9])(?=.*[A-Fa-f])"),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", False, 20, 3.9, r"(?=.*[0-9])(?=.*[A-Za-z])"),
)
#: What matches one of these is no secret: UUIDs, placeholders, counted alphabets.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)example|placeholder|dummy|sample",
    r"(.)\1{5,}",
    r"(?i)0123456789|abcdefghij",
)

#: Matches that are listed together.
CHUNK = 128
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>"


def located(text: Column, pattern: str, kind: str, rank: int, hint: Column) -> Column:
    """The leftmost non-overlapping matches of a pattern, as an array of spans."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m.alias("m")))
    nothing = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("found"))
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(x["m"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"),
        )

    def chunk(state: Column, some: Column) -> Column:
        """A chunk of matches at once, so a text of many matches doesn't copy its list for each."""
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), nothing.alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda y: F.struct(y["at"].alias("at"), F.concat(state["out"], F.array(y["out"])).alias("out"))), 0)

    def listed(all_steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_steps, k * CHUNK + 1, CHUNK))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        return F.aggregate(chunks, start, chunk, lambda state: F.flatten(state["out"]))

    return F.when(hint, F.get(F.transform(F.array(steps), listed), 0)).otherwise(nothing)


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def dense_part(candidate: Column, which: CharacterClass) -> Column:
    """(first, last): where windows over the limit begin and end in a candidate; nulls if none does."""
    text = F.lower(candidate) if which.fold else candidate
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(which.alphabet), c))
    codes = F.filter(codes, lambda c: c > 0)
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.when(i >= which.window, F.element_at(codes, i - which.window + 1)).otherwise(F.lit(0)).alias("leaves"), i.alias("at")))
    start = F.struct(
        F.array_repeat(F.lit(0), len(which.alphabet) + 1).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(state: Column, x: Column) -> Column:
        out = F.element_at(state["counts"], x["leaves"] + 1)
        kept = F.when(x["leaves"] > 0, state["total"] - _weight(out) + _weight(out - 1)).otherwise(state["total"])
        now = F.element_at(state["counts"], x["enters"] + 1) - F.when(x["leaves"] == x["enters"], 1).otherwise(0)
        total = kept - _weight(now) + _weight(now + 1)
        counts = F.transform(state["counts"], lambda c, i: c + F.when(i == x["enters"], 1).otherwise(0) - F.when((i == x["leaves"]) & (i > 0), 1).otherwise(0))
        full = x["at"] >= which.window - 1
        dense = full & (F.lit(math.log2(which.window)) - total / which.window >= which.bits)
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(dense & state["first"].isNull(), x["at"] - which.window + 1).otherwise(state["first"]).alias("first"),
            F.when(dense, x["at"] + 1).otherwise(state["last"]).alias("last"),
        )

    return F.aggregate(pairs, start, step, lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))


def scanned(docs: DataFrame, *, text: str = "text", allowed: tuple[str, ...] = ALLOWED, classes: tuple[CharacterClass, ...] = CLASSES, added: tuple[str, str] = ("base", "dense")) -> DataFrame:
    """``docs`` with base and dense spans, arrays of (start, rank, end, kind, found), under the names ``added``.

    No column of ``docs`` may be called so.  A null text is an empty one and has no spans.  Every row
    is treated by itself.  What the allow-list matches parts a candidate, and what a base span covers
    is cut out of a dense one; the parts that are a window long stay.
    """
    if free_names(docs, *added) != list(added):
        raise ValueError(f"the table has a column of {', '.join(added)} already; name others")
    names, (base, dense) = docs.columns, added
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assign = located(body, ASSIGN, "assign", 0, body.rlike(ASSIGN_HINT))
    access = located(body, ACCESS, "access", 1, F.contains(body, F.lit("AKIA")))
    hexes = located(body, HEX, "hex", 2, body.rlike(HEX))
    long_enough = F.filter(assign, lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 1)) >= ASSIGN_LEAST)
    each = free_names(docs.select(*names, *(F.lit(0).alias(n) for n in added)), *(f"dense{k}" for k in range(len(classes))))
    out = docs.withColumn(base, F.array_sort(F.concat(long_enough, access, hexes)))
    for k, which in enumerate(classes):
        out = out.withColumn(each[k], _dense_spans(body, which, 3 + k, allowed))
    every = F.concat(*(F.flatten(F.transform(n, lambda x, w=which.window: _apart(x, F.col(base), w))) for n, which in zip(each, classes, strict=True))) if classes else F.array().cast(_SPANS)
    return out.withColumn(dense, F.array_sort(every)).select(*names, *added)


def _apart(span: Column, base: Column, window: int) -> Column:
    """The parts of a span that no base span (in order of start) covers and that are a window long."""
    near = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    starts = F.concat(F.array(span["start"]), F.transform(near, lambda b, i: F.array_max(F.transform(F.slice(near, 1, i + 1), lambda x: x["end"]))))
    ends = F.concat(F.transform(near, lambda b: b["start"]), F.array(span["end"]))
    parts = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), span["rank"].alias("rank"), b.alias("end"), span["kind"].alias("kind"), span["found"].alias("found")))
    return F.when(F.size(near) == 0, F.array(span)).otherwise(F.filter(parts, lambda x: x["end"] - x["start"] >= window))


def _dense_spans(body: Column, which: CharacterClass, rank: int, allowed: tuple[str, ...]) -> Column:
    """The parts of high entropy of the candidates of one class, and of what the allow-list leaves of them."""
    found = located(body, which.pattern, which.kind, rank, body.rlike(which.pattern))
    found = F.filter(found, lambda x: x["found"].rlike(which.needs))
    if allowed:
        listed = "|".join(f"(?:{p})" for p in allowed)
        found = F.flatten(F.transform(found, lambda x: F.when(x["found"].rlike(listed), _parted(x, listed)).otherwise(F.array(x))))
        found = F.filter(found, lambda x: (F.length(x["found"]) >= which.window) & x["found"].rlike(which.needs))
    dense = F.transform(found, lambda x: F.struct(x.alias("x"), dense_part(x["found"], which).alias("d")))
    return F.transform(
        F.filter(dense, lambda y: y["d"]["first"].isNotNull()),
        lambda y: F.struct(
            (y["x"]["start"] + y["d"]["first"]).alias("start"),
            y["x"]["rank"].alias("rank"),
            (y["x"]["start"] + y["d"]["last"]).alias("end"),
            y["x"]["kind"].alias("kind"),
            y["x"]["found"].alias("found"),
        ),
    )


def _parted(span: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern in the text of a span, as spans."""
    found = F.regexp_extract_all(span["found"], F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(span["found"], pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x["gap"])
        part = F.struct(state["at"].alias("start"), span["rank"].alias("rank"), end.alias("end"), span["kind"].alias("kind"), x["gap"].alias("found"))
        return F.struct((end + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.concat(state["out"], F.array(part)).alias("out"))

    start = F.struct(span["start"].alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(steps, start, step, lambda state: state["out"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and dense, by start and kind)."""
    found = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return found.select(
        "doc_id",
        *(_count(kind) for kind in ("assign", "access", "hex")),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "dense"))).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by the mask; other columns are kept."""
    base, dense = free_names(docs, "base", "dense")
    found = scanned(docs, added=(base, dense))
    spans = F.array_sort(F.concat(base, dense))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - state["at"]).cast("int"))
        fresh = x["start"] >= state["at"]
        return F.struct(
            F.concat(state["out"], before, F.when(fresh, F.lit(mask)).otherwise(F.lit(""))).alias("out"),
            F.greatest(state["at"], x["end"]).alias("at"),
        )

    done = F.aggregate(spans, start, step)
    rest = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text"))
    text = F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
